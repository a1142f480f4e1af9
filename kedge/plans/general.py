"""Queries of the general data-processing operators: p1 (hierarchies), p2 (broken rows), p4 (heavy keys)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kedge.operators import hierarchy, skew
from kedge.session import cut, table
from kedge.sources import occurrence_lines


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = hierarchy.redirect_edges(table(spark, d, "redirects"))
    return hierarchy.resolve(nodes, edges).select("node", "root", "depth", "kind")


def p1_paths(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = hierarchy.redirect_edges(table(spark, d, "redirects"))
    got = hierarchy.resolve(nodes, edges, paths=True)
    return got.select("node", "root", "depth", "kind", F.array_join("path", " > ").alias("path"))


def p1_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Every title with those that it leads to; a circle is one class, with p1_found as its membership."""
    nodes, edges = hierarchy.redirect_edges(table(spark, d, "redirects"))
    return hierarchy.descendants(hierarchy.resolve(nodes, edges, paths=True))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return occurrence_lines.rejects(occurrence_lines.read_occurrence_lines(table(spark, d, "occs_raw")))


def p2_rows(spark: SparkSession, d: str) -> DataFrame:
    return occurrence_lines.loaded(occurrence_lines.read_occurrence_lines(table(spark, d, "occs_raw")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    occs = table(spark, d, "occs").filter(F.col("uri").isNotNull()).select("uri", "occ_id")
    rows = skew.salted_aggregate(occs, ["uri"], [skew.count_of("n")], spread=["occ_id"])
    slices = table(spark, d, "dbpediaresource").filter(F.col("uri").isNotNull()).select("uri", "slice_id", "uri_count")
    counts = skew.salted_aggregate(slices, ["uri"], [skew.sum_of("uri_count", "n")], spread=["slice_id"])
    of = lambda df, field: skew.share_of_total(df, "n", 0.01).select(F.lit(field).alias("field"), "uri")
    return of(rows, "uri").unionByName(of(counts, "uri_count"))


def p4_per_uri(spark: SparkSession, d: str) -> DataFrame:
    """Per uri: rows, characters of context, distinct surface forms, and the resource's count."""
    occs = table(spark, d, "occs").select("occ_id", "uri", "surface_form", F.char_length("context").alias("chars"))
    rows = skew.salted_aggregate(occs, ["uri"], [skew.count_of("n_rows"), skew.sum_of("chars", "context_chars"), skew.min_of("occ_id", "first_occ"), skew.max_of("occ_id", "last_occ")], spread=["occ_id"])
    forms = skew.salted_count_distinct(occs, ["uri"], "surface_form", "n_forms")
    slices = table(spark, d, "dbpediaresource").select("uri", "slice_id", "uri_count")
    counts = skew.salted_aggregate(slices, ["uri"], [skew.sum_of("uri_count", "uri_count")], spread=["slice_id"])
    out = rows.filter(F.col("uri").isNotNull()).join(forms, "uri", "left").join(counts, "uri", "left")
    return out.select("uri", "n_rows", "context_chars", "first_occ", "last_occ", F.coalesce("n_forms", F.lit(0)).alias("n_forms"), "uri_count")


def p4_occs_with_counts(spark: SparkSession, d: str) -> DataFrame:
    """Every occurrence with its resource's count: a join on the skewed key."""
    occs = table(spark, d, "occs").select("occ_id", "uri")
    slices = table(spark, d, "dbpediaresource").filter(F.col("uri").isNotNull()).select("uri", "slice_id", "uri_count")
    counts = skew.salted_aggregate(slices, ["uri"], [skew.sum_of("uri_count", "uri_count")], spread=["slice_id"]).withColumnRenamed("uri", "res_uri")
    return skew.salted_join(occs, counts, "uri", "res_uri", how="left", spread=["occ_id"]).select("occ_id", "uri", "uri_count")


#: Text of the p1 queries that follow: edges(node, parent) and nodes(node) of the redirects table.
_TITLE = "url_decode(replace(regexp_replace(regexp_replace(regexp_replace({0}, '^<|>$', '', 'g'), '^http://kb\\.example/resource/', ''), '%([^0-9A-Fa-f]|[0-9A-Fa-f][^0-9A-Fa-f]|[0-9A-Fa-f]?$)', '%25\\1', 'g'), '+', '%2B'))"
_EDGES = f"""
rows AS (SELECT {_TITLE.format("subj")} AS node, {_TITLE.format("obj")} AS parent, line_no FROM redirects WHERE subj IS NOT NULL AND obj IS NOT NULL),
nodes AS (SELECT node FROM rows UNION SELECT parent FROM rows),
edges AS (SELECT node, arg_max(parent, line_no) AS parent FROM rows GROUP BY node),
walk AS (
  SELECT node, node AS cur, [node] AS path FROM nodes
  UNION ALL
  SELECT w.node, e.parent, list_append(w.path, e.parent) FROM walk w JOIN edges e ON e.node = w.cur WHERE NOT list_contains(w.path, e.parent)),
ends AS (
  SELECT w.node, w.cur, w.path, e.parent AS back FROM walk w LEFT JOIN edges e ON e.node = w.cur
  WHERE e.parent IS NULL OR list_contains(w.path, e.parent)),
found AS (
  SELECT node,
    CASE WHEN back IS NULL THEN cur ELSE list_min(path[list_position(path, back):]) END AS root,
    CASE WHEN back IS NULL THEN len(path) - 1 ELSE list_position(path, back) - 1 END AS depth,
    CASE WHEN back IS NULL THEN 'tree' WHEN list_position(path, back) = 1 THEN 'cycle' ELSE 'tail' END AS kind,
    path FROM ends)
"""
_FIELD = '(?:"(?:[^"]|"")*"|[^"\\t][^\\t]*|)'
_P2 = f"""
WITH raw AS (
  SELECT line_id, file_name, line,
    regexp_full_match(line, '(?s:{_FIELD}(?:\\t{_FIELD})*)') AS quoted,
    list_transform(regexp_extract_all(chr(9) || line, '(?s:\\t({_FIELD}))', 1), lambda f: CASE WHEN f LIKE '"%' THEN replace(substr(f, 2, length(f) - 2), '""', '"') ELSE f END) AS f
  FROM occs_raw),
judged AS (
  SELECT *, CASE
    WHEN line IS NULL THEN 'columns'
    WHEN NOT quoted THEN 'quoting'
    WHEN len(f) <> 5 THEN 'columns'
    WHEN f[1] = '' OR f[2] = '' OR f[3] = '' OR f[4] = '' THEN 'empty'
    WHEN regexp_matches(list_aggregate(f, 'string_agg', ' '), '[\\x00-\\x08\\x0A-\\x1F\\x{{FFFD}}]') THEN 'chars'
    WHEN NOT regexp_full_match(f[5], '[0-9]+') OR TRY_CAST(f[5] AS HUGEINT) IS NULL OR TRY_CAST(f[5] AS HUGEINT) > 2147483647 THEN 'offset'
    WHEN substr(f[4], CAST(TRY_CAST(f[5] AS HUGEINT) AS BIGINT) + 1, length(f[3])) <> f[3] THEN 'mismatch'
  END AS reason FROM raw)
"""
_COUNTS = "SELECT uri, CAST(sum(uri_count) AS BIGINT) AS uri_count FROM dbpediaresource WHERE uri IS NOT NULL GROUP BY uri"

QUERIES = {f.__name__: f for f in (p1_found, p1_paths, p1_descendants, p2_found, p2_rows, p4_found, p4_per_uri, p4_occs_with_counts)}
SQL = {
    "p1_found": f"WITH RECURSIVE {_EDGES} SELECT node, root, CAST(depth AS BIGINT) AS depth, kind FROM found",
    "p1_paths": f"WITH RECURSIVE {_EDGES} SELECT node, root, CAST(depth AS BIGINT) AS depth, kind, array_to_string(path, ' > ') AS path FROM found",
    "p1_descendants": f"""WITH RECURSIVE {_EDGES} SELECT path[i] AS ancestor, node, CAST(i - 1 AS BIGINT) AS distance
      FROM (SELECT node, path, unnest(generate_series(2, CASE WHEN kind = 'tree' THEN len(path) ELSE depth END)) AS i FROM found)
      UNION ALL SELECT root, node, CAST(depth AS BIGINT) FROM found WHERE kind = 'tail'""",
    "p2_found": f"{_P2} SELECT line_id, reason FROM judged WHERE reason IS NOT NULL",
    "p2_rows": f"{_P2} SELECT line_id, file_name, f[1] AS id, f[2] AS uri, f[3] AS surface_form, f[4] AS context, CAST(f[5] AS INTEGER) AS text_offset FROM judged WHERE reason IS NULL",
    "p4_found": """
      SELECT 'uri' AS field, uri FROM occs WHERE uri IS NOT NULL GROUP BY uri HAVING count(*) >= 0.01 * (SELECT count(uri) FROM occs)
      UNION ALL
      SELECT 'uri_count', uri FROM dbpediaresource WHERE uri IS NOT NULL GROUP BY uri
      HAVING sum(uri_count) > 0 AND sum(uri_count) >= 0.01 * (SELECT sum(uri_count) FROM dbpediaresource WHERE uri IS NOT NULL)""",
    "p4_per_uri": f"""
      SELECT o.uri, count(*) AS n_rows, CAST(sum(length(context)) AS BIGINT) AS context_chars, min(occ_id) AS first_occ, max(occ_id) AS last_occ,
        count(DISTINCT surface_form) AS n_forms, any_value(c.uri_count) AS uri_count
      FROM occs o LEFT JOIN ({_COUNTS}) c ON c.uri = o.uri WHERE o.uri IS NOT NULL GROUP BY o.uri""",
    "p4_occs_with_counts": f"SELECT occ_id, o.uri, c.uri_count FROM occs o LEFT JOIN ({_COUNTS}) c ON c.uri = o.uri",
}
