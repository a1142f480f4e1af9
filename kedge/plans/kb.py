"""Queries of the model-building operators over the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kedge.functions import scalars as S
from kedge.functions import text as T
from kedge.operators import filters, hierarchy, model
from kedge.operators.skew import salted_join
from kedge.session import spread, table
from kedge.sources import sinks

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function as the query of its name, with the SQL that gives the same rows."""

    def wrap(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return wrap


# Pieces of the SQL side.
PAIRS = "pairs AS (SELECT surface_form AS name, uri, count(*) AS n FROM occs WHERE surface_form IS NOT NULL AND uri IS NOT NULL GROUP BY 1, 2)"
RES = "res AS (SELECT uri, CAST(sum(uri_count) AS BIGINT) AS support FROM dbpediaresource WHERE uri IS NOT NULL GROUP BY uri HAVING sum(uri_count) > 0)"
FORMS = "forms AS (SELECT name, CAST(sum(annotated_count) AS BIGINT) AS annotated, CAST(coalesce(sum(CASE WHEN total_count > 0 THEN total_count END), -1) AS BIGINT) AS total FROM surface_forms WHERE name IS NOT NULL AND annotated_count >= 0 GROUP BY name)"
LOWER = "lower_rows AS (SELECT lower(name) AS lower, CAST(arg_max(total_count, sf_id) AS BIGINT) AS lower_count FROM surface_forms WHERE name IS NOT NULL AND annotated_count = -1 GROUP BY 1)"
WORDS = "regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}]+')"
CTX = f"ctx AS (SELECT uri, token, count(*) AS n FROM (SELECT uri, unnest({WORDS.format('context')}) AS token FROM occs WHERE uri IS NOT NULL) GROUP BY uri, token)"
CAND = f"{PAIRS}, {RES}, cand AS (SELECT p.name, p.uri, p.n, CAST(sum(p.n) OVER (PARTITION BY p.name) AS BIGINT) AS annotated FROM pairs p), candidates AS (SELECT c.name, c.uri, c.n, c.annotated, r.support, c.n / c.annotated AS prior FROM cand c JOIN res r ON r.uri = c.uri)"


def occs_of(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "occs")


def kb_model(spark: SparkSession, d: str, write=None) -> model.Model:
    """The model of the test tables: lazy for queries of one table, written once (``write=cut``) for those that link."""
    given = {"write": write} if write else {}
    return model.build(occs_of(spark, d), table(spark, d, "dbpediaresource"), table(spark, d, "surface_forms"), **given)


@query(f"WITH {FORMS} SELECT name, annotated, total FROM forms")
def a11_surface_form_counts(spark: SparkSession, d: str) -> DataFrame:
    return model.surface_form_counts(table(spark, d, "surface_forms"))


@query(f"WITH {LOWER} SELECT lower, lower_count FROM lower_rows")
def a12_lowercase_counts(spark: SparkSession, d: str) -> DataFrame:
    return model.lowercase_counts(table(spark, d, "surface_forms"))


@query(f"WITH {FORMS} SELECT name, CASE WHEN total = -1 THEN 1.0 WHEN total = 0 THEN 0.0 ELSE annotated / total END AS p FROM forms")
def a13_annotation_probability(spark: SparkSession, d: str) -> DataFrame:
    return a11_surface_form_counts(spark, d).select("name", model.annotation_probability(F.col("annotated"), F.col("total")).alias("p"))


_TYPES = "list_filter(list_transform(string_split(types, ','), lambda t: trim(t)), lambda t: t <> '')"


@query(f"""WITH {RES}, t AS (SELECT DISTINCT uri, unnest({_TYPES}) AS type FROM dbpediaresource WHERE types IS NOT NULL)
SELECT r.uri, r.support, coalesce(string_agg(t.type, ',' ORDER BY t.type), '') AS types FROM res r LEFT JOIN t ON t.uri = r.uri GROUP BY r.uri, r.support""")
def a14_resource_counts(spark: SparkSession, d: str) -> DataFrame:
    return model.resource_counts(table(spark, d, "dbpediaresource")).select("uri", "support", F.array_join("types", ",").alias("types"))


@query(f"WITH {PAIRS} SELECT name, uri, n FROM pairs")
def a16_pair_counts(spark: SparkSession, d: str) -> DataFrame:
    return model.pair_counts(occs_of(spark, d))


@query(f"""WITH {CTX} SELECT token, CAST(sum(n) AS BIGINT) AS n FROM (SELECT token, n FROM ctx UNION ALL
  SELECT unnest({WORDS.format("name")}), 1 FROM surface_forms WHERE name IS NOT NULL AND annotated_count >= 0) GROUP BY token""")
def a23_token_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    """Token counts of the contexts, and one for each token of each surface form."""
    names = table(spark, d, "surface_forms").filter(F.col("name").isNotNull() & (F.col("annotated_count") >= 0))
    extra = names.select(F.explode(T.lower_words(F.col("name"))).alias("token"), F.lit(1).cast("long").alias("n"))
    return model.context_counts(occs_of(spark, d)).select("token", "n").unionByName(extra).groupBy("token").agg(F.sum("n").alias("n"))


@query("""SELECT id, uri, surface_form, context, text_offset FROM occs WHERE id IS NOT NULL AND uri IS NOT NULL AND surface_form IS NOT NULL AND context IS NOT NULL AND text_offset >= 0
  AND substr(context, text_offset + 1, length(surface_form)) = surface_form""")
def a01_sound_occurrences(spark: SparkSession, d: str) -> DataFrame:
    """Occurrences whose form stands at its offset; the others are dropped as malformed."""
    rows = occs_of(spark, d).select("id", "uri", "surface_form", "context", "text_offset").dropna()
    return rows.filter((F.col("text_offset") >= 0) & (F.substr(F.col("context"), F.col("text_offset") + 1, F.char_length("surface_form")) == F.col("surface_form")))


@query("SELECT uri, text FROM documents WHERE uri IS NOT NULL AND text IS NOT NULL")
def a02_page_texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("uri", "text").dropna()


@query("SELECT context, count(*) AS mentions, min(text_offset) AS first_offset, max(text_offset) AS last_offset, count(DISTINCT uri) AS uris FROM occs WHERE context IS NOT NULL GROUP BY context")
def a03_paragraphs_by_text(spark: SparkSession, d: str) -> DataFrame:
    """Occurrences of one text as one paragraph."""
    rows = occs_of(spark, d).filter(F.col("context").isNotNull())
    return rows.groupBy("context").agg(F.count(F.lit(1)).alias("mentions"), F.min("text_offset").alias("first_offset"), F.max("text_offset").alias("last_offset"), F.count_distinct("uri").alias("uris"))


@query("""SELECT page, count(*) AS paragraphs, CAST(sum(length(context)) AS BIGINT) AS chars FROM
  (SELECT DISTINCT regexp_extract(id, '^(.*)-p[0-9]+l[0-9]+$', 1) AS page, context FROM occs WHERE id IS NOT NULL AND context IS NOT NULL) GROUP BY page""")
def a04_paragraphs_by_id(spark: SparkSession, d: str) -> DataFrame:
    """Distinct paragraphs of each page of the occurrence ids."""
    rows = occs_of(spark, d).filter(F.col("id").isNotNull() & F.col("context").isNotNull()).select(F.regexp_extract("id", "^(.*)-p[0-9]+l[0-9]+$", 1).alias("page"), "context").distinct()
    return rows.groupBy("page").agg(F.count(F.lit(1)).alias("paragraphs"), F.sum(F.char_length("context")).alias("chars"))


@query("""SELECT regexp_replace(subj, '^<|>$', '', 'g') AS s, regexp_replace(pred, '^<|>$', '', 'g') AS p, regexp_replace(obj, '^<|>$', '', 'g') AS o
  FROM redirects WHERE subj IS NOT NULL AND pred IS NOT NULL AND obj IS NOT NULL""")
def a06_triples(spark: SparkSession, d: str) -> DataFrame:
    strip = lambda c: F.regexp_replace(c, "^<|>$", "")
    return table(spark, d, "redirects").dropna(subset=["subj", "pred", "obj"]).select(strip("subj").alias("s"), strip("pred").alias("p"), strip("obj").alias("o"))


@query(f"""WITH t AS (SELECT uri, unnest({_TYPES}) AS type FROM dbpediaresource WHERE types IS NOT NULL)
  SELECT uri, string_agg(DISTINCT type, ',' ORDER BY type) AS types FROM t WHERE type <> 'owl#Thing' GROUP BY uri""")
def a08_types_of_uris(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "dbpediaresource").select("uri", F.explode(S.types_of_csv(F.col("types"))).alias("type")).filter(F.col("type") != "owl#Thing")
    return rows.filter(F.col("uri").isNotNull()).groupBy("uri").agg(F.array_join(F.array_sort(F.collect_set("type")), ",").alias("types"))


@query(f"""WITH t AS (SELECT DISTINCT uri, unnest({_TYPES}) AS type FROM dbpediaresource WHERE types IS NOT NULL), x AS (SELECT uri, string_agg(type, ',' ORDER BY type) AS types FROM t GROUP BY uri)
  SELECT occ_id, coalesce(x.types, '') AS types FROM occs LEFT JOIN x ON x.uri = occs.uri""")
def a10_occurrences_with_types(spark: SparkSession, d: str) -> DataFrame:
    types = table(spark, d, "dbpediaresource").select("uri", F.explode(S.types_of_csv(F.col("types"))).alias("type")).filter(F.col("uri").isNotNull())
    of = types.groupBy(F.col("uri").alias("u")).agg(F.array_join(F.array_sort(F.collect_set("type")), ",").alias("types"))
    return salted_join(occs_of(spark, d).select("occ_id", "uri"), of, "uri", "u", "left", spread=["occ_id"]).select("occ_id", F.coalesce("types", F.lit("")).alias("types"))


_BAG = "SELECT uri, '{' || string_agg('(' || token || ',' || n || ')', ',') || '}' AS bag FROM ctx GROUP BY uri"


@query(f"WITH {CTX} SELECT uri, token, n FROM ctx WHERE n >= 3")
def a19_bags_parsed(spark: SparkSession, d: str) -> DataFrame:
    """Token bags '{(token,n),…}' written and parsed again, counts of at least 3."""
    from kedge.sources import bags

    ctx = model.context_counts(occs_of(spark, d))
    return bags.parse_pig(bags.write_pig(ctx), 3)


@query(f"WITH {CTX} SELECT uri, token, n FROM ctx WHERE n >= 3")
def a20_json_bags_parsed(spark: SparkSession, d: str) -> DataFrame:
    from kedge.sources import bags

    return bags.parse_json(bags.write_json(model.context_counts(occs_of(spark, d))), 3)


@query(f"WITH {CTX} SELECT uri, token, n FROM ctx WHERE n > 3")
def a21_bags_strict(spark: SparkSession, d: str) -> DataFrame:
    from kedge.sources import bags

    return bags.parse_pig(bags.write_pig(model.context_counts(occs_of(spark, d))), 3, strict=True)


@query("""WITH p AS (SELECT doc_id, i - 1 AS par, ps[i] AS text FROM (SELECT doc_id, ps, unnest(generate_series(1, len(ps))) AS i FROM (SELECT doc_id, string_split_regex(text, '\\n+') AS ps FROM documents WHERE text IS NOT NULL)))
  SELECT doc_id, par, text FROM p WHERE trim(text, chr(13) || chr(32)) <> ''""")
def a28_paragraph_split(spark: SparkSession, d: str) -> DataFrame:
    """The paragraphs of each page."""
    rows = table(spark, d, "documents").filter(F.col("text").isNotNull()).select("doc_id", F.posexplode(F.split("text", "\\n+")).alias("par", "text"))
    return rows.filter(F.btrim("text", F.lit("\r ")) != "").select("doc_id", F.col("par").cast("long").alias("par"), "text")


_LINKS = """SELECT occ_id, unnest(regexp_extract_all(context, '\\[\\[([^\\[\\]]*)\\]\\]', 1)) AS link FROM occs WHERE context IS NOT NULL"""


@query(f"WITH l AS ({_LINKS}) SELECT occ_id, split_part(link, '|', 1) AS uri, CASE WHEN contains(link, '|') THEN split_part(link, '|', 2) ELSE link END AS name FROM l")
def a24_wiki_link_occurrences(spark: SparkSession, d: str) -> DataFrame:
    rows = occs_of(spark, d).filter(F.contains("context", F.lit("[["))).select("occ_id", F.explode(T.wiki_links(F.col("context"))).alias("l"))
    return rows.select("occ_id", "l.uri", "l.name")


@query("""SELECT o.occ_id, coalesce(d.categories, '') AS categories FROM occs o LEFT JOIN
  (SELECT uri, string_agg(DISTINCT source, ',' ORDER BY source) AS categories FROM documents WHERE uri IS NOT NULL AND source IS NOT NULL GROUP BY uri) d ON d.uri = o.uri""")
def a31_occurrence_categories(spark: SparkSession, d: str) -> DataFrame:
    """Occurrences with the categories (here: sources) of their resource's articles."""
    cats = table(spark, d, "documents").filter(F.col("uri").isNotNull() & F.col("source").isNotNull()).groupBy(F.col("uri").alias("u")).agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("categories"))
    return salted_join(occs_of(spark, d).select("occ_id", "uri"), cats, "uri", "u", "left", spread=["occ_id"]).select("occ_id", F.coalesce("categories", F.lit("")).alias("categories"))


@query(f"WITH {PAIRS}, amb AS (SELECT name FROM pairs GROUP BY name HAVING count(*) > 1) SELECT DISTINCT o.context, o.surface_form, o.uri FROM occs o JOIN amb ON amb.name = o.surface_form WHERE o.uri IS NOT NULL AND o.context IS NOT NULL")
def a32_held_out_ambiguous(spark: SparkSession, d: str) -> DataFrame:
    """Distinct gold mentions whose name has more than one resource."""
    occs = occs_of(spark, d)
    amb = model.pair_counts(occs).groupBy("name").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > 1).select(F.col("name").alias("surface_form"))
    return occs.filter(F.col("uri").isNotNull() & F.col("context").isNotNull()).select("context", "surface_form", "uri").join(amb, "surface_form", "left_semi").distinct().select("context", "surface_form", "uri")


@query("""WITH w AS (SELECT occ_id, regexp_extract_all(substr(context, 1, text_offset), '[\\p{L}\\p{N}]+') AS l, regexp_extract_all(substr(context, text_offset + 1), '[\\p{L}\\p{N}]+') AS r
  FROM occs WHERE context IS NOT NULL AND text_offset >= 0) SELECT occ_id, array_to_string(list_concat(l[-10:], r[1:11]), ' ') AS small FROM w""")
def a41_small_contexts(spark: SparkSession, d: str) -> DataFrame:
    """Ten words left and eleven from the mention on."""
    rows = occs_of(spark, d).filter(F.col("context").isNotNull() & (F.col("text_offset") >= 0))
    left = T.words(F.substr(F.col("context"), F.lit(1), F.col("text_offset")))
    right = T.words(F.substr(F.col("context"), F.col("text_offset") + 1))
    tail = F.slice(left, F.greatest(F.size(left) - 9, F.lit(1)), F.lit(10))
    return rows.select("occ_id", F.array_join(F.concat(tail, F.slice(right, 1, 11)), " ").alias("small"))


@query("SELECT type, count(DISTINCT uri) AS uris, count(*) AS entries FROM (SELECT uri, unnest(list_filter(list_transform(string_split(types, ','), lambda t: trim(t)), lambda t: t <> '')) AS type FROM dbpediaresource WHERE uri IS NOT NULL AND types IS NOT NULL) GROUP BY type")
def a50_type_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "dbpediaresource").filter(F.col("uri").isNotNull()).select("uri", F.explode(S.types_of_csv(F.col("types"))).alias("type"))
    return rows.groupBy("type").agg(F.count_distinct("uri").alias("uris"), F.count(F.lit(1)).alias("entries"))


@query("""WITH t AS (SELECT uri, unnest(list_filter(list_transform(string_split(types, ','), lambda t: trim(t)), lambda t: t <> '')) AS type FROM dbpediaresource WHERE types IS NOT NULL)
  SELECT split_part(type, ':', 1) AS vocabulary, CASE WHEN grouping(type) = 0 THEN type END AS type, count(*) AS n FROM t GROUP BY GROUPING SETS ((split_part(type, ':', 1), type), (split_part(type, ':', 1)))""")
def a51_type_tree(spark: SparkSession, d: str) -> DataFrame:
    """Counts of types rolled up to their vocabulary."""
    rows = table(spark, d, "dbpediaresource").select(F.explode(S.types_of_csv(F.col("types"))).alias("type")).withColumn("vocabulary", F.split_part("type", F.lit(":"), F.lit(1)))
    return rows.rollup("vocabulary", "type").agg(F.count(F.lit(1)).alias("n")).filter(F.col("vocabulary").isNotNull())


@query(f"WITH {FORMS} SELECT row_number() OVER (ORDER BY name) AS sf_id, name, annotated, total FROM forms WHERE annotated >= 2")
def h01_surface_form_store(spark: SparkSession, d: str) -> DataFrame:
    return model.surface_form_store(a11_surface_form_counts(spark, d))


@query(f"""WITH {FORMS}, {LOWER}, store AS (SELECT row_number() OVER (ORDER BY name) AS sf_id, * FROM forms WHERE annotated >= 2)
  SELECT l.lower, l.lower_count, s.sf_id FROM store s JOIN lower_rows l ON l.lower = lower(s.name) LEFT JOIN store o ON o.name = lower(s.name) WHERE o.name IS NULL OR o.annotated <= 2""")
def h02_lowercase_map(spark: SparkSession, d: str) -> DataFrame:
    return model.lowercase_map(h01_surface_form_store(spark, d), a12_lowercase_counts(spark, d))


@query(f"""WITH {FORMS}, w AS (SELECT annotated, string_split(name, ' ') AS w FROM forms WHERE contains(name, ' ')),
  sub AS (SELECT DISTINCT w, annotated, array_to_string(w[i:i + n - 1], ' ') AS sub FROM (SELECT w, annotated, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM (SELECT w, annotated, unnest(generate_series(1, len(w) - 1)) AS n FROM w))),
  less AS (SELECT sub AS name, sum(floor(annotated * 1.25)) AS less FROM sub GROUP BY sub)
  SELECT f.name, f.total, CAST(CASE WHEN f.total > 0 THEN greatest(f.total - coalesce(less.less, 0), 1) ELSE f.total END AS BIGINT) AS corrected FROM forms f LEFT JOIN less ON less.name = f.name""")
def h03_corrected_totals(spark: SparkSession, d: str) -> DataFrame:
    return model.corrected_totals(a11_surface_form_counts(spark, d))


@query(f"WITH {RES} SELECT row_number() OVER (ORDER BY uri) AS res_id, uri, support, support / sum(support) OVER () AS prior FROM res")
def h04_resource_store(spark: SparkSession, d: str) -> DataFrame:
    res = model.resource_counts(table(spark, d, "dbpediaresource"))
    return model.with_ids(res.select("uri", "support"), "uri", "res_id").select("res_id", "uri", "support", (F.col("support") / res.agg(F.sum("support")).scalar()).alias("prior"))


@query(f"WITH {CAND} SELECT name, uri, n, annotated, support, prior FROM candidates")
def h05_candidate_store(spark: SparkSession, d: str) -> DataFrame:
    return kb_model(spark, d).candidates


@query(f"WITH {CTX} SELECT uri, token, n FROM ctx")
def h07_context_store(spark: SparkSession, d: str) -> DataFrame:
    return model.context_counts(occs_of(spark, d))


@query(f"WITH {CTX} SELECT uri, CAST(sum(n) AS BIGINT) AS total FROM ctx GROUP BY uri")
def h08_context_totals(spark: SparkSession, d: str) -> DataFrame:
    return model.context_totals(model.context_counts(occs_of(spark, d)))


TOTALS = "totals AS (SELECT (SELECT CAST(sum(n) AS BIGINT) FROM ctx) AS n_tokens, (SELECT count(DISTINCT token) FROM ctx) AS vocabulary, (SELECT CAST(sum(support) AS BIGINT) FROM res) AS support, (SELECT CAST(sum(n) AS BIGINT) FROM pairs) AS annotated)"


@query(f"WITH {PAIRS}, {RES}, {CTX}, {TOTALS} SELECT * FROM totals")
def h09_totals(spark: SparkSession, d: str) -> DataFrame:
    m = kb_model(spark, d)
    return model.totals(m.tokens, m.resources, m.pairs)


@query("""WITH RECURSIVE e AS (SELECT subj AS src, arg_max(obj, line_no) AS dst FROM (SELECT line_no, regexp_replace(regexp_replace(subj, '^<|>$', '', 'g'), '^http://kb\\.example/resource/', '') AS subj, regexp_replace(regexp_replace(obj, '^<|>$', '', 'g'), '^http://kb\\.example/resource/', '') AS obj FROM redirects WHERE subj IS NOT NULL AND obj IS NOT NULL) GROUP BY subj),
  w AS (SELECT src, dst, [src] AS path FROM e UNION ALL SELECT w.src, e.dst, list_append(w.path, e.src) FROM w JOIN e ON e.src = w.dst WHERE NOT list_contains(w.path, w.dst))
  SELECT src, arg_max(dst, len(path)) AS dst FROM w WHERE src NOT IN (SELECT src FROM w WHERE list_contains(path, dst)) GROUP BY src""")
def h11_redirect_closure(spark: SparkSession, d: str) -> DataFrame:
    """Title to final title; titles whose chain runs into a circle have none. Escapes are left as they are here."""
    rows = table(spark, d, "redirects").filter(F.col("subj").isNotNull() & F.col("obj").isNotNull())
    strip = lambda c: S.strip_namespace(F.regexp_replace(c, "^<|>$", ""))
    edges = rows.select(strip("subj").alias("node"), strip("obj").alias("parent"), "line_no").groupBy("node").agg(F.max_by("parent", "line_no").alias("parent"))
    done = hierarchy.resolve(edges.select(F.explode(F.array("node", "parent")).alias("node")), edges)
    return done.filter((F.col("kind") == "tree") & (F.col("depth") > 0)).select(F.col("node").alias("src"), F.col("root").alias("dst"))


@query("""SELECT uri FROM dbpediaresource WHERE uri IS NOT NULL EXCEPT
  SELECT regexp_replace(regexp_replace(subj, '^<|>$', '', 'g'), '^http://kb\\.example/resource/', '') FROM redirects WHERE subj IS NOT NULL EXCEPT SELECT uri FROM dbpediaresource WHERE contains(uri, '(disambiguation)')""")
def h13_concept_uris(spark: SparkSession, d: str) -> DataFrame:
    """Titles without redirects and disambiguations."""
    titles = table(spark, d, "dbpediaresource").filter(F.col("uri").isNotNull()).select("uri")
    strip = S.strip_namespace(F.regexp_replace("subj", "^<|>$", ""))
    away = table(spark, d, "redirects").filter(F.col("subj").isNotNull()).select(strip.alias("uri"))
    return titles.subtract(away).filter(~F.contains("uri", F.lit("(disambiguation)")))


@query("""WITH t AS (SELECT uri, uri AS title FROM dbpediaresource WHERE uri IS NOT NULL UNION SELECT uri, uri FROM occs WHERE uri IS NOT NULL)
  SELECT DISTINCT trim(regexp_replace(replace(url_decode(replace(title, '+', '%2B')), '_', ' '), ' \\([^)]*\\)$', '')) AS name, uri FROM t""")
def h15_forms_of_titles(spark: SparkSession, d: str) -> DataFrame:
    uris = table(spark, d, "dbpediaresource").select("uri").union(occs_of(spark, d).select("uri")).filter(F.col("uri").isNotNull()).distinct()
    return uris.select(S.surface_form_of(F.col("uri")).alias("name"), "uri").distinct()


@query(f"WITH {PAIRS} SELECT uri, name, n, sum(n) OVER (PARTITION BY uri) AS uses, count(*) OVER (PARTITION BY uri) AS forms FROM pairs")
def h17_forms_per_uri(spark: SparkSession, d: str) -> DataFrame:
    """The names of every resource, a row each, with how many there are: no resource's names are gathered in one row."""
    pairs = model.pair_counts(occs_of(spark, d))
    sizes = pairs.groupBy(F.col("uri").alias("u")).agg(F.sum("n").alias("uses"), F.count(F.lit(1)).alias("forms"))
    return salted_join(pairs, sizes, "uri", "u", spread=["name"]).select("uri", "name", "n", "uses", "forms")


_LEX = f"""WITH {PAIRS}, t AS (SELECT sum(n) AS t FROM pairs), u AS (SELECT uri, sum(n) AS nu FROM pairs GROUP BY uri), s AS (SELECT name, sum(n) AS ns FROM pairs GROUP BY name)
  SELECT p.name, p.uri, p.n, p.n / nu AS p_name_given_uri, p.n / ns AS p_uri_given_name, nu / t AS p_uri, ln(p.n * t / (nu * ns)) AS pmi FROM pairs p JOIN u ON u.uri = p.uri JOIN s ON s.name = p.name, t"""


@query(_LEX)
def h18_lexicalisations(spark: SparkSession, d: str) -> DataFrame:
    return model.lexicalisations(model.pair_counts(occs_of(spark, d)))


@query("SELECT uri, row_number() OVER (PARTITION BY uri ORDER BY occ_id) AS position, surface_form, context FROM occs WHERE uri IS NOT NULL AND context IS NOT NULL")
def h19_merged_contexts(spark: SparkSession, d: str) -> DataFrame:
    """The contexts of every resource, sorted by resource; a row each, so that no resource's text is gathered in one."""
    return sinks.merged_contexts(occs_of(spark, d))


@query(f"WITH {PAIRS} SELECT name, uri, n FROM pairs WHERE n > 3")
def h20_frequent_pairs(spark: SparkSession, d: str) -> DataFrame:
    return model.pair_counts(occs_of(spark, d)).filter(F.col("n") > 3)


_DF = f"SELECT token, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({WORDS.format('text')}) AS token FROM documents) GROUP BY token"


@query(f"SELECT token, df FROM ({_DF}) WHERE NOT regexp_matches(token, '[0-9]') ORDER BY df DESC, token LIMIT 50")
def h21_stopwords(spark: SparkSession, d: str) -> DataFrame:
    return h22_document_frequency(spark, d).filter(~F.col("token").rlike("[0-9]")).orderBy(F.desc("df"), "token").limit(50)


@query(_DF)
def h22_document_frequency(spark: SparkSession, d: str) -> DataFrame:
    rows = spread(table(spark, d, "documents").select("text")).select(F.explode(F.array_distinct(T.lower_words(F.col("text")))).alias("token"))
    return rows.groupBy("token").agg(F.count(F.lit(1)).alias("df"))


@query(f"WITH {CTX} SELECT uri, token, n, rank FROM (SELECT uri, token, n, row_number() OVER (PARTITION BY uri ORDER BY n DESC, token) AS rank FROM ctx) WHERE rank <= 5")
def h23_context_signatures(spark: SparkSession, d: str) -> DataFrame:
    from kedge.operators.topics import first_of_each

    first = first_of_each(model.context_counts(occs_of(spark, d)), "uri", [F.desc("n"), F.col("token")], 5, spread="token")
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("uri").orderBy(F.desc("n"), "token")))


@query("""WITH r AS (SELECT occ_id, surface_form, uri, row_number() OVER (PARTITION BY surface_form, uri ORDER BY occ_id) AS k, count(*) OVER (PARTITION BY surface_form, uri) AS n FROM occs WHERE uri IS NOT NULL AND surface_form IS NOT NULL),
  a AS (SELECT surface_form, count(DISTINCT uri) AS c FROM occs WHERE uri IS NOT NULL AND surface_form IS NOT NULL GROUP BY 1)
  SELECT r.occ_id, CASE WHEN a.c > 1 AND k <= floor(n * 0.2 + 0.5) THEN 'test' ELSE 'train' END AS part FROM r JOIN a ON a.surface_form = r.surface_form""")
def h25_train_test_split(spark: SparkSession, d: str) -> DataFrame:
    """Per form and resource a fifth to test, in order of id; unambiguous forms train."""
    from kedge.operators import splitting

    return splitting.split_by_pair(occs_of(spark, d), 0.2)


@query("SELECT occ_id, uri, k, CASE WHEN k % 5 = 0 THEN 'test' ELSE 'train' END AS part FROM (SELECT occ_id, uri, row_number() OVER (PARTITION BY uri ORDER BY occ_id) AS k, count(*) OVER (PARTITION BY uri) AS n FROM occs WHERE uri IS NOT NULL) WHERE n >= 10")
def h26_group_split(spark: SparkSession, d: str) -> DataFrame:
    from kedge.operators import splitting

    return splitting.split_groups(occs_of(spark, d), "uri", "occ_id", least=10, every=5)


@query(f"WITH {RES} SELECT uri, support FROM res WHERE NOT contains(uri, '/') AND NOT contains(uri, '%23') AND regexp_matches(uri, '\\p{{L}}')")
def g18_good_uris(spark: SparkSession, d: str) -> DataFrame:
    return model.resource_counts(table(spark, d, "dbpediaresource")).select("uri", "support").transform(filters.good_uri())
