"""Queries of record formats: readers and writers of lists, maps, stand-off gold data, index documents and answers, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kedge.functions import phonetic
from kedge.functions import scalars as S
from kedge.functions import text as T
from kedge.operators import filters, hierarchy, linking, model
from kedge.operators.skew import salted_join
from kedge.plans.general import _EDGES, _P2
from kedge.plans.kb import CAND, FORMS, PAIRS, RES, WORDS, kb_model, occs_of
from kedge.plans.kb import SQL as KB_SQL
from kedge.session import cut, table
from kedge.sources import occurrence_lines, readers, sinks

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def wrap(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return wrap


_TYPES = "list_filter(list_transform(string_split(types, ','), lambda t: trim(t)), lambda t: t <> '')"
_TYPE_OF = "CASE lower(split_part(trim(t), ':', 1)) WHEN 'd' THEN 'DBpedia:' || regexp_replace(trim(t), '^[^:]*:', '') WHEN 's' THEN 'Schema:' || regexp_replace(trim(t), '^[^:]*:', '') ELSE trim(t) END"
TYPE_ROWS = f"type_rows AS (SELECT DISTINCT uri, {_TYPE_OF} AS type FROM (SELECT uri, unnest({_TYPES}) AS t FROM dbpediaresource WHERE uri IS NOT NULL AND types IS NOT NULL))"
#: Final titles in SQL: fin(uri, root), of titles whose chain ends.
CLOSURE = f"{_EDGES}, fin AS (SELECT node AS uri, root FROM found WHERE kind = 'tree' AND depth > 0)"
#: Concepts in SQL: resources and final titles that redirect no further and list no meanings.
ALL_CONCEPTS = f"concept AS (SELECT uri FROM ({KB_SQL['h13_concept_uris']}) UNION SELECT root FROM fin WHERE NOT contains(root, '(disambiguation)'))"
CONCEPTS = f"concept AS ({KB_SQL['h13_concept_uris']})"


def closure_of(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = hierarchy.redirect_edges(table(spark, d, "redirects"))
    return hierarchy.resolve(nodes, edges)


def type_rows(spark: SparkSession, d: str) -> DataFrame:
    """(uri, type): distinct type ids of the resources."""
    rows = table(spark, d, "dbpediaresource").filter(F.col("uri").isNotNull())
    return rows.select("uri", F.explode(S.types_of_csv(F.col("types"))).alias("type")).distinct()


def concept_uris(spark: SparkSession, d: str, closure: DataFrame | None = None) -> DataFrame:
    """Resources that redirect no further; with a closure, its final titles too."""
    from kedge.plans.kb import h13_concept_uris

    own = h13_concept_uris(spark, d)
    if closure is None:
        return own
    roots = closure.filter((F.col("kind") == "tree") & (F.col("depth") > 0)).select(F.col("root").alias("uri"))
    return own.union(roots.filter(~F.contains("uri", F.lit("(disambiguation)")))).distinct()


@query("SELECT regexp_replace(subj, '^<|>$', '', 'g') AS s, regexp_replace(pred, '^<|>$', '', 'g') AS p, regexp_replace(obj, '^<|>$', '', 'g') AS o FROM redirects WHERE subj IS NOT NULL AND pred IS NOT NULL AND obj IS NOT NULL")
def a07_parsed_triples(spark: SparkSession, d: str) -> DataFrame:
    """The redirects written as N-Triples lines and parsed again."""
    strip = lambda c: F.regexp_replace(c, "^<|>$", "")
    rows = table(spark, d, "redirects").dropna(subset=["subj", "pred", "obj"])
    return readers.triples(rows.select(F.concat(F.lit("<"), strip("subj"), F.lit("> <"), strip("pred"), F.lit("> <"), strip("obj"), F.lit("> .")).alias("value")))


@query(f"WITH {TYPE_ROWS} SELECT uri, string_agg(type, ',' ORDER BY type) AS types FROM type_rows GROUP BY uri")
def a09_types_by_triples(spark: SparkSession, d: str) -> DataFrame:
    """Types written as rdf:type statements, parsed and grouped."""
    line = F.concat(F.lit("<"), "uri", F.lit("> <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <"), "type", F.lit("> ."))
    got = readers.types_by_triples(readers.triples(type_rows(spark, d).select(line.alias("value"))))
    return got.select("uri", F.array_join("types", ",").alias("types"))


@query("SELECT DISTINCT name, 0 AS annotated, 0 AS total FROM surface_forms WHERE name IS NOT NULL")
def a13_listed_forms(spark: SparkSession, d: str) -> DataFrame:
    """A plain list of forms, without counts."""
    return readers.form_list(table(spark, d, "surface_forms").select(F.col("name").alias("value")))


@query(f"WITH {RES}, {TYPE_ROWS}, {CONCEPTS}, tt AS (SELECT uri, string_agg(type, ',' ORDER BY type) AS types FROM type_rows GROUP BY uri) SELECT c.uri, coalesce(r.support, 0) AS support, coalesce(tt.types, '') AS types FROM concept c LEFT JOIN res r ON r.uri = c.uri LEFT JOIN tt ON tt.uri = c.uri")
def a15_concept_resources(spark: SparkSession, d: str) -> DataFrame:
    """The concept list with counts and types."""
    types = type_rows(spark, d).groupBy("uri").agg(F.array_sort(F.collect_list("type")).alias("types"))
    counts = model.resource_counts(table(spark, d, "dbpediaresource")).select("uri", "support")
    return sinks.enriched(concept_uris(spark, d), counts, types).select("uri", "support", F.array_join("types", ",").alias("types"))


@query(f"WITH {PAIRS} SELECT name, uri, n FROM pairs")
def a17_candidate_map(spark: SparkSession, d: str) -> DataFrame:
    """Pairs written as 'count uri TAB form' lines and read again."""
    pairs = model.pair_counts(occs_of(spark, d))
    return readers.candidate_map(pairs.select(F.concat(F.lit("   "), F.col("n").cast("string"), F.lit(" "), "uri", F.lit("\t"), "name").alias("value")))


#: Items of pages that list meanings, in SQL: item(occ_id, uri, name).
_ITEMS = """line AS (SELECT occ_id, i - 1 AS line, ls[i] AS l, lower(trim(replace(uri, '_', ' '))) AS title FROM (SELECT occ_id, uri, ls, unnest(generate_series(1, len(ls))) AS i FROM (SELECT occ_id, uri, string_split(context, chr(10)) AS ls FROM occs WHERE uri IS NOT NULL AND contains(context, '[[')))),
  lk AS (SELECT occ_id, line, title, regexp_extract(l, '\\[\\[([^\\[\\]]*)\\]\\]', 1) AS link FROM line WHERE regexp_matches(l, '^ *[*#-] *.*\\[\\[[^\\[\\]]*\\]\\]')),
  nm AS (SELECT occ_id, line, title, split_part(link, '|', 1) AS uri, CASE WHEN contains(link, '|') THEN split_part(link, '|', 2) ELSE link END AS name FROM lk),
  ini AS (SELECT *, array_to_string(list_transform(string_split_regex(lower(name), '[ _]+'), lambda x: substr(x, 1, 1)), '') AS initials FROM nm),
  item AS (SELECT occ_id, line, uri, name FROM ini WHERE contains(lower(replace(uri, '_', ' ')), title) OR (length(title) > 1 AND regexp_matches(initials, array_to_string(list_transform(list_transform(generate_series(1, length(title)), lambda i: substr(title, CAST(i AS INTEGER), 1)), lambda c: regexp_escape(c)), '.*'))))"""


@query(f"WITH {_ITEMS} SELECT occ_id, line, uri, name FROM item")
def a26_disambiguation_items(spark: SparkSession, d: str) -> DataFrame:
    """The first link of each list line that contains the page's title or has it as an acronym."""
    pages = occs_of(spark, d).filter(F.col("uri").isNotNull()).select("occ_id", "uri", "context")
    return readers.disambiguation_items(pages, "occ_id", "uri", "context")


@query(f"""WITH {_ITEMS} SELECT 'link' AS source, id, uri, surface_form AS name, context, text_offset FROM occs WHERE id IS NOT NULL AND uri IS NOT NULL AND surface_form IS NOT NULL AND context IS NOT NULL AND text_offset >= 0 AND substr(context, text_offset + 1, length(surface_form)) = surface_form
  UNION ALL SELECT 'page', 'page-' || doc_id, uri, trim(regexp_replace(replace(url_decode(replace(uri, '+', '%2B')), '_', ' '), ' \\([^)]*\\)$', '')), text, 0 FROM documents WHERE uri IS NOT NULL AND text IS NOT NULL
  UNION ALL SELECT 'item', 'item-' || i.occ_id || '-' || i.line, i.uri, i.name, i.name, 0 FROM item i, generate_series(1, 10)""")
def a25_all_occurrences(spark: SparkSession, d: str) -> DataFrame:
    """Links, one occurrence per page text, and each item of a list of meanings ten times."""
    from kedge.plans.kb import a01_sound_occurrences

    cols = ["source", "id", "uri", "name", "context", "text_offset"]
    links = a01_sound_occurrences(spark, d).select(F.lit("link").alias("source"), "id", "uri", F.col("surface_form").alias("name"), "context", F.col("text_offset").cast("int").alias("text_offset"))
    docs = table(spark, d, "documents").filter(F.col("uri").isNotNull() & F.col("text").isNotNull())
    pages = docs.select(F.lit("page").alias("source"), F.concat(F.lit("page-"), F.col("doc_id").cast("string")).alias("id"), "uri", S.surface_form_of(F.col("uri")).alias("name"), F.col("text").alias("context"), F.lit(0).alias("text_offset"))
    items = a26_disambiguation_items(spark, d).withColumn("__ten", F.explode(F.sequence(F.lit(1), F.lit(10))))
    items = items.select(F.lit("item").alias("source"), F.concat(F.lit("item-"), F.col("occ_id").cast("string"), F.lit("-"), F.col("line").cast("string")).alias("id"), "uri", "name", F.col("name").alias("context"), F.lit(0).alias("text_offset"))
    return links.select(cols).unionByName(pages.select(cols)).unionByName(items.select(cols))


@query("""WITH a AS (SELECT occ_id, regexp_replace(context, '<[^>]*>', '', 'g') AS text, unnest(regexp_extract_all(context, '<a [^>]*href=["''][^"'']*["''][^>]*>[^<]*</a>')) AS a FROM occs),
  n AS (SELECT occ_id, text, regexp_extract(a, 'href=["'']([^"'']*)["'']', 1) AS href, regexp_extract(a, '>([^<]*)</a>', 1) AS name FROM a)
  SELECT occ_id, href, name, text FROM n WHERE length(text) BETWEEN 50 AND 500 AND length(name) BETWEEN 1 AND 40 AND (length(text) - length(replace(text, name, ''))) = length(name)""")
def a29_web_occurrences(spark: SparkSession, d: str) -> DataFrame:
    """Anchors as occurrences: texts of 50 to 500 characters in which a name of at most 40 stands once."""
    return readers.web_occurrences(occs_of(spark, d), "occ_id", "context")


@query(f"""WITH RECURSIVE {CLOSURE}, {ALL_CONCEPTS} SELECT o.occ_id, coalesce(fin.root, o.uri) AS uri, lower(o.surface_form) AS surface_form FROM occs o LEFT JOIN fin ON fin.uri = o.uri
  WHERE coalesce(fin.root, o.uri) IN (SELECT uri FROM concept) AND length(o.surface_form) <= 50 AND length(o.context) >= 50""")
def a30_filtered_occurrences(spark: SparkSession, d: str) -> DataFrame:
    """Redirects resolved, concepts only, no overlong forms or short contexts, forms in lower case."""
    closure = cut(closure_of(spark, d))
    rows = model.resolved(occs_of(spark, d).select("occ_id", "uri", "surface_form", F.char_length("context").alias("n")), closure)
    sized = rows.filter((F.char_length("surface_form") <= 50) & (F.col("n") >= 50))
    return sized.transform(filters.uris(concept_uris(spark, d, closure))).transform(filters.lowercase_forms()).select("occ_id", "uri", "surface_form")


@query(f"""WITH RECURSIVE {CLOSURE}, r AS (SELECT o.context, o.surface_form, coalesce(fin.root, o.uri) AS uri FROM occs o LEFT JOIN fin ON fin.uri = o.uri WHERE o.uri IS NOT NULL AND o.context IS NOT NULL AND o.surface_form IS NOT NULL),
  amb AS (SELECT surface_form FROM r GROUP BY surface_form HAVING count(DISTINCT uri) > 1) SELECT DISTINCT context, surface_form, uri FROM r WHERE surface_form IN (SELECT surface_form FROM amb)""")
def a32_held_out_resolved(spark: SparkSession, d: str) -> DataFrame:
    """Distinct gold mentions, redirects resolved, whose name still has more than one resource."""
    rows = model.resolved(occs_of(spark, d).select("context", "surface_form", "uri").dropna(), closure_of(spark, d))
    amb = rows.select("surface_form", "uri").distinct().groupBy("surface_form").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > 1)
    return rows.join(amb.select("surface_form"), "surface_form", "left_semi").distinct().select("context", "surface_form", "uri")


@query(f"WITH f AS (SELECT token, count(*) AS n FROM (SELECT unnest({WORDS.format('text')}) AS token FROM documents) GROUP BY token) SELECT token AS word, n FROM f WHERE n > 100 AND n < 5000")
def a34_common_words(spark: SparkSession, d: str) -> DataFrame:
    """A frequency list 'rank TAB word TAB count' written and read with both bounds."""
    counts = table(spark, d, "documents").select(F.explode(T.lower_words(F.col("text"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return readers.common_words(counts.select(F.concat_ws("\t", F.lit("0"), "token", F.col("n").cast("string")).alias("value")), 100, 5000)


@query("SELECT occ_id, uri, CAST(text_offset AS INTEGER) AS start, substr(context, text_offset + 1, length(surface_form)) AS name FROM occs WHERE uri IS NOT NULL AND context IS NOT NULL AND surface_form IS NOT NULL AND text_offset >= 0")
def a37_standoff_gold(spark: SparkSession, d: str) -> DataFrame:
    """Annotations written as stand-off XML beside their texts, and read again by offset and length."""
    occs = occs_of(spark, d).dropna(subset=["uri", "context", "surface_form"]).filter(F.col("text_offset") >= 0)
    part = lambda tag, c: F.concat(F.lit(f"<{tag}>"), sinks.escape_xml(c.cast("string")), F.lit(f"</{tag}>"))
    xml = F.concat(F.lit("<annotations><annotation>"), part("docName", F.col("occ_id")), part("wikiName", F.col("uri")), part("offset", F.col("text_offset")), part("length", F.char_length("surface_form")), F.lit("</annotation></annotations>"))
    got = readers.standoff_gold(occs.select(xml.alias("value")), occs.select(F.col("occ_id").cast("string").alias("doc"), F.col("context").alias("text")))
    return got.select(F.col("doc").cast("long").alias("occ_id"), "uri", "start", "name")


@query("SELECT 'q' || occ_id AS query_id, replace(uri, '_', ' ') AS name, occ_id AS doc, uri FROM occs WHERE uri IS NOT NULL AND context IS NOT NULL")
def a38_linking_queries(spark: SparkSession, d: str) -> DataFrame:
    """Query XML, answer lines and documents of a linking task, joined."""
    occs = occs_of(spark, d).filter(F.col("uri").isNotNull() & F.col("context").isNotNull())
    number = F.col("occ_id").cast("string")
    xml = F.concat(F.lit('<kbpentlink><query id="q'), number, F.lit('"><name>'), sinks.escape_xml(F.translate("uri", "_", " ")), F.lit("</name><docid>"), number, F.lit("</docid></query></kbpentlink>"))
    answers = occs.select(F.concat_ws("\t", F.concat(F.lit("q"), number), "uri", F.lit("X")).alias("value"))
    got = readers.linking_queries(occs.select(xml.alias("value")), answers, occs.select(number.alias("doc")))
    return got.select("query_id", "name", F.col("doc").cast("long").alias("doc"), "uri")


@query("SELECT surface_form AS name, CAST(text_offset AS INTEGER) AS start, trim(regexp_replace(context, '\\s+', ' ', 'g'), ' ') AS text, uri, text_offset >= 0 AS valid FROM occs WHERE surface_form IS NOT NULL AND context IS NOT NULL AND uri IS NOT NULL AND text_offset IS NOT NULL AND NOT regexp_matches(surface_form, '\\s\\s|[\\t\\n\\r]')")
def a42_spot_dataset(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a spot data set: form, offset, text, uri, two more columns, t for valid."""
    occs = occs_of(spark, d).dropna(subset=["surface_form", "context", "uri", "text_offset"]).filter(~F.col("surface_form").rlike("\\s\\s|[\\t\\n\\r]"))
    line = F.concat_ws("\t", "surface_form", F.col("text_offset").cast("string"), F.trim(F.regexp_replace("context", "\\s+", " ")), "uri", F.lit(""), F.lit(""), F.when(F.col("text_offset") >= 0, "t").otherwise("c"))
    return readers.spot_dataset(occs.select(line.alias("value")))


@query(f"WITH {TYPE_ROWS} SELECT DISTINCT d.doc_id, t.type FROM documents d JOIN type_rows t ON t.uri = d.uri")
def a50_page_types(spark: SparkSession, d: str) -> DataFrame:
    """Types of pages by way of the resource each page is about: page number, page and resource, types."""
    pages = table(spark, d, "documents").filter(F.col("uri").isNotNull()).select("doc_id", "uri")
    return salted_join(pages, type_rows(spark, d).withColumnRenamed("uri", "u"), "uri", "u", spread=["doc_id"]).select("doc_id", "type").distinct()


@query("SELECT doc_id, uri || chr(9) || regexp_replace(text, '\\s+', ' ', 'g') AS line FROM documents WHERE uri IS NOT NULL AND text IS NOT NULL")
def b02_page_lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter(F.col("uri").isNotNull() & F.col("text").isNotNull()).select("doc_id", sinks.page_line().alias("line"))


@query(f"""{_P2} SELECT line_id, '<error status="400">' || reason || '</error>' AS xml FROM judged WHERE reason IS NOT NULL""")
def b11_error_documents(spark: SparkSession, d: str) -> DataFrame:
    """An error document for each line that can't be loaded."""
    bad = occurrence_lines.rejects(occurrence_lines.read_occurrence_lines(table(spark, d, "occs_raw")))
    return bad.select("line_id", sinks.error_xml(F.col("reason"), F.lit(400)).alias("xml"))


@query(f"""WITH {CAND}, a AS (SELECT name, uri, row_number() OVER (PARTITION BY name ORDER BY prior DESC, uri) AS rank, count(*) OVER (PARTITION BY name) AS ambiguity FROM candidates)
  SELECT o.occ_id, '"' || o.occ_id || '"' || chr(9) || '"' || o.uri || '"' || chr(9) || '"' || coalesce(a.rank, 0) || '"' || chr(9) || '"' || coalesce(b.ambiguity, 0) || '"' AS line
  FROM occs o LEFT JOIN a ON a.name = o.surface_form AND a.uri = o.uri LEFT JOIN (SELECT DISTINCT name, ambiguity FROM a) b ON b.name = o.surface_form WHERE o.uri IS NOT NULL AND o.surface_form IS NOT NULL""")
def b13_evaluation_lines(spark: SparkSession, d: str) -> DataFrame:
    """Quoted evaluation lines: mention, gold resource, its rank by prior (0: not among them), ambiguity of the name."""
    cand = kb_model(spark, d).candidates
    every = linking.by_prior(cand, cand.select("name").distinct(), 1 << 30).select("name", "uri", "rank")
    amb = linking.ambiguity(cand.select("name").distinct(), cand)
    gold = occs_of(spark, d).filter(F.col("uri").isNotNull() & F.col("surface_form").isNotNull()).select("occ_id", F.col("surface_form").alias("name"), "uri")
    met = gold.join(every, ["name", "uri"], "left").join(amb, "name", "left")
    quoted = [F.concat(F.lit('"'), c.cast("string"), F.lit('"')) for c in (F.col("occ_id"), F.col("uri"), F.coalesce("rank", F.lit(0)), F.coalesce("ambiguity", F.lit(0)))]
    return met.select("occ_id", F.concat_ws("\t", *quoted).alias("line"))


@query(f"WITH {CAND} SELECT o.occ_id, c.uri, c.prior, ln(c.support) AS log_support, c.n / c.support AS likelihood, CAST(c.uri = o.uri AS INTEGER) AS class FROM occs o JOIN candidates c ON c.name = o.surface_form WHERE o.uri IS NOT NULL")
def b14_training_rows(spark: SparkSession, d: str) -> DataFrame:
    """Features and class of every candidate of every gold mention."""
    gold = occs_of(spark, d).filter(F.col("uri").isNotNull()).select("occ_id", F.col("surface_form").alias("name"), F.col("uri").alias("gold"))
    met = salted_join(gold, kb_model(spark, d).candidates.withColumnRenamed("name", "__n"), "name", "__n", spread=["occ_id"])
    return met.select("occ_id", "uri", "prior", F.log("support").alias("log_support"), (F.col("n") / F.col("support")).alias("likelihood"), (F.col("uri") == F.col("gold")).cast("int").alias("class"))


_GRAM = f"w AS (SELECT doc_id, {WORDS.format('text')} AS w FROM documents)"


@query(f"WITH {_GRAM}, g AS (SELECT n, array_to_string(w[i:i + n - 1], ' ') AS gram FROM (SELECT n, w, unnest(generate_series(1, len(w) - n + 1)) AS i FROM (SELECT w, unnest([1, 2, 3]) AS n FROM w))) SELECT n, gram, count(*) AS uses FROM g GROUP BY n, gram HAVING count(*) >= 2")
def b19_ngram_counts(spark: SparkSession, d: str) -> DataFrame:
    """Words, pairs and triples of words that documents hold twice or more."""
    words = table(spark, d, "documents").select(T.lower_words(F.col("text")).alias("w"))
    rows = [words.select(F.lit(n).alias("n"), F.explode(T.ngrams(F.col("w"), n)).alias("gram")) for n in (1, 2, 3)]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).groupBy("n", "gram").agg(F.count(F.lit(1)).alias("uses")).filter(F.col("uses") >= 2)


@query(f"WITH t AS (SELECT uri, unnest({WORDS.format('context')}) AS token FROM occs WHERE uri IS NOT NULL) SELECT token, uri, count(*) AS n FROM t WHERE regexp_full_match(token, '\\p{{L}}{{2,}}') GROUP BY token, uri")
def b22_agreement_matrix(spark: SparkSession, d: str) -> DataFrame:
    """The cells of the matrix of words and resources that aren't 0."""
    return model.context_counts(occs_of(spark, d)).filter(S.accept_in_matrix(F.col("token"))).select("token", "uri", "n")


@query(f"""WITH {PAIRS}, a AS (SELECT uri, n, unnest([name, lower(name), regexp_replace(name, '(?i)^(the|an|a) ', ''), regexp_replace(name, 's$', ''), trim(regexp_replace(name, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))]) AS name FROM pairs WHERE n > 1)
  SELECT uri, name, max(n) AS n FROM a GROUP BY uri, name""")
def b24_candidate_index(spark: SparkSession, d: str) -> DataFrame:
    return sinks.candidate_index(model.pair_counts(occs_of(spark, d)), 1)


@query("SELECT occ_id, uri, lower(surface_form) AS surface_form, context FROM occs WHERE uri IS NOT NULL AND surface_form IS NOT NULL AND context IS NOT NULL")
def b25_separate_documents(spark: SparkSession, d: str) -> DataFrame:
    return sinks.separate_documents(occs_of(spark, d))


@query(f"WITH {RES}, {TYPE_ROWS}, tt AS (SELECT uri, string_agg(type, ',' ORDER BY type) AS types FROM type_rows GROUP BY uri), i AS (SELECT uri, count(*) AS uri_count, count(context) AS n_contexts FROM occs WHERE uri IS NOT NULL GROUP BY uri) SELECT i.uri, i.uri_count, coalesce(r.support, 0) AS support, coalesce(tt.types, '') AS types FROM i LEFT JOIN res r ON r.uri = i.uri LEFT JOIN tt ON tt.uri = i.uri")
def b26_enriched_index(spark: SparkSession, d: str) -> DataFrame:
    """Index documents with support and types."""
    types = type_rows(spark, d).groupBy("uri").agg(F.array_sort(F.collect_list("type")).alias("types"))
    counts = model.resource_counts(table(spark, d, "dbpediaresource")).select("uri", "support")
    got = sinks.enriched(sinks.compressed_index(occs_of(spark, d), 1), counts, types)
    return got.select("uri", "uri_count", "support", F.array_join("types", ",").alias("types"))


@query(f"""WITH {CAND} SELECT name, '<surfaceForm name="' || replace(replace(replace(replace(name, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') || '">' ||
  string_agg('<resource uri="' || replace(replace(replace(replace(uri, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') || '" support="' || support || '" priorScore="' || printf('%.6f', round(prior, 6)) || '"/>', '' ORDER BY prior DESC, uri) || '</surfaceForm>' AS xml FROM candidates GROUP BY name""")
def b07_candidates_xml(spark: SparkSession, d: str) -> DataFrame:
    return sinks.candidates_xml(kb_model(spark, d).candidates)


@query(f"WITH {RES}, {PAIRS} SELECT r.uri, r.support FROM res r WHERE r.uri IN (SELECT uri FROM pairs)")
def e14_resources_by_name(spark: SparkSession, d: str) -> DataFrame:
    """Resources looked up by name; an unknown name gives nothing."""
    asked = model.pair_counts(occs_of(spark, d)).select("uri").distinct()
    return model.resource_counts(table(spark, d, "dbpediaresource")).select("uri", "support").join(asked, "uri", "left_semi")


@query("""WITH s AS (SELECT occ_id, context, CAST(text_offset AS BIGINT) AS start, text_offset + length(surface_form) AS stop FROM occs WHERE context IS NOT NULL AND surface_form IS NOT NULL AND text_offset >= 0),
  m AS (SELECT *, max(stop) OVER (PARTITION BY context ORDER BY start, stop DESC, occ_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s) SELECT occ_id, coalesce(reach > start, FALSE) AS meets, coalesce(reach >= stop, FALSE) AS inside FROM m""")
def e19_overlapping_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Whether a mention meets or lies in one before it in its paragraph, from the furthest end so far: no pairs."""
    rows = occs_of(spark, d).filter(F.col("context").isNotNull() & F.col("surface_form").isNotNull() & (F.col("text_offset") >= 0))
    spans = rows.select("occ_id", "context", F.col("text_offset").alias("start"), F.char_length("surface_form").alias("length"))
    return linking.overlaps(spans, "context", "occ_id").select("occ_id", "meets", "inside")


@query(f"""WITH {FORMS}, {PAIRS} SELECT f.name, f.total, coalesce(p.uses, 0) AS uses FROM forms f LEFT JOIN (SELECT name, CAST(sum(n) AS BIGINT) AS uses FROM pairs GROUP BY name) p ON p.name = f.name WHERE NOT regexp_matches(f.name, '^[0-9]+$|^List')""")
def g20_blacklisted_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts of forms but those that a blacklist pattern hits."""
    forms = model.surface_form_counts(table(spark, d, "surface_forms")).transform(filters.not_matching("name", "^[0-9]+$|^List"))
    uses = model.pair_counts(occs_of(spark, d)).groupBy("name").agg(F.sum("n").alias("uses"))
    return forms.join(uses, "name", "left").select("name", "total", F.coalesce("uses", F.lit(0)).alias("uses"))


@query("SELECT occ_id, uri FROM occs WHERE regexp_full_match(uri, '[0-9]+')")
def g15_numeric_resources(spark: SparkSession, d: str) -> DataFrame:
    return occs_of(spark, d).transform(filters.keep_numeric()).select("occ_id", "uri")


@query(f"""WITH RECURSIVE {CLOSURE}, r AS (SELECT coalesce(fin.root, o.uri) AS uri, o.context FROM occs o LEFT JOIN fin ON fin.uri = o.uri WHERE o.uri IS NOT NULL)
  SELECT uri, token, count(*) AS n FROM (SELECT uri, unnest({WORDS.format('context')}) AS token FROM r) GROUP BY uri, token""")
def h07_resolved_contexts(spark: SparkSession, d: str) -> DataFrame:
    """Context counts with those of redirecting titles merged into their targets."""
    return model.context_counts(model.resolved(occs_of(spark, d).select("uri", "context"), closure_of(spark, d)))


@query(f"WITH {TYPE_ROWS} SELECT row_number() OVER (ORDER BY type) AS type_id, type FROM (SELECT DISTINCT type FROM type_rows)")
def h10_type_ids(spark: SparkSession, d: str) -> DataFrame:
    return model.with_ids(type_rows(spark, d).select("type").distinct(), "type", "type_id").select("type_id", "type")


@query(f"WITH RECURSIVE {CLOSURE}, u AS (SELECT DISTINCT uri FROM occs WHERE uri IS NOT NULL), e AS (SELECT u.uri AS asked, url_decode(replace(regexp_replace(u.uri, '#.*$', ''), '+', '%2B')) AS title FROM u) SELECT asked, coalesce(fin.root, e.title) AS uri FROM e LEFT JOIN fin ON fin.uri = e.title WHERE NOT contains(coalesce(fin.root, e.title), '(disambiguation)')")
def h12_entities_of_urls(spark: SparkSession, d: str) -> DataFrame:
    """Page addresses, with anchors and slashes at their end, to final titles; pages that list meanings are left out."""
    asked = occs_of(spark, d).filter(F.col("uri").isNotNull()).select("uri").distinct()
    urls = asked.select(F.col("uri").alias("asked"), F.concat(F.lit("http://en.wikipedia.example/wiki/"), "uri", F.lit("#Top")).alias("url"))
    titles = urls.select("asked", S.title_of_url(F.col("url")).alias("uri"))
    return model.resolved(titles, closure_of(spark, d)).filter(~F.contains("uri", F.lit("(disambiguation)"))).select("asked", "uri")


@query(f"WITH RECURSIVE {CLOSURE}, {ALL_CONCEPTS} SELECT fin.uri, fin.root FROM fin WHERE fin.root IN (SELECT uri FROM concept)")
def h14_closure_to_concepts(spark: SparkSession, d: str) -> DataFrame:
    """Redirects whose final title is a concept."""
    return _to_concepts(spark, d, cut(closure_of(spark, d)))


def _to_concepts(spark: SparkSession, d: str, closure: DataFrame) -> DataFrame:
    done = closure.filter((F.col("kind") == "tree") & (F.col("depth") > 0)).select(F.col("node").alias("uri"), "root")
    return done.join(concept_uris(spark, d, closure).select(F.col("uri").alias("root")), "root", "left_semi").select("uri", "root")


_NAME = "trim(regexp_replace(replace(url_decode(replace({0}, '+', '%2B')), '_', ' '), ' \\([^)]*\\)$', ''))"


@query(f"WITH RECURSIVE {CLOSURE}, {ALL_CONCEPTS}, f AS (SELECT uri, {_NAME.format('uri')} AS name FROM concept UNION SELECT root, {_NAME.format('uri')} FROM fin WHERE root IN (SELECT uri FROM concept)) SELECT uri, name FROM f WHERE length(name) <= 50 AND regexp_matches(name, '\\p{{L}}') AND NOT regexp_matches(name, '%[0-9A-Fa-f]{{2}}')")
def h15_forms_of_all_titles(spark: SparkSession, d: str) -> DataFrame:
    """Names of concepts from their own titles and from all titles that redirect to them."""
    closure = cut(closure_of(spark, d))
    own = concept_uris(spark, d, closure).select("uri", S.surface_form_of(F.col("uri")).alias("name"))
    other = _to_concepts(spark, d, closure).select(F.col("root").alias("uri"), S.surface_form_of(F.col("uri")).alias("name"))
    every = own.unionByName(other).distinct()
    return every.filter((F.char_length("name") <= 50) & F.col("name").rlike("\\p{L}") & ~F.col("name").rlike("%[0-9A-Fa-f]{2}"))


@query(f"WITH RECURSIVE {_EDGES} SELECT p AS uri, node AS via, {_NAME.format('node')} AS name FROM (SELECT node, unnest(path[1:CASE WHEN kind = 'tree' THEN len(path) ELSE depth END]) AS p FROM found)")
def h16_names_by_reverse_links(spark: SparkSession, d: str) -> DataFrame:
    """For every title the names of all titles that lead to it, and its own, by walking the links backwards; a circle isn't walked."""
    nodes, edges = hierarchy.redirect_edges(table(spark, d, "redirects"))
    done = hierarchy.resolve(nodes, edges, paths=True)
    walked = F.when(F.col("kind") == "tree", F.col("path")).otherwise(F.slice("path", F.lit(1), F.col("depth").cast("int")))
    return done.select(F.explode(walked).alias("uri"), F.col("node").alias("via"), S.surface_form_of(F.col("node")).alias("name"))


@query(None)
def c18_phonetic_terms(spark: SparkSession, d: str) -> DataFrame:
    """Phonetic keys of the words of every form, and runs of two and three of them."""
    return phonetic.phonetic_terms(occs_of(spark, d).select(F.col("surface_form").alias("name")))


@query(None)
def e11_sounding_names(spark: SparkSession, d: str) -> DataFrame:
    """Known names that sound like a form."""
    return phonetic.sounding_alike(occs_of(spark, d).select(F.col("surface_form").alias("name")), table(spark, d, "surface_forms").select("name"))
