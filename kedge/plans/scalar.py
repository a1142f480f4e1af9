"""Queries of the scalar and text functions over the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kedge.functions import scalars as S
from kedge.functions import text as T
from kedge.plans.kb import WORDS
from kedge.session import spread, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def wrap(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return wrap


def _forms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "occs").filter(F.col("surface_form").isNotNull()).select(F.col("surface_form").alias("name")).distinct()


def _uris(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "occs").filter(F.col("uri").isNotNull()).select("uri").distinct()


FORMS = "f AS (SELECT DISTINCT surface_form AS name FROM occs WHERE surface_form IS NOT NULL)"
#: N-Triples escapes of a text, as SQL.
NT = """array_to_string(list_transform(list_transform(generate_series(1, length({0})), lambda i: substr({0}, CAST(i AS INTEGER), 1)), lambda c: CASE WHEN c = '\\' THEN '\\\\' WHEN c = '"' THEN '\\"' WHEN c = chr(10) THEN '\\n' WHEN c = chr(13) THEN '\\r' WHEN c = chr(9) THEN '\\t'
  WHEN unicode(c) BETWEEN 32 AND 126 THEN c WHEN unicode(c) > 65535 THEN '\\U' || printf('%08X', unicode(c)) ELSE '\\u' || printf('%04X', unicode(c)) END), '')"""
#: Edit distance by characters, as SQL (the built-in counts bytes): characters beyond ASCII of the pair stand for signs that the names don't hold.
_ODD = "list_distinct(regexp_extract_all({0} || {1}, '[^ -~]'))"
EDITS = f"levenshtein(translate({{0}}, array_to_string({_ODD}, ''), array_to_string(list_transform(generate_series(1, len({_ODD})), lambda i: chr(CAST(i AS INTEGER))), '')), translate({{1}}, array_to_string({_ODD}, ''), array_to_string(list_transform(generate_series(1, len({_ODD})), lambda i: chr(CAST(i AS INTEGER))), '')))"
_TRIGRAM = "SELECT DISTINCT name, substr(lower(name), CAST(i AS INTEGER), 3) AS g FROM (SELECT name, unnest(generate_series(1, length(name) - 2)) AS i FROM {0} WHERE name IS NOT NULL)"
#: Pairs of a mention's form and a known name that share six letter trigrams.
ALIKE = f"f AS (SELECT DISTINCT surface_form AS name FROM occs WHERE surface_form IS NOT NULL), ta AS ({_TRIGRAM.format('f')}), tb AS ({_TRIGRAM.format('surface_forms')}), alike AS (SELECT ta.name, tb.name AS other, count(*) AS shared FROM ta JOIN tb ON tb.g = ta.g GROUP BY 1, 2 HAVING count(*) >= 6)"
DECODED = "url_decode(replace(uri, '+', '%2B'))"
#: Tokens with character offsets, as SQL: span({key}, pos, token, start).
SPANS = """tg AS (SELECT {key}, regexp_extract_all({text}, '[\\p{{L}}\\p{{N}}]+') AS w, string_split_regex({text}, '[\\p{{L}}\\p{{N}}]+') AS g FROM {table} WHERE {text} IS NOT NULL),
  ti AS (SELECT {key}, i, w[i] AS token, length(g[i]) AS gap, length(w[i]) AS size FROM (SELECT {key}, w, g, unnest(generate_series(1, len(w))) AS i FROM tg)),
  span AS (SELECT {key}, i - 1 AS pos, token, CAST(sum(gap + size) OVER (PARTITION BY {key} ORDER BY i) - size AS BIGINT) AS start FROM ti)"""
_WIKI = "context"
for _p, _by in (
    [("(?s)<!--.*?-->", ""), ("(?s)<ref[^>/]*>.*?</ref>|<ref[^>]*/>", ""), ("(?s)\\{\\|.*?\\|\\}", "")] + [("\\{\\{[^{}]*\\}\\}", "")] * 5
    + [("(?i)\\[\\[(?:file|image|category):[^\\[\\]]*\\]\\]", ""), ("__[A-Z]+__", ""), ("(?m)^=+ *(.*?) *=+ *$", "\\1"), ("''{2,5}".replace("''", "''", 1), ""), ("</?[a-zA-Z][^<>]*>", ""), ("(?m)^[*#:;]+ *", ""), ("\\[(?:https?)://[^ \\]]*(?: ([^\\]]*))?\\]", "\\1"), ("\n{2,}", "\n")]
):
    _WIKI = f"regexp_replace({_WIKI}, '{_p}', '{_by}', 'g')"
URIS = "u AS (SELECT DISTINCT uri FROM occs WHERE uri IS NOT NULL)"


@query("""SELECT uri, slice_id, CASE WHEN uri_count = 0 THEN NULL ELSE ln(uri_count) END AS log_count,
  CASE WHEN uri_count = 0 THEN ln(2) ELSE greatest(ln(uri_count), ln(2)) + ln(1 + exp(-abs(ln(uri_count) - ln(2)))) END AS log_sum FROM dbpediaresource WHERE uri_count IS NOT NULL""")
def i01_i02_log_space(spark: SparkSession, d: str) -> DataFrame:
    """ln with ln(0) = -inf (shown as null) and log-addition of ln 2."""
    log = S.ln(F.col("uri_count").cast("double"))
    rows = table(spark, d, "dbpediaresource").filter(F.col("uri_count").isNotNull())
    return rows.select("uri", "slice_id", F.when(log != S.log_zero(), log).alias("log_count"), S.ln_sum(log, F.log(F.lit(2.0))).alias("log_sum"))


@query("SELECT uri, ln(sum(uri_count)) AS lse, CASE WHEN min(uri_count) > 0 THEN sum(CASE WHEN uri_count > 0 THEN ln(uri_count) END) END AS product FROM dbpediaresource WHERE uri_count IS NOT NULL GROUP BY uri HAVING sum(uri_count) > 0")
def i03_log_folds(spark: SparkSession, d: str) -> DataFrame:
    """Log-sum over an array and log-product, of which -infinity absorbs all."""
    log = S.ln(F.col("uri_count").cast("double"))
    got = table(spark, d, "dbpediaresource").filter(F.col("uri_count").isNotNull()).groupBy("uri").agg(F.collect_list(log).alias("logs"), F.sum(log).alias("p"), F.sum("uri_count").alias("n"))
    return got.filter(F.col("n") > 0).select("uri", S.ln_sum_over(F.col("logs")).alias("lse"), F.when(F.col("p") != S.log_zero(), F.col("p")).alias("product"))


@query(f"""WITH {URIS} SELECT uri, 'http://kb.example/resource/' || uri AS full_uri, starts_with(uri, 'http://') OR starts_with(uri, 'https://') AS external FROM u""")
def i05_full_uris(spark: SparkSession, d: str) -> DataFrame:
    return _uris(spark, d).select("uri", S.full_uri(F.col("uri")).alias("full_uri"), S.is_external(F.col("uri")).alias("external"))


@query("""WITH r AS (SELECT DISTINCT regexp_replace(regexp_replace(subj, '^<|>$', '', 'g'), '^http://kb\\.example/resource/', '') AS uri FROM redirects WHERE subj IS NOT NULL)
  SELECT uri, CASE WHEN regexp_matches(uri, '%[0-9a-fA-F]{2}') THEN uri ELSE replace(replace(replace(replace(replace(replace(replace(replace(url_encode(replace(uri, ' ', '_')), '%2C', ','), '%28', '('), '%29', ')'), '%3A', ':'), '%21', '!'), '%27', ''''), '%2F', '/'), '%40', '@') END AS normal FROM r""")
def i04_normal_uris(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "redirects").filter(F.col("subj").isNotNull()).select(S.strip_namespace(F.regexp_replace("subj", "^<|>$", "")).alias("uri")).distinct()
    return rows.select("uri", S.normalise_uri(F.col("uri")).alias("normal"))


@query(f"WITH {URIS}, n AS (SELECT uri, trim(regexp_replace(replace({DECODED}, '_', ' '), ' \\([^)]*\\)$', '')) AS name FROM u) SELECT uri, name, lower(name) AS lower_name FROM n")
def i06_surface_forms_of_uris(spark: SparkSession, d: str) -> DataFrame:
    return _uris(spark, d).select("uri", S.surface_form_of(F.col("uri")).alias("name"), S.surface_form_of(F.col("uri"), lower=True).alias("lower_name"))


@query("""WITH t AS (SELECT DISTINCT unnest(string_split(types, ',')) AS qname FROM dbpediaresource WHERE types IS NOT NULL), x AS (SELECT DISTINCT trim(qname) AS qname FROM t WHERE trim(qname) <> '')
  SELECT qname, CASE lower(split_part(qname, ':', 1)) WHEN 'd' THEN 'DBpedia:' || regexp_replace(qname, '^[^:]*:', '') WHEN 's' THEN 'Schema:' || regexp_replace(qname, '^[^:]*:', '') ELSE qname END AS type_id FROM x""")
def i09_types_of_qnames(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "dbpediaresource").select(F.explode(F.split("types", ",")).alias("q")).select(F.trim("q").alias("qname")).filter(F.col("qname") != "").distinct()
    return rows.select("qname", S.type_of_qname(F.col("qname")).alias("type_id"))


@query("""SELECT uri, slice_id, array_to_string(list_transform(list_filter(list_transform(string_split(coalesce(types, ''), ','), lambda t: trim(t)), lambda t: t <> ''), lambda q: CASE lower(split_part(q, ':', 1))
  WHEN 'd' THEN 'DBpedia:' || regexp_replace(q, '^[^:]*:', '') WHEN 's' THEN 'Schema:' || regexp_replace(q, '^[^:]*:', '') ELSE q END), ',') AS type_ids FROM dbpediaresource""")
def i10_types_of_csv(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "dbpediaresource").select("uri", "slice_id", F.array_join(S.types_of_csv(F.col("types")), ",").alias("type_ids"))


@query("SELECT 'http://schema.org/' || s.v AS uri, 'Schema:' || s.v AS type_id FROM (SELECT DISTINCT split_part(trim(t), ':', 2) AS v FROM (SELECT unnest(string_split(types, ',')) AS t FROM dbpediaresource WHERE types IS NOT NULL) WHERE trim(t) LIKE 'Schema:%') s")
def i08_types_of_uris(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "dbpediaresource").select(F.explode(F.split("types", ",")).alias("q")).select(F.trim("q").alias("q")).filter(F.col("q").startswith("Schema:"))
    return rows.select(F.concat(F.lit("http://schema.org/"), F.split_part("q", F.lit(":"), F.lit(2))).alias("uri")).distinct().select("uri", S.type_of_uri(F.col("uri")).alias("type_id"))


@query(f"""WITH {FORMS} SELECT DISTINCT name, alt FROM (SELECT name, unnest([name, lower(name), regexp_replace(name, '(?i)^(the|an|a) ', ''), regexp_replace(name, 's$', ''), trim(regexp_replace(name, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))]) AS alt FROM f)""")
def i12_alternatives(spark: SparkSession, d: str) -> DataFrame:
    return _forms(spark, d).select("name", F.explode(S.alternatives(F.col("name"))).alias("alt"))


@query(f"WITH {FORMS} SELECT name, {NT.format('name')} AS escaped FROM f")
def i13_nt_escapes(spark: SparkSession, d: str) -> DataFrame:
    return _forms(spark, d).select("name", S.nt_escape(F.col("name")).alias("escaped"))


@query(f"""WITH {ALIKE} SELECT name, other, CASE WHEN name = other THEN 1.0 WHEN lower(name) = lower(other) THEN 0.85 ELSE 0.85 * (1 - {EDITS.format('name', 'other')} / greatest(length(name), length(other))) END AS score FROM alike""")
def i17_edit_scores(spark: SparkSession, d: str) -> DataFrame:
    """Edit scores of forms and known names that share letter trigrams, equal or not."""
    from kedge.operators.linking import trigram_names

    near = trigram_names(_forms(spark, d), table(spark, d, "surface_forms").filter(F.col("name").isNotNull()).select("name"))
    return near.select("name", F.col("form").alias("other"), S.edit_score(F.col("name"), F.col("form")).alias("score"))


@query(f"WITH {FORMS} SELECT name, array_to_string(list_filter(string_split(trim(regexp_replace(lower(name), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' '), lambda w: w NOT IN ('the', 'a', 'an')), ' ') AS normal FROM f")
def e06_normalised_names(spark: SparkSession, d: str) -> DataFrame:
    return _forms(spark, d).select("name", S.normalise_name(F.col("name")).alias("normal"))


@query("""SELECT occ_id, trim(regexp_replace(regexp_replace(context, '[+\\-&|!(){}\\[\\]^"~*?:\\\\/]', ' ', 'g'), ' +', ' ', 'g')) AS q FROM occs WHERE context IS NOT NULL""")
def i18_sanitised_queries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "occs").filter(F.col("context").isNotNull()).select("occ_id", S.sanitise_query(F.col("context")).alias("q"))


@query(f"WITH t AS (SELECT unnest({WORDS.format('context')}) AS token FROM occs) SELECT token, count(*) AS n FROM t WHERE regexp_full_match(token, '\\p{{L}}{{2,}}') GROUP BY token")
def i19_matrix_tokens(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "occs").select(F.explode(T.lower_words(F.col("context"))).alias("token"))
    return rows.filter(S.accept_in_matrix(F.col("token"))).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS at FROM events WHERE ts IS NOT NULL")
def i20_feed_dates(spark: SparkSession, d: str) -> DataFrame:
    """Event times written as feed dates and read again."""
    text = F.concat(F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))
    return table(spark, d, "events").filter(F.col("ts").isNotNull()).select("event_id", F.unix_timestamp(S.rss_time(text)).alias("at"))


@query("SELECT occ_id, regexp_replace(context, '<[^>]*>', '', 'g') AS bare FROM occs WHERE contains(context, '<')")
def i21_stripped_html(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "occs").filter(F.contains("context", F.lit("<"))).select("occ_id", S.strip_html(F.col("context")).alias("bare"))


@query("""SELECT uri, pow(2, -sum(p * log2(p))) AS perplexity FROM (SELECT uri, n / sum(n) OVER (PARTITION BY uri) AS p FROM (SELECT uri, surface_form, count(*) AS n FROM occs WHERE uri IS NOT NULL AND surface_form IS NOT NULL GROUP BY 1, 2)) GROUP BY uri""")
def i23_perplexity(spark: SparkSession, d: str) -> DataFrame:
    """Perplexity of the forms of each resource."""
    from pyspark.sql.window import Window

    from kedge.operators.model import pair_counts

    share = F.col("n") / F.sum("n").over(Window.partitionBy("uri"))
    return pair_counts(table(spark, d, "occs")).select("uri", share.alias("p")).groupBy("uri").agg(S.perplexity(F.collect_list("p")).alias("perplexity"))


@query(f"""WITH {URIS}, k AS (SELECT uri, replace({DECODED}, '_', ' ') AS t FROM u)
  SELECT uri, '+"' || regexp_replace(t, ' \\([^)]*\\)$', '') || '"' || CASE WHEN regexp_extract(t, ' \\(([^)]*)\\)$', 1) IN ('', 'disambiguation') THEN '' ELSE ' +"' || regexp_extract(t, ' \\(([^)]*)\\)$', 1) || '"' END AS keywords FROM k""")
def c21_keywords(spark: SparkSession, d: str) -> DataFrame:
    return _uris(spark, d).select("uri", S.keywords_of(F.col("uri")).alias("keywords"))


@query(f"""WITH {FORMS}, w AS (SELECT name, array_to_string(list_transform(string_split_regex(lower(name), '[ _]+'), lambda x: substr(x, 1, 1)), '') AS acronym FROM f) SELECT name, acronym, length(acronym) > 1 AS fits FROM w""")
def a27_acronyms(spark: SparkSession, d: str) -> DataFrame:
    """The initials of every name are an acronym of it, single letters aren't."""
    initials = F.array_join(F.transform(F.split(F.lower("name"), "[ _]+"), lambda w: F.substring(w, 1, 1)), "")
    return _forms(spark, d).select("name", initials.alias("acronym")).select("name", "acronym", S.is_acronym_of(F.col("acronym"), F.col("name")).alias("fits"))


@query("""WITH d AS (SELECT doc_id, regexp_extract_all(text, '[\\p{L}\\p{N}]+') AS w FROM documents) SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, w[i] AS token FROM (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS i FROM d)""")
def c02_tokens(spark: SparkSession, d: str) -> DataFrame:
    return T.token_rows(table(spark, d, "documents"), "doc_id", "text").select("doc_id", "pos", "token")


@query(f"WITH {SPANS.format(key='occ_id', text='context', table='occs')} SELECT occ_id, pos, token, start FROM span")
def c02_token_spans(spark: SparkSession, d: str) -> DataFrame:
    """Every token of every context with its character offset."""
    got = T.token_spans(table(spark, d, "occs"), "occ_id", "context")
    return got.select("occ_id", F.col("pos").cast("long").alias("pos"), "token", F.col("start").cast("long").alias("start"))


@query(None)
def c01_sentences(spark: SparkSession, d: str) -> DataFrame:
    return T.sentence_rows(table(spark, d, "documents"), "doc_id", "text").select("doc_id", "sent", F.size("words").alias("n_words"))


@query(f"""WITH d AS (SELECT doc_id, {WORDS.format('text')} AS w FROM documents), g AS (SELECT w[i] || ' ' || w[i + 1] AS gram FROM (SELECT w, unnest(generate_series(1, len(w) - 1)) AS i FROM d)) SELECT gram, count(*) AS n FROM g GROUP BY gram HAVING count(*) >= 3""")
def c17_bigrams(spark: SparkSession, d: str) -> DataFrame:
    rows = spread(table(spark, d, "documents").select("text")).select(T.lower_words(F.col("text")).alias("w")).select(F.explode(T.ngrams(F.col("w"), 2)).alias("gram"))
    return rows.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= 3)


@query(f"WITH {FORMS} SELECT gram, count(*) AS n FROM (SELECT substr(lower(name), CAST(i AS INTEGER), 3) AS gram FROM (SELECT name, unnest(generate_series(1, length(name) - 2)) AS i FROM f)) GROUP BY gram")
def c17_char_trigrams(spark: SparkSession, d: str) -> DataFrame:
    """Letter trigrams of the names, in any script."""
    rows = _forms(spark, d).select(F.explode(T.char_ngrams(F.lower("name"), 3)).alias("gram"))
    return rows.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT doc_id, CASE WHEN lower(lang) LIKE 'fr%' THEN regexp_replace(text, '\\b[dlDL][''’](\\p{L})', '  \\1', 'g') WHEN lower(lang) LIKE 'en%' THEN regexp_replace(text, '[''’]s\\b', ' s', 'g') ELSE text END AS normal FROM documents""")
def c03_language_rules(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.language_normalised(F.col("text"), F.col("lang")).alias("normal"))


@query(f"""WITH t AS (SELECT unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+')) AS token FROM documents), v AS (SELECT unnest({WORDS.format('context')}) AS token FROM occs),
  k AS (SELECT DISTINCT token FROM v), y AS (SELECT t.token, CASE WHEN t.token IN ('the', 'a', 'an', 'and', 'or', 'of', 'in', 'on', 'to', 'is', 'was', 'for', 'by', 'with', 'that', 'it', 'as', 'at') THEN 'stopword' WHEN k.token IS NULL THEN 'unknown' ELSE 'known' END AS kind FROM t LEFT JOIN k ON k.token = lower(t.token))
  SELECT kind, count(*) AS n, count(DISTINCT token) AS types FROM y GROUP BY kind""")
def c04_token_typing(spark: SparkSession, d: str) -> DataFrame:
    """Document tokens as stopword (by exact case), known to the contexts' vocabulary, or unknown."""
    counted = T.token_rows(table(spark, d, "documents"), "doc_id", "text").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    known = table(spark, d, "occs").select(F.explode(T.lower_words(F.col("context"))).alias("k")).distinct()
    kind = F.when(F.col("token").isin(*T.STOPWORDS), "stopword").when(F.col("k").isNull(), "unknown").otherwise("known")
    return counted.join(known, F.lower("token") == F.col("k"), "left").withColumn("kind", kind).groupBy("kind").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("types"))


@query(None)
def c08_stems(spark: SparkSession, d: str) -> DataFrame:
    """Stems of the distinct English words."""
    words = table(spark, d, "documents").filter(F.lower("lang").startswith("en")).select(F.explode(T.lower_words(F.col("text"))).alias("token")).distinct()
    return words.select("token", T.stem_udf("token").alias("stem"))


@query("""WITH s AS (SELECT occ_id, context, surface_form, text_offset FROM occs WHERE text_offset >= 0 AND substr(context, text_offset + 1, length(surface_form)) = surface_form),
  w AS (SELECT occ_id, regexp_extract_all(context, '[\\p{L}\\p{N}]+') AS t, len(regexp_extract_all(substr(context, 1, text_offset), '[\\p{L}\\p{N}]+')) AS lead_n, len(regexp_extract_all(surface_form, '[\\p{L}\\p{N}]+')) AS width FROM s),
  r AS (SELECT *, greatest(20 - width, 0) AS room, len(t) - lead_n - width AS right_have FROM w),
  l AS (SELECT *, least(lead_n, greatest(CAST(ceil(room / 2) AS BIGINT), room - right_have)) AS lft FROM r),
  g AS (SELECT occ_id, t[lead_n - lft + 1:lead_n + width + least(right_have, room - lft)] AS got FROM l)
  SELECT occ_id, array_to_string(got, ' ') AS narrow FROM g WHERE len(got) >= 8""")
def c11_context_windows(spark: SparkSession, d: str) -> DataFrame:
    """Contexts narrowed to 20 words around the mention; with fewer than 8 they are dropped."""
    from kedge.operators.filters import narrowed

    return table(spark, d, "occs").transform(narrowed(20, 8)).select("occ_id", "narrow")


@query("SELECT occ_id, trim(regexp_replace(regexp_replace(" + _WIKI + ", '\\[\\[[^\\[\\]|]*\\|([^\\[\\]|]*)(?:\\|[^\\[\\]]*)?\\]\\]', '\\1', 'g'), '\\[\\[([^\\[\\]]*)\\]\\]', '\\1', 'g')) AS plain FROM occs")
def c12_stripped_wiki(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "occs").select("occ_id", T.strip_wiki(F.col("context")).alias("plain"))


@query("""WITH b AS (SELECT occ_id, context, regexp_extract_all(context, '\\[\\[([^\\[\\]]*)\\]\\]', 1) AS w, string_split_regex(context, '\\[\\[[^\\[\\]]*\\]\\]') AS g FROM occs WHERE contains(context, '[[')),
  x AS (SELECT occ_id, i, w[i] AS name, length(g[i]) AS gap, length(w[i]) AS size FROM (SELECT *, unnest(generate_series(1, len(w))) AS i FROM b))
  SELECT occ_id, name, CAST(sum(gap + size) OVER (PARTITION BY occ_id ORDER BY i) - size AS BIGINT) AS at FROM x""")
def c13_bracket_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Marked names with their offsets in the text without marks."""
    _, mentions = T.mentions_in_brackets(F.col("context"))
    rows = table(spark, d, "occs").filter(F.contains("context", F.lit("[["))).select("occ_id", F.explode(mentions).alias("m"))
    return rows.select("occ_id", "m.name", F.col("m.offset").cast("long").alias("at"))


@query("SELECT occ_id, regexp_replace(regexp_replace(context, '\\[\\[[^\\[\\]|]*\\|([^\\[\\]|]*)(?:\\|[^\\[\\]]*)?\\]\\]', '\\1', 'g'), '\\[\\[([^\\[\\]]*)\\]\\]', '\\1', 'g') AS plain FROM occs WHERE contains(context, '[[')")
def c15_erased_markup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "occs").filter(F.contains("context", F.lit("[["))).select("occ_id", T.erase_markup(F.col("context")).alias("plain"))


@query(f"""WITH t AS (SELECT doc_id, unnest({WORDS.format('text')}) AS token FROM documents WHERE lower(lang) LIKE 'en%') SELECT token, count(*) AS n FROM t WHERE token NOT IN ('the', 'a', 'an', 'and', 'or', 'of', 'in', 'on', 'to', 'is', 'was', 'for', 'by', 'with', 'that', 'it', 'as', 'at') GROUP BY token""")
def c16_analysed_terms(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").filter(F.lower("lang").startswith("en")).select(F.explode(F.filter(T.lower_words(F.col("text")), lambda w: ~w.isin(*T.STOPWORDS))).alias("token"))
    return rows.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH d AS (SELECT doc_id, regexp_extract_all(text, '[\\p{L}\\p{N}]+') AS w FROM documents), t AS (SELECT doc_id, i - 1 AS pos, w[i] AS token FROM (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS i FROM d)),
  c AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM t WHERE regexp_matches(token, '^\\p{Lu}'))
  SELECT doc_id, CAST(min(pos) AS INTEGER) AS first, CAST(count(*) AS INTEGER) AS length, string_agg(token, ' ' ORDER BY pos) AS run FROM c GROUP BY doc_id, island""")
def d05_capital_runs(spark: SparkSession, d: str) -> DataFrame:
    tokens = T.token_rows(table(spark, d, "documents"), "doc_id", "text")
    return T.capital_runs(tokens, "doc_id", tokens)


@query("""WITH d AS (SELECT doc_id, regexp_extract_all(text, '[\\p{L}\\p{N}]+') AS w FROM documents), t AS (SELECT doc_id, i - 1 AS pos, w[i] AS token FROM (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS i FROM d))
  SELECT doc_id, pos, token, lag(token) OVER w AS left_token, lead(token) OVER w AS right_token FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY pos)""")
def c19_token_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Each token with its neighbours, from the array of its text: no shuffle and no window."""
    w = T.words(F.col("text"))
    rows = table(spark, d, "documents").select("doc_id", w.alias("w")).select("doc_id", "w", F.posexplode("w").alias("pos", "token"))
    left = F.when(F.col("pos") > 0, F.try_element_at("w", F.greatest(F.col("pos"), F.lit(1))))
    return rows.select("doc_id", F.col("pos").cast("long").alias("pos"), "token", left.alias("left_token"), F.try_element_at("w", F.col("pos") + 2).alias("right_token"))
