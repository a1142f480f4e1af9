"""Queries of spotting, candidate lookup, scoring and filters over the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kedge import api
from kedge.functions import text as T
from kedge.operators import filters, linking, model, spotting
from kedge.operators.skew import salted_join
from kedge.plans.kb import CAND, CTX, FORMS, LOWER, PAIRS, RES, TOTALS, WORDS, kb_model
from kedge.plans.scalar import ALIKE, EDITS, SPANS
from kedge.session import cut, free_shuffles, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def wrap(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return wrap


# The dictionary: names by their tokens; of names with the same tokens the likeliest.
CORPUS_FORMS = f"{PAIRS}, pf AS (SELECT name, CAST(sum(n) AS BIGINT) AS a FROM pairs GROUP BY name), forms AS (SELECT f.name, f.a AS annotated, f.a + coalesce(l.a, 0) AS total FROM pf f LEFT JOIN pf l ON l.name = lower(f.name) AND l.name <> f.name)"
DICT = f"""{CORPUS_FORMS}, dict_rows AS (SELECT name, CASE WHEN total = -1 THEN 1.0 WHEN total = 0 THEN 0.0 ELSE annotated / total END AS p, regexp_extract_all(name, '[\\p{{L}}\\p{{N}}]+') AS w FROM forms),
dict AS (SELECT array_to_string(w, ' ') AS key, len(w) AS n, arg_max(name, (p, name)) AS name, max(p) AS p FROM dict_rows WHERE p >= 0.05 AND len(w) BETWEEN 1 AND 6 GROUP BY 1, 2)"""
# All matches: spots(doc_id, pos, n, key).
MATCHES = f"""{DICT}, doc AS (SELECT doc_id, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+') AS w FROM documents),
gram AS (SELECT doc_id, i - 1 AS pos, n, array_to_string(w[i:i + n - 1], ' ') AS key FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM (SELECT doc_id, w, unnest(generate_series(1, 6)) AS n FROM doc))),
spots AS (SELECT g.doc_id, g.pos, g.n, d.name, d.p FROM gram g JOIN dict d ON d.key = g.key)"""
# Matches with characters: atx(doc_id, start, size, pos, n, name, p).
PLACED = f"""{MATCHES}, {SPANS.format(key='doc_id', text='text', table='documents')},
atx AS (SELECT s.doc_id, a.start, z.start + length(z.token) - a.start AS size, s.pos, s.n, s.name, s.p FROM spots s JOIN span a ON a.doc_id = s.doc_id AND a.pos = s.pos JOIN span z ON z.doc_id = s.doc_id AND z.pos = s.pos + s.n - 1)"""
SCORE = "(1.0 * p + 0.2 * CASE WHEN length(name) < 5 AND upper(name) = name AND NOT regexp_full_match(name, '[0-9]+') AND regexp_matches(name, '\\p{L}') THEN 1 ELSE 0 END - 0.2 * CASE WHEN regexp_full_match(name, '[0-9.,]+') THEN 1 ELSE 0 END + 0.1)"
MENTIONS = "m AS (SELECT occ_id, surface_form AS name, context AS text FROM occs WHERE surface_form IS NOT NULL AND context IS NOT NULL)"


def mentions(spark: SparkSession, d: str) -> DataFrame:
    """Every occurrence as a mention to be linked: (occ_id, name, text)."""
    occs = table(spark, d, "occs").filter(F.col("surface_form").isNotNull() & F.col("context").isNotNull())
    return occs.select("occ_id", F.col("surface_form").alias("name"), F.col("context").alias("text"))


def names_of(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "occs").filter(F.col("surface_form").isNotNull()).select(F.col("surface_form").alias("name")).distinct()


def dictionary_of(spark: SparkSession, d: str) -> DataFrame:
    return spotting.dictionary(model.forms_of_pairs(model.pair_counts(table(spark, d, "occs"))))


def matches_of(spark: SparkSession, d: str) -> DataFrame:
    return spotting.dictionary_matches(table(spark, d, "documents"), dictionary_of(spark, d))


@query(f"WITH {DICT} SELECT key, n AS n_tokens, name, p FROM dict")
def d01_dictionary(spark: SparkSession, d: str) -> DataFrame:
    return dictionary_of(spark, d).select("key", F.col("n_tokens").cast("long").alias("n_tokens"), "name", "p")


@query(f"WITH {MATCHES} SELECT doc_id, pos, n AS n_tokens, name, p FROM spots")
def d03_dictionary_matches(spark: SparkSession, d: str) -> DataFrame:
    return matches_of(spark, d).select("doc_id", F.col("pos").cast("long").alias("pos"), F.col("n_tokens").cast("long").alias("n_tokens"), "name", "p")


@query(f"WITH {MATCHES}, s AS (SELECT doc_id, pos, n AS n_tokens, name, {SCORE} AS score FROM spots) SELECT * FROM s WHERE score >= 0.5")
def d07_scored_spots(spark: SparkSession, d: str) -> DataFrame:
    got = spotting.accepted(matches_of(spark, d), 0.5)
    return got.select("doc_id", F.col("pos").cast("long").alias("pos"), F.col("n_tokens").cast("long").alias("n_tokens"), "name", "score")


@query(f"WITH {MATCHES} SELECT doc_id, pos, n AS n_tokens, name, p FROM spots WHERE p >= 0.25")
def d09_unweighted_spots(spark: SparkSession, d: str) -> DataFrame:
    got = spotting.accepted(matches_of(spark, d), weights=None)
    return got.select("doc_id", F.col("pos").cast("long").alias("pos"), F.col("n_tokens").cast("long").alias("n_tokens"), "name", "p")


# The ordered fold over a text's spots: kept(doc_id, start, size, pos, n, name, p).
FOLD = f"""WITH RECURSIVE {PLACED}, o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start, size, pos) AS i FROM atx WHERE {SCORE} >= 0.5),
step AS (SELECT doc_id, i, i AS last, start, size, p, CAST(NULL AS BIGINT) AS out FROM o WHERE i = 1
  UNION ALL SELECT o.doc_id, o.i, CASE WHEN meets AND NOT takes THEN t.last ELSE o.i END, CASE WHEN meets AND NOT takes THEN t.start ELSE o.start END, CASE WHEN meets AND NOT takes THEN t.size ELSE o.size END, CASE WHEN meets AND NOT takes THEN t.p ELSE o.p END, CASE WHEN NOT meets THEN t.last END
  FROM (SELECT t.doc_id, t.i, t.last, t.start, t.size, t.p, o.i AS oi, o.start < t.start + t.size AS meets,
      CASE WHEN o.size > t.size AND o.p > t.p / 2 THEN TRUE WHEN o.size <= t.size AND o.p <= t.p * 2 THEN FALSE WHEN o.p = t.p THEN FALSE ELSE o.p > t.p END AS takes FROM step t JOIN o ON o.doc_id = t.doc_id AND o.i = t.i + 1) t JOIN o ON o.doc_id = t.doc_id AND o.i = t.oi),
kept AS (SELECT o.* FROM o JOIN (SELECT doc_id, out AS k FROM step WHERE out IS NOT NULL UNION ALL SELECT doc_id, arg_max(last, i) FROM step GROUP BY doc_id) e ON e.doc_id = o.doc_id AND e.k = o.i)"""
_SPOT = "doc_id, CAST(pos AS INTEGER) AS pos, CAST(n AS INTEGER) AS n_tokens, CAST(start AS INTEGER) AS start, CAST(size AS INTEGER) AS length, name, p"


@query(f"{FOLD} SELECT {_SPOT} FROM kept")
def d10_resolved_spots(spark: SparkSession, d: str) -> DataFrame:
    """One spot per stretch of text: the ordered fold."""
    return spotting.resolve_overlaps(spotting.accepted(matches_of(spark, d), 0.5))


@query(f"""WITH RECURSIVE {PLACED}, o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start, size DESC, pos) AS i FROM atx),
  step AS (SELECT doc_id, i, start + size AS e, TRUE AS keep FROM o WHERE i = 1 UNION ALL SELECT o.doc_id, o.i, CASE WHEN o.start > t.e THEN o.start + o.size ELSE t.e END, o.start > t.e FROM step t JOIN o ON o.doc_id = t.doc_id AND o.i = t.i + 1)
  SELECT {_SPOT} FROM o JOIN step USING (doc_id, i) WHERE keep""")
def d13_leftmost_longest(spark: SparkSession, d: str) -> DataFrame:
    return spotting.leftmost_longest(matches_of(spark, d))


_RUNS = """doc AS (SELECT doc_id, regexp_extract_all(text, '[\\p{L}\\p{N}]+') AS w FROM documents), t AS (SELECT doc_id, i - 1 AS pos, w[i] AS token FROM (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS i FROM doc)),
  c AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM t WHERE regexp_matches(token, '^\\p{Lu}')),
  runs AS (SELECT doc_id, min(pos) AS first, count(*) AS length, list(token ORDER BY pos) AS w FROM c GROUP BY doc_id, island)"""


@query(f"""WITH {DICT}, {_RUNS}, trims AS (SELECT doc_id, first, i AS priority, array_to_string(w[i + 1:], ' ') AS trim FROM (SELECT *, unnest(generate_series(0, length - 1)) AS i FROM runs)
  UNION ALL SELECT doc_id, first, length + i - 1, array_to_string(w[1:length - i], ' ') FROM (SELECT *, unnest(generate_series(1, length - 1)) AS i FROM runs WHERE length > 1))
  SELECT t.doc_id, t.first, arg_min(t.trim, t.priority) AS trim, min(t.priority) AS priority FROM trims t JOIN dict d ON d.key = t.trim GROUP BY t.doc_id, t.first""")
def d06_capital_run_trims(spark: SparkSession, d: str) -> DataFrame:
    """The first trim of each capital run that is a name."""
    tokens = T.token_rows(table(spark, d, "documents"), "doc_id", "text")
    runs = T.capital_runs(tokens, "doc_id", tokens)
    got = spotting.first_known_trim(runs, dictionary_of(spark, d), ["doc_id", "first"])
    return got.select("doc_id", F.col("first").cast("long").alias("first"), "trim", F.col("priority").cast("long").alias("priority"))


@query(f"WITH {DICT}, n AS (SELECT DISTINCT surface_form AS name FROM occs WHERE surface_form IS NOT NULL) SELECT n.name FROM n WHERE EXISTS (SELECT 1 FROM dict d WHERE lower(d.name) = lower(n.name))")
def d16_exact_dictionary(spark: SparkSession, d: str) -> DataFrame:
    """Names in the dictionary, without regard to case; exact, so without the false hits of a Bloom filter."""
    known = dictionary_of(spark, d).select(F.lower("name").alias("l")).distinct()
    names = names_of(spark, d)
    return names.join(known, F.lower("name") == F.col("l"), "left_semi")


@query(f"WITH {MATCHES}, v AS (SELECT token FROM (SELECT unnest({WORDS.format('context')}) AS token FROM occs) GROUP BY token HAVING count(*) > 100) SELECT doc_id, pos, name FROM spots WHERE length(name) >= 3 AND lower(name) NOT IN (SELECT token FROM v) AND NOT regexp_full_match(name, '(?:January|February|March|April|May|June|July|August|September|October|November|December)')")
def d23_chained_selectors(spark: SparkSession, d: str) -> DataFrame:
    """Not short, not a common word, not a month."""
    common = table(spark, d, "occs").select(F.explode(T.lower_words(F.col("context"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    months = "January|February|March|April|May|June|July|August|September|October|November|December"
    select = spotting.chained(spotting.not_short(3), spotting.uncommon(common, 100), spotting.without_pattern(months))
    return matches_of(spark, d).transform(select).select("doc_id", F.col("pos").cast("long").alias("pos"), "name")


@query(f"WITH {MATCHES} SELECT doc_id, pos, name FROM spots WHERE name IN (SELECT name FROM pairs WHERE n > 20)")
def d27_whitelisted_spots(spark: SparkSession, d: str) -> DataFrame:
    allowed = model.pair_counts(table(spark, d, "occs")).filter(F.col("n") > 20).select("name")
    return matches_of(spark, d).transform(spotting.whitelisted(allowed)).select("doc_id", F.col("pos").cast("long").alias("pos"), "name")


@query(f"WITH {MATCHES} SELECT doc_id, pos, name FROM spots WHERE n BETWEEN 2 AND 4")
def d32_term_size(spark: SparkSession, d: str) -> DataFrame:
    return matches_of(spark, d).transform(spotting.term_size(2, 4)).select("doc_id", F.col("pos").cast("long").alias("pos"), "name")


@query(f"WITH {CAND}, {MENTIONS} SELECT m.occ_id, c.uri, c.n, c.prior FROM m JOIN candidates c ON c.name = m.name")
def e01_candidates(spark: SparkSession, d: str) -> DataFrame:
    return mentions(spark, d).select("occ_id", "name").join(kb_model(spark, d).candidates, "name").select("occ_id", "uri", "n", "prior")


_NORM = f"""{FORMS}, {LOWER}, known AS (SELECT lower(f.name) AS lower, f.name AS form, CASE WHEN total = -1 THEN 1.0 WHEN total > 0 THEN annotated / total ELSE 0.0 END AS p, total, l.lower_count FROM forms f LEFT JOIN lower_rows l ON l.lower = lower(f.name)),
  nf AS (SELECT n.name, k.form, (CASE WHEN n.name = k.form THEN 1.0 ELSE 0.85 END) * p * CASE WHEN lower_count IS NULL OR total <= 0 THEN 1.0 ELSE 2.0 * total / (lower_count + total) END AS score FROM names n JOIN known k ON k.lower = lower(n.name)),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY score DESC, form) AS rank FROM nf)"""
_NAMES = "names AS (SELECT DISTINCT surface_form AS name FROM occs WHERE surface_form IS NOT NULL)"


@query(f"WITH {_NAMES}, {_NORM} SELECT name, form, score, rank FROM ranked WHERE rank <= 5")
def e04_normalised_forms(spark: SparkSession, d: str) -> DataFrame:
    m = kb_model(spark, d)
    return linking.normalised_forms(names_of(spark, d), m.forms, m.lower)


@query(f"""WITH {CAND}, names AS (SELECT name FROM surface_forms WHERE name IS NOT NULL), {_NORM}
  SELECT n.name, c.uri, c.n, TRUE AS exact FROM names n JOIN candidates c ON c.name = n.name UNION ALL
  SELECT r.name, c.uri, max(c.n), FALSE FROM ranked r JOIN candidates c ON c.name = r.form WHERE r.rank <= 5 AND r.name NOT IN (SELECT name FROM candidates) GROUP BY r.name, c.uri""")
def e02_candidates_with_fallback(spark: SparkSession, d: str) -> DataFrame:
    m = kb_model(spark, d)
    names = table(spark, d, "surface_forms").filter(F.col("name").isNotNull()).select("name")
    return linking.candidates_with_fallback(names, m.candidates, m.forms, m.lower)


@query(f"WITH {CAND}, {_NAMES} SELECT n.name, count(c.uri) AS ambiguity FROM names n LEFT JOIN candidates c ON c.name = n.name GROUP BY n.name")
def e03_ambiguity(spark: SparkSession, d: str) -> DataFrame:
    return linking.ambiguity(names_of(spark, d), kb_model(spark, d).candidates)


_BI = "SELECT DISTINCT name, substr('^' || lower(name) || '$', CAST(i AS INTEGER), 2) AS g FROM (SELECT name, unnest(generate_series(1, length(name) + 1)) AS i FROM {0} WHERE name IS NOT NULL)"


@query(f"""WITH {_NAMES}, ba AS ({_BI.format('names')}), bb AS ({_BI.format('(SELECT DISTINCT name FROM surface_forms)')}), p AS (SELECT ba.name, bb.name AS form FROM ba JOIN bb ON bb.g = ba.g WHERE abs(length(ba.name) - length(bb.name)) * 2 <= greatest(length(ba.name), length(bb.name)) GROUP BY 1, 2 HAVING count(*) >= 2),
  s AS (SELECT name, form, 1 - {EDITS.format('lower(name)', 'lower(form)')} / greatest(length(name), length(form)) AS similarity FROM p) SELECT * FROM s WHERE similarity >= 0.5""")
def e09_fuzzy_names(spark: SparkSession, d: str) -> DataFrame:
    """Names at least half alike, in any script."""
    return linking.fuzzy_names(names_of(spark, d), table(spark, d, "surface_forms").filter(F.col("name").isNotNull()).select("name").distinct())


@query(f"WITH {ALIKE} SELECT name, other AS form, shared FROM alike")
def e10_trigram_names(spark: SparkSession, d: str) -> DataFrame:
    """Names that share at least six letter trigrams, in any script."""
    return linking.trigram_names(names_of(spark, d), table(spark, d, "surface_forms").filter(F.col("name").isNotNull()).select("name"))


@query("""WITH f AS (SELECT DISTINCT surface_form AS name FROM occs WHERE surface_form IS NOT NULL), k AS (SELECT DISTINCT name FROM surface_forms),
  v AS (SELECT f.name, k.name AS form, x.i FROM f, (SELECT unnest([1, 2, 3, 4]) AS i) x JOIN k ON k.name = CASE x.i WHEN 1 THEN f.name WHEN 2 THEN regexp_replace(f.name, '(?i)^(the|an|a) ', '') WHEN 3 THEN regexp_replace(f.name, '''s$', '') WHEN 4 THEN regexp_replace(f.name, 's$', '') END)
  SELECT name, arg_min(form, i) AS form FROM v GROUP BY name""")
def e12_name_variants(spark: SparkSession, d: str) -> DataFrame:
    """The first variant of a name that is known: itself, without article, without 's, without s."""
    known = table(spark, d, "surface_forms").filter(F.col("name").isNotNull()).select(F.col("name").alias("form")).distinct()
    n = F.col("name")
    variants = F.array(n, F.regexp_replace(n, "(?i)^(the|an|a) ", ""), F.regexp_replace(n, "'s$", ""), F.regexp_replace(n, "s$", ""))
    tried = names_of(spark, d).select("name", F.posexplode(variants).alias("i", "form")).join(known, "form")
    return tried.groupBy("name").agg(F.min_by("form", "i").alias("form"))


@query(f"WITH {PAIRS}, {RES} SELECT r.uri, p.name, p.n FROM res r JOIN pairs p ON p.uri = r.uri")
def e13_names_of_resources(spark: SparkSession, d: str) -> DataFrame:
    m = kb_model(spark, d)
    return m.pairs.join(m.resources.select("uri"), "uri").select("uri", "name", "n")


@query(f"WITH {RES} SELECT uri, support, (support + 1) / 69772256.0 AS prior FROM res")
def e15_resource_priors(spark: SparkSession, d: str) -> DataFrame:
    from kedge.functions.scalars import TOTAL_OCCURRENCES

    return model.resource_counts(table(spark, d, "dbpediaresource")).select("uri", "support", ((F.col("support") + 1) / float(TOTAL_OCCURRENCES)).alias("prior"))


@query(f"""WITH {CAND}, {CTX}, {TOTALS}, {MENTIONS}, q AS (SELECT DISTINCT occ_id, token FROM (SELECT occ_id, unnest({WORDS.format('text')}) AS token FROM m)), tok AS (SELECT token, sum(n) AS tn FROM ctx GROUP BY token), ct AS (SELECT uri, sum(n) AS total FROM ctx GROUP BY uri),
  best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY prior DESC, uri) AS r FROM candidates) WHERE r <= 10), s AS (SELECT m.occ_id, m.name, b.uri, b.support, b.prior FROM m JOIN best b ON b.name = m.name),
  gain AS (SELECT s.occ_id, s.uri, sum(ln(0.8 * (tn + 1) / (n_tokens + vocabulary) + 0.2 * c.n / total) - ln(0.8 * (tn + 1) / (n_tokens + vocabulary))) AS gain FROM s JOIN ctx c ON c.uri = s.uri JOIN q ON q.occ_id = s.occ_id AND q.token = c.token JOIN ct ON ct.uri = s.uri JOIN tok ON tok.token = c.token, totals GROUP BY s.occ_id, s.uri),
  sc AS (SELECT s.*, coalesce(g.gain, 0) AS context_gain, ln(s.prior) + coalesce(g.gain, 0) + ln(s.support / t.support) AS score, -ln(t.annotated) AS nil FROM s LEFT JOIN gain g ON g.occ_id = s.occ_id AND g.uri = s.uri, totals t),
  kept AS (SELECT *, greatest(max(score) OVER (PARTITION BY occ_id), nil) AS top FROM sc WHERE score > nil),
  fin AS (SELECT occ_id, uri, support, score, exp(score - top) / (sum(exp(score - top)) OVER (PARTITION BY occ_id) + exp(nil - top)) AS final_score, coalesce(exp(lead(score) OVER w - score), 0) AS second_rank, row_number() OVER w AS rank FROM kept WINDOW w AS (PARTITION BY occ_id ORDER BY score DESC, uri))
  SELECT occ_id, uri, support, round(score, 6) AS score, round(final_score, 6) AS final_score, round(second_rank, 6) AS second_rank FROM fin WHERE rank = 1""")
def f13_linked_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Every mention with its best entity: candidates, context score, prune against no entity, softmax, second rank."""
    got = api.link_mentions(mentions(spark, d), kb_model(spark, d, cut), "occ_id").filter(F.col("rank") == 1)
    return got.select("occ_id", "uri", "support", F.round("score", 6).alias("score"), F.round("final_score", 6).alias("final_score"), F.round("second_rank", 6).alias("second_rank"))


SQL["g08_filtered_links"] = SQL["f13_linked_mentions"] + " AND support > 20 AND final_score >= 0.5 AND second_rank <= 1 - 0.5 * 0.5"


@query(None)
def g08_filtered_links(spark: SparkSession, d: str) -> DataFrame:
    """Support, confidence and second rank."""
    got = api.link_mentions(mentions(spark, d), kb_model(spark, d, cut), "occ_id").filter(F.col("rank") == 1).transform(filters.pipeline(0.5, 20))
    return got.select("occ_id", "uri", "support", F.round("score", 6).alias("score"), F.round("final_score", 6).alias("final_score"), F.round("second_rank", 6).alias("second_rank"))


@query(f"""WITH {CAND}, {_NAMES} SELECT c.name, c.uri, round(1234.3989 * c.prior + 0.9968 * ln(c.n) - 0.0275, 6) AS linear, round(0.7 * ln(c.n) + 0.3 * c.prior, 6) AS fader, round(ln(c.n) * (1 + c.prior), 6) AS product, round(c.prior + ln(c.n), 6) AS plain FROM candidates c""")
def f14_f16_mixtures(spark: SparkSession, d: str) -> DataFrame:
    prior, context = F.col("prior"), F.log("n")
    mix = {"linear": linking.linear_mixture(prior, context), "fader": linking.fader_mixture(prior, context), "product": linking.product_mixture(prior, context), "plain": linking.unweighted_mixture(prior, context)}
    return kb_model(spark, d).candidates.select("name", "uri", *[F.round(v, 6).alias(k) for k, v in mix.items()])


@query(f"WITH {CAND}, {_NAMES} SELECT name, uri, prior, rank FROM (SELECT n.name, c.uri, c.prior, row_number() OVER (PARTITION BY n.name ORDER BY c.prior DESC, c.uri) AS rank FROM names n JOIN candidates c ON c.name = n.name) WHERE rank <= 3")
def f17_baseline_by_prior(spark: SparkSession, d: str) -> DataFrame:
    return linking.by_prior(kb_model(spark, d).candidates, names_of(spark, d), 3).select("name", "uri", "prior", "rank")


@query(f"WITH {CAND}, {_NAMES} SELECT name, uri, support, rank FROM (SELECT n.name, c.uri, c.support, row_number() OVER (PARTITION BY n.name ORDER BY c.support DESC, c.uri) AS rank FROM names n JOIN candidates c ON c.name = n.name) WHERE rank <= 3")
def f18_baseline_by_support(spark: SparkSession, d: str) -> DataFrame:
    return linking.by_prior(kb_model(spark, d).candidates, names_of(spark, d), 3, "support").select("name", "uri", "support", "rank")


_ICF = f"{CAND}, {CTX}, {_NAMES}, cc AS (SELECT n.name, c.uri FROM names n JOIN candidates c ON c.name = n.name), nc AS (SELECT name, count(*) AS nc FROM cc GROUP BY name), icf AS (SELECT cc.name, x.token, count(*) AS holders, any_value(nc.nc) AS nc FROM cc JOIN ctx x ON x.uri = cc.uri JOIN nc ON nc.name = cc.name GROUP BY cc.name, x.token)"


@query(f"WITH {_ICF}, {MENTIONS}, q AS (SELECT DISTINCT name, token FROM (SELECT name, unnest({WORDS.format('text')}) AS token FROM m)) SELECT icf.name, icf.token, holders, ln(nc / holders) + 1 AS icf FROM icf JOIN q ON q.name = icf.name AND q.token = icf.token")
def f21_icf_weights(spark: SparkSession, d: str) -> DataFrame:
    """Weights of the words that mentions of each name hold."""
    m = kb_model(spark, d, cut)
    got = linking.inverse_candidate_frequency(linking.words_of(mentions(spark, d), "occ_id"), m.candidates, m.contexts)
    return got.select("name", "token", "holders", "icf").distinct()


@query(f"""WITH {_ICF}, {MENTIONS}, q AS (SELECT DISTINCT occ_id, name, token FROM (SELECT occ_id, name, unnest({WORDS.format('text')}) AS token FROM m)),
  s AS (SELECT q.occ_id, q.name, c.uri, sum(sqrt(x.n) * (ln(i.nc / i.holders) + 1) * (ln(i.nc / i.holders) + 1)) AS score FROM q JOIN candidates c ON c.name = q.name JOIN ctx x ON x.uri = c.uri AND x.token = q.token JOIN icf i ON i.name = q.name AND i.token = q.token GROUP BY 1, 2, 3),
  a AS (SELECT m.occ_id, m.name, c.uri, coalesce(s.score, 0) AS score FROM m JOIN candidates c ON c.name = m.name LEFT JOIN s ON s.occ_id = m.occ_id AND s.uri = c.uri)
  SELECT occ_id, uri, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY occ_id ORDER BY round(score, 6) DESC, uri) AS r FROM a) WHERE r = 1""")
def f19_icf_links(spark: SparkSession, d: str) -> DataFrame:
    """Every mention's best candidate by inverse candidate frequency."""
    m = kb_model(spark, d, cut)
    scored = linking.icf_scores(mentions(spark, d), m.candidates, m.contexts, "occ_id").withColumn("score", F.round("score", 6))
    return filters.best_per(scored, ["occ_id"], "score").select("occ_id", "uri", "score")


def contexts_of(spark: SparkSession, d: str) -> DataFrame:
    """The context counts alone, written once."""
    contexts = cut(model.context_counts(table(spark, d, "occs")))
    free_shuffles(spark)
    return contexts


_TFIDF = f"""{CTX}, nd AS (SELECT count(DISTINCT uri) AS nd FROM ctx), df AS (SELECT token, count(*) AS df FROM ctx GROUP BY token), w AS (SELECT c.uri, c.token, sqrt(c.n) * ln(nd / df) AS w FROM ctx c JOIN df ON df.token = c.token, nd), nm AS (SELECT uri, sqrt(sum(w * w)) AS norm FROM w GROUP BY uri),
  q AS (SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest({WORDS.format('text')}) AS token FROM documents) GROUP BY 1, 2),
  qa AS (SELECT doc_id, token, qw, row_number() OVER (PARTITION BY doc_id ORDER BY qw DESC, token) AS k FROM (SELECT q.doc_id, q.token, round(sqrt(q.tf) * ln(nd / df.df), 9) AS qw FROM q JOIN df ON df.token = q.token, nd))"""
_ALIKE3 = """dots AS (SELECT q.doc_id, w.uri, sum(q.qw * w.w) AS dot FROM qt q JOIN w ON w.token = q.token WHERE w.w > 0 GROUP BY 1, 2), sc AS (SELECT doc_id, d.uri, round(dot / norm, 6) AS score FROM dots d JOIN nm ON nm.uri = d.uri),
  r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, uri) AS rank FROM sc) SELECT doc_id, rank, uri, score FROM r WHERE rank <= 3"""


@query(f"WITH {_TFIDF}, qt AS (SELECT * FROM qa WHERE k <= 25), {_ALIKE3}")
def f27_text_similarity(spark: SparkSession, d: str) -> DataFrame:
    """The three resources most like each document by its 25 weightiest words, as in a more-like-this query; by all words: f27_text_similarity_all."""
    got = linking.tfidf_similarity(table(spark, d, "documents").select("doc_id", "text"), contexts_of(spark, d), "doc_id", 3, linking.QUERY_TERMS)
    return got.select("doc_id", F.col("rank").cast("long").alias("rank"), "uri", "score")


@query(f"WITH {_TFIDF}, qt AS (SELECT * FROM qa), {_ALIKE3}")
def f27_text_similarity_all(spark: SparkSession, d: str) -> DataFrame:
    """The three resources whose contexts are most like each document, by all its words."""
    got = linking.tfidf_similarity(table(spark, d, "documents").select("doc_id", "text"), contexts_of(spark, d), "doc_id", 3)
    return got.select("doc_id", F.col("rank").cast("long").alias("rank"), "uri", "score")


@query(f"WITH {CAND}, a AS (SELECT uri, count(*) AS names, sum(n) AS total, avg(prior) AS mean FROM candidates GROUP BY uri) SELECT c.name, arg_max(c.uri, (a.total, c.uri)) AS common, arg_max(c.uri, (round(a.mean, 9), c.uri)) AS best FROM candidates c JOIN a ON a.uri = c.uri GROUP BY c.name")
def f31_ranking_strategies(spark: SparkSession, d: str) -> DataFrame:
    """The candidate that is most common over all names, and the one best on average."""
    cand = kb_model(spark, d).candidates
    over = cand.groupBy("uri").agg(F.sum("n").alias("total"), F.avg("prior").alias("mean"))
    met = cand.join(over, "uri")
    return met.groupBy("name").agg(F.max_by("uri", F.struct("total", "uri")).alias("common"), F.max_by("uri", F.struct(F.round("mean", 9), F.col("uri"))).alias("best"))


@query(f"WITH df AS (SELECT token, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({WORDS.format('text')}) AS token FROM documents) GROUP BY token), n AS (SELECT count(*) AS n FROM documents), q AS (SELECT DISTINCT occ_id, token FROM (SELECT occ_id, unnest({WORDS.format('context')}) AS token FROM occs)) SELECT occ_id, round(avg(ln(n / df)), 6) AS mean_idf FROM q JOIN df ON df.token = q.token, n GROUP BY occ_id")
def f32_average_idf(spark: SparkSession, d: str) -> DataFrame:
    """Mean ln(documents / document frequency) over the distinct words of each context."""
    docs = table(spark, d, "documents")
    df = docs.select(F.explode(F.array_distinct(T.lower_words(F.col("text")))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    n = docs.agg(F.count(F.lit(1))).scalar()
    words = table(spark, d, "occs").select("occ_id", F.explode(F.array_distinct(T.lower_words(F.col("context")))).alias("token"))
    return words.join(df, "token").groupBy("occ_id").agg(F.round(F.avg(F.log(n / F.col("df"))), 6).alias("mean_idf"))


@query(f"WITH df AS (SELECT token, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({WORDS.format('text')}) AS token FROM documents) GROUP BY token), n AS (SELECT count(*) AS n FROM documents), w AS (SELECT DISTINCT name, unnest({WORDS.format('name')}) AS token FROM surface_forms) SELECT name, max(ln(n / (1 + coalesce(df, 0)))) AS importance, min(coalesce(df, 0)) AS at_most FROM w LEFT JOIN df ON df.token = w.token, n GROUP BY name")
def f33_f34_name_importance(spark: SparkSession, d: str) -> DataFrame:
    """Importance of a name's rarest word, and the upper bound of its phrase frequency."""
    docs = table(spark, d, "documents")
    df = docs.select(F.explode(F.array_distinct(T.lower_words(F.col("text")))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    n = docs.agg(F.count(F.lit(1))).scalar()
    words = table(spark, d, "surface_forms").select("name", F.explode(F.array_distinct(T.lower_words(F.col("name")))).alias("token"))
    seen = F.coalesce(F.col("df"), F.lit(0))
    return words.join(df, "token", "left").groupBy("name").agg(F.max(F.log(n / (1 + seen))).alias("importance"), F.min(seen).alias("at_most"))


@query("SELECT occ_id, uri FROM occs WHERE uri IN (SELECT uri FROM dbpediaresource WHERE types LIKE '%Schema:Place%')")
def g05_type_filter(spark: SparkSession, d: str) -> DataFrame:
    res = model.resource_counts(table(spark, d, "dbpediaresource").withColumn("uri_count", F.lit(1).cast("long"))).select(F.col("uri").alias("u"), "types")
    rows = salted_join(table(spark, d, "occs").select("occ_id", "uri"), res, "uri", "u", spread=["occ_id"])
    return rows.transform(filters.types(["Schema:Place"])).select("occ_id", "uri")


@query("SELECT occ_id, uri FROM occs WHERE uri IS NOT NULL AND uri NOT IN (SELECT uri FROM dbpediaresource WHERE uri_count > 1000 AND uri IS NOT NULL)")
def g06_uri_blacklist(spark: SparkSession, d: str) -> DataFrame:
    often = table(spark, d, "dbpediaresource").filter(F.col("uri_count") > 1000)
    return table(spark, d, "occs").filter(F.col("uri").isNotNull()).select("occ_id", "uri").transform(filters.uris(often, blacklist=True))


@query("SELECT occ_id, uri FROM occs WHERE uri IN (SELECT uri FROM dbpediaresource)")
def g12_uri_whitelist(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "occs").select("occ_id", "uri").transform(filters.uris(table(spark, d, "dbpediaresource")))


@query("SELECT occ_id, surface_form FROM occs WHERE length(surface_form) <= 50 AND regexp_matches(surface_form, '\\p{L}') AND NOT regexp_matches(surface_form, '%[0-9A-Fa-f]{2}') AND len(list_filter(regexp_extract_all(lower(surface_form), '[\\p{L}\\p{N}]+'), lambda w: w NOT IN ('the', 'a', 'an', 'and', 'or', 'of', 'in', 'on', 'to', 'is', 'was', 'for', 'by', 'with', 'that', 'it', 'as', 'at'))) > 0")
def g19_good_forms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "occs").filter(F.col("surface_form").isNotNull()).transform(filters.good_form()).select("occ_id", "surface_form")


@query("SELECT occ_id, uri, n AS group_size FROM (SELECT occ_id, uri, count(*) OVER (PARTITION BY uri) AS n FROM occs WHERE uri IS NOT NULL) WHERE n > 1")
def g21_repeated_uris(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "occs").select("occ_id", "uri").transform(filters.in_large_groups("uri")).select("occ_id", "uri", "group_size")


@query("SELECT occ_id, uri, lower(surface_form) AS surface_form FROM occs WHERE uri NOT LIKE 'List\\_of\\_%' ESCAPE '\\' AND coalesce(id, '') NOT LIKE 'List\\_of\\_%' ESCAPE '\\'")
def g14_g16_no_lists_lowercase(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "occs").transform(filters.no_lists()).transform(filters.lowercase_forms()).select("occ_id", "uri", "surface_form")


@query("""WITH RECURSIVE e AS (SELECT s AS node, arg_max(o, line_no) AS parent FROM (SELECT line_no, regexp_replace(regexp_replace(subj, '^<|>$', '', 'g'), '^http://kb\\.example/resource/', '') AS s, regexp_replace(regexp_replace(obj, '^<|>$', '', 'g'), '^http://kb\\.example/resource/', '') AS o FROM redirects WHERE subj IS NOT NULL AND obj IS NOT NULL) GROUP BY s)
  SELECT o.occ_id, coalesce(e.parent, o.uri) AS uri FROM occs o LEFT JOIN e ON e.node = o.uri WHERE o.uri IS NOT NULL""")
def g13_one_redirect(spark: SparkSession, d: str) -> DataFrame:
    """Uris by their direct redirect."""
    from kedge.functions.scalars import strip_namespace

    rows = table(spark, d, "redirects").filter(F.col("subj").isNotNull() & F.col("obj").isNotNull())
    strip = lambda c: strip_namespace(F.regexp_replace(c, "^<|>$", ""))
    edges = rows.select(strip("subj").alias("node"), strip("obj").alias("parent"), "line_no").groupBy("node").agg(F.max_by("parent", "line_no").alias("root"))
    return table(spark, d, "occs").filter(F.col("uri").isNotNull()).select("occ_id", "uri").transform(filters.redirected(edges)).select("occ_id", "uri")


@query("""WITH r AS (SELECT occ_id, context, surface_form AS name, text_offset AS start, uri FROM occs WHERE surface_form IS NOT NULL AND context IS NOT NULL AND uri IS NOT NULL AND text_offset IS NOT NULL),
  long AS (SELECT context, w, start, uri FROM (SELECT context, start, uri, name, unnest(string_split(name, ' ')) AS w FROM r WHERE contains(name, ' ') AND len(list_filter(string_split(name, ' '), lambda x: NOT regexp_matches(x, '^\\p{Lu}'))) = 0)),
  f AS (SELECT context, w, min((start, uri)) AS f FROM long GROUP BY context, w)
  SELECT r.occ_id, CASE WHEN f.f IS NOT NULL AND r.start > f.f[1] THEN f.f[2] ELSE r.uri END AS uri FROM r LEFT JOIN f ON f.context = r.context AND f.w = r.name""")
def g07_coreference(spark: SparkSession, d: str) -> DataFrame:
    occs = table(spark, d, "occs").dropna(subset=["surface_form", "context", "uri", "text_offset"])
    rows = occs.select("occ_id", F.col("context").alias("par"), F.col("surface_form").alias("name"), F.col("text_offset").alias("start"), "uri")
    return filters.coreference(rows, "par").select("occ_id", "uri")


@query("SELECT occ_id, uri, rank() OVER (PARTITION BY uri ORDER BY text_offset DESC) AS by_offset, ntile(4) OVER (PARTITION BY uri ORDER BY occ_id) AS quarter FROM occs WHERE uri IS NOT NULL AND text_offset IS NOT NULL")
def j01_rank_windows(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("uri")
    rows = table(spark, d, "occs").filter(F.col("uri").isNotNull() & F.col("text_offset").isNotNull())
    return rows.select("occ_id", "uri", F.rank().over(w.orderBy(F.desc("text_offset"))).cast("long").alias("by_offset"), F.ntile(4).over(w.orderBy("occ_id")).cast("long").alias("quarter"))


@query(f"WITH {CAND} SELECT name, uri, round(prior / sum(prior) OVER (PARTITION BY name), 9) AS share, coalesce(lead(prior) OVER (PARTITION BY name ORDER BY prior DESC, uri) / prior, 0) AS next FROM candidates")
def j02_j03_lead_and_softmax(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("name")
    nxt = F.coalesce(F.lead("prior").over(w.orderBy(F.desc("prior"), "uri")) / F.col("prior"), F.lit(0.0))
    return kb_model(spark, d).candidates.select("name", "uri", F.round(F.col("prior") / F.sum("prior").over(w), 9).alias("share"), nxt.alias("next"))


@query("SELECT uri, count(*) AS n FROM occs WHERE uri IS NOT NULL GROUP BY uri ORDER BY n DESC, uri LIMIT 100")
def j07_top_resources(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "occs").filter(F.col("uri").isNotNull()).groupBy("uri").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "uri").limit(100)


@query("SELECT uri FROM occs WHERE uri IS NOT NULL INTERSECT SELECT uri FROM documents")
def j09_intersection(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "occs").select("uri").filter(F.col("uri").isNotNull()).intersect(table(spark, d, "documents").select("uri"))


@query("SELECT uri FROM dbpediaresource WHERE uri IS NOT NULL UNION SELECT uri FROM occs WHERE uri IS NOT NULL")
def j10_union(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "dbpediaresource").select("uri").union(table(spark, d, "occs").select("uri")).filter(F.col("uri").isNotNull()).distinct()


@query("SELECT uri FROM dbpediaresource WHERE uri IS NOT NULL EXCEPT SELECT uri FROM occs")
def j11_except(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "dbpediaresource").select("uri").filter(F.col("uri").isNotNull()).subtract(table(spark, d, "occs").select("uri"))


def h_pages(spark: SparkSession, d: str) -> DataFrame:
    """(name, doc_id): documents that hold all words of each form."""
    words = F.array_distinct(T.lower_words(F.col("name")))
    names = names_of(spark, d).withColumn("w", words).withColumn("k", F.size("w"))
    docs = table(spark, d, "documents").filter(F.col("text").isNotNull()).select(F.col("doc_id").alias("__d"), F.array_distinct(T.lower_words(F.col("text"))).alias("__w"))
    return linking.with_all_terms(names, docs).select("name", F.col("__d").alias("doc_id"))
