"""Queries of spot classes, context windows, score variants, topic learning, streams of models and evaluation, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kedge import api
from kedge.functions import text as T
from kedge.operators import evaluation, filters, linking, model, spotclass, spotting, topics
from kedge.plans.analytics import _NB, LINKS, PAGE, _pages, _topic_rows, corpus_model, l03_topic_prediction, l13_topic_inference, links_of
from kedge.plans.analytics import SQL as TOPIC_SQL
from kedge.plans.kb import CAND, CTX, PAIRS, TOTALS, WORDS, kb_model
from kedge.plans.linking import _NORM, _RUNS, FOLD, MENTIONS, h_pages, mentions
from kedge.plans.linking import SQL as LINK_SQL
from kedge.plans.records import TYPE_ROWS, type_rows
from kedge.session import cut, table
from kedge.sources import sinks
from kedge.streaming import feeds

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def wrap(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return wrap


# --- spots


@query(f"""WITH {_RUNS}, rn AS (SELECT doc_id, first, array_to_string(w, ' ') AS name FROM runs), names AS (SELECT DISTINCT name FROM rn WHERE name NOT IN (SELECT name FROM surface_forms WHERE name IS NOT NULL AND annotated_count >= 0)), {_NORM},
  e AS (SELECT name, CASE WHEN total = -1 THEN 1.0 WHEN total = 0 THEN 0.0 ELSE annotated / total END AS p FROM forms)
  SELECT rn.doc_id, rn.first, rn.name, coalesce(e.p, r.score, 0) AS p FROM rn LEFT JOIN e ON e.name = rn.name LEFT JOIN (SELECT * FROM ranked WHERE rank = 1) r ON r.name = rn.name""")
def d07_fallback_probabilities(spark: SparkSession, d: str) -> DataFrame:
    """Capital runs with the probability of their own form, else of the likeliest normalised one."""
    tokens = T.token_rows(table(spark, d, "documents"), "doc_id", "text")
    runs = T.capital_runs(tokens, "doc_id", tokens).select("doc_id", F.col("first").cast("long").alias("first"), F.col("run").alias("name"))
    m = kb_model(spark, d)
    return spotting.known_probability(runs, m.forms, m.lower).select("doc_id", "first", "name", "p")


_KEYS = """f AS (SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS token FROM documents) GROUP BY 1, 2), nd AS (SELECT count(DISTINCT doc_id) AS nd FROM f), fd AS (SELECT token, count(*) AS df FROM f GROUP BY token),
  w0 AS (SELECT f.doc_id, f.token, ln(1 + tf) * ln(nd / df) AS w FROM f JOIN fd ON fd.token = f.token, nd), nm AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM w0 GROUP BY doc_id), w AS (SELECT w0.doc_id, token, round(w / norm, 8) AS w FROM w0 JOIN nm ON nm.doc_id = w0.doc_id WHERE norm > 0)"""


@query(f"WITH {_KEYS} SELECT doc_id, token, w FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY w DESC, token) AS r FROM w) WHERE r <= 100 AND w >= 0.075")
def d20_key_phrases(spark: SparkSession, d: str) -> DataFrame:
    """The hundred weightiest words of each document that weigh enough."""
    rows = topics.weighted(topics.features(table(spark, d, "documents"), "doc_id", "text"), "doc_id").withColumn("w", F.round("w", 8))
    return topics.first_of_each(rows, "doc_id", [F.desc("w"), F.col("token")], 100, spread="token").filter(F.col("w") >= 0.075).select("doc_id", "token", "w")


def _listed(words) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


_SC = spotclass
_LEX = f"""m AS (SELECT occ_id, uri, surface_form AS name, substr(context, 1, text_offset) AS b, substr(context, text_offset + length(surface_form) + 1) AS a FROM occs WHERE text_offset >= 0 AND substr(context, text_offset + 1, length(surface_form)) = surface_form),
  nb AS (SELECT occ_id, uri, name, nullif(regexp_extract(b, '([\\p{{L}}\\p{{N}}]+|[^\\s\\p{{L}}\\p{{N}}])\\s*$', 1), '') AS l, nullif(regexp_extract(a, '^\\s*([\\p{{L}}\\p{{N}}]+|[^\\s\\p{{L}}\\p{{N}}])', 1), '') AS r, trim(b, ' ') = '' OR regexp_matches(b, '[.!?]\\s*$') AS initial FROM m),
  c AS (SELECT *, CASE WHEN upper(name) = name THEN 2 WHEN NOT initial AND regexp_matches(name, '^\\p{{Lu}}') THEN 1 WHEN initial AND regexp_matches(name, '^\\p{{Lu}}') THEN 3 ELSE 0 END AS case_class FROM nb),
  lex AS (SELECT occ_id, uri, name, l, r, case_class, CAST(coalesce(l IN {_listed(_SC.QUOTES)} AND r IN {_listed(_SC.QUOTES)}, FALSE) AS INTEGER) AS quoted, CAST(coalesce(r = 'of', FALSE) AS INTEGER) AS before_of, CAST(coalesce(l = 'of', FALSE) AS INTEGER) AS after_of,
    CAST(coalesce(r IN {_listed(_SC.PREPOSITIONS)}, FALSE) AS INTEGER) AS before_preposition, CASE WHEN case_class = 0 THEN 0 ELSE CAST(coalesce(regexp_matches(r, '^\\p{{Lu}}'), FALSE) OR coalesce(regexp_matches(l, '^\\p{{Lu}}'), FALSE) AS INTEGER) END AS near_upper,
    CAST(coalesce(r IN {_listed(_SC.AUXILIARIES)}, FALSE) AS INTEGER) AS before_verb, CAST(coalesce(lower(l) IN {_listed(_SC.POSSESSIVES)}, FALSE) AS INTEGER) AS after_possessive, CAST(coalesce(l = ',' AND r IN {_listed((",", *_SC.CONJUNCTIONS))}, FALSE) AS INTEGER) AS in_enumeration,
    CAST(regexp_matches(name, 's$') AS INTEGER) AS plural, CAST(coalesce(r IN ('''', '’'), FALSE) AS INTEGER) AS possessive,
    CASE WHEN lower(l) IN {_listed(_SC.POSSESSIVES)} AND r IN {_listed(_SC.PREPOSITIONS)} THEN 0 WHEN l = 'of' THEN 2 WHEN l IN {_listed(_SC.PREPOSITIONS)} THEN 1 WHEN lower(l) IN ('a', 'an') THEN 3 WHEN lower(l) = 'the' THEN 4 END AS pre_pos,
    CASE WHEN r IN {_listed(_SC.AUXILIARIES)} THEN 0 WHEN r = 'of' THEN 1 END AS next_pos FROM c)"""
_COLUMNS = ", ".join(spotclass.FEATURES)


def _placed(spark: SparkSession, d: str) -> DataFrame:
    occs = table(spark, d, "occs")
    stands = (F.col("text_offset") >= 0) & (F.substr(F.col("context"), F.col("text_offset") + 1, F.char_length("surface_form")) == F.col("surface_form"))
    rows = spotclass.neighbours(occs.filter(stands), "context", "text_offset", "surface_form")
    return spotclass.lexical_features(rows.withColumn("name", F.col("surface_form")))


@query(f"WITH {_LEX} SELECT occ_id, {_COLUMNS}, pre_pos, next_pos FROM lex")
def d34_lexical_features(spark: SparkSession, d: str) -> DataFrame:
    """Case, quotes, neighbours, enumeration, number and possession of every mention."""
    return _placed(spark, d).select("occ_id", *spotclass.FEATURES, "pre_pos", "next_pos")


_GRAMS = f"gw AS (SELECT {WORDS.format('text')} AS w FROM documents), grams AS (SELECT gram, count(*) AS n FROM (SELECT unnest(w) AS gram FROM gw UNION ALL SELECT w[i] || ' ' || w[i + 1] FROM (SELECT w, unnest(generate_series(1, len(w) - 1)) AS i FROM gw)) GROUP BY gram HAVING count(*) >= 2)"


@query(f"""WITH {_LEX}, {_GRAMS}, k AS (SELECT occ_id, l, r, {WORDS.format('name')} AS w FROM lex)
  SELECT k.occ_id, u.n AS uses, CASE WHEN k.l IS NOT NULL THEN a.n END AS left_pair, CASE WHEN k.r IS NOT NULL THEN b.n END AS right_pair FROM k
  LEFT JOIN grams u ON u.gram = CASE WHEN len(k.w) = 1 THEN k.w[1] END LEFT JOIN grams a ON a.gram = concat_ws(' ', lower(k.l), k.w[1]) LEFT JOIN grams b ON b.gram = concat_ws(' ', k.w[len(k.w)], lower(k.r))""")
def d35_neighbourhood_counts(spark: SparkSession, d: str) -> DataFrame:
    """Corpus counts of a mention's word and of the pairs with its neighbours, missing below two."""
    got = spotclass.neighbourhood_counts(_placed(spark, d), table(spark, d, "documents"), "occ_id")
    return got.select("occ_id", "uses", "left_pair", "right_pair")


# Parameters of the example: weights of the two linear models.
ONE, ONE_BIAS = {"case_class": 0.8, "before_of": -0.4, "before_verb": 0.5, "plural": -0.6, "near_upper": -0.3}, -0.5
MORE, MORE_BIAS = {"case_class": 0.9, "after_of": -0.3, "in_enumeration": 0.4, "quoted": 0.5}, -0.2


def _sigmoid(weights: dict[str, float], bias: float) -> str:
    return f"(1 / (1 + exp(-({bias} + " + " + ".join(f"({w}) * {k}" for k, w in weights.items()) + "))))"


_PICK = f"pick AS (SELECT occ_id, uri, name, trim(name, ' ') <> '' AND CASE WHEN len(regexp_extract_all(name, '[\\p{{L}}\\p{{N}}]+')) <= 1 THEN NOT regexp_full_match(name, '{spotclass.CALENDAR}') AND {_sigmoid(ONE, ONE_BIAS)} >= 0.5 ELSE {_sigmoid(MORE, MORE_BIAS)} >= 0.5 END AS kept FROM lex)"


@query(f"WITH {_LEX}, {_PICK} SELECT occ_id, name FROM pick WHERE kept")
def d29_selected_spots(spark: SparkSession, d: str) -> DataFrame:
    """Mentions that pattern filter and the two classifiers, for one word and for several, leave."""
    return spotclass.selected(_placed(spark, d), spotclass.linear(ONE, ONE_BIAS), spotclass.linear(MORE, MORE_BIAS)).select("occ_id", "name")


@query(f"WITH {_LEX}, s AS (SELECT occ_id, {_sigmoid(ONE, ONE_BIAS)} AS c FROM lex) SELECT occ_id, round(c, 9) AS confidence, CASE WHEN c >= 0.5 THEN 'valid' ELSE 'common' END AS spot_class FROM s")
def d36_spot_classes(spark: SparkSession, d: str) -> DataFrame:
    return spotclass.classified(_placed(spark, d), spotclass.linear(ONE, ONE_BIAS)).select("occ_id", F.round("confidence", 9).alias("confidence"), "spot_class")


@query(f"WITH {_LEX} SELECT occ_id, {_COLUMNS}, CAST(uri IS NOT NULL AS INTEGER) AS valid FROM lex")
def d37_spot_training_rows(spark: SparkSession, d: str) -> DataFrame:
    """Features with the class that the annotation gives: a mention without resource is common."""
    return _placed(spark, d).select("occ_id", *spotclass.FEATURES, F.col("uri").isNotNull().cast("int").alias("valid"))


@query(None)
def d38_tuned_weights(spark: SparkSession, d: str) -> DataFrame:
    """Weights of the spot score by least squares: a dictionary match is right if it is the mention of its context."""
    occs = table(spark, d, "occs").filter(F.col("context").isNotNull())
    names = spotting.dictionary(corpus_model(spark, d).forms)
    met = spotting.dictionary_matches(occs.select("occ_id", "context"), names, "occ_id", "context").join(occs.select("occ_id", "text_offset", "surface_form"), "occ_id")
    right = F.coalesce((F.col("start") == F.col("text_offset")) & (F.col("name") == F.col("surface_form")), F.lit(False))
    weights = spotclass.tuned_weights(met.withColumn("gold", right), "gold")
    return spark.createDataFrame([(n, float(w)) for n, w in zip(("probability", "abbreviation", "number", "bias"), weights, strict=True)], "feature string, weight double")


# --- windows and whole requests

_WIN = """sn AS MATERIALIZED (SELECT doc_id, i, s[i] AS t, len(regexp_extract_all(s[i], '[\\p{L}\\p{N}]+')) AS n FROM (SELECT doc_id, s, unnest(generate_series(1, len(s))) AS i FROM (SELECT doc_id, list_filter(regexp_extract_all(text, '(?s).*?(?:[.!?]+\\s+|\\z)'), lambda x: x <> '') AS s FROM documents WHERE len(regexp_extract_all(text, '[.!?]+\\s+')) >= 200))),
wf AS (SELECT doc_id, i, 0 AS win, n AS acc FROM sn WHERE i = 1 UNION ALL SELECT sn.doc_id, sn.i, CASE WHEN wf.acc >= 200 THEN wf.win + 1 ELSE wf.win END, CASE WHEN wf.acc >= 200 THEN sn.n ELSE wf.acc + sn.n END FROM wf JOIN sn ON sn.doc_id = wf.doc_id AND sn.i = wf.i + 1),
wl AS (SELECT wf.doc_id, wf.win, string_agg(sn.t, '' ORDER BY sn.i) AS text, sum(length(sn.t)) AS size FROM wf JOIN sn ON sn.doc_id = wf.doc_id AND sn.i = wf.i GROUP BY 1, 2),
win AS (SELECT doc_id, win, CAST(sum(size) OVER (PARTITION BY doc_id ORDER BY win) - size AS BIGINT) AS start, text FROM wl UNION ALL SELECT doc_id, 0, 0, text FROM documents WHERE text IS NOT NULL AND len(regexp_extract_all(text, '[.!?]+\\s+')) < 200)"""


@query(f"WITH RECURSIVE {_WIN} SELECT doc_id, CAST(win AS INTEGER) AS win, CAST(start AS INTEGER) AS start, text FROM win")
def f07_context_windows(spark: SparkSession, d: str) -> DataFrame:
    """Texts of more than 200 sentences in windows of whole sentences."""
    return T.context_windows(table(spark, d, "documents"), "doc_id", "text").select("doc_id", F.col("window").alias("win"), "start", "text")


def _scored(k: int) -> str:
    """Scores in SQL of spots sp(u, start, name) against the words q(u, token): fn(u, start, name, uri, support, score, final_score, second_rank, rank)."""
    return f"""tok AS (SELECT token, sum(n) AS tn FROM ctx GROUP BY token), ct AS (SELECT uri, sum(n) AS total FROM ctx GROUP BY uri),
  bst AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY prior DESC, uri) AS r FROM candidates) WHERE r <= {k}), sx AS (SELECT sp.u, sp.start, sp.name, b.uri, b.support, b.prior FROM sp JOIN bst b ON b.name = sp.name),
  gn AS (SELECT s.u, s.uri, sum(ln(0.8 * (tn + 1) / (n_tokens + vocabulary) + 0.2 * c.n / total) - ln(0.8 * (tn + 1) / (n_tokens + vocabulary))) AS gain FROM (SELECT DISTINCT u, uri FROM sx) s JOIN ctx c ON c.uri = s.uri JOIN q ON q.u = s.u AND q.token = c.token JOIN ct ON ct.uri = s.uri JOIN tok ON tok.token = c.token, totals GROUP BY s.u, s.uri),
  sc AS (SELECT s.*, ln(s.prior) + coalesce(g.gain, 0) + ln(s.support / t.support) AS score, -ln(t.annotated) AS nil FROM sx s LEFT JOIN gn g ON g.u = s.u AND g.uri = s.uri, totals t),
  kp AS (SELECT *, greatest(max(score) OVER (PARTITION BY u, start), nil) AS top FROM sc WHERE score > nil),
  fn AS (SELECT u, start, name, uri, support, score, exp(score - top) / (sum(exp(score - top)) OVER (PARTITION BY u, start) + exp(nil - top)) AS final_score, coalesce(exp(lead(score) OVER w - score), 0) AS second_rank, row_number() OVER w AS rank FROM kp WINDOW w AS (PARTITION BY u, start ORDER BY score DESC, uri))"""


_REST = CAND[len(PAIRS) + 2 :]
_DOCS = f"""{FOLD}, {_REST}, {CTX}, {TOTALS}, {_WIN},
sp AS (SELECT k.doc_id || '-' || coalesce(w.win, 0) AS u, k.doc_id, k.start, k.name FROM kept k LEFT JOIN (SELECT k.doc_id, k.start, max(win.win) AS win FROM kept k JOIN win ON win.doc_id = k.doc_id AND win.start <= k.start GROUP BY 1, 2) w ON w.doc_id = k.doc_id AND w.start = k.start),
q AS (SELECT DISTINCT u, token FROM (SELECT doc_id || '-' || win AS u, unnest({WORDS.format('text')}) AS token FROM win))"""


@query(f"{_DOCS}, {_scored(10)} SELECT CAST(split_part(u, '-', 1) AS BIGINT) AS doc_id, CAST(start AS INTEGER) AS start, name, uri, support, round(final_score, 6) AS final_score, round(second_rank, 6) AS second_rank FROM fn WHERE rank = 1 AND support > 0 AND final_score >= 0.5 AND second_rank <= 0.75")
def n15_annotate(spark: SparkSession, d: str) -> DataFrame:
    """All documents: spots, candidates, scores, filters."""
    got = api.annotate(table(spark, d, "documents").select("doc_id", "text"), corpus_model(spark, d))
    return got.select("doc_id", "start", "name", "uri", "support", F.round("final_score", 6).alias("final_score"), F.round("second_rank", 6).alias("second_rank"))


@query(f"{_DOCS}, {_scored(100)} SELECT CAST(split_part(u, '-', 1) AS BIGINT) AS doc_id, CAST(start AS INTEGER) AS start, name, uri, rank, round(score, 6) AS score FROM fn")
def n16_candidates(spark: SparkSession, d: str) -> DataFrame:
    got = api.candidates(table(spark, d, "documents").select("doc_id", "text"), corpus_model(spark, d))
    return got.select("doc_id", "start", "name", "uri", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query(f"""WITH {CAND}, {CTX}, {TOTALS}, bm AS (SELECT occ_id, regexp_replace(context, '\\[\\[[^\\[\\]|]*\\|([^\\[\\]|]*)(?:\\|[^\\[\\]]*)?\\]\\]', '[[\\1]]', 'g') AS shown FROM occs WHERE contains(context, '[[')),
  bx AS (SELECT occ_id, i, w[i] AS name, length(g[i]) AS gap, length(w[i]) AS size FROM (SELECT *, unnest(generate_series(1, len(w))) AS i FROM (SELECT occ_id, regexp_extract_all(shown, '\\[\\[([^\\[\\]]*)\\]\\]', 1) AS w, string_split_regex(shown, '\\[\\[[^\\[\\]]*\\]\\]') AS g FROM bm))),
  sp AS (SELECT occ_id AS u, CAST(sum(gap + size) OVER (PARTITION BY occ_id ORDER BY i) - size AS BIGINT) AS start, name FROM bx),
  q AS (SELECT DISTINCT u, token FROM (SELECT occ_id AS u, unnest(regexp_extract_all(lower(regexp_replace(shown, '\\[\\[([^\\[\\]]*)\\]\\]', '\\1', 'g')), '[\\p{{L}}\\p{{N}}]+')) AS token FROM bm)),
  {_scored(10)} SELECT u AS occ_id, CAST(start AS INTEGER) AS start, name, uri FROM fn WHERE rank = 1 AND support > 0""")
def n18_disambiguate(spark: SparkSession, d: str) -> DataFrame:
    """Links of the names that contexts mark with double brackets."""
    docs = table(spark, d, "occs").filter(F.contains("context", F.lit("[["))).select("occ_id", F.col("context").alias("text"))
    return api.disambiguate(docs, corpus_model(spark, d), key="occ_id", confidence=0.0).select("occ_id", "start", "name", "uri")


@query(f"""{FOLD}, {_REST}, px AS (SELECT k.doc_id, k.start, k.name, c.uri, c.support, c.prior / sum(c.prior) OVER w AS final_score, coalesce(lead(c.prior) OVER v / c.prior, 0) AS second_rank, row_number() OVER v AS rank FROM kept k JOIN candidates c ON c.name = k.name WINDOW w AS (PARTITION BY k.doc_id, k.start), v AS (PARTITION BY k.doc_id, k.start ORDER BY c.prior DESC, c.uri))
  SELECT doc_id, '[' || string_agg('{{"offset":' || start || ',"surfaceForm":' || CAST(to_json(name) AS VARCHAR) || ',"URI":' || CAST(to_json(uri) AS VARCHAR) || ',"support":' || support || ',"similarityScore":"' || printf('%.6f', round(final_score, 6)) || '"}}', ',' ORDER BY start) || ']' AS json FROM px WHERE rank = 1 AND support > 0 AND final_score >= 0.5 AND second_rank <= 0.75 GROUP BY doc_id""")
def n14_request_by_prior(spark: SparkSession, d: str) -> DataFrame:
    """A request that names its policies: default spotter, links by prior alone, the answer as JSON."""
    return api.request(table(spark, d, "documents").select("doc_id", "text"), corpus_model(spark, d), "Default", "Prior", "json")


# --- score variants of the linked mentions

_F13 = LINK_SQL["f13_linked_mentions"].rsplit("SELECT occ_id, uri, support, round", 1)[0]


def _linked(spark: SparkSession, d: str) -> DataFrame:
    return api.link_mentions(mentions(spark, d), kb_model(spark, d, cut), "occ_id")


@query(f"""WITH {CAND}, {MENTIONS}, tt AS (SELECT sum(support) AS s FROM res), best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY prior DESC, uri) AS r FROM candidates) WHERE r <= 10),
  s AS (SELECT m.occ_id, b.uri, ln(b.prior) + ln(b.support / tt.s) AS score FROM m JOIN best b ON b.name = m.name, tt), x AS (SELECT *, max(score) OVER (PARTITION BY occ_id) AS top FROM s),
  f AS (SELECT occ_id, uri, exp(score - top) / sum(exp(score - top)) OVER (PARTITION BY occ_id) AS final_score, row_number() OVER (PARTITION BY occ_id ORDER BY score DESC, uri) AS rank FROM x) SELECT occ_id, uri, round(final_score, 6) AS final_score, rank FROM f""")
def f05_links_without_context(spark: SparkSession, d: str) -> DataFrame:
    """All candidates of every mention where the context says nothing."""
    m = kb_model(spark, d)
    cands = linking.top_candidates(mentions(spark, d), m.candidates, ["occ_id"])
    got = linking.linked(cands, None, model.totals(m.tokens, m.resources, m.pairs), ["occ_id"], "occ_id")
    return got.select("occ_id", "uri", F.round("final_score", 6).alias("final_score"), F.col("rank").cast("long").alias("rank"))


@query(f"""{_F13}, cm AS (SELECT *, greatest(max(context_gain) OVER (PARTITION BY occ_id), 0) AS m FROM kept) SELECT occ_id, uri, round(exp(context_gain - m) / (sum(exp(context_gain - m)) OVER (PARTITION BY occ_id) + exp(-m)), 6) AS context_share FROM cm""")
def f12_context_shares(spark: SparkSession, d: str) -> DataFrame:
    """Softmax of the context alone, no resource included."""
    return _linked(spark, d).select("occ_id", "uri", F.round("context_share", 6).alias("context_share"))


@query(f"""{_F13}, mx AS (SELECT occ_id, uri, round(0.7 * context_gain + 0.3 * prior, 6) AS mixed FROM kept) SELECT occ_id, uri, mixed, row_number() OVER w AS rank, round(coalesce(lead(mixed) OVER w / mixed, -1), 6) AS next FROM mx WINDOW w AS (PARTITION BY occ_id ORDER BY mixed DESC, uri)""")
def f20_reranked(spark: SparkSession, d: str) -> DataFrame:
    """Candidates ranked anew by seven parts context and three parts prior."""
    got = linking.reranked(_linked(spark, d), ["occ_id"], F.round(0.7 * F.col("context_gain") + 0.3 * F.col("prior"), 6))
    return got.select("occ_id", "uri", "mixed", F.col("rank").cast("long").alias("rank"), F.round("next", 6).alias("next"))


@query(f"""{_F13} SELECT f.occ_id, f.uri FROM fin f JOIN kept k ON k.occ_id = f.occ_id AND k.uri = f.uri WHERE f.rank = 1 AND round(k.context_gain, 6) >= 1""")
def g03_contextual_links(spark: SparkSession, d: str) -> DataFrame:
    rows = _linked(spark, d).filter(F.col("rank") == 1).withColumn("context_gain", F.round("context_gain", 6))
    return rows.transform(filters.contextual(1.0)).select("occ_id", "uri")


@query(f"{LINKS} SELECT occ_id, uri FROM li WHERE support >= 20 AND final_score >= 0.5 AND second_rank <= 0.75")
def g11_all_in_one(spark: SparkSession, d: str) -> DataFrame:
    """The older single filter with its support of at least the bound."""
    rows = links_of(spark, d).withColumn("final_score", F.round("final_score", 6)).withColumn("second_rank", F.round("second_rank", 6))
    return rows.transform(filters.all_in_one(0.5, 20, key="occ_id")).select("occ_id", "uri")


_HOLD = f"hw AS (SELECT doc_id, list_distinct({WORDS.format('text')}) AS w FROM documents)"


@query(f"WITH {_HOLD}, nw AS (SELECT DISTINCT surface_form AS name, list_distinct({WORDS.format('surface_form')}) AS w FROM occs WHERE surface_form IS NOT NULL) SELECT nw.name, hw.doc_id FROM nw JOIN hw ON len(nw.w) > 0 AND list_has_all(hw.w, nw.w)")
def f26_texts_with_all_words(spark: SparkSession, d: str) -> DataFrame:
    """Every form with the documents that hold all its words."""
    return h_pages(spark, d)


@query(f"WITH {_HOLD}, nw AS (SELECT DISTINCT surface_form AS name, list_distinct({WORDS.format('surface_form')}) AS w FROM occs WHERE surface_form IS NOT NULL) SELECT nw.name, count(*) AS texts FROM nw JOIN hw ON len(nw.w) > 0 AND list_has_all(hw.w, nw.w) GROUP BY nw.name")
def f23_term_set_sizes(spark: SparkSession, d: str) -> DataFrame:
    """How many documents hold all words of each form."""
    return h_pages(spark, d).groupBy("name").agg(F.count(F.lit(1)).alias("texts"))


@query(f"WITH {CAND}, {_HOLD}, cn AS (SELECT name, count(*) AS c, list_distinct({WORDS.format('name')}) AS w FROM candidates GROUP BY name) SELECT cn.name, round(cn.c / count(*), 4) AS belief FROM cn JOIN hw ON len(cn.w) > 0 AND list_has_all(hw.w, cn.w) GROUP BY cn.name, cn.c")
def f22_spot_beliefs(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of a name over the documents that hold it."""
    return linking.spot_belief(kb_model(spark, d).candidates, table(spark, d, "documents").select("text"))


@query(f"WITH {CAND}, {MENTIONS} SELECT m.occ_id, c.uri, coalesce(CAST(length(x.uri) AS DOUBLE), 0) AS score FROM m JOIN candidates c ON c.name = m.name LEFT JOIN (SELECT uri FROM res WHERE support > 100) x ON x.uri = c.uri")
def f29_custom_scores(spark: SparkSession, d: str) -> DataFrame:
    """Candidates with scores that the caller gives by resource (here: lengths of well-known uris), 0 without one."""
    m = kb_model(spark, d)
    given = m.resources.filter(F.col("support") > 100).select("uri", F.char_length("uri").cast("double").alias("score"))
    return linking.custom_scores(mentions(spark, d).select("occ_id", "name").join(m.candidates.select("name", "uri"), "name"), given).select("occ_id", "uri", "score")


@query(None)
def f29_random_scores(spark: SparkSession, d: str) -> DataFrame:
    return linking.random_scores(kb_model(spark, d).candidates).select("name", "uri", "score")


@query(f"""{LINKS}, v AS (SELECT regexp_extract(o.id, '^(.*)-p[0-9]+l[0-9]+$', 1) AS page, l.uri, l.final_score, l.support, l.second_rank FROM li l JOIN occs o ON o.occ_id = l.occ_id WHERE o.id IS NOT NULL),
  xx AS (SELECT page, uri, unnest(['similarity', 'support', 'confusion']) AS feature, unnest([final_score, CAST(support AS DOUBLE), 1 - second_rank]) AS v FROM v), s AS (SELECT feature, page, uri, round(sum(v), 4) AS value FROM xx GROUP BY 1, 2, 3)
  SELECT feature, page, uri, value, row_number() OVER (PARTITION BY feature, page ORDER BY value DESC, uri) AS rank FROM s""")
def h27_tags_by_feature(spark: SparkSession, d: str) -> DataFrame:
    """Tags of each page by three features of its links."""
    got = links_of(spark, d).select("occ_id", "uri", F.round("final_score", 6).alias("similarity"), F.col("support").cast("double").alias("support"), (1 - F.round("second_rank", 6)).alias("confusion"))
    ids = table(spark, d, "occs").filter(F.col("id").isNotNull()).select("occ_id", F.regexp_extract("id", "^(.*)-p[0-9]+l[0-9]+$", 1).alias("page"))
    return topics.tags_by(got.join(ids, "occ_id"), "page", ("similarity", "support", "confusion"))


@query(f"""WITH p AS (SELECT DISTINCT page, uri FROM ({PAGE})), c AS (SELECT a.uri, b.uri AS other, count(*) AS n FROM p a JOIN p b ON b.page = a.page AND b.uri <> a.uri GROUP BY 1, 2), r AS (SELECT uri, other, n FROM (SELECT *, row_number() OVER (PARTITION BY uri ORDER BY n DESC, other) AS k FROM c) WHERE k <= 5),
  s AS (SELECT p.page, r.other, sum(r.n) AS value FROM p JOIN r ON r.uri = p.uri GROUP BY 1, 2) SELECT page, other, value, rank FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY value DESC, other) AS rank FROM s) WHERE rank <= 5""")
def h29_related_to_sets(spark: SparkSession, d: str) -> DataFrame:
    """The resources most related to the set that each page names."""
    pages = _pages(spark, d)
    return topics.related_to_sets(pages, topics.related(pages, "page", 5), "page", 5)


# --- topics


@query(TOPIC_SQL["l13_topic_inference"])
def k07_topics_of_stream(spark: SparkSession, d: str) -> DataFrame:
    """Topics of the pages of a stream of links."""
    docs = table(spark, d, "documents").filter(F.col("uri").isNotNull() & F.col("source").isNotNull())
    priors = docs.groupBy("uri", F.col("source").alias("topic")).agg(F.count(F.lit(1)).alias("n"))
    stream = feeds.replay(spark, f"{d}/occs.parquet", 1_000_000).filter(F.col("uri").isNotNull() & F.col("id").isNotNull()).select(F.regexp_extract("id", "^(.*)-p[0-9]+l[0-9]+$", 1).alias("page"), "uri")
    return feeds.inferred_topics(stream, "page", lambda df: topics.infer(df, priors, "page")).select("page", "topic", F.round("p", 8).alias("p"))


@query("SELECT lower(substr(lang, 1, 2)) AS topic, token, CAST(count(*) AS DOUBLE) AS mass FROM (SELECT lang, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS token FROM documents WHERE lang IS NOT NULL) GROUP BY 1, 2")
def k08_model_of_stream(spark: SparkSession, d: str) -> DataFrame:
    """Evidence of topics learnt from a stream of documents."""
    stream = feeds.replay(spark, f"{d}/documents.parquet").filter(F.col("lang").isNotNull()).select("doc_id", F.lower(F.substring("lang", 1, 2)).alias("topic"), "text")
    learn = lambda df: topics.train(topics.features(df, "doc_id", "text", ("topic",)).withColumn("w", F.col("tf").cast("double")))
    merge = lambda df: df.groupBy("topic", "token").agg(F.sum("mass").alias("mass"))
    return feeds.updated_model(stream, learn, merge)


@query(f"""WITH x AS ({TOPIC_SQL['l03_topic_prediction']}), b AS (SELECT doc_id, arg_max(topic, (p, topic)) AS best, max(p) AS p FROM x GROUP BY doc_id), g AS (SELECT b.*, b.best = lower(substr(d.lang, 1, 2)) AS r FROM b JOIN documents d ON d.doc_id = b.doc_id)
  SELECT CAST(c AS DOUBLE) AS cutoff, count(*) AS decided, count(*) FILTER (WHERE r) AS right_ones FROM g JOIN (SELECT unnest([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS c) ON p >= c GROUP BY c""")
def l05_accuracy_by_cutoff(spark: SparkSession, d: str) -> DataFrame:
    gold = table(spark, d, "documents").filter(F.col("lang").isNotNull()).select("doc_id", F.lower(F.substring("lang", 1, 2)).alias("topic"))
    return topics.accuracy_by_cutoff(l03_topic_prediction(spark, d), gold, "doc_id").select("cutoff", "decided", F.col("right").alias("right_ones"))


@query(f"""WITH {_NB}, al AS (SELECT token, sum(mass) AS a FROM ev GROUP BY token), tot AS (SELECT sum(mass) AS s FROM ev),
  gr AS (SELECT al.token, tt.topic, ln((coalesce(ev.mass, 0) + 1) / (tt.total + v.v)) - ln((al.a - coalesce(ev.mass, 0) + 1) / (tot.s - tt.total + v.v)) AS g FROM al CROSS JOIN tt LEFT JOIN ev ON ev.token = al.token AND ev.topic = tt.topic, v, tot),
  sm AS (SELECT w.doc_id, gr.topic, sum(w.w * gr.g) AS s FROM w JOIN gr ON gr.token = w.token GROUP BY 1, 2) SELECT doc_id, topic, round(1 / (1 + exp(-s)), 6) AS p FROM sm""")
def l06_topics_one_by_one(spark: SparkSession, d: str) -> DataFrame:
    """Each topic by itself against the rest."""
    rows = _topic_rows(spark, d)
    return topics.predict_each(rows.select("doc_id", "token", "w"), topics.train(rows), "doc_id").select("doc_id", "topic", F.round("p", 6).alias("p"))


@query(None)
def l11_self_trained(spark: SparkSession, d: str) -> DataFrame:
    """Evidence from documents whose language is written in its short form, spread to the others."""
    docs = table(spark, d, "documents")
    rows = cut(topics.weighted(topics.features(docs.withColumn("topic", F.col("lang")), "doc_id", "text", ("topic",)), "doc_id", ("topic",)))
    short = F.coalesce(F.col("topic").rlike("^[a-z]{2}$"), F.lit(False))
    got = topics.self_trained(rows.filter(short), rows.filter(~short).select("doc_id", "token", "w"), "doc_id", 0.4)
    return got.select("topic", "token", F.round("mass", 6).alias("mass"))


#: Categories of topics for the first split.
CATEGORIES = {"places": ["Schema:Place", "DBpedia:Place"], "people": ["Schema:Person", "DBpedia:Person"], "works": ["Schema:CreativeWork", "DBpedia:Work"]}
_CATS = " UNION ALL ".join(f"SELECT '{t}' AS topic, '{c}' AS category" for t, cs in CATEGORIES.items() for c in cs)


@query(f"WITH {TYPE_ROWS}, cats AS ({_CATS}), rt AS (SELECT DISTINCT t.uri, c.topic FROM type_rows t JOIN cats c ON c.category = t.type) SELECT o.occ_id, rt.topic FROM occs o JOIN rt ON rt.uri = o.uri")
def l12_initial_split(spark: SparkSession, d: str) -> DataFrame:
    """Occurrences by the topics to which the categories of their resource belong."""
    cats = type_rows(spark, d).withColumnRenamed("type", "category")
    return topics.initial_split(table(spark, d, "occs").select("occ_id", "uri"), cats, CATEGORIES).select("occ_id", "topic")


@query(f"""WITH a AS ({TOPIC_SQL['l13_topic_inference']}), pg AS ({PAGE}), mc AS (SELECT page, uri FROM (SELECT page, uri, row_number() OVER (PARTITION BY page ORDER BY count(*) DESC, uri) AS r FROM pg GROUP BY page, uri) WHERE r = 1),
  pr AS (SELECT uri, source AS topic, count(*) AS n FROM documents WHERE uri IS NOT NULL AND source IS NOT NULL GROUP BY 1, 2), al AS (SELECT uri, sum(n) AS all_n FROM pr GROUP BY uri), mm AS (SELECT page, topic, sum(n * n / all_n) AS mass FROM mc JOIN pr ON pr.uri = mc.uri JOIN al ON al.uri = mc.uri GROUP BY 1, 2),
  b AS (SELECT page, topic, mass / sum(mass) OVER (PARTITION BY page) AS p FROM mm), j AS (SELECT coalesce(a.page, b.page) AS page, coalesce(a.topic, b.topic) AS topic, a.p AS pa, b.p AS pb FROM a FULL JOIN b ON b.page = a.page AND b.topic = a.topic)
  SELECT page, topic, round(CASE WHEN count(pa) OVER (PARTITION BY page) > 0 AND count(pb) OVER (PARTITION BY page) > 0 THEN (coalesce(pa, 0) + coalesce(pb, 0)) / 2 ELSE coalesce(pa, 0) + coalesce(pb, 0) END, 6) AS p FROM j""")
def l13_blended_topics(spark: SparkSession, d: str) -> DataFrame:
    """Half by all linked resources of a page, half by its main one."""
    docs = table(spark, d, "documents").filter(F.col("uri").isNotNull() & F.col("source").isNotNull())
    priors = docs.groupBy("uri", F.col("source").alias("topic")).agg(F.count(F.lit(1)).alias("n"))
    main = topics.tags(_pages(spark, d).withColumn("one", F.lit(1)), "page", "one").filter(F.col("rank") == 1).select("page", "uri")
    return topics.blended(l13_topic_inference(spark, d), topics.infer(main, priors, "page"), "page").select("page", "topic", F.round("p", 6).alias("p"))


_TOPIC_XML = f"WITH x AS ({TOPIC_SQL['l03_topic_prediction']})"


@query(_TOPIC_XML + """ SELECT doc_id, '[' || string_agg('{"topic":"' || topic || '","p":"' || printf('%.6f', round(p, 6)) || '"}', ',' ORDER BY p DESC, topic) || ']' AS json FROM x GROUP BY doc_id""")
def b21_topic_json(spark: SparkSession, d: str) -> DataFrame:
    return sinks.topic_json(l03_topic_prediction(spark, d))


@query(_TOPIC_XML + """ SELECT doc_id, '<topics>' || string_agg('<topic name="' || topic || '" score="' || printf('%.6f', round(p, 6)) || '"/>', '' ORDER BY p DESC, topic) || '</topics>' AS xml FROM x GROUP BY doc_id""")
def b21_topic_xml(spark: SparkSession, d: str) -> DataFrame:
    return sinks.topic_xml(l03_topic_prediction(spark, d).select("doc_id", "p", "topic"))


@query(f"{LINKS} SELECT occ_id, CAST(start AS BIGINT) AS begin_at, CAST(start + length(name) AS BIGINT) AS end_at, uri FROM li")
def b29_text_annotations(spark: SparkSession, d: str) -> DataFrame:
    """Links as typed stretches of text."""
    return sinks.text_annotations(links_of(spark, d), "occ_id").select("occ_id", F.col("begin").alias("begin_at"), F.col("end").alias("end_at"), "uri")


# --- evaluation


@query(f"""{LINKS}, am AS (SELECT name FROM pairs GROUP BY name HAVING count(*) > 1), known AS (SELECT DISTINCT name, uri FROM candidates),
  g AS (SELECT o.occ_id, o.surface_form AS name, o.uri FROM occs o JOIN am ON am.name = o.surface_form WHERE o.uri IS NOT NULL AND o.context IS NOT NULL),
  e AS (SELECT g.occ_id, l.uri = g.uri AS r, l.uri IS NULL AND k.uri IS NULL AS nil FROM g LEFT JOIN li l ON l.occ_id = g.occ_id LEFT JOIN known k ON k.name = g.name AND k.uri = g.uri)
  SELECT count(*) AS mentions, count(*) FILTER (WHERE r) AS right_ones, count(*) FILTER (WHERE nil) AS right_nils FROM e""".replace("WITH x AS (", f"WITH {CAND}, x AS (", 1))
def m05_ambiguous_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Ambiguous mentions only; a mention without link whose resource can't be known counts as right."""
    m = kb_model(spark, d)
    amb = m.pairs.groupBy("name").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > 1).select("name")
    gold = mentions(spark, d).select("occ_id", "name").join(table(spark, d, "occs").filter(F.col("uri").isNotNull()).select("occ_id", F.col("uri").alias("gold")), "occ_id").join(amb, "name", "left_semi")
    return evaluation.with_nil_credit(gold, links_of(spark, d).select("occ_id", "uri"), m.candidates.select("name", "uri"), "occ_id").select("mentions", F.col("right").alias("right_ones"), "right_nils")


@query(f"""WITH {CAND}, dict AS (SELECT name FROM (SELECT f.name, f.a AS annotated, f.a + coalesce(l.a, 0) AS total FROM (SELECT name, sum(n) AS a FROM pairs GROUP BY name) f LEFT JOIN (SELECT name, sum(n) AS a FROM pairs GROUP BY name) l ON l.name = lower(f.name) AND l.name <> f.name) WHERE annotated / total >= 0.05),
  best AS (SELECT name, arg_max(uri, prior) FILTER (WHERE r = 1) AS uri, count(*) AS c FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY prior DESC, uri) AS r FROM candidates) GROUP BY name),
  g AS (SELECT o.occ_id, o.uri, d.name IS NOT NULL AS spotted, coalesce(b.c, 0) > 1 AS ambiguous, coalesce(b.uri = o.uri, FALSE) AS r FROM occs o LEFT JOIN dict d ON d.name = o.surface_form LEFT JOIN best b ON b.name = o.surface_form WHERE o.uri IS NOT NULL AND o.surface_form IS NOT NULL AND o.context IS NOT NULL)
  SELECT count(*) AS gold, count(*) FILTER (WHERE spotted) AS spotted, count(*) FILTER (WHERE spotted AND ambiguous) AS ambiguous, count(*) FILTER (WHERE spotted AND r) AS matched FROM g""")
def m06_batch_evaluation(spark: SparkSession, d: str) -> DataFrame:
    """Gold mentions that are spotted, those of them that are ambiguous, and those that the likeliest resource gets right."""
    m = kb_model(spark, d)
    gold = mentions(spark, d).select("occ_id", "name").join(table(spark, d, "occs").filter(F.col("uri").isNotNull()).select("occ_id", "uri"), "occ_id")
    forms = model.forms_of_pairs(m.pairs)
    known = forms.filter(model.annotation_probability(F.col("annotated"), F.col("total")) >= model.MIN_ANNOTATION_PROBABILITY).select("name")
    best = linking.by_prior(m.candidates, m.candidates.select("name").distinct(), 1).select("name", F.col("uri").alias("best"))
    return evaluation.batch_summary(gold, known, linking.ambiguity(best.select("name"), m.candidates), best)


@query(f"{LINKS}, c AS (SELECT s, c FROM (SELECT unnest([0, 100, 1000]) AS s), (SELECT unnest([0.0, 0.5, 0.9]) AS c)) SELECT DISTINCT c.s AS min_support, CAST(c.c AS DOUBLE) AS min_confidence, li.uri FROM li JOIN c ON li.support > c.s AND li.final_score >= c.c")
def m07_sets_by_interval(spark: SparkSession, d: str) -> DataFrame:
    """The resources that come out for each pair of support and confidence."""
    rows = links_of(spark, d).select("uri", "support", F.round("final_score", 6).alias("final_score"))
    return evaluation.sets_by_interval(rows, [0, 100, 1000], [0.0, 0.5, 0.9])


@query(f"WITH {_LEX}, {_PICK} SELECT CASE WHEN uri IS NULL THEN 'common' ELSE 'valid' END AS spot_class, count(*) AS spots, count(*) FILTER (WHERE kept) AS kept FROM pick GROUP BY 1")
def m09_selector_evaluation(spark: SparkSession, d: str) -> DataFrame:
    """Spots of each class, and how many of them the selector keeps."""
    rows = _placed(spark, d).withColumn("spot_class", F.when(F.col("uri").isNull(), "common").otherwise("valid"))
    kept = spotclass.selected(rows, spotclass.linear(ONE, ONE_BIAS), spotclass.linear(MORE, MORE_BIAS))
    return evaluation.kept_by_class(rows, kept, "spot_class")


@query(f"""{LINKS}, o AS (SELECT occ_id, regexp_extract(id, '^(.*)-p[0-9]+l[0-9]+$', 1) AS page, uri, context FROM occs WHERE id IS NOT NULL), n AS (SELECT page, sum(len(regexp_extract_all(context, '\\S+'))) AS words FROM o GROUP BY page),
  t AS (SELECT o.page, l.uri, round(sum(l.final_score), 4) AS value, count(*) AS c FROM li l JOIN o ON o.occ_id = l.occ_id GROUP BY 1, 2), r AS (SELECT t.*, sum(c) OVER (PARTITION BY t.page) AS links, row_number() OVER (PARTITION BY t.page ORDER BY value DESC, uri) AS k FROM t),
  p AS (SELECT r.page, r.uri FROM r JOIN n ON n.page = r.page WHERE k <= least(links, floor(0.06 * words + 0.5))), g AS (SELECT DISTINCT page, uri FROM o WHERE uri IS NOT NULL), c AS (SELECT (SELECT count(*) FROM p JOIN g USING (page, uri)) AS tp, (SELECT count(*) FROM p) AS np, (SELECT count(*) FROM g) AS ng)
  SELECT tp, np - tp AS fp, ng - tp AS fn FROM c""")
def m13_tag_evaluation(spark: SparkSession, d: str) -> DataFrame:
    """The best tags of each page, six for every hundred words, against the resources that it names."""
    occs = table(spark, d, "occs").filter(F.col("id").isNotNull())
    rows = occs.select("occ_id", F.regexp_extract("id", "^(.*)-p[0-9]+l[0-9]+$", 1).alias("page"), "uri", F.size(F.regexp_extract_all("context", F.lit("\\S+"), F.lit(0))).alias("n"))
    words = rows.groupBy("page").agg(F.sum(F.when(F.col("n") > 0, F.col("n")).otherwise(0)).alias("words"))
    links = links_of(spark, d).select("occ_id", "uri", F.round("final_score", 6).alias("final_score")).join(rows.select("occ_id", "page"), "occ_id")
    picked = evaluation.best_tags(links, words, "page")
    return evaluation.set_scores(rows.filter(F.col("uri").isNotNull()), picked, ["page", "uri"]).select("tp", "fp", "fn")
