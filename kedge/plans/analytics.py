"""Queries of serialisers, evaluation, topics, tags and streams over the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kedge import api
from kedge.operators import evaluation, linking, model, topics
from kedge.plans.kb import CAND, PAIRS, kb_model
from kedge.plans.kb import SQL as _KB_SQL
from kedge.plans.linking import FOLD, _SPOT, mentions, names_of
from kedge.plans.linking import SQL as _LINK_SQL
from kedge.plans.scalar import NT
from kedge.session import cut, table
from kedge.sources import readers, sinks
from kedge.streaming import feeds

QUERIES: dict = {}
SQL: dict[str, str] = {}
SQL_OF = {**_KB_SQL, **_LINK_SQL}


def query(sql: str | None = None):
    def wrap(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return wrap


def corpus_model(spark: SparkSession, d: str) -> model.Model:
    """The model whose names are those of the corpus."""
    m = kb_model(spark, d, cut)
    m.forms = model.forms_of_pairs(m.pairs)
    return m


def links_of(spark: SparkSession, d: str) -> DataFrame:
    """Linked mentions of the occurrences, in the shape that sinks and tags take: the context is the text."""
    got = api.link_mentions(mentions(spark, d), kb_model(spark, d, cut), "occ_id").filter(F.col("rank") == 1)
    at = table(spark, d, "occs").select("occ_id", F.col("text_offset").alias("start"), "context")
    return got.join(at, "occ_id")


@query(f"{FOLD} SELECT {_SPOT} FROM kept")
def n17_spot(spark: SparkSession, d: str) -> DataFrame:
    return api.spot(table(spark, d, "documents").select("doc_id", "text"), corpus_model(spark, d))


@query("SELECT occ_id, concat_ws(chr(9), coalesce(id, ''), coalesce(uri, ''), coalesce(surface_form, ''), coalesce(regexp_replace(context, '\\s+', ' ', 'g'), ''), coalesce(CAST(text_offset AS VARCHAR), '')) AS line FROM occs")
def b03_occurrence_lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "occs").select("occ_id", sinks.occurrence_line().alias("line"))


_ESC = "replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"
#: Links of the mentions in SQL: li(occ_id, uri, support, final_score, name, start).
LINKS = f"""WITH x AS ({SQL_OF["f13_linked_mentions"]}), li AS (SELECT x.*, o.surface_form AS name, o.text_offset AS start FROM x JOIN occs o ON o.occ_id = x.occ_id)"""


@query(f"""{LINKS} SELECT occ_id, '<Annotation><Resources>' || coalesce('<Resource URI="' || {_ESC.format("uri")} || '" support="' || support || '" surfaceForm="' || {_ESC.format("name")} || '" offset="' || start || '"/>', '') || '</Resources></Annotation>' AS xml FROM li""")
def b06_annotation_xml(spark: SparkSession, d: str) -> DataFrame:
    return sinks.annotation_xml(links_of(spark, d), "occ_id")


@query(f"""{LINKS} SELECT occ_id, '[{{' || CASE WHEN start IS NULL THEN '' ELSE '"offset":' || start || ',' END || '"surfaceForm":' || CAST(to_json(name) AS VARCHAR) || ',"URI":' || CAST(to_json(uri) AS VARCHAR) || ',"support":' || support || ',"similarityScore":"' || printf('%.6f', round(final_score, 6)) || '"}}]' AS json FROM li""")
def b08_annotation_json(spark: SparkSession, d: str) -> DataFrame:
    return sinks.annotation_json(links_of(spark, d), "occ_id")


@query("""SELECT occ_id, substr(context, 1, text_offset) || '<a href="http://kb.example/resource/' || uri || '">' || surface_form || '</a>' || substr(context, text_offset + 1 + length(surface_form)) AS html
  FROM occs WHERE uri IS NOT NULL AND context IS NOT NULL AND text_offset >= 0 AND substr(context, text_offset + 1, length(surface_form)) = surface_form""")
def b09_annotated_html(spark: SparkSession, d: str) -> DataFrame:
    """Gold mentions spliced into their contexts as links."""
    occs = table(spark, d, "occs")
    stands = (F.col("text_offset") >= 0) & (F.substr(F.col("context"), F.col("text_offset") + 1, F.char_length("surface_form")) == F.col("surface_form"))
    sound = occs.filter(F.col("uri").isNotNull() & stands)
    links = sound.select("occ_id", F.col("text_offset").alias("start"), F.col("surface_form").alias("name"), "uri")
    return sinks.annotated_html(sound.select("occ_id", "context"), links, "occ_id", "context").select("occ_id", "html")


@query(f"""SELECT '<http://kb.example/text/' || occ_id || '#char=' || text_offset || ',' || (text_offset + length(surface_form)) || '> nif:beginIndex "' || text_offset || '" ; nif:endIndex "' || (text_offset + length(surface_form)) || '" ; nif:anchorOf "' || {NT.format('surface_form')} || '" ; itsrdf:taIdentRef <http://kb.example/resource/' || uri || '> .' AS line
  FROM occs WHERE uri IS NOT NULL AND text_offset IS NOT NULL AND surface_form IS NOT NULL""")
def b10_turtle(spark: SparkSession, d: str) -> DataFrame:
    """Links of all names, escaped where needed."""
    rows = table(spark, d, "occs").filter(F.col("surface_form").isNotNull() & F.col("uri").isNotNull() & F.col("text_offset").isNotNull())
    return sinks.turtle_lines(rows.select("occ_id", F.col("text_offset").alias("start"), F.col("surface_form").alias("name"), "uri"), "occ_id").select("line")


@query("SELECT occ_id, replace(replace(context, '[[', ''), ']]', '') AS plain FROM occs WHERE contains(context, '[[')")
def b12_markers_removed(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "occs").filter(F.contains("context", F.lit("[["))).select("occ_id", F.regexp_replace("context", "\\[\\[|\\]\\]", "").alias("plain"))


@query(f"""WITH {PAIRS} SELECT '<http://kb.example/resource/' || uri || '> <http://www.w3.org/2000/01/rdf-schema#label> "' || {NT.format('name')} || '" .' AS line FROM pairs""")
def b16_name_triples(spark: SparkSession, d: str) -> DataFrame:
    """All names, escaped where needed."""
    return sinks.name_triples(model.pair_counts(table(spark, d, "occs")))


@query(f"""WITH x AS ({SQL_OF["h18_lexicalisations"]}) SELECT '<http://kb.example/resource/' || uri || '> <http://kb.example/score/pmi> "' || printf('%.6f', round(pmi, 6)) || '" "' || {NT.format('name')} || '" .' AS line FROM x WHERE n >= 5""")
def b15_score_quads(spark: SparkSession, d: str) -> DataFrame:
    return sinks.score_quads(model.lexicalisations(model.pair_counts(table(spark, d, "occs"))))


@query("""SELECT uri, 'surface_form' AS field, CAST(NULL AS BIGINT) AS position, surface_form AS value, count(*) AS n FROM occs WHERE uri IS NOT NULL AND surface_form IS NOT NULL GROUP BY uri, surface_form
  UNION ALL SELECT uri, 'context', row_number() OVER (PARTITION BY uri ORDER BY occ_id), context, 1 FROM occs WHERE uri IS NOT NULL AND context IS NOT NULL""")
def b23_inverted_index(spark: SparkSession, d: str) -> DataFrame:
    return sinks.inverted_index(table(spark, d, "occs"))


@query("SELECT uri, count(*) AS uri_count, count(context) AS n_contexts FROM occs WHERE uri IS NOT NULL GROUP BY uri HAVING count(*) >= 5")
def b27_compressed_index(spark: SparkSession, d: str) -> DataFrame:
    return sinks.compressed_index(table(spark, d, "occs"), 5)


@query("""SELECT source, doc_id, '["' || string_agg(w, '","' ORDER BY w) || '"]' AS tags FROM (SELECT DISTINCT source, doc_id, uri AS w FROM documents WHERE uri IS NOT NULL) GROUP BY source, doc_id""")
def b20_tag_lists(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").filter(F.col("uri").isNotNull()).select("source", "doc_id", "uri").distinct()
    return rows.groupBy("source", "doc_id").agg(F.to_json(F.array_sort(F.collect_list("uri"))).alias("tags"))


GOLD = "SELECT occ_id, surface_form AS name, uri FROM occs WHERE surface_form IS NOT NULL AND context IS NOT NULL AND uri IS NOT NULL"
RANKED = f"WITH {CAND}, gold AS ({GOLD}), rk AS (SELECT g.occ_id, g.uri, coalesce(c.rank, 0) AS gold_rank FROM gold g LEFT JOIN (SELECT name, uri, row_number() OVER (PARTITION BY name ORDER BY prior DESC, uri) AS rank FROM candidates) c ON c.name = g.name AND c.uri = g.uri)"


def _baseline_ranks(spark: SparkSession, d: str) -> DataFrame:
    gold = mentions(spark, d).select("occ_id", "name").join(table(spark, d, "occs").filter(F.col("uri").isNotNull()).select("occ_id", "uri"), "occ_id")
    ranked = linking.by_prior(kb_model(spark, d).candidates, names_of(spark, d), 1_000_000).select("name", "uri", "rank")
    return gold.join(ranked, ["name", "uri"], "left").select("occ_id", "uri", F.coalesce("rank", F.lit(0)).alias("gold_rank"))


@query(RANKED + " SELECT occ_id, uri, gold_rank FROM rk")
def j04_gold_ranks(spark: SparkSession, d: str) -> DataFrame:
    return _baseline_ranks(spark, d)


@query(RANKED + " SELECT count(*) AS mentions, avg(CASE WHEN gold_rank > 0 AND gold_rank <= 100 THEN 1.0 ELSE 0.0 END) AS found, avg(CASE WHEN gold_rank = 1 THEN 1.0 ELSE 0.0 END) AS accuracy, avg(CASE WHEN gold_rank > 0 THEN 1.0 / gold_rank ELSE 0.0 END) AS mrr FROM rk")
def m01_ranking_summary(spark: SparkSession, d: str) -> DataFrame:
    """Baseline by prior: found, accuracy and mean reciprocal rank."""
    return evaluation.ranking_summary(_baseline_ranks(spark, d))


@query("""WITH g AS (SELECT DISTINCT context, surface_form, text_offset FROM occs WHERE context IS NOT NULL AND surface_form IS NOT NULL AND text_offset IS NOT NULL), p AS (SELECT DISTINCT context, surface_form, CAST(strpos(context, surface_form) - 1 AS INTEGER) AS text_offset FROM occs WHERE context IS NOT NULL AND surface_form IS NOT NULL AND strpos(context, surface_form) > 0),
  n AS (SELECT (SELECT count(*) FROM g JOIN p USING (context, surface_form, text_offset)) AS tp, (SELECT count(*) FROM p) AS np, (SELECT count(*) FROM g) AS ng) SELECT tp, np - tp AS fp, ng - tp AS fn, tp / np AS precision, tp / ng AS recall, 2 * tp / (np + ng) AS f1 FROM n""")
def m02_spot_scores(spark: SparkSession, d: str) -> DataFrame:
    """First occurrences of the forms as spots against the gold offsets."""
    rows = table(spark, d, "occs").filter(F.col("context").isNotNull() & F.col("surface_form").isNotNull())
    at = F.position(F.col("surface_form"), F.col("context"))
    predicted = rows.withColumn("at", at).filter(F.col("at") > 0).select("context", "surface_form", (F.col("at") - 1).alias("text_offset"))
    return evaluation.set_scores(rows.filter(F.col("text_offset").isNotNull()), predicted, ["context", "surface_form", "text_offset"])


@query(f"""WITH {CAND}, g AS (SELECT name, uri FROM pairs WHERE n >= 2), p AS (SELECT name, uri FROM (SELECT name, uri, row_number() OVER (PARTITION BY name ORDER BY prior DESC, uri) AS r FROM candidates) WHERE r = 1),
  j AS (SELECT len(string_split(name, ' ')) AS n_words, count(g.name2) FILTER (WHERE p.name2 IS NOT NULL) AS tp, count(*) FILTER (WHERE g.name2 IS NULL) AS fp, count(*) FILTER (WHERE p.name2 IS NULL) AS fn FROM (SELECT name, uri, name AS name2 FROM g) g FULL JOIN (SELECT name, uri, name AS name2 FROM p) p USING (name, uri) GROUP BY 1)
  SELECT n_words, tp, fp, fn, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1 FROM j""")
def m03_set_scores_by_source(spark: SparkSession, d: str) -> DataFrame:
    """The likeliest resource of every name against the pairs seen twice, by the number of words of the name."""
    m = kb_model(spark, d)
    size = F.size(F.split("name", " ")).cast("long").alias("n_words")
    gold = m.pairs.filter(F.col("n") >= 2).select("name", "uri", size)
    best = linking.by_prior(m.candidates, m.candidates.select("name").distinct(), 1).select("name", "uri", size)
    return evaluation.set_scores(gold, best, ["name", "uri", "n_words"], ["n_words"])


@query(f"""{LINKS}, c AS (SELECT s, c FROM (SELECT unnest([0, 100, 1000]) AS s), (SELECT unnest([0.0, 0.25, 0.5, 0.75, 0.9]) AS c)), g AS (SELECT DISTINCT occ_id, uri FROM occs WHERE uri IS NOT NULL)
  SELECT c.s AS min_support, CAST(c.c AS DOUBLE) AS min_confidence, count(g.uri) AS tp, count(*) AS predicted, count(g.uri) / count(*) AS precision, count(g.uri) / (SELECT count(*) FROM g) AS recall
  FROM li JOIN c ON li.support > c.s AND li.final_score >= c.c LEFT JOIN g ON g.occ_id = li.occ_id AND g.uri = li.uri GROUP BY c.s, c.c""")
def m05_linker_evaluation(spark: SparkSession, d: str) -> DataFrame:
    """The linker's precision and recall over a grid of support and confidence."""
    gold = table(spark, d, "occs").filter(F.col("uri").isNotNull()).select("occ_id", "uri")
    rounded = links_of(spark, d).select("occ_id", "uri", "support", F.round("final_score", 6).alias("final_score"))
    return evaluation.grid_scores(gold, rounded, ["occ_id", "uri"], [0, 100, 1000], [0.0, 0.25, 0.5, 0.75, 0.9])


@query("SELECT coalesce(substr(context, text_offset + 1, length(surface_form)) = surface_form AND text_offset >= 0, FALSE) AS stands, count(*) AS n FROM occs GROUP BY 1")
def m15_offset_check(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.offset_check(table(spark, d, "occs"))


_FEAT = "f AS (SELECT doc_id, lang, token, count(*) AS tf FROM (SELECT doc_id, lower(substr(lang, 1, 2)) AS lang, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS token FROM documents WHERE lang IS NOT NULL) GROUP BY 1, 2, 3)"
_WEIGHT = f"{_FEAT}, nd AS (SELECT count(DISTINCT doc_id) AS nd FROM f), fd AS (SELECT token, count(*) AS df FROM f GROUP BY token), w0 AS (SELECT f.doc_id, f.lang, f.token, ln(1 + tf) * ln(nd / df) AS w FROM f JOIN fd ON fd.token = f.token, nd), nm AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM w0 GROUP BY doc_id), w AS (SELECT w0.doc_id, lang, token, w / norm AS w FROM w0 JOIN nm ON nm.doc_id = w0.doc_id WHERE norm > 0)"
_NB = f"{_WEIGHT}, ev AS (SELECT lang AS topic, token, sum(w) AS mass FROM w GROUP BY lang, token), v AS (SELECT count(DISTINCT token) AS v FROM ev), tt AS (SELECT topic, sum(mass) AS total FROM ev GROUP BY topic), lw AS (SELECT ev.topic, token, ln((mass + 1) / (total + v)) AS lw, ln(1 / (total + v)) AS floor FROM ev JOIN tt ON tt.topic = ev.topic, v)"


def _topic_rows(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").filter(F.col("lang").isNotNull()).withColumn("topic", F.lower(F.substring("lang", 1, 2)))
    return cut(topics.weighted(topics.features(docs, "doc_id", "text", ("topic",)), "doc_id", ("topic",)))


@query(f"WITH {_WEIGHT} SELECT doc_id, token, round(w, 8) AS w FROM w")
def l02_topic_features(spark: SparkSession, d: str) -> DataFrame:
    return _topic_rows(spark, d).select("doc_id", "token", F.round("w", 8).alias("w"))


@query(f"WITH {_NB} SELECT topic, token, round(lw, 8) AS lw FROM lw")
def l04_topic_training(spark: SparkSession, d: str) -> DataFrame:
    """Evidence of two batches added up, as smoothed log probabilities."""
    rows = _topic_rows(spark, d)
    even, odd = (rows.filter(F.col("doc_id") % 2 == k) for k in (0, 1))
    both = topics.add(topics.train(even), topics.train(odd))
    return topics.log_weights(both).select("topic", "token", F.round("lw", 8).alias("lw"))


@query(f"""WITH {_NB}, ms AS (SELECT doc_id, sum(w) AS mass FROM w GROUP BY doc_id), fl AS (SELECT topic, any_value(floor) AS floor FROM lw GROUP BY topic), gn AS (SELECT doc_id, topic, sum(w.w * (lw - floor)) AS gain FROM w JOIN lw ON lw.token = w.token GROUP BY 1, 2),
  sc AS (SELECT ms.doc_id, fl.topic, mass * floor + coalesce(gain, 0) AS score FROM ms CROSS JOIN fl LEFT JOIN gn ON gn.doc_id = ms.doc_id AND gn.topic = fl.topic) SELECT doc_id, topic, round(exp(score - max(score) OVER (PARTITION BY doc_id)) / sum(exp(score - m)) OVER (PARTITION BY doc_id), 6) AS p FROM (SELECT *, max(score) OVER (PARTITION BY doc_id) AS m FROM sc)""")
def l03_topic_prediction(spark: SparkSession, d: str) -> DataFrame:
    rows = _topic_rows(spark, d)
    return topics.predict(rows.select("doc_id", "token", "w"), topics.log_weights(topics.train(rows)), "doc_id").select("doc_id", "topic", F.round("p", 6).alias("p"))


@query(f"""WITH x AS ({SQL["l03_topic_prediction"]}) SELECT doc_id, topic FROM x WHERE p >= 0.4 UNION ALL SELECT doc_id, 'other' FROM x GROUP BY doc_id HAVING max(p) < 0.4""")
def l08_topic_assignment(spark: SparkSession, d: str) -> DataFrame:
    return topics.assign(l03_topic_prediction(spark, d), "doc_id", 0.4)


@query("""WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY substr(md5(CAST(doc_id AS VARCHAR)), 1, 15)) AS k FROM documents WHERE source IS NOT NULL)
  SELECT doc_id, source FROM r WHERE k <= (SELECT min(n) FROM (SELECT count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY source))""")
def l09_balanced_corpus(spark: SparkSession, d: str) -> DataFrame:
    return topics.balanced(table(spark, d, "documents").filter(F.col("source").isNotNull()).select("doc_id", "source"), "source", "doc_id")


@query("""WITH pr AS (SELECT uri, source AS topic, count(*) AS n FROM documents WHERE uri IS NOT NULL AND source IS NOT NULL GROUP BY 1, 2), al AS (SELECT uri, sum(n) AS all_n FROM pr GROUP BY uri), o AS (SELECT regexp_extract(id, '^(.*)-p[0-9]+l[0-9]+$', 1) AS page, uri, count(*) AS occ FROM occs WHERE uri IS NOT NULL AND id IS NOT NULL GROUP BY 1, 2),
  m AS (SELECT page, topic, sum(n * occ * n / all_n) AS mass FROM o JOIN pr ON pr.uri = o.uri JOIN al ON al.uri = o.uri GROUP BY 1, 2) SELECT page, topic, round(mass / sum(mass) OVER (PARTITION BY page), 8) AS p FROM m""")
def l13_topic_inference(spark: SparkSession, d: str) -> DataFrame:
    """Topics (sources) of pages by their linked resources."""
    docs = table(spark, d, "documents").filter(F.col("uri").isNotNull() & F.col("source").isNotNull())
    priors = docs.groupBy("uri", F.col("source").alias("topic")).agg(F.count(F.lit(1)).alias("n"))
    links = table(spark, d, "occs").filter(F.col("uri").isNotNull() & F.col("id").isNotNull()).select(F.regexp_extract("id", "^(.*)-p[0-9]+l[0-9]+$", 1).alias("page"), "uri")
    return topics.infer(links, priors, "page").select("page", "topic", F.round("p", 8).alias("p"))


PAGE = "SELECT regexp_extract(id, '^(.*)-p[0-9]+l[0-9]+$', 1) AS page, uri FROM occs WHERE uri IS NOT NULL AND id IS NOT NULL"


def _pages(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "occs").filter(F.col("uri").isNotNull() & F.col("id").isNotNull())
    return rows.select(F.regexp_extract("id", "^(.*)-p[0-9]+l[0-9]+$", 1).alias("page"), "uri")


@query(f"SELECT page, uri, n AS value, row_number() OVER (PARTITION BY page ORDER BY n DESC, uri) AS rank FROM (SELECT page, uri, count(*) AS n FROM ({PAGE}) GROUP BY page, uri)")
def h27_tags(spark: SparkSession, d: str) -> DataFrame:
    """Resources of each page by how often it names them."""
    return topics.tags(_pages(spark, d).withColumn("one", F.lit(1)), "page", "one")


@query("""WITH t AS (SELECT doc_id, len(regexp_extract_all(text, '[\\p{L}\\p{N}]+')) AS n, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS token FROM documents), c AS (SELECT doc_id, n, token, count(*) AS tf FROM t GROUP BY 1, 2, 3)
  SELECT doc_id, token, tf FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY tf DESC, token) AS r FROM c) WHERE r <= floor(0.06 * n + 0.5)""")
def j08_top_share_of_words(spark: SparkSession, d: str) -> DataFrame:
    """Of each document its most frequent words, as many as six in a hundred of its length."""
    from pyspark.sql.window import Window

    from kedge.functions import text as T

    docs = table(spark, d, "documents").withColumn("n", F.size(T.words(F.col("text"))))
    counted = topics.features(docs, "doc_id", "text", ("n",))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("tf"), "token"))
    return counted.withColumn("r", rank).filter(F.col("r") <= F.floor(0.06 * F.col("n") + 0.5)).select("doc_id", "token", "tf")


@query("SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents WHERE source IS NOT NULL) WHERE r <= 20")
def l10_first_per_topic(spark: SparkSession, d: str) -> DataFrame:
    """The first twenty documents of every topic (here: source)."""
    return topics.first_of_each(table(spark, d, "documents").select("doc_id", "source"), "source", [F.col("doc_id")], 20, spread="doc_id")


@query(f"""WITH {CAND} SELECT name, '[' || string_agg('{{"uri":' || CAST(to_json(uri) AS VARCHAR) || ',"n":' || n || '}}', ',' ORDER BY n DESC, uri) || ']' AS candidates FROM candidates GROUP BY name""")
def b07_nested_candidates(spark: SparkSession, d: str) -> DataFrame:
    """All candidates of every name as one nested JSON value, the most frequent first; a name has as many as it is ambiguous."""
    one = F.struct((-F.col("n")).alias("minus"), "uri", "n")
    ordered = F.transform(F.array_sort(F.collect_list(one)), lambda x: F.struct(x["uri"].alias("uri"), x["n"].alias("n")))
    return kb_model(spark, d).candidates.groupBy("name").agg(F.to_json(ordered).alias("candidates"))


@query(f"WITH p AS (SELECT DISTINCT page, uri FROM ({PAGE})), c AS (SELECT a.uri, b.uri AS other, count(*) AS n FROM p a JOIN p b ON b.page = a.page AND b.uri <> a.uri GROUP BY 1, 2) SELECT uri, other, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY uri ORDER BY n DESC, other) AS rank FROM c) WHERE rank <= 5")
def h29_related(spark: SparkSession, d: str) -> DataFrame:
    return topics.related(_pages(spark, d), "page", 5)


@query("SELECT event_id, event_type, user_id FROM events")
def k01_replayed_feed(spark: SparkSession, d: str) -> DataFrame:
    """Events as a stream of micro-batches, projected and written."""
    return feeds.collected(feeds.replay(spark, f"{d}/events.parquet").select("event_id", "event_type", "user_id"))


@query("SELECT 'events' AS feed, event_id FROM events UNION ALL SELECT 'occurrences', occ_id FROM occs")
def k03_registered_feeds(spark: SparkSession, d: str) -> DataFrame:
    """Two feeds found by the columns they deliver, each decorated to one shape."""
    known = feeds.Registry()
    known.add("events", feeds.replay(spark, f"{d}/events.parquet"))
    known.add("occurrences", feeds.replay(spark, f"{d}/occs.parquet"))
    got = {**known.with_columns("event_id"), **known.with_columns("occ_id")}
    shaped = [feeds.collected(feeds.decorated(v, lambda f, k=k: f.select(F.lit(k).alias("feed"), F.col(f.columns[0]).alias("event_id")))) for k, v in sorted(got.items())]
    return shaped[0].unionByName(shaped[1])


@query("SELECT DISTINCT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS at FROM events WHERE ts > TIMESTAMP '2024-01-10 00:00:00'")
def k06_new_items(spark: SparkSession, d: str) -> DataFrame:
    """Each event after the poll mark once."""
    stream = feeds.replay(spark, f"{d}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    got = feeds.collected(feeds.new_items(stream, "event_id", "ts", delay=None, since="2024-01-10 00:00:00"))
    return got.select("event_id", F.unix_timestamp("ts").alias("at"))


@query("""SELECT CAST(epoch(time_bucket(INTERVAL '1 day', ts)) AS BIGINT) AS start, event_type, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY 1, 2
  HAVING epoch(time_bucket(INTERVAL '1 day', min(ts))) + 86400 <= (SELECT epoch(max(ts)) - 3600 FROM events)""")
def k09_windowed_counts(spark: SparkSession, d: str) -> DataFrame:
    """Events per day and type from a stream: the windows that the watermark (an hour behind the last event) has made final."""
    stream = feeds.replay(spark, f"{d}/events.parquet", files_per_batch=1_000_000).select("event_type", F.col("ts").cast("timestamp").alias("ts")).filter(F.col("ts").isNotNull())
    return feeds.collected(feeds.windowed_counts(stream, "ts", "event_type", "1 day")).select(F.unix_timestamp("start").alias("start"), "event_type", "n")


@query("SELECT event_type, count(*) AS n, min(event_id) AS first_event FROM events GROUP BY event_type")
def k01_running_totals(spark: SparkSession, d: str) -> DataFrame:
    """The last state of counts that a stream keeps up to date."""
    stream = feeds.replay(spark, f"{d}/events.parquet").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"))
    return feeds.collected(stream, "complete")


@query("SELECT occ_id, link_uri AS uri, name FROM (SELECT occ_id, split_part(link, '|', 1) AS link_uri, CASE WHEN contains(link, '|') THEN split_part(link, '|', 2) ELSE link END AS name FROM (SELECT occ_id, unnest(regexp_extract_all(context, '\\[\\[([^\\[\\]]*)\\]\\]', 1)) AS link FROM occs))")
def k05_page_changes(spark: SparkSession, d: str) -> DataFrame:
    """Linked mentions of the paragraphs of changed pages, from a stream."""
    stream = feeds.replay(spark, f"{d}/occs.parquet").select("occ_id", "context")
    return feeds.collected(feeds.page_changes(stream, "occ_id", "context")).select("occ_id", "uri", "name")


@query("SELECT occ_id, href, name FROM (SELECT occ_id, regexp_extract(a, 'href=[\"'']([^\"'']*)[\"'']', 1) AS href, regexp_extract(a, '>([^<]*)</a>', 1) AS name FROM (SELECT occ_id, unnest(regexp_extract_all(context, '<a [^>]*href=[\"''][^\"'']*[\"''][^>]*>[^<]*</a>')) AS a FROM occs))")
def a29_anchors(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "occs").filter(F.contains("context", F.lit("<a "))).select("occ_id", F.explode(readers.anchors(F.col("context"))).alias("a"))
    return rows.select("occ_id", "a.href", "a.name")
