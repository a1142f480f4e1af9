"""Topical classification by naive Bayes over word counts, tags and related resources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kedge.operators.skew import PIECES_PER_PARTITION, numbered, salted_join
from kedge.session import cut, partitions, spread

# The class of texts without a topic, and the features' pattern.
OTHER = "other"
FEATURE = "[a-z]{3,}"
#: Most topics of one model: each is an aggregate of its own.
MOST_TOPICS = 200


def features(docs: DataFrame, key: str, text: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, keep…, token, tf): lower-case words of three ASCII letters or more."""
    words = F.regexp_extract_all(F.lower(text), F.lit(FEATURE), F.lit(0))
    return spread(docs.select(key, *keep, text)).select(key, *keep, F.explode(words).alias("token")).groupBy(key, *keep, "token").agg(F.count(F.lit(1)).alias("tf"))


def weighted(feats: DataFrame, key: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, keep…, token, w): ln(1 + tf) * ln(N / df), each text of length 1; words in every text weigh nothing."""
    feats = cut(feats)
    n = feats.agg(F.count_distinct(key)).scalar()
    df = feats.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    w = feats.join(df, "token").withColumn("w", F.log(1 + F.col("tf")) * F.log(n / F.col("df")))
    norm = w.groupBy(F.col(key).alias("__k")).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm")).filter(F.col("norm") > 0)
    return w.join(norm, F.col(key) == F.col("__k")).select(key, *keep, "token", (F.col("w") / F.col("norm")).alias("w"))


def train(rows: DataFrame, topic: str = "topic") -> DataFrame:
    """(topic, token, mass): evidence of every topic, to which later batches are added."""
    return rows.groupBy(topic, "token").agg(F.sum("w").alias("mass"))


def add(model: DataFrame, batch: DataFrame) -> DataFrame:
    """A model with another batch's evidence."""
    return model.unionByName(batch).groupBy("topic", "token").agg(F.sum("mass").alias("mass"))


def log_weights(model: DataFrame, smoothing: float = 1.0) -> DataFrame:
    """(topic, token, lw, floor): smoothed log probabilities, and that of a word the topic never had."""
    vocabulary = model.agg(F.count_distinct("token")).scalar()
    total = model.groupBy("topic").agg(F.sum("mass").alias("total"))
    bottom = F.col("total") + smoothing * vocabulary
    return model.join(F.broadcast(total), "topic").select("topic", "token", F.log((F.col("mass") + smoothing) / bottom).alias("lw"), F.log(smoothing / bottom).alias("floor"))


def topic_names(model: DataFrame) -> list[str]:
    """The topics of a model. They are labels that people gave, few by nature; their number is checked."""
    names = sorted(r["topic"] for r in model.select("topic").distinct().limit(MOST_TOPICS + 1).collect())
    if len(names) > MOST_TOPICS:
        raise ValueError(f"more than {MOST_TOPICS} topics")
    return names


def _scored(rows: DataFrame, per_token: DataFrame, key: str, n_topics: int) -> DataFrame:
    """(key, scores): sum over a text's words of weight times each topic's value; ``per_token`` has one array per word,
    so a word meets the model once, whatever the number of topics."""
    met = rows.join(per_token, "token")
    return met.groupBy(key).agg(*[F.sum(F.col("w") * F.col("v")[i]).alias(f"__s{i}") for i in range(n_topics)]).select(key, F.array(*[F.col(f"__s{i}") for i in range(n_topics)]).alias("scores"))


def predict(rows: DataFrame, weights: DataFrame, key: str) -> DataFrame:
    """(key, topic, p): proportions of all topics for each text, with a uniform prior; a topic that never had a word takes its floor."""
    weights = cut(weights)
    names = topic_names(weights)
    if not names:
        return rows.select(key, F.lit(None).cast("string").alias("topic"), F.lit(None).cast("double").alias("p")).limit(0)
    floors = {r["topic"]: r["floor"] for r in weights.groupBy("topic").agg(F.first("floor").alias("floor")).collect()}
    known = weights.groupBy("token").agg(F.map_from_entries(F.collect_list(F.struct("topic", "lw"))).alias("m"))
    per_token = known.select("token", F.array(*[F.coalesce(F.col("m")[t], F.lit(floors[t])) for t in names]).alias("v"))
    return _softmax(_scored(rows, per_token, key, len(names)), key, names)


def _softmax(scored: DataFrame, key: str, names: list[str]) -> DataFrame:
    shifted = scored.withColumn("e", F.transform("scores", lambda x: F.exp(x - F.array_max("scores"))))
    total = F.aggregate("e", F.lit(0.0), lambda acc, x: acc + x)
    at = F.posexplode(F.transform("e", lambda x: x / total)).alias("i", "p")
    return shifted.select(key, at).select(key, F.array(*[F.lit(t) for t in names])[F.col("i")].alias("topic"), "p")


def predict_each(rows: DataFrame, model: DataFrame, key: str, smoothing: float = 1.0) -> DataFrame:
    """(key, topic, p): for each topic by itself, whether the text is of it or of any other (one model per topic against the rest).

    The evidence of the rest is all evidence less the topic's own, so no text is relabelled and none is read
    once per topic. Topics may hold together; their p don't add up to 1.
    """
    model = cut(model)
    names = topic_names(model)
    if not names:
        return rows.select(key, F.lit(None).cast("string").alias("topic"), F.lit(None).cast("double").alias("p")).limit(0)
    own = {r["topic"]: r["m"] for r in model.groupBy("topic").agg(F.sum("mass").alias("m")).collect()}
    every, vocabulary = sum(own.values()), model.agg(F.count_distinct("token")).first()[0]
    by_token = model.groupBy("token").agg(F.map_from_entries(F.collect_list(F.struct("topic", "mass"))).alias("m"), F.sum("mass").alias("all"))
    bottom = smoothing * vocabulary

    def gain(t: str) -> Column:
        m = F.coalesce(F.col("m")[t], F.lit(0.0))
        return F.log((m + smoothing) / (own[t] + bottom)) - F.log((F.col("all") - m + smoothing) / (every - own[t] + bottom))

    scored = _scored(rows, by_token.select("token", F.array(*[gain(t) for t in names]).alias("v")), key, len(names))
    at = scored.select(key, F.posexplode("scores").alias("i", "s"))
    return at.select(key, F.array(*[F.lit(t) for t in names])[F.col("i")].alias("topic"), (1 / (1 + F.exp(-F.col("s")))).alias("p"))


def self_trained(labelled: DataFrame, unlabelled: DataFrame, key: str, least: float, rounds: int = 2) -> DataFrame:
    """(topic, token, mass): evidence of the labelled rows (key, topic, token, w), to which each round adds that of the
    unlabelled texts (key, token, w) whose best topic reaches ``least``; the others wait for the next round."""
    found, rest = train(labelled), unlabelled
    for _ in range(rounds):
        best = predict(rest, log_weights(found), key).filter(F.col("p") >= least)
        sure = cut(best.groupBy(key).agg(F.max_by("topic", F.struct("p", "topic")).alias("topic")))
        found = cut(add(found, train(rest.join(sure, key))))
        rest = rest.join(sure, key, "left_anti")
    return found


def initial_split(occs: DataFrame, categories: DataFrame, topics_of: dict[str, list[str]]) -> DataFrame:
    """(occs…, topic): occurrences with each topic to which a category (uri, category) of their resource belongs; those of none are left out."""
    of = {c: [] for cs in topics_of.values() for c in cs}
    for t, cs in topics_of.items():
        for c in cs:
            of[c].append(t)
    named = F.create_map(*[x for c, ts in sorted(of.items()) for x in (F.lit(c), F.array(*[F.lit(t) for t in sorted(ts)]))])
    topics = categories.select(F.col("uri").alias("__u"), F.explode(named[F.col("category")]).alias("topic")).distinct()
    return salted_join(occs, topics, "uri", "__u").drop("__u")


def accuracy_by_cutoff(predicted: DataFrame, gold: DataFrame, key: str, cutoffs: Sequence[float] = tuple(k / 10 for k in range(1, 10))) -> DataFrame:
    """(cutoff, decided, right): texts whose likeliest topic reaches the cut-off, and those of them it is right for."""
    best = predicted.groupBy(key).agg(F.max_by("topic", F.struct("p", "topic")).alias("best"), F.max("p").alias("p")).join(gold.select(key, "topic"), key)
    cells = best.select((F.col("best") == F.col("topic")).alias("r"), "p", F.explode(F.array(*[F.lit(float(c)) for c in cutoffs])).alias("cutoff"))
    return cells.filter(F.col("p") >= F.col("cutoff")).groupBy("cutoff").agg(F.count(F.lit(1)).alias("decided"), F.sum(F.col("r").cast("long")).alias("right"))


def assign(predicted: DataFrame, key: str, least: float) -> DataFrame:
    """(key, topic): all topics of at least that probability, else ``other``."""
    best = predicted.groupBy(key).agg(F.max("p").alias("__m"))
    got = predicted.filter(F.col("p") >= least).select(key, "topic")
    return got.unionByName(best.filter(F.col("__m") < least).select(key, F.lit(OTHER).alias("topic")))


def first_of_each(rows: DataFrame, topic: str, order: Sequence[Column], most: int, spread: str) -> DataFrame:
    """The first ``most`` rows of every topic. A topic's rows are ranked in pieces (by a hash of ``spread``, a key) first and only
    each piece's first go on, so a topic of a third of all rows is sorted by many tasks. Null topics are left out."""
    pieces = PIECES_PER_PARTITION * partitions(rows)
    kept = rows.filter(F.col(topic).isNotNull()).withColumn("__piece", F.pmod(F.xxhash64(spread), F.lit(pieces)))
    near = kept.withColumn("__r", F.row_number().over(Window.partitionBy(topic, "__piece").orderBy(*order))).filter(F.col("__r") <= most)
    return near.withColumn("__r", F.row_number().over(Window.partitionBy(topic).orderBy(*order))).filter(F.col("__r") <= most).drop("__r", "__piece")


def balanced(rows: DataFrame, topic: str, key: str) -> DataFrame:
    """As many rows of every topic as the smallest has, in the order of a hash of the key.

    A row stays if its place in its topic, the rows with a smaller hash, is among the first: the place is counted by
    ranges of the hash (``numbered``), never by sorting a whole topic in one task.
    """
    sizes = rows.groupBy(topic).agg(F.count(F.lit(1)).alias("n"))
    least = sizes.agg(F.min("n")).scalar()
    hashed = rows.withColumn("__h", F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 15), 16, 10).cast("long"))
    return numbered(hashed, topic, "__h").filter(F.col("position") <= least).drop("__h", "position")


def infer(links: DataFrame, priors: DataFrame, key: str) -> DataFrame:
    """(key, topic, p): topics of texts by their linked resources: sum of count * occurrences * weight, the weight of a resource being s / (s + other)."""
    n = links.groupBy(key, "uri").agg(F.count(F.lit(1)).alias("occ"))
    every = priors.groupBy("uri").agg(F.sum("n").alias("all_n"))
    got = n.join(priors, "uri").join(every, "uri").groupBy(key, "topic").agg(F.sum(F.col("n") * F.col("occ") * F.col("n") / F.col("all_n")).alias("mass"))
    return got.select(key, "topic", (F.col("mass") / F.sum("mass").over(Window.partitionBy(key))).alias("p"))


def blended(by_links: DataFrame, by_main: DataFrame, key: str) -> DataFrame:
    """(key, topic, p): half by the linked resources, half by the main ones; where a text has only one of them, that one."""
    a = by_links.select(key, "topic", F.col("p").alias("__a"))
    b = by_main.select(key, "topic", F.col("p").alias("__b"))
    got = a.join(b, [key, "topic"], "full_outer")
    every = Window.partitionBy(key)
    both = (F.count("__a").over(every) > 0) & (F.count("__b").over(every) > 0)
    total = F.coalesce("__a", F.lit(0.0)) + F.coalesce("__b", F.lit(0.0))
    return got.select(key, "topic", F.when(both, total / 2).otherwise(total).alias("p"))


def tags(links: DataFrame, key: str, value: str = "final_score") -> DataFrame:
    """(key, uri, value, rank): resources of each text by the sum of their links' values."""
    got = links.groupBy(key, "uri").agg(F.sum(value).alias("value"))
    return got.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("value"), "uri")))


def related(rows: DataFrame, key: str, k: int) -> DataFrame:
    """(uri, other, n, rank): the k resources most often named in the same text.

    Pairs are made within a text, whose resources are bounded by its length; each text counts a pair once.
    """
    per = rows.filter(F.col("uri").isNotNull()).select(key, "uri").distinct()
    pairs = per.join(per.select(key, F.col("uri").alias("other")), key).filter(F.col("uri") != F.col("other"))
    counts = pairs.groupBy("uri", "other").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("uri").orderBy(F.desc("n"), "other"))
    return counts.withColumn("rank", rank).filter(F.col("rank") <= k)


def tags_by(links: DataFrame, key: str, features: Sequence[str]) -> DataFrame:
    """(feature, key, uri, value, rank): tags of each text by the sum of each feature over its links, to four places."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features])).alias("x")
    got = links.select(key, "uri", each).groupBy("x.feature", key, "uri").agg(F.round(F.sum("x.v"), 4).alias("value"))
    return got.withColumn("rank", F.row_number().over(Window.partitionBy("feature", key).orderBy(F.desc("value"), "uri")).cast("long"))


def related_to_sets(sets: DataFrame, relations: DataFrame, key: str, k: int) -> DataFrame:
    """(key, other, value, rank): the k resources with the largest sum of relations (uri, other, n) to the distinct resources of each set."""
    met = salted_join(sets.select(key, "uri").distinct(), relations.select(F.col("uri").alias("__u"), "other", "n"), "uri", "__u", spread=[key])
    got = met.groupBy(key, "other").agg(F.sum("n").alias("value"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("value"), "other")).cast("long")
    return got.withColumn("rank", rank).filter(F.col("rank") <= k)
