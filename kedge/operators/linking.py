"""Candidates of spots, their scores against the context, and the choice among them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kedge.functions import scalars as S
from kedge.functions import text as T
from kedge.operators.model import with_ids
from kedge.operators.postings import most_alike
from kedge.session import cut, partitions, spread

# Smoothing and caps of the scorer.
LAMBDA = 0.2
TOP_CANDIDATES = 10
TOP_NORMALISED = 5
QUERY_TERMS = 25
#: Tables of at most this many terms or resources are sent to the tasks; larger ones are joined by a shuffle.
SENT_TERMS = 1_000_000


def token_prior(count: Column, n_tokens: Column, vocabulary: Column) -> Column:
    """ln P(token), smoothed by one."""
    return F.log(count + 1) - F.log(n_tokens + vocabulary)


def smoothed(prior: Column, count: Column, total: Column) -> Column:
    """ln of (1 - lambda) P(token) + lambda count / total."""
    own = F.when((count > 0) & (total > 0), F.log(F.lit(LAMBDA)) + F.log(count / total)).otherwise(S.log_zero())
    return S.ln_sum(F.log(F.lit(1 - LAMBDA)) + prior, own)


def top_candidates(spots: DataFrame, candidates: DataFrame, keys: list[str], k: int = TOP_CANDIDATES) -> DataFrame:
    """The k likeliest candidates of each spot by P(resource | name), ties by uri.

    The cap is taken on the candidates of each name, before the join: names repeat, and a frequent
    name then brings k rows per spot at most.
    """
    by_prior = Window.partitionBy("name").orderBy(F.desc("prior"), "uri")
    best = candidates.withColumn("__r", F.row_number().over(by_prior)).filter(F.col("__r") <= k).drop("__r")
    return spots.select(*keys, "name").join(best, "name")


def normalised_forms(names: DataFrame, forms: DataFrame, lower: DataFrame, k: int = TOP_NORMALISED) -> DataFrame:
    """(name, form, score, rank): known forms with the same lower case, by edit score, annotation probability and the lower-case rows' share."""
    p = F.when(F.col("total") == -1, 1.0).when(F.col("total") > 0, F.col("annotated") / F.col("total")).otherwise(0.0)
    known = forms.withColumn("lower", F.lower("name")).join(lower, "lower", "left").select("lower", F.col("name").alias("form"), p.alias("p"), "total", "lower_count")
    share = F.when(F.col("lower_count").isNull() | (F.col("total") <= 0), 1.0).otherwise(2.0 * F.col("total") / (F.col("lower_count") + F.col("total")))
    met = names.withColumn("lower", F.lower("name")).join(known, "lower").select("name", "form", (S.edit_score(F.col("name"), F.col("form")) * F.col("p") * share).alias("score"))
    rank = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("score"), "form"))
    return met.withColumn("rank", rank).filter(F.col("rank") <= k)


def candidates_with_fallback(names: DataFrame, candidates: DataFrame, forms: DataFrame, lower: DataFrame) -> DataFrame:
    """(name, uri, n, exact): candidates of the name itself, else of its likeliest normalised forms."""
    exact = names.join(candidates, "name").select("name", "uri", "n", F.lit(True).alias("exact"))
    missing = names.join(candidates.select("name").distinct(), "name", "left_anti")
    near = normalised_forms(missing, forms, lower).join(candidates.select(F.col("name").alias("form"), "uri", "n"), "form")
    return exact.unionByName(near.groupBy("name", "uri").agg(F.max("n").alias("n")).withColumn("exact", F.lit(False)))


def ambiguity(names: DataFrame, candidates: DataFrame) -> DataFrame:
    """(name, ambiguity): number of candidates, 0 for unknown names."""
    counts = candidates.groupBy("name").agg(F.count(F.lit(1)).alias("ambiguity"))
    return names.join(counts, "name", "left").select("name", F.coalesce("ambiguity", F.lit(0)).alias("ambiguity"))


def fuzzy_names(names: DataFrame, known: DataFrame, least: float = 0.5) -> DataFrame:
    """(name, form, similarity): distinct ``names`` and ``known`` names at least half alike by edits, case apart.

    The pairs tried share two letter pairs (the ends of the name count as letters) and differ in length by no more
    than the similarity allows; a typo may be anywhere, the first letters included. Two names that are half alike
    nearly always share two pairs: the recall against all pairs is measured in the tests. No cross join.
    """
    edge = lambda c: F.concat(F.lit("^"), F.lower(c), F.lit("$"))
    grams = lambda df: df.select("name", F.explode(F.array_distinct(T.char_ngrams(edge("name"), 2))).alias("g"))
    a, b = F.char_length("name"), F.char_length("form")
    met = grams(names).join(grams(known).withColumnRenamed("name", "form"), "g").filter(F.abs(a - b) <= (1 - least) * F.greatest(a, b))
    near = met.groupBy("name", "form").agg(F.count(F.lit(1)).alias("shared")).filter(F.col("shared") >= 2)
    return near.select("name", "form", (1 - F.levenshtein(F.lower("name"), F.lower("form")) / F.greatest(a, b)).alias("similarity")).filter(F.col("similarity") >= least)


def trigram_names(names: DataFrame, known: DataFrame, least: int = 6) -> DataFrame:
    """(name, form, shared): names that share at least so many letter trigrams."""
    grams = lambda df: df.select("name", F.explode(F.array_distinct(T.char_ngrams(F.lower("name"), 3))).alias("g"))
    met = grams(names).join(grams(known).withColumnRenamed("name", "form"), "g")
    return met.groupBy("name", "form").agg(F.count(F.lit(1)).alias("shared")).filter(F.col("shared") >= least)


def gains_of(contexts: DataFrame, tokens: DataFrame, sizes: DataFrame) -> DataFrame:
    """(uri, token, g): how much better a resource explains a word than no resource does; one row per row of ``contexts``."""
    prior = token_prior(F.col("tn"), F.col("n_tokens"), F.col("vocabulary"))
    floor = F.log(F.lit(1 - LAMBDA)) + prior
    total = contexts.groupBy("uri").agg(F.sum("n").alias("total"))
    known = contexts.join(total, "uri").join(tokens.select("token", F.col("n").alias("tn")), "token").join(F.broadcast(sizes.select("n_tokens", "vocabulary")))
    return known.select("uri", "token", (smoothed(prior, F.col("n"), F.col("total")) - floor).alias("g"))


def context_gain(spotted: DataFrame, texts: DataFrame, contexts: DataFrame, tokens: DataFrame, sizes: DataFrame, key: str) -> DataFrame:
    """(key, uri, gain): how much better the resource explains the distinct words of the text than no resource does.

    Only words that text and resource share differ from the background. What a word gains for a
    resource doesn't depend on the text, so it is worked out once per row of the context table; the
    words of a text then meet the gains of its candidates by (resource, word). Joining candidates to
    whole contexts first would multiply every mention by its resource's vocabulary. A text with several
    mentions of one resource asks once.
    """
    # texts and candidates are placed by key once; words are taken apart and met there, in as many tasks as asked for
    n = partitions(texts)
    query = texts.select(key, "text").repartition(n, key).select(key, F.explode(F.array_distinct(T.lower_words(F.col("text")))).alias("token"))
    wanted = spotted.select(key, "uri").repartition(n, key).distinct()
    gains = gains_of(contexts, tokens, sizes)
    # (uri, token) is unique among the gains, so their hash tables are even and small however often a pair is asked for
    return wanted.join(query, key).join(gains.hint("shuffle_hash"), ["uri", "token"]).groupBy(key, "uri").agg(F.sum("g").alias("gain"))


def linked(candidates: DataFrame, gain: DataFrame | None, sizes: DataFrame, keys: list[str], key: str, true_likelihood: bool = False) -> DataFrame:
    """Candidates with score, final score, share of the next one and rank; those no better than no resource are gone.

    score = ln P(resource | name) + context gain + ln P(resource); the score of no resource is
    ln(1 / annotations). ``true_likelihood`` takes P(name | resource) instead. ``context_share`` is the softmax of the
    context alone, with no resource at 0. Without a gain (None) the context says nothing and no resource is
    impossible, so every candidate stays. Ties rank by uri.
    """
    no_context = gain is None
    gain = candidates.select(key, "uri").distinct().withColumn("gain", F.lit(0.0)) if no_context else gain
    like = F.col("n") / F.col("support") if true_likelihood else F.col("prior")
    rows = candidates.join(gain, [key, "uri"], "left").join(F.broadcast(sizes.select(F.col("support").alias("all_support"), F.col("annotated").alias("all_annotated"))))
    score = F.log(like) + F.coalesce("gain", F.lit(0.0)) + F.log(F.col("support") / F.col("all_support"))
    nil = F.lit(float("-inf")) if no_context else -F.log("all_annotated")
    kept = rows.withColumn("context_gain", F.coalesce("gain", F.lit(0.0))).withColumn("score", score).withColumn("nil", nil).filter(~F.isnan("score") & (F.col("score") > F.col("nil")))
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "uri")
    every = Window.partitionBy(*keys)
    top = F.greatest(F.max("score").over(every), F.col("nil"))
    mass = F.sum(F.exp(F.col("score") - top)).over(every) + F.exp(F.col("nil") - top)
    most = F.greatest(F.max("context_gain").over(every), F.lit(0.0))
    context_mass = F.sum(F.exp(F.col("context_gain") - most)).over(every) + F.exp(-most)
    return kept.select(
        *keys, "name", "uri", "support", "prior", "context_gain", "score",
        (F.exp(F.col("score") - top) / mass).alias("final_score"),
        (F.exp(F.col("context_gain") - most) / context_mass).alias("context_share"),
        F.coalesce(F.exp(F.lead("score").over(order) - F.col("score")), F.lit(0.0)).alias("second_rank"),
        F.row_number().over(order).alias("rank"),
    )


def unweighted_mixture(*features: Column) -> Column:
    return S.ln_product(*features)


def linear_mixture(prior: Column, context: Column) -> Column:
    return S.MIX_PRIOR * prior + S.MIX_CONTEXT * context + S.MIX_OFFSET


def fader_mixture(prior: Column, context: Column, alpha: float = 0.7) -> Column:
    return alpha * context + (1 - alpha) * prior


def product_mixture(prior: Column, context: Column) -> Column:
    return context * (1 + prior)


def by_prior(candidates: DataFrame, names: DataFrame, k: int, order: str = "prior") -> DataFrame:
    """Baseline: the k candidates with the largest prior (or support), ties by uri."""
    rank = F.row_number().over(Window.partitionBy("name").orderBy(F.desc(order), "uri"))
    return names.join(candidates, "name").withColumn("rank", rank).filter(F.col("rank") <= k)


def inverse_candidate_frequency(asked: DataFrame, candidates: DataFrame, contexts: DataFrame) -> DataFrame:
    """(name, token, uri, n, holders, icf) for each asked (name, token) and candidate of the name whose context holds the
    token: ln(candidates / candidates that hold it) + 1.

    Only words that are asked for are looked up: all words of all candidates of all names would multiply every
    name by the vocabulary of its resources. The holders of a name and word are as few as the name's candidates.
    """
    cand = candidates.select("name", "uri", F.count(F.lit(1)).over(Window.partitionBy("name")).alias("__cand"))
    held = asked.select("name", "token").distinct().join(cand, "name").join(contexts.select("uri", "token", "n").hint("shuffle_hash"), ["uri", "token"])
    holders = F.count(F.lit(1)).over(Window.partitionBy("name", "token"))
    return held.withColumn("holders", holders).select("name", "token", "uri", "n", "holders", (F.log(F.col("__cand") / F.col("holders")) + 1).alias("icf"))


def words_of(mentions: DataFrame, key: str) -> DataFrame:
    """(key, name, token): the distinct words of each mention's text."""
    return spread(mentions.select(key, "name", "text")).select(key, "name", F.explode(F.array_distinct(T.lower_words(F.col("text")))).alias("token"))


def icf_scores(mentions: DataFrame, candidates: DataFrame, contexts: DataFrame, key: str, belief: DataFrame | None = None) -> DataFrame:
    """(key, name, uri, score): sum of tf * icf squared over the words that mention and candidate share; 0 without any.

    ``belief`` (name, belief) multiplies each icf: how convinced one may be that the name is a mention at all.
    """
    words = words_of(mentions, key)
    icf = inverse_candidate_frequency(words, candidates, contexts)
    if belief is not None:
        icf = icf.join(belief, "name").withColumn("icf", F.col("icf") * F.col("belief"))
    weights = icf.select("name", "token", "uri", (F.sqrt("n") * F.col("icf") * F.col("icf")).alias("w"))
    score = words.join(weights, ["name", "token"]).groupBy(key, "name", "uri").agg(F.sum("w").alias("score"))
    cand = mentions.select(key, "name").join(candidates.select("name", "uri"), "name")
    return cand.join(score, [key, "name", "uri"], "left").select(key, "name", "uri", F.coalesce("score", F.lit(0.0)).alias("score"))


def spot_belief(candidates: DataFrame, docs: DataFrame, text: str = "text") -> DataFrame:
    """(name, belief): candidates of the name over the texts that hold all its words, to four places; a name in no text has none."""
    names = candidates.groupBy("name").agg(F.count(F.lit(1)).alias("c")).withColumn("w", F.array_distinct(T.lower_words(F.col("name")))).withColumn("k", F.size("w"))
    held = cut(docs.select(F.monotonically_increasing_id().alias("__d"), F.array_distinct(T.lower_words(F.col(text))).alias("__w")))
    return with_all_terms(names, held).groupBy("name").agg(F.first("c").alias("c"), F.count(F.lit(1)).alias("d")).select("name", F.round(F.col("c") / F.col("d"), 4).alias("belief"))


def with_all_terms(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """(queries…, __d): every query (w: its distinct terms, k: how many) with every text (__d, __w) that holds them all.

    The texts are looked up by the query's rarest term only, then checked for the others in the same row: frequent
    terms never bring their long lists of texts together.
    """
    df = docs.select(F.explode("__w").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("__df"))
    asked = queries.filter(F.col("k") > 0)
    terms = asked.select("name", F.explode("w").alias("token")).join(df, "token", "left")
    rarest = terms.groupBy("name").agg(F.min_by("token", F.struct(F.coalesce("__df", F.lit(0)), F.col("token"))).alias("token"), F.min(F.coalesce("__df", F.lit(0))).alias("__least"))
    lists = docs.select("__d", F.explode("__w").alias("token"))
    met = rarest.filter(F.col("__least") > 0).join(lists, "token").select("name", "__d").join(asked, "name").join(docs, "__d")
    return met.filter(F.size(F.array_intersect("w", "__w")) == F.col("k")).drop("__w")


def custom_scores(candidates: DataFrame, scores: DataFrame) -> DataFrame:
    """Candidates with given scores by resource; those without one have 0."""
    return candidates.join(scores.select("uri", "score"), "uri", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def random_scores(candidates: DataFrame, seed: int = 7, mean: float = 100.0, deviation: float = 5.0) -> DataFrame:
    """Candidates with random scores of a normal distribution, drawn from a hash of name and resource, so a row keeps its score when its task runs again."""
    at = lambda k: (F.pmod(F.xxhash64("name", "uri", F.lit(seed), F.lit(k)), F.lit(1_000_003)) + 1) / 1_000_004.0
    return candidates.withColumn("score", mean + deviation * F.sqrt(-2 * F.log(at(1))) * F.cos(2 * math.pi * at(2)))


def tfidf_similarity(texts: DataFrame, contexts: DataFrame, key: str, k: int, query_terms: int | None = None) -> DataFrame:
    """(key, uri, score, rank): the resources whose contexts are most like the text, by cosine of tf * idf weights.

    All words of a text count. With ``query_terms`` a text is represented by its so many weightiest words
    only, as in a more-like-this query. To six places, so that what is equal but for the order of its sum ties.
    """
    n_docs = contexts.agg(F.count_distinct("uri")).first()[0]
    df = numbered_terms(contexts)
    small = df.count() <= SENT_TERMS
    met = F.broadcast(df) if small else df
    # texts are placed by key once; their words are counted, weighed and gathered there
    words = texts.select(key, "text").repartition(partitions(texts), key).select(key, F.explode(T.lower_words(F.col("text"))).alias("token"))
    query = words.groupBy(key, "token").agg(F.count(F.lit(1)).alias("tf")).join(met, "token").withColumn("qw", F.round(F.sqrt("tf") * F.log(n_docs / F.col("df")), 9))
    if query_terms is not None:
        order = Window.partitionBy(key).orderBy(F.desc("qw"), "token")
        query = query.withColumn("__r", F.row_number().over(order)).filter(F.col("__r") <= query_terms)
    query = query.groupBy(key).agg(F.collect_list(F.struct("term", "qw")).alias("q")).select(key, F.col("q.term").alias("terms"), F.col("q.qw").alias("weights"))
    weighted = contexts.join(met, "token").withColumn("w", F.sqrt("n") * F.log(n_docs / F.col("df"))).filter(F.col("w") > 0)
    norm = cut(weighted.groupBy("uri").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm")))
    named = cut(with_ids(norm, "uri", "id").select("uri", "norm", (F.col("id") - 1).alias("resource")))
    sent = F.broadcast(named) if named.count() <= SENT_TERMS else named
    index = weighted.join(sent, "uri").select("term", "resource", (F.col("w") / F.col("norm")).alias("weight"))
    got = most_alike(query, index, key, k)
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "resource"))
    return got.withColumn("rank", rank).filter(F.col("rank") <= k).join(named.select("resource", "uri"), "resource").select(key, "uri", F.round("score", 6).alias("score"), "rank")


def numbered_terms(contexts: DataFrame) -> DataFrame:
    """(token, df, term): the words of contexts with the number of resources that hold them, numbered from 1; written once."""
    return cut(with_ids(contexts.groupBy("token").agg(F.count(F.lit(1)).alias("df")), "token", "term").select("token", "df", F.col("term").cast("int").alias("term")))


def overlaps(spans: DataFrame, group: str, key: str) -> DataFrame:
    """Spans (group, key, start, length) with ``meets`` (begins before one that began earlier has ended) and ``inside`` (ends within it).

    One running maximum of the ends in order of start, longer first: as much as a join of intervals tells about each
    span, without their pairs.
    """
    stop = F.col("start") + F.col("length")
    w = Window.partitionBy(group).orderBy("start", F.desc(stop), key).rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max(stop).over(w)
    return spans.withColumn("meets", F.coalesce(reach > F.col("start"), F.lit(False))).withColumn("inside", F.coalesce(reach >= stop, F.lit(False)))


def reranked(links: DataFrame, keys: list[str], weight: Column) -> DataFrame:
    """Candidates ranked anew by a mixture of their features; ``next`` is the share of the next one, -1 for the last. Ties by uri."""
    w = Window.partitionBy(*keys).orderBy(F.desc("mixed"), "uri")
    got = links.withColumn("mixed", weight)
    return got.withColumn("rank", F.row_number().over(w)).withColumn("next", F.coalesce(F.try_divide(F.lead("mixed").over(w), F.col("mixed")), F.lit(-1.0)))
