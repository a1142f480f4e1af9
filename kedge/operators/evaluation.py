"""Comparing predictions with gold data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def gold_ranks(gold: DataFrame, ranked: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, uri, gold_rank): the rank of the right entity among the predicted, 0 when it isn't there."""
    hit = ranked.select(*keys, "uri", F.col("rank").alias("gold_rank"))
    return gold.join(hit, [*keys, "uri"], "left").select(*keys, "uri", F.coalesce("gold_rank", F.lit(0)).alias("gold_rank"))


def ranking_summary(ranks: DataFrame, by: Sequence[str] = (), most: int = 100) -> DataFrame:
    """Mentions, share found among the first ``most``, accuracy and mean reciprocal rank; 0 ranks count as not found."""
    found = (F.col("gold_rank") > 0) & (F.col("gold_rank") <= most)
    return ranks.groupBy(*by).agg(
        F.count(F.lit(1)).alias("mentions"), F.avg(found.cast("double")).alias("found"), F.avg((F.col("gold_rank") == 1).cast("double")).alias("accuracy"),
        F.avg(F.when(F.col("gold_rank") > 0, 1 / F.col("gold_rank")).otherwise(0.0)).alias("mrr"),
    )


def set_scores(gold: DataFrame, predicted: DataFrame, keys: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """True and false positives, false negatives, precision, recall and F1 of two sets of keys; 0 where a share has no ground."""
    g = gold.select(*keys).distinct().withColumn("g", F.lit(1))
    p = predicted.select(*keys).distinct().withColumn("p", F.lit(1))
    met = g.join(p, list(keys), "full_outer")
    n = met.groupBy(*by).agg(F.sum(F.coalesce(F.col("g") * F.col("p"), F.lit(0))).alias("tp"), F.sum(F.when(F.col("g").isNull(), 1).otherwise(0)).alias("fp"), F.sum(F.when(F.col("p").isNull(), 1).otherwise(0)).alias("fn"))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    scored = n.withColumn("precision", share(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", share(F.col("tp"), F.col("tp") + F.col("fn")))
    return scored.withColumn("f1", share(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))


def grid_scores(gold: DataFrame, links: DataFrame, keys: Sequence[str], supports: Sequence[int], confidences: Sequence[float]) -> DataFrame:
    """Precision and recall for each pair of parameters: the links are counted once per cell they pass, in one aggregation."""
    cells = F.array(*[F.struct(F.lit(s).alias("min_support"), F.lit(float(c)).alias("min_confidence")) for s in sorted(set(supports)) for c in sorted(set(confidences))])
    met = links.join(gold.select(*keys).distinct().withColumn("g", F.lit(1)), list(keys), "left")
    passing = met.select("g", "support", "final_score", F.explode(cells).alias("c")).filter((F.col("support") > F.col("c.min_support")) & (F.col("final_score") >= F.col("c.min_confidence")))
    n_gold = gold.select(*keys).distinct().agg(F.count(F.lit(1))).scalar()
    got = passing.groupBy("c.min_support", "c.min_confidence").agg(F.sum(F.coalesce("g", F.lit(0))).alias("tp"), F.count(F.lit(1)).alias("predicted"))
    return got.select("min_support", "min_confidence", "tp", "predicted", (F.col("tp") / F.col("predicted")).alias("precision"), (F.col("tp") / n_gold).alias("recall"))


def offset_check(occs: DataFrame) -> DataFrame:
    """(stands, n): whether forms stand in their context at their offset."""
    stands = F.substr(F.col("context"), F.col("text_offset") + 1, F.char_length("surface_form")) == F.col("surface_form")
    return occs.groupBy(F.coalesce(stands & (F.col("text_offset") >= 0), F.lit(False)).alias("stands")).agg(F.count(F.lit(1)).alias("n"))


def with_nil_credit(gold: DataFrame, links: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """One row: gold mentions (key, name, gold), those linked right, and those without a link whose resource isn't among
    the known candidates (name, uri) of their name, which no linker could have found."""
    met = gold.join(links.select(key, "uri"), key, "left").join(known.select("name", F.col("uri").alias("gold")).distinct().withColumn("__k", F.lit(True)), ["name", "gold"], "left")
    right = F.count_if(F.coalesce(F.col("uri") == F.col("gold"), F.lit(False)))
    return met.agg(F.count(F.lit(1)).alias("mentions"), right.alias("right"), F.count_if(F.col("uri").isNull() & F.col("__k").isNull()).alias("right_nils"))


def batch_summary(gold: DataFrame, spottable: DataFrame, ambiguity: DataFrame, best: DataFrame) -> DataFrame:
    """One row: gold mentions (name, uri), those whose name a spotter knows, of them the ambiguous ones and those that ``best`` (name, best) gets right."""
    met = gold.join(spottable.select("name").distinct().withColumn("__s", F.lit(True)), "name", "left").join(ambiguity, "name", "left").join(best, "name", "left")
    seen = F.col("__s").isNotNull()
    return met.agg(
        F.count(F.lit(1)).alias("gold"), F.count_if(seen).alias("spotted"), F.count_if(seen & (F.col("ambiguity") > 1)).alias("ambiguous"),
        F.count_if(seen & F.coalesce(F.col("best") == F.col("uri"), F.lit(False))).alias("matched"),
    )


def sets_by_interval(links: DataFrame, supports: Sequence[int], confidences: Sequence[float]) -> DataFrame:
    """(min_support, min_confidence, uri): the set of resources for each pair of parameters, in one pass over the links."""
    cells = F.array(*[F.struct(F.lit(s).alias("min_support"), F.lit(float(c)).alias("min_confidence")) for s in sorted(set(supports)) for c in sorted(set(confidences))])
    each = links.select("uri", "support", "final_score", F.explode(cells).alias("c")).filter((F.col("support") > F.col("c.min_support")) & (F.col("final_score") >= F.col("c.min_confidence")))
    return each.select("c.min_support", "c.min_confidence", "uri").distinct()


def kept_by_class(spots: DataFrame, kept: DataFrame, by: str) -> DataFrame:
    """(class, spots, kept): spots of each class and those that a selector keeps."""
    every = spots.groupBy(by).agg(F.count(F.lit(1)).alias("spots"))
    left = kept.groupBy(by).agg(F.count(F.lit(1)).alias("kept"))
    return every.join(left, by, "left").select(by, "spots", F.coalesce("kept", F.lit(0)).alias("kept"))


def best_tags(links: DataFrame, words: DataFrame, key: str, share: float = 0.06) -> DataFrame:
    """(key, uri): of each text the tags with the largest sums of scores, as many as ``share`` of its words and no more than its links."""
    sums = links.groupBy(key, "uri").agg(F.round(F.sum("final_score"), 4).alias("value"), F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(key)
    ranked = sums.withColumn("k", F.row_number().over(w.orderBy(F.desc("value"), "uri"))).withColumn("links", F.sum("c").over(w)).join(words, key)
    return ranked.filter(F.col("k") <= F.least(F.col("links"), F.floor(share * F.col("words") + 0.5))).select(key, "uri")
