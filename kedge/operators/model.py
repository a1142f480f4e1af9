"""Count tables of a knowledge base from raw rows: surface forms, resources, candidates, tokens, contexts.

Every table is one aggregation of the raw rows with a map-side combine; ids come from an order by
name, so that builds repeat. Nothing here depends on the number of partitions.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kedge.functions import text as T
from kedge.functions.scalars import types_of_csv
from kedge.operators.skew import salted_join
from kedge.session import cut, free_shuffles, spread

# Thresholds of the build.
MIN_ANNOTATED, MIN_CONTEXT, MIN_ANNOTATION_PROBABILITY = 2, 3, 0.05
NGRAM_DISCOUNT = 1.25


def surface_form_counts(rows: DataFrame) -> DataFrame:
    """(name, annotated, total): lower-case rows (annotated -1) and null names are left out, repeated names are
    summed; a total that is null or not positive counts as unknown, -1."""
    kept = rows.filter(F.col("name").isNotNull() & (F.col("annotated_count") >= 0))
    total = F.sum(F.when(F.col("total_count") > 0, F.col("total_count")))
    return kept.groupBy("name").agg(F.sum("annotated_count").cast("long").alias("annotated"), F.coalesce(total, F.lit(-1)).cast("long").alias("total"))


def lowercase_counts(rows: DataFrame, order: str = "sf_id") -> DataFrame:
    """(lower, lower_count): the rows with annotated -1; of several, the last by ``order``."""
    kept = rows.filter(F.col("name").isNotNull() & (F.col("annotated_count") == -1))
    return kept.groupBy(F.lower("name").alias("lower")).agg(F.max_by("total_count", order).cast("long").alias("lower_count"))


def annotation_probability(annotated: Column, total: Column) -> Column:
    """annotated / total; 1 where the total is unknown (-1), 0 where it is 0 or null."""
    return F.when(total == -1, 1.0).when((total == 0) | total.isNull(), 0.0).otherwise(annotated / total)


def with_ids(df: DataFrame, order: str, name: str) -> DataFrame:
    """Dense ids from 1 in the order of a column: range partitions are numbered one by one, not all rows in one task.

    The partitions' numbers are written with the rows before they are used twice, since a plan that is run
    again may cut the ranges elsewhere.
    """
    ranked = cut(df.repartitionByRange(F.col(order)).withColumn("__p", F.spark_partition_id()))
    inside = ranked.withColumn("__i", F.row_number().over(Window.partitionBy("__p").orderBy(order)))
    sizes = inside.groupBy("__p").agg(F.count(F.lit(1)).alias("__c"))
    before = sizes.withColumn("__b", F.coalesce(F.sum("__c").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("__p", "__b")
    return inside.join(F.broadcast(before), "__p").withColumn(name, (F.col("__b") + F.col("__i")).cast("long")).drop("__p", "__i", "__b")


def surface_form_store(counts: DataFrame, minimum: int = MIN_ANNOTATED) -> DataFrame:
    """(sf_id, name, annotated, total) of the forms annotated often enough, ids from 1 by name."""
    return with_ids(counts.filter(F.col("annotated") >= minimum), "name", "sf_id").select("sf_id", "name", "annotated", "total")


def lowercase_map(store: DataFrame, lower: DataFrame, minimum: int = MIN_ANNOTATED) -> DataFrame:
    """(lower, lower_count, sf_id): forms reached by their lower case where the lower-case form itself is missing or rare."""
    own = store.select(F.col("name").alias("__l"), F.col("annotated").alias("__a"))
    forms = store.withColumn("lower", F.lower("name")).join(own, F.col("lower") == F.col("__l"), "left")
    return forms.filter(F.col("__a").isNull() | (F.col("__a") <= minimum)).join(lower, "lower").select("lower", "lower_count", "sf_id")


def corrected_totals(counts: DataFrame) -> DataFrame:
    """(name, total, corrected): a form's total without its uses inside longer forms: total - sum(floor(1.25 * annotated)), 1 at least where it was positive."""
    forms = counts.withColumn("w", F.split("name", " "))
    sizes = F.sequence(F.lit(1), F.size("w") - 1)
    at = lambda n: F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " "))
    inner = forms.filter(F.size("w") > 1).select("annotated", F.explode(F.array_distinct(F.flatten(F.transform(sizes, at)))).alias("sub"))
    less = inner.groupBy(F.col("sub").alias("name")).agg(F.sum(F.floor(F.col("annotated") * NGRAM_DISCOUNT)).alias("less"))
    got = F.col("total") - F.coalesce("less", F.lit(0))
    return counts.join(less, "name", "left").select("name", "total", F.when(F.col("total") > 0, F.greatest(got, F.lit(1))).otherwise(F.col("total")).cast("long").alias("corrected"))


def resource_counts(slices: DataFrame) -> DataFrame:
    """(uri, support, types): counts summed over slices, type ids distinct and sorted; without positive count dropped."""
    counts = slices.filter(F.col("uri").isNotNull()).groupBy("uri").agg(
        F.sum("uri_count").alias("support"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(types_of_csv(F.col("types")))))).alias("types")
    )
    return counts.filter(F.col("support") > 0)


def pair_counts(occs: DataFrame) -> DataFrame:
    """(name, uri, n) of the occurrences that have both."""
    return occs.filter(F.col("surface_form").isNotNull() & F.col("uri").isNotNull()).groupBy(F.col("surface_form").alias("name"), "uri").agg(F.count(F.lit(1)).alias("n"))


def forms_of_pairs(pairs: DataFrame) -> DataFrame:
    """(name, annotated, total) where no counts are given: annotated uses, and with them the uses of the lower-case form."""
    uses = pairs.groupBy("name").agg(F.sum("n").alias("annotated"))
    low = uses.select(F.col("name").alias("__l"), F.col("annotated").alias("__a"))
    met = uses.join(low, (F.lower("name") == F.col("__l")) & (F.col("name") != F.col("__l")), "left")
    return met.select("name", "annotated", (F.col("annotated") + F.coalesce("__a", F.lit(0))).alias("total"))


def candidates(pairs: DataFrame, resources: DataFrame) -> DataFrame:
    """(name, uri, n, annotated, support, prior): pairs whose resource is known, with P(resource | name)."""
    per_name = pairs.groupBy("name").agg(F.sum("n").alias("annotated"))
    return pairs.join(per_name, "name").join(resources.select("uri", "support"), "uri").select("name", "uri", "n", "annotated", "support", (F.col("n") / F.col("annotated")).alias("prior"))


def context_counts(occs: DataFrame, minimum: int = 1) -> DataFrame:
    """(uri, token, n): lower-case words of the contexts of each resource.

    The words are counted per context first, so a resource with a third of all rows is combined in
    many tasks before its counts meet.
    """
    tokens = spread(occs.filter(F.col("uri").isNotNull()).select("uri", "context")).select("uri", F.explode(T.lower_words(F.col("context"))).alias("token"))
    return tokens.groupBy("uri", "token").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= minimum)


def token_types(contexts: DataFrame) -> DataFrame:
    """(token, n) over all resources."""
    return contexts.groupBy("token").agg(F.sum("n").alias("n"))


def context_totals(contexts: DataFrame) -> DataFrame:
    return contexts.groupBy("uri").agg(F.sum("n").alias("total"))


def totals(tokens: DataFrame, resources: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row: number of tokens, vocabulary size, sum of supports, sum of annotations."""
    return tokens.agg(F.sum("n").alias("n_tokens"), F.count(F.lit(1)).alias("vocabulary")).select(
        "n_tokens", "vocabulary", resources.agg(F.sum("support")).scalar().alias("support"), pairs.agg(F.sum("n")).scalar().alias("annotated")
    )


def lexicalisations(pairs: DataFrame, minimum: int = 1) -> DataFrame:
    """(name, uri, n, p_name_given_uri, p_uri_given_name, p_uri, pmi) of pairs seen often enough; sums are over all pairs."""
    total = pairs.agg(F.sum("n")).scalar()
    by_uri = pairs.groupBy("uri").agg(F.sum("n").alias("n_uri"))
    by_name = pairs.groupBy("name").agg(F.sum("n").alias("n_name"))
    got = salted_join(pairs, by_uri.withColumnRenamed("uri", "__u"), "uri", "__u", spread=["name"]).join(by_name, "name")
    return got.filter(F.col("n") >= minimum).select(
        "name", "uri", "n", (F.col("n") / F.col("n_uri")).alias("p_name_given_uri"), (F.col("n") / F.col("n_name")).alias("p_uri_given_name"), (F.col("n_uri") / total).alias("p_uri"),
        F.log(F.col("n") * total / (F.col("n_uri") * F.col("n_name"))).alias("pmi"),
    )


@dataclass
class Model:
    """The tables of a built model."""

    forms: DataFrame
    lower: DataFrame
    resources: DataFrame
    pairs: DataFrame
    candidates: DataFrame
    contexts: DataFrame
    tokens: DataFrame


def build(occs: DataFrame, slices: DataFrame, names: DataFrame, write: Callable[[DataFrame], DataFrame] = lambda df: df) -> Model:
    """All count tables of a model; ``write`` (``session.cut``) writes each once, so that what links with them reads
    tables and counts no context again. Without it they are lazy plans, right where a query needs one of them."""
    resources, pairs, contexts = write(resource_counts(slices)), write(pair_counts(occs)), write(context_counts(occs))
    if write is cut:
        free_shuffles(occs.sparkSession)
    return Model(surface_form_counts(names), lowercase_counts(names), resources, pairs, write(candidates(pairs, resources)), contexts, write(token_types(contexts)))


def save(built: Model, folder: str) -> None:
    """Every table of a model as Parquet, those met by uri or name in its order, so that readers skip files."""
    order = {"forms": "name", "lower": "lower", "resources": "uri", "pairs": "name", "candidates": "name", "contexts": "uri", "tokens": "token"}
    for f in fields(built):
        getattr(built, f.name).repartitionByRange(order[f.name]).sortWithinPartitions(order[f.name]).write.mode("overwrite").parquet(f"{folder}/{f.name}")


def load(spark: SparkSession, folder: str) -> Model:
    """The model that ``save`` wrote; a missing table is an error."""
    return Model(**{f.name: spark.read.parquet(f"{folder}/{f.name}") for f in fields(Model)})


def resolved(occs: DataFrame, closure: DataFrame) -> DataFrame:
    """Occurrences with redirecting uris by their final titles, so that the counts of both meet.

    ``closure`` is what ``hierarchy.resolve`` gives; a uri on a circle or running into one stays, as it has no final
    title, and so does an unknown one. Null uris stay null.
    """
    to = closure.filter((F.col("kind") == "tree") & (F.col("depth") > 0)).select(F.col("node").alias("__n"), F.col("root").alias("__r"))
    met = salted_join(occs, to, "uri", "__n", "left")
    return met.withColumn("uri", F.coalesce("__r", "uri")).drop("__n", "__r")
