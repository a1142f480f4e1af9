"""Reproducible splits of occurrences into train and test rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kedge.operators.skew import numbered, salted_join


def split_by_pair(occs: DataFrame, ratio: float) -> DataFrame:
    """(occ_id, part): of each form and resource the first round(n * ratio) to test; forms of one resource train."""
    rows = occs.filter(F.col("uri").isNotNull() & F.col("surface_form").isNotNull()).select("occ_id", "surface_form", "uri")
    group = Window.partitionBy("surface_form", "uri")
    ambiguous = rows.groupBy("surface_form").agg(F.count_distinct("uri").alias("c"))
    ranked = rows.withColumn("k", F.row_number().over(group.orderBy("occ_id"))).withColumn("n", F.count(F.lit(1)).over(group)).join(ambiguous, "surface_form")
    test = (F.col("c") > 1) & (F.col("k") <= F.floor(F.col("n") * ratio + 0.5))
    return ranked.select("occ_id", F.when(test, "test").otherwise("train").alias("part"))


def split_groups(rows: DataFrame, group: str, order: str, least: int, every: int) -> DataFrame:
    """Groups of at least ``least`` rows, every ``every``-th row of each to test, in order of a numeric, unique column; no group is sorted as a whole."""
    kept = rows.filter(F.col(group).isNotNull()).select(order, group)
    sizes = kept.groupBy(F.col(group).alias("__g")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    got = numbered(salted_join(kept, sizes, group, "__g", spread=[order]), group, order).withColumnRenamed("position", "k")
    return got.select(order, group, "k", F.when(F.col("k") % every == 0, "test").otherwise("train").alias("part"))
