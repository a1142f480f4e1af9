"""Token bags of resources: '{(token,n),…}' and JSON, written and parsed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_pig(contexts: DataFrame) -> DataFrame:
    """(uri, bag) from (uri, token, n)."""
    items = F.array_sort(F.collect_list(F.concat(F.lit("("), "token", F.lit(","), F.col("n").cast("string"), F.lit(")"))))
    return contexts.groupBy("uri").agg(F.concat(F.lit("{"), F.array_join(items, ","), F.lit("}")).alias("bag"))


def parse_pig(bags: DataFrame, least: int = 0, strict: bool = False) -> DataFrame:
    """(uri, token, n) of counts of at least (strictly more than) ``least``; what isn't a pair is skipped."""
    pairs = F.regexp_extract_all("bag", F.lit("\\(([^(),]*),[0-9]+\\)"), F.lit(1))
    counts = F.regexp_extract_all("bag", F.lit("\\([^(),]*,([0-9]+)\\)"), F.lit(1))
    rows = bags.select("uri", F.explode(F.arrays_zip(pairs.alias("token"), counts.alias("n"))).alias("p")).select("uri", "p.token", F.col("p.n").try_cast("long").alias("n"))
    return rows.filter(F.col("n") > least if strict else F.col("n") >= least)


def write_json(contexts: DataFrame) -> DataFrame:
    return contexts.groupBy("uri").agg(F.to_json(F.collect_list(F.struct("token", "n"))).alias("bag"))


def parse_json(bags: DataFrame, least: int = 0) -> DataFrame:
    rows = bags.select("uri", F.explode(F.from_json("bag", "array<struct<token:string,n:bigint>>")).alias("p")).select("uri", "p.token", "p.n")
    return rows.filter(F.col("n") >= least)
