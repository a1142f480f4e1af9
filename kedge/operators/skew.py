"""Aggregation and joins on keys of which a few hold most rows.

A key is *heavy* if it holds more than one ``pieces``-th of all rows, so there are fewer than
``pieces`` heavy keys whatever the size of the data: that bound is what makes the broadcast of the
heavy keys safe. The counting pass has a map-side combine, so it isn't hurt by the keys it looks for.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kedge.session import partitions

#: Shuffle partitions times this is the number of pieces into which the rows are thought divided.
PIECES_PER_PARTITION = 2
#: Parts into which ``numbered`` divides the rows at most; each row is compared with every cut.
MAX_QUANTILES = 200


@dataclass(frozen=True)
class Agg:
    """An aggregate in two stages: ``partial`` over the rows of a key and salt, ``merge`` over the partials."""

    name: str
    partial: Column
    merge: str  # name of the built-in that merges two partials

    def merged(self) -> Column:
        return getattr(F, self.merge)(F.col(self.name)).alias(self.name)


def count_of(name: str = "n") -> Agg:
    return Agg(name, F.count(F.lit(1)), "sum")


def sum_of(column: str | Column, name: str) -> Agg:
    return Agg(name, F.sum(column), "sum")


def min_of(column: str | Column, name: str) -> Agg:
    return Agg(name, F.min(column), "min")


def max_of(column: str | Column, name: str) -> Agg:
    return Agg(name, F.max(column), "max")


def heavy_keys(df: DataFrame, keys: Sequence[str], pieces: int | None = None) -> DataFrame:
    """``keys`` and ``__salts``: the keys with more than one ``pieces``-th of the rows, and into how many
    parts each must be split so that none of them is larger than that. Fewer than ``pieces`` rows.
    """
    pieces = pieces or PIECES_PER_PARTITION * partitions(df)
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    total = counts.agg(F.sum("__n")).scalar()
    return counts.filter(F.col("__n") * pieces > total).select(*keys, F.ceil(F.col("__n") * pieces / total).cast("int").alias("__salts"))


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str], names: Sequence[str]) -> Column:
    cond = F.lit(True)
    for a, b in zip(keys, names, strict=True):
        cond = cond & left[a].eqNullSafe(right[b])
    return cond


def with_salt(df: DataFrame, keys: Sequence[str], heavy: DataFrame, spread: Sequence[str] | None) -> DataFrame:
    """Add ``__salts`` (null for ordinary keys) and a ``__salt`` below it.

    ``spread`` names columns whose hash spreads the rows of one key (an id): the salt is then the same
    when a task runs again. Without it the salt is a seeded random number.
    """
    renamed = heavy.select(*[F.col(k).alias(f"__h{i}") for i, k in enumerate(keys)], "__salts")
    names = [f"__h{i}" for i in range(len(keys))]
    joined = df.join(F.broadcast(renamed), _same(df, renamed, keys, names), "left").drop(*names)
    roll = F.pmod(F.xxhash64(*spread), F.col("__salts")) if spread else F.floor(F.rand(7) * F.col("__salts"))
    return joined.withColumn("__salt", F.coalesce(roll.cast("int"), F.lit(0)))


def salted_aggregate(df: DataFrame, keys: Sequence[str], aggs: Sequence[Agg], spread: Sequence[str] | None = None, pieces: int | None = None) -> DataFrame:
    """Aggregate in two stages: per key and salt, then per key.

    Heavy keys get a random salt, so their rows meet in many tasks; what is merged by the original
    key is at most one row per salt. A null key is a key like any other (as in GROUP BY); an empty
    table gives an empty result; null values are ignored as the built-in aggregates do; columns
    that aren't asked for don't reach the shuffle.
    """
    salted = with_salt(df, keys, heavy_keys(df, keys, pieces), spread)
    partial = salted.groupBy(*keys, "__salt").agg(*[a.partial.alias(a.name) for a in aggs])
    return partial.groupBy(*keys).agg(*[a.merged() for a in aggs])


def salted_count_distinct(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Distinct non-null values per key. The values themselves spread a heavy key: equal ones meet, and no others must."""
    pairs = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.lit(1).alias("__one"))
    return pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def salted_join(
    left: DataFrame,
    right: DataFrame,
    left_key: str,
    right_key: str,
    how: str = "inner",
    heavy: DataFrame | None = None,
    spread: Sequence[str] | None = None,
    pieces: int | None = None,
) -> DataFrame:
    """Join a side with heavy keys (left) to one with few rows a key (right); ``how`` is inner or left.

    The rows of a heavy key are divided among its salts, and the few matching rows of the right side
    are repeated once per salt. A null key meets nothing.
    """
    heavy = heavy_keys(left.filter(F.col(left_key).isNotNull()), [left_key], pieces) if heavy is None else heavy
    a = with_salt(left, [left_key], heavy, spread)
    named = heavy.select(F.col(left_key).alias("__hk"), F.col("__salts").alias("__rs"))
    b = right.join(F.broadcast(named), F.col(right_key) == F.col("__hk"), "left")
    b = b.withColumn("__rsalt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__rs"), F.lit(1)) - 1))).drop("__hk", "__rs")
    return a.join(b, (a[left_key] == b[right_key]) & (a["__salt"] == b["__rsalt"]), how).drop("__salt", "__salts", "__rsalt")


def numbered(df: DataFrame, key: str, order: str, pieces: int | None = None) -> DataFrame:
    """Add ``position``, from 1 in order of a numeric, unique column, among the rows of each key.

    The quantiles of ``order`` divide all rows into parts of about the same size, so no task sorts more
    than such a part of a hot key; a part's rows come after those of the key's parts before it. The rows
    move once for both the numbers and the join. Rows whose key is null are left out.
    """
    pieces = min(MAX_QUANTILES, pieces or PIECES_PER_PARTITION * partitions(df))
    cuts = sorted(set(df.approxQuantile(order, [i / pieces for i in range(1, pieces)], 1 / (4 * pieces)))) if pieces > 1 else []
    part = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col(order).cast("double"))) if cuts else F.lit(0)
    rows = df.filter(F.col(key).isNotNull()).withColumn("__part", part)
    sizes = rows.groupBy(key, "__part").agg(F.count(F.lit(1)).alias("__n"))
    earlier = F.sum("__n").over(Window.partitionBy(key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    before = sizes.select(F.col(key).alias("__k"), F.col("__part").alias("__q"), F.coalesce(earlier, F.lit(0)).alias("__before"))
    inside = rows.withColumn("__i", F.row_number().over(Window.partitionBy(key, "__part").orderBy(order)))
    met = inside.join(before, (inside[key] == before["__k"]) & (inside["__part"] == before["__q"]))
    return met.withColumn("position", F.col("__before") + F.col("__i")).drop("__part", "__n", "__i", "__k", "__q", "__before")


def share_of_total(grouped: DataFrame, value: str, share: float) -> DataFrame:
    """The rows whose ``value`` is at least ``share`` of the column's sum; none if that sum is null or 0."""
    total = grouped.agg(F.sum(value)).scalar()
    return grouped.filter((F.col(value) > 0) & (F.col(value) >= F.lit(share) * total))
