from collections import Counter

from pyspark.sql import functions as F

from kedge.operators import skew
from kedge.sources import sinks


def rows(spark):
    data = [("hot", i) for i in range(500)] + [(f"k{i % 40}", i) for i in range(400)] + [(None, i) for i in range(7)]
    return spark.createDataFrame(data, "k string, v long"), data


def test_salted_aggregate_equals_plain(spark):
    df, data = rows(spark)
    for spread in (["v"], None):
        got = {r["k"]: (r["n"], r["s"], r["lo"], r["hi"]) for r in skew.salted_aggregate(df, ["k"], [skew.count_of(), skew.sum_of("v", "s"), skew.min_of("v", "lo"), skew.max_of("v", "hi")], spread=spread).collect()}
        keys = {k for k, _ in data}
        assert got == {k: (len(x), sum(x), min(x), max(x)) for k in keys for x in [[v for a, v in data if a == k]]}


def test_heavy_keys_are_few_and_split(spark):
    df, data = rows(spark)
    got = {r["k"]: r["__salts"] for r in skew.heavy_keys(df, ["k"], pieces=4).collect()}
    assert set(got) == {"hot"} and got["hot"] >= 2
    salted = skew.with_salt(df, ["k"], skew.heavy_keys(df, ["k"], pieces=16), ["v"])
    assert salted.filter("k = 'hot'").select("__salt").distinct().count() > 3
    assert salted.count() == len(data)


def test_salted_join_equals_plain(spark):
    df, data = rows(spark)
    right = spark.createDataFrame([("hot", 1), ("k1", 2), ("k1", 3), (None, 4)], "k2 string, w int")
    for how in ("inner", "left"):
        a = Counter(tuple(r) for r in skew.salted_join(df, right, "k", "k2", how, spread=["v"]).collect())
        b = Counter(tuple(r) for r in df.join(right, F.col("k") == F.col("k2"), how).collect())
        assert a == b


def test_empty(spark):
    df = spark.createDataFrame([], "k string, v long")
    assert skew.salted_aggregate(df, ["k"], [skew.count_of()]).count() == 0
    assert skew.share_of_total(skew.salted_aggregate(df, ["k"], [skew.count_of()]), "n", 0.01).count() == 0


def test_count_distinct_and_share(spark):
    df, _ = rows(spark)
    got = {r["k"]: r["d"] for r in skew.salted_count_distinct(df.withColumn("m", F.col("v") % 3), ["k"], "m", "d").collect()}
    assert got["hot"] == 3
    zeros = spark.createDataFrame([("a", 0), ("b", None)], "k string, n long")
    assert skew.share_of_total(zeros, "n", 0.01).count() == 0


def test_contexts_of_a_hot_resource_come_out_in_order(spark):
    data = [(i * i, "hot" if i % 3 else f"u{i % 7}", f"f{i}", f"context {i}") for i in range(300)] + [(-1, None, "f", "c"), (-2, "hot", None, None), (-3, "hot", None, "")]
    df = spark.createDataFrame(data, "occ_id long, uri string, surface_form string, context string")
    got = [tuple(r) for r in sinks.merged_contexts(df).collect()]
    want = {}
    for _, u, f, c in sorted((r for r in data if r[1] is not None and r[3] is not None), key=lambda r: r[0]):
        want.setdefault(u, []).append((f, c))
    assert got == [(u, i, f, c) for u in sorted(want) for i, (f, c) in enumerate(want[u], 1)]
    assert skew.numbered(df.limit(0), "uri", "occ_id").count() == 0
