import os

import pytest
from pyspark.sql import functions as F

from kedge import session as s
from kedge.streaming import feeds


def test_only_tables_of_cut_are_dropped(spark, tmp_path):
    mine = str(tmp_path / "mine")
    spark.range(3).write.parquet(mine)
    with pytest.raises(ValueError):
        s.drop(spark.read.parquet(mine))
    assert spark.read.parquet(mine).count() == 3
    t = s.cut(spark.range(5))
    folder = t.cut_path.removeprefix("file:")
    assert t.count() == 5 and os.path.isdir(folder)
    s.drop(t)
    assert not os.path.exists(folder)


def test_counted_cut(spark):
    t, n = s.cut_counted(spark.range(10), even=F.col("id") % 2 == 0, none=F.col("id") < 0)
    assert n == {"even": 5, "none": 0} and t.count() == 10
    assert s.cut_counted(spark.range(0), any=F.col("id") >= 0)[1] == {"any": 0}


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError, match="checkpoint"):
        s.scratch(Session())


def test_new_items_whatever_the_order_of_files(spark, tmp_path):
    where = str(tmp_path / "feed")
    for k, rows in enumerate(([(1, "2024-01-05 00:00:00"), (2, "2024-01-06 00:00:00")], [(3, "2024-01-01 00:00:00"), (1, "2024-01-05 00:00:00")])):
        spark.createDataFrame(rows, "id long, at string").withColumn("at", F.to_timestamp("at")).coalesce(1).write.mode("append" if k else "overwrite").parquet(where)
    stream = feeds.replay(spark, where)
    assert sorted(r["id"] for r in feeds.collected(feeds.new_items(stream, "id", "at", delay=None)).collect()) == [1, 2, 3]
    late = feeds.new_items(feeds.replay(spark, where), "id", "at", delay=None, since="2024-01-04 00:00:00")
    assert sorted(r["id"] for r in feeds.collected(late).collect()) == [1, 2]
    total = feeds.collected(feeds.replay(spark, where).groupBy().agg(F.count(F.lit(1)).alias("n")), "complete")
    assert total.collect()[0]["n"] == 4


def test_registry(spark):
    r = feeds.Registry()
    r.add("a", spark.range(1).withColumn("x", F.lit(1)))
    r.add("b", spark.range(1))
    assert set(r.with_columns("id")) == {"a", "b"} and set(r.within_columns("id")) == {"b"}
