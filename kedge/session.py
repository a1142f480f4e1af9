"""Session settings, reading of tables and cutting of lineage."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def local_session(cores: str = "8", name: str = "kedge") -> SparkSession:
    """A session for tests and the bench; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """The shared folder for tables that cut lineage: the session's ``spark.checkpoint.dir``.

    Only where none is set and the session is local, as in tests, a temporary folder stands in: on a
    cluster every executor would write to a disk of its own, and the tables would come back empty, so
    that is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(os.path.join(tempfile.gettempdir(), "kedge-checkpoints"))
    return f"{sc.getCheckpointDir()}/tables"


def own_folder(spark: SparkSession, prefix: str = "") -> str:
    """A new path in the shared folder, deleted when the process ends."""
    path = f"{scratch(spark)}/{prefix}{uuid.uuid4().hex}"

    def forget() -> None:
        with contextlib.suppress(Exception):
            delete(spark, path)

    atexit.register(forget)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table to the shared folder and go on from its files.

    A lost executor then costs nothing but its running tasks, and plans that are built in a loop
    stay small. The tables go when the process ends, or earlier through ``drop``.
    """
    path = own_folder(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def cut_counted(df: DataFrame, **counts: Column) -> tuple[DataFrame, dict[str, int]]:
    """``cut``, and for each name the number of rows for which its condition holds, counted while they are written."""
    seen = Observation()
    out = cut(df.observe(seen, *[F.count_if(c).alias(k) for k, c in counts.items()]))
    return out, seen.get


def drop(*tables: DataFrame) -> None:
    """Delete tables that ``cut`` wrote and nothing reads any more; any other DataFrame is an error, its files stay."""
    for df in tables:
        path = getattr(df, "cut_path", None)
        if path is None:
            raise ValueError("only a table that cut returned can be dropped")
        delete(df.sparkSession, path)


def free_shuffles(spark: SparkSession) -> None:
    """Let go of the shuffle files of what is done: Spark deletes them once the driver has collected its garbage, which by itself may take half an hour."""
    spark._jvm.System.gc()


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def spread(df: DataFrame) -> DataFrame:
    """``df`` for work that is heavy per row: over all cores, where a small file would keep it in a few tasks.

    Data in many files has more tasks than cores anyhow and isn't moved.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df._jdf.rdd().getNumPartitions() <= cores else df


def partitions(df: DataFrame) -> int:
    """The number of shuffle partitions of the session, the unit in which shares are reckoned."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def empty_like(spark: SparkSession, schema: str, rows: Iterable = ()) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)
