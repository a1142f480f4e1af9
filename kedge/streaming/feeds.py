"""Feeds as Structured Streaming: replay of tables, projections, paragraphs of page changes, de-duplication, windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kedge.functions import text as T
from kedge.session import delete, own_folder


def replay(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """A table's files as a stream."""
    schema = spark.read.parquet(path).schema
    folder = path if not path.endswith(".parquet") or _is_folder(spark, path) else path.rpartition("/")[0]
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    return reader.option("pathGlobFilter", path.rpartition("/")[2]).parquet(folder) if folder != path else reader.parquet(path)


def _is_folder(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory()


class Registry:
    """Feeds by the columns they deliver."""

    def __init__(self) -> None:
        self.feeds: dict[str, DataFrame] = {}

    def add(self, name: str, feed: DataFrame) -> None:
        self.feeds[name] = feed

    def with_columns(self, *columns: str) -> dict[str, DataFrame]:
        """The feeds that have all these columns, projected to them."""
        return {k: v.select(*columns) for k, v in self.feeds.items() if set(columns) <= set(v.columns)}

    def within_columns(self, *columns: str) -> dict[str, DataFrame]:
        """The feeds that have no other columns than these."""
        return {k: v for k, v in self.feeds.items() if set(v.columns) <= set(columns)}


def page_changes(pages: DataFrame, key: str, text: str) -> DataFrame:
    """(key, par, name, uri, offset): linked mentions of each paragraph; paragraphs without links are dropped."""
    pars = pages.select(key, F.posexplode(F.split(text, "\n+")).alias("par", "p")).filter(F.contains("p", F.lit("[[")))
    _, marks = T.mentions_in_brackets(F.col("p"))
    links = pars.select(key, "par", F.explode(F.arrays_zip(marks.alias("m"), T.wiki_links(F.col("p")).alias("l"))).alias("x"))
    return links.select(key, "par", F.col("x.l.name").alias("name"), F.col("x.l.uri").alias("uri"), F.col("x.m.offset").alias("offset"))


def new_items(items: DataFrame, key: str, at: str, delay: str | None = "1 hour", since: str | None = None) -> DataFrame:
    """Each item once, those after the poll mark ``since`` if one is given.

    With a ``delay`` the state is bounded by a watermark, and items later than that are dropped as any feed
    must. ``delay`` None keeps every key: right for a replay, which ends, and whatever the order of its files.
    """
    fresh = items if since is None else items.filter(F.col(at) > F.lit(since).cast("timestamp"))
    return fresh.dropDuplicates([key]) if delay is None else fresh.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def windowed_counts(items: DataFrame, at: str, by: str, width: str, delay: str = "1 hour") -> DataFrame:
    """Rows per window and group; on a stream, late rows beyond the delay are left out and a window comes when it is final."""
    return items.withWatermark(at, delay).groupBy(F.window(at, width).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), by, "n")


def run(stream: DataFrame, batch: Callable[[DataFrame, int], None]) -> None:
    """Every available micro-batch through ``batch``, with a checkpoint in the shared folder, then end.

    A batch may come again after a failure, with the same number: write by that number, or overwrite.
    """
    where = own_folder(stream.sparkSession, "stream-")
    stream.writeStream.foreachBatch(batch).option("checkpointLocation", where).trigger(availableNow=True).start().awaitTermination()
    delete(stream.sparkSession, where)


def collected(stream: DataFrame, mode: str = "append") -> DataFrame:
    """The rows of a stream that ends, as a table in the shared folder: all rows (append), or the last state (complete)."""
    spark = stream.sparkSession
    name, marks = own_folder(spark, "feed-"), own_folder(spark, "marks-")
    if mode == "append":
        writer = stream.writeStream.format("parquet").option("path", name)
    else:
        writer = stream.writeStream.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(name))
    writer.outputMode(mode).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()
    delete(spark, marks)
    return spark.read.schema(stream.schema).parquet(name)


def decorated(feed: DataFrame, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A feed made of another: ``step`` is any row-wise transformation (a map, or a flat map by explode)."""
    return feed.transform(step)


def inferred_topics(feed: DataFrame, key: str, infer: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The topics of each micro-batch of (key, uri) rows by ``infer``, as a table; a key's rows must come in one batch."""
    spark = feed.sparkSession
    name = own_folder(spark, "topics-")
    run(feed, lambda df, n: infer(df).write.mode("overwrite").parquet(f"{name}/batch={n}"))
    return spark.read.parquet(name).drop("batch")


def updated_model(feed: DataFrame, learn: Callable[[DataFrame], DataFrame], merge: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A model that grows with a stream: what each micro-batch teaches (``learn``) is kept by its number, so a batch
    that comes again counts once, and the parts are added up by ``merge``."""
    spark = feed.sparkSession
    name = own_folder(spark, "model-")
    run(feed, lambda df, n: learn(df).write.mode("overwrite").parquet(f"{name}/batch={n}"))
    return merge(spark.read.parquet(name).drop("batch"))
