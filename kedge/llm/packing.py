"""Items of varying length into containers of fixed capacity, by hierarchical residual packing.

Each partition packs its items best-fit, longest first, and emits the bins that are nearly full. The
others go on as items of the next round, in fewer partitions, where they are merged best-fit again;
what was together stays together. The rounds end when one partition has seen all the rest, or when a
round no longer lowers their number (bins more than half full merge with nothing). The number of
partitions of a round follows the number of open bins, so no task gets an unbounded share.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kedge.session import cut, drop, partitions, spread

CAPACITY = 2048
#: A bin at least this full is emitted at once.
NEARLY_FULL = 0.99
#: Items, or open bins of the round before, per task of a round.
BINS_PER_TASK = 100_000
#: A round that leaves more than this share of the open bins, where the tasks can't become fewer, is the last: bins
#: more than half full merge with nothing. They stay as they are, nothing is lost.
NO_GAIN = 0.98


def token_counter(path: str, pattern: str):
    """A function from text to its number of tokens, for a byte-level vocabulary file of ranks and its splitting pattern."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    coder = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return lambda text: len(coder.encode_ordinary(text))


def token_sizes(docs: DataFrame, key: str, text: str, tokenizer: str, pattern: str) -> DataFrame:
    """(key, size) of every row; a null text has no tokens. ``tokenizer`` names a file that every executor can read."""

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = None
        for b in batches:
            count = count or token_counter(tokenizer, pattern)
            n = [0 if t is None else count(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=[key, "size"])

    return spread(docs.select(key, text)).mapInArrow(sizes, f"{key} {dict(docs.dtypes)[key]}, size long")


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin of each item, and each bin's fill; items in the order given (longest first by the caller).

    The open bins are kept by their remaining room; a bit mask of the rooms in use gives the
    smallest that is large enough.
    """
    where = np.empty(len(sizes), np.int64)
    fill: list[int] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for i, s in enumerate(sizes.tolist()):
        fits = mask >> s
        if fits:
            room = s + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                mask &= ~(1 << room)
        else:
            room, b = capacity, len(fill)
            fill.append(0)
        fill[b] += s
        where[i] = b
        if room > s:
            by_room[room - s].append(b)
            mask |= 1 << (room - s)
    return where, np.array(fill, np.int64)


def _packed(level: int, capacity: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        t = pa.Table.from_batches(parts)
        ids, sizes = t["item"].to_numpy(), t["room"].to_numpy()
        order = np.lexsort((ids, -sizes))
        where, fill = best_fit(sizes[order], capacity)
        first = (level << 56) | (TaskContext.get().partitionId() << 32)
        yield pa.RecordBatch.from_arrays([pa.array(ids[order]), pa.array(first + where), pa.array(fill[where])], names=["item", "bin", "fill"])

    return pack


def pack(items: DataFrame, capacity: int = CAPACITY, nearly_full: float = NEARLY_FULL, bins_per_task: int = BINS_PER_TASK) -> DataFrame:
    """(item, container) for ``items`` (item BIGINT unique, room BIGINT from 1 to capacity)."""
    n_parts = max(partitions(items), -(-items.count() // bins_per_task))
    level, links = 0, []
    todo, before = items.select("item", "room"), None
    while True:
        spread = todo.repartition(n_parts, "item")
        got = cut(spread.mapInArrow(_packed(level, capacity), "item long, bin long, fill long"))
        links.append(got)
        bins = got.groupBy("bin").agg(F.first("fill").alias("room"))
        full = F.col("room") >= nearly_full * capacity
        rest = bins.filter(~full)
        n = rest.count()
        if n == 0:
            break
        if n_parts == 1 or (before is not None and n > NO_GAIN * before and n_parts <= -(-n // bins_per_task)):
            break
        todo, before = rest.select(F.col("bin").alias("item"), "room"), n
        level, n_parts = level + 1, max(1, min(n_parts // 2, -(-n // bins_per_task)))
    out = links[0].select("item", F.col("bin").alias("b0"))
    for k, link in enumerate(links[1:], 1):
        up = link.select(F.col("item").alias("__i"), F.col("bin").alias("__b"))
        prev = F.col("b0")
        out = out.join(up, prev == F.col("__i"), "left").select("item", F.coalesce("__b", "b0").alias("b0"))
    got = cut(out.select("item", F.col("b0").alias("container")))
    drop(*links)
    return got


def pack_documents(docs: DataFrame, tokenizer: str, pattern: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """(key, piece, container, position, start, size): where each document's tokens lie.

    A document of more than ``capacity`` tokens is cut into full pieces and a rest, any other is one
    piece. position counts the pieces of a container from 0, start is the number of tokens before it.
    A null or empty text has size 0; it is placed too and takes the room of one token, so a container
    never holds more than ``capacity`` pieces. Every row is an item of its own, repeated texts too.
    """
    sizes = cut(token_sizes(docs, key, text, tokenizer, pattern))
    n_pieces = F.greatest(F.ceil(F.col("size") / capacity), F.lit(1))
    cutting = sizes.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), n_pieces - 1)))
    pieces = cut(cutting.select(key, "piece", F.least(F.col("size") - F.col("piece") * capacity, F.lit(capacity)).alias("size"), F.monotonically_increasing_id().alias("item")))
    placed = pack(pieces.select("item", F.greatest("size", F.lit(1)).cast("long").alias("room")), capacity)
    inside = Window.partitionBy("container").orderBy(F.desc("size"), "item")
    before = F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    joined = pieces.join(placed, "item")
    drop(sizes)
    return joined.select(key, "piece", "container", (F.row_number().over(inside) - 1).cast("long").alias("position"), before.cast("long").alias("start"), F.col("size").cast("long").alias("size"))
