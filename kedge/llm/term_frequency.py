"""How often every distinct value or term occurs, and in how many records.

1. Terms are brought together with their record id, which divides them into blocks by the hash of
   both: no term and no record, however frequent, is gathered in one place.
2. Each block encodes its terms locally and counts occurrences and record presence in two count
   arrays (one cell per local code).
3. A global dictionary gives every distinct (field, term) a dense integer; the blocks' arrays are
   re-addressed by it. A term comes at most once per block and flush into this join.
4. The identifier space is cut into ranges; the blocks' cells of one range are added into the
   range's arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kedge.session import cut, partitions

#: Identifiers per range: the two arrays of a range take 16 bytes per identifier.
RANGE = 1 << 15
#: Rows of a block after which its arrays are passed on, so that its memory is bounded.
FLUSH = 1 << 21

_CELLS = "field string, term string, n long, records long"


def _count_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []

    def flush() -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held).unify_dictionaries()
        held.clear()
        for field in pc.unique(t["field"]).to_pylist():
            part = t.filter(pc.equal(t["field"], field))
            coded = part["term"].combine_chunks().dictionary_encode()
            codes = coded.indices.to_numpy(zero_copy_only=False)
            size = len(coded.dictionary)
            n = np.bincount(codes, weights=part["n"].to_numpy(), minlength=size).astype(np.int64)
            seen = np.bincount(codes, weights=part["present"].to_numpy(), minlength=size).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([field] * size, pa.string()), coded.dictionary.cast(pa.string()), pa.array(n), pa.array(seen)], names=["field", "term", "n", "records"])

    rows = 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            rows += b.num_rows
        if rows >= FLUSH:
            yield from flush()
            rows = 0
    if held:
        yield from flush()


def _sum_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n: dict[int, np.ndarray] = {}
    records: dict[int, np.ndarray] = {}
    for b in batches:
        ids = b.column("tid").to_numpy()
        a, r = b.column("n").to_numpy(), b.column("records").to_numpy()
        part = ids // RANGE
        for k in np.unique(part):
            at = part == k
            if k not in n:
                n[k], records[k] = np.zeros(RANGE, np.int64), np.zeros(RANGE, np.int64)
            np.add.at(n[k], ids[at] % RANGE, a[at])
            np.add.at(records[k], ids[at] % RANGE, r[at])
    for k in sorted(n):
        used = np.flatnonzero(n[k])
        yield pa.RecordBatch.from_arrays([pa.array(used + k * RANGE), pa.array(n[k][used]), pa.array(records[k][used])], names=["tid", "n", "records"])


def dictionary(cells: DataFrame) -> DataFrame:
    """(field, term, tid): a dense integer for every distinct pair, without a global sort.

    Each partition numbers its own terms; the numbers of the partitions before it (as many rows as
    partitions) are added.
    """
    distinct = cut(cells.select("field", "term").distinct().withColumn("__m", F.monotonically_increasing_id()))
    part = F.shiftright("__m", 33)
    sizes = distinct.groupBy(part.alias("__p")).agg(F.count(F.lit(1)).alias("c")).collect()
    base, total = {}, 0
    for r in sorted(sizes, key=lambda r: r["__p"]):
        base[r["__p"]] = total
        total += r["c"]
    bases = distinct.sparkSession.createDataFrame(list(base.items()), "__p long, __b long")
    return distinct.join(F.broadcast(bases), part == F.col("__p")).select("field", "term", (F.col("__b") + F.col("__m").bitwiseAND((1 << 33) - 1)).alias("tid"))


def term_counts(df: DataFrame, record: str, fields: dict[str, Column]) -> DataFrame:
    """(field, term, n, records): ``fields`` gives each field's terms as a string or an array of strings.

    n is the number of appearances, records that of distinct values of ``record`` they are in. Null
    terms don't count; the empty string is a term; a null record id adds to n but is no record;
    repeated rows of a record count in n and once in records; an empty table gives no rows.
    """
    as_array = [F.struct(F.lit(k).alias("field"), v.alias("terms")) for k, v in fields.items()]
    terms = df.select(F.col(record).alias("rec"), F.explode(F.array(*as_array)).alias("f")).select("rec", "f.field", F.explode("f.terms").alias("term")).filter(F.col("term").isNotNull())
    pairs = terms.groupBy("field", "term", "rec").agg(F.count(F.lit(1)).alias("n"))
    cells = cut(pairs.select("field", "term", "n", F.col("rec").isNotNull().cast("long").alias("present")).mapInArrow(_count_block, _CELLS))
    words = dictionary(cells)
    coded = cells.join(words, ["field", "term"]).select("tid", "n", "records")
    by_range = coded.repartition(partitions(df), (F.col("tid") / RANGE).cast("long"))
    sums = by_range.mapInArrow(_sum_ranges, "tid long, n long, records long")
    return words.join(sums, "tid").select("field", "term", "n", "records")


def occurrence_terms(occs: DataFrame) -> DataFrame:
    one = lambda c: F.array(F.col(c))
    words = F.filter(F.split("surface_form", " "), lambda w: w != "")
    return term_counts(occs, "id", {"uri": one("uri"), "surface_form": one("surface_form"), "word": words})


def marked(counts: DataFrame, records: DataFrame, record: str, rare: int = 1, common: float = 0.01) -> DataFrame:
    """(field, term, mark): ``rare`` in at most that many records but at least one, ``common`` in at least that share of all. Both can hold."""
    total = records.agg(F.count_distinct(record)).scalar()
    marks = F.array(
        F.when((F.col("records") >= 1) & (F.col("records") <= rare), "rare"),
        F.when((F.col("records") >= 1) & (F.col("records") >= F.lit(common) * total), "common"),
    )
    return counts.select("field", "term", F.explode(marks).alias("mark")).filter(F.col("mark").isNotNull())
