"""Finding known names in texts: dictionary n-grams, scores, overlap resolution, selectors."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kedge.functions import text as T
from kedge.operators.linking import normalised_forms
from kedge.operators.model import MIN_ANNOTATION_PROBABILITY, annotation_probability
from kedge.session import spread

# Weights and thresholds of the spotter.
WEIGHTS = (1.0, 0.2, -0.2, 0.1)
LEAST_SCORE, LEAST_WITHOUT_WEIGHTS = 0.1, 0.25
TYPE_ORDER = ("person", "organisation", "location", "misc", "phrase", "match")
PY_WORD = regex.compile(r"[\p{L}\p{N}]+")
#: Of a dictionary of at most this many names the hashes are sent to the tasks; to a larger one all runs are shuffled.
BROADCAST_NAMES = 4_000_000
#: A dictionary of at most this many names is itself sent to the tasks, to be joined there.
JOINED_NAMES = 100_000
#: Characters of texts that are taken apart at once, and runs that are passed on at once.
PART_CHARS, MOST_RUNS = 1_000_000, 50_000
#: The hash of a run is that of the run before its last token times FACTOR, plus the token's, modulo 2^64.
FACTOR, MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1


def dictionary(forms: DataFrame, least: float = MIN_ANNOTATION_PROBABILITY) -> DataFrame:
    """(key, n_tokens, name, p): names by their tokens, without those hardly ever annotated. Of names with the same tokens the likeliest stays."""
    p = annotation_probability(F.col("annotated"), F.col("total"))
    tokens = T.words(F.col("name"))
    rows = forms.select("name", p.alias("p"), F.array_join(tokens, " ").alias("key"), F.size(tokens).alias("n_tokens")).filter((F.col("p") >= least) & (F.col("n_tokens") >= 1))
    best = F.max_by(F.struct("name", "p", "n_tokens"), F.struct("p", F.col("name")))
    return rows.groupBy("key").agg(best.alias("b")).select("key", "b.n_tokens", "b.name", "b.p")


def _token_hash(token: str, memo: dict[str, int]) -> int:
    got = memo.get(token)
    if got is None:
        got = memo[token] = int.from_bytes(hashlib.blake2b(token.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
    return got


def _beginnings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, whole): the hash of every beginning of every name of a batch, and whether it is the whole name."""
    for b in batches:
        memo: dict[str, int] = {}
        hashes, whole = [], []
        for name in b.column(0).to_pylist():
            h, tokens = 0, name.split(" ")
            for n, token in enumerate(tokens, 1):
                h = (h * FACTOR + _token_hash(token, memo)) & MASK
                hashes.append(h)
                whole.append(n == len(tokens))
        yield pa.RecordBatch.from_arrays([pa.array(np.array(hashes, np.uint64).view(np.int64)), pa.array(whole, pa.bool_())], names=["h", "whole"])


def _runs(at: np.ndarray, left: np.ndarray, hashes: np.ndarray, known: tuple[np.ndarray, np.ndarray] | None, longest: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each length the places of the tokens at which a run of it begins: one whose hash is a name's if ``known`` is given.

    ``left`` holds how many tokens the text has from each place on. A place is given up once no name begins like its run.
    """
    h, n = np.zeros(len(at), np.uint64), 1
    while len(at) and (known is not None or n <= longest):
        if known is None:
            yield n, at
        else:
            h = h * np.uint64(FACTOR) + hashes[at + n - 1]
            slot = np.minimum(np.searchsorted(known[0], h), len(known[0]) - 1)
            met = known[0][slot] == h if len(known[0]) else np.zeros(len(at), bool)
            at, h, slot = at[met], h[met], slot[met]
            yield n, at[known[1][slot]]
        more = left[at] > n
        at, h, n = at[more], h[more] if known is not None else h, n + 1


def _grams(known: tuple[np.ndarray, np.ndarray] | None, key: str, longest: int = 0):
    """Token runs of texts: those that may be names if ``known`` is given (sorted hashes of the beginnings of names, and
    which are whole), else all of at most ``longest`` tokens. A batch is taken and passed on in parts, so that memory
    doesn't follow the number of its runs."""

    def part(kind: pa.DataType, texts: list[tuple]) -> Iterator[pa.RecordBatch]:
        spans: list[tuple[int, int, str]] = []
        counts = np.zeros(len(texts), np.int64)
        for i, (_, text) in enumerate(texts):
            before = len(spans)
            spans += [(m.start(), m.end(), m[0]) for m in PY_WORD.finditer(text)]
            counts[i] = len(spans) - before
        if not spans:
            return
        memo: dict[str, int] = {}
        hashes = np.fromiter((_token_hash(t, memo) for _, _, t in spans), np.uint64, len(spans)) if known is not None else np.zeros(0, np.uint64)
        ends = np.repeat(np.cumsum(counts), counts)
        first = ends - np.repeat(counts, counts)
        which = np.repeat(np.arange(len(texts)), counts)
        for n, at in _runs(np.arange(len(spans)), ends - np.arange(len(spans)), hashes, known, longest):
            for places in (at[i : i + MOST_RUNS] for i in range(0, len(at), MOST_RUNS)):
                rows = places.tolist()
                start = [spans[i][0] for i in rows]
                yield pa.RecordBatch.from_arrays([
                    pa.array([texts[w][0] for w in which[places].tolist()], kind), pa.array((places - first[places]).astype(np.int32)), pa.array(np.full(len(rows), n, np.int32)), pa.array(start, pa.int32()),
                    pa.array([spans[i + n - 1][1] - x for i, x in zip(rows, start, strict=True)], pa.int32()), pa.array([" ".join([s[2] for s in spans[i : i + n]]) for i in rows], pa.string()),
                ], names=[key, "pos", "n_tokens", "start", "length", "key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, size = [], 0
            for k, text in zip(b.column(0), b.column(1), strict=True):
                texts.append((k.as_py(), text.as_py()))
                size += len(texts[-1][1])
                if size >= PART_CHARS:
                    yield from part(b.schema.field(0).type, texts)
                    texts, size = [], 0
            yield from part(b.schema.field(0).type, texts)

    return run


def dictionary_matches(docs: DataFrame, names: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos, n_tokens, start, length, name, p): every dictionary match at every start and of every length.

    One pass over the texts in Arrow batches gives tokens, offsets and runs together. The hashes of a dictionary of at
    most BROADCAST_NAMES names and of their beginnings travel with the tasks, which then pass on little but matches; the
    names themselves are met by a join. To a larger one all runs up to its longest name are shuffled. Texts that are null
    or hold no token match nothing.
    """
    size, longest = names.agg(F.count(F.lit(1)), F.max("n_tokens")).first()
    known = None
    if size <= BROADCAST_NAMES:
        got = names.select("key").mapInArrow(_beginnings, "h long, whole boolean").groupBy("h").agg(F.max("whole").alias("whole")).toArrow()
        hashes = got["h"].to_numpy().view(np.uint64)
        order = np.argsort(hashes)
        known = hashes[order], got["whole"].to_numpy()[order].astype(bool)
    rows = spread(docs.filter(F.col(text).isNotNull()).select(key, text))
    shape = f"{key} {dict(docs.dtypes)[key]}, pos int, n_tokens int, start int, length int, key string"
    grams = rows.mapInArrow(_grams(known, key, longest or 0), shape)
    right = names.select("key", "name", "p")
    return grams.join(F.broadcast(right) if size <= JOINED_NAMES else right, "key").select(key, "pos", "n_tokens", "start", "length", "name", "p")


def spot_features(name: Column, p: Column) -> tuple[Column, Column, Column, Column]:
    """Probability, is an abbreviation, is a number, 1."""
    abbreviation = (F.char_length(name) < 5) & (F.upper(name) == name) & ~name.rlike("^[0-9]+$") & name.rlike("\\p{L}")
    return p, abbreviation.cast("double"), name.rlike("^[0-9.,]+$").cast("double"), F.lit(1.0)


def spot_score(name: Column, p: Column, weights: Sequence[float] | None = WEIGHTS) -> Column:
    if weights is None:
        return p
    return reduce(lambda a, b: a + b, [w * f for w, f in zip(weights, spot_features(name, p), strict=True)])


def known_probability(spots: DataFrame, forms: DataFrame, lower: DataFrame, name: str = "name") -> DataFrame:
    """Spots with ``p``: the annotation probability of the name itself, else the score of its likeliest normalised form, else 0.

    Each distinct name is looked up once, those without a form of their own by their lower case.
    """
    p = annotation_probability(F.col("annotated"), F.col("total"))
    exact = forms.select(F.col("name").alias("__n"), p.alias("__p"))
    names = spots.select(F.col(name).alias("name")).distinct()
    missing = names.join(exact.select(F.col("__n").alias("name")), "name", "left_anti")
    near = normalised_forms(missing, forms, lower, 1).select(F.col("name").alias("__n"), F.col("score").alias("__p"))
    return spots.join(exact.unionByName(near), F.col(name) == F.col("__n"), "left").withColumn("p", F.coalesce("__p", F.lit(0.0))).drop("__n", "__p")


def accepted(spots: DataFrame, confidence: float = 0.5, weights: Sequence[float] | None = WEIGHTS) -> DataFrame:
    """Spots with a score of at least max(0.1, confidence), or 0.25 without weights."""
    least = LEAST_WITHOUT_WEIGHTS if weights is None else max(LEAST_SCORE, confidence)
    return spots.withColumn("score", spot_score(F.col("name"), F.col("p"), weights)).filter(F.col("score") >= least)


def resolve_overlaps(spots: DataFrame, key: str = "doc_id", type_column: str | None = None) -> DataFrame:
    """One spot per stretch of text, by a fold over the spots of a text in order of start and length.

    Where the current spot meets the last kept one: 1 longer and more than half as likely: it takes
    its place; 2 not longer and at most twice as likely: it goes; 3 as likely and of a better type:
    it takes the place; 4 as likely: it goes; 5 likelier: it takes the place; 6 else it goes. The
    fold is an expression over one text's spots (bounded by the text), evaluated in the JVM.
    """
    kind = F.array_position(F.array(*[F.lit(t) for t in TYPE_ORDER]), F.col(type_column)).cast("int") if type_column else F.lit(0)
    one = F.struct("start", "length", "pos", "n_tokens", "name", "p", kind.alias("kind"))
    shape = "array<struct<start:int,length:int,pos:int,n_tokens:int,name:string,p:double,kind:int>>"
    grouped = spots.groupBy(key).agg(F.array_sort(F.collect_list(one)).alias("spots"))

    def step(kept: Column, cur: Column) -> Column:
        last = F.try_element_at(kept, F.lit(-1))
        meets = (F.size(kept) > 0) & (cur["start"] < last["start"] + last["length"])
        longer = cur["length"] > last["length"]
        replace = (
            F.when(longer & (cur["p"] > last["p"] / 2), True)
            .when(~longer & (cur["p"] <= last["p"] * 2), False)
            .when((cur["p"] == last["p"]) & (cur["kind"] > 0) & (cur["kind"] < last["kind"]), True)
            .when(cur["p"] == last["p"], False)
            .otherwise(cur["p"] > last["p"])
        )
        before = F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))
        return F.when(~meets, F.concat(kept, F.array(cur))).when(replace, F.concat(before, F.array(cur))).otherwise(kept)

    folded = grouped.select(key, F.explode(F.aggregate("spots", F.array().cast(shape), step)).alias("s"))
    return folded.select(key, "s.pos", "s.n_tokens", "s.start", "s.length", "s.name", "s.p")


def leftmost_longest(matches: DataFrame, key: str = "doc_id") -> DataFrame:
    """Matches from left to right, the longest first; the next must begin strictly after the end of the last (an adjacent one is dropped)."""
    one = F.struct("start", (-F.col("length")).alias("minus"), "pos", "n_tokens", "name", "p")
    shape = "array<struct<start:int,minus:int,pos:int,n_tokens:int,name:string,p:double>>"
    grouped = matches.groupBy(key).agg(F.array_sort(F.collect_list(one)).alias("m"))

    def step(kept: Column, cur: Column) -> Column:
        last = F.try_element_at(kept, F.lit(-1))
        return F.when((F.size(kept) == 0) | (cur["start"] > last["start"] - last["minus"]), F.concat(kept, F.array(cur))).otherwise(kept)

    out = grouped.select(key, F.explode(F.aggregate("m", F.array().cast(shape), step)).alias("s"))
    return out.select(key, "s.pos", "s.n_tokens", "s.start", (-F.col("s.minus")).alias("length"), "s.name", "s.p")


def trims(tokens: Column) -> Column:
    """All sub-runs of a run in the order in which they are tried: the whole, from the left, then from the right."""
    n = F.size(tokens)
    left = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array_join(F.slice(tokens, i + 1, n), " "))
    right = F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.array_join(F.slice(tokens, F.lit(1), n - i), " "))).otherwise(F.array().cast("array<string>"))
    return F.concat(left, right)


def first_known_trim(runs: DataFrame, names: DataFrame, keys: Sequence[str], run: str = "run") -> DataFrame:
    """The first trim of each run that is a name: (keys, trim, priority, name, p)."""
    tried = runs.select(*keys, F.posexplode(trims(F.split(run, " "))).alias("priority", "key"))
    hit = tried.join(names.select("key", "name", "p"), "key")
    best = F.min_by(F.struct("key", "name", "p", "priority"), "priority")
    return hit.groupBy(*keys).agg(best.alias("b")).select(*keys, F.col("b.key").alias("trim"), "b.priority", "b.name", "b.p")


Selector = Callable[[DataFrame], DataFrame]


def chained(*selectors: Selector) -> Selector:
    return lambda df: reduce(lambda a, s: a.transform(s), selectors, df)


def not_short(least: int = 3) -> Selector:
    return lambda df: df.filter(F.char_length("name") >= least)


def whitelisted(names: DataFrame) -> Selector:
    return lambda df: df.join(names.select("name").distinct(), "name", "left_semi")


def uncommon(common: DataFrame, least: int = 100) -> Selector:
    """Without single words that the corpus holds more than ``least`` times."""
    return lambda df: df.join(common.filter(F.col("n") > least).select(F.col("token").alias("__t")), F.lower("name") == F.col("__t"), "left_anti")


def without_pattern(pattern: str) -> Selector:
    return lambda df: df.filter(~F.col("name").rlike(f"^(?:{pattern})$"))


def term_size(least: int, most: int) -> Selector:
    return lambda df: df.filter(F.size(T.words(F.col("name"))).between(least, most))


def with_noun(pos: str = "pos_tags") -> Selector:
    """At least one token tagged as a noun (n…) or a foreign word (fw)."""
    return lambda df: df.filter(F.exists(pos, lambda t: F.lower(t).rlike("^(n|fw)")))


def tagged_as(pattern: str = "n[^r].*|n|fw.*", pos: str = "pos_tags") -> Selector:
    return lambda df: df.filter(F.exists(pos, lambda t: F.lower(t).rlike(f"^(?:{pattern})$")))


def share_of(ratio: float, key: str = "doc_id") -> Selector:
    """A reproducible subset: rows whose hash falls under the ratio."""
    return lambda df: df.filter(F.pmod(F.xxhash64(key, "name"), F.lit(10_000)) < int(ratio * 10_000))


def inverse(condition: Column) -> Selector:
    return lambda df: df.filter(~condition)
