"""Predicates over links and occurrences; each is a transform from rows to the rows that pass."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kedge.functions import text as T

Filter = Callable[[DataFrame], DataFrame]


def confidence(least: float, thresholds: Sequence[float] = ()) -> Filter:
    """Score at least the confidence, or the entry of a table of thresholds that the confidence points at."""
    bound = thresholds[round((len(thresholds) - 1) * least)] if thresholds else least
    return lambda df: df.filter(F.col("final_score") >= bound)


def second_rank(conf: float) -> Filter:
    """Without links whose next candidate comes nearer than 1 - confidence squared."""
    return lambda df: df.filter(F.col("second_rank") <= 1 - conf * conf)


def contextual(least: float) -> Filter:
    return lambda df: df.filter(F.col("context_gain") >= least)


def support(more_than: int) -> Filter:
    return lambda df: df.filter(F.col("support") > more_than)


def types(wanted: Sequence[str], blacklist: bool = False) -> Filter:
    """Links with (or, as a blacklist, without) one of the types; 'unknown' stands for having none; no types let all pass."""

    def apply(df: DataFrame) -> DataFrame:
        if not wanted:
            return df
        hit = F.coalesce(F.arrays_overlap("types", F.array(*[F.lit(t) for t in wanted])), F.lit(False))
        if "unknown" in wanted:
            hit = hit | (F.coalesce(F.size("types"), F.lit(0)) <= 0)
        return df.filter(~hit if blacklist else hit)

    return apply


def uris(allowed: DataFrame, blacklist: bool = False) -> Filter:
    """Links whose uri is (or is not) among the rows of a query."""
    return lambda df: df.join(allowed.select("uri").distinct(), "uri", "left_anti" if blacklist else "left_semi")


def redirected(redirects: DataFrame) -> Filter:
    """Uris by their final titles: ``redirects`` has (node, root)."""

    def apply(df: DataFrame) -> DataFrame:
        to = redirects.select(F.col("node").alias("__n"), F.col("root").alias("__r"))
        return df.join(to, F.col("uri") == F.col("__n"), "left").withColumn("uri", F.coalesce("__r", "uri")).drop("__n", "__r")

    return apply


def no_lists(prefix: str = "List_of_") -> Filter:
    return lambda df: df.filter(~F.startswith("uri", F.lit(prefix)) & ~F.coalesce(F.startswith("id", F.lit(prefix)), F.lit(False)))


def keep_numeric() -> Filter:
    return lambda df: df.filter(F.col("uri").rlike("^[0-9]+$"))


def lowercase_forms() -> Filter:
    return lambda df: df.withColumn("surface_form", F.lower("surface_form"))


def narrowed(max_words: int, min_words: int) -> Filter:
    """Contexts cut to the words around the mention; rows with too few, or whose mention isn't at its offset, are dropped."""

    def apply(df: DataFrame) -> DataFrame:
        at = F.size(T.words(F.substr(F.col("context"), F.lit(1), F.col("text_offset"))))
        width = F.size(T.words(F.col("surface_form")))
        stands = F.substr(F.col("context"), F.col("text_offset") + 1, F.char_length("surface_form")) == F.col("surface_form")
        window = T.context_window(T.words(F.col("context")), at, width, max_words, min_words)
        return df.filter(F.coalesce(stands & (F.col("text_offset") >= 0), F.lit(False))).withColumn("narrow", window).filter(F.col("narrow").isNotNull()).withColumn("narrow", F.array_join("narrow", " "))

    return apply


def good_uri(blacklist: str | None = None) -> Filter:
    """Without slash, without an escaped '#', with a letter, and not matching the blacklist."""

    def apply(df: DataFrame) -> DataFrame:
        ok = ~F.contains("uri", F.lit("/")) & ~F.contains("uri", F.lit("%23")) & F.col("uri").rlike("\\p{L}")
        return df.filter(ok & ~F.col("uri").rlike(blacklist) if blacklist else ok)

    return apply


def good_form(most: int = 50, stopwords: Sequence[str] = T.STOPWORDS) -> Filter:
    """Not too long, with a letter, without escapes, not of stopwords only."""

    def apply(df: DataFrame) -> DataFrame:
        all_stop = F.forall(T.lower_words(F.col("surface_form")), lambda w: w.isin(*stopwords))
        return df.filter((F.char_length("surface_form") <= most) & F.col("surface_form").rlike("\\p{L}") & ~F.col("surface_form").rlike("%[0-9A-Fa-f]{2}") & ~all_stop)

    return apply


def in_large_groups(by: str, more_than: int = 1) -> Filter:
    """Rows without null whose group has more than so many rows; the sizes are joined, no group is gathered."""

    def apply(df: DataFrame) -> DataFrame:
        from kedge.operators.skew import salted_join

        rows = df.filter(F.col(by).isNotNull())
        sizes = rows.groupBy(F.col(by).alias("__g")).agg(F.count(F.lit(1)).alias("group_size")).filter(F.col("group_size") > more_than)
        return salted_join(rows, sizes, by, "__g").drop("__g")

    return apply


def coreference(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """A later one-word mention that stands in an earlier mention of several capitalised words takes its entity (of several, the first's).

    The join is an equality on text and word; only the words of earlier long mentions are spread out.
    """
    words = F.split("name", " ")
    capital = F.forall(words, lambda w: w.rlike("^\\p{Lu}"))
    whole = df.filter((F.size(words) > 1) & capital).select(F.col(key).alias("__k"), F.explode(F.array_distinct(words)).alias("__w"), F.col("start").alias("__s"), F.col("uri").alias("__u"))
    first = whole.groupBy("__k", "__w").agg(F.min_by(F.struct("__s", "__u"), F.struct("__s", "__u")).alias("__f"))
    met = df.join(first, (F.col(key) == F.col("__k")) & (F.col("name") == F.col("__w")) & (F.col("start") > F.col("__f.__s")), "left")
    return met.withColumn("uri", F.coalesce(F.col("__f.__u"), F.col("uri"))).drop("__k", "__w", "__f")


def pipeline(conf: float = 0.5, more_than: int = 0, wanted: Sequence[str] = (), blacklist: bool = False, allowed: DataFrame | None = None, thresholds: Sequence[float] = ()) -> Filter:
    """Support, types, uris, confidence (only without a table of thresholds), second rank."""
    steps: list[Filter] = [support(more_than), types(wanted, blacklist)]
    if allowed is not None:
        steps.append(uris(allowed, blacklist))
    if not thresholds:
        steps.append(confidence(conf))
    steps.append(second_rank(conf))

    def apply(df: DataFrame) -> DataFrame:
        for s in steps:
            df = df.transform(s)
        return df

    return apply


def best_per(df: DataFrame, keys: Sequence[str], score: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), "uri"))
    return df.withColumn("__r", rank).filter(F.col("__r") == 1).drop("__r")


def not_matching(column: str, pattern: str) -> Filter:
    """Without the rows whose column a blacklist pattern hits."""
    return lambda df: df.filter(~F.col(column).rlike(pattern))


def all_in_one(conf: float, least_support: int, similarity: Sequence[float] = (), key: str = "doc_id") -> Filter:
    """The older single filter: coreference first, support of at least the bound, a confidence between 0 and 1 or an error."""
    if not 0 <= conf <= 1:
        raise ValueError("confidence must be between 0 and 1")

    def apply(df: DataFrame) -> DataFrame:
        kept = coreference(df, key).filter(F.col("support") >= least_support)
        return kept.transform(confidence(conf, similarity)).transform(second_rank(conf))

    return apply
