"""What a user calls: spot, candidates, disambiguate, annotate, over a built model.

Every function takes and returns DataFrames of whole corpora; the keyword defaults are the service's.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kedge.functions import text as T
from kedge.operators import filters, linking, model, spotting, topics
from kedge.sources import sinks

# Defaults of the parameters.
CONFIDENCE, SUPPORT, MOST_CANDIDATES = 0.5, 0, 100


def spot(docs: DataFrame, built: model.Model, confidence: float = CONFIDENCE, key: str = "doc_id", select: spotting.Selector | None = None) -> DataFrame:
    """(key, pos, n_tokens, start, length, name, p): the names found in each text, none overlapping."""
    found = spotting.dictionary_matches(docs, spotting.dictionary(built.forms), key)
    kept = spotting.resolve_overlaps(spotting.accepted(found, confidence), key)
    return kept.transform(select) if select else kept


def link_mentions(mentions: DataFrame, built: model.Model, key: str, k: int = linking.TOP_CANDIDATES, true_likelihood: bool = False) -> DataFrame:
    """Ranked entities of mentions (key unique, name, text) that stand alone, each with its own text."""
    sizes = model.totals(built.tokens, built.resources, built.pairs)
    cands = linking.top_candidates(mentions, built.candidates, [key], k)
    gain = linking.context_gain(cands, mentions.select(key, "text"), built.contexts, built.tokens, sizes, key)
    return linking.linked(cands, gain, sizes, [key], key, true_likelihood)


def best_k(docs: DataFrame, spots: DataFrame, built: model.Model, key: str = "doc_id", k: int = linking.TOP_CANDIDATES) -> DataFrame:
    """Ranked entities of each spot (key, start) of each text; a spot of a long text is scored against its window."""
    windows = T.context_windows(docs, key, "text")
    starts = windows.filter(F.col("window") > 0).groupBy(key).agg(F.array_sort(F.collect_list("start")).alias("__starts"))
    window = F.coalesce(F.size(F.filter("__starts", lambda s: s <= F.col("start"))), F.lit(0))
    placed = spots.join(starts, key, "left").withColumn("__unit", F.struct(F.col(key).alias("k"), window.alias("w")))
    sizes = model.totals(built.tokens, built.resources, built.pairs)
    cands = linking.top_candidates(placed, built.candidates, ["__unit", "start"], k)
    texts = windows.select(F.struct(F.col(key).alias("k"), F.col("window").alias("w")).alias("__unit"), "text")
    gain = linking.context_gain(cands, texts, built.contexts, built.tokens, sizes, "__unit")
    return linking.linked(cands, gain, sizes, ["__unit", "start"], "__unit").withColumn(key, F.col("__unit.k")).drop("__unit")


def with_types(links: DataFrame, built: model.Model) -> DataFrame:
    return links.join(built.resources.select("uri", "types"), "uri", "left")


def candidates(docs: DataFrame, built: model.Model, confidence: float = CONFIDENCE, key: str = "doc_id") -> DataFrame:
    """All candidates of all spots, ranked, at most 100 a spot."""
    return with_types(best_k(docs, spot(docs, built, confidence, key), built, key, MOST_CANDIDATES), built)


def annotate(
    docs: DataFrame,
    built: model.Model,
    confidence: float = CONFIDENCE,
    support: int = SUPPORT,
    types: Sequence[str] = (),
    blacklist: bool = False,
    allowed: DataFrame | None = None,
    coreference: bool = False,
    key: str = "doc_id",
    spotter: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """(key, start, name, uri, support, types, final_score, second_rank): the linked names of each text that pass the filters."""
    spots = spotter(docs) if spotter else spot(docs, built, confidence, key)
    best = best_k(docs, spots, built, key).filter(F.col("rank") == 1)
    got = with_types(best, built).transform(filters.pipeline(confidence, support, types, blacklist, allowed))
    if coreference:
        got = filters.coreference(got, key)
    return got.select(key, "start", "name", "uri", "support", "types", "final_score", "second_rank")


def disambiguate(docs: DataFrame, built: model.Model, key: str = "doc_id", **parameters) -> DataFrame:
    """Links of the names that the client marked as [[name]] or [[target|name]] in the text."""
    shown = F.regexp_replace("text", "\\[\\[[^\\[\\]|]*\\|([^\\[\\]|]*)(?:\\|[^\\[\\]]*)?\\]\\]", "[[$1]]")
    plain, marks = T.mentions_in_brackets(F.col("__shown"))
    marked = docs.select(key, shown.alias("__shown")).select(key, plain.alias("text"), marks.alias("m"))
    spots = marked.select(key, F.explode("m").alias("s")).select(key, F.col("s.offset").alias("start"), F.col("s.name").alias("name"))
    return annotate(marked.select(key, "text"), built, key=key, spotter=lambda _: spots, **parameters)


def topics_of(docs: DataFrame, evidence: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, topic, p): what a topic service answers for each text, by a trained model's evidence (topic, token, mass)."""
    rows = topics.weighted(topics.features(docs, key, "text"), key)
    return topics.predict(rows, topics.log_weights(evidence), key)


# What a request may name. A spotter takes (docs, built, confidence, key), a disambiguator (docs, spots, built, key).
SPOTTERS: dict[str, Callable[..., DataFrame]] = {
    "Default": lambda docs, built, confidence, key: spot(docs, built, confidence, key),
    "AllOccurrences": lambda docs, built, confidence, key: spotting.dictionary_matches(docs, spotting.dictionary(built.forms), key),
    "LeftmostLongest": lambda docs, built, confidence, key: spotting.leftmost_longest(spotting.dictionary_matches(docs, spotting.dictionary(built.forms), key), key),
    "AtLeastThreeLetters": lambda docs, built, confidence, key: spot(docs, built, confidence, key, spotting.not_short(3)),
    "TermsOfTwoToFour": lambda docs, built, confidence, key: spot(docs, built, confidence, key, spotting.term_size(2, 4)),
}
DISAMBIGUATORS: dict[str, Callable[..., DataFrame]] = {
    "Default": lambda docs, spots, built, key: best_k(docs, spots, built, key),
    "Prior": lambda docs, spots, built, key: prior_links(spots, built, key, "prior"),
    "Support": lambda docs, spots, built, key: prior_links(spots, built, key, "support"),
}


def prior_links(spots: DataFrame, built: model.Model, key: str, order: str = "prior") -> DataFrame:
    """Candidates of each spot by prior or support alone, in the shape of ``best_k``."""
    every = linking.top_candidates(spots, built.candidates, [key, "start"])
    w = Window.partitionBy(key, "start")
    ranked = w.orderBy(F.desc(order), "uri")
    share = F.col(order) / F.sum(order).over(w)
    return every.select(
        key, "start", "name", "uri", "support", "prior", F.lit(0.0).alias("context_gain"), F.log(order).alias("score"), share.alias("final_score"),
        F.coalesce(F.lead(order).over(ranked) / F.col(order), F.lit(0.0)).alias("second_rank"), F.row_number().over(ranked).alias("rank"),
    )


def policy(kind: dict[str, Callable[..., DataFrame]], name: str) -> Callable[..., DataFrame]:
    """The spotter or disambiguator of a name; an unknown or empty one is an error."""
    if name not in kind:
        raise ValueError(f"unknown policy {name!r}; there are {', '.join(sorted(kind))}")
    return kind[name]


def request(docs: DataFrame, built: model.Model, spotter: str = "Default", disambiguator: str = "Default", output: str = "rows", key: str = "doc_id", confidence: float = CONFIDENCE, support: int = SUPPORT, types: Sequence[str] = (), blacklist: bool = False, allowed: DataFrame | None = None, coreference: bool = False) -> DataFrame:
    """A whole request by names: spots, links, filters, and the answer as rows, json, xml, html or turtle."""
    spots = policy(SPOTTERS, spotter)(docs, built, confidence, key)
    best = policy(DISAMBIGUATORS, disambiguator)(docs, spots, built, key).filter(F.col("rank") == 1)
    got = with_types(best, built).transform(filters.pipeline(confidence, support, types, blacklist, allowed))
    got = filters.coreference(got, key) if coreference else got
    return policy(OUTPUTS, output)(docs, got, key)


OUTPUTS: dict[str, Callable[..., DataFrame]] = {
    "rows": lambda docs, links, key: links,
    "json": lambda docs, links, key: sinks.annotation_json(links, key),
    "xml": lambda docs, links, key: sinks.annotation_xml(links, key),
    "html": lambda docs, links, key: sinks.annotated_html(docs, links, key),
    "turtle": lambda docs, links, key: sinks.turtle_lines(links, key),
}
