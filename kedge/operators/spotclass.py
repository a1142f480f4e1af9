"""Which spots are worth linking: lexical features of a mention, counts of its neighbourhood, a classifier, its training data and tuning."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kedge.functions import text as T
from kedge.operators.skew import salted_join
from kedge.operators.spotting import spot_features
from kedge.session import spread

# Closed-class words that stand in for part-of-speech tags where none are given, and names that are never linked.
PREPOSITIONS = ("of", "in", "on", "at", "by", "for", "from", "with", "to", "into", "over", "under", "between", "after", "before", "during")
POSSESSIVES = ("my", "your", "his", "her", "its", "our", "their")
AUXILIARIES = ("is", "was", "are", "were", "has", "have", "had", "be", "been", "will", "would", "can", "could", "may", "did", "does")
CONJUNCTIONS = ("and", "or", "but")
QUOTES = ('"', "“", "”", "'", "‘", "’", "«", "»")
CALENDAR = (
    "January|February|March|April|May|June|July|August|September|October|November|December|Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday"
    "|kilometres?|metres?|kilometers?|meters?|miles?|feet|years?|months?|days?|hours?|percent|Mr|Mrs|Ms|Dr|Prof|Sir"
)

LEFT = "([\\p{L}\\p{N}]+|[^\\s\\p{L}\\p{N}])\\s*$"
RIGHT = "^\\s*([\\p{L}\\p{N}]+|[^\\s\\p{L}\\p{N}])"
FEATURES = ("case_class", "quoted", "before_of", "after_of", "before_preposition", "near_upper", "before_verb", "after_possessive", "in_enumeration", "plural", "possessive")


def neighbours(mentions: DataFrame, context: str, start: str, name: str) -> DataFrame:
    """Mentions with the token to the ``left_token`` and ``right_token`` (null at the ends of the text) and whether they begin a sentence (``initial``)."""
    before = F.substr(F.col(context), F.lit(1), F.col(start))
    after = F.substr(F.col(context), F.col(start) + F.char_length(name) + 1)
    left, right = F.regexp_extract(before, LEFT, 1), F.regexp_extract(after, RIGHT, 1)
    none = F.lit(None).cast("string")
    return mentions.withColumns({"left_token": F.when(left != "", left).otherwise(none), "right_token": F.when(right != "", right).otherwise(none), "initial": (F.trim(before) == "") | before.rlike("[.!?]\\s*$")})


def lexical_features(mentions: DataFrame, name: str = "name") -> DataFrame:
    """Adds the FEATURES, and ``pre_pos`` and ``next_pos`` (null where no rule holds), from what ``neighbours`` gives.

    case_class: 2 all upper case, 1 upper case inside a sentence, 3 at its beginning, 0 none. Without a tagger,
    closed classes of words stand for their tags; what only a tagger knows (adjectives, full verbs) is not set.
    """
    n, left, right = F.col(name), F.col("left_token"), F.col("right_token")
    upper = n.rlike("^\\p{Lu}")
    yes = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    case_class = F.when(F.upper(n) == n, 2).when(~F.col("initial") & upper, 1).when(F.col("initial") & upper, 3).otherwise(0)
    low = F.lower(left)
    pre = F.when(low.isin(*POSSESSIVES) & right.isin(*PREPOSITIONS), 0).when(left == "of", 2).when(left.isin(*PREPOSITIONS), 1).when(low.isin("a", "an"), 3).when(low == "the", 4)
    return mentions.withColumn("case_class", case_class).withColumns({
        "quoted": yes(left.isin(*QUOTES) & right.isin(*QUOTES)), "before_of": yes(right == "of"), "after_of": yes(left == "of"), "before_preposition": yes(right.isin(*PREPOSITIONS)),
        "near_upper": F.when(F.col("case_class") == 0, 0).otherwise(F.greatest(yes(right.rlike("^\\p{Lu}")), yes(left.rlike("^\\p{Lu}")))),
        "before_verb": yes(right.isin(*AUXILIARIES)), "after_possessive": yes(low.isin(*POSSESSIVES)), "in_enumeration": yes((left == ",") & right.isin(",", *CONJUNCTIONS)),
        "plural": yes(n.rlike("s$")), "possessive": yes(right.isin("'", "’")), "pre_pos": pre, "next_pos": F.when(right.isin(*AUXILIARIES), 0).when(right == "of", 1),
    })


def neighbourhood_counts(mentions: DataFrame, docs: DataFrame, key: str, name: str = "name", text: str = "text", least: int = 2) -> DataFrame:
    """Mentions with the corpus counts of their words (``uses``, of a single word) and of the pairs that they make with
    their neighbours (``left_pair``, ``right_pair``); a count below ``least`` is missing (null)."""
    words = spread(docs.select(text)).select(T.lower_words(F.col(text)).alias("w"))
    grams = words.select(F.explode(F.concat(F.col("w"), T.ngrams(F.col("w"), 2))).alias("__gram")).groupBy("__gram").agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") >= least)
    first, last = F.try_element_at("__w", F.lit(1)), F.try_element_at("__w", F.lit(-1))
    pair = lambda a, b: F.when(F.col("left_token" if a is None else "right_token").isNotNull(), F.concat_ws(" ", *([F.lower("left_token"), b] if a is None else [a, F.lower("right_token")])))
    slots = F.array(*[F.struct(F.lit(k).alias("k"), g.alias("gram")) for k, g in (("uses", F.when(F.size("__w") == 1, first)), ("left_pair", pair(None, first)), ("right_pair", pair(last, None)))])
    asked = mentions.select(key, "left_token", "right_token", T.lower_words(F.col(name)).alias("__w")).select(key, F.explode(slots).alias("s")).select(key, "s.k", "s.gram").filter(F.col("gram").isNotNull())
    met = salted_join(asked, grams, "gram", "__gram", spread=[key])
    counts = met.groupBy(F.col(key).alias("__key")).agg(*[F.max(F.when(F.col("k") == k, F.col("__n"))).alias(k) for k in ("uses", "left_pair", "right_pair")])
    return mentions.join(counts, F.col(key) == F.col("__key"), "left").drop("__key")


def linear(weights: dict[str, float], bias: float) -> Column:
    """Confidence of a linear model: the logistic function of the weighted features; a missing feature counts as 0."""
    total = F.lit(float(bias))
    for k, w in weights.items():
        total = total + F.lit(float(w)) * F.coalesce(F.col(k).cast("double"), F.lit(0.0))
    return 1 / (1 + F.exp(-total))


def classified(mentions: DataFrame, confidence: Column) -> DataFrame:
    """Adds ``confidence`` (that the spot is worth linking) and ``spot_class``: valid from one half on, else common."""
    got = mentions.withColumn("confidence", confidence)
    return got.withColumn("spot_class", F.when(F.col("confidence") >= 0.5, "valid").otherwise("common"))


def selected(mentions: DataFrame, single: Column, several: Column, name: str = "name", tag: str | None = None) -> DataFrame:
    """The spots worth linking. A single word must be a noun or foreign word by its tag (an adjective in upper case is kept
    without more questions; where there is no tag, any word passes), hit no calendar, unit or title word, and be valid
    by the ``single`` confidence; several words are judged by the ``several`` confidence. Empty names are dropped."""
    one = F.size(T.words(F.col(name))) <= 1
    noun = rescued = None
    if tag is not None:
        t = F.lower(tag)
        noun = F.coalesce(t.rlike("^(?:n[^r].*|n|fw.*)$"), F.lit(True))
        rescued = F.coalesce(t.startswith("j"), F.lit(False)) & F.col(name).rlike("^\\p{Lu}")
    keep_one = ~F.col(name).rlike(f"^(?:{CALENDAR})$") & (single >= 0.5)
    keep_one = keep_one if noun is None else (noun & keep_one) | rescued
    return mentions.filter((F.trim(name) != "") & F.when(one, keep_one).otherwise(several >= 0.5))


def fit(rows: DataFrame, label: str, features: Sequence[str] = FEATURES, iterations: int = 50) -> tuple[dict[str, float], float]:
    """Weights and bias for ``linear``, fitted over all rows by logistic regression; null features count as 0."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    clean = rows.select(F.col(label).cast("double").alias("label"), *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features])
    data = VectorAssembler(inputCols=list(features), outputCol="features").transform(clean)
    model = LogisticRegression(maxIter=iterations, regParam=1e-3).fit(data)
    return dict(zip(features, map(float, model.coefficients), strict=True)), float(model.intercept)


def tuned_weights(spots: DataFrame, gold: str, name: str = "name", p: str = "p") -> np.ndarray:
    """The four weights of the spot score by least squares of the gold mark (true or false) over all spots.

    The sums of products are one aggregate of fifteen numbers; only these come to the driver. Features that never
    differ get the smallest weights that fit.
    """
    x = [f.cast("double") for f in spot_features(F.col(name), F.col(p))]
    y = F.col(gold).cast("double")
    sums = [F.sum(a * b) for i, a in enumerate(x) for b in x[i:]] + [F.sum(a * y) for a in x]
    got = [0.0 if v is None else float(v) for v in spots.agg(*[c.alias(f"s{i}") for i, c in enumerate(sums)]).first()]
    xx, at = np.zeros((4, 4)), 0
    for i in range(4):
        for j in range(i, 4):
            xx[i, j] = xx[j, i] = got[at]
            at += 1
    return np.linalg.lstsq(xx, np.array(got[at:]), rcond=None)[0]
