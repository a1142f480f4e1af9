"""Numbers that describe a text, and by them prose told from lists, tables and junk.

The statistics are taken over whole texts. Labelling functions on them give weak labels where they
are sure and none elsewhere; boosted trees are trained on a bounded sample of weakly labelled
documents (``TRAIN_ROWS``, in the order of a hash, so of all sources), their probability of prose is
calibrated on the hand-checked documents, and every document is then scored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kedge.llm.boosting import Boosted, platt
from kedge.session import cut, spread

#: Most rows of the training sample and of the holdout.
TRAIN_ROWS = 6000
HOLDOUT_ROWS = 4000

# Words of the closed classes (articles, pronouns, prepositions, conjunctions, auxiliaries) of English, German, French and Spanish.
CLOSED_CLASS = frozenset(
    """
the a an this that these those he she it they we you i his her its their our of to in on at by for with from into about over under
between after before during until since and or but because if while although than as is are was were be been has have had not
der die das den dem des ein eine einer eines er sie es wir ich sich ihr von zu mit nach aus bei für auf an um durch zwischen über unter
seit und oder aber weil dass wenn als wie ist sind war waren wird wurde wurden hat hatte haben nicht im am zum
le la les un une des du de il elle nous vous ce cette son sa ses leur et ou mais que qui où dans sur par pour avec sans sous entre
depuis avant après au aux en est sont était fut ont avait ne pas se on
el los las una unos del al lo su sus y o pero como más con sin para por desde hasta sobre entre donde fue era son está no
""".split()
)
#: Words learnt from the corpus: those in at least this share of a language's texts, so many of them at most; and the texts a language must have.
LEARNT_SHARE, LEARNT_WORDS, LEARNT_TEXTS = 0.4, 50, 50
BULLET = re.compile(r"(?:[-–—•·*●▪◦‣+]|\d{1,3}[.)]|\[\d+\]|\(\w{1,3}\)|[a-z][.)]) ?\S|\d{3,4} [–—-] ")
FIELD = re.compile(r"[^:|;\t]{1,40}: ?\S.{0,48}$|[^:|;\t]{1,40}:$")
LOG = re.compile(r"\[?\d{4}-\d\d-\d\d|\[?\d\d:\d\d(?::\d\d)?\b|(?:info|warn|err|error|debug)\b")
GAPS = re.compile(r"\S(?: {2,}|\t+)(?=\S)")
HEX = re.compile(r"(?:[0-9a-f]{2,8}[ :]+){4,}[0-9a-f]{2,8}\b")
CODE = re.compile(r"[;{}]\s*$|\w\([^()]{0,200}\)\s{0,9}[;{]|\w\[\d{1,9}\]\s{0,9}=|</?\w{1,40}>|\b(?:var|function|return|def|import|class)\b [^=({:;]{0,80}[=({:;]")
CELL = re.compile(r'";"|","|,(?=[^\s,])')
ENDS = frozenset(".!?…。")
CLOSERS = "\"'”’»)]"
WORD = re.compile(r"[^\W\d_]+")
VOWELLESS = re.compile(r"(?<![^\W\d_])[bcdfghjklmnpqrstvwxz]{3,}(?![^\W\d_])")

NAMES = [
    "n_words", "mean_word_length", "symbol_ratio", "digit_ratio", "upper_ratio", "punct_line_ratio", "common_word_ratio", "n_lines", "words_per_line",
    "distinct_ratio", "top_word_ratio", "late_ratio", "longest_token", "alpha_word_ratio", "vowelless_ratio", "separators_per_word", "commas_per_word", "sentences_per_word",
    "prose_share", "bullet_share", "item_share", "inline_share", "cell_share", "field_share", "log_share", "code_share", "hex_share", "bare_share", "single_case_share",
]
KINDS = ["prose", "list", "table", "junk"]

# Classes of characters that are counted: 0 other, then as named below.
_OTHER, DIGIT, UPPER, LOWER, SYMBOL, PLAIN, COMMA, STOP, SEPARATOR, LATE, WHITE = range(11)
CLASS = np.zeros(65536, np.uint8)
for _chars, _class in (
    ("".join(chr(c) for c in range(33, 127)), SYMBOL), ("0123456789", DIGIT), ("".join(chr(c) for c in range(65, 91)), UPPER), ("".join(chr(c) for c in range(97, 123)), LOWER),
    (":'\"()-", PLAIN), (",", COMMA), (".!?", STOP), ("|;/»·•>", SEPARATOR), ("ÃÂ�¿½€™œžŸ", LATE), (" \t\n\r\x0b\x0c\u00a0\u2003\u3000", WHITE),
):
    for _c in _chars:
        CLASS[ord(_c)] = _class


def _line(line: str, n: int, common: float) -> str:
    """What a line (in lower case) of ``n`` tokens looks like, ``common`` of them being common words."""
    if n >= 4 and common >= 0.2 and "|" not in line and "\t" not in line:
        return "prose"
    if LOG.match(line):
        return "log"
    if HEX.search(line):
        return "hex"
    if line.count("|") >= 2 and n > 1 or "\t" in line or common < 0.15 and (len(GAPS.findall(line)) >= 2 or len(CELL.findall(line)) >= 2):
        return "cell"
    if BULLET.match(line):
        return "bullet"
    if common < 0.12 and CODE.search(line):
        return "code"
    if n >= 3 and common >= 0.15:
        return "prose"
    ended = line.rstrip(CLOSERS)[-1:] in ENDS
    if not ended and FIELD.match(line):
        return "field"
    if n >= 8 and (line.count(",") + line.count(";") + line.count("·") + line.count("•")) / n >= 0.12:
        return "inline"
    if n <= 8 and not ended:
        return "item"
    return "prose" if n >= 3 and common >= 0.1 else "bare"


def common_words(docs: DataFrame, text: str = "text", lang: str = "lang") -> frozenset[str]:
    """The closed classes, and of each language the words that most of its texts hold, learnt over all texts.

    A language is the first two letters of ``lang``; texts without one teach nothing, nor does a language of fewer
    than LEARNT_TEXTS texts. At most 1 / 0.02 languages times LEARNT_WORDS words come back: those of languages
    with a fiftieth of all texts.
    """
    rows = docs.select(F.lower(F.substring(lang, 1, 2)).alias("__l"), F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("\\p{L}+"), F.lit(0))).alias("__w")).filter(F.col("__l").isNotNull())
    sizes = rows.groupBy("__l").agg(F.count(F.lit(1)).alias("__n"))
    sizes = sizes.filter((F.col("__n") >= LEARNT_TEXTS) & (F.col("__n") * 50 >= sizes.agg(F.sum("__n")).scalar()))
    counts = rows.select("__l", F.explode("__w").alias("word")).groupBy("__l", "word").agg(F.count(F.lit(1)).alias("n"))
    shares = counts.join(F.broadcast(sizes), "__l").filter(F.col("n") >= LEARNT_SHARE * F.col("__n"))
    rank = F.row_number().over(Window.partitionBy("__l").orderBy(F.desc(F.col("n") / F.col("__n")), "word"))
    return CLOSED_CLASS | {r["word"] for r in shares.withColumn("r", rank).filter(F.col("r") <= LEARNT_WORDS).select("word").collect()}


def statistics(text: str | None, common_set: frozenset[str] = CLOSED_CLASS) -> list[float]:
    """The numbers of NAMES; all 0 for a null or empty text."""
    text = text or ""
    low = text.lower()
    words = WORD.findall(low)
    known = common_set.__contains__
    shares = dict.fromkeys(("prose", "bullet", "item", "inline", "cell", "field", "log", "code", "hex", "bare"), 0)
    n_tokens = n_lines = longest = ended = total = 0
    for line in low.splitlines():
        tokens = line.split()
        n = len(tokens)
        if not n:
            continue
        longest = max(longest, len(max(tokens, key=len)))
        line = line.strip()
        n_lines += 1
        n_tokens += n
        ended += line[-1] in ENDS or line.rstrip(CLOSERS)[-1:] in ENDS
        # a token of code holds several words, one of prose seldom more than one
        common = sum(map(known, tokens)) / n
        shares[_line(line.lstrip("> "), n, common)] += len(line)
        total += len(line)
    if not n_lines:
        return [0.0] * len(NAMES)
    kinds = np.bincount(CLASS[np.minimum(np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32), 65535)], minlength=11)
    n = max(1, len(text) - int(kinds[WHITE]))
    seen = Counter(words)
    alpha = max(1, len(words))
    upper, lower = int(kinds[UPPER]), int(kinds[LOWER])
    return [
        float(n_tokens), sum(map(len, words)) / alpha, int(kinds[SYMBOL]) / n, int(kinds[DIGIT]) / n, upper / max(1, upper + lower), ended / n_lines, sum(map(known, words)) / max(n_tokens, alpha), float(n_lines), n_tokens / n_lines,
        len(seen) / alpha, max(seen.values(), default=0) / alpha, int(kinds[LATE]) / n, float(longest), len(words) / n_tokens, len(VOWELLESS.findall(low)) / alpha, int(kinds[SEPARATOR]) / n_tokens, int(kinds[COMMA]) / n_tokens, int(kinds[STOP]) / n_tokens,
        *[v / total for v in shares.values()], float(upper == 0 or lower == 0),
    ]


def document_statistics(docs: DataFrame, key: str = "doc_id", text: str = "text", common: frozenset[str] = CLOSED_CLASS) -> DataFrame:
    """``key`` and the numbers of NAMES for every row; repeated texts and rows each get theirs."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = np.array([statistics(t, common) for t in b.column(1).to_pylist()], np.float64).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(rows[:, j]) for j in range(len(NAMES))]], names=[key, *NAMES])

    return spread(docs.select(key, text)).mapInArrow(measure, f"{key} {dict(docs.dtypes)[key]}, " + ", ".join(f"{n} double" for n in NAMES))


def weak_labels(x: pd.DataFrame) -> np.ndarray:
    """Index into KINDS where the rules are sure, -1 elsewhere."""
    table = x.cell_share + x.field_share
    listed = x.bullet_share + x.item_share + x.inline_share
    wild = (x.late_ratio > 0.01) | (x.symbol_ratio > 0.2) | (x.longest_token > 70) & (x.common_word_ratio < 0.1) | (x.vowelless_ratio > 0.12) & (x.common_word_ratio < 0.1)
    dull = (x.n_words > 20) & ((x.distinct_ratio < 0.12) & (x.common_word_ratio < 0.1) | (x.top_word_ratio > 0.3) & (x.common_word_ratio < 0.15))
    machine = x.log_share + x.code_share + x.hex_share > 0.6
    salad = (x.n_words > 20) & (x.common_word_ratio < 0.04) & (x.commas_per_word + x.separators_per_word < 0.05) & (x.words_per_line > 8) & (x.sentences_per_word < 0.02)
    menu = (x.separators_per_word > 0.3) & (x.distinct_ratio < 0.4) & (x.n_words > 12) & (x.digit_ratio < 0.05)
    junk = wild | dull | machine | salad | menu
    out = np.full(len(x), -1)
    ended = (x.prose_share > 0.75) & (x.punct_line_ratio >= 0.5) & (x.common_word_ratio > 0.15)
    out[(((x.prose_share > 0.95) & (x.common_word_ratio > 0.25) | ended) & ~wild).to_numpy()] = 0
    out[((listed > 0.85) & (table < 0.1) & ~junk).to_numpy()] = 1
    out[((table > 0.85) & (listed < 0.15) & ~junk).to_numpy()] = 2
    out[(junk & (x.prose_share < 0.5)).to_numpy()] = 3
    out[(wild & (x.late_ratio > 0.01)).to_numpy()] = 3
    return out


def _sample(measured: DataFrame, key: str, rows: int) -> pd.DataFrame:
    """At most ``rows`` rows in the order of a hash of the key.

    Rows whose hash is beyond twice the share wanted can't be among them (but for a chance that vanishes
    with the number of rows), so each task passes on its few rows instead of ``rows`` of its own.
    """
    n = measured.count()
    place = F.pmod(F.xxhash64(key), F.lit(1_000_000))
    share = 1_000_000 if n <= 2 * rows else -(-2_000_000 * rows // n)
    return measured.filter(place < share).orderBy(place, key).limit(rows).toPandas()


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", train_rows: int = TRAIN_ROWS, holdout_rows: int = HOLDOUT_ROWS) -> DataFrame:
    """``key``, the statistics, ``p_prose`` and ``kind`` for every row.

    ``labels`` (key, quality: 1 prose, 0 not, annotator; ``auto`` ones aren't hand-checked) may be empty or hold nulls and errors; without both
    classes the probability stays as the trees give it. Hand-checked documents are held out: the trees don't see them. Texts without any character are junk. No
    documents give no rows.
    """
    measured = cut(document_statistics(docs, key, common=common_words(docs) if "lang" in docs.columns else CLOSED_CLASS))
    by_hand = F.col("quality").isin(0, 1) & ~F.coalesce(F.col("annotator") == "auto", F.lit(False))
    checked = labels.filter(by_hand).groupBy(key).agg(F.max("quality").alias("quality"))
    train = _sample(measured.join(checked, key, "left_anti"), key, train_rows)
    y = weak_labels(train)
    model = Boosted(len(KINDS)).fit(train.loc[y >= 0, NAMES].to_numpy(), y[y >= 0])
    hold = _sample(measured.join(checked, key), key, holdout_rows)
    p = model.predict(hold[NAMES].to_numpy())[:, 0] if len(hold) else np.empty(0)
    a, b = platt(p, hold["quality"].to_numpy().astype(float))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([batch.column(n).to_numpy(zero_copy_only=False) for n in NAMES], 1)
            q = model.predict(x)
            z = np.log(np.clip(q[:, 0], 1e-6, 1 - 1e-6) / np.clip(1 - q[:, 0], 1e-6, 1))
            prose = 1 / (1 + np.exp(-(a * z + b)))
            prose[x[:, 0] == 0] = 0
            kind = np.where(prose >= 0.5, 0, 1 + q[:, 1:].argmax(1))
            kind[x[:, 0] == 0] = 3
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(prose), pa.array([KINDS[k] for k in kind], pa.string())], names=[*batch.schema.names, "p_prose", "kind"])

    types = ", ".join(f"{c} {t}" for c, t in measured.dtypes)
    return measured.mapInArrow(score, f"{types}, p_prose double, kind string")
