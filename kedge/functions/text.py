"""Text to tokens, n-grams, sentences, windows and mentions, as Column expressions wherever Spark can say it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

from kedge.session import spread

# Patterns and word lists that results depend on.
WORD = "[\\p{L}\\p{N}]+"
TOKEN = "[\\p{L}\\p{N}]+|[^\\s\\p{L}\\p{N}]"
STOPWORDS = ("the", "a", "an", "and", "or", "of", "in", "on", "to", "is", "was", "for", "by", "with", "that", "it", "as", "at")
LANGUAGE_RULES = {"fr": ("\\b[dlDL]['’](?=\\p{L})", "  "), "it": ("\\b(?:l|un|L|Un)['’](?=\\p{L})", "  "), "en": ("['’]s\\b", " s")}


def words(text: Column) -> Column:
    """Runs of letters and digits, in order."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def lower_words(text: Column) -> Column:
    return words(F.lower(text))


def apostrophes(text: Column) -> Column:
    return F.translate(text, "’", "'")


def language_normalised(text: Column, lang: Column) -> Column:
    """Elisions and possessives become blanks before tokens are cut; the length stays, so offsets hold."""
    out = text
    for code, (pattern, by) in LANGUAGE_RULES.items():
        out = F.when(F.lower(lang).startswith(code), F.regexp_replace(text, pattern, by)).otherwise(out)
    return F.coalesce(out, text)


#: Items that a running sum adds one by one before it goes on from their total.
CHUNK = 64


def _placed(pairs: Column, token: str, start: str) -> Column:
    """Array of (token, start) of tokens t and the gaps g before them: a running sum of lengths.

    The sum goes over chunks of items: an array that grows by one item a step is copied each time,
    so growing it over a whole text would cost the square of its length.
    """
    n = F.size(pairs)
    shape = f"array<struct<{token}:string,{start}:int>>"
    chunks = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.floor((n - 1) / CHUNK).cast("int")), lambda c: F.slice(pairs, c * CHUNK + 1, CHUNK))).otherwise(F.array().cast("array<array<struct<t:string,g:string>>>"))

    def one(acc: Column, p: Column) -> Column:
        at = acc["at"] + F.char_length(p["g"])
        return F.struct((at + F.char_length(p["t"])).alias("at"), F.concat(acc["out"], F.array(F.struct(p["t"].alias(token), at.alias(start)))).alias("out"))

    def chunk(acc: Column, items: Column) -> Column:
        done = F.aggregate(items, F.struct(acc["at"].alias("at"), F.array().cast(shape).alias("out")), one)
        return F.transform(F.array(done), lambda x: F.struct(x["at"].alias("at"), F.concat(acc["out"], F.array(x["out"])).alias("out")))[0]

    zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{shape}>").alias("out"))
    return F.flatten(F.aggregate(chunks, zero, chunk, lambda acc: acc["out"]))


def with_spans(df: DataFrame, text: str, name: str = "s", pattern: str = WORD) -> DataFrame:
    """Add ``name``: array of (token, start), where each match of the pattern begins, 0-based, without leaving the JVM.

    What lies between two matches is what a split by the pattern leaves. Tokens and gaps are columns
    of their own, so that each is computed once.
    """
    cut = df.withColumns({"__t": F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)), "__g": F.split(text, pattern)})
    pairs = cut.withColumn("__p", F.arrays_zip(F.col("__t").alias("t"), F.slice("__g", F.lit(1), F.size("__t")).alias("g"))).drop("__t", "__g")
    return pairs.withColumn(name, _placed(F.col("__p"), "token", "start")).drop("__p")


def token_rows(df: DataFrame, key: str, text: str, pattern: str = WORD) -> DataFrame:
    """(key, pos, token): one row per token, from one explode."""
    return spread(df.select(key, text)).select(key, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))).alias("pos", "token"))


def token_spans(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, token, start) with character offsets."""
    rows = with_spans(spread(df.select(key, text)), text).select(key, F.posexplode("s").alias("pos", "s"))
    return rows.select(key, "pos", "s.token", "s.start")


def ngrams(tokens: Column, n: int) -> Column:
    """All runs of n tokens joined by blanks; none for shorter arrays. Give a column that holds the array: an expression would be evaluated once per run."""
    at = F.sequence(F.lit(1), F.size(tokens) - (n - 1))
    return F.when(F.size(tokens) >= n, F.transform(at, lambda i: F.array_join(F.slice(tokens, i, n), " "))).otherwise(F.array().cast("array<string>"))


def char_ngrams(text: Column, n: int = 3) -> Column:
    at = F.sequence(F.lit(1), F.char_length(text) - (n - 1))
    return F.when(F.char_length(text) >= n, F.transform(at, lambda i: F.substr(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def sentence_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, sent, words): the platform's sentence iterator; punctuation is dropped."""
    return df.select(key, F.posexplode(F.sentences(text)).alias("sent", "words"))


def context_window(tokens: Column, at: Column, width: Column | int, max_words: int, min_words: int) -> Column:
    """Up to ``max_words`` words around the mention at ``at`` (0-based, ``width`` words), alternately left and right; null below ``min_words``."""
    width = F.lit(width) if isinstance(width, int) else width
    room = F.greatest(F.lit(max_words) - width, F.lit(0))
    n = F.size(tokens)
    left_have, right_have = at, n - at - width
    left_want = F.ceil(room / 2).cast("int")
    left = F.least(left_have, F.greatest(left_want, room - right_have))
    right = F.least(right_have, room - left)
    got = F.slice(tokens, at - left + 1, left + width + right)
    return F.when(F.size(got) >= min_words, got)


#: A sentence ends at these signs before a blank; texts of more sentences than this are scored in windows of at least so many words.
SENTENCE_END = "[.!?]+\\s+"
LONG_TEXT, WINDOW_WORDS = 200, 200


def context_windows(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, window, start, text): a text of more than LONG_TEXT sentences in windows, each of whole sentences until they
    hold WINDOW_WORDS words; any other text is one window. Null texts have none."""
    ends = regex.compile(SENTENCE_END)
    word = regex.compile("[\\p{L}\\p{N}]+")

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], []]
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                window = start = at = n = 0
                for end in [*(m.end() for m in ends.finditer(t)), len(t)]:
                    n += sum(1 for _ in word.finditer(t, at, end))
                    at = end
                    if (n >= WINDOW_WORDS or end == len(t)) and end > start:
                        for col, v in zip(out, (k, window, start, t[start:end]), strict=True):
                            col.append(v)
                        window, start, n = window + 1, end, 0
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, pa.schema([b.schema.field(0), ("w", pa.int32()), ("s", pa.int32()), ("t", pa.string())]), strict=True)], names=[key, "window", "start", "text"])

    rows = df.filter(F.col(text).isNotNull()).select(key, F.col(text).alias("text"))
    long = F.size(F.regexp_extract_all("text", F.lit(SENTENCE_END), F.lit(0))) >= LONG_TEXT
    cut = rows.filter(long).mapInArrow(cut_up, f"{key} {dict(df.dtypes)[key]}, window int, start int, text string")
    return cut.unionByName(rows.filter(~long).select(key, F.lit(0).alias("window"), F.lit(0).alias("start"), "text"))


def mentions_in_brackets(text: Column) -> tuple[Column, Column]:
    """Plain text and the array of (name, offset) of [[name]] markup."""
    names = F.regexp_extract_all(text, F.lit("\\[\\[([^\\[\\]]*)\\]\\]"), F.lit(1))
    plain = F.regexp_replace(text, "\\[\\[([^\\[\\]]*)\\]\\]", "$1")
    gaps = F.split(text, "\\[\\[[^\\[\\]]*\\]\\]")
    return plain, _placed(F.arrays_zip(names.alias("t"), F.slice(gaps, 1, F.size(names)).alias("g")), "name", "offset")


def wiki_links(text: Column) -> Column:
    """Array of (uri, name, confidence) of [[uri|name|confidence]]; a missing name is the uri."""
    inner = F.regexp_extract_all(text, F.lit("\\[\\[([^\\[\\]]*)\\]\\]"), F.lit(1))

    def one(link: Column) -> Column:
        parts = F.split(link, "\\|")
        return F.struct(parts[0].alias("uri"), F.coalesce(F.try_element_at(parts, F.lit(2)), parts[0]).alias("name"), F.try_element_at(parts, F.lit(3)).try_cast("double").alias("confidence"))

    return F.transform(inner, one)


def erase_markup(text: Column) -> Column:
    """[[a|b]] to b and [[a]] to a."""
    return F.regexp_replace(F.regexp_replace(text, "\\[\\[[^\\[\\]|]*\\|([^\\[\\]|]*)(?:\\|[^\\[\\]]*)?\\]\\]", "$1"), "\\[\\[([^\\[\\]]*)\\]\\]", "$1")


def without_templates(text: Column) -> Column:
    """{{…}} out, innermost first, as many times as they are deep in one another."""
    tokens = F.regexp_extract_all(text, F.lit("\\{\\{|\\}\\}"), F.lit(0))
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(acc: Column, t: Column) -> Column:
        now = F.greatest(acc["now"] + F.when(t == "{{", 1).otherwise(-1), F.lit(0))
        return F.struct(now.alias("now"), F.greatest(acc["most"], now).alias("most"))

    depth = F.aggregate(tokens, start, step)["most"]
    rounds = F.when(depth > 0, F.sequence(F.lit(1), depth)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(rounds, text, lambda acc, _: F.regexp_replace(acc, "\\{\\{[^{}]*\\}\\}", ""))


def strip_wiki(text: Column) -> Column:
    """Wiki markup out of a page: comments, references, templates, tables, files, headings, quotes, links, bullets, blank lines."""
    out = text
    for pattern, by in (
        ("(?s)<!--.*?-->", ""),
        ("(?s)<ref[^>/]*>.*?</ref>|<ref[^>]*/>", ""),
        ("(?s)\\{\\|.*?\\|\\}", ""),
        (None, ""),
        ("(?i)\\[\\[(?:file|image|category):[^\\[\\]]*\\]\\]", ""),
        ("__[A-Z]+__", ""),
        ("(?m)^=+ *(.*?) *=+ *$", "$1"),
        ("'{2,5}", ""),
        ("</?[a-zA-Z][^<>]*>", ""),
        ("(?m)^[*#:;]+ *", ""),
        ("\\[(?:https?)://[^ \\]]*(?: ([^\\]]*))?\\]", "$1"),
        ("\n{2,}", "\n"),
    ):
        out = without_templates(out) if pattern is None else F.regexp_replace(out, pattern, by)
    return F.trim(erase_markup(out))


def capital_runs(df: DataFrame, key: str, tokens: DataFrame) -> DataFrame:
    """(key, first, length, run): maximal runs of capitalised neighbouring tokens (islands of a window)."""
    caps = tokens.filter(F.col("token").rlike("^\\p{Lu}"))
    w = Window.partitionBy(key).orderBy("pos")
    islands = caps.withColumn("island", F.col("pos") - F.row_number().over(w))
    return islands.groupBy(key, "island").agg(F.min("pos").alias("first"), F.count(F.lit(1)).cast("int").alias("length"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda s: s["token"]), " ").alias("run")).drop("island")


_VOWELS = "aeiouy"
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")


def _regions(w: str) -> tuple[int, int]:
    def after(start: int) -> int:
        for i in range(start + 1, len(w)):
            if w[i] not in _VOWELS and w[i - 1] in _VOWELS:
                return i + 1
        return len(w)

    r1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    r1 = after(0) if r1 is None else r1
    return r1, after(r1) if r1 < len(w) else len(w)


def _short_syllable(w: str) -> bool:
    if len(w) == 2:
        return w[0] in _VOWELS and w[1] not in _VOWELS
    return len(w) >= 3 and w[-1] not in _VOWELS + "wxY" and w[-2] in _VOWELS and w[-3] not in _VOWELS


def stem(word: str) -> str:
    """English stem after the published Porter2 rules; words of two letters stay."""
    w = word.lower()
    if len(w) < 3 or not w.isascii():
        return w
    special = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
    if w in special:
        return special[w]
    if w in ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes"):
        return w
    w = w.lstrip("'")
    w = "".join("Y" if c == "y" and (i == 0 or w[i - 1] in "aeiou") else c for i, c in enumerate(w))
    r1, r2 = _regions(w)
    for s in ("'s'", "'s", "'"):
        if w.endswith(s):
            w = w[: -len(s)]
            break
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and any(c in _VOWELS for c in w[:-2]):
        w = w[:-1]
    if w in ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"):
        return w
    for s in ("eedly", "ingly", "edly", "eed", "ing", "ed"):
        if w.endswith(s):
            if s in ("eed", "eedly"):
                if len(w) - len(s) >= r1:
                    w = w[: -len(s)] + "ee"
            elif any(c in _VOWELS for c in w[: -len(s)]):
                w = w[: -len(s)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif w.endswith(_DOUBLES):
                    w = w[:-1]
                elif r1 >= len(w) and _short_syllable(w):
                    w += "e"
            break
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _VOWELS:
        w = w[:-1] + "i"
    step2 = {"ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble", "ogi": "og", "li": ""}
    for s in sorted(step2, key=len, reverse=True):
        if w.endswith(s):
            base = w[: -len(s)]
            if len(base) >= r1 and (s not in ("ogi", "li") or s == "ogi" and base.endswith("l") or s == "li" and base[-1:] in tuple("cdeghkmnrt")):
                w = base + step2[s]
            break
    step3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ative": "", "ical": "ic", "ness": "", "ful": ""}
    for s in sorted(step3, key=len, reverse=True):
        if w.endswith(s):
            if len(w) - len(s) >= (r2 if s == "ative" else r1):
                w = w[: -len(s)] + step3[s]
            break
    for s in ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic"):
        if w.endswith(s):
            if len(w) - len(s) >= r2 and (s != "ion" or w[-4:-3] in ("s", "t")):
                w = w[: -len(s)]
            break
    if w.endswith("e"):
        if len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _short_syllable(w[:-1]):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


@pandas_udf(StringType())
def stem_udf(tokens: pd.Series) -> pd.Series:
    """Stems of a column, each distinct token stemmed once."""
    known = {t: stem(t) for t in tokens.dropna().unique()}
    return tokens.map(known)
