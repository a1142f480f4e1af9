"""One form for text that looks the same in print.

Characters first: width, presentation forms of joined letters and numerals, invisible characters,
kinds of blank and hyphen, composition of accents. Then letters, token by token: the dominant script
of the token is determined, and look-alikes of other scripts are exchanged only where the outcome
stands in the corpus vocabulary (the tokens of the given names). A token written wholly in
look-alikes has no second script to tell it; it too is exchanged only for a vocabulary word.
Letter case, accents and spelling are kept.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kedge.operators.skew import salted_join
from kedge.session import cut, spread

# Letters of the same printed shape, Latin then Cyrillic or Greek or other scripts.
SAME_SHAPE = """
A А Α Ꭺ
B В Β Ᏼ
C С Ϲ Ꮯ
E Е Ε Ꭼ
F Ϝ
G Ԍ Ꮐ
H Н Η Ꮋ
I І Ι Ӏ
J Ј Ϳ Ꭻ
K К Κ Ꮶ
L Ꮮ
M М Μ Ꮇ
N Ν
O О Ο Օ
P Р Ρ Ꮲ
Q Ԛ
S Ѕ Տ Ꮪ
T Т Τ Ꭲ
U Ս
V Ѵ Ꮩ
W Ԝ Ꮃ
X Х Χ
Y Ү Υ
Z Ζ Ꮓ
a а ɑ
c с ϲ
d ԁ
e е
f ꬵ
g ɡ
h һ հ
i і
j ј ϳ
l ӏ
n ո
o о ο օ
p р ρ
q ԛ
s ѕ
u ս
v ѵ ν
w ԝ
x х
y у
ä ӓ
ë ё
ï ї
ö ӧ
ÿ ӱ
Ä Ӓ
Ë Ё
Ï Ї
Ö Ӧ
æ ӕ
Æ Ӕ
Ə Ә
ə ә
Г Γ
П Π
Ф Φ
κ к
φ ф
"""
#: Characters without a printed shape of their own.
INVISIBLE = re.compile("[\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\u3164\ufe00-\ufe0f\ufeff\uffa0\U000e0000-\U000e0fff]")
BLANKS = re.compile("[\t\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000]")
HYPHENS = re.compile("[\u2010\u2011\ufe63\uff0d]")
#: Presentation forms whose decomposition prints the same: ligatures, full width, Roman numerals, joined letters, unit letters, ellipsis.
SAME_IN_PRINT = re.compile("[\ufb00-\ufb06\ufb13-\ufb17\uff01-\uff5e\uffe0-\uffe6\u2160-\u217f\u0132\u0133\u01c4-\u01cc\u01f1-\u01f3\u212a\u212b\u2126\u2024-\u2026]")


def _look_table() -> dict[int, str]:
    """Every letter to the first of its row: rows that share a letter become one."""
    first: dict[str, str] = {}
    for row in SAME_SHAPE.split("\n"):
        letters = row.split()
        if letters:
            home = next((first[x] for x in letters if x in first), letters[0])
            for x in letters:
                first.setdefault(x, home)
    return {ord(k): v for k, v in first.items()}


LOOK = _look_table()


def settled(text: str) -> str:
    """Characters in one form: width, joined forms, invisibles, blanks, hyphens, composition."""
    if text.isascii() and "\t" not in text:
        return text
    text = HYPHENS.sub("-", INVISIBLE.sub("", text))
    text = SAME_IN_PRINT.sub(lambda m: unicodedata.normalize("NFKC", m[0]), text)
    return unicodedata.normalize("NFC", BLANKS.sub(" ", text))


def look(token: str) -> str:
    """What the token looks like: accents apart, each letter replaced by the first of its shape."""
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", token.translate(LOOK)).translate(LOOK))


@lru_cache(maxsize=4096)
def script(char: str) -> str | None:
    if not char.isalpha():
        return None
    name = unicodedata.name(char, "")
    return next((s for s in ("LATIN", "CYRILLIC", "GREEK", "ARMENIAN", "CHEROKEE") if name.startswith(s)), "LATIN" if "KELVIN" in name or "ANGSTROM" in name else "OTHER")


def scripts(token: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for c in token:
        if s := script(c):
            out[s] = out.get(s, 0) + 1
    return out


def dominant(token: str) -> str | None:
    """The script of most of the token's letters; of several as frequent, the one met first."""
    got = scripts(token)
    return max(got, key=got.__getitem__) if got else None


PIECE = re.compile(r"[^ \-]+|[ \-]+")
_SCHEMA = "pos int, piece string, look string, script string, mixed boolean"


def pieces(values: DataFrame) -> DataFrame:
    """(value, known, pos, piece, look, script, mixed): the tokens of each value once its characters are settled, with
    what each looks like, its dominant script, and whether it mixes scripts; what stands between tokens has no look."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, tuple[str, str | None, bool]] = {}
        for b in batches:
            out: list[list] = [[] for _ in range(7)]
            for value, known in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for pos, piece in enumerate(PIECE.findall(settled(value)) or [""]):
                    shown: tuple = (None, None, False)
                    if piece and piece[0] not in " -":
                        if piece not in seen:
                            if len(seen) > 100_000:
                                seen.clear()
                            seen[piece] = (look(piece), dominant(piece), len(scripts(piece)) > 1)
                        shown = seen[piece]
                    for col, v in zip(out, (value, known, pos, piece, *shown), strict=True):
                        col.append(v)
            types = [pa.string(), pa.bool_(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["value", "known", "pos", "piece", "look", "script", "mixed"])

    return values.select("value", "known").mapInArrow(read, f"value string, known boolean, {_SCHEMA}")


def token_repairs(rows: DataFrame) -> DataFrame:
    """(piece, repaired, class): for each token that looks like words of the vocabulary (the tokens of known values) the
    word that takes its place, and the first of the words that all look so.

    A vocabulary word of one script stays. Of several words that look like the token, the one in the token's
    dominant script is taken, then the token itself, then the first. Tokens without such a word aren't
    here: they stay as they are. Token and word meet by an equality join on their look, so neither the
    vocabulary nor the tokens must fit into one task.
    """
    words = rows.filter(F.col("known") & F.col("look").isNotNull()).select(F.col("piece").alias("word"), "look", F.col("script").alias("word_script")).distinct()
    tokens = rows.filter(F.col("look").isNotNull()).select("piece", "look", "script", "mixed").distinct()
    same = F.col("word") == F.col("piece")
    order = F.struct((~(same & ~F.col("mixed"))).alias("a"), (~F.col("word_script").eqNullSafe(F.col("script"))).alias("b"), (~same).alias("c"), F.col("word").alias("d"))
    return tokens.join(words, "look").groupBy("piece").agg(F.min_by("word", order).alias("repaired"), F.min("word").alias("class"))


def repair_values(values: DataFrame) -> DataFrame:
    """(value, known, repaired, key) of distinct ``values`` (value, known: whether its tokens are vocabulary), null ones left out.

    ``repaired`` is the one form; ``key`` has each repaired token as the first word of its looks, so that values of
    one look meet even where the vocabulary holds it in several scripts. The empty text stays empty.
    """
    rows = cut(pieces(spread(values.filter(F.col("value").isNotNull()))))
    fixed = token_repairs(rows).filter((F.col("repaired") != F.col("piece")) | (F.col("class") != F.col("piece"))).withColumnRenamed("piece", "__t")
    met = salted_join(rows.select("value", "known", "pos", "piece"), fixed, "piece", "__t", "left", spread=["value", "pos"])
    parts = F.array_sort(F.collect_list(F.struct("pos", F.coalesce("repaired", "piece").alias("r"), F.coalesce("class", "piece").alias("k"))))
    joined = lambda c: F.array_join(F.transform("__x", lambda x: x[c]), "")
    return met.groupBy("value", "known").agg(parts.alias("__x")).select("value", "known", joined("r").alias("repaired"), joined("k").alias("key"))


def _values(forms: DataFrame, names: DataFrame) -> DataFrame:
    known = names.filter(F.col("name").isNotNull()).select(F.col("name").alias("value")).distinct()
    odd = forms.filter(F.col("surface_form").isNotNull()).select(F.col("surface_form").alias("value")).distinct().join(known, "value", "left_anti")
    return known.withColumn("known", F.lit(True)).unionByName(odd.withColumn("known", F.lit(False)))


def repair_forms(forms: DataFrame, names: DataFrame) -> DataFrame:
    """(surface_form, repaired) of every distinct form but null, by the vocabulary of ``names.name``."""
    kept = forms.select("surface_form").distinct()
    return repair_values(_values(kept, names)).select(F.col("value").alias("surface_form"), "repaired").join(kept, "surface_form", "left_semi")


def match_lookalikes(occs: DataFrame, names: DataFrame) -> DataFrame:
    """(occ_id, sf_id): mentions equal to no name that are the same as one after repair.

    A mention that looks like several names comes out with each. Null and empty mentions and names
    match nothing. Each distinct spelling is repaired once, so frequent ones cost nothing more.
    """
    names = names.select("sf_id", "name")
    fixed = repair_values(_values(occs, names)).filter(F.col("value") != "")
    odd = fixed.filter(~F.col("known")).select(F.col("value").alias("__sf"), "key")
    pairs = odd.join(fixed.filter("known").select(F.col("value").alias("name"), "key"), "key").join(names, "name").select("__sf", "sf_id")
    # the pairs are fewer than the spellings of known names; where a few spellings hold most rows, the join splits them
    rows = occs.filter(F.col("surface_form").isNotNull()).select("occ_id", "surface_form")
    return salted_join(rows, pairs, "surface_form", "__sf", spread=["occ_id"]).select("occ_id", "sf_id")
