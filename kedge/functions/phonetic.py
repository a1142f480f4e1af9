"""Phonetic keys of words by the published double-metaphone rules, and lookup of names by them."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf
from pyspark.sql.types import StringType

from kedge.functions import text as T

# Letters that are vowels to the rules, and the length of a key.
VOWELS = "AEIOUY"
MOST = 8


class _Word:
    """A word in capitals, read from left to right into a first and a second key."""

    def __init__(self, word: str, most: int) -> None:
        plain = unicodedata.normalize("NFD", word.upper())
        self.w = "".join(c for c in plain if c.isascii() and c.isalpha() or c in "ÇÑ")
        self.most, self.one, self.two, self.i = most, "", "", 0
        self.slavic = any(x in self.w for x in ("W", "K", "CZ", "WITZ"))

    def has(self, at: int, *options: str) -> bool:
        return at >= 0 and any(self.w.startswith(o, at) for o in options)

    def vowel(self, at: int) -> bool:
        return 0 <= at < len(self.w) and self.w[at] in VOWELS

    def put(self, one: str, two: str | None = None, step: int = 1) -> None:
        self.one += one
        self.two += one if two is None else two
        self.i += step

    def skip(self, letter: str) -> int:
        """1, or 2 where the letter stands twice."""
        return 2 if self.has(self.i + 1, letter) else 1

    def read(self) -> tuple[str, str]:
        if self.has(0, "GN", "KN", "PN", "WR", "PS"):
            self.i = 1
        elif self.has(0, "X"):
            self.put("S")
        while self.i < len(self.w) and (len(self.one) < self.most or len(self.two) < self.most):
            c = self.w[self.i]
            rule = getattr(self, f"_{c.lower()}", None)
            if c in VOWELS:
                self.put("A" if self.i == 0 else "")
            elif rule is not None:
                rule()
            else:
                self.put({"Q": "K", "V": "F", "N": "N", "M": "M", "F": "F", "B": "P"}.get(c, ""), step=self.skip(c))
        return self.one[: self.most], self.two[: self.most]

    def _m(self) -> None:
        silent = self.has(self.i - 1, "UMB") and (self.i + 2 == len(self.w) or self.has(self.i + 2, "ER"))
        self.put("M", step=2 if silent or self.has(self.i + 1, "M") else 1)

    def _c(self) -> None:
        i = self.i
        if i > 1 and not self.vowel(i - 2) and self.has(i - 1, "ACH") and not self.has(i + 2, "I") and (not self.has(i + 2, "E") or self.has(i - 2, "BACHER", "MACHER")):
            self.put("K", step=2)
        elif i == 0 and self.has(0, "CAESAR"):
            self.put("S", step=2)
        elif self.has(i, "CHIA"):
            self.put("K", step=2)
        elif self.has(i, "CH"):
            if i > 0 and self.has(i, "CHAE"):
                self.put("K", "X", 2)
            elif i == 0 and self.has(1, "HARAC", "HARIS", "HOR", "HYM", "HIA", "HEM") and not self.has(0, "CHORE"):
                self.put("K", step=2)
            elif self.has(0, "VAN ", "VON ", "SCH") or self.has(i - 2, "ORCHES", "ARCHIT", "ORCHID") or self.has(i + 2, "T", "S") or (i == 0 or self.has(i - 1, "A", "O", "U", "E")) and (i + 2 == len(self.w) or self.has(i + 2, "L", "R", "N", "M", "B", "H", "F", "V", "W")):
                self.put("K", step=2)
            elif i > 0:
                self.put("K" if self.has(0, "MC") else "X", "K", 2)
            else:
                self.put("X", step=2)
        elif self.has(i, "CZ") and not self.has(i - 2, "WICZ"):
            self.put("S", "X", 2)
        elif self.has(i + 1, "CIA"):
            self.put("X", step=3)
        elif self.has(i, "CC") and not (i == 1 and self.w[0] == "M"):
            if self.has(i + 2, "I", "E", "H") and not self.has(i + 2, "HU"):
                hard = i == 1 and self.w[0] == "A" or self.has(i - 1, "UCCEE", "UCCES")
                self.put("KS" if hard else "X", step=3)
            else:
                self.put("K", step=2)
        elif self.has(i, "CK", "CG", "CQ"):
            self.put("K", step=2)
        elif self.has(i, "CI", "CE", "CY"):
            self.put("S", "X" if self.has(i, "CIO", "CIE", "CIA") else "S", 2)
        else:
            self.put("K", step=2 if self.has(i + 1, "C", "K", "Q") and not self.has(i + 1, "CE", "CI") else 1)

    def _ç(self) -> None:
        self.put("S")

    def _d(self) -> None:
        if self.has(self.i, "DG"):
            soft = self.has(self.i + 2, "I", "E", "Y")
            self.put("J" if soft else "TK", step=3 if soft else 2)
        else:
            self.put("T", step=2 if self.has(self.i, "DT", "DD") else 1)

    def _g(self) -> None:
        i, w = self.i, self.w
        if self.has(i + 1, "H"):
            if i > 0 and not self.vowel(i - 1):
                self.put("K", step=2)
            elif i == 0:
                self.put("J" if self.has(2, "I") else "K", step=2)
            elif self.has(i - 2, "B", "H", "D") or self.has(i - 3, "B", "H", "D") or self.has(i - 4, "B", "H"):
                self.put("", step=2)
            elif i > 2 and self.has(i - 1, "U") and self.has(i - 3, "C", "G", "L", "R", "T"):
                self.put("F", step=2)
            else:
                self.put("K" if i > 0 and not self.has(i - 1, "I") else "", step=2)
        elif self.has(i + 1, "N"):
            if i == 1 and self.vowel(0) and not self.slavic:
                self.put("KN", "N", 2)
            elif not self.has(i + 2, "EY") and not self.slavic:
                self.put("N", "KN", 2)
            else:
                self.put("KN", step=2)
        elif self.has(i + 1, "LI") and not self.slavic:
            self.put("KL", "L", 2)
        elif i == 0 and self.has(1, "Y", "ES", "EP", "EB", "EL", "EY", "IB", "IL", "IN", "IE", "EI", "ER"):
            self.put("K", "J", 2)
        elif self.has(i + 1, "ER", "Y") and not self.has(0, "DANGER", "RANGER", "MANGER") and not self.has(i - 1, "E", "I", "RGY", "OGY"):
            self.put("K", "J", 2)
        elif self.has(i + 1, "E", "I", "Y") or self.has(i - 1, "AGGI", "OGGI"):
            if self.has(0, "VAN ", "VON ", "SCH") or self.has(i + 1, "ET"):
                self.put("K", step=2)
            else:
                self.put("J", "J" if self.has(i + 1, "IER") and i + 4 == len(w) else "K", 2)
        else:
            self.put("K", step=self.skip("G"))

    def _h(self) -> None:
        sounds = (self.i == 0 or self.vowel(self.i - 1)) and self.vowel(self.i + 1)
        self.put("H" if sounds else "", step=2 if sounds else 1)

    def _j(self) -> None:
        i = self.i
        if self.has(0, "JOSE", "SAN "):
            self.put("H" if self.w == "JOSE" or self.has(0, "SAN ") else "J", "H", 1)
        elif i == 0:
            self.put("J", "A", self.skip("J"))
        elif self.vowel(i - 1) and not self.slavic and self.has(i + 1, "A", "O"):
            self.put("J", "H", self.skip("J"))
        elif i + 1 == len(self.w):
            self.put("J", "", 1)
        else:
            silent = self.has(i + 1, "L", "T", "K", "S", "N", "M", "B", "Z") or self.has(i - 1, "S", "K", "L")
            self.put("" if silent else "J", step=self.skip("J"))

    def _k(self) -> None:
        self.put("K", step=self.skip("K"))

    def _l(self) -> None:
        spanish = self.has(self.i, "LL") and (self.i + 3 == len(self.w) and self.has(self.i - 1, "ILLO", "ILLA", "ALLE") or self.w.endswith(("AS", "OS", "A", "O")) and self.has(self.i - 1, "ALLE"))
        self.put("L", "" if spanish else "L", self.skip("L"))

    def _ñ(self) -> None:
        self.put("N")

    def _p(self) -> None:
        if self.has(self.i + 1, "H"):
            self.put("F", step=2)
        else:
            self.put("P", step=2 if self.has(self.i + 1, "P", "B") else 1)

    def _r(self) -> None:
        french = self.i + 1 == len(self.w) and not self.slavic and self.has(self.i - 2, "IE") and not self.has(self.i - 4, "ME", "MA")
        self.put("" if french else "R", "R", self.skip("R"))

    def _s(self) -> None:
        i = self.i
        if self.has(i - 1, "ISL", "YSL"):
            self.put("")
        elif i == 0 and self.has(0, "SUGAR"):
            self.put("X", "S")
        elif self.has(i, "SH"):
            self.put("S" if self.has(i + 1, "HEIM", "HOEK", "HOLM", "HOLZ") else "X", step=2)
        elif self.has(i, "SIO", "SIA"):
            self.put("S", "S" if self.slavic else "X", 3)
        elif i == 0 and self.has(1, "M", "N", "L", "W") or self.has(i + 1, "Z"):
            self.put("S", "X", 2 if self.has(i + 1, "Z") else 1)
        elif self.has(i, "SC"):
            if self.has(i + 2, "H"):
                if self.has(i + 3, "OO", "ER", "EN", "UY", "ED", "EM"):
                    self.put("X" if self.has(i + 3, "ER", "EN") else "SK", "SK", 3)
                else:
                    self.put("X", "S" if i == 0 and not self.vowel(3) and not self.has(3, "W") else "X", 3)
            else:
                soft = self.has(i + 2, "I", "E", "Y")
                self.put("S" if soft else "SK", step=3)
        else:
            french = i + 1 == len(self.w) and self.has(i - 2, "AI", "OI")
            self.put("" if french else "S", "S", 2 if self.has(i + 1, "S", "Z") else 1)

    def _t(self) -> None:
        if self.has(self.i, "TION", "TIA", "TCH"):
            self.put("X", step=3)
        elif self.has(self.i, "TH", "TTH"):
            plain = self.has(self.i + 2, "OM", "AM") or self.has(0, "VAN ", "VON ", "SCH")
            self.put("T" if plain else "0", "T", 2)
        else:
            self.put("T", step=2 if self.has(self.i + 1, "T", "D") else 1)

    def _w(self) -> None:
        i = self.i
        if self.has(i, "WR"):
            self.put("R", step=2)
        elif i == 0 and (self.vowel(1) or self.has(0, "WH")):
            self.put("A", "F" if self.vowel(1) else "A")
        elif i + 1 == len(self.w) and self.vowel(i - 1) or self.has(i - 1, "EWSKI", "EWSKY", "OWSKI", "OWSKY") or self.has(0, "SCH"):
            self.put("", "F")
        elif self.has(i, "WICZ", "WITZ"):
            self.put("TS", "FX", 4)
        else:
            self.put("")

    def _x(self) -> None:
        french = self.i + 1 == len(self.w) and self.has(self.i - 3, "IAU", "EAU") or self.has(self.i - 2, "AUX", "OUX") and self.i + 1 == len(self.w)
        self.put("" if french else "KS", step=2 if self.has(self.i + 1, "C", "X") else 1)

    def _z(self) -> None:
        if self.has(self.i + 1, "H"):
            self.put("J", step=2)
        else:
            two = self.has(self.i + 1, "ZO", "ZI", "ZA") or self.slavic and self.i > 0 and not self.has(self.i - 1, "T")
            self.put("S", "TS" if two else "S", self.skip("Z"))


def double_metaphone(word: str, most: int = MOST) -> tuple[str, str]:
    """The two phonetic keys of a word, the second equal to the first where there is one way to say it. Letters beyond
    Latin have no sound here: a word of none but those has empty keys."""
    return _Word(word, most).read()


@pandas_udf(StringType())
def phonetic_udf(words: pd.Series) -> pd.Series:
    """First keys of a column, each distinct word keyed once; null stays null."""
    known = {w: double_metaphone(w)[0] for w in words.dropna().unique()}
    return words.map(known)


def phonetic_terms(names: DataFrame, name: str = "name", stopwords: tuple[str, ...] = T.STOPWORDS) -> DataFrame:
    """(name, term): phonetic keys of the words that aren't stopwords, and runs of two and three of them.

    Each distinct word is keyed once. Names of stopwords or of letters without a key have no term.
    """
    rows = names.filter(F.col(name).isNotNull()).select(F.col(name).alias("name")).distinct()
    words = rows.select("name", F.posexplode(F.filter(T.lower_words(F.col("name")), lambda w: ~w.isin(*stopwords))).alias("pos", "w"))
    keyed = words.select("w").distinct().select("w", phonetic_udf("w").alias("key")).filter(F.col("key") != "")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "key"))), lambda x: x["key"])
    keys = words.join(keyed, "w").groupBy("name").agg(ordered.alias("k"))
    return keys.select("name", F.explode(F.array_distinct(F.concat("k", T.ngrams(F.col("k"), 2), T.ngrams(F.col("k"), 3)))).alias("term"))


def sounding_alike(names: DataFrame, known: DataFrame) -> DataFrame:
    """(name, form, shared): names with the known names that share the phonetic keys of at least two neighbouring words,
    or the single key that either of them consists of."""
    a, b = phonetic_terms(names), phonetic_terms(known).withColumnRenamed("name", "form")
    count = lambda df, c: df.groupBy(c).agg(F.count(F.lit(1)).alias(f"__{c}"))
    met = a.join(b, "term").groupBy("name", "form").agg(F.count(F.lit(1)).alias("shared"))
    sized = met.join(count(a, "name"), "name").join(count(b, "form"), "form")
    whole = (F.col("__name") == 1) & (F.col("__form") == 1)
    return sized.filter((F.col("shared") >= 3) | whole).select("name", "form", "shared")
