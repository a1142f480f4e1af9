import pytest

from kedge.functions import phonetic as p


@pytest.mark.parametrize(
    ("word", "keys"),
    [("Smith", ("SM0", "XMT")), ("Schmidt", ("XMT", "SMT")), ("Knight", ("NT", "NT")), ("Wright", ("RT", "RT")), ("Phone", ("FN", "FN")), ("Catherine", ("K0RN", "KTRN")), ("Xavier", ("SF", "SFR")), ("judge", ("JJ", "AJ")), ("nation", ("NXN", "NXN")), ("", ("", "")), ("река", ("", "")), ("Éclair", ("AKLR", "AKLR"))],
)
def test_keys(word, keys):
    assert p.double_metaphone(word) == keys


def test_long_words_and_any_text_end():
    assert len(p.double_metaphone("brt" * 5_000)[0]) == 8
    for w in ("tz", "ggg", "cch", "sch", "'", "zz", "wr", "x", "q" * 99, "mb", "gn"):
        p.double_metaphone(w)


def test_sounding_alike(spark):
    names = spark.createDataFrame([("Jon Smith",), ("Kathryn",), ("the of",), (None,), ("",), ("Jon Smith",)], "name string")
    known = spark.createDataFrame([("John Smythe",), ("Catherine",), ("John Brown",)], "name string")
    got = {(r["name"], r["form"]) for r in p.sounding_alike(names, known).collect()}
    assert ("Jon Smith", "John Smythe") in got and ("Jon Smith", "John Brown") not in got
    assert p.sounding_alike(names, known.limit(0)).count() == 0
