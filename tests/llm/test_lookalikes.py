import unicodedata

from kedge.llm import lookalikes as k

NAMES = ["Bidavorim Valley", "Táfavorum", "Guzu-Viram", "Гузу-вирам", "Λιβοβéηιμ", "Liti Lurest IV", "COPE", "Sanflor", "bidavorim"]


def repaired(spark, shown):
    """(repaired, key) of each text against the vocabulary of NAMES."""
    known = [(n, True) for n in NAMES]
    odd = [(t, False) for t in shown if t not in NAMES]
    return {r["value"]: (r["repaired"], r["key"]) for r in k.repair_values(spark.createDataFrame(known + odd, "value string, known boolean")).collect()}


def test_same_in_print(spark):
    cases = {
        "Bidаvοrim\u00a0Valley": "Bidavorim Valley",
        "Ｂｉｄａｖｏｒｉｍ　Ｖａｌｌｅｙ": "Bidavorim Valley",
        "Ta\u0301favorum": "Táfavorum",
        "Guzu\u2011Vi\u200bram\ufeff": "Guzu-Viram",
        "Гyзy-виpaм": "Гузу-вирам",
        "Liti Lurest Ⅳ": "Liti Lurest IV",
        "Sanﬂor": "Sanflor",
        "СОРЕ": "COPE",
        "Λιβoβéηιμ": "Λιβοβéηιμ",
    }
    got = repaired(spark, list(cases))
    for shown, name in cases.items():
        assert got[shown][0] == unicodedata.normalize("NFC", name), shown
        assert got[shown][1] == got[name][1]


def test_visible_differences_stay(spark):
    shown = ["BIDAVORIM VALLEY", "Tafavorum", "Táfávorum", "Guzu–Viram", "Guzu Viram", "Bidavorim Valleу²", "Bidavor1m Valley", "GuzuViram"]
    got = repaired(spark, shown)
    known = {got[n][1] for n in NAMES}
    assert not [t for t in shown if got[t][1] in known]


def test_only_vocabulary_words_are_exchanged(spark):
    got = repaired(spark, ["хаос pаndа", ""])
    assert got["хаос pаndа"][0] == "хаос pаndа"  # no known word looks so
    assert got[""] == ("", "")


def test_the_dominant_script_decides(spark):
    """The same look is in the vocabulary in two scripts: a mixed token becomes the word of its dominant one, and all meet."""
    rows = [("cope", True), ("соре", True), ("cорe", False), ("соpе", False), ("сoрe9", False)]
    got = {r["value"]: (r["repaired"], r["key"]) for r in k.repair_values(spark.createDataFrame(rows, "value string, known boolean")).collect()}
    assert got["соpе"][0] == "соре" and got["cope"][0] == "cope" and got["соре"][0] == "соре"
    assert len({got[v][1] for v in ("cope", "соре", "cорe", "соpе")}) == 1
    assert got["сoрe9"] == ("сoрe9", "сoрe9")


def test_match(spark):
    occs = spark.createDataFrame([(1, "Bidаvorim Valley", 9), (2, "Bidavorim Valley", 9), (3, None, 9), (4, "", 9), (5, "Ta\u0301favorum", 9), (6, "Bidаvorim Valley", 9), (7, "other", 9), (8, "x" * 50_000 + "а", 9)], "occ_id long, surface_form string, name int")
    names = spark.createDataFrame([(1, "Bidavorim Valley"), (2, "Táfavorum"), (3, None), (4, ""), (5, "Bidavorіm Valley")], "sf_id long, name string")
    got = sorted(tuple(r) for r in k.match_lookalikes(occs, names).collect())
    assert got == [(1, 1), (1, 5), (5, 2), (6, 1), (6, 5)]
    assert k.match_lookalikes(occs.limit(0), names).count() == 0
    assert k.match_lookalikes(occs, names.limit(0)).count() == 0
