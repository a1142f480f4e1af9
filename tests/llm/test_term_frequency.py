from collections import Counter, defaultdict


from kedge.llm import term_frequency as t

SCHEMA = "id string, uri string, surface_form string, term string"


def brute(rows):
    n, recs = Counter(), defaultdict(set)
    for rid, uri, sf, _ in rows:
        for field, terms in (("uri", [uri]), ("surface_form", [sf]), ("word", [w for w in sf.split(" ") if w] if sf is not None else [])):
            for w in terms:
                if w is not None:
                    n[field, w] += 1
                    if rid is not None:
                        recs[field, w].add(rid)
    return {(f, w, k, len(recs[f, w])) for (f, w), k in n.items()}


def test_counts_equal_brute_force(spark):
    rows = [(f"i{i % 90}", "hot" if i % 3 else f"u{i}", ["a b", "a  a", "", "b " * 50, "é"][i % 5], "clash") for i in range(300)]
    rows += [(None, "hot", "a", "x"), ("i1", None, None, "x"), ("i1", "hot", "a b", "x")]
    got = {tuple(r) for r in t.occurrence_terms(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(rows)


def test_marks(spark):
    rows = [(f"i{i}", "often", f"only{i}", None) for i in range(150)] + [("i0", "twice", None, None), ("i1", "twice", None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {tuple(r) for r in t.marked(t.occurrence_terms(df), df, "id").collect()}
    assert ("uri", "often", "common") in got and ("word", "only7", "rare") in got
    assert not any(term == "often" and mark == "rare" for _, term, mark in got)
    assert ("uri", "twice", "common") in got  # 2 of 150 records are more than 1%


def test_dictionary_is_dense(spark):
    cells = spark.createDataFrame([(f"f{i % 2}", f"t{i}") for i in range(500)] * 2, "field string, term string").repartition(7)
    got = sorted(r["tid"] for r in t.dictionary(cells).collect())
    assert got == list(range(500))


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert t.occurrence_terms(df).count() == 0
    assert t.marked(t.occurrence_terms(df), df, "id").count() == 0


def test_long_text(spark):
    df = spark.createDataFrame([("i", None, "w " * 100_000, None)], SCHEMA)
    got = {(r["field"], r["n"]) for r in t.occurrence_terms(df).collect()}
    assert got == {("word", 100_000), ("surface_form", 1)}
