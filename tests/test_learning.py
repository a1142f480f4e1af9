import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kedge import api
from kedge.functions import text as T
from kedge.operators import evaluation, linking, model, spotclass, spotting, topics
from kedge.sources import readers, sinks


def alike(a, b):
    a, b = a.lower(), b.lower()
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return 1 - row[-1] / max(len(a), len(b))


def test_fuzzy_recall_against_all_pairs(spark, sf):
    occs = spark.read.parquet(f"{sf}/occs.parquet").filter("surface_form IS NOT NULL")
    names = [r[0] for r in occs.select("surface_form").distinct().collect()]
    known = [r[0] for r in spark.read.parquet(f"{sf}/surface_forms.parquet").filter("name IS NOT NULL").select("name").distinct().collect()]
    names += [k[1:] + "x" for k in known[:40]] + ["", "q"]
    want = {(a, b) for a in set(names) for b in known if a and alike(a, b) >= 0.5}
    got = {(r["name"], r["form"]) for r in linking.fuzzy_names(spark.createDataFrame([(n,) for n in set(names)], "name string"), spark.createDataFrame([(k,) for k in known], "name string")).collect()}
    assert got <= want and len(got) >= 0.9 * len(want)


def test_windows_of_long_texts(spark):
    long = "One two three. " * 500
    df = spark.createDataFrame([(1, long), (2, "Short. Text."), (3, None), (4, ""), (5, long.strip())], "doc_id long, text string")
    rows = T.context_windows(df, "doc_id", "text").orderBy("doc_id", "window").collect()
    mine = [r for r in rows if r["doc_id"] == 1]
    assert "".join(r["text"] for r in mine) == long and all(long[r["start"] :].startswith(r["text"]) for r in mine)
    assert all(len(r["text"].split()) == 201 for r in mine[:-1]) and [r["window"] for r in mine] == list(range(len(mine)))
    assert [r["text"] for r in rows if r["doc_id"] in (2, 4)] == ["Short. Text.", ""] and not [r for r in rows if r["doc_id"] == 3]


def test_links_are_scored_in_their_window(spark):
    far, near = "apple pie. " * 300, "engine wheel. " * 300
    occs = spark.createDataFrame([(1, "fruit", "Apple", "apple pie"), (2, "car", "Apple", "engine wheel")], "occ_id long, uri string, surface_form string, context string")
    built = model.build(occs, spark.createDataFrame([("fruit", 1, 5, None), ("car", 1, 5, None)], "uri string, slice_id long, uri_count long, types string"), spark.createDataFrame([], "sf_id long, name string, annotated_count int, total_count int"))
    docs = spark.createDataFrame([(1, far + near)], "doc_id long, text string")
    spots = spark.createDataFrame([(1, 3, "Apple"), (1, len(far) + 1400, "Apple")], "doc_id long, start int, name string")
    got = {r["start"]: r["uri"] for r in api.best_k(docs, spots, built).filter("rank = 1").collect()}
    assert got == {3: "fruit", len(far) + 1400: "car"}


def test_model_is_saved_and_loaded(spark, tmp_path):
    occs = spark.createDataFrame([(1, "u", "A", "a b a"), (2, None, None, None)], "occ_id long, uri string, surface_form string, context string")
    built = model.build(occs, spark.createDataFrame([("u", 1, 5, "x")], "uri string, slice_id long, uri_count long, types string"), spark.createDataFrame([(1, "A", 2, 3)], "sf_id long, name string, annotated_count int, total_count int"))
    model.save(built, str(tmp_path / "m"))
    again = model.load(spark, str(tmp_path / "m"))
    for part in ("forms", "resources", "pairs", "candidates", "contexts", "tokens", "lower"):
        assert sorted(map(str, getattr(again, part).collect())) == sorted(map(str, getattr(built, part).collect()))


def test_policies(spark):
    with pytest.raises(ValueError, match="fff"):
        api.policy(api.SPOTTERS, "fff")
    with pytest.raises(ValueError):
        api.policy(api.DISAMBIGUATORS, "")


def test_linked_without_context_and_share(spark):
    c = spark.createDataFrame([(1, "A", "u", 3, 4, 8, 0.75), (1, "A", "v", 1, 4, 2, 0.25)], "occ_id long, name string, uri string, n long, annotated long, support long, prior double")
    sizes = spark.createDataFrame([(10, 5, 10, 4)], "n_tokens long, vocabulary long, support long, annotated long")
    rows = {r["uri"]: r for r in linking.linked(c, None, sizes, ["occ_id"], "occ_id").collect()}
    assert math.isclose(rows["u"]["final_score"] + rows["v"]["final_score"], 1) and rows["u"]["rank"] == 1
    gain = spark.createDataFrame([(1, "u", 2.0)], "occ_id long, uri string, gain double")
    one = {r["uri"]: r["context_share"] for r in linking.linked(c, gain, sizes, ["occ_id"], "occ_id").collect()}
    assert set(one) == {"u"} and math.isclose(one["u"], math.e**2 / (math.e**2 + 1))  # v is no better than no resource


def test_overlaps(spark):
    rows = [(1, "p", 0, 10), (2, "p", 2, 3), (3, "p", 8, 5), (4, "p", 20, 2), (5, "q", 3, 3)]
    got = {r["k"]: (r["meets"], r["inside"]) for r in linking.overlaps(spark.createDataFrame(rows, "k long, g string, start int, length int"), "g", "k").collect()}
    assert got == {1: (False, False), 2: (True, True), 3: (True, False), 4: (False, False), 5: (False, False)}


def test_texts_with_all_terms(spark):
    docs = spark.createDataFrame([(1, ["a", "b"]), (2, ["a"]), (3, ["b", "a", "c"])], "__d long, __w array<string>")
    asked = spark.createDataFrame([("ab", ["a", "b"], 2), ("z", ["z"], 1), ("none", [], 0), ("a", ["a"], 1)], "name string, w array<string>, k int")
    got = {(r["name"], r["__d"]) for r in linking.with_all_terms(asked, docs).collect()}
    assert got == {("ab", 1), ("ab", 3), ("a", 1), ("a", 2), ("a", 3)}


def test_random_scores_repeat(spark):
    c = spark.createDataFrame([("n", f"u{i}") for i in range(400)], "name string, uri string")
    a = {r["uri"]: r["score"] for r in linking.random_scores(c).collect()}
    assert a == {r["uri"]: r["score"] for r in linking.random_scores(c.repartition(7)).collect()}
    assert abs(np.mean(list(a.values())) - 100) < 1 and 4 < np.std(list(a.values())) < 6


def test_first_of_each_and_balanced(spark):
    rows = [(i, "hot" if i % 3 else "cold", i * 7 % 11) for i in range(300)] + [(999, None, 0)]
    df = spark.createDataFrame(rows, "id long, topic string, v int")
    got = topics.first_of_each(df, "topic", [F.desc("v"), F.col("id")], 4, spread="id").collect()
    for t in ("hot", "cold"):
        want = sorted((r for r in rows if r[1] == t), key=lambda r: (-r[2], r[0]))[:4]
        assert sorted(r["id"] for r in got if r["topic"] == t) == sorted(r[0] for r in want)
    sizes = {r["topic"]: r["count"] for r in topics.balanced(df.filter("topic IS NOT NULL"), "topic", "id").groupBy("topic").count().collect()}
    assert sizes == {"hot": 100, "cold": 100}


def test_topics(spark):
    docs = [(i, ("alpha beta gamma " if i % 2 else "delta epsilon zeta ") * 3 + f"word{chr(97 + i)}", "x" if i % 2 else "y") for i in range(10)]
    rows = topics.weighted(topics.features(spark.createDataFrame(docs, "k long, text string, topic string"), "k", "text", ("topic",)), "k", ("topic",))
    evidence = topics.train(rows)
    best = {r["k"]: r["topic"] for r in topics.predict(rows.drop("topic"), topics.log_weights(evidence), "k").filter("p > 0.5").collect()}
    assert best == {k: t for k, _, t in docs}
    each = topics.predict_each(rows.drop("topic"), evidence, "k").collect()
    assert all((r["p"] > 0.5) == (r["topic"] == dict((k, t) for k, _, t in docs)[r["k"]]) for r in each) and len(each) == 20
    some = F.col("k") < 4
    grown = topics.self_trained(rows.filter(some), rows.filter(~some).drop("topic"), "k", 0.5)
    assert {r["topic"] for r in grown.collect()} == {"x", "y"} and grown.count() > topics.train(rows.filter(some)).count()
    assert topics.predict(rows.drop("topic"), topics.log_weights(evidence.limit(0)), "k").count() == 0


def test_spot_features_and_selection(spark):
    rows = [(1, "He saw the Bank of Ruda, and Pim were there.", 11, "Bank"), (2, "april came", 0, "april"), (3, "Monday", 0, "Monday"), (4, 'He said "Gofer" again', 9, "Gofer"), (5, "its River in May", 4, "River"), (6, "A, Beta, and C", 3, "Beta")]
    df = spark.createDataFrame(rows, "k long, text string, start int, name string")
    f = {r["k"]: r for r in spotclass.lexical_features(spotclass.neighbours(df, "text", "start", "name")).collect()}
    assert f[1]["case_class"] == 1 and f[1]["before_of"] == 1 and f[1]["pre_pos"] == 4 and f[1]["next_pos"] == 1
    assert f[2]["case_class"] == 0 and f[2]["left_token"] is None and f[3]["case_class"] == 3 and f[3]["right_token"] is None
    assert f[4]["quoted"] == 1 and f[5]["after_possessive"] == 1 and f[5]["pre_pos"] == 0 and f[6]["in_enumeration"] == 1 and f[1]["in_enumeration"] == 0
    ready = spotclass.lexical_features(spotclass.neighbours(df, "text", "start", "name"))
    kept = {r["k"] for r in spotclass.selected(ready, F.lit(0.9), F.lit(0.9)).collect()}
    assert kept == {1, 2, 4, 5, 6}
    tagged = spark.createDataFrame([("Canadian", "jj"), ("canadian", "jj"), ("dog", "nn"), ("run", "vb"), ("x", None)], "name string, tag string")
    assert {r["name"] for r in spotclass.selected(tagged, F.lit(0.9), F.lit(0.9), tag="tag").collect()} == {"Canadian", "dog", "x"}


def test_spot_classifier_and_tuning(spark):
    rnd = random.Random(1)
    rows = [(rnd.randint(0, 3), rnd.randint(0, 1)) for _ in range(400)]
    df = spark.createDataFrame([(a, b, int(a + b >= 3)) for a, b in rows], "case_class int, quoted int, valid int")
    weights, bias = spotclass.fit(df, "valid", ("case_class", "quoted"))
    got = spotclass.classified(df, spotclass.linear(weights, bias)).collect()
    assert np.mean([(r["spot_class"] == "valid") == (r["valid"] == 1) for r in got]) > 0.95
    spots = [("Ab", 0.9), ("ABC", 0.2), ("12", 0.4), ("name", 0.1), ("XY", 0.7)]
    x = np.array([[p, float(n.isupper() and len(n) < 5), float(n.isdigit()), 1.0] for n, p in spots])
    y = x @ np.array([0.5, 0.2, -0.3, 0.1])
    df = spark.createDataFrame([(n, p, float(v)) for (n, p), v in zip(spots, y, strict=True)], "name string, p double, gold double")
    assert np.allclose(spotclass.tuned_weights(df, "gold"), [0.5, 0.2, -0.3, 0.1])


def test_fallback_probability(spark):
    forms = spark.createDataFrame([("Berlin", 8, 10), ("BERLIN", 1, 10)], "name string, annotated long, total long")
    lower = spark.createDataFrame([], "lower string, lower_count long")
    got = {r["name"]: r["p"] for r in spotting.known_probability(spark.createDataFrame([("Berlin",), ("berlin",), ("Rome",), (None,)], "name string"), forms, lower).collect()}
    assert got["Berlin"] == 0.8 and math.isclose(got["berlin"], 0.85 * 0.8) and got["Rome"] == 0.0 and got[None] == 0.0


def test_readers(spark):
    pages = spark.createDataFrame([(1, "UNO", "Intro [[X]]\n* [[United_Nations_Organisation|United Nations Organisation]] and [[Y]]\n* [[Uno_(game)]]\n* [[Other]]"), (2, None, "* [[A]]"), (3, "A", None)], "id long, title string, text string")
    got = {(r["line"], r["uri"]) for r in readers.disambiguation_items(pages, "id", "title", "text").collect()}
    assert got == {(1, "United_Nations_Organisation"), (2, "Uno_(game)")}
    html = spark.createDataFrame([(1, 'A long enough text about <a href="http://x">Foo</a> and some other things here.'), (2, 'Foo <a href="y">Foo</a> twice, and some more words to make the text long enough.'), (3, '<a href="z">Z</a> short')], "id long, html string")
    assert [(r["id"], r["name"]) for r in readers.web_occurrences(html, "id", "html").collect()] == [(1, "Foo")]
    lines = spark.createDataFrame([("  12 Some_uri\tSome form",), ("bad line",)], "value string")
    assert [tuple(r) for r in readers.candidate_map(lines).collect()] == [("Some form", "Some_uri", 12)]
    assert readers.spot_dataset(spark.createDataFrame([("a\t3\ttext\turi\t\t\tt",), ("short",)], "value string")).collect()[0]["valid"] is True
    q = spark.createDataFrame([('<kbpentlink><query id="1"><name>N</name><docid>d</docid></query></kbpentlink>',)], "value string")
    got = readers.linking_queries(q, spark.createDataFrame([("1\tNIL7\tX",)], "value string"), spark.createDataFrame([("d",)], "doc string")).collect()
    assert [tuple(r) for r in got] == [("1", "N", "d", None)]


def test_index_documents(spark):
    occs = spark.createDataFrame([(1, "u", "A", "c1"), (2, "u", "A", "c2"), (3, "u", None, None), (4, None, "B", "c")], "occ_id long, uri string, surface_form string, context string")
    got = sorted((r["field"], r["position"] or 0, r["value"], r["n"]) for r in sinks.inverted_index(occs).collect())
    assert got == [("context", 1, "c1", 1), ("context", 2, "c2", 1), ("surface_form", 0, "A", 2)]
    assert [tuple(r) for r in sinks.compressed_index(occs, 2).collect()] == [("u", 3, 2)]
    x = spark.range(1).select(sinks.error_xml(F.lit('a<b "c"'), F.lit(400)).alias("x")).collect()[0]["x"]
    assert x == '<error status="400">a&lt;b &quot;c&quot;</error>'


def test_evaluation(spark):
    gold = spark.createDataFrame([(1, "A", "u"), (2, "A", "v"), (3, "B", "w")], "k long, name string, gold string")
    links = spark.createDataFrame([(1, "u")], "k long, uri string")
    known = spark.createDataFrame([("A", "u"), ("A", "v")], "name string, uri string")
    assert tuple(evaluation.with_nil_credit(gold, links, known, "k").collect()[0]) == (3, 1, 1)
    tags = evaluation.best_tags(spark.createDataFrame([("p", "a", 0.9), ("p", "b", 0.5), ("p", "c", 0.1)], "page string, uri string, final_score double"), spark.createDataFrame([("p", 30)], "page string, words long"), "page")
    assert {r["uri"] for r in tags.collect()} == {"a", "b"}


def test_redirects_merge_counts(spark):
    closure = spark.createDataFrame([("Old", "New", 1, "tree"), ("New", "New", 0, "tree"), ("X", "X", 0, "cycle")], "node string, root string, depth long, kind string")
    occs = spark.createDataFrame([(1, "Old"), (2, "New"), (3, "X"), (4, None), (5, "Other")], "occ_id long, uri string")
    assert {r["occ_id"]: r["uri"] for r in model.resolved(occs, closure).collect()} == {1: "New", 2: "New", 3: "X", 4: None, 5: "Other"}


def test_templates_of_any_depth(spark):
    text = "a {{x|{{y|{{z|{{q}}}}}}}} b {{c}} d }} e"
    assert spark.createDataFrame([(text,)], "t string").select(T.without_templates(F.col("t")).alias("t")).collect()[0]["t"] == "a  b  d }} e"
