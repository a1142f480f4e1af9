import random

from pyspark.sql import functions as F

from kedge import api
from kedge.operators import evaluation, filters, linking, model, spotting


def loop_fold(spots):
    kept = []
    for c in sorted(spots, key=lambda s: (s["start"], s["length"])):
        if not kept or c["start"] >= kept[-1]["start"] + kept[-1]["length"]:
            kept.append(c)
            continue
        last = kept[-1]
        longer = c["length"] > last["length"]
        if longer and c["p"] > last["p"] / 2:
            kept[-1] = c
        elif not longer and c["p"] <= 2 * last["p"]:
            pass
        elif c["p"] == last["p"]:
            pass
        elif c["p"] > last["p"]:
            kept[-1] = c
    return [(s["start"], s["length"]) for s in kept]


def test_overlap_fold_equals_a_loop(spark):
    rnd = random.Random(5)
    rows = [(d, i, 1, rnd.randrange(40), rnd.randrange(1, 9), f"n{i}", rnd.choice([0.1, 0.2, 0.4, 0.9])) for d in range(25) for i in range(rnd.randrange(1, 14))]
    rows = list({(r[0], r[3], r[4]): r for r in rows}.values())
    names = ["doc_id", "pos", "n_tokens", "start", "length", "name", "p"]
    df = spark.createDataFrame(rows, "doc_id long, pos int, n_tokens int, start int, length int, name string, p double")
    got = {}
    for r in spotting.resolve_overlaps(df).orderBy("doc_id", "start").collect():
        got.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
    want = {d: loop_fold([dict(zip(names, r, strict=True)) for r in rows if r[0] == d]) for d in {r[0] for r in rows}}
    assert got == want


def test_adjacent_match_is_dropped(spark):
    df = spark.createDataFrame([(1, 0, 1, 0, 3, "abc", 1.0), (1, 1, 1, 3, 2, "de", 1.0), (1, 2, 1, 6, 2, "fg", 1.0), (1, 0, 2, 0, 2, "ab", 1.0)], "doc_id long, pos int, n_tokens int, start int, length int, name string, p double")
    assert [r["name"] for r in spotting.leftmost_longest(df).orderBy("start").collect()] == ["abc", "fg"]


def tiny(spark):
    occs = [(i, "Apple", "Apple_Inc", "the Apple computer company sells phones") for i in range(6)] + [(10 + i, "Apple", "Apple_fruit", "an apple pie fruit tree") for i in range(3)] + [(20, "Pie", "Pie", "apple pie"), (21, None, "X", None)]
    o = spark.createDataFrame(occs, "occ_id long, surface_form string, uri string, context string")
    s = spark.createDataFrame([("Apple_Inc", 1, 60, "s:Org"), ("Apple_fruit", 1, 40, None), ("Pie", 1, 5, " "), ("Zero", 1, 0, None)], "uri string, slice_id long, uri_count long, types string")
    n = spark.createDataFrame([(1, "Apple", 9, 12), (2, "Pie", 1, None), (3, "pie", -1, 4)], "sf_id long, name string, annotated_count int, total_count int")
    return model.build(o, s, n)


def test_context_decides(spark):
    docs = spark.createDataFrame([(1, "Apple sells phones and a computer"), (2, "Apple on a tree, fruit for pie"), (3, None), (4, "")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in api.annotate(docs, tiny(spark), confidence=0.1).collect() if r["name"] == "Apple"}
    assert got[1]["uri"] == "Apple_Inc" and got[2]["uri"] == "Apple_fruit" and set(got) == {1, 2}
    assert got[1]["start"] == 0


def test_marked_names_are_linked(spark):
    docs = spark.createDataFrame([(1, "an [[x|Apple]] that sells phones, [[Nobody]]"), (2, "Apple"), (3, None)], "doc_id long, text string")
    got = [(r["doc_id"], r["start"], r["name"], r["uri"]) for r in api.disambiguate(docs, tiny(spark), confidence=0.0).collect()]
    assert got == [(1, 3, "Apple", "Apple_Inc")]


def test_spans_of_spots_are_their_names(spark):
    docs = spark.createDataFrame([(1, "x Apple, Apple.")], "doc_id long, text string")
    text = docs.first()["text"]
    for r in api.spot(docs, tiny(spark), 0.1).collect():
        assert text[r["start"] : r["start"] + r["length"]] == r["name"]


def test_a_large_dictionary_is_joined_instead(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "Apple Pie, Apple; pie"), (2, None), (3, ""), (4, "Apple " * 4000)], "doc_id long, text string").selectExpr("*", "'x' AS name", "1 AS key")
    names = spotting.dictionary(tiny(spark).forms)
    small = sorted(tuple(r) for r in spotting.dictionary_matches(docs, names).collect())
    monkeypatch.setattr(spotting, "BROADCAST_NAMES", 0)
    assert small == sorted(tuple(r) for r in spotting.dictionary_matches(docs, names).collect())
    assert [r[:5] for r in small[:3]] == [(1, 0, 1, 0, 5), (1, 1, 1, 6, 3), (1, 2, 1, 11, 5)] and len(small) == 4003
    assert spotting.dictionary_matches(docs, names.limit(0)).count() == 0


def test_long_names_are_found(spark, monkeypatch):
    long = "The Long and Winding Road to the Very End of It"
    forms = spark.createDataFrame([(long, 9, 9), ("Road", 5, 5), ("--", 5, 5)], "name string, annotated long, total long")
    docs = spark.createDataFrame([(1, f"x {long}, Road"), (2, long[:-3])], "doc_id long, text string")
    names = spotting.dictionary(forms)
    want = [(1, "Road", 5), (1, "Road", 12), (1, long, 1), (2, "Road", 4)]
    found = lambda: sorted((r["doc_id"], r["name"], r["pos"]) for r in spotting.dictionary_matches(docs, names).collect())
    assert found() == want
    monkeypatch.setattr(spotting, "BROADCAST_NAMES", 0)
    assert found() == want


def test_nil_prunes_a_rare_candidate(spark):
    cands = spark.createDataFrame([(1, "N", "rare", 1, 1000, 1, 0.001), (1, "N", "often", 999, 1000, 900, 0.999)], "occ_id long, name string, uri string, n long, annotated long, support long, prior double")
    sizes = spark.createDataFrame([(100, 50, 1000, 1000)], "n_tokens long, vocabulary long, support long, annotated long")
    gain = spark.createDataFrame([], "occ_id long, uri string, gain double")
    got = linking.linked(cands, gain, sizes, ["occ_id"], "occ_id").collect()
    assert [r["uri"] for r in got] == ["often"] and got[0]["second_rank"] == 0.0


def test_coreference(spark):
    rows = [(1, "Marilyn Manson", 75, "Marilyn_Manson"), (1, "Marilyn", 128, "WRONG"), (1, "Marilyn", 10, "EARLY"), (2, "Marilyn", 5, "OTHER")]
    df = spark.createDataFrame(rows, "doc_id long, name string, start int, uri string")
    got = {(r["doc_id"], r["start"]): r["uri"] for r in filters.coreference(df).collect()}
    assert got == {(1, 75): "Marilyn_Manson", (1, 128): "Marilyn_Manson", (1, 10): "EARLY", (2, 5): "OTHER"}


def test_filters(spark):
    df = spark.createDataFrame([("a", 10, 0.9, 0.1, ["T"]), ("b", 5, 0.9, 0.9, []), ("c", 50, 0.2, 0.0, None)], "uri string, support long, final_score double, second_rank double, types array<string>")
    names = lambda f: sorted(r["uri"] for r in df.transform(f).collect())
    assert names(filters.support(5)) == ["a", "c"]
    assert names(filters.types(["T"])) == ["a"] and names(filters.types(["T"], blacklist=True)) == ["b", "c"]
    assert names(filters.types(["unknown"])) == ["b", "c"] and names(filters.types([])) == ["a", "b", "c"]
    assert names(filters.second_rank(0.5)) == ["a", "c"] and names(filters.pipeline(0.5, 0)) == ["a"]
    assert names(filters.confidence(0.5, [0.1, 0.15, 0.5])) == ["a", "b", "c"]


def test_model_edges(spark):
    m = tiny(spark)
    assert {tuple(r) for r in m.forms.collect()} == {("Apple", 9, 12), ("Pie", 1, -1)}
    assert {tuple(r) for r in m.lower.collect()} == {("pie", 4)}
    assert {r["uri"] for r in m.resources.collect()} == {"Apple_Inc", "Apple_fruit", "Pie"}
    ids = model.with_ids(m.forms, "name", "id").orderBy("id").collect()
    assert [(r["id"], r["name"]) for r in ids] == [(1, "Apple"), (2, "Pie")]
    got = {r["name"]: r["corrected"] for r in model.corrected_totals(spark.createDataFrame([("New York", 4, 9), ("York", 3, 6), ("New", 1, -1)], "name string, annotated long, total long")).collect()}
    assert got == {"New York": 9, "York": 1, "New": -1}


def test_scores(spark):
    g = spark.createDataFrame([("a",), ("b",), ("b",)], "k string")
    p = spark.createDataFrame([("b",), ("c",)], "k string")
    r = evaluation.set_scores(g, p, ["k"]).first()
    assert (r["tp"], r["fp"], r["fn"], r["precision"], r["recall"], r["f1"]) == (1, 1, 1, 0.5, 0.5, 0.5)
    none = evaluation.set_scores(g.limit(0), p.limit(0), ["k"]).collect()
    assert len(none) == 1 and none[0]["precision"] == 0.0


def test_similarity_takes_all_words_and_names_the_resource(spark):
    import math

    rare = [f"w{chr(97 + i // 6)}{chr(97 + i % 6)}" for i in range(30)]
    held = [("A", w, 1) for w in rare] + [("B", "plain", 4), ("B", "other", 1), ("C", "plain", 1), ("D", "other", 2), ("D", "plain", 1), ("E", "far", 1)]
    texts = {1: " ".join([*rare, "plain", "plain", "other"]), 2: "other", 3: "", 4: None}
    ctx = spark.createDataFrame(held, "uri string, token string, n long")
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    df = {w: sum(x == w for _, x, _ in held) for _, w, _ in held}
    weight = {(u, w): math.sqrt(n) * math.log(5 / df[w]) for u, w, n in held}
    want = []
    for d, t in texts.items():
        words = (t or "").split()
        q = {w: math.sqrt(words.count(w)) * math.log(5 / df[w]) for w in set(words)}
        dots = {u: sum(q.get(w, 0) * x for (v, w), x in weight.items() if v == u) for u in "ABCDE"}
        norm = {u: math.sqrt(sum(x * x for (v, _), x in weight.items() if v == u)) for u in "ABCDE"}
        best = sorted((-dots[u] / norm[u], u) for u in "ABCDE" if dots[u] > 0)[:3]
        want += [(d, u, round(-s, 6), i) for i, (s, u) in enumerate(best, 1)]
    got = linking.tfidf_similarity(docs, ctx, "doc_id", 3).collect()
    assert sorted((r["doc_id"], r["uri"], round(r["score"], 6), r["rank"]) for r in got) == sorted(want) and len(want) == 5
    assert [r["uri"] for r in linking.tfidf_similarity(docs.limit(1), ctx, "doc_id", 3, 25).collect()] == ["A"]


def test_runs_of_texts_are_passed_on_in_parts(monkeypatch):
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(spotting, "PART_CHARS", 40)
    monkeypatch.setattr(spotting, "MOST_RUNS", 7)
    texts = ["New York is not new york, but New York City", "", "a b c " * 20, "New"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(4), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    every = [b for b in spotting._grams(None, "doc_id", 3)([batch])]
    assert max(b.num_rows for b in every) <= 7
    words = [t.replace(",", "").split() for t in texts]
    want = sorted((k, i, " ".join(w[i : i + n])) for k, w in enumerate(words) for n in (1, 2, 3) for i in range(len(w) - n + 1))
    rows = [r for b in every for r in b.to_pylist()]
    assert sorted((r["doc_id"], r["pos"], r["key"]) for r in rows) == want
    assert all(texts[r["doc_id"]][r["start"] : r["start"] + r["length"]].replace(",", "") == r["key"] for r in rows)
    names = pa.RecordBatch.from_arrays([pa.array(["New York", "New York City", "c a b"])], names=["key"])
    got = pa.Table.from_batches(spotting._beginnings([names])).group_by("h").aggregate([("whole", "max")]).sort_by("h")
    hashes = got["h"].to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    known = hashes[order], got["whole_max"].to_numpy()[order]
    hits = sorted((r["doc_id"], r["pos"], r["key"]) for b in spotting._grams(known, "doc_id")([batch]) for r in b.to_pylist())
    assert hits == [x for x in want if x[2] in ("New York", "New York City", "c a b")] and len(hits) == 22


def test_similarity_over_blocks_and_without_pairs(spark, monkeypatch):
    import random

    from kedge.operators import postings

    rnd = random.Random(3)
    index = [(t, r, rnd.choice([0.25, 0.5, 1.0, 2.0])) for t in range(1, 30) for r in range(40) if rnd.random() < 0.4]
    queries = {q: {t: rnd.choice([0.5, 1.0, 3.0]) for t in rnd.sample(range(1, 35), rnd.randint(0, 8))} for q in range(50)}
    weight = {(t, r): w for t, r, w in index}
    want = []
    for q, terms in queries.items():
        sums = {r: sum(w * weight.get((t, r), 0) for t, w in terms.items()) for r in range(40)}
        want += [(q, r, s) for s, r in sorted((-s, r) for r, s in sums.items() if s)[:3]]
    want = sorted((q, r, -s) for q, r, s in want)
    df = spark.createDataFrame([(q, list(t), list(t.values())) for q, t in queries.items()], "q long, terms array<int>, weights array<double>")
    held = spark.createDataFrame(index, "term int, resource long, weight double")
    for block in (len(index), 30):
        monkeypatch.setattr(postings, "BLOCK_POSTINGS", block)
        got = {}
        for r in postings.most_alike(df, held, "q", 3).collect():
            got.setdefault(r["q"], []).append((-r["score"], r["resource"]))
        assert sorted((q, r, -s) for q, rows in got.items() for s, r in sorted(rows)[:3]) == want
    assert postings.most_alike(df, held.limit(0), "q", 3).count() == 0 == postings.most_alike(df.limit(0), held, "q", 3).count()
    many = spark.range(2000).selectExpr("id AS doc_id", "'same word' AS text")
    contexts = spark.range(400).selectExpr("concat('r', id) AS uri", "CASE WHEN id % 2 = 0 THEN 'same' ELSE 'word' END AS token", "1L AS n")
    found = linking.tfidf_similarity(many, contexts, "doc_id", 3)
    assert "SortMergeJoin [token" not in found._jdf.queryExecution().executedPlan().toString() and found.count() == 6000
