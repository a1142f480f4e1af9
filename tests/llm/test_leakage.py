import random

import numpy as np

from kedge.llm import leakage as k


def common_run(a, b):
    best, last = 0, [0] * (len(b) + 1)
    for x in a:
        row = [0] * (len(b) + 1)
        for j, y in enumerate(b):
            row[j + 1] = last[j] + 1 if x == y else 0
            best = max(best, row[j + 1])
        last = row
    return best


def test_against_brute_force(spark):
    rnd = random.Random(2)
    words = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randrange(5, 60)))) for i in range(12)]
    docs = []
    for d in range(60):
        parts = [rnd.choice(words) for _ in range(40)]
        if d % 2:
            own = rnd.choice(items)[1].split()
            a = rnd.randrange(len(own))
            parts += own[a : a + rnd.randrange(8, 20)]
        docs.append((d, " ".join(parts + parts[:3])))
    got = {(r["doc_id"], r["item_id"]): r["longest"] for r in k.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), min_words=8).collect()}
    want = {(d, i): n for d, t in docs for i, x in items if (n := common_run(k.words_of(t), k.words_of(x))) >= 8}
    assert got == want and got


def test_reordered_passages_are_covered(spark):
    a, b = [" ".join(f"{c}{i}" for i in range(20)) for c in "xy"]
    docs = spark.createDataFrame([(1, f"{b.upper()}, then — {a}!"), (2, a), (3, None), (4, ""), (5, "short")], "doc_id long, text string")
    items = spark.createDataFrame([(9, f"{a} {b}", "t"), (10, None, "t"), (11, "short", "t")], "item_id long, text string, coverage string")
    got = {r["doc_id"]: (r["n_tiles"], r["tiled_words"], r["coverage"]) for r in k.leaks(docs, items).collect()}
    assert got == {1: (2, 40, 1.0), 2: (1, 20, 0.5)}


def test_many_blocks_give_the_same(spark):
    items = spark.createDataFrame([(i, " ".join(f"{i}q{j}" for j in range(15))) for i in range(20)], "item_id long, text string")
    docs = items.selectExpr("item_id AS doc_id", "text")
    one = sorted(tuple(r) for r in k.leaks(docs, items).collect())
    assert one == sorted(tuple(r) for r in k.leaks(docs, items, block_chars=300).collect()) and len(one) == 20


def test_repetition_ties_and_empty_tables(spark):
    items = spark.createDataFrame([(1, "a " * 40), (2, "a " * 40)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a " * 3000), (1, "a " * 11)], "doc_id long, text string")
    got = k.leaks(docs, items).collect()
    assert sorted((r["doc_id"], r["item_id"], r["coverage"]) for r in got) == [(1, 1, 1.0), (1, 2, 1.0)]
    assert k.leaks(docs, items.limit(0)).count() == 0 and k.leaks(docs.limit(0), items).count() == 0


def test_an_unequal_word_splits_a_run_of_seeds():
    """As if the hashes of one window had met by chance: the equal stretches around it stay."""
    doc = np.arange(1, 31, dtype=np.uint64)
    item = doc.copy()
    item[14] = 99
    at = np.arange(28)
    assert sorted(k.tiles(doc, item, at, at, 3)) == [(0, 0, 14), (15, 15, 15)]
