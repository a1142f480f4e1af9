import numpy as np

from kedge.llm import quality as q
from kedge.llm.boosting import Boosted, platt
from kedge.session import table

TABLE = "\n".join(f"| {chr(97 + i) * 3}ome | {i * 37} | {chr(110 + i % 9)}ada |" for i in range(26))


def test_statistics():
    s = dict(zip(q.NAMES, q.statistics("The cat sat on the mat.\n\nIt was a good cat, and it slept."), strict=True))
    assert s["n_words"] == 14 and s["punct_line_ratio"] == 1 and s["prose_share"] == 1 and s["n_lines"] == 2
    assert q.statistics(None) == q.statistics("  \n ") == [0.0] * len(q.NAMES)
    t = dict(zip(q.NAMES, q.statistics("| a | b |\n| 1 | 2 |\nx\ty\n"), strict=True))
    assert t["cell_share"] == 1
    assert len(q.statistics("word " * 200_000)) == len(q.NAMES)


def test_boosting_learns_and_calibrates():
    rnd = np.random.RandomState(0)
    x = rnd.rand(1500, 4)
    y = (x[:, 0] > 0.5).astype(int) + (x[:, 1] > 0.7).astype(int)
    model = Boosted(3).fit(x[:1000], y[:1000])
    p = model.predict(x[1000:])
    assert (p.argmax(1) == y[1000:]).mean() > 0.95 and np.allclose(p.sum(1), 1)
    assert np.array_equal(Boosted(3).fit(x[:1000], y[:1000]).predict(x[1000:]), p)
    a, b = platt(np.array([0.9, 0.8, 0.2, 0.1] * 20), np.array([1, 1, 0, 0] * 19 + [0, 1, 0, 1]))
    assert a > 0 and abs(b) < 1
    assert platt(np.array([0.5]), np.array([1.0])) == (1.0, 0.0) and platt(np.empty(0), np.empty(0)) == (1.0, 0.0)


def test_held_out_accuracy(spark, sf):
    """Hand labels hold a few errors, so the bound leaves room for them."""
    d = sf.replace("sf0.001", "sf0.01")
    labels = table(spark, d, "doc_labels").filter("quality IS NOT NULL")
    got = q.classify(table(spark, d, "documents"), labels.filter("doc_id % 2 = 0")).join(labels, "doc_id").filter("doc_id % 2 = 1").select("kind", "quality").collect()
    assert np.mean([(r["kind"] == "prose") == (r["quality"] == 1) for r in got]) > 0.85


def test_rows(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "x" * 300_000), (-4, TABLE), (-4, TABLE)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, annotator string")
    rows = q.classify(docs.unionByName(odd), labels).select("doc_id", "kind").collect()
    assert len(rows) == docs.count() + 5
    kinds = {r["doc_id"]: r["kind"] for r in rows}
    assert kinds[-1] == kinds[-2] == "junk" and kinds[-4] == "table"
    assert q.classify(docs.limit(0), labels).count() == 0
