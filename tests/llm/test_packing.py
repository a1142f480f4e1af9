import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from kedge.llm import packing as p
from kedge.llm.queries import TOKENIZER

PATTERN = r"\w+|[^\w\s]+|\s+"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=80))
def test_best_fit_is_best_fit(sizes):
    where, fill = p.best_fit(np.array(sorted(sizes, reverse=True), np.int64), 50)
    rooms = []
    for s, b in zip(sorted(sizes, reverse=True), where.tolist(), strict=True):
        fitting = [r for r in rooms if r >= s]
        if b == len(rooms):
            assert not fitting
            rooms.append(50 - s)
        else:
            assert rooms[b] == min(fitting)
            rooms[b] -= s
    assert [50 - r for r in rooms] == fill.tolist()


def test_no_document_is_lost_split_or_overfull(spark):
    texts = ["word " * n for n in (1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 400)] * 6 + ["", None, "", "a b"]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, size int, item string")
    rows = p.pack_documents(df, TOKENIZER, PATTERN, capacity=100).collect()
    count = p.token_counter(TOKENIZER, PATTERN)
    sizes = {i: 0 if t is None else count(t) for i, t in enumerate(texts)}
    by_doc, by_bin = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_bin.setdefault(r["container"], []).append(r)
    assert set(by_doc) == set(sizes)
    for i, rs in by_doc.items():
        assert sum(r["size"] for r in rs) == sizes[i]
        assert len(rs) == max(1, -(-sizes[i] // 100)) and sorted(r["piece"] for r in rs) == list(range(len(rs)))
    for rs in by_bin.values():
        rs = sorted(rs, key=lambda r: r["position"])
        assert [r["position"] for r in rs] == list(range(len(rs))) and sum(max(r["size"], 1) for r in rs) <= 100
        assert [r["start"] for r in rs] == [sum(q["size"] for q in rs[:k]) for k in range(len(rs))]
    assert len(by_bin) <= 1.05 * sum(sizes.values()) / 100 + 1


def test_rounds_merge_the_rest(spark):
    items = spark.createDataFrame([(i, 1 + i % 37) for i in range(3000)], "item long, room long")
    placed = p.pack(items, 100, bins_per_task=50).join(items, "item").groupBy("container").sum("room").collect()
    total = sum(1 + i % 37 for i in range(3000))
    assert max(r[1] for r in placed) <= 100 and len(placed) <= total / 100 * 1.02 + 1


def test_items_of_more_than_half_stay_apart_and_end(spark):
    items = spark.createDataFrame([(i, 60) for i in range(400)], "item long, room long")
    assert p.pack(items, 100, bins_per_task=20).select("container").distinct().count() == 400


def test_empty(spark):
    assert p.pack_documents(spark.createDataFrame([], "doc_id long, text string"), TOKENIZER, PATTERN).count() == 0
