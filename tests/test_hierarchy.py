import random

import pytest
from pyspark.sql import functions as F

from kedge.operators import hierarchy


def brute(nodes, parent):
    out = {}
    for v in nodes:
        path, seen = [v], {v: 0}
        while parent.get(path[-1]) is not None and parent[path[-1]] not in seen:
            seen[parent[path[-1]]] = len(path)
            path.append(parent[path[-1]])
        back = parent.get(path[-1])
        if back is None:
            out[v] = (path[-1], len(path) - 1, "tree", path)
        else:
            at = seen[back]
            out[v] = (min(path[at:]), at, "tail" if at else "cycle", path)
    return out


def check(spark, edges):
    nodes = sorted({x for e in edges for x in e if x is not None})
    parent = {a: b for a, b in edges if a is not None and b is not None}
    n = spark.createDataFrame([(x,) for x in nodes], "node string")
    e = spark.createDataFrame(edges, "node string, parent string").dropDuplicates(["node"])
    got = {r["node"]: (r["root"], r["depth"], r["kind"], r["path"]) for r in hierarchy.resolve(n, e, paths=True).collect()}
    assert got == brute(nodes, parent)
    return got


def test_trees_circles_and_tails(spark):
    edges = [("a", "b"), ("b", "c"), ("d", "b"), ("x", "y"), ("y", "z"), ("z", "x"), ("t", "y"), ("u", "t"), ("s", "s"), ("q", "s")]
    got = check(spark, edges)
    assert got["x"][:3] == ("x", 0, "cycle") and got["u"][:3] == ("x", 2, "tail") and got["a"][:3] == ("c", 2, "tree")


def test_long_chain_and_random_graph(spark):
    check(spark, [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(60)])
    rnd = random.Random(3)
    check(spark, [(f"v{i}", f"v{rnd.randrange(80)}") for i in range(80) if rnd.random() < 0.85])


def test_popular_parent(spark):
    edges = [(f"c{i}", "hub") for i in range(300)] + [("hub", "top")]
    got = check(spark, edges)
    assert got["c7"][:3] == ("top", 2, "tree")


def test_empty_and_nulls(spark):
    none = spark.createDataFrame([], "node string, parent string")
    assert hierarchy.resolve(none.select("node"), none).count() == 0
    nodes = spark.createDataFrame([("a",), (None,), ("a",)], "node string")
    assert [tuple(r) for r in hierarchy.resolve(nodes, none).collect()] == [("a", "a", 0, "tree")]


def test_redirect_edges_take_the_last_line_and_ignore_extra_columns(spark):
    ns = hierarchy.RESOURCE
    rows = [(1, f"<{ns}A%20b>", "B"), (2, "A b", f"{ns}C"), (3, None, "B"), (4, "D", None), (5, "E+1", "100%")]
    df = spark.createDataFrame(rows, "line_no long, subj string, obj string").withColumn("node", F.lit("clash"))
    nodes, edges = hierarchy.redirect_edges(df)
    assert {tuple(r) for r in edges.collect()} == {("A b", "C"), ("E+1", "100%")}
    assert {r[0] for r in nodes.collect()} == {"A b", "B", "C", "E+1", "100%"}


def test_descendants(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c")], "node string, parent string")
    n = spark.createDataFrame([("a",), ("b",), ("c",)], "node string")
    got = {tuple(r) for r in hierarchy.descendants(hierarchy.resolve(n, e, paths=True)).collect()}
    assert got == {("b", "a", 1), ("c", "a", 2), ("c", "b", 1)}


def test_descendants_take_a_circle_once(spark):
    edges = [("u", "t"), ("t", "y"), ("x", "y"), ("y", "z"), ("z", "x"), ("s", "s")]
    n = spark.createDataFrame([(v,) for v in "utxyzs"], "node string")
    got = hierarchy.descendants(hierarchy.resolve(n, spark.createDataFrame(edges, "node string, parent string"), paths=True))
    assert {tuple(r) for r in got.collect()} == {("t", "u", 1), ("x", "u", 2), ("x", "t", 1)}


if __name__ == "__main__":
    pytest.main([__file__])
