"""Parent links of unknown depth to roots, depths, paths and descendants, by tree contraction.

A round rakes all leaves and splices out an independent set of the nodes that then have one child (unary
chains shrink by a constant share), so the number of rounds is logarithmic in the nodes, however deep
the trees are. A node that comes to point at itself is what is left of a circle: the core that no
contraction ends. The rounds are then undone in reverse order, each by one join. No round gathers
the children of a node: they are counted, and the joins on a popular parent are salted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kedge.operators.skew import heavy_keys, salted_join
from kedge.session import cut, cut_counted, drop

#: Namespace of the titles in the redirects table.
RESOURCE = "http://kb.example/resource/"


def title_of(iri: Column, namespace: str = RESOURCE) -> Column:
    """An IRI as title: no angle brackets, no namespace, percent-escapes decoded as UTF-8 ('+' stays, a '%' without two hex digits stays)."""
    bare = F.regexp_replace(iri, "^<|>$", "")
    bare = F.when(F.startswith(bare, F.lit(namespace)), F.substring(bare, len(namespace) + 1, 2**30)).otherwise(bare)
    guarded = F.regexp_replace(F.replace(bare, F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25")
    return F.when(F.contains(bare, F.lit("%")), F.url_decode(guarded)).otherwise(bare)


def redirect_edges(redirects: DataFrame, namespace: str = RESOURCE) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a redirects table: rows with a null end are ignored, the highest line_no of a subject holds."""
    rows = redirects.filter(F.col("subj").isNotNull() & F.col("obj").isNotNull()).select(
        title_of(F.col("subj"), namespace).alias("node"), title_of(F.col("obj"), namespace).alias("parent"), "line_no"
    )
    nodes = rows.select(F.explode(F.array("node", "parent")).alias("node")).distinct()
    return nodes, rows.groupBy("node").agg(F.max_by("parent", "line_no").alias("parent"))


def _round(live: DataFrame, turn: int) -> DataFrame:
    """One contraction: every live node with what becomes of it (act: rake, splice or keep).

    Leaves are raked. A node with one child that isn't a leaf is spliced out, if its hash is greater than
    those of its child and its parent: then neither of them is, and each node decides from its own row.
    A kept node whose parent was spliced out now hangs below that one's parent.
    """
    rank = lambda c: F.xxhash64(F.col(c), F.lit(turn))
    kids = live.groupBy(F.col("parent").alias("__p")).agg(F.count(F.lit(1)).alias("__kids"))
    seen = live.join(kids, F.col("node") == F.col("__p"), "left").drop("__p")
    inner = seen.filter(F.col("__kids").isNotNull()).groupBy(F.col("parent").alias("__p")).agg(F.count(F.lit(1)).alias("__inner"), F.min("node").alias("child"))
    seen = seen.join(inner, F.col("node") == F.col("__p"), "left").drop("__p")
    out = F.coalesce((F.col("__inner") == 1) & (rank("node") > rank("child")) & (F.col("top") | (rank("node") > rank("parent"))), F.lit(False))
    above = seen.filter(out).select(F.col("child").alias("__c"), F.col("node").alias("v"), F.col("parent").alias("p"), F.col("steps").alias("s"), F.col("least").alias("l"), F.col("via").alias("h"), F.col("top").alias("t"))
    moved = F.col("__c").isNotNull()
    return seen.withColumn("__out", out).join(above, F.col("node") == F.col("__c"), "left").select(
        "node",
        F.when(moved, F.col("p")).otherwise(F.col("parent")).alias("parent"),
        F.when(moved, F.col("steps") + F.col("s")).otherwise(F.col("steps")).alias("steps"),
        F.when(moved, F.least("least", "v", "l")).otherwise(F.col("least")).alias("least"),
        F.when(moved, F.concat("via", F.array("v"), "h")).otherwise(F.col("via")).alias("via"),
        F.when(moved, F.col("t")).otherwise(F.col("top")).alias("top"),
        F.when(F.col("__out"), F.col("child")).alias("child"),
        F.when(F.col("__kids").isNull(), "rake").when(F.col("__out"), "splice").otherwise("keep").alias("act"),
    )


def resolve(nodes: DataFrame, edges: DataFrame, paths: bool = False) -> DataFrame:
    """(node, root, depth, kind[, path]) for every node; ``edges`` has one parent per node at most.

    kind ``tree``: the chain ends at root after depth steps. ``cycle``: the node lies on a circle
    (pointing at itself too), root is the smallest node on it, depth 0. ``tail``: the chain runs into
    a circle after depth steps, root is its smallest node. ``path`` holds every node the links lead
    to, in order and once, the node itself first. Edges with a null end are ignored; no edges give
    every node as its own root; no nodes give no rows. Other columns are not carried along.

    With paths the result is as large as the sum of the depths, which is its size by definition;
    without them no row grows with the depth. What is written in all rounds together is a multiple of
    the nodes: a node that hangs at a root is known without asking for the root, so a round's undoing
    touches only the nodes that were still there in that round.
    """
    edges = edges.filter(F.col("node").isNotNull() & F.col("parent").isNotNull()).select("node", "parent")
    none = F.lit(None).cast("string")
    hidden = F.array().cast("array<string>")
    first = cut(nodes.filter(F.col("node").isNotNull()).select("node").distinct().join(edges, "node", "left"))
    roots = first.filter(F.col("parent").isNull()).select("node")
    linked = first.filter(F.col("parent").isNotNull())
    heavy = cut(heavy_keys(linked, ["parent"]))
    linked = salted_join(linked, roots.select(F.col("node").alias("__r")), "parent", "__r", "left", heavy=heavy, spread=["node"])
    # of the popular parents only those that aren't roots are asked again
    inner_heavy = cut(heavy.join(first.filter(F.col("parent").isNotNull()).select(F.col("node").alias("parent")), "parent", "left_semi"))
    hot = not inner_heavy.isEmpty()

    def to_parent(rows: DataFrame, right: DataFrame, key: str) -> DataFrame:
        if hot:
            return salted_join(rows, right, "parent", key, heavy=inner_heavy, spread=["node"])
        return rows.join(right, F.col("parent") == F.col(key))

    live = linked.select("node", "parent", F.lit(1).cast("long").alias("steps"), none.alias("least"), hidden.alias("via"), F.col("__r").isNotNull().alias("top"))

    def cores(rows: DataFrame) -> DataFrame:
        """What is left of circles."""
        path = [F.concat(F.array("node"), "via").alias("path")] if paths else []
        return rows.filter(F.col("parent") == F.col("node")).select("node", F.least("node", "least").alias("root"), F.lit(0).cast("long").alias("depth"), F.lit("cycle").alias("kind"), *path)

    # the rows of each round as (table, rakes, splices, circles)
    states: list[tuple[DataFrame, dict[str, int]]] = []
    ends = [cores(live)]
    live = live.filter(F.col("parent") != F.col("node"))
    turn = 0
    while True:
        act, ring = F.col("act"), F.col("parent") == F.col("node")
        state, n = cut_counted(_round(live, turn) if paths else _round(live, turn).withColumn("via", hidden), rake=act == "rake", splice=act == "splice", ring=(act == "keep") & ring, live=(act == "keep") & ~ring)
        states.append((state, n))
        kept = state.filter(act == "keep").drop("act", "child")
        if n["ring"]:
            ends.append(cores(kept))
        if not n["live"]:
            break
        live = kept.filter(~ring)
        turn += 1

    def known(rows: DataFrame, done: DataFrame, spliced: bool) -> DataFrame:
        """Rows of a round by those that their parents have: at a root at once, else by a join."""
        up = done.select(F.col("node").alias("__n"), F.col("root").alias("__root"), F.col("depth").alias("__d"), F.col("kind").alias("__k"), *([F.col("path").alias("__p")] if paths else []))
        got = to_parent(rows.filter(~F.col("top")), up, "__n")
        on_ring = F.lit(False)
        if spliced:
            rings = done.filter(F.col("kind") == "cycle").select(F.col("node").alias("__c"), *([F.col("path").alias("__ring")] if paths else []))
            got = got.join(rings, F.col("child") == F.col("__c"), "left")
            on_ring = F.col("__c").isNotNull()
        path = []
        if paths:
            along = F.concat(F.array("node"), "via", "__p")
            if spliced:
                at = F.array_position("__ring", F.col("node")).cast("int")
                along = F.when(on_ring, F.concat(F.slice("__ring", at, F.size("__ring")), F.slice("__ring", F.lit(1), at - 1))).otherwise(along)
            path = [along.alias("path")]
        return got.select(
            "node",
            F.col("__root").alias("root"),
            F.when(on_ring, F.lit(0).cast("long")).otherwise(F.col("__d") + F.col("steps")).alias("depth"),
            F.when(on_ring, "cycle").when(F.col("__k") == "tree", "tree").otherwise("tail").alias("kind"),
            *path,
        )

    def below_roots(rows: DataFrame) -> DataFrame:
        path = [F.concat(F.array("node"), "via", F.array("parent")).alias("path")] if paths else []
        return rows.filter("top").select("node", F.col("parent").alias("root"), F.col("steps").alias("depth"), F.lit("tree").alias("kind"), *path)

    # Undone together: the splices of a round and the rakes of the next. A raked node's parent stayed or was
    # spliced later, and a spliced node's parent had a child that stayed, so neither hangs on the other.
    done = cut(reduce(DataFrame.unionByName, ends))
    circles = len(ends) > 1 or not done.isEmpty()
    for k in range(len(states), -1, -1):
        new = []
        if k < len(states) and states[k][1]["rake"]:
            rows = states[k][0].filter(F.col("act") == "rake")
            new += [below_roots(rows), known(rows, done, False)]
        if k and states[k - 1][1]["splice"]:
            rows = states[k - 1][0].filter(F.col("act") == "splice")
            new += [below_roots(rows), known(rows, done, circles)]
        if new:
            before, done = done, cut(reduce(DataFrame.unionByName, [done, *new]))
            drop(before)
        if k < len(states):
            drop(states[k][0])
    top = roots.select("node", F.col("node").alias("root"), F.lit(0).cast("long").alias("depth"), F.lit("tree").alias("kind"), *([F.array("node").alias("path")] if paths else []))
    return top.unionByName(done)


def descendants(resolved: DataFrame) -> DataFrame:
    """(ancestor, node, distance): every node with every node that it leads to, from ``resolve(paths=True)``.

    One row per pair, never a list per ancestor: a popular one may have a third of all nodes below it. A
    circle counts once, as its root, at the distance at which it is reached; which nodes lie on it, and so
    lead to one another, is said by ``resolve`` (kind ``cycle``, same root), not by all their pairs.
    """
    off_ring = F.when(F.col("kind") == "tree", F.col("path")).otherwise(F.slice("path", F.lit(1), F.col("depth").cast("int")))
    steps = F.when(F.col("kind") == "tail", F.concat(off_ring, F.array("root"))).otherwise(off_ring)
    return resolved.select("node", F.posexplode(steps).alias("distance", "ancestor")).filter(F.col("distance") > 0).select("ancestor", "node", F.col("distance").cast("long").alias("distance"))
