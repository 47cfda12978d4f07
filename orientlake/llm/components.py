"""Connected components of a table of links, by star contraction and pointer doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from orientlake.llm.common import Scratch, map_rows


def _forest(batches):
    """Replace the links of one task by links to the smallest node they reach inside the task."""
    parent: dict = {}

    def root(x):
        top = x
        while parent.setdefault(top, top) != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for batch in batches:
        for a, b in zip(batch["a"], batch["b"]):
            x, y = root(a), root(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
    nodes = [x for x in parent if root(x) != x]
    for i in range(0, len(nodes), 65536):
        part = nodes[i:i + 65536]
        yield {"a": part, "b": [root(x) for x in part]}


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for every node that has a link; the component is its smallest node.

    Links with a null end are no links, loops and repeated links change
    nothing, and no links give an empty table.

    Each round hangs the smaller neighbours of a node, and the node itself,
    below the smallest of them, until every node has one such neighbour; then links are
    doubled until they end at the roots. The smallest neighbour is an
    aggregate with partial sums, so a node with a third of all links costs one
    row per task, and joins have one row per node on one side. Each round
    writes the links to the shared folder; only counts come to the driver.
    """
    kind = links.schema[a].dataType.simpleString()
    # greatest and least skip nulls, so a link with a null end is a loop here
    flat = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b")
    scratch, shape = Scratch(links.sparkSession), f"a {kind}, b {kind}"
    now = scratch.cut(map_rows(flat, _forest, shape), "links")
    while True:
        least = scratch.cut(now.groupBy("a").agg(F.min("b").alias("m"), F.max("b").alias("most")), "least")
        if not least.where("m <> most").take(1):
            break
        joined = now.join(least.drop("most"), "a")
        moved = joined.select("a", F.col("m").alias("b")).union(joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")))
        now = scratch.cut(map_rows(moved, _forest, shape), "links")
        scratch.clear(keep=1)
    now = least.select("a", F.col("m").alias("b"))
    while True:
        up = now.toDF("b", "top")
        now = scratch.cut(now.join(up, "b", "left").select("a", F.coalesce("top", "b").alias("b"), F.col("top").isNotNull().alias("moved")), "roots")
        scratch.clear(keep=1)
        if not now.where("moved").take(1):
            break
        now = now.drop("moved")
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.union(stars.select(F.col("component").alias("node"), "component").distinct())
