"""Connected components of an edge table by repeated minimum-neighbour contraction.

Each round points every node at its least neighbour (itself included), shortens
the pointers, renames the edges by them and drops loops and repeats.  Components
at least halve in nodes each round, so the rounds grow with the logarithm of the
longest chain.  Minima are combined before the shuffle, and joins are between two
written tables, so adaptive execution can split a hub.  Nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depweave.session import materialise


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(a, b) edges -> (node, root) for every node of an edge; root is the least node of its component.

    Loops and null ends are ignored; repeated edges do no harm; no edges give no rows.
    """
    live = materialise(edges.select("a", "b").where("a <> b").distinct(), f"{name}-edges")
    assigned: DataFrame | None = None
    while not live.isEmpty():
        both = live.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(live.select(F.col("b").alias("node"), F.col("a").alias("other")))
        least = both.groupBy("node").agg(F.min("other").alias("other"))
        parent = materialise(least.select("node", F.least("node", "other").alias("root")), f"{name}-parents")
        while True:  # pointer doubling until every pointer ends at a root
            up = parent.where("node <> root").select(F.col("node").alias("mid"), F.col("root").alias("top"))
            nxt = parent.join(up, parent["root"] == up["mid"], "left").select("node", F.coalesce("top", "root").alias("root"), F.col("top").isNotNull().alias("moved"))
            nxt = materialise(nxt, f"{name}-parents")
            parent = nxt.select("node", "root")
            if nxt.where("moved").isEmpty():
                break
        if assigned is None:
            assigned = parent
        else:
            to = parent.select(F.col("node").alias("mid"), F.col("root").alias("top"))
            assigned = materialise(assigned.join(to, assigned["root"] == to["mid"], "left").select("node", F.coalesce("top", "root").alias("root")), f"{name}-assigned")
        left = parent.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        right = parent.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        live = materialise(live.join(left, "a").join(right, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), f"{name}-edges")
    if assigned is None:
        return live.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return assigned
