"""Ordering of layered graphs with few edge crossings.

Rows are swept by barycenters in alternating directions, then neighbours are
swapped where that lowers the number of crossings (up to ``TRANSPOSE_NODES`` nodes).
Each graph is ordered inside one task, whatever its size, and must fit its memory.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SWEEPS = 6
PASSES = 4
TRANSPOSE_NODES = 1200


def barycenter(rows: list[list[str]], near: dict[str, list[str]], sweeps: int = SWEEPS) -> list[list[str]]:
    """Each sweep orders a row by the mean place of its nodes' neighbours in rows passed before; others keep their place."""
    rows = [list(r) for r in rows]
    place = {v: i / max(1, len(r) - 1) for r in rows for i, v in enumerate(r)}
    row_of = {v: k for k, r in enumerate(rows) for v in r}
    for s in range(sweeps):
        down = s % 2 == 0
        order = range(1, len(rows)) if down else range(len(rows) - 2, -1, -1)
        for k in order:
            def key(v: str) -> float:
                at = [place[w] for w in near.get(v, ()) if (row_of[w] < k if down else row_of[w] > k)]  # noqa: B023
                return sum(at) / len(at) if at else place[v]

            rows[k].sort(key=key)
            for i, v in enumerate(rows[k]):
                place[v] = i / max(1, len(rows[k]) - 1)
    return rows


def _pair_crossings(a: list[int], b: list[int]) -> int:
    """Crossings of the edges of a (left) and b (right): pairs whose far ends stand the other way round; both sorted."""
    return sum(bisect_left(b, x) for x in a)


def transpose(rows: list[list[str]], near: dict[str, list[str]], passes: int = PASSES) -> list[list[str]]:
    rows = [list(r) for r in rows]
    slot = {v: i for r in rows for i, v in enumerate(r)}
    row_of = {v: k for k, r in enumerate(rows) for v in r}
    for _ in range(passes):
        better = False
        for k, r in enumerate(rows):
            for i in range(len(r) - 1):
                left, right = r[i], r[i + 1]
                ends: dict[int, tuple[list[int], list[int]]] = {}
                for v, which in ((left, 0), (right, 1)):
                    for w in near.get(v, ()):
                        if row_of[w] != k:
                            insort(ends.setdefault(row_of[w], ([], []))[which], slot[w])
                now = sum(_pair_crossings(a, b) for a, b in ends.values())
                then = sum(_pair_crossings(b, a) for a, b in ends.values())
                if then < now:
                    r[i], r[i + 1] = right, left
                    slot[left], slot[right] = i + 1, i
                    better = True
        if not better:
            break
    return rows


def ordered(placed: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, node, row, slot) with the slots of a :func:`views.rows_of` table changed to lower crossings."""
    schema = "graph_id string, node string, row long, slot int"
    nodes = placed.select("graph_id", "node", "row", "slot", F.lit(None).cast("string").alias("dst"))
    keys = nodes.select("graph_id").distinct()
    e = edges.join(keys, "graph_id", "left_semi").select("graph_id", F.col("src").alias("node"), F.lit(None).cast("long").alias("row"), F.lit(None).cast("int").alias("slot"), "dst").distinct()

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes = pdf[pdf["dst"].isna()].sort_values(["row", "slot"])
        names = set(nodes["node"])
        near: dict[str, list[str]] = {}
        for a, b in pdf[pdf["dst"].notna()][["node", "dst"]].sort_values(["node", "dst"]).itertuples(index=False):
            if a in names and b in names and a != b:
                near.setdefault(a, []).append(b)
                near.setdefault(b, []).append(a)
        groups = nodes.groupby("row", sort=True)["node"].apply(list)
        rows = barycenter(list(groups), near)
        if len(names) <= TRANSPOSE_NODES:
            rows = transpose(rows, near)
        out = [(pdf["graph_id"].iloc[0], v, int(k), i) for k, r in zip(groups.index, rows, strict=True) for i, v in enumerate(r)]
        return pd.DataFrame(out, columns=["graph_id", "node", "row", "slot"])

    return nodes.unionByName(e).groupBy("graph_id").applyInPandas(one, schema)
