"""Inversions against all pairs, and a million edges between two rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from depweave.operators import inversions
from depweave.plans import views


@pytest.mark.parametrize("block", [1024, 3])
def test_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(inversions, "BLOCK", block)
    r = random.Random(4)
    rows = [(k, r.randint(0, most), r.randint(0, most)) for k, most in (("a", 3), ("b", 40), ("c", 5000), ("d", 0), ("e", 15), ("f", 16)) for _ in range(60)]
    tops = {k: max(t for key, _, t in rows if key == k) for k, *_ in rows}
    df = spark.createDataFrame([(*x, tops[x[0]]) for x in rows], "k string, s int, t int, top int").repartition(5)
    want = {k: sum(p[0] == q[0] == k and p[1] < q[1] and p[2] > q[2] for p in rows for q in rows) for k in tops}
    assert {x["k"]: x["n"] for x in inversions.inversions(df, ["k"], "s", "t", "top").collect()} == want
    assert inversions.inversions(df.limit(0), ["k"], "s", "t", "top").collect() == []


def count(t: np.ndarray) -> int:
    """Inversions of a sequence, by merging."""
    n = len(t)
    if n < 2:
        return 0
    left, right = t[: n // 2], t[n // 2 :]
    return count(left) + count(right) + int((len(left) - np.searchsorted(np.sort(left), right, "right")).sum())


def test_a_million_edges_between_two_rows(spark):
    """Every node of one row has ten edges; pairs that cross number some 5 x 10^11."""
    n = 100_000
    placed = spark.range(2 * n).select(F.lit("g").alias("graph_id"), F.col("id").cast("string").alias("node"), F.expr(f"id div {n}").alias("row"), (F.col("id") % n).alias("slot"))
    edges = spark.range(10 * n).select(F.lit("g").alias("graph_id"), (F.col("id") % n).cast("string").alias("src"), (n + (F.col("id") * 7919 + F.expr(f"id div {n}") * 31) % n).cast("string").alias("dst"))
    s, k = np.arange(10 * n) % n, np.arange(10 * n) // n
    t = (np.arange(10 * n) * 7919 + k * 31) % n
    order = np.lexsort((t, s))  # of one source by rising target, so ties are no inversions
    assert views.crossings(edges, placed).first()["crossings"] == count(t[order])


def test_no_pair_is_listed(spark):
    placed = spark.createDataFrame([("g", "a", 0, 0), ("g", "b", 1, 0)], "graph_id string, node string, row long, slot int")
    edges = spark.createDataFrame([("g", "a", "b")], "graph_id string, src string, dst string")
    out = views.crossings(edges, placed)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert out.collect()[0]["crossings"] == 0
    assert "Join Cross" not in plan and not [x for x in plan.splitlines() if "Join" in x and ("<" in x or ">" in x.replace("<=>", ""))]
