"""All depths and all seeds at once against one at a time."""

import random

import pytest
from pyspark.sql import functions as F

from depweave.operators import cluster, reach

G = "g"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_every_depth_at_once_is_every_depth_alone(spark):
    r = random.Random(3)
    paths = sorted({"/".join(r.choice(["a", "b", "file:", "dir:x"]) for _ in range(r.randint(1, 13))) for _ in range(90)} | {"top.py", "a/b.py"})
    files = spark.createDataFrame([(g, p, False) for g in ("g", "h") for p in paths], "graph_id string, path string, deleted boolean")
    edges = {(g, r.choice(paths), "file", r.choice(paths)) for g in ("g", "h") for _ in range(200)} | {("g", r.choice(paths), "symbol", f"a/b/{i}") for i in range(20)}
    imports = spark.createDataFrame(sorted(edges), "graph_id string, src string, dst_kind string, dst string")
    graph = cluster.graph_of(files, imports)
    nodes, between = cluster.rolled_up(*graph)
    for depth in range(1, 11):
        one = cluster.clustered(*graph, depth)
        assert rows(nodes.where(F.col("depth") == depth).select("graph_id", "id", "kind", "file_count")) == rows(one[0])
        assert rows(between.where(F.col("depth") == depth).select("graph_id", "src", "dst", "weight")) == rows(one[1])


@pytest.mark.parametrize("bucket", [1 << 16, 40])
def test_all_seeds_at_once_are_each_seed_alone(spark, monkeypatch, bucket):
    monkeypatch.setattr(reach, "BUCKET", bucket)
    r = random.Random(6)
    n = 150  # three words
    pairs = sorted({(G, f"n{r.randrange(n)}", f"n{r.randrange(n)}") for _ in range(330)} | {("other", "n1", "n2"), ("other", "n2", "n1")})
    seeds = [(G, f"n{i}") for i in range(n)] + [("other", "n1"), ("other", "n1")]
    live = {x for x in seeds if x[1] not in ("n3", "n4")}
    edges = spark.createDataFrame(pairs, "graph_id string, src string, dst string")
    nodes = lambda x: spark.createDataFrame(sorted(x), "graph_id string, node string")
    want = {}
    for g, s in set(seeds):
        seen, front = set(), {s}
        for hop in range(1, 5):
            front = {b for k, a, b in pairs if k == g and a in front and (g, b) in live} - seen
            seen |= front
            if front:
                want[g, s, hop] = len(front)
    got = reach.reach_counts(edges, nodes(seeds), 4, nodes(live)).collect()
    assert {(x["graph_id"], x["node"], x["hop"]): x["n"] for x in got} == want and len(got) == len(want)
    one = reach.reach(edges, nodes([(G, "n7")]), 4, nodes(live)).groupBy("hop").count().collect()
    assert {x["hop"]: x["count"] for x in one} == {h: v for (g, s, h), v in want.items() if (g, s) == (G, "n7")}


def test_every_node_has_a_bit_of_its_own(spark, monkeypatch):
    monkeypatch.setattr(reach, "BUCKET", 100)
    nodes = spark.range(1000).select(F.lit(G).alias("graph_id"), F.col("id").cast("string").alias("node"))
    at = reach.numbered(nodes).collect()
    assert len({(x["block"], x["bit"]) for x in at}) == 1000 and {x["bit"] for x in at} <= set(range(64))


def test_no_seeds(spark):
    empty = spark.createDataFrame([], "graph_id string, node string")
    assert reach.reach_counts(spark.createDataFrame([(G, "a", "b")], "graph_id string, src string, dst string"), empty, 3).collect() == []


def test_rounds_and_pairs_shuffle_numbers_instead_of_paths(spark, monkeypatch):
    from depweave.operators import history, structure

    made = {}
    for module in (structure, history):
        monkeypatch.setattr(module, "materialise", lambda df, name, f=module.materialise: made.setdefault(name, []).append(dict(df.dtypes)) or f(df, name))
    r = random.Random(8)
    edges = spark.createDataFrame([(g, f"n{r.randrange(60)}", f"n{r.randrange(60)}") for g in ("g", "h") for _ in range(90)], "graph_id string, src string, dst string")
    nodes = spark.createDataFrame([(g, f"n{i}") for g in ("g", "h") for i in range(58)], "graph_id string, node string")
    want = rows(structure.metrics(nodes, edges))
    assert rows(structure.metrics(nodes, edges, 0)) == want
    for table, types in made.items():
        if table.startswith(("scc", "layer", "graph-large")):
            assert all(x in ("int", "bigint", "boolean") for t in types for x in t.values()), table
    commits = spark.createDataFrame([("g", c, f"n{i}") for c in range(4) for i in (9, 10, 57, 59)], "graph_id string, commit_seq long, path string")
    found = rows(history.coupling(commits, nodes.withColumnRenamed("node", "path")))
    assert found == [("g", a, b, 4, 1.0) for a, b in (("n10", "n57"), ("n10", "n9"), ("n57", "n9"))]
    assert "string" not in made["shared"][0].values() and made["touched"][0]["id"] == "bigint"
