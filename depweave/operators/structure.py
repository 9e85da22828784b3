"""Structure of directed graphs: degrees, strongly connected components, layers, roles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from depweave.session import materialise

#: Graphs of up to so many edges are condensed inside one task each; larger ones by distributed rounds.
LOCAL_EDGES = 2_000_000


def known_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges (graph_id, src, dst) both of whose ends are among nodes (graph_id, node); repeats stay."""
    n = nodes.select("graph_id", "node").distinct()
    return edges.join(n.withColumnRenamed("node", "src"), ["graph_id", "src"], "left_semi").join(n.withColumnRenamed("node", "dst"), ["graph_id", "dst"], "left_semi").select("graph_id", "src", "dst")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, node, fan_in, fan_out) for all nodes; repeated edges and loops count.

    Both counts come from one grouping over the edges seen from either end.
    """
    ends = edges.select("graph_id", F.inline(F.array(F.struct(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))))
    counts = ends.groupBy("graph_id", "node").agg(F.sum("i").alias("i"), F.sum("o").alias("o"))
    zero = F.lit(0).cast("long")
    return nodes.select("graph_id", "node").distinct().join(counts, ["graph_id", "node"], "left").select("graph_id", "node", F.coalesce("i", zero).alias("fan_in"), F.coalesce("o", zero).alias("fan_out"))


def condense_arrays(src: np.ndarray, dst: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(component, layer) of nodes 0..n-1; a component is named by its least node.

    Kosaraju's two sweeps over compressed adjacency, then longest-path layers in
    topological order.
    """

    def adjacency(a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int]]:
        order = np.argsort(a, kind="stable")
        return np.searchsorted(a[order], np.arange(n + 1)).tolist(), b[order].tolist()

    begin, out = adjacency(src, dst)
    done, finished = [False] * n, []
    for root in range(n):
        if done[root]:
            continue
        done[root] = True
        stack, at = [root], [begin[root]]
        while stack:
            v, i = stack[-1], at[-1]
            if i < begin[v + 1]:
                at[-1] += 1
                w = out[i]
                if not done[w]:
                    done[w] = True
                    stack.append(w)
                    at.append(begin[w])
            else:
                finished.append(v)
                stack.pop()
                at.pop()
    back, into = adjacency(dst, src)
    number, members = [-1] * n, []
    for root in reversed(finished):  # components appear in topological order
        if number[root] >= 0:
            continue
        k = len(members)
        number[root] = k
        members.append([root])
        stack = [root]
        while stack:
            v = stack.pop()
            for w in into[back[v] : back[v + 1]]:
                if number[w] < 0:
                    number[w] = k
                    members[k].append(w)
                    stack.append(w)
    layer = [0] * len(members)
    for k, group in enumerate(members):
        for v in group:
            for w in into[back[v] : back[v + 1]]:
                if number[w] != k:
                    layer[k] = max(layer[k], layer[number[w]] + 1)
    comp = np.array(number, np.int64)
    name = np.array([min(g) for g in members], np.int64) if members else np.zeros(0, np.int64)
    return name[comp], np.array(layer, np.int64)[comp]


#: Rows up to which a list of nodes is broadcast (some twenty bytes each).
BROADCAST_ROWS = 1_000_000


def _sent(nodes: DataFrame) -> DataFrame:
    """Broadcast if it was counted to be small."""
    return F.broadcast(nodes) if nodes.count() <= BROADCAST_ROWS else nodes


def numbered(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes with an id, edges between them as (graph_id, src, dst) of ids), so that what is shuffled round by round are numbers; repeats of edges stay."""
    ids = materialise(nodes.select("graph_id", "node").distinct().withColumn("id", F.monotonically_increasing_id()), "graph-ids")
    a, b = ids.select("graph_id", F.col("node").alias("src"), F.col("id").alias("s")), ids.select("graph_id", F.col("node").alias("dst"), F.col("id").alias("d"))
    known = edges.select("graph_id", "src", "dst").join(a, ["graph_id", "src"]).join(b, ["graph_id", "dst"])
    return ids, materialise(known.select("graph_id", F.col("s").alias("src"), F.col("d").alias("dst")), "known-edges")


def _condense_group(table: pa.Table) -> pa.Table:
    src, dst = table["src"].to_numpy(), table["dst"].to_numpy()
    names, codes = np.unique(np.concatenate([src, dst]), return_inverse=True)
    comp, layer = condense_arrays(codes[: len(src)], codes[len(src) :], len(names))
    return pa.table({"id": pa.array(names, pa.int64()), "component": pa.array(names[comp], pa.int64()), "layer": pa.array(layer, pa.int64())})


def condense_ids(known: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(id, component, layer) of the nodes of materialised edges (graph_id, src, dst) of ids; ``component`` is an id of the component."""
    sizes = materialise(known.groupBy("graph_id").agg(F.count("*").alias("n")), "graph-sizes")
    of = lambda kept: known.join(sizes.where(kept).select("graph_id"), "graph_id", "left_semi").distinct()
    result = of(F.col("n") <= local_edges).groupBy("graph_id").applyInArrow(_condense_group, "id long, component long, layer long")
    if not sizes.where(F.col("n") > local_edges).isEmpty():
        # ids tell graphs apart
        large = materialise(of(F.col("n") > local_edges).select(F.lit(0).alias("graph_id"), "src", "dst"), "graph-large")
        done = layers_distributed(large, components_distributed(large)).select(F.col("node").alias("id"), "component", "layer")
        result = done if sizes.where(F.col("n") <= local_edges).isEmpty() else result.unionByName(done)
    return result


def condense(edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(graph_id, node, component, layer) of every node with an edge.

    ``component`` is the least node of the strongly connected component, ``layer``
    the longest way to it from a source over the graph of components.
    """
    ends = edges.select("graph_id", F.col("src").alias("node")).unionByName(edges.select("graph_id", F.col("dst").alias("node")))
    ids, known = numbered(ends, edges)
    shape = materialise(ids.join(condense_ids(known, local_edges), "id"), "condensed")
    names = shape.groupBy("component").agg(F.min("node").alias("name"))
    return shape.join(names, "component").select("graph_id", "node", F.col("name").alias("component"), "layer")


def components_distributed(edges: DataFrame) -> DataFrame:
    """(graph_id, node, component) by trimming and colouring rounds over DataFrames.

    Trimming takes off nodes without a way in or out.  Of the rest each round spreads
    the least labels that are new along the edges until nothing changes; then the nodes that reach
    the label's owner back inside its colour are its component.
    """
    live = edges.where("src <> dst")
    parts = [edges.select("graph_id", F.col("src").alias("node")).unionByName(edges.select("graph_id", F.col("dst").alias("node"))).distinct()]
    everything = materialise(parts[0], "scc-nodes")
    settled: DataFrame | None = None

    def without(nodes: DataFrame) -> DataFrame:
        rest, gone = live, _sent(nodes.select("graph_id", "node"))
        for end in ("src", "dst"):
            rest = rest.join(gone.withColumnRenamed("node", end), ["graph_id", end], "left_anti")
        return materialise(rest, "scc-live")

    while True:
        while True:  # trim
            sides = live.select("graph_id", F.inline(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))))
            held = materialise(sides.groupBy("graph_id", "node").agg(F.max("o").alias("o"), F.max("i").alias("i")), "scc-ends")
            bare = held.where("o + i < 2")
            if bare.isEmpty():
                break
            live = without(bare)
        if held.isEmpty():
            break
        color = held.select("graph_id", "node", F.col("node").alias("color"))
        moved = color
        while True:
            offers = _sent(moved.withColumnRenamed("node", "src"))
            offered = live.join(offers, ["graph_id", "src"]).groupBy("graph_id", F.col("dst").alias("node")).agg(F.min("color").alias("new"))
            nxt = color.join(offered, ["graph_id", "node"], "left")
            nxt = materialise(nxt.select("graph_id", "node", F.least("color", "new").alias("color"), F.coalesce(F.col("new") < F.col("color"), F.lit(False)).alias("moved")), "scc-color")
            color, moved = nxt.select("graph_id", "node", "color"), nxt.where("moved").select("graph_id", "node", "color")
            if moved.isEmpty():
                break
        colored = _sent(color)
        a, b = colored.select("graph_id", F.col("node").alias("src"), F.col("color").alias("cs")), colored.select("graph_id", F.col("node").alias("dst"), F.col("color").alias("cd"))
        inside = materialise(live.join(a, ["graph_id", "src"]).join(b, ["graph_id", "dst"]).where("cs = cd").select("graph_id", "src", "dst", F.col("cs").alias("color")), "scc-inside")
        found = materialise(color.where("node = color").select("graph_id", "node", "color"), "scc-found")
        front = found
        while True:  # back from the owners
            new = inside.join(_sent(front.select("graph_id", F.col("node").alias("dst"))), ["graph_id", "dst"]).select("graph_id", F.col("src").alias("node"), "color").distinct()
            front = materialise(new.join(found, ["graph_id", "node"], "left_anti"), "scc-front")
            if front.isEmpty():
                break
            found = found.unionByName(front)
        found = materialise(found, "scc-found")
        settled = found if settled is None else settled.unionByName(found)
        live = without(found)
    if settled is None:
        return everything.withColumn("component", F.col("node"))
    return everything.join(settled, ["graph_id", "node"], "left").select("graph_id", "node", F.coalesce("color", "node").alias("component"))


def condensation(edges: DataFrame, components: DataFrame) -> DataFrame:
    """Distinct edges (graph_id, src, dst) between different components."""
    c = components.select("graph_id", "node", "component")
    a, b = c.select("graph_id", F.col("node").alias("src"), F.col("component").alias("cs")), c.select("graph_id", F.col("node").alias("dst"), F.col("component").alias("cd"))
    return edges.join(a, ["graph_id", "src"]).join(b, ["graph_id", "dst"]).where("cs <> cd").select("graph_id", F.col("cs").alias("src"), F.col("cd").alias("dst")).distinct()


def layers_distributed(edges: DataFrame, components: DataFrame) -> DataFrame:
    """Adds layer to (graph_id, node, component): round k takes the components that no remaining one precedes."""
    components = materialise(components, "layer-components")
    dag = materialise(condensation(edges, components), "layer-dag")
    rest = materialise(components.select("graph_id", F.col("component").alias("node")).distinct(), "layer-rest")
    done, k = None, 0
    while not rest.isEmpty():
        blocked = dag.select("graph_id", F.col("dst").alias("node")).distinct()
        now = materialise(rest.join(blocked, ["graph_id", "node"], "left_anti").withColumn("layer", F.lit(k).cast("long")), "layer")
        done = now if done is None else done.unionByName(now)
        gone = now.select("graph_id", "node")
        dag = materialise(dag.join(gone.withColumnRenamed("node", "src"), ["graph_id", "src"], "left_anti"), "layer-dag")
        rest = materialise(rest.join(gone, ["graph_id", "node"], "left_anti"), "layer-rest")
        k += 1
    if done is None:
        return components.withColumn("layer", F.lit(0).cast("long"))
    return components.join(done.withColumnRenamed("node", "component"), ["graph_id", "component"]).select("graph_id", "node", "component", "layer")


def metrics(nodes: DataFrame, edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(graph_id, node, component, layer, fan_in, fan_out, in_cycle) for every node; loops make no cycle."""
    ids, known = numbered(nodes, edges)
    each = known.select(F.inline(F.array(F.struct(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))))
    fans = each.groupBy("id").agg(F.sum("i").alias("i"), F.sum("o").alias("o"))
    zero = F.lit(0).cast("long")
    joined = ids.join(fans, "id", "left").join(condense_ids(known, local_edges), "id", "left")
    joined = materialise(joined.select("graph_id", "node", F.coalesce("component", "id").alias("component"), *[F.coalesce(c, zero).alias(n) for c, n in (("layer", "layer"), ("i", "fan_in"), ("o", "fan_out"))]), "metrics")
    groups = joined.groupBy("component").agg(F.min("node").alias("name"), F.count("*").alias("n"))
    return joined.join(groups, "component").select("graph_id", "node", F.col("name").alias("component"), "layer", "fan_in", "fan_out", (F.col("n") > 1).alias("in_cycle"))


def cycles(measured: DataFrame) -> DataFrame:
    """(graph_id, size, members): components of more than one node, members sorted."""
    return measured.where("in_cycle").groupBy("graph_id", "component").agg(F.count("*").alias("size"), F.array_sort(F.collect_list("node")).alias("members")).select("graph_id", "size", "members")


def entry_points(measured: DataFrame) -> DataFrame:
    return measured.where((F.col("fan_in") == 0) & (F.col("fan_out") > 0)).select("graph_id", "node")


def orphans(measured: DataFrame) -> DataFrame:
    return measured.where((F.col("fan_in") == 0) & (F.col("fan_out") == 0)).select("graph_id", "node")


def hubs(measured: DataFrame, most: int = 15) -> DataFrame:
    """The ``most`` nodes of each graph with the largest positive fan-in, ties by name."""
    rank = F.row_number().over(Window.partitionBy("graph_id").orderBy(F.desc("fan_in"), "node"))
    return measured.where("fan_in > 0").withColumn("rank", rank).where(F.col("rank") <= most).select("graph_id", "node", "fan_in", "fan_out", "rank")


def max_layer(measured: DataFrame) -> DataFrame:
    return measured.groupBy("graph_id").agg(F.max("layer").alias("max_layer"))


def level_edges(edges: DataFrame, measured: DataFrame) -> DataFrame:
    """Distinct edges whose ends share a layer: they can only belong to a cycle (a loop included)."""
    a, b = measured.select("graph_id", F.col("node").alias("src"), F.col("layer").alias("ls")), measured.select("graph_id", F.col("node").alias("dst"), F.col("layer").alias("ld"))
    return edges.select("graph_id", "src", "dst").distinct().join(a, ["graph_id", "src"]).join(b, ["graph_id", "dst"]).where("ls = ld").select("graph_id", "src", "dst", F.col("ls").alias("layer"))
