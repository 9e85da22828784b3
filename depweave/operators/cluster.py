"""Directory roll-ups of file graphs, and capped or partial views of them.

Nodes are (graph_id, id, kind, path) with ids ``file:<path>``, ``sym:<name>`` and
``dir:<prefix>``; edges are (graph_id, src, dst) between ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def check_depth(depth: int) -> int:
    if isinstance(depth, bool) or not isinstance(depth, int) or not 1 <= depth <= 10:
        raise ValueError(f"depth must be an integer from 1 to 10: {depth!r}")
    return depth


def cluster_key(path: Column, depth: int) -> Column:
    """The first ``depth`` segments of a path that is deeper than that, else null."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > depth, F.array_join(F.slice(parts, 1, depth), "/"))


def file_nodes(files: DataFrame) -> DataFrame:
    return files.select("graph_id", F.concat(F.lit("file:"), "path").alias("id"), F.lit("file").alias("kind"), "path")


def symbol_nodes(symbols: DataFrame) -> DataFrame:
    return symbols.select("graph_id", F.concat(F.lit("sym:"), "name").alias("id"), F.lit("symbol").alias("kind"), F.lit(None).cast("string").alias("path"))


def graph_of(files: DataFrame, imports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the live files: imports among them and of external symbols."""
    live = files.where(~F.col("deleted")).select("graph_id", "path")
    src = live.withColumnRenamed("path", "src")
    from_live = imports.join(src, ["graph_id", "src"], "left_semi")
    inner = from_live.where("dst_kind = 'file'").join(live.withColumnRenamed("path", "dst"), ["graph_id", "dst"], "left_semi")
    outer = from_live.where("dst_kind = 'symbol'")
    node = lambda kind, c: F.concat(F.lit(kind), c)
    edges = inner.select("graph_id", node("file:", "src").alias("src"), node("file:", "dst").alias("dst")).unionByName(outer.select("graph_id", node("file:", "src").alias("src"), node("sym:", "dst").alias("dst"))).distinct()
    symbols = outer.select("graph_id", F.col("dst").alias("name")).distinct()
    return file_nodes(live).unionByName(symbol_nodes(symbols)), edges


def clustered(nodes: DataFrame, edges: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
    """(nodes with file_count, edges with weight) after folding files into directories.

    Symbols and files that are not deep enough stand for themselves; edges inside a
    cluster vanish, the others are counted.
    """
    key = cluster_key(F.col("path"), check_depth(depth))
    place = nodes.select("graph_id", "id", F.when(F.col("kind") == "file", F.coalesce(F.concat(F.lit("dir:"), key), F.col("id"))).otherwise(F.col("id")).alias("cluster"), F.when((F.col("kind") == "file") & key.isNotNull(), F.lit("dir_cluster")).otherwise(F.col("kind")).alias("kind"))
    folded = place.groupBy("graph_id", F.col("cluster").alias("id"), "kind").agg(F.when(F.col("kind") != "symbol", F.count("*")).alias("file_count"))
    a, b = place.select("graph_id", F.col("id").alias("src"), F.col("cluster").alias("s")), place.select("graph_id", F.col("id").alias("dst"), F.col("cluster").alias("t"))
    between = edges.join(a, ["graph_id", "src"]).join(b, ["graph_id", "dst"]).where("s <> t")
    return folded, between.groupBy("graph_id", F.col("s").alias("src"), F.col("t").alias("dst")).agg(F.count("*").alias("weight"))


def rolled_up(nodes: DataFrame, edges: DataFrame, deepest: int = 10) -> tuple[DataFrame, DataFrame]:
    """:func:`clustered` at every depth from 1 to ``deepest`` at once: (nodes, edges), both with a depth.

    The graph is folded once, to the deepest level.  A cluster's id says which cluster it belongs to at any lower
    depth, so the other levels are sums of that one: each folded row goes to its prefixes, and one grouping by
    (depth, cluster) or (depth, pair) adds the counts up.  What lies inside one cluster lies inside all those above it.
    """
    folded, between = clustered(nodes, edges, deepest)
    depths = F.explode(F.sequence(F.lit(1), F.lit(deepest))).alias("depth")

    def up(c: str) -> Column:
        parts = F.split(F.regexp_replace(F.col(c), "^(dir|file):", ""), "/")
        return F.when(~F.startswith(F.col(c), F.lit("sym:")) & (F.size(parts) > F.col("depth")), F.concat(F.lit("dir:"), F.array_join(F.slice(parts, F.lit(1), F.col("depth")), "/"))).otherwise(F.col(c))

    n = folded.select("graph_id", "id", "kind", "file_count", depths).select("graph_id", "depth", up("id").alias("id"), "kind", "file_count")
    n = n.withColumn("kind", F.when(F.startswith("id", F.lit("dir:")), "dir_cluster").otherwise(F.col("kind")))
    e = between.select("graph_id", "src", "dst", "weight", depths).select("graph_id", "depth", up("src").alias("src"), up("dst").alias("dst"), "weight").where("src <> dst")
    return n.groupBy("graph_id", "depth", "id", "kind").agg(F.sum("file_count").alias("file_count")), e.groupBy("graph_id", "depth", "src", "dst").agg(F.sum("weight").alias("weight"))


def expanded(files: DataFrame, imports: DataFrame, prefix: str, depth: int | None = None) -> tuple[DataFrame, DataFrame]:
    """One directory opened: files under it and edges among them, folded one level deeper."""
    prefix = prefix.strip("/")
    nodes, edges = graph_of(files.where(F.startswith(F.col("path"), F.lit(prefix + "/"))), imports.where("dst_kind = 'file'"))
    return clustered(nodes, edges, depth if depth is not None else len(prefix.split("/")) + 1)


def capped(nodes: DataFrame, edges: DataFrame, most: int = 10_000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, (graph_id, total, truncated)) with the first ``most`` edges of each graph by (src, dst).

    All files stay; symbols stay only with an edge.
    """
    rank = F.row_number().over(Window.partitionBy("graph_id").orderBy("src", "dst"))
    kept = edges.withColumn("rank", rank).where(F.col("rank") <= most).drop("rank")
    ends = kept.select("graph_id", F.col("src").alias("id")).unionByName(kept.select("graph_id", F.col("dst").alias("id"))).distinct()
    nodes = nodes.where("kind <> 'symbol'").unionByName(nodes.where("kind = 'symbol'").join(ends, ["graph_id", "id"], "left_semi"))
    stats = edges.groupBy("graph_id").agg(F.count("*").alias("total")).withColumn("truncated", F.col("total") > most)
    return nodes, kept, stats


def first_of(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row per key: the first by ``order``."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")
