"""Everything that can be asked of a store, as plain Python results.

A facade for tools and services: arguments are checked, tables are narrowed to one
graph, and small results are collected.  Errors are ``ValueError`` (bad argument) and
``LookupError`` (no such thing).
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depweave.functions.paths import check_graph_id, clean_file_path
from depweave.operators import cluster, reach, search, structure
from depweave.plans import tools, views
from depweave.sources import clone, gitlog, slices
from depweave.store import Store


#: Rows of a list that are collected; the tables themselves have all.
MOST = 10_000


class Workspace:
    """``repos_dir`` holds the working copies that sources and histories are read from."""

    def __init__(self, store: Store, repos_dir: str | Path):
        self.store, self.repos_dir = store, Path(repos_dir)
        self.spark = store.spark
        self._histories: dict[str, tuple[str | None, DataFrame]] = {}

    def _tables(self, graph_id: str) -> dict[str, DataFrame]:
        check_graph_id(graph_id)
        return self.store.tables(graph_id)

    def _seed(self, graph_id: str, path: str) -> DataFrame:
        return self.spark.range(1).select(F.lit(graph_id).alias("graph_id"), F.lit(clean_file_path(path)).alias("node"))

    def history(self, graph_id: str) -> DataFrame:
        """Commit files of a graph's working copy, read once for each publication of the graph; empty without a copy."""
        publication = self.store.publications().get(graph_id)
        known, commits = self._histories.get(graph_id, (None, None))
        if commits is None or known != publication:
            if commits is not None:
                commits.unpersist()
            log = gitlog.read_history_log(self.spark, str(clone.local_path(graph_id, self.repos_dir)), graph_id)
            commits = gitlog.commit_files(log).select("graph_id", "commit_seq", "path").cache()
            self._histories[graph_id] = publication, commits
        return commits

    # ---- tools ---------------------------------------------------------------------

    def list_repos(self) -> list[dict]:
        return [r.asDict() for r in tools.list_repos(self.store.repositories()).collect()]

    def repo_info(self, graph_id: str) -> dict:
        t = self._tables(graph_id)
        found = tools.repo_info(t["repositories"], t["files"], t["functions"]).first()
        if not found:
            raise LookupError(f"there is no graph {graph_id!r}; ingest it first")
        return found.asDict()

    def structure(self, graph_id: str, path: str = "", limit: int = 200) -> dict:
        entries, stats = tools.structure(self._tables(graph_id)["files"], path, limit)
        more = stats.first()
        return {"entries": [r.asDict() for r in entries.orderBy("path").collect()], "truncated": bool(more and more["truncated"])}

    def dependencies(self, graph_id: str, path: str, direction: str = "both", max_hops: int = 3) -> dict:
        return tools.file_dependencies(self._tables(graph_id), graph_id, clean_file_path(path), direction, max_hops)

    def search(self, graph_id: str, query: str, kind: str = "any", limit: int = 20, offset: int = 0) -> dict:
        t = self._tables(graph_id)
        hits, nxt = search.search_nodes(t["files"], t["functions"], graph_id, query, kind, limit, offset, t)
        return {"hits": [r.asDict() for r in hits.orderBy(F.desc("score"), "name", "id").collect()], "next_offset": nxt}

    def node(self, graph_id: str, node_id: str) -> dict:
        found = tools.nodes(self._tables(graph_id)).where(F.col("id") == node_id).first()
        if not found:
            raise LookupError(f"there is no node {node_id!r} in {graph_id!r}")
        return found.asDict()

    def file_metadata(self, graph_id: str, path: str) -> dict:
        found = tools.file_metadata(self._tables(graph_id)["files"]).where(F.col("path") == clean_file_path(path)).first()
        if not found:
            raise LookupError(f"there is no file {path!r} in {graph_id!r}")
        return found.asDict()

    def _lines(self, graph_id: str, path: str, start: int | None, end: int | None) -> tuple[str, int, int, bool]:
        """A range of the source that the store keeps, or of the working copy if it keeps none."""
        stored = self.store.table("sources", graph_id).where(F.col("path") == path)
        found = slices.with_ranges(stored, F.lit(start).cast("int"), F.lit(end).cast("int")).first()
        if found is None:
            return slices.read_source(clone.local_path(graph_id, self.repos_dir), path, start, end)
        if found["error"]:
            raise ValueError(found["error"])
        return found["slice"], found["start_line"], found["end_line"], found["truncated"]

    def file_content(self, graph_id: str, path: str, start: int | None = None, end: int | None = None) -> dict:
        about = self.file_metadata(graph_id, path)  # deleted files are not shown
        text, first, last, cut = self._lines(graph_id, about["path"], start, end)
        return {"path": about["path"], "language": about["language"], "content": text, "start_line": first, "end_line": last, "truncated": cut}

    def function_source(self, graph_id: str, node_id: str) -> dict:
        about = self.node(graph_id, node_id)
        if about["kind"] in ("file", "other") or about["start_line"] is None or about["end_line"] is None:
            raise ValueError(f"{node_id!r} is no function with a place in a file")
        text, first, last, cut = self._lines(graph_id, about["path"], about["start_line"], about["end_line"])
        return {**about, "source": text, "start_line": first, "end_line": last, "truncated": cut}

    def schema(self, graph_id: str) -> dict:
        return {"labels": list(tools.NODE_KINDS), "edge_types": list(tools.EDGE_TYPES), "repository": self.repo_info(graph_id)}

    # ---- views ---------------------------------------------------------------------

    def _payload(self, graph_id: str, nodes: DataFrame, edges: DataFrame, total: int | None = None, truncated: bool = False) -> dict:
        n, e = [r.asDict() for r in nodes.orderBy("id").collect()], [r.asDict() for r in edges.orderBy("src", "dst").collect()]
        return {"nodes": n, "edges": e, "stats": {"nodes": len(n), "edges": len(e), "total_edges": len(e) if total is None else total, "truncated": truncated}}

    def full_graph(self, graph_id: str, max_edges: int = 10_000) -> dict:
        """All files and the first edges; measures are taken before edges are cut, churn comes along."""
        t = self._tables(graph_id)
        nodes, edges = cluster.graph_of(t["files"], t["imports"])
        measured = views.annotated(nodes, edges, ("file",)).join(self._churn(graph_id, t), ["graph_id", "path"], "left")
        kept, few, stats = cluster.capped(measured, edges, max_edges)
        s = stats.first()
        return self._payload(graph_id, kept, few, s["total"] if s else 0, bool(s and s["truncated"]))

    def _churn(self, graph_id: str, t: dict[str, DataFrame]) -> DataFrame:
        from depweave.operators.history import churn

        return churn(self.history(graph_id), t["files"].where(~F.col("deleted")).select("graph_id", "path"))

    def overview(self, graph_id: str, depth: int = 1) -> dict:
        """The graph folded into directories; measures are taken of the folded graph."""
        t = self._tables(graph_id)
        nodes, edges = cluster.clustered(*cluster.graph_of(t["files"], t["imports"]), depth)
        return self._payload(graph_id, views.annotated(nodes, edges), edges)

    def expand(self, graph_id: str, prefix: str) -> dict:
        t = self._tables(graph_id)
        return self._payload(graph_id, *cluster.expanded(t["files"], t["imports"], prefix))

    def subgraph(self, graph_id: str, path: str, depth: int = 2, symbols: bool = False) -> dict:
        """The neighbourhood of a file; an unknown or deleted file is a graph of itself alone."""
        t, seed = self._tables(graph_id), self._seed(graph_id, path)
        edges = reach.neighbourhood_edges(tools.file_edges(t["imports"]), seed, tools.live_nodes(t["files"]), depth)
        ends = edges.select("graph_id", F.col("src").alias("path")).unionByName(edges.select("graph_id", F.col("dst").alias("path"))).unionByName(seed.withColumnRenamed("node", "path")).distinct()
        language = t["files"].where(~F.col("deleted")).select("graph_id", "path", "language")
        nodes = cluster.file_nodes(ends).join(language, ["graph_id", "path"], "left")
        edges = edges.select("graph_id", F.concat(F.lit("file:"), "src").alias("src"), F.concat(F.lit("file:"), "dst").alias("dst"))
        if symbols:
            own = t["imports"].where("dst_kind = 'symbol'").join(seed.withColumnRenamed("node", "src"), ["graph_id", "src"], "left_semi").select("graph_id", "src", "dst").distinct()
            nodes = nodes.unionByName(cluster.symbol_nodes(own.select("graph_id", F.col("dst").alias("name"))), allowMissingColumns=True)
            edges = edges.unionByName(own.select("graph_id", F.concat(F.lit("file:"), "src").alias("src"), F.concat(F.lit("sym:"), "dst").alias("dst")))
        return self._payload(graph_id, nodes, edges)

    def impact(self, graph_id: str, path: str, max_hops: int = 3) -> dict:
        """Rings of files by distance in either direction, and the names of callers and callees."""
        reach.check_hops(max_hops, 1)
        t, seed = self._tables(graph_id), self._seed(graph_id, path)
        both = tools.imported_by(t["files"], t["imports"], seed, max_hops).unionByName(tools.imports_of(t["files"], t["imports"], seed, max_hops))
        names = lambda df: sorted({r["node"] for r in df.select("node").collect()})
        rings = [{"hop": r["hop"], "paths": r["paths"]} for r in tools.impact_rings(both).orderBy("hop").collect()]
        return {"rings": rings, "total": sum(len(r["paths"]) for r in rings), "callers": names(tools.callers(t["files"], t["defines"], t["calls"], seed, max_hops)), "calls": names(tools.callees(t["files"], t["defines"], t["calls"], seed, max_hops))}

    def findings(self, graph_id: str) -> dict:
        """What is worth telling; lists that grow with the graph are cut to ``MOST`` rows (orphans to fewer)."""
        t = self._tables(graph_id)
        live = tools.live_nodes(t["files"])
        found = views.findings(live, tools.file_edges(t["imports"]), self.history(graph_id))
        order = {"hubs": ["rank"], "cycles": [F.desc("size"), "members"], "risk": ["rank"], "coupling": ["rank"], "entry_points": ["node"], "orphans": ["node"], "churn": ["path"]}
        out = {k: [r.asDict() for r in found[k].orderBy(*by).limit(views.MAX_ORPHANS if k == "orphans" else MOST).collect()] for k, by in order.items()}
        deepest, available = found["max_layer"].first(), found["coupling_available"].first()
        return out | {"layers": (deepest["max_layer"] + 1) if deepest else 0, "coupling_available": bool(available and available["coupling_available"])}

    def hidden_coupling(self, graph_id: str) -> list[dict]:
        """Pairs that change together although neither imports the other."""
        return [p for p in self.findings(graph_id)["coupling"] if not p["has_import_edge"]]

    def file_detail(self, graph_id: str, path: str) -> dict:
        """Metadata, source, functions in order of line, and neighbours of one file."""
        t, about = self._tables(graph_id), self.file_metadata(graph_id, path)
        own = t["functions"].where(F.col("path") == about["path"]).orderBy("start_line", "qualified_name")
        near = self.dependencies(graph_id, path, "both", 1)
        try:
            content = self.file_content(graph_id, path)["content"]
        except ValueError:
            content = None  # no working copy
        side = {k: sorted({x["node"] for x in near[k]}) for k in ("imported_by", "imports", "callers", "calls")}
        return {**about, "content": content, "functions": [r.asDict() for r in own.collect()], **side, "external_symbols": sorted({x["name"] for x in near["external_symbols"]})}


def render(title: str, rows: list[dict], fields: tuple[str, ...]) -> str:
    """A result as lines of text."""
    return "\n".join([f"{title} ({len(rows)})", *("  " + "  ".join(str(r.get(f, "")) for f in fields) for r in rows)])
