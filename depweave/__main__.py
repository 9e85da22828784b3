"""Command line: ingest, ls, findings, deps, reset."""

from __future__ import annotations

import argparse
import json
import shutil
from dataclasses import asdict

from depweave.functions.paths import sanitise_url, slug_of
from depweave.plans.workspace import Workspace
from depweave.session import local_session
from depweave.sources import clone, gitlog, tree
from depweave.store import Store


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="depweave")
    p.add_argument("--store", required=True, help="folder of the snapshots")
    p.add_argument("--repos", required=True, help="folder of the working copies")
    sub = p.add_subparsers(dest="command", required=True)
    one = sub.add_parser("ingest", help="clone or fetch, parse and publish")
    one.add_argument("url")
    one.add_argument("--branch")
    one.add_argument("--depth", type=int)
    one.add_argument("--force", action="store_true")
    one.add_argument("--token")
    one.add_argument("--token-host", default="")
    sub.add_parser("ls", help="list repositories")
    for name in ("findings", "reset"):
        one = sub.add_parser(name)
        one.add_argument("graph_id")
    one.add_argument("--keep-clone", action="store_true")
    one = sub.add_parser("deps", help="dependencies of a file")
    one.add_argument("graph_id")
    one.add_argument("path")
    one.add_argument("--direction", default="both")
    one.add_argument("--max-hops", type=int, default=3)
    return p


def main(arguments: list[str] | None = None) -> int:
    a = parser().parse_args(arguments)
    spark = local_session()
    store = Store(spark, a.store)
    work = Workspace(store, a.repos)
    out: object
    if a.command == "ingest":
        graph_id, root = slug_of(a.url), clone.local_path(a.url, a.repos)
        branch = clone.clone_or_fetch(a.url, root, a.branch, a.depth, a.force, a.token, a.token_host)
        log = gitlog.last_commits(gitlog.read_last_commit_log(spark, str(root), graph_id))
        did = store.ingest(graph_id, graph_id, sanitise_url(a.url), branch, tree.scan_clone(spark, root, graph_id), log)
        out = work.repo_info(graph_id) | {"ingest": asdict(did)}
    elif a.command == "ls":
        out = work.list_repos()
    elif a.command == "findings":
        out = work.findings(a.graph_id)
    elif a.command == "deps":
        out = work.dependencies(a.graph_id, a.path, a.direction, a.max_hops)
    else:
        store.wipe(a.graph_id)
        if not a.keep_clone:
            shutil.rmtree(clone.local_path(a.graph_id, a.repos), ignore_errors=True)
        out = {"removed": a.graph_id}
    print(json.dumps(out, default=str, indent=1))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
