import subprocess

import pytest

from depweave.plans.workspace import Workspace, render
from depweave.sources import clone, gitlog, tree
from depweave.store import Store

G = "h.com/a"


@pytest.fixture(scope="module")
def work(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("work")
    upstream = base / "upstream"
    upstream.mkdir()

    def git(*args, cwd=upstream):
        subprocess.run(["git", "-c", "user.name=An", "-c", "user.email=a@x", *args], cwd=cwd, check=True, capture_output=True)

    git("init", "-b", "main")
    (upstream / "lib").mkdir()
    for k in range(4):
        (upstream / "lib" / "auth.py").write_text(f"import os\n\n\ndef check():\n    return os.getpid() + {k}\n")
        (upstream / "main.py").write_text(f"from lib.auth import check\n\n\ndef main():\n    check()\n    print({k})\n")
        (upstream / "lone.py").write_text("x = 1\n")
        git("add", "-A")
        git("commit", "-m", f"c{k}")
    root = clone.local_path(G, base / "repos")
    assert clone.clone_or_fetch(str(upstream), root) == "main"
    assert clone.clone_or_fetch(str(upstream), root) == "main"
    store = Store(spark, str(base / "store"))
    log = gitlog.last_commits(gitlog.read_last_commit_log(spark, str(root), G))
    store.ingest(G, "a", "https://h.com/a", "main", tree.scan_clone(spark, root, G), log)
    return Workspace(store, base / "repos")


def test_tools(work):
    assert [r["graph_id"] for r in work.list_repos()] == [G]
    work.store.mark(["h.com/new"])
    assert [(r["graph_id"], r["ingest_status"]) for r in work.list_repos()] == [(G, "complete"), ("h.com/new", "running")]
    info = work.schema(G)["repository"]
    assert (info["files"], info["functions"], info["ingest_status"]) == (3, 2, "complete")
    assert [(e["name"], e["type"]) for e in work.structure(G)["entries"]] == [("lib", "dir"), ("lone.py", "file"), ("main.py", "file")]
    assert work.search(G, "che")["hits"][0]["id"] == "lib/auth.py::check"
    assert work.file_metadata(G, "./main.py")["last_author"] == "An"
    assert work.file_content(G, "main.py", 4, 4)["content"] == "def main():"
    assert work.function_source(G, "lib/auth.py::check")["source"].startswith("def check():\n")
    assert "main.py" in render("imported by", work.dependencies(G, "lib/auth.py")["imported_by"], ("node", "hop"))
    for wrong, error in ((lambda: work.node(G, "nope"), LookupError), (lambda: work.repo_info("x"), LookupError), (lambda: work.function_source(G, "main.py"), ValueError), (lambda: work.repo_info("a b"), ValueError), (lambda: work.structure(G, limit=0), ValueError)):
        with pytest.raises(error):
            wrong()


def test_views(work):
    full = work.full_graph(G)
    by = {n["id"]: n for n in full["nodes"]}
    assert set(by) == {"file:lib/auth.py", "file:main.py", "file:lone.py", "sym:os"}
    assert (by["file:lib/auth.py"]["layer"], by["file:lib/auth.py"]["fan_in"], by["file:lib/auth.py"]["commits"], by["file:lone.py"]["commits"]) == (1, 1, 4, 1)
    assert by["sym:os"]["layer"] is None and full["stats"]["truncated"] is False
    assert work.full_graph(G, 1)["stats"]["truncated"] is True
    assert {n["id"] for n in work.overview(G)["nodes"]} == {"dir:lib", "file:main.py", "file:lone.py", "sym:os"}
    assert {n["id"] for n in work.expand(G, "lib")["nodes"]} == {"file:lib/auth.py"}
    assert {(e["src"], e["dst"]) for e in work.subgraph(G, "lib/auth.py", symbols=True)["edges"]} == {("file:main.py", "file:lib/auth.py"), ("file:lib/auth.py", "sym:os")}
    assert [n["id"] for n in work.subgraph(G, "unknown.py")["nodes"]] == ["file:unknown.py"]
    assert work.impact(G, "lib/auth.py") == {"rings": [{"hop": 1, "paths": ["main.py"]}], "total": 1, "callers": ["main.py::main"], "calls": []}
    detail = work.file_detail(G, "lib/auth.py")
    assert (detail["imported_by"], detail["callers"], detail["external_symbols"], [f["name"] for f in detail["functions"]]) == (["main.py"], ["main.py::main"], ["getpid", "os"], ["check"])


def test_findings(work):
    f = work.findings(G)
    assert [h["node"] for h in f["hubs"]] == ["lib/auth.py"] and [x["node"] for x in f["orphans"]] == ["lone.py"] and [x["node"] for x in f["entry_points"]] == ["main.py"]
    assert f["layers"] == 2 and f["coupling_available"] and [(r["path"], r["score"]) for r in f["risk"]] == [("lib/auth.py", 4)]
    assert [(c["a"], c["b"], c["shared"], c["strength"], c["has_import_edge"]) for c in f["coupling"]] == [("lib/auth.py", "main.py", 4, 1.0, True)]
    assert work.hidden_coupling(G) == []
