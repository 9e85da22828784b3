import random
import subprocess

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from depweave import store
from depweave.functions import paths as P
from depweave.operators import cluster, history, reach, resolve, search, structure
from depweave.plans import layout, tools, views
from depweave.sources import gitlog, slices, tree

G = "g"


def edges_df(spark, pairs):
    return spark.createDataFrame([(G, a, b) for a, b in pairs], "graph_id string, src string, dst string")


def nodes_df(spark, names):
    return spark.createDataFrame([(G, n) for n in names], "graph_id string, node string")


def found(df):
    return {(r["node"], r["hop"]) for r in df.collect()}


# ---- reachability ------------------------------------------------------------------


def test_reach_least_hops_cycles_and_dead_ends(spark):
    e = edges_df(spark, [("a", "x"), ("a", "m"), ("m", "x"), ("x", "a"), ("s", "s"), ("x", "d"), ("d", "y")])
    live = nodes_df(spark, "axmsy")
    assert found(reach.reach(e, nodes_df(spark, "a"), 10, live)) == {("x", 1), ("m", 1), ("a", 2)}
    assert found(reach.reach(e, nodes_df(spark, "s"), 3, live)) == {("s", 1)}
    assert found(reach.reach(e, nodes_df(spark, "a"), 2)) == {("x", 1), ("m", 1), ("a", 2), ("d", 2)}
    assert found(reach.reach(e, nodes_df(spark, "a"), 0)) == set()
    for bad in (True, 11, -1, "3"):
        with pytest.raises(ValueError):
            reach.check_hops(bad)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 10**6))
def test_subgraph_is_the_union_of_bounded_paths(spark, seed):
    r = random.Random(seed)
    names = "abcdefg"
    pairs = sorted({(r.choice(names), r.choice(names)) for _ in range(12)})
    live = [n for n in names if r.random() < 0.85] or ["a"]
    start, depth = r.choice(names), r.randint(1, 3)

    def walks(es):
        out, stack = set(), [(start, ())]
        while stack:
            at, used = stack.pop()
            out.update(used)
            if len(used) < depth:
                stack += [(b, (*used, (a, b))) for a, b in es if a == at and (a, b) not in used and b in live]
        return out

    want = (walks(pairs) | {(a, b) for b, a in walks([(b, a) for a, b in pairs])}) if start in live else set()
    got = reach.neighbourhood_edges(edges_df(spark, pairs), nodes_df(spark, start), nodes_df(spark, live), depth)
    assert {(x["src"], x["dst"]) for x in got.collect()} == want


# ---- structure ---------------------------------------------------------------------


def plain_components(names, pairs):
    to = {n: {n} for n in names}
    while True:
        grown = {n: to[n].union(*(to[b] for a, b in pairs if a in to[n])) for n in names}
        if grown == to:
            return {n: min(m for m in names if m in to[n] and n in to[m]) for n in names}
        to = grown


@pytest.mark.parametrize("seed", range(6))
def test_components_and_layers_both_ways(spark, seed):
    r = random.Random(seed)
    names = [f"n{i:02d}" for i in range(14)]
    pairs = [(r.choice(names), r.choice(names)) for _ in range(20)]
    touched = sorted({x for p in pairs for x in p})
    comp = plain_components(touched, pairs)
    layer = dict.fromkeys(touched, 0)
    for _ in touched:
        for a, b in pairs:
            if comp[a] != comp[b]:
                deeper = layer[a] + 1
                for n in touched:
                    if comp[n] == comp[b]:
                        layer[n] = max(layer[n], deeper)
    want = {(n, comp[n], layer[n]) for n in touched}
    e = edges_df(spark, pairs)
    limits = (structure.LOCAL_EDGES, 0) if seed < 2 else (structure.LOCAL_EDGES,)
    for limit in limits:
        assert {(x["node"], x["component"], x["layer"]) for x in structure.condense(e, limit).collect()} == want


def test_roles(spark):
    e = edges_df(spark, [("a", "b"), ("a", "b"), ("b", "c"), ("c", "b"), ("l", "l"), ("a", "gone")])
    m = structure.metrics(nodes_df(spark, "abclo"), e).cache()
    got = {r["node"]: (r["layer"], r["fan_in"], r["fan_out"], r["in_cycle"]) for r in m.collect()}
    assert got == {"a": (0, 0, 2, False), "b": (1, 3, 1, True), "c": (1, 1, 1, True), "l": (0, 1, 1, False), "o": (0, 0, 0, False)}
    assert [(r["size"], r["members"]) for r in structure.cycles(m).collect()] == [(2, ["b", "c"])]
    assert [r["node"] for r in structure.entry_points(m).collect()] == ["a"]
    assert [r["node"] for r in structure.orphans(m).collect()] == ["o"]
    assert [r["node"] for r in structure.hubs(m, 2).orderBy("rank").collect()] == ["b", "c"]


# ---- resolution --------------------------------------------------------------------

KNOWN = ["src/auth.ts", "src/comp.tsx", "src/lib/index.js", "src/x.js", "pkg/a.py", "pkg/sub/__init__.py", "lib/src/deep/mod.py", "pkg/__init__.py", "app/src/main/java/com/foo/Bar.java", "app/src/main/kotlin/com/foo/Baz.kt"]
CASES = [
    ("./auth.js", "src/index.ts", "ts", "src/auth.ts"),
    ("./comp.jsx", "src/index.ts", "tsx", "src/comp.tsx"),
    ("./lib", "src/index.ts", "js", "src/lib/index.js"),
    ("../x", "src/lib/index.js", "js", "src/x.js"),
    ("react", "src/index.ts", "ts", None),
    ("..", "src/lib/deep/y.js", "js", "src/lib/index.js"),
    (".a", "pkg/b.py", "py", "pkg/a.py"),
    ("..a", "pkg/sub/c.py", "py", "pkg/a.py"),
    (".", "pkg/b.py", "py", "pkg/__init__.py"),
    ("pkg.sub", "x.py", "py", "pkg/sub/__init__.py"),
    ("deep.mod", "x.py", "py", "lib/src/deep/mod.py"),
    ("os", "x.py", "py", None),
    ("com.foo.Bar", "X.java", "java", "app/src/main/java/com/foo/Bar.java"),
    ("com.foo.Bar.member", "X.java", "java", "app/src/main/java/com/foo/Bar.java"),
    ("com.foo.Baz", "X.java", "java", "app/src/main/kotlin/com/foo/Baz.kt"),
    ("com.foo.*", "X.kt", "kotlin", None),
    ("com.foo.Bar", "X.kt", "kotlin", "app/src/main/java/com/foo/Bar.java"),
    ("pkg.a", "x.rb", "ruby", None),
]


def test_import_resolution(spark):
    rows = spark.createDataFrame([(G, src, lang, module) for module, src, lang, _ in CASES], "graph_id string, src string, language string, module string")
    known = spark.createDataFrame([(G, p) for p in KNOWN], "graph_id string, path string")
    got = {(r["module"], r["src"], r["language"]): r["path"] for r in resolve.resolve_imports(rows, known).collect()}
    assert got == {(m, s, lang): p for m, s, lang, p in CASES}


def test_call_binding_tiers(spark):
    f = [("a.py", "Order"), ("a.py", "Order.save"), ("a.py", "User.save"), ("b.py", "helper"), ("c.py", "helper"), ("c.py", "Out.Order.save")]
    functions = spark.createDataFrame([(G, f"{p}::{q}", p) for p, q in f], "graph_id string, qualified_name string, path string")
    c = [
        ("a.py", "a.py::Order.x", "save", "self", "Order", "a.py::Order.save"), ("a.py", "a.py::h", "save", "User", None, "a.py::User.save"), ("c.py", "c.py::h", "helper", None, None, "c.py::helper"),
        ("z.py", "z.py::h", "helper", None, None, "b.py::helper"), ("z.py", "z.py::h", "print", None, None, None), ("z.py", "z.py::h", "save", "self", "Nope", "a.py::Order.save"), ("b.py", "b.py::h", "save", "Unknown", None, "a.py::Order.save"),
    ]
    calls = spark.createDataFrame([(G, *x[:5]) for x in c], "graph_id string, path string, caller string, callee string, receiver string, caller_class string")
    got = {(r["path"], r["callee"], r["receiver"]): r["qualified_name"] for r in resolve.bind_calls(calls, functions).collect()}
    assert got == {(x[0], x[2], x[3]): x[5] for x in c}


def test_path_and_url_functions(spark):
    cases = {"a/../b/./c": "b/c", "../x": "../x", "a/b/../../..": "..", "": ".", "a\\b": "a/b"}
    df = spark.createDataFrame([(k,) for k in cases], "p string")
    assert {r["p"]: r["n"] for r in df.select("p", P.normalised(F.col("p")).alias("n")).collect()} == cases
    urls = {"https://h.com/a/b.git": "h.com/a/b", "git@h.com:a/b": "h.com/a/b", "https://me:tok@h.com/a": "h.com/a", "http://h.com/a": None}
    df = spark.createDataFrame([(k,) for k in urls], "u string")
    assert {r["u"]: r["s"] for r in df.select("u", P.repository_slug(F.col("u")).alias("s")).collect()} == urls
    assert P.with_token("https://gitlab.com/a/b", "T") == "https://oauth2:T@gitlab.com/a/b"
    assert P.with_token("https://h.com/a", "T", "other.com") == "https://h.com/a"
    assert P.with_token("git@h.com:a/b", "T") == "git@h.com:a/b"
    with pytest.raises(ValueError):
        P.slug_of("http://h.com/a")


@pytest.mark.parametrize(("lines", "path", "out"), [
    (["*.log"], "a/b.log", True), (["/b"], "a/b", False), (["/b"], "b/c.py", True), (["build/"], "x/build/y.py", True), (["build/"], "x/build", False), (["*.py", "!keep.py"], "a/keep.py", False),
    (["a/**/z.py"], "a/z.py", True), (["a/**/z.py"], "a/b/c/z.py", True), (["docs/**"], "docs/x/y.js", True), (["# c", ""], "a.py", False), (["te?t.[jt]s"], "q/test.ts", True), (["te?t.[!j]s"], "q/test.js", False),
])
def test_ignore_lines(spark, lines, path, out):
    assert spark.createDataFrame([(path,)], "path string").select(tree.ignored(F.col("path"), lines).alias("x")).first()["x"] is out


# ---- history -----------------------------------------------------------------------


def test_logs(spark):
    text = "abcdef1|An|2024\n\na.py\nb|c|d.py\n\nabcdef2|Bo|20|25\nb.py\na.py\n"
    df = spark.createDataFrame([(G, i, x) for i, x in enumerate(text.split("\n"))], "graph_id string, line_no int, line string")
    got = {(r["path"], r["sha"], r["author"], r["committed_at"]) for r in gitlog.last_commits(df).collect()}
    assert got == {("a.py", "abcdef1", "An", "2024"), ("b|c|d.py", "abcdef1", "An", "2024"), ("b.py", "abcdef2", "Bo", "20|25")}
    text = "stray\n\0s1\n\na\nb\n\0s2\n\0s3\nc"
    df = spark.createDataFrame([(G, i, x) for i, x in enumerate(text.split("\n"))], "graph_id string, line_no int, line string")
    assert {(r["commit_seq"], r["sha"], r["path"]) for r in gitlog.commit_files(df).collect()} == {(1, "s1", "a"), (1, "s1", "b"), (3, "s3", "c")}


def test_logs_are_read_alike_in_blocks_of_any_size(spark):
    r = random.Random(5)
    rows, commits, newest = [], set(), {}
    for g in ("h.com/a", "h.com/b"):
        at, number, sha = -700, 0, None
        for _ in range(300):
            at += r.choice((1, 1, 1, 2, 90))
            if r.random() < 0.1:
                number, sha = number + 1, f"{r.randrange(16**7):07x}"
                rows.append((g, at, f"\0{sha}", f"{sha}|An|d"))
                continue
            path = r.choice(("", "a.py", "b.py", f"lib/{r.randrange(40)}.py"))
            rows.append((g, at, path, path))
            if path and number:
                commits.add((g, number, sha, path))
                newest.setdefault((g, path), sha)
    df = spark.createDataFrame(rows, "graph_id string, line_no long, nul string, bars string")
    for block in (1, 7, 100, 65_536):
        got = gitlog.commit_files(df.select("graph_id", "line_no", F.col("nul").alias("line")), block).collect()
        assert {(x["graph_id"], x["commit_seq"], x["sha"], x["path"]) for x in got} == commits, block
        got = gitlog.last_commits(df.select("graph_id", "line_no", F.col("bars").alias("line")), block).collect()
        assert {(x["graph_id"], x["path"]): x["sha"] for x in got} == newest and len(got) == len(newest), block


def test_a_log_is_copied_in_chunks_and_no_repository_has_none(spark, tmp_path, monkeypatch):
    assert gitlog.read_history_log(spark, str(tmp_path / "nowhere"), G).count() == 0
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=An", "-c", "user.email=a@x", *a], check=True, capture_output=True)
    git("init", "-b", "main")
    assert gitlog.read_last_commit_log(spark, str(tmp_path), G).count() == 0  # no commit yet
    for k in range(3):
        (tmp_path / f"f{k}.py").write_text("x")
        git("add", "-A")
        git("commit", "-m", str(k))
    monkeypatch.setattr(gitlog, "CHUNK_LINES", 2)
    got = gitlog.commit_files(gitlog.read_history_log(spark, str(tmp_path), G)).select("commit_seq", "path").collect()
    assert {tuple(x) for x in got} == {(1, "f2.py"), (2, "f1.py"), (3, "f0.py")}
    got = gitlog.last_commits(gitlog.read_last_commit_log(spark, str(tmp_path), G)).collect()
    assert {(x["path"], x["author"]) for x in got} == {(f"f{k}.py", "An") for k in range(3)}


def test_coupling_and_churn(spark):
    commits = [["a", "b"], ["a", "b"], ["a", "b", "c"], ["c"], ["a", *[f"w{i}" for i in range(70)]], ["gone", "a"]]
    rows = [(G, i, p) for i, c in enumerate(commits) for p in c]
    files = spark.createDataFrame(rows, "graph_id string, commit_seq long, path string")
    live = spark.createDataFrame([(G, p) for p in ["a", "b", "c", "quiet", *[f"w{i}" for i in range(70)]]] + [("other", "x")], "graph_id string, path string")
    assert [(r["a"], r["b"], r["shared"], r["strength"]) for r in history.coupling(files, live).collect()] == [("a", "b", 3, 3 / 5)]
    churn = {(r["graph_id"], r["path"]): r["commits"] for r in history.churn(files, live).collect()}
    assert (churn[G, "a"], churn[G, "c"], churn[G, "quiet"], churn["other", "x"]) == (5, 2, 0, None)


# ---- slices, search, clusters, layout ------------------------------------------------


def test_slices(spark):
    texts = ["a\nb\r\nc\x0bd\u2028e\n", "", "one"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")

    def at(i, s, e, n=2000):
        r = slices.with_slices(df.where(F.col("i") == i), "t", F.lit(s).cast("int"), F.lit(e).cast("int"), n).first()
        return r["slice"], r["start_line"], r["end_line"], r["truncated"]

    assert at(0, None, None) == ("a\nb\nc\nd\ne", 1, 5, False)
    assert at(0, 2, 99) == ("b\nc\nd\ne", 2, 5, False)
    assert at(0, 2, 5, 2) == ("b\nc", 2, 3, True)
    assert at(1, None, None) == ("", 1, 0, False)
    assert at(2, 3, 1) == (None, None, None, None)
    with pytest.raises(ValueError):
        slices.contained_path("/r/x", "../y")


def test_search_pages_and_fallback(spark):
    files = spark.createDataFrame([(G, "auth/login.py", False), (G, "old/auth.py", True)], "graph_id string, path string, deleted boolean")
    functions = spark.createDataFrame([(G, f"auth/login.py::auth_{i}", f"auth_{i}", "method", "auth/login.py") for i in range(5)], "graph_id string, qualified_name string, name string, kind string, path string")
    first, nxt = search.search_nodes(files, functions, G, "auth", limit=4)
    second, end = search.search_nodes(files, functions, G, "auth", limit=4, offset=nxt)
    ids = [[r["id"] for r in x.collect()] for x in (first, second)]
    assert nxt == 4 and end is None and not set(ids[0]) & set(ids[1]) and len(ids[0] + ids[1]) == 6
    assert {r["kind"] for r in first.collect()} <= {"function", "file"}
    hits, _ = search.search_nodes(files, functions, G, "ogin", "function")
    assert {r["kind"] for r in hits.collect()} == {"method"}
    assert search.prefix_query("a+b c") == r"a\+b* c*" and search.prefix_query("  ") == "*"


def test_layout_reduces_crossings(spark):
    r = random.Random(5)
    names = [[f"r{k}n{i}" for i in range(10)] for k in range(6)]
    pairs = []
    for k in range(5):
        order = names[k + 1][:]
        r.shuffle(order)
        pairs += [(a, b) for a, b in zip(names[k], order, strict=True)] + [(r.choice(names[k]), r.choice(names[k + 1])) for _ in range(2)]
    nodes = spark.createDataFrame([(G, n, n, k) for k, row in enumerate(names) for n in row], "graph_id string, node string, path string, layer long")
    placed, e = views.rows_of(nodes), edges_df(spark, pairs)
    before = views.crossings(e, views.positions(placed)).first()["crossings"]
    after = views.crossings(e, views.positions(layout.ordered(placed, e))).first()["crossings"]
    assert after < before / 2


def test_layout_sweeps_large_graphs(spark):
    n = 10_500
    placed = [(G, f"{k}{i:05}", k, i) for k in range(2) for i in range(n)]
    placed = spark.createDataFrame(placed, "graph_id string, node string, row long, slot int")
    e = edges_df(spark, [(f"0{i:05}", f"1{n - 1 - i:05}") for i in range(n)])
    slots = {r["node"]: r["slot"] for r in layout.ordered(placed, e).collect()}
    assert len(slots) == 2 * n and all(slots[f"0{i:05}"] == slots[f"1{n - 1 - i:05}"] for i in range(n))


def test_clusters(spark):
    paths = ["a/b/1", "a/b/2", "a/3", "4"]
    files = spark.createDataFrame([(G, p, False) for p in paths] + [(G, "a/dead", True)], "graph_id string, path string, deleted boolean")
    imports = spark.createDataFrame([(G, "a/b/1", "file", "4"), (G, "a/b/2", "file", "4"), (G, "a/b/1", "file", "a/3"), (G, "4", "symbol", "os"), (G, "a/dead", "symbol", "sys"), (G, "4", "file", "a/dead")], "graph_id string, src string, dst_kind string, dst string")
    n, e = cluster.clustered(*cluster.graph_of(files, imports), 1)
    assert {(r["id"], r["kind"], r["file_count"]) for r in n.collect()} == {("dir:a", "dir_cluster", 3), ("file:4", "file", 1), ("sym:os", "symbol", None)}
    assert {(r["src"], r["dst"], r["weight"]) for r in e.collect()} == {("dir:a", "file:4", 2), ("file:4", "sym:os", 1)}
    n, e = cluster.expanded(files, imports, "a")
    assert {r["id"] for r in n.collect()} == {"dir:a/b", "file:a/3"} and [(r["src"], r["dst"]) for r in e.collect()] == [("dir:a/b", "file:a/3")]


# ---- from sources to answers ---------------------------------------------------------


def test_ingest_and_ask(spark, tmp_path):
    root = tmp_path / "repo"
    for name, text in {"main.py": "from auth import check\n\ndef main():\n    check()\n    print()\n", "auth.py": "def check():\n    pass\n", "skip.py": "x = 1\n", "build/z.py": "y = 1\n", "notes.txt": "n", "pkg/__init__.py": "from .x import y\n", "pkg/x.py": "y = 1\n"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    (root / ".gitignore").write_text("skip.py\n")
    kept = store.Store(spark, str(tmp_path / "store"))
    log = spark.createDataFrame([(G, "auth.py", "s1", "An", "2024")], "graph_id string, path string, sha string, author string, committed_at string")
    kept.ingest(G, "g", "https://h/g", "main", tree.scan_clone(spark, root, G), log)
    t = kept.tables()
    assert {(r["path"], r["last_author"]) for r in t["files"].collect()} == {("main.py", None), ("auth.py", "An"), ("pkg/__init__.py", None), ("pkg/x.py", None)}
    assert [r["src"] for r in t["imports"].where("dst = 'pkg/x.py'").collect()] == ["pkg/__init__.py"]
    got = tools.file_dependencies(t, G, "auth.py")
    assert [(x["node"], x["hop"]) for x in got["imported_by"]] == [("main.py", 1)] and [x["node"] for x in got["callers"]] == ["main.py::main"]
    assert {(r["name"], r["kind"]) for r in t["symbols"].collect()} == {("print", "call")}
    assert tools.file_dependencies(t, G, "main.py", max_hops=0)["external_symbols"] == [{"graph_id": G, "name": "print", "kind": "call", "via": "main.py::main"}]

    (root / "main.py").unlink()
    kept.ingest(G, "g", "https://h/g", "main", tree.scan_clone(spark, root, G), log.limit(0))
    t = kept.tables()
    assert {(r["path"], r["deleted"], r["last_author"]) for r in t["files"].collect()} == {("main.py", True, None), ("auth.py", False, "An"), ("pkg/__init__.py", False, None), ("pkg/x.py", False, None)}
    assert tools.file_dependencies(t, G, "auth.py")["imported_by"] == []
    assert {r["id"] for r in tools.nodes(t).where("kind = 'function'").collect()} == {"auth.py::check"}
    assert slices.read_source(root, "auth.py", 1, 1) == ("def check():", 1, 1, False)
    assert {r["path"] for r in tree.scan(spark, str(root), G, ["skip.py"]).collect()} == {"auth.py", "pkg/x.py"}  # hidden names stay hidden to Spark
    kept.wipe(G)
    assert all(df.isEmpty() for df in kept.tables().values())
