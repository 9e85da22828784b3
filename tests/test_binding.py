"""Calls bound in one lookup, against a plain version, with one name in half of all calls."""

import random

from depweave.operators import resolve


def plain(call, functions):
    graph, path, _, callee, receiver, cls = call
    own = sorted((q, p, q.split("::")[-1]) for g, q, p in functions if g == graph)
    tiers = [
        [q for q, p, part in own if receiver == "self" and cls is not None and p == path and part.split(".")[-1] == callee and part.startswith(f"{cls}.{callee}")],
        [q for q, _, part in own if receiver not in (None, "self") and part == f"{receiver}.{callee}"],
        [q for q, p, part in own if p == path and part.split(".")[-1] == callee],
        [q for q, _, part in own if part.split(".")[-1] == callee],
    ]
    return next(((qs[0], t) for t, qs in enumerate(tiers, 1) if qs), (None, None))


def test_every_tier_and_a_hot_name(spark):
    r = random.Random(5)
    names, classes, paths = ["run", "go", "hot", "x"], ["A", "B", "A.run"], ["a.py", "b.py", "c.py"]
    functions = sorted({(g, f"{p}::{'' if k is None else k + '.'}{n}", p) for g in "gh" for p in paths for n in names for k in (None, *classes) if r.random() < 0.4})
    calls = [(r.choice("gh"), r.choice(paths), f"f{r.randint(0, 9)}", "hot" if r.random() < 0.5 else r.choice([*names, "none", ""]), r.choice([None, "self", "A", "B", ""]), r.choice([None, *classes])) for _ in range(600)]
    f = spark.createDataFrame(functions, "graph_id string, qualified_name string, path string")
    c = spark.createDataFrame(calls, "graph_id string, path string, caller string, callee string, receiver string, caller_class string").repartition(4)
    got = {tuple(x)[:6]: (x["qualified_name"], x["tier"], x["n"]) for x in resolve.bind_calls(c, f).collect()}
    want = {x: (*plain(x, functions), calls.count(x)) for x in set(calls) if x[3]}
    assert got == want and {t for _, t, _ in want.values()} == {None, 1, 2, 3, 4}


def test_calls_are_dealt_twice_and_never_listed_once_for_each_tier(spark):
    calls = spark.createDataFrame([("g", "a.py", "a.py::f", "go", "self", "C"), ("g", "a.py", "a.py::f", "go", "D", None), ("g", "a.py", "a.py::f", "go", None, None), ("g", "b.py", "b.py::h", "go", None, None), ("g", "b.py", "b.py::h", "no", "E", None)], "graph_id string, path string, caller string, callee string, receiver string, caller_class string")
    functions = spark.createDataFrame([("g", q, q.split("::")[0]) for q in ("a.py::go", "a.py::C.go", "0.py::go", "z.py::D.go")], "graph_id string, qualified_name string, path string")
    bound = resolve.bind_calls(calls.unionByName(calls.limit(1)), functions)
    got = {(r["path"], r["callee"], r["receiver"]): (r["qualified_name"], r["tier"], r["n"]) for r in bound.collect()}
    assert got == {("a.py", "go", "self"): ("a.py::C.go", 1, 2), ("a.py", "go", "D"): ("z.py::D.go", 2, 1), ("a.py", "go", None): ("a.py::C.go", 3, 1), ("b.py", "go", None): ("0.py::go", 4, 1), ("b.py", "no", "E"): (None, None, 1)}
    plan = bound._jdf.queryExecution().optimizedPlan().toString()
    assert "inline(" not in plan


def test_calls_are_bound_in_their_own_file_as_they_are_read(spark):
    """The same as by joins, for calls that come twice, through self, a class, the file, another file and nothing; few of them are dealt."""
    from depweave import extract

    texts = {
        "a.py": "class A:\n    def run(self, b: B):\n        self.run()\n        self.stop()\n        b.go()\n        b.go()\n        b.none()\n        help()\n        far()\n    def stop(self):\n        nothing()\n\ndef help():\n    help()\n    x = A()\n    x.run()\n",
        "b.py": "class B:\n    def go(self):\n        self.far()\n        go()\n    class C:\n        def go(self):\n            self.go()\n\ndef far():\n    def go():\n        pass\n    (lambda: 1)()\n",
        "c.py": "help()\nfar()\nfar()\nself.help()\n",
        "d.py": "def broken(:",
    }
    sources = spark.createDataFrame([(g, p, "py", t.encode()) for g in "gh" for p, t in texts.items() if (g, p) != ("h", "b.py")], "graph_id string, path string, language string, content binary")
    plain_, near = extract.extracted(sources), extract.extracted(sources, near=True)
    rows = lambda df: sorted((tuple(x) for x in df.collect()), key=str)
    want = rows(resolve.bind_calls(extract.calls_of(plain_), extract.functions_of(plain_)))
    bound = resolve.bind_read(near.selectExpr("graph_id", "path", "functions.qualified_name as names", "calls"))
    assert rows(bound.drop("inside")) == want and {x[7] for x in want} == {None, 1, 2, 3, 4}
    assert rows(resolve.call_edges(bound)) == rows(resolve.call_edges(resolve.bind_calls(extract.calls_of(plain_), extract.functions_of(plain_)), extract.functions_of(plain_)))
    assert rows(extract.functions_of(near)) == rows(extract.functions_of(plain_))
    plan = bound._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan
