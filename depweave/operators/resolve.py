"""Import resolution and call binding as joins on keys.

Every import yields a short list of candidate files in order of preference; the
candidates are joined with the known paths (or with the suffixes of known paths,
reduced to the least path for each), and the best match wins.  Nothing is matched
by scanning names, so the work grows with the rows, not with their product.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depweave.functions import paths as P

_ENTRY = "array<struct<rank:int,kind:string,key:string>>"


def _candidates(*items: tuple[str, Column]) -> Column:
    return F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(kind).alias("kind"), key.alias("key")) for i, (kind, key) in enumerate(items)])


def _python(module: Column, src: Column) -> Column:
    dots = F.length(F.regexp_extract(module, r"^(\.*)", 1))
    rest = F.regexp_replace(module, r"^\.+", "")
    parts = F.split(src, "/")
    up = F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - F.greatest(dots, F.lit(1)), F.lit(0))), "/")
    base = F.when(rest == "", up).otherwise(P.joined(up, F.replace(rest, F.lit("."), F.lit("/"))))
    path = F.replace(module, F.lit("."), F.lit("/"))
    relative = _candidates(("path", F.concat(base, F.lit(".py"))), ("path", F.concat(base, F.lit("/__init__.py"))))
    absolute = _candidates(
        ("path", F.concat(path, F.lit(".py"))), ("path", F.concat(path, F.lit("/__init__.py"))),
        ("suffix", F.concat(F.lit("/"), path, F.lit(".py"))), ("suffix", F.concat(F.lit("/"), path, F.lit("/__init__.py"))),
    )
    return F.when(F.startswith(module, F.lit(".")), relative).otherwise(absolute)


def _jvm(module: Column, endings: tuple[str, str]) -> Column:
    """The named file, own language first, then the file of the enclosing name (a static or member import)."""
    whole = F.replace(module, F.lit("."), F.lit("/"))
    parent = F.regexp_replace(whole, r"/[^/]*$", "")
    items = []
    for base in (whole, F.when(F.contains(whole, F.lit("/")), parent)):
        for e in endings:
            items += [("path", F.concat(base, F.lit(e))), ("suffix", F.concat(F.lit("/"), base, F.lit(e)))]
    return F.when(~F.endswith(module, F.lit(".*")), _candidates(*items))


def _js(module: Column, src: Column) -> Column:
    base = P.joined(P.dirname(src), module)
    stem = lambda n: F.regexp_replace(base, rf"\.{n}$", "")
    is_js, is_jsx = F.endswith(base, F.lit(".js")), F.endswith(base, F.lit(".jsx"))
    items = [base, F.when(is_js, F.concat(stem("js"), F.lit(".ts"))), F.when(is_js, F.concat(stem("js"), F.lit(".tsx"))), F.when(is_jsx, F.concat(stem("jsx"), F.lit(".tsx")))]
    items += [F.concat(base, F.lit(tail + e)) for tail in ("", "/index") for e in (".js", ".ts", ".tsx", ".jsx")]
    return F.when(F.startswith(module, F.lit(".")), _candidates(*[("path", x) for x in items]))


def candidates(module: Column, src: Column, language: Column) -> Column:
    """The candidates of one import; null for an unknown language or a specifier that cannot name a file."""
    return (
        F.when((module == "") | module.isNull(), F.lit(None).cast(_ENTRY))
        .when(language == "py", _python(module, src).cast(_ENTRY))
        .when(language.isin("js", "ts", "tsx"), _js(module, src).cast(_ENTRY))
        .when(language == "java", _jvm(module, (".java", ".kt")).cast(_ENTRY))
        .when(language == "kotlin", _jvm(module, (".kt", ".java")).cast(_ENTRY))
    )


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(graph_id, src, module) with language -> adds path, null where unresolved, and n: how often it occurs; distinct.

    ``files`` (graph_id, path) are the known paths.  Of several files with the same
    suffix the lexicographically least is taken.
    """
    wanted = imports.groupBy("graph_id", "src", "language", "module").agg(F.count("*").alias("n"))
    tried = wanted.select("graph_id", "src", "language", "module", F.inline(candidates(F.col("module"), F.col("src"), F.col("language")))).where(F.col("key").isNotNull())
    known = files.select("graph_id", "path").distinct()
    whole = known.select("graph_id", F.lit("path").alias("kind"), F.col("path").alias("key"), "path")
    ends = known.select("graph_id", F.lit("suffix").alias("kind"), F.explode(P.suffixes(F.col("path"))).alias("key"), "path").groupBy("graph_id", "kind", "key").agg(F.min("path").alias("path"))
    best = tried.join(whole.unionByName(ends), ["graph_id", "kind", "key"]).groupBy("graph_id", "src", "language", "module").agg(F.min_by("path", "rank").alias("path"))
    return wanted.join(best, ["graph_id", "src", "language", "module"], "left")


def import_edges(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Edges (graph_id, src, dst_kind, dst): resolved imports go to files, all others to symbols."""
    return edges_of(resolve_imports(imports, files))


def edges_of(resolved: DataFrame) -> DataFrame:
    return resolved.select("graph_id", "src", F.when(F.col("path").isNotNull(), "file").otherwise("symbol").alias("dst_kind"), F.coalesce("path", "module").alias("dst")).distinct()


def bind_calls(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """Calls (graph_id, path, caller, callee, receiver, caller_class) -> adds qualified_name and tier, null where unbound, and n: how often it occurs.

    Tiers: 1 a method of the enclosing class through self; 2 the receiver's class;
    3 the same file; 4 the lexicographically first of the repository.  Calls are
    dealt by file and name, where tiers 1 and 3 are looked up, and once more by name;
    functions are reduced to one per name, and what a hot name weighs is on the side
    of the calls, which a skewed join may split.
    """
    named = _named(functions)
    here = named.groupBy("graph_id", "path", "callee").agg(F.collect_list(F.struct("qualified_name", "part")).alias("here"))  # of one name in one file
    c = calls.where("callee <> ''").repartition("graph_id", "path", "callee").groupBy(*_CALL).agg(F.count("*").alias("n"))
    own = F.concat("caller_class", F.lit("."), "callee")
    through_self = F.filter("here", lambda f: (F.col("receiver") == "self") & F.startswith(f["part"], own))
    first = lambda fs: F.array_min(F.transform(fs, lambda f: f["qualified_name"]))
    near = c.join(here, ["graph_id", "path", "callee"], "left").select(*_CALL, "n", first(through_self).alias("t1"), first(F.col("here")).alias("t3"), _of_class().alias("of_class"))
    by_part, by_name = _by_part(named), _by_name(named)
    received = near.where("of_class is not null").join(by_part, ["graph_id", "of_class"], "left").drop("of_class")
    others = near.where("of_class is null").drop("of_class").withColumn("t2", _none())
    return _tiers(received.unionByName(others).join(by_name, ["graph_id", "callee"], "left"))


_CALL = ("graph_id", "path", "caller", "callee", "receiver", "caller_class")


def _of_class() -> Column:
    return F.when(F.col("receiver") != "self", F.concat("receiver", F.lit("."), "callee"))


def _none() -> Column:
    return F.lit(None).cast("string")


def _named(functions: DataFrame) -> DataFrame:
    part = F.substring_index("qualified_name", "::", -1)
    return functions.select("graph_id", "qualified_name", "path", part.alias("part"), F.substring_index(part, ".", -1).alias("callee"))


def _by_part(named: DataFrame) -> DataFrame:
    return named.groupBy("graph_id", F.col("part").alias("of_class")).agg(F.min("qualified_name").alias("t2"))


def _by_name(named: DataFrame) -> DataFrame:
    return named.groupBy("graph_id", "callee").agg(F.min("qualified_name").alias("t4"))


def _tiers(found: DataFrame, *more: str) -> DataFrame:
    tier = F.when(F.col("t1").isNotNull(), 1).when(F.col("t2").isNotNull(), 2).when(F.col("t3").isNotNull(), 3).when(F.col("t4").isNotNull(), 4)
    return found.select(*_CALL, F.coalesce("t1", "t2", "t3", "t4").alias("qualified_name"), tier.alias("tier"), "n", *more)


def bind_read(parsed: DataFrame) -> DataFrame:
    """:func:`bind_calls` for files (graph_id, path, names: qualified ones, calls) read with ``near`` calls, each path once; adds inside: whether the caller is a function.

    Tiers 1 and 3 are known, so only calls that a receiver's class or another file may
    bind are dealt, each by the name that it is looked up by.
    """
    named = _named(parsed.select("graph_id", "path", F.explode("names").alias("qualified_name")))
    c = parsed.select("graph_id", "path", F.explode("calls").alias("c")).select("graph_id", "path", "c.*").where("callee <> ''").withColumn("n", F.col("n").cast("long")).withColumn("of_class", _of_class())
    of_file = F.col("t1").isNotNull() | F.col("t3").isNotNull()
    of_class = F.col("of_class").isNotNull()
    by_part = _by_part(named)
    done = c.where(of_file & ~of_class).drop("of_class").withColumns({"t2": _none(), "t4": _none()})
    received = c.where(of_file & of_class).join(by_part, ["graph_id", "of_class"], "left").drop("of_class").withColumn("t4", _none())
    far = c.where(~of_file & of_class).join(by_part, ["graph_id", "of_class"], "left").drop("of_class")
    far = far.unionByName(c.where(~of_file & ~of_class).drop("of_class").withColumn("t2", _none()))
    return _tiers(done.unionByName(received).unionByName(far.join(_by_name(named), ["graph_id", "callee"], "left")), "inside")


def call_edges(bound: DataFrame, functions: DataFrame | None = None) -> DataFrame:
    """Edges (graph_id, caller, dst_kind, dst) of callers that are functions, by :func:`bind_read` if these aren't given; unbound calls go to symbols."""
    ends = ["graph_id", "caller", F.when(F.col("qualified_name").isNotNull(), "function").otherwise("symbol").alias("dst_kind"), F.coalesce("qualified_name", "callee").alias("dst")]
    if functions is None:
        return bound.where("inside").select(*ends).distinct()
    known = functions.select("graph_id", F.col("qualified_name").alias("caller")).distinct()
    return bound.select(*ends).join(known, ["graph_id", "caller"], "left_semi").select("graph_id", "caller", "dst_kind", "dst").distinct()


def symbols(imports: DataFrame, bound: DataFrame) -> DataFrame:
    """(graph_id, name, kind) of external names; a name both imported and called is a call.

    Calls without a function around them leave a symbol but no edge.
    """
    a = imports.where("dst_kind = 'symbol'").select("graph_id", F.col("dst").alias("name"), F.lit("import").alias("kind"))
    b = bound.where("qualified_name is null").select("graph_id", F.col("callee").alias("name"), F.lit("call").alias("kind"))
    return a.unionByName(b).groupBy("graph_id", "name").agg(F.min("kind").alias("kind"))
