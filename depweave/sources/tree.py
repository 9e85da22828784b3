"""Scans of source trees: which files there are, in what language, and what is in them."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from depweave.functions import paths as P
from depweave.session import shared_dir


def ignore_regex(pattern: str) -> tuple[str, bool] | None:
    """(regular expression for relative paths, whether the line re-includes) of one ignore line; None for blanks and comments."""
    line = pattern.rstrip("\n").rstrip("\r")
    if not line.endswith("\\ "):
        line = line.rstrip(" ")
    if not line or line.startswith("#"):
        return None
    negated = line.startswith("!")
    line = line[1:] if negated else line.removeprefix("\\")
    only_dirs = line.endswith("/")
    line = line.rstrip("/")
    if not line:
        return None
    anchored = "/" in line
    line = line.lstrip("/")
    out, i = "", 0
    while i < len(line):
        if line.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif line.startswith("/**", i) and i + 3 == len(line):
            out, i = out + "/.*", i + 3
        elif line[i] == "*":
            while i < len(line) and line[i] == "*":
                i += 1
            out += "[^/]*"
        elif line[i] == "?":
            out, i = out + "[^/]", i + 1
        elif line[i] == "[" and (end := line.find("]", i + 2)) > 0:
            inner = line[i + 1 : end].replace("\\", "\\\\")
            out, i = out + "[" + ("^" + inner[1:] if inner[0] in "!^" else inner) + "]", end + 1
        elif line[i] == "\\" and i + 1 < len(line):
            out, i = out + re.escape(line[i + 1]), i + 2
        else:
            out, i = out + re.escape(line[i]), i + 1
    return ("^" if anchored else "^(?:.*/)?") + out + ("/.*$" if only_dirs else "(?:/.*)?$"), negated


def ignored(path: Column, lines: list[str]) -> Column:
    """Whether the ignore lines exclude a relative path: the last line that matches decides."""
    out = F.lit(False)
    for line in lines:
        if rule := ignore_regex(line):
            out = F.when(path.rlike(rule[0]), F.lit(not rule[1])).otherwise(out)
    return out


def scan(spark: SparkSession, root: str, graph_id: str, ignore_lines: list[str] | None = None) -> DataFrame:
    """(graph_id, path, language, content) of the source files of a tree in a store that executors read.

    Directories that never count and files of unknown extensions are left out by
    conditions on the path.  Spark's file sources hide names that begin with ``_`` or
    ``.``; for working copies, where such files count, use :func:`scan_clone`.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    bare = F.regexp_replace(F.col("path"), "^file:/*", "/")
    base = re.sub("^file:/*", "/", root.rstrip("/"))
    rows = files.select(F.substring(bare, len(base) + 2, 1_000_000).alias("path"), "content")
    rows = rows.withColumn("language", P.language_of(F.col("path"))).where(F.col("language").isNotNull() & ~P.in_skipped_directory(F.col("path")))
    if ignore_lines:
        rows = rows.where(~ignored(F.col("path"), ignore_lines))
    return rows.select(F.lit(graph_id).alias("graph_id"), "path", "language", "content")


def is_ignored(path: str, rules: list[tuple[str, bool]]) -> bool:
    out = False
    for pattern, negated in rules:
        if re.match(pattern, path):
            out = not negated
    return out


def walk(root: str | Path) -> Iterator[tuple[str, str]]:
    """(relative path, language) of the source files of a working copy; its own ignore file at the root counts."""
    root = Path(root)
    lines = (root / ".gitignore").read_text("utf-8", "replace").splitlines() if (root / ".gitignore").is_file() else []
    rules = [r for r in map(ignore_regex, lines) if r]
    for folder, inner, names in os.walk(root):
        inner[:] = sorted(d for d in inner if d not in P.SKIPPED_DIRECTORIES)
        for name in sorted(names):
            path = (Path(folder) / name).relative_to(root).as_posix()
            language = P.EXTENSION_LANGUAGE.get(Path(name).suffix.lower())
            if language and not is_ignored(path, rules):
                yield path, language


def scan_clone(spark: SparkSession, root: str | Path, graph_id: str, chunk_bytes: int = 64_000_000) -> DataFrame:
    """(graph_id, path, language, content) of a working copy on the driver.

    Executors do not see the driver's folders, so the sources are copied into a
    Parquet table in the shared folder, ``chunk_bytes`` at a time.
    """
    table = f"{shared_dir(spark)}/tables/sources-{uuid.uuid4().hex}"
    schema = pa.schema([("graph_id", pa.string()), ("path", pa.string()), ("language", pa.string()), ("content", pa.binary())])
    rows: list[dict] = []
    size = 0

    def put() -> None:
        spark.createDataFrame(pa.Table.from_pylist(rows, schema)).write.mode("append").parquet(table)
        rows.clear()

    for path, language in walk(root):
        content = (Path(root) / path).read_bytes()
        rows.append({"graph_id": graph_id, "path": path, "language": language, "content": content})
        size += len(content)
        if size >= chunk_bytes:
            put()
            size = 0
    put()
    return spark.read.parquet(table)
