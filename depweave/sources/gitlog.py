"""Commit histories from the text of git logs.

Logs come as rows (graph_id, line_no, line), every line number once in a repository.  A
header applies to the lines after it.  That running value is taken in two levels, inside
blocks of line numbers and over the blocks of a repository, so the log of a large
repository is spread over many tasks.  Where line numbers have gaps, a block is wider by
as much, so that blocks stay few.
"""

from __future__ import annotations

import io
import subprocess
import threading
import uuid
from itertools import batched

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from depweave.session import materialise, shared_dir

#: A commit id, author and date, divided by bars; the date may hold bars, a path that looks so cannot be told apart.
_HEADER = r"^([0-9a-f]{7,40})\|([^|]*)\|(.*)$"
HISTORY_LIMIT = 5000
TIMEOUT_SECONDS = 120
#: Lines in a block, about.
BLOCK = 65_536
#: Lines of a log that the driver holds at once.
CHUNK_LINES = 500_000


def _stripped(column: str = "line"):
    return F.regexp_replace(column, r"^\s+|\s+$", "")


def in_blocks(lines: DataFrame, block: int = BLOCK) -> DataFrame:
    """The lines with ``block``: runs of line numbers of one width, of a repository's n lines at most n / block + 1 runs."""
    spans = lines.groupBy("graph_id").agg(F.count("*").alias("n"), F.min("line_no").alias("lo"), F.max("line_no").alias("hi"))
    width = F.expr(f"(hi - lo) div greatest(1L, ceil(n / {block})) + 1")
    return lines.join(spans.select("graph_id", "lo", width.alias("width")), "graph_id").select(*lines.columns, F.expr("(line_no - lo) div width").alias("block"))


def under_headers(lines: DataFrame, header: Column, block: int = BLOCK) -> DataFrame:
    """The lines with ``header``, the last header up to each line, and ``commit_seq``, the number of headers up to it.

    ``header`` is null on lines that are none.
    """
    at = in_blocks(materialise(lines.select("*", header.alias("own")), "log-lines"), block)
    inside = Window.partitionBy("graph_id", "block").orderBy("line_no")
    seen = at.withColumns({"inner": F.last("own", ignorenulls=True).over(inside), "n": F.count("own").over(inside)})
    last = F.max(F.when(F.col("own").isNotNull(), F.struct("line_no", "own")))["own"]
    blocks = at.groupBy("graph_id", "block").agg(last.alias("last"), F.count("own").alias("held"))
    before = Window.partitionBy("graph_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select("graph_id", "block", F.last("last", ignorenulls=True).over(before).alias("outer"), F.coalesce(F.sum("held").over(before), F.lit(0)).alias("passed"))
    both = seen.join(carried, ["graph_id", "block"])
    return both.select(*lines.columns, F.coalesce("inner", "outer").alias("header"), (F.col("passed") + F.col("n")).alias("commit_seq"))


def last_commits(log: DataFrame, block: int = BLOCK) -> DataFrame:
    """(graph_id, path, sha, author, committed_at): the first commit in the log that names each path."""
    lines = log.select("graph_id", "line_no", _stripped().alias("line")).where(F.col("line") != "")
    is_header = F.col("line").rlike(_HEADER)
    named = under_headers(lines, F.when(is_header, F.col("line")), block).where(~is_header & F.col("header").isNotNull())
    first = named.groupBy("graph_id", F.col("line").alias("path")).agg(F.min_by("header", "line_no").alias("h"))
    return first.select("graph_id", "path", *[F.regexp_extract("h", _HEADER, i + 1).alias(n) for i, n in enumerate(("sha", "author", "committed_at"))])


def commit_files(log: DataFrame, block: int = BLOCK) -> DataFrame:
    """(graph_id, commit_seq, sha, path) from a log whose headers begin with a NUL; commits without files vanish."""
    is_header = F.startswith(F.col("line"), F.lit("\0"))
    runs = under_headers(log.select("graph_id", "line_no", "line"), F.when(is_header, F.substring("line", 2, 64)), block)
    return runs.where(~is_header & (F.col("commit_seq") > 0)).select("graph_id", "commit_seq", F.col("header").alias("sha"), _stripped().alias("path")).where("path <> ''")


def _log(spark: SparkSession, graph_id: str, root: str, *arguments: str) -> DataFrame:
    """The lines of a clone's log, copied to the shared folder as they come; none if git fails or takes too long."""
    schema = "graph_id string, line_no long, line string"
    none = spark.createDataFrame([], schema)
    table = f"{shared_dir(spark)}/tables/log-{uuid.uuid4().hex}"
    try:
        git = subprocess.Popen(["git", "-C", root, "log", *arguments], stdout=subprocess.PIPE, stderr=subprocess.DEVNULL)
    except OSError:
        return none
    patience = threading.Timer(TIMEOUT_SECONDS, git.kill)
    patience.start()
    written = False
    try:
        with git, io.TextIOWrapper(git.stdout, "utf-8", "replace", newline="\n") as text:
            for rows in batched(enumerate(text), CHUNK_LINES):
                parts = {"graph_id": [graph_id] * len(rows), "line_no": [i for i, _ in rows], "line": [x.removesuffix("\n") for _, x in rows]}
                spark.createDataFrame(pa.table(parts)).write.mode("append").parquet(table)
                written = True
    finally:
        patience.cancel()
    return spark.read.schema(schema).parquet(table) if written and git.returncode == 0 else none


def read_last_commit_log(spark: SparkSession, root: str, graph_id: str) -> DataFrame:
    """The log of a clone for :func:`last_commits`; empty when there is none."""
    return _log(spark, graph_id, root, "--format=%H|%an|%aI", "--name-only")


def read_history_log(spark: SparkSession, root: str, graph_id: str, most: int = HISTORY_LIMIT) -> DataFrame:
    """The log of a clone for :func:`commit_files`, without merges; empty on any failure."""
    return _log(spark, graph_id, root, f"--max-count={most}", "--format=%x00%H", "--name-only", "--no-merges")
