"""Churn, change coupling and risk from commit histories.

``commit_files`` is (graph_id, commit_seq, path), ``live`` is (graph_id, path).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from depweave.session import materialise

#: Commits that touch more live files than this say nothing about coupling.
MAX_WIDTH = 60
MIN_SHARED = 3


def touched(commit_files: DataFrame, live: DataFrame) -> DataFrame:
    """Distinct (graph_id, commit_seq, path) of live files."""
    return commit_files.select("graph_id", "commit_seq", "path").distinct().join(live.select("graph_id", "path").distinct(), ["graph_id", "path"], "left_semi")


def churn(commit_files: DataFrame, live: DataFrame) -> DataFrame:
    """(graph_id, path, commits): commits of any width that touch each live file, untouched files at 0.

    A graph without any history gets null: unknown is not zero.
    """
    counts = touched(commit_files, live).groupBy("graph_id", "path").agg(F.count("*").alias("n"))
    known = commit_files.select("graph_id").distinct().withColumn("has", F.lit(True))
    out = live.select("graph_id", "path").distinct().join(counts, ["graph_id", "path"], "left").join(known, "graph_id", "left")
    return out.select("graph_id", "path", F.when(F.col("has"), F.coalesce("n", F.lit(0).cast("long"))).alias("commits"))


def coupling(commit_files: DataFrame, live: DataFrame, min_shared: int = MIN_SHARED, max_width: int = MAX_WIDTH) -> DataFrame:
    """(graph_id, a, b, shared, strength) of file pairs a < b changed together in ``min_shared`` commits or more.

    Pairs come from commits of 2 to ``max_width`` live files, so a commit gives 1770
    at most; strength is the share of commits touching either file that touch both,
    over commits of any width.
    """
    ids = materialise(live.select("graph_id", "path").distinct().withColumn("id", F.monotonically_increasing_id()), "file-ids")
    # files are numbers until the end: pairs are many
    t = materialise(commit_files.join(ids, ["graph_id", "path"]).select("graph_id", "commit_seq", "id").distinct(), "touched")
    width = F.count("*").over(Window.partitionBy("graph_id", "commit_seq"))
    narrow = t.withColumn("width", width).where(F.col("width").between(2, max_width))
    files = narrow.groupBy("graph_id", "commit_seq").agg(F.array_sort(F.collect_list("id")).alias("f"))  # max_width at most
    left = files.select(F.posexplode("f").alias("i", "a"), "f")
    pairs = left.select("a", F.explode(F.expr("slice(f, i + 2, size(f))")).alias("b"))
    shared = materialise(pairs.groupBy("a", "b").agg(F.count("*").alias("shared")).where(F.col("shared") >= min_shared), "shared")
    total = materialise(ids.join(t.groupBy("id").agg(F.count("*").alias("n")), "id"), "file-totals")
    side = lambda x, *more: total.select(F.col("id").alias(x), F.col("path").alias(f"p{x}"), F.col("n").alias(f"n{x}"), *more)
    one = shared.join(side("a"), "a").join(side("b", "graph_id"), "b")
    return one.select("graph_id", F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"), "shared", (F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))).alias("strength"))


def with_import_edge(pairs: DataFrame, imports: DataFrame) -> DataFrame:
    """Adds has_import_edge: whether either file of a pair (a < b) imports the other."""
    linked = imports.select("graph_id", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), F.lit(True).alias("linked")).distinct()
    return pairs.join(linked, ["graph_id", "a", "b"], "left").withColumn("has_import_edge", F.coalesce("linked", F.lit(False))).drop("linked")


def strongest(pairs: DataFrame, most: int = 20) -> DataFrame:
    """The ``most`` strongest pairs of each graph; strength is rounded (half to even) after ordering."""
    rank = F.row_number().over(Window.partitionBy("graph_id").orderBy(F.desc("strength"), F.desc("shared"), "a", "b"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= most).withColumn("strength", F.bround("strength", 3))


def risk(churned: DataFrame, fan: DataFrame, most: int = 15) -> DataFrame:
    """(graph_id, path, commits, fan_in, score, rank): churn times fan-in where positive."""
    scored = churned.join(fan.select("graph_id", F.col("node").alias("path"), "fan_in"), ["graph_id", "path"]).withColumn("score", F.col("commits") * F.col("fan_in")).where("score > 0")
    rank = F.row_number().over(Window.partitionBy("graph_id").orderBy(F.desc("score"), "path"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= most).select("graph_id", "path", "commits", "fan_in", "score", "rank")
