from pyspark.sql import functions as F

from depweave.sources import gitlog


def test_a_log_with_gaps_has_few_blocks_and_the_same_headers(spark):
    lines = [("g", i * 200_000 + k, "\0c%d" % i if not k else f"f{k}") for i in range(50) for k in range(3)] + [("h", 7, "\0x"), ("h", 8, "f")]
    log = spark.createDataFrame(lines, "graph_id string, line_no long, line string")
    cut = gitlog.in_blocks(log, 30)
    assert cut.count() == len(lines)
    assert {x["graph_id"]: x["n"] <= 6 for x in cut.groupBy("graph_id").agg(F.countDistinct("block").alias("n")).collect()} == {"g": True, "h": True}
    got = {(x["graph_id"], x["commit_seq"], x["sha"], x["path"]) for x in gitlog.commit_files(log, 30).collect()}
    assert got == {("g", i + 1, f"c{i}", f"f{k}") for i in range(50) for k in (1, 2)} | {("h", 1, "x", "f")}
