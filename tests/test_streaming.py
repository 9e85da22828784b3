from depweave.streaming.churn import current_churn, write_churn


def test_counts_grow_and_repeats_do_not_count(spark, tmp_path):
    source = str(tmp_path / "in")
    schema = "graph_id string, commit_seq long, path string, committed_at timestamp"

    def put(rows):
        spark.createDataFrame(rows, "graph_id string, commit_seq long, path string, at string").selectExpr("graph_id", "commit_seq", "path", "cast(at as timestamp) as committed_at").coalesce(1).write.mode("append").parquet(source)

    def run():
        events = spark.readStream.schema(schema).parquet(source)
        write_churn(events, str(tmp_path / "out"), str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination(120)

    put([("g", 1, "a", "2024-01-01"), ("g", 1, "b", "2024-01-01"), ("g", 2, "a", "2024-01-02"), ("g", 2, "a", "2024-01-02")])
    run()
    put([("g", 3, "a", "2024-01-03"), ("g", 2, "a", "2024-01-02")])
    run()
    got = current_churn(spark.read.parquet(str(tmp_path / "out")))
    assert {(r["path"], r["commits"]) for r in got.collect()} == {("a", 3), ("b", 1)}
