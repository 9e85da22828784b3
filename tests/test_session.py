import os

from depweave.session import clear_scratch, materialise, shared_dir


def test_scratch_tables_keep_their_schema_and_can_be_cleared(spark):
    empty = spark.createDataFrame([], "a long, b array<string>")
    assert materialise(empty, "t").schema.simpleString() == empty.schema.simpleString()
    one = materialise(spark.range(3), "u")
    assert one.count() == 3
    folder = shared_dir(spark).removeprefix("file:") + "/tables"
    assert os.listdir(folder)
    clear_scratch(spark)
    assert not os.path.exists(folder)


def test_shuffles_begin_with_partitions_in_proportion_to_the_input(spark, tmp_path, monkeypatch):
    from depweave import session

    name = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.range(20_000).write.parquet(str(tmp_path / "t"))
    before = spark.conf.get(name, None)
    try:
        spark.conf.unset(name)
        session.spread(spark, str(tmp_path))
        assert spark.conf.get(name, None) is None  # small inputs keep the session's number
        assert spark.conf.get(size) == session.JOINED
        spark.conf.set(size, "8MB")
        monkeypatch.setattr(session, "INPUT_PER_PARTITION", 1000)
        session.spread(spark, str(tmp_path))
        assert int(spark.conf.get(name)) > 50
        spark.conf.set(name, "100000")
        session.spread(spark, str(tmp_path))
        assert spark.conf.get(name) == "100000" and spark.conf.get(size) == "8MB"
    finally:
        spark.conf.unset(size)
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def test_a_written_table_leaves_no_shuffle_files_and_scratch_tables_go_at_the_end(spark, tmp_path):
    import glob

    from depweave import session
    from pyspark.sql import functions as F

    local = os.path.dirname(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()[0].getPath())
    files = lambda: {os.path.basename(f).split("_")[1] for f in glob.glob(f"{local}/**/shuffle_*.data", recursive=True)}
    before = files()
    with session.scratch(spark):
        t = materialise(spark.range(5000).groupBy(F.col("id") % 700).agg(F.count("*").alias("n")), "grouped")
        folder = os.path.dirname(t.inputFiles()[0].removeprefix("file://").removeprefix("file:"))
        assert t.count() == 700 and os.listdir(folder)
        session.write_table(t.repartition(3), f"file:{tmp_path}/kept")
    assert not os.path.exists(folder)
    assert spark.read.parquet(f"file:{tmp_path}/kept").count() == 700
    import time

    for _ in range(50):  # they are deleted in the background
        if len(files() - before) <= 1:  # the count's own
            break
        time.sleep(0.1)
    assert len(files() - before) <= 1


def test_joins_send_little_by_way_of_the_driver(spark, tmp_path):
    from depweave import session

    spark.range(10).write.parquet(str(tmp_path / "t"))
    before = {n: spark.conf.get(n, None) for n in session.SENT}
    try:
        for n in session.SENT:
            spark.conf.unset(n)
        session.spread(spark, str(tmp_path))
        assert {n: spark.conf.get(n) for n in session.SENT} == session.SENT
    finally:
        for n, v in before.items():
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)
