"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("depweave")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    It is ``spark.checkpoint.dir`` as the cluster names it.  Only a single-machine
    session (``local[...]``) without that setting gets a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    set_dir = spark.sparkContext.getCheckpointDir()
    if set_dir:
        return set_dir.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="depweave-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


#: Bytes of Parquet input for each partition that a shuffle begins with.
INPUT_PER_PARTITION = 2 << 20
_PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
#: Bytes of a shuffle up to which small partitions are joined, if the session doesn't say.
JOINED = "16MB"
_JOINED = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
#: Bytes up to which a side of a join goes to all executors by way of the driver, if the session doesn't say: as estimated from Parquet, which is a small part of what its rows take, and as counted in a shuffle.
SENT = {"spark.sql.autoBroadcastJoinThreshold": "256KB", "spark.sql.adaptive.autoBroadcastJoinThreshold": "8MB"}
_DEFAULT_SENT = (None, "10485760b", "10MB", "10485760")


def spread(spark: SparkSession, folder: str) -> None:
    """Lets shuffles begin with partitions in proportion to the tables in a folder, so that what a task holds doesn't grow with them.

    Adaptive execution joins those that turn out small.  Without it, or where the session asks for more, nothing changes.
    """
    if spark.conf.get("spark.sql.adaptive.enabled") != "true" or spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled") != "true":
        return
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    size = path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    wanted = -(-size // INPUT_PER_PARTITION)
    if spark.conf.get(_JOINED, None) in (None, "67108864b", "64MB"):  # the default: a task that pairs what it reads holds many times as much
        spark.conf.set(_JOINED, JOINED)
    for name, most in SENT.items():
        if spark.conf.get(name, None) in _DEFAULT_SENT:
            spark.conf.set(name, most)
    if wanted > int(spark.conf.get(_PARTITIONS, None) or spark.conf.get("spark.sql.shuffle.partitions")):
        spark.conf.set(_PARTITIONS, str(wanted))


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_scratch: ContextVar[str] = ContextVar("scratch", default="tables")


def write_table(df: DataFrame, path: str, *by: str) -> None:
    """Writes Parquet; the shuffle files of the write are deleted at its end, not when the driver happens to collect garbage."""
    spark = df.sparkSession
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)


def materialise(df: DataFrame, name: str, kept: bool = False) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This cuts the lineage: a lost executor costs a re-read, not a recomputation.
    The schema is passed on explicitly, so an empty table reads back whole.
    ``kept``: it outlives the innermost :func:`scratch`.
    """
    spark = df.sparkSession
    folder = _scratch.get()
    if kept and "/" in folder:
        folder = folder.rsplit("/", 1)[0]
    path = f"{shared_dir(spark)}/{folder}/{name}-{uuid.uuid4().hex}"
    write_table(df, path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end the tables that are materialised inside it, but for those that are kept; for results that are written to elsewhere inside it."""
    folder = f"{_scratch.get()}/{uuid.uuid4().hex}"
    token = _scratch.set(folder)
    try:
        yield
    finally:
        _scratch.reset(token)
        delete_folder(spark, f"{shared_dir(spark)}/{folder}")


def delete_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clear_scratch(spark: SparkSession) -> None:
    """Deletes all tables that :func:`materialise` has written; for when no query needs them any more."""
    delete_folder(spark, f"{shared_dir(spark)}/tables")
