"""The training-corpus pipeline: five stages, each over all that the one before it kept.

quality classifier -> line dedup -> SimHash near-dedup -> benchmark
decontamination -> best-fit packing.  Every stage is written as Parquet and read
again, so a lost executor never costs more than its own stage; what a stage has read
from the one before it is deleted once its own output is written.

Defined results: a null or empty text is scored as one blank line, passes line dedup
as it is, and all such documents are near copies of each other, so one may stay; it is
packed as an end token.  Rows equal in id and text pass as one after near-dedup.  A
null id is a document.  Further columns of ``documents``, whatever their names, are
kept up to packing.  An empty table gives no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depweave.llm import decontaminate, line_dedup, packing, quality_crf, simhash
from depweave.session import delete_folder, scratch, shared_dir, write_table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that score below 0.5; fitted on labels of the training folds (crc32 mod 3 not 1)."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    field = quality_crf.fit_quality(docs, labels, quality_crf.in_fold("doc_id", 3, 1))
    return quality_crf.keep_good(docs, field)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated lines; every document stays, with the length of its text."""
    out = line_dedup.dedup_lines(docs)
    return out.withColumn("n_chars", F.char_length("text").cast("long"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group, the one with the least id; links are five-word shingle sets of similarity 0.8 or more."""
    return simhash.drop_near_duplicates(docs, size=5, similarity=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes documents that hold a window of a benchmark item."""
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the training sequences."""
    return packing.pack(docs)


STAGES = [("quality", quality), ("line_dedup", lines), ("near_dedup", near_dedup), ("decontamination", decontamination), ("packing", pack)]

#: No SQL: the first stage is a fitted model.  The tests hold the stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/tables/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES:
        with scratch(spark):
            out = stage(spark, docs, sf_dir)
            write_table(out, f"{folder}/{name}")
        if before:
            delete_folder(spark, f"{folder}/{before}")
        before = name
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{name}")
    return docs
