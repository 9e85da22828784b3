"""A bounded sample of labelled documents for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depweave.session import materialise


def in_fold(id_col: str, modulus: int, remainder: int):
    """Whether crc32 of the id as text leaves this remainder (null id: false)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, per_class: int, exclude=None, id_col: str = "doc_id", text_col: str = "text", name: str = "sample") -> DataFrame:
    """(id, text, label) of at most ``per_class`` labelled documents of each of the classes 0 and 1.

    They are the first by a hash of the id among rows that ``exclude`` doesn't
    hold for.  Null ids and labels are passed over; an id with several labels
    counts with the largest; an id with several rows gives one of them.
    """
    usable = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1))
    if exclude is not None:
        usable = usable.where(~exclude)
    one = usable.groupBy(id_col).agg(F.max(label_col).cast("int").alias("label"))
    first = [one.where(F.col("label") == v).orderBy(F.xxhash64(id_col), id_col).limit(per_class) for v in (0, 1)]
    chosen = first[0].unionByName(first[1])  # at most 2 * per_class rows
    texts = docs.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    found = texts.join(F.broadcast(chosen), id_col).groupBy(id_col, "label").agg(F.min("text").alias("text"))
    return materialise(found, name)
