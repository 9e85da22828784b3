"""Quality rules: how much of a text lies inside repeated n-grams and repeated lines.

Words are runs of characters other than space and U+0009 to U+000D.  Words
are hashed by mixing in eight bytes at a time (64 bits, no polynomial whose collisions
are known), n-gram hashes roll over the word hashes for every length at once, and an n-gram counts as repeated when its hash
occurs twice or more in the same text.  All of it is numpy over Arrow buffers in
one pass without a shuffle: each row depends on its own text alone.

Defined results: a null or empty text has no words and fails the base rule;
repeated rows each get their own row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textbytes import NOT_SPACE, Chunk, bounded_batches, chunks, duplicated, mix

#: n-gram length -> largest share of word characters inside repeated n-grams of that length.
NGRAM_LIMITS = {5: 0.45, 7: 0.40, 10: 0.35}
#: Largest share of the characters of non-blank lines that lie in repeats of an earlier line.
LINE_LIMIT = 0.30
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_ROLL = np.uint64(0xC2B2AE3D27D4EB4F)
_TEXT_KEY = np.uint64(0x165667B19E3779F9)


def measure(c: Chunk, lengths: tuple[int, ...]) -> dict[str, np.ndarray]:
    """Per text: counts, and characters inside repeated lines and n-grams."""
    n = c.hi - c.lo
    starts, ends = c.spans(NOT_SPACE)
    first = c.per_text(starts)
    counts = np.diff(first)
    text_no = np.repeat(np.arange(n), counts)
    letters = np.zeros(len(c.data) + 1, np.int64)
    np.cumsum((c.data & 0xC0) != 0x80, out=letters[1:])
    width = letters[ends] - letters[starts]
    total = lambda x: np.bincount(text_no, x, n).astype(np.int64)
    out = {"n_words": counts.astype(np.int64), "word_chars": total(width), "n_symbols": np.diff(c.per_text(np.flatnonzero(_SYMBOL[c.data])))}

    line_start, line_end, line_text = c.lines()
    has_word = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_start)
    line_start, line_end, line_text = line_start[has_word], line_end[has_word], line_text[has_word]
    again = duplicated(mix(c.hashes(line_start, line_end) + line_text.astype(np.uint64) * _TEXT_KEY), "first")
    line_width = letters[line_end] - letters[line_start]
    out["n_dup_lines"] = np.bincount(line_text, again, n).astype(np.int64)
    out["line_chars"] = np.bincount(line_text, line_width, n).astype(np.int64)
    out["dup_line_chars"] = np.bincount(line_text, line_width * again, n).astype(np.int64)

    word = c.hashes(starts, ends)
    salt = text_no.astype(np.uint64) * _TEXT_KEY
    gram, left = word.copy(), counts
    room = np.repeat(first[1:], counts) - np.arange(len(starts))  # words from here to the end of the text
    for k in range(2, max(lengths) + 1):
        gram = mix(gram[:-1]) * _ROLL + word[k - 1 :] if len(gram) else gram
        if k not in lengths:
            continue
        at = np.flatnonzero(room[: len(gram)] >= k)
        hit = at[duplicated(mix(gram[at] + salt[at]), False)]
        edge = np.zeros(len(starts) + 1, np.int64)
        edge += np.bincount(hit, minlength=len(edge)) - np.bincount(hit + k, minlength=len(edge))
        inside = np.cumsum(edge[:-1]) > 0
        out[f"words_in_{k}"], out[f"chars_in_{k}"] = total(inside), total(width * inside)
    return out


def columns(lengths: Iterable[int]) -> list[str]:
    per_length = [f"{what}_in_{k}" for k in sorted(lengths) for what in ("words", "chars")]
    return ["n_words", "word_chars", "n_symbols", "n_dup_lines", "line_chars", "dup_line_chars", *per_length]


def repetition_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lengths: Iterable[int] = (3, *NGRAM_LIMITS)) -> DataFrame:
    """One row per input row: the id and the measures of :func:`measure` as longs."""
    bounded_batches(docs.sparkSession)
    lengths = tuple(sorted(set(lengths)))
    names = columns(lengths)
    slim = docs.select(docs[id_col], docs[text_col].cast("string").alias("__text"))
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *[T.StructField(x, T.LongType()) for x in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            parts = [measure(c, lengths) for c in chunks(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(np.concatenate([p[x] for p in parts]), pa.int64()) for x in names]], names=[id_col, *names])

    return slim.mapInArrow(run, schema)


def verdict(stats: DataFrame, ngram_limits: dict[int, float] | None = None, line_limit: float = LINE_LIMIT) -> DataFrame:
    """Adds base_failed and kept to the result of :func:`repetition_stats`."""
    limits = NGRAM_LIMITS if ngram_limits is None else ngram_limits
    base_failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("words_in_3") > MAX_REPEAT_PERCENT * F.col("n_words"))
    fine = F.col("dup_line_chars") <= line_limit * F.col("line_chars")
    for k, most in sorted(limits.items()):
        fine &= F.col(f"chars_in_{k}") <= most * F.col("word_chars")
    return stats.withColumns({"base_failed": base_failed, "kept": ~base_failed & fine})
