"""Fill-in-the-middle transformation: a text's middle is moved behind its prefix and suffix.

A text is cut into units (by default runs of ASCII letters, and single other
characters).  Where to cut is a pair of ranks drawn from a hash of the id, so it needs the
number of units first.  Two passes of a lazy matcher do that in constant memory: the first
only counts its matches, the second advances a fresh matcher to both ranks and reads off
the character positions.  No list of units exists at any time, however long the text.

Each row depends on itself alone: no shuffle, and a lost task is simply run again.

Defined results: a null text is an empty text; an empty text, or one that holds a sentinel,
stays plain; a null id draws as the empty string; repeated rows each give a row (the same
id draws the same cuts); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from hashlib import sha256
from itertools import count, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textbytes import bounded_batches, returned

UNIT = "[A-Za-z]+|[^A-Za-z]"
#: Marks of prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
#: Of a hundred texts, how many are transformed; of a hundred transformed ones, how many have the suffix first.
TRANSFORMED, SUFFIX_FIRST = 90, 20


def count_units(unit: re.Pattern, text: str) -> int:
    """First pass: the number of matches, none of which is kept."""
    ticks = count()
    deque(zip(unit.finditer(text), ticks, strict=False), maxlen=0)
    return next(ticks)


def rank_ends(unit: re.Pattern, text: str, first: int, second: int) -> tuple[int, int]:
    """Second pass: where the units of rank ``first`` <= ``second`` end (rank 0: before the text)."""
    matches = unit.finditer(text)
    a = next(islice(matches, first - 1, None)).end() if first else 0
    b = next(islice(matches, second - first - 1, None)).end() if second > first else a
    return a, b


def draws(seed: int, key: str) -> list[int]:
    """Four unsigned 32-bit numbers from the seed and a row's id."""
    digest = sha256(f"{seed}:{key}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4)]


def check_sentinels(sentinels: tuple[str, str, str]) -> None:
    """A sentinel must not begin inside one, or text before it could complete another: restoring would be ambiguous."""
    if len(set(sentinels)) < 3 or any(not s or s[0] in t[1:] for s in sentinels for t in sentinels):
        raise ValueError("sentinels must differ, and none of their first characters may occur further inside one")


def transform(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, transformed: int = TRANSFORMED, suffix_first: int = SUFFIX_FIRST,
    unit: str = UNIT, sentinels: tuple[str, str, str] = SENTINELS,
) -> DataFrame:
    """One row per input row: id, n (units), form (plain, psm or spm), prefix_chars, middle_chars (null if plain), output.

    ``unit`` must match every character of a text, as a part of some unit.
    """
    check_sentinels(sentinels)
    bounded_batches(docs.sparkSession)
    slim = docs.select(docs[id_col], docs[id_col].cast("string").alias("__key"), docs[text_col].cast("string").alias("__text"))
    long, text_type = T.LongType(), T.StringType()
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *[T.StructField(c, t) for c, t in (("n", long), ("form", text_type), ("prefix_chars", long), ("middle_chars", long), ("output", text_type))]])

    def one(pattern: re.Pattern, key: str | None, text: str) -> tuple:
        p, s, m = sentinels
        n = count_units(pattern, text)
        h = draws(seed, key or "")
        if not text or p in text or s in text or m in text or h[2] % 100 >= transformed:
            return n, "plain", None, None, text
        a, b = rank_ends(pattern, text, *sorted((h[0] % (n + 1), h[1] % (n + 1))))
        if h[3] % 100 < suffix_first:
            return n, "spm", a, b - a, f"{s}{text[b:]}{p}{text[:a]}{m}{text[a:b]}"
        return n, "psm", a, b - a, f"{p}{text[:a]}{s}{text[b:]}{m}{text[a:b]}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = re.compile(unit)
        for batch in returned(batches):
            rows = [one(pattern, k.as_py(), t.as_py() or "") for k, t in zip(batch.column(1), batch.column(2), strict=True)]
            made = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=schema.names)

    return slim.mapInArrow(run, schema)


def restored(output: str | Column, form: str | Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that :func:`transform` was given, from its output and form alone."""
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))

    def parts(first: str, second: str, third: str) -> tuple[Column, Column, Column]:
        """What follows each of the three sentinels, in this order."""
        rest = F.substring(output, F.lit(len(first) + 1), F.char_length(output))
        a = F.substring_index(rest, second, 1)
        rest = F.substring(rest, F.char_length(a) + len(second) + 1, F.char_length(rest))
        b = F.substring_index(rest, third, 1)
        return a, b, F.substring(rest, F.char_length(b) + len(third) + 1, F.char_length(rest))

    p, s, m = sentinels
    psm, spm = parts(p, s, m), parts(s, p, m)
    return F.when(form == "psm", F.concat(psm[0], psm[2], psm[1])).when(form == "spm", F.concat(spm[1], spm[2], spm[0])).otherwise(output)
