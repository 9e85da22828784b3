"""Best-fit-decreasing packing of tokenised documents into sequences of a fixed capacity.

Best-fit decreasing looks at lengths only, so the plan is made once for the whole
corpus from the histogram of piece lengths, which has ``capacity`` rows at most
whatever the corpus size.  Open bins with the same remaining capacity are
interchangeable; they are kept as intervals of sequence numbers under their
remaining capacity, and a segment tree over the capacities finds the tightest
that still fits in logarithmic time.  Documents of one length are placed in runs,
exactly as one after another would be.  The plan (intervals of ranks within a
length -> intervals of sequences) is then looked up for every piece by its rank.

Tokenising runs once; only lengths and checksums are kept for planning, so no
token crosses the network.  Ranks are made of a count within each task and of
prefix sums over tasks; no length is gathered in one place.

Defined results: a null or empty text is the end token alone; repeated rows are
packed each for itself; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from depweave.session import materialise

from .textbytes import bounded_batches, chunks, returned

CAPACITY = 4096
END_ID = 1
VOCABULARY = "word_bpe_49k.json"
#: Words whose ids a worker keeps.
CACHE_WORDS = 500_000

_coders: dict[str, WordCoder] = {}


class _Slots(dict):
    """Unknown words have slot -1."""

    def __missing__(self, word: bytes) -> int:
        return -1


class WordCoder:
    """Ids by a tokenizer that drops white space and case: equal words are encoded once.

    The vocabulary's splitter never joins what ASCII white space separates, so a
    text's ids are those of its words in order; texts are lower-cased in ASCII first,
    as the tokenizer does, unless they may hold one of its special tokens.  The first
    ``CACHE_WORDS`` words that a worker meets stay known, which are nearly all the
    frequent ones; others are encoded once per call.  Many words are encoded as one
    text, with a mark between them.
    """

    MARK = "\x01"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are what runs in parallel here
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.mark_ids = self.tokenizer.encode(self.MARK, add_special_tokens=False).ids
        self.slot = _Slots()
        self.ids = np.zeros(1 << 16, np.uint32)
        self.begin = np.zeros(1 << 16, np.int64)
        self.size = np.zeros(1 << 16, np.int64)
        self.used = 0

    def _word_ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, number of ids per word)."""
        if len(self.mark_ids) == 1 and len(words) > 1:
            text = f" {self.MARK} ".join([w.decode() for w in words])
            flat = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
            at = np.flatnonzero(flat == self.mark_ids[0])
            if len(at) == len(words) - 1:  # no word holds the mark
                return np.delete(flat, at), np.diff(np.concatenate([[-1], at, [len(flat)]])) - 1
        found = [e.ids for e in self.tokenizer.encode_batch([w.decode() for w in words], add_special_tokens=False)]
        return np.fromiter((i for x in found for i in x), np.uint32), np.fromiter((len(x) for x in found), np.int64, len(found))

    def _learn(self, words: list[bytes], n: int) -> None:
        """Puts the ids of ``words`` into the slots from ``n`` on."""
        for lo in range(0, len(words), 20_000):
            part = words[lo : lo + 20_000]
            flat, size = self._word_ids(part)
            a, b = n + lo, n + lo + len(part)
            while self.used + len(flat) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
            while b > len(self.begin):
                self.begin = np.concatenate([self.begin, np.zeros_like(self.begin)])
                self.size = np.concatenate([self.size, np.zeros_like(self.size)])
            self.begin[a:b] = self.used + np.cumsum(size) - size
            self.size[a:b] = size
            self.ids[self.used : self.used + len(flat)] = flat
            self.used += len(flat)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids per text)."""
        parts = [(t if b"<|" in t else t.lower()).split() for t in texts]
        flat = list(chain.from_iterable(parts))
        slots = np.array(list(map(self.slot.__getitem__, flat)), np.int64)
        unknown = np.flatnonzero(slots < 0)
        new = dict.fromkeys([flat[i] for i in unknown.tolist()])
        n = len(self.slot)
        stay = max(0, CACHE_WORDS - n)
        words = list(new)
        self._learn(words[:stay], n)
        used = self.used
        self._learn(words[stay:], n + len(words[:stay]))
        for i, w in enumerate(words):
            new[w] = n + i
        slots[unknown] = [new[flat[i]] for i in unknown.tolist()]
        self.slot.update(zip(words[:stay], range(n, n + len(words)), strict=False))
        sizes = self.size[slots]
        after = np.cumsum(sizes)
        into = np.repeat(self.begin[slots] - after + sizes, sizes)
        into += np.arange(len(into))
        count = np.fromiter((len(p) for p in parts), np.int64, len(parts))
        edge = np.concatenate([[0], after])[np.concatenate([[0], np.cumsum(count)])]
        out = self.ids[into], np.diff(edge)
        self.used = used
        return out


def coder(path: str) -> WordCoder:
    if path not in _coders:
        _coders[path] = WordCoder(path)
    return _coders[path]


def tokenizer_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _batches(column: pa.Array, most: int = 2_000_000) -> Iterator[list[bytes]]:
    for c in chunks(column, most):
        yield [x or b"" for x in column[c.lo : c.hi].cast(pa.binary()).to_pylist()]


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, and (task, rank): its place among the task's pieces of its length."""
    bounded_batches(docs.sparkSession)
    path = path or tokenizer_path()
    slim = docs.select(id_col, F.col(text_col).cast("string").alias("__text"), F.spark_partition_id().alias("task"))
    longs = ("piece", "start", "length", "ids_crc32", "rank")
    schema = T.StructType([docs.schema[id_col], T.StructField("task", T.IntegerType()), *[T.StructField(x, T.IntegerType() if x == "piece" else T.LongType()) for x in longs]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(path)
        seen = np.zeros(capacity + 1, np.int64)
        for b in returned(batches):
            base = 0
            for texts in _batches(b.column(1)):
                ids, sizes = code.encode(texts)
                row, out = [], {x: [] for x in longs}
                at = 0
                for i, n in enumerate(sizes.tolist()):
                    whole = np.append(ids[at : at + n], np.uint32(END_ID)).astype("<u4", copy=False)
                    at += n
                    for k, s in enumerate(range(0, n + 1, capacity)):
                        cut = whole[s : s + capacity]
                        row.append(base + i)
                        for name, v in zip(longs, (k, s, len(cut), zlib.crc32(cut), seen[len(cut)]), strict=True):
                            out[name].append(int(v))
                        seen[len(cut)] += 1
                base += len(texts)
                take = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(2).take(take), *[pa.array(out[x], pa.int32() if x == "piece" else pa.int64()) for x in longs]], names=[id_col, "task", *longs])

    return slim.mapInArrow(run, schema)


class CapacityTree:
    """A segment tree over remaining capacities: which of them have open bins."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.some = bytearray(2 * self.leaves)

    def put(self, remaining: int, open_: bool) -> None:
        i = remaining + self.leaves
        self.some[i] = open_
        while i > 1:
            i >>= 1
            self.some[i] = self.some[2 * i] | self.some[2 * i + 1]

    def tightest(self, need: int) -> int:
        """The least remaining capacity of at least ``need`` with an open bin, or -1."""
        i = need + self.leaves
        if self.some[i]:
            return need
        while i > 1:
            if not i & 1 and self.some[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.some[2 * i] else 2 * i + 1
                return i - self.leaves
            i >>= 1
        return -1


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Best-fit decreasing over {length: count}.

    Returns rows (length, first rank, items per bin, first sequence, first offset),
    sorted by length and rank, and the number of sequences.
    """
    tree = CapacityTree(capacity)
    open_: dict[int, list[tuple[int, int]]] = {}
    rows, opened = [], 0

    def add(remaining: int, first: int, n: int) -> None:
        if remaining and n:
            if not open_.setdefault(remaining, []):
                tree.put(remaining, True)
            open_[remaining].append((first, n))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            r = tree.tightest(length)
            if r < 0:  # a new bin is as tight as any other new bin: open as many as this length fills
                fit = capacity // length
                n = max(1, left // fit)
                add(capacity, opened, n)
                opened += n
                r = capacity
            fit = r // length  # a bin that took one of this length is the tightest for the next, until full
            first, n = open_[r].pop()
            if not open_[r]:
                tree.put(r, False)
            bins = min(n, left // fit)
            if bins:
                rows.append((length, rank, fit, first, capacity - r))
                add(r - fit * length, first, bins)
                rank, left = rank + bins * fit, left - bins * fit
            elif left:
                rows.append((length, rank, left, first, capacity - r))
                add(r - left * length, first, 1)
                rank, left, bins = rank + left, 0, 1
            add(r, first + bins, n - bins)
    return np.array(sorted(rows), np.int64).reshape(-1, 5), opened


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Per piece: id, piece, start, length, ids_crc32, sequence_id and offset."""
    cut = materialise(pieces(docs, id_col, text_col, path, capacity), "pieces")
    counts = materialise(cut.groupBy("length", "task").agg((F.max("rank") + 1).alias("n")), "piece-counts")
    # The histogram has at most `capacity` rows.
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    rows, _ = plan(histogram, capacity)
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(rows)
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    base = materialise(counts.select("length", "task", F.coalesce(before, F.lit(0)).alias("base")), "piece-bases")
    ranked = cut.join(base, ["length", "task"]).select(id_col, "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("base")).alias("rank"))
    keep = [id_col, "piece", "start", "length", "ids_crc32"]
    schema = T.StructType([*[ranked.schema[x] for x in keep], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = sent.value
        top = np.int64(1) << 42  # (length, rank) as one number; ranks stay below
        start = p[:, 0] * top + p[:, 1]
        for b in batches:
            length, rank = (b.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            at = p[np.searchsorted(start, length * top + rank, "right") - 1]
            i = rank - at[:, 1]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(at[:, 3] + i // at[:, 2]), pa.array(at[:, 4] + i % at[:, 2] * length)], names=[*keep, "sequence_id", "offset"])

    return ranked.mapInArrow(place, schema)


def sequences(docs: DataFrame, packed: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids, and where each document's piece lies in it.

    Takes unique ids.  Tokens are made again and shuffled once to their sequences.
    """
    path = path or tokenizer_path()
    slim = docs.select(id_col, F.col(text_col).cast("string").alias("__text"))
    schema = T.StructType([docs.schema[id_col], T.StructField("piece", T.IntegerType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(path)
        for b in returned(batches):
            base = 0
            for texts in _batches(b.column(1), 1_000_000):
                ids, sizes = code.encode(texts)
                row, no, out, at = [], [], [], 0
                for i, n in enumerate(sizes.tolist()):
                    whole = np.append(ids[at : at + n], np.uint32(END_ID)).astype(np.int32)
                    at += n
                    for k, s in enumerate(range(0, n + 1, capacity)):
                        row.append(base + i)
                        no.append(k)
                        out.append(whole[s : s + capacity])
                base += len(texts)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), pa.array(no, pa.int32()), pa.array(out, pa.list_(pa.int32()))], names=[id_col, "piece", "ids"])

    tokens = slim.mapInArrow(run, schema)
    placed = packed.join(tokens, [id_col, "piece"])
    parts = F.array_sort(F.collect_list(F.struct("offset", id_col, "piece", "length", "ids")))
    return placed.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id", F.flatten("parts.ids").alias("ids"), F.transform("parts", lambda p: F.struct(p["offset"].alias("offset"), p["length"].alias("length"), p[id_col].alias(id_col), p["piece"].alias("piece"))).alias("documents")
    )
