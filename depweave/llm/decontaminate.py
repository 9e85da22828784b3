"""Benchmark decontamination with suffix arrays over the training words.

Each shard (a bounded run of texts inside a task) gets a word-level suffix array.  The
windows of the benchmark items that may occur in it are those whose rolling hash a run of
its words has: its hashes are looked up in the benchmark's sorted ones, so a shard's work
hardly grows with the benchmark.  These windows are binary-searched in the array, which
yields all their occurrences at once (equal hashes alone decide nothing).  Matches that don't go on to the left are then extended to
the longest verbatim match of the item suffix that starts there, in parts of bounded
size, so that repetitive texts cost time but no memory.  Only positions that can match enter the
array: a run of words in which every word occurs in the benchmark and which is at
least as long as the shortest window.  Words outside such runs cannot lie in any
occurrence, so nothing is lost and the array is short on ordinary text.

The benchmark is measured first.  It is split into blocks of at most
``block_bytes`` of text, each broadcast by itself and dropped before the next one; the
training texts are scanned once per block and never shuffled.

Defined results: null or empty texts have no words and no hits; null or empty
items have no windows; rows with the same id each get a row; items with the same
id count once; other columns are ignored (scan) or kept (removal).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from depweave.session import materialise

from .textbytes import ALNUM_LOWER, Chunk, bounded_batches, chunks, returned

WINDOW = 10
BLOCK_BYTES = 32_000_000
SHARD_BYTES = 2_000_000
#: Pairs of places that are compared at once.
PAIRS = 1_000_000


@dataclass
class Block:
    """Benchmark windows over a vocabulary; ids of words start at 1, 0 stands for any other word."""

    vocabulary: np.ndarray  # sorted word hashes
    filter: np.ndarray  # by the hash's top 20 bits: may the word be in the vocabulary
    tokens: np.ndarray  # word ids of all items, one 0 after each item
    window_start: np.ndarray  # into tokens, of each different window
    window_length: np.ndarray
    place_begin: np.ndarray  # per window, into places
    places: np.ndarray  # into tokens: everywhere that the windows stand
    item_of: np.ndarray  # per token
    item_ids: list[str]
    shortest: int
    hashes: dict[int, tuple[np.ndarray, np.ndarray]]  # per window length: sorted rolling hashes, their windows


def rolling(tokens: np.ndarray, lengths: Iterable[int]) -> Iterator[tuple[int, np.ndarray]]:
    """(length, hashes of the runs of that many tokens from each place); runs that reach over the end are left out."""
    mixed = tokens.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    out, k = np.zeros(len(tokens), np.uint64), 0
    for length in sorted(lengths):
        while k < min(length, len(tokens)):
            out = out[: len(tokens) - k] * np.uint64(0x100000001B3) + mixed[k:]
            k += 1
        yield length, out if k == length else out[:0]


def possible(tokens: np.ndarray, block: Block) -> np.ndarray:
    """The windows, in order, whose rolling hash a run of these tokens has: all that occur, and few others."""
    found = [np.zeros(0, np.int64)]
    for length, seen in rolling(tokens, block.hashes):
        keys, windows = block.hashes[length]
        seen = np.unique(seen)
        low, high = np.searchsorted(keys, seen), np.searchsorted(keys, seen, "right")
        found.append(windows[ranges(low, high - low)])
    return np.sort(np.concatenate(found))


def window_classes(tokens: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A number per window (start, length), the same for the same words and length."""
    out = np.zeros(len(start), np.int64)
    wide = int(length.max(initial=0))
    for k in range(wide.bit_length()):
        step = 1 << k
        if not k:
            rank = tokens
        else:
            ahead = np.zeros_like(rank)
            ahead[: -step // 2] = rank[step // 2 :]
            rank = np.unique(rank * (int(rank.max(initial=0)) + 1) + ahead, return_inverse=True)[1]
        at = np.flatnonzero(length >> k & 1)
        before = length[at] & (step - 1)  # the lower bits' words stand first
        part = np.zeros(len(start), np.int64)
        part[at] = rank[start[at] + before] + 1
        out = np.unique(out * (int(part.max(initial=0)) + 1) + part, return_inverse=True)[1]
    return np.unique(out * (wide + 1) + length, return_inverse=True)[1]


def build_block(item_ids: list[str], texts: list[str | None], window: int = WINDOW) -> Block:
    hashes, item_no = [], []
    for c in chunks(pa.array(texts, pa.string())):
        c = c.lowered()
        starts, ends = c.spans(ALNUM_LOWER)
        hashes.append(c.hashes(starts, ends))
        item_no.append(np.repeat(np.arange(c.lo, c.hi), np.diff(c.per_text(starts))))
    word = np.concatenate([*hashes, np.zeros(0, np.uint64)])
    item = np.concatenate([*item_no, np.zeros(0, np.int64)]).astype(np.int64)
    vocabulary, ids = np.unique(word, return_inverse=True)
    place = np.arange(len(word)) + item  # one gap after each item
    tokens = np.zeros(len(word) + len(texts) + 1, np.int64)
    tokens[place] = ids + 1
    size = np.bincount(item, minlength=len(texts))
    left = np.repeat(np.cumsum(size), size) - np.arange(len(word))  # words from here to the item's end
    length = np.minimum(size[item], window)
    at = np.flatnonzero(left >= length)
    at = at[(size[item[at]] >= window) | (left[at] == size[item[at]])]
    table = np.zeros(1 << 20, bool)
    table[(vocabulary >> np.uint64(44)).astype(np.int64)] = True
    group = window_classes(tokens, place[at], length[at])
    order = np.argsort(group, kind="stable")
    begin = np.flatnonzero(np.diff(group[order], prepend=-1))
    owner = np.zeros(len(tokens), np.int64)
    owner[place] = item
    first = order[begin]
    start, long = place[at][first], length[at][first]
    table_of = {}
    for k, h in rolling(tokens, np.unique(long).tolist()):
        windows = np.flatnonzero(long == k)
        by_hash = np.argsort(h[start[windows]], kind="stable")
        table_of[k] = h[start[windows]][by_hash], windows[by_hash]
    return Block(vocabulary, table, tokens, start, long, np.append(begin, len(order)), place[at][order], owner, list(item_ids), int(length[at].min(initial=window)), table_of)


def suffix_array(tokens: np.ndarray, depth: int) -> np.ndarray:
    """Positions of non-zero tokens in the order of the suffixes that begin there, exact for ``depth`` tokens."""
    rank, step = tokens, 1
    while step < depth:
        ahead = np.zeros_like(rank)
        ahead[:-step] = rank[step:]
        distinct, rank = np.unique(rank * (int(rank.max(initial=0)) + 1) + ahead, return_inverse=True)
        step *= 2
        if len(distinct) == len(tokens):
            break
    order = np.argsort(rank, kind="stable")
    return order[tokens[order] > 0]


def search(tokens: np.ndarray, order: np.ndarray, block: Block, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of the windows the range of ``order`` whose suffixes begin with it, by binary search of all windows at once."""
    start, length = block.window_start[windows], block.window_length[windows]
    wide = int(length.max(initial=1))
    reach = np.arange(wide)
    inside = reach < length[:, None]
    wanted = np.where(inside, block.tokens[np.minimum(start[:, None] + reach, len(block.tokens) - 1)], 0)
    padded = np.concatenate([tokens, np.zeros(wide, tokens.dtype)])
    rows = np.arange(len(wanted))

    def bound(after_equal: bool) -> np.ndarray:
        low, high = np.zeros(len(wanted), np.int64), np.full(len(wanted), len(order), np.int64)
        while (open_ := low < high).any():
            mid = (low + high) >> 1
            seen = np.where(inside, padded[order[np.minimum(mid, len(order) - 1)][:, None] + reach], 0)
            at = (seen != wanted).argmax(1)
            a, b = seen[rows, at], wanted[rows, at]
            right = open_ & ((a < b) | ((a == b) & after_equal))
            low = np.where(right, mid + 1, low)
            high = np.where(open_ & ~right, mid, high)
        return low

    return bound(False), bound(True)


@dataclass
class Hits:
    """Words per text; occurrences of different windows (text, word number, words); (text, item) pairs; (text, length, word number, item) of verbatim matches, each text's longest among them."""

    n_words: np.ndarray
    text: np.ndarray
    word: np.ndarray
    length: np.ndarray
    items: np.ndarray
    matches: np.ndarray


def ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[i], begin[i] + 1, ... for each i, ``size[i]`` of them."""
    return np.repeat(begin - np.cumsum(size) + size, size) + np.arange(int(size.sum()))


def extended(tokens: np.ndarray, begin: np.ndarray, window: np.ndarray, text: np.ndarray, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index into ``begin``, place in the items, words) of verbatim matches that can't be longer on either side, of each text the longest among them.

    Pairs of an occurrence and a place of the window in the items are made in parts of
    ``PAIRS``; those whose words before agree too belong to a match that begins there.
    A part leaves one match of each text: its longest, the first of them in the text,
    of the least item.
    """
    many = block.place_begin[window + 1] - block.place_begin[window]
    parts = np.searchsorted(np.cumsum(many), np.arange(PAIRS, int(many.sum()) + PAIRS, PAIRS))
    found = [], [], []
    lo = 0
    for hi in np.unique(np.minimum(parts + 1, len(begin))).tolist():
        at = np.repeat(np.arange(lo, hi), many[lo:hi])
        place = block.places[ranges(block.place_begin[window[lo:hi]], many[lo:hi])]
        a = np.where(begin[at] > 0, tokens[begin[at] - 1], 0)
        b = np.where(place > 0, block.tokens[place - 1], 0)
        first = (a != b) | (a == 0)
        at, place = at[first], place[first]
        length = block.window_length[window[at]].astype(np.int64)
        live = np.arange(len(at))
        while len(live):
            a = tokens[np.minimum(begin[at[live]] + length[live], len(tokens) - 1)]
            b = block.tokens[np.minimum(place[live] + length[live], len(block.tokens) - 1)]
            live = live[(a == b) & (a > 0)]
            length[live] += 1
        order = np.lexsort((block.item_of[place], begin[at], -length, text[at]))
        order = order[np.diff(text[at][order], prepend=-1) != 0]
        for x, v in zip(found, (at, place, length), strict=True):
            x.append(v[order])
        lo = hi
    return tuple(np.concatenate([*x, np.zeros(0, np.int64)]) for x in found)


def scan(c: Chunk, block: Block) -> Hits:
    c = c.lowered()
    starts, ends = c.spans(ALNUM_LOWER)
    first = c.per_text(starts)
    counts = np.diff(first)
    none = np.zeros(0, np.int64)
    empty = Hits(counts, none, none, none, np.zeros((0, 2), np.int64), np.zeros((0, 4), np.int64))
    if not len(starts) or not len(block.window_start):
        return empty
    word = c.hashes(starts, ends)
    maybe = np.flatnonzero(block.filter[(word >> np.uint64(44)).astype(np.int64)])
    slot = np.minimum(np.searchsorted(block.vocabulary, word[maybe]), len(block.vocabulary) - 1)
    known = block.vocabulary[slot] == word[maybe]
    at, ids = maybe[known], slot[known] + 1
    if not len(at):
        return empty
    text = np.searchsorted(first, at, "right") - 1
    cut = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (text[1:] != text[:-1])])
    run = np.cumsum(cut) - 1
    keep = np.bincount(run)[run] >= block.shortest
    at, ids, text, run = at[keep], ids[keep], text[keep], run[keep]
    if not len(at):
        return empty
    place = np.arange(len(at)) + np.cumsum(np.concatenate([[0], run[1:] != run[:-1]]))  # one gap between runs
    tokens = np.zeros(place[-1] + 2, np.int64)
    tokens[place] = ids
    back = np.zeros(len(tokens), np.int64)
    back[place] = np.arange(len(at))
    order = suffix_array(tokens, int(block.window_length.max()))
    windows = possible(tokens, block)
    low, high = search(tokens, order, block, windows)
    n = high - low
    window = np.repeat(windows, n)
    begin = order[ranges(low, n)]
    src = back[begin]
    in_text = np.unique(np.stack([text[src], window], 1), axis=0)
    many = block.place_begin[in_text[:, 1] + 1] - block.place_begin[in_text[:, 1]]
    items = np.stack([np.repeat(in_text[:, 0], many), block.item_of[block.places[ranges(block.place_begin[in_text[:, 1]], many)]]], 1)
    which, place, longest = extended(tokens, begin, window, text[src], block)
    src_of = src[which]
    matches = np.stack([text[src_of], longest, at[src_of] - first[text[src_of]], block.item_of[place]], 1)
    return Hits(counts, text[src], at[src] - first[text[src]], block.window_length[window].astype(np.int64), np.unique(items, axis=0), matches)


def blocks_of(benchmark: DataFrame, id_col: str, text_col: str, window: int, block_bytes: int) -> tuple[int, Iterator[Block]]:
    """How many blocks of about ``block_bytes`` of text the benchmark has; the blocks, fetched one at a time."""
    items = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = items.agg(F.sum(F.octet_length("text") + F.octet_length("item") + 16)).first()[0] or 0
    n = max(1, -(-size // block_bytes))

    def fetched() -> Iterator[Block]:
        for i in range(n):
            part = items if n == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == i)
            got = part.toArrow()
            yield build_block(got["item"].to_pylist(), got["text"].to_pylist(), window)

    return n, fetched()


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row of ``docs``: n_words, n_hit, items (sorted ids), and the longest verbatim match with its item and word number."""
    spark = docs.sparkSession
    bounded_batches(spark)
    n_blocks, blocks = blocks_of(benchmark, item_col, item_text_col, window, block_bytes)
    slim = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"), F.monotonically_increasing_id().alias("__row"))
    if n_blocks > 1:
        slim = materialise(slim, "decontaminate")  # fixes the row numbers over several scans
    span = T.ArrayType(T.StructType([T.StructField("from", T.LongType()), T.StructField("to", T.LongType())]))
    best = T.StructType([T.StructField("length", T.LongType()), T.StructField("word", T.LongType()), T.StructField("item", T.StringType())])
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("__row", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("spans", span), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("longest", best)])
    arrow_span = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
    arrow_best = pa.struct([("length", pa.int64()), ("word", pa.int64()), ("item", pa.string())])

    def one(bc):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = bc.value
            for b in returned(batches):
                if not b.num_rows:
                    continue
                words, spans, items, longest = [], [None] * b.num_rows, [None] * b.num_rows, [None] * b.num_rows
                for c in chunks(b.column(1), SHARD_BYTES):
                    h = scan(c, block)
                    words.append(h.n_words)
                    order = np.argsort(h.text, kind="stable")
                    for part in np.split(order, np.flatnonzero(np.diff(h.text[order])) + 1) if len(order) else ():
                        spans[c.lo + int(h.text[part[0]])] = union(h.word[part], h.word[part] + h.length[part])
                    for part in np.split(h.items, np.flatnonzero(np.diff(h.items[:, 0])) + 1) if len(h.items) else ():
                        items[c.lo + int(part[0, 0])] = sorted({block.item_ids[k] for k in part[:, 1].tolist()})
                    best = h.matches[np.lexsort((h.matches[:, 3], h.matches[:, 2], -h.matches[:, 1], h.matches[:, 0]))]
                    for t, length, word, item in best[np.diff(best[:, 0], prepend=-1) != 0].tolist():
                        longest[c.lo + t] = {"length": length, "word": word, "item": block.item_ids[item]}
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(2), pa.array(np.concatenate(words), pa.int64()), pa.array([x or [] for x in spans], arrow_span), pa.array([x or [] for x in items], pa.list_(pa.string())), pa.array(longest, arrow_best)],
                    names=[id_col, "__row", "n_words", "spans", "items", "longest"],
                )

        return run

    parts = []
    for block in blocks:
        sent = spark.sparkContext.broadcast(block)
        part = slim.mapInArrow(one(sent), schema)
        if n_blocks > 1:  # written, so that one block at a time is in memory
            part = materialise(part, "decontaminate-block")
            sent.destroy()
        parts.append(part)
    out = parts[0]
    if n_blocks > 1:
        for p in parts[1:]:
            out = out.unionByName(p)
        out = out.groupBy("__row").agg(
            F.any_value(id_col).alias(id_col), F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.max_by("longest", "longest.length").alias("longest"),
        )
    covered = F.aggregate(
        F.array_sort("spans"),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")),
        lambda acc, x: F.struct((acc["n"] + F.greatest(F.lit(0).cast("long"), x["to"] - F.greatest(x["from"], acc["end"]))).alias("n"), F.greatest(acc["end"], x["to"]).alias("end")),
        lambda acc: acc["n"],
    )
    return out.select(id_col, "n_words", covered.alias("n_hit"), "items", "longest")


def union(start: np.ndarray, end: np.ndarray) -> list[dict]:
    """The union of intervals as sorted disjoint intervals."""
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], start[1:] > reach[:-1]])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:] - 1, [len(start) - 1]])
    return [{"from": int(a), "to": int(b)} for a, b in zip(start[first], reach[last], strict=True)]


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs``, all columns, whose text holds no benchmark window."""
    spark = docs.sparkSession
    bounded_batches(spark)
    at = docs.columns.index(text_col)

    def one(bc):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = bc.value
            for b in returned(batches):
                keep = np.ones(b.num_rows, bool)
                for c in chunks(b.column(at), SHARD_BYTES):
                    keep[c.lo + scan(c, block).text] = False
                yield b.filter(pa.array(keep))

        return run

    out = docs
    n_blocks, blocks = blocks_of(benchmark, item_col, item_text_col, window, block_bytes)
    for block in blocks:
        sent = spark.sparkContext.broadcast(block)
        out = out.mapInArrow(one(sent), docs.schema)
        if n_blocks > 1:
            out = materialise(out, "decontaminated")
            sent.destroy()
    return out
