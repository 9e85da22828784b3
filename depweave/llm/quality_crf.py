"""Document quality from a linear-chain conditional random field over lines.

Every line is good (1) or bad (0).  A line's features are shares of character
classes, repetition and shape of its own and of the lines before and after it;
the chain adds weights for neighbouring labels.  The field is fitted on a bounded
sample of labelled documents whose lines carry their document's label, by
gradient ascent on the penalised conditional likelihood.  A document's score is
the mean over its lines, weighted by their length, of the marginal probability of
"good" from the forward-backward recursion.

Only texts enter the score.  Scoring is one pass without a shuffle; the weights
(some hundred numbers) are all that is sent out.

Defined results: a null or empty text is one blank line, whose marginal is the
score; repeated rows get a row each.  Without labelled rows of both classes the
weights stay zero and every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .labelled import in_fold, labelled_sample
from .textbytes import NOT_SPACE, Chunk, bounded_batches, chunks, duplicated, mix, returned

#: Bounds of the training sample: documents per class, and lines of a document, in runs of so many lines spread evenly over it.
SAMPLE_PER_CLASS = 1500
SAMPLE_LINES = 200
RUN_LINES = 20
#: Lines from which on a text's recursions run over segments side by side.
MANY_LINES = 2000
ROUNDS = 150
PENALTY = 1e-3

_ALL = np.zeros(256, bool)


def _table(chars: bytes) -> np.ndarray:
    t = _ALL.copy()
    t[list(chars)] = True
    return t


_UPPER, _LOWERCASE, _DIGIT = _table(bytes(range(65, 91))), _table(bytes(range(97, 123))), _table(b"0123456789")
_SYMBOLS, _STOPS, _COMMAS, _BANG, _PIPE, _SLASH = _table(b"#*$%&<>"), _table(b".?"), _table(b",;:"), _table(b"!"), _table(b"|"), _table(b"/@=_{}[]()")
_FAR = _ALL.copy()
_FAR[128:] = True
OWN = 19
WIDTH = 3 * OWN
_KEY = np.uint64(0x165667B19E3779F9)
_ROLL = np.uint64(0xC2B2AE3D27D4EB4F)


def line_columns(c: Chunk) -> tuple[Iterator[np.ndarray], np.ndarray, np.ndarray]:
    """(``OWN`` columns of features of the chunk's lines, one after another; text number, bytes of each line)."""
    start, end, text = c.lines()
    n = len(start)
    word_start, word_end = c.spans(NOT_SPACE)
    lo, hi = np.searchsorted(word_start, start), np.searchsorted(word_start, end)
    words = (hi - lo).astype(np.float32)
    some = np.maximum(words, 1)

    def within(table: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(table[c.data])
        return (np.searchsorted(at, end) - np.searchsorted(at, start)).astype(np.float32)

    size = (end - start).astype(np.float32)
    big = np.maximum(size, 1)
    upper, lower = within(_UPPER), within(_LOWERCASE)
    hashes = c.prefix_hash()
    word = hashes.of(word_start, word_end)
    line_of = np.repeat(np.arange(n), hi - lo)
    word_text = text[line_of].astype(np.uint64) if n else np.zeros(0, np.uint64)
    seen_in_line = duplicated(mix(word + line_of.astype(np.uint64) * _KEY), "first")
    as_before = np.zeros(len(word), bool)
    as_before[1:] = (word[1:] == word[:-1]) & (line_of[1:] == line_of[:-1])
    covered = np.zeros(len(word) + 3, np.int64)
    if len(word) > 2:
        gram = (word[:-2] * _ROLL + word[1:-1]) * _ROLL + word[2:]
        whole = word_text[2:] == word_text[:-2]
        at = np.flatnonzero(whole)
        hit = at[duplicated(mix(gram[at] + word_text[at] * _KEY), False)]
        covered += np.bincount(hit, minlength=len(covered)) - np.bincount(hit + 3, minlength=len(covered))
    covered = np.cumsum(covered)[: len(word)] > 0
    count = lambda x: np.bincount(line_of, x, n).astype(np.float32)
    line_again = duplicated(mix(hashes.of(start, end) + text.astype(np.uint64) * _KEY), "first") & (words > 0)
    last = c.data[np.maximum(word_end[np.maximum(hi - 1, 0)] - 1, 0)] if len(word) else np.zeros(n, np.uint8)
    first = c.data[word_start[np.minimum(lo, len(word) - 1)]] if len(word) else np.zeros(n, np.uint8)
    has = words > 0
    def columns() -> Iterator[np.ndarray]:
        yield np.ones(n, np.float32)
        yield np.log1p(words) / 4
        yield np.minimum(size / some / 10, 3)
        yield np.minimum(within(_SYMBOLS) / some, 3)
        yield np.minimum(within(_BANG) / some, 3)
        yield upper / np.maximum(upper + lower, 1)
        yield np.minimum(within(_DIGIT) / some, 2)
        yield np.minimum(within(_STOPS) / some, 1)
        yield np.minimum(within(_COMMAS) / some, 1)
        yield within(_FAR) / big
        yield np.minimum(within(_PIPE) / some, 1)
        yield np.minimum(within(_SLASH) / some, 2)
        yield count(seen_in_line) / some
        yield count(as_before) / some
        yield count(covered) / some
        yield line_again
        yield has & _STOPS[last]
        yield has & _UPPER[first]
        yield ~has

    return columns(), text, np.maximum(end - start, 0)


def line_features(c: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features with those of both neighbours, text number, bytes) for each line of the chunk."""
    columns, text, size = line_columns(c)
    own = np.stack([x.astype(np.float32) for x in columns], 1)
    full = np.zeros((len(text), WIDTH), np.float32)
    full[:, :OWN] = own
    near = np.flatnonzero(text[1:] == text[:-1])
    full[near + 1, OWN : 2 * OWN] = own[near]
    full[near, 2 * OWN :] = own[near + 1]
    return full, text, size


def line_scores(emission: np.ndarray, c: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(emission score, text number, bytes) of each line, one column of features at a time."""
    columns, text, size = line_columns(c)
    here, below, above = (np.zeros(len(text)) for _ in range(3))
    for i, x in enumerate(columns):
        for total, w in zip((here, below, above), emission[i::OWN], strict=True):
            if w:
                total += x * w
    same = text[1:] == text[:-1]
    here[1:] += np.where(same, below[:-1], 0)
    here[:-1] += np.where(same, above[1:], 0)
    return here, text, size


@dataclass
class Field:
    """Weights: of features for the label good against bad, and of neighbouring labels (bad/good by bad/good)."""

    emission: np.ndarray
    transition: np.ndarray


def marginals(field: Field, score: np.ndarray, text: np.ndarray) -> np.ndarray:
    """P(good) of each line; lines in order of text.

    The recursions of ordinary texts run side by side, line by line; those of a text
    of many lines run over its segments (:func:`segmented`).
    """
    begin = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]])) if len(text) else np.zeros(0, np.int64)
    size = np.diff(np.append(begin, len(text)))
    out = np.zeros(len(score))
    rest = np.ones(len(score), bool)
    for i in np.flatnonzero(size > MANY_LINES).tolist():
        at = slice(begin[i], begin[i] + size[i])
        out[at] = segmented(field, score[at])
        rest[at] = False
    out[rest] = _forward_backward(field, score[rest], text[rest])[0]
    return out


def _swept(first: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Row vectors before each step of a product of 2 x 2 matrices, each scaled to add up to one.

    The steps are cut into segments: products of all segments are made side by side,
    then the vectors at their begins by the same function, then those inside.
    """
    n = len(steps)
    wide = int(n**0.5) + 1
    if n <= 64:
        out = np.zeros((n, 2))
        v = first
        for t in range(n):
            out[t] = v
            v = v @ steps[t]
            v = v / v.sum()
        return out
    segments = -(-n // wide)
    padded = np.concatenate([steps, np.broadcast_to(np.eye(2), (segments * wide - n, 2, 2))]).reshape(segments, wide, 2, 2)
    whole = np.broadcast_to(np.eye(2), (segments, 2, 2))
    for t in range(wide):
        whole = whole @ padded[:, t]
        whole = whole / whole.sum((1, 2), keepdims=True)
    out = np.zeros((segments, wide, 2))
    v = _swept(first, whole)
    for t in range(wide):
        out[:, t] = v
        v = (v[:, None, :] @ padded[:, t])[:, 0]
        v = v / v.sum(1, keepdims=True)
    return out.reshape(-1, 2)[:n]


def segmented(field: Field, score: np.ndarray) -> np.ndarray:
    """P(good) of the lines of one text."""
    emit = np.stack([np.exp(-np.maximum(score, 0)), np.exp(np.minimum(score, 0))], 1)
    turn = np.exp(field.transition - field.transition.max())
    even = np.full(2, 0.5)
    # forward: before line t's own emission; backward: after it
    ahead = np.matmul(emit[:-1, :, None] * np.eye(2), turn[None])
    forward = np.concatenate([even[None], _swept(even, np.concatenate([ahead, np.eye(2)[None]]))[1:]])
    behind = np.matmul(emit[1:, :, None] * np.eye(2), turn.T[None])[::-1]
    backward = np.concatenate([even[None], _swept(even, np.concatenate([behind, np.eye(2)[None]]))[1:]])[::-1]
    p = forward * emit * backward
    return p[:, 1] / p.sum(1)


def _forward_backward(field: Field, score: np.ndarray, text: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Line marginals, and the sum of the marginals of neighbouring label pairs, weighted by their first lines."""
    pairs = np.zeros((2, 2))
    if not len(score):
        return np.zeros(0), pairs
    begin = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
    size = np.diff(np.append(begin, len(text)))
    order = np.argsort(-size, kind="stable")
    begin, size = begin[order], size[order]
    unary = np.stack([np.zeros(len(score)), score], 1)
    longest = int(size[0])
    live = np.searchsorted(-size, -np.arange(longest), "left")  # texts with more lines than t
    forward, backward = np.zeros((len(score), 2)), np.zeros((len(score), 2))
    forward[begin] = unary[begin]
    tr = field.transition
    for t in range(1, longest):
        at = begin[: live[t]] + t
        before = forward[at - 1]
        forward[at] = unary[at] + np.logaddexp(before[:, :1] + tr[0], before[:, 1:] + tr[1])
    for t in range(longest - 2, -1, -1):
        at = begin[: live[t + 1]] + t
        after = backward[at + 1] + unary[at + 1]
        backward[at] = np.logaddexp(after[:, :1] + tr[:, 0], after[:, 1:] + tr[:, 1])
    both = forward + backward
    total = np.logaddexp(both[:, 0], both[:, 1])
    inner = np.flatnonzero(text[1:] == text[:-1])
    if len(inner):
        p = forward[inner][:, :, None] + tr[None] + (unary + backward)[inner + 1][:, None, :] - total[inner][:, None, None]
        pairs = np.exp(p).sum(0) if weight is None else np.einsum("iab,i->ab", np.exp(p), weight[inner])
    return np.exp(both[:, 1] - total), pairs


def fit(features: np.ndarray, text: np.ndarray, good: np.ndarray, rounds: int = ROUNDS, penalty: float = PENALTY) -> Field:
    """Maximises the penalised conditional likelihood of line labels ``good`` by Adam steps.

    All lines of a text have one label; texts are weighted so that each class weighs alike.
    """
    field = Field(np.zeros(features.shape[1]), np.zeros((2, 2)))
    if not len(good) or good.all() or not good.any():
        return field
    same = text[1:] == text[:-1]
    weight = np.where(good, 0.5 / good.mean(), 0.5 / (1 - good.mean()))
    seen = np.zeros((2, 2))
    np.add.at(seen, (good[:-1][same].astype(int), good[1:][same].astype(int)), weight[:-1][same])
    n, theta = len(good), np.zeros(features.shape[1] + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    x = features.astype(np.float64)
    for k in range(1, rounds + 1):
        field = Field(theta[:-4], theta[-4:].reshape(2, 2))
        p, pairs = _forward_backward(field, x @ field.emission, text, weight)
        gradient = np.concatenate([x.T @ ((good - p) * weight) / n, (seen - pairs).ravel() / n]) - penalty * theta
        m = 0.9 * m + 0.1 * gradient
        v = 0.99 * v + 0.01 * gradient**2
        theta = theta + 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return Field(theta[:-4], theta[-4:].reshape(2, 2))


def document_scores(field: Field, c: Chunk) -> np.ndarray:
    score, text, size = line_scores(field.emission, c)
    p = marginals(field, score, text)
    n = c.hi - c.lo
    weight = size.astype(np.float64)
    blank = np.bincount(text, weight, n) == 0
    weight[blank[text]] = 1
    return np.clip(np.bincount(text, weight * p, n) / np.bincount(text, weight, n), 0, 1)


def fit_quality(docs: DataFrame, labels: DataFrame, exclude=None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = SAMPLE_PER_CLASS) -> Field:
    """Fits on at most ``per_class`` labelled documents of each class, with at most ``SAMPLE_LINES`` lines of each."""
    bounded_batches(docs.sparkSession)
    sample = labelled_sample(docs, labels, label_col, per_class, exclude, id_col, text_col, "quality-sample").select(id_col, "label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            label = b.column(1).to_numpy(zero_copy_only=False)
            for c in chunks(b.column(2)):
                x, text, _ = line_features(c)
                begin = np.searchsorted(text, np.arange(c.hi - c.lo))
                no = np.arange(len(text)) - begin[text]
                runs, most = -(-np.bincount(text, minlength=c.hi - c.lo)[text] // RUN_LINES), SAMPLE_LINES // RUN_LINES
                run = no // RUN_LINES
                keep = (runs <= most) | (run * most // runs != (run - 1) * most // runs)  # runs spread evenly
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(c.lo + text[keep])), pa.array(label[c.lo + text[keep]], pa.int32()), pa.array(no[keep], pa.int32()), pa.FixedSizeListArray.from_arrays(pa.array(x[keep].ravel()), WIDTH).cast(pa.list_(pa.float32()))],
                    names=["id", "label", "line", "x"],
                )

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("label", T.IntegerType()), T.StructField("line", T.IntegerType()), T.StructField("x", T.ArrayType(T.FloatType()))])
    got = sample.mapInArrow(run, schema).toArrow().sort_by([("id", "ascending"), ("line", "ascending")])
    if not got.num_rows:
        return Field(np.zeros(WIDTH), np.zeros((2, 2)))
    x = got["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, WIDTH)
    line = got["line"].to_numpy()
    text = np.cumsum(np.diff(line, prepend=-2) != 1)  # a run of lines is a chain
    return fit(x, text, got["label"].to_numpy() == 1)


def score(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) per row."""
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in returned(batches):
            if b.num_rows:
                p = np.concatenate([document_scores(sent.value, c) for c in chunks(b.column(1))])
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p)], names=[id_col, "score"])

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, T.StructType([docs.schema[id_col], T.StructField("score", T.DoubleType())]))


def keep_good(docs: DataFrame, field: Field, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows, all columns, that score at least ``least``."""
    bounded_batches(docs.sparkSession)
    sent, at = docs.sparkSession.sparkContext.broadcast(field), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in returned(batches):
            if b.num_rows:
                p = np.concatenate([document_scores(sent.value, c) for c in chunks(b.column(at))])
                yield b.filter(pa.array(p >= least))

    return docs.mapInArrow(run, docs.schema)


def quality_scores(docs: DataFrame, labels: DataFrame, modulus: int = 3, remainder: int = 1, id_col: str = "doc_id") -> DataFrame:
    """Scores of all rows by a field that never saw labels of the held-out fold."""
    held = in_fold(id_col, modulus, remainder)
    return score(docs, fit_quality(docs, labels, held, id_col), id_col).select(id_col, held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
