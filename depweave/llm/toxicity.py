"""A toxicity classifier whose score stays put when an identity term is swapped.

Features of a text are its lower-cased words and their beginnings of 4 to 8
bytes, counted as log(1 + occurrences), and the logarithm of its length.  On a
bounded sample of labelled texts the features that differ most between the
classes are chosen (by the likelihood-ratio statistic) and weighed by penalised
logistic regression.  The counterfactual term: every sentence of the sample that
mentions a group is written again with the mention swapped for each other term of its
list, both are read like texts, and the squared difference of their scores is penalised.
The bare term counts as one more sentence, so that terms the sample lacks are held
together too.  Mentioning a group, whichever, then cannot make a text toxic by itself.
Lists of terms are an argument; those that come along are in four languages.

Only texts enter the score.  Scoring is one pass without a shuffle; the model has a
weight for each feature whose classes differ by ``LEAST_GAIN`` in the bounded sample.

Defined results: a null or empty text scores as a text of no words; repeated rows
get a row each.  Without labelled rows of both classes every score is 0.5.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .labelled import in_fold, labelled_sample
from .textbytes import ALNUM_LOWER, Chunk, bounded_batches, chunks, mix

#: Bound: documents per class in the sample.
SAMPLE_PER_CLASS = 3000
#: Least likelihood-ratio statistic of a feature.
LEAST_GAIN = 4.0
PREFIXES = (4, 5, 6, 7, 8)
PENALTY = 2e-4
COUNTERFACTUAL = 0.05
ROUNDS = 250

#: Terms that may be swapped for each other, by list (fixed values).
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys", "transgender"),
    ("woman", "man", "girl", "boy"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist", "catholic"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists", "catholics"),
    ("black", "white", "asian", "latino", "african", "european", "arab", "indigenous"),
    ("gay", "straight", "lesbian", "bisexual", "queer"),
    ("immigrant", "refugee", "migrant", "foreigner", "native"),
    ("immigrants", "refugees", "migrants", "foreigners", "natives"),
    ("old", "young", "elderly", "teenage"),
    ("disabled", "deaf", "blind", "autistic"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("christen", "muslime", "juden", "hindus", "buddhisten", "atheisten", "katholiken"),
    ("ausländer", "flüchtlinge", "einwanderer", "deutsche", "türken", "araber"),
    ("femmes", "hommes", "filles", "garçons"),
    ("chrétiens", "musulmans", "juifs", "hindous", "bouddhistes", "athées", "catholiques"),
    ("étrangers", "réfugiés", "immigrés", "français", "arabes", "africains"),
    ("mujeres", "hombres", "niñas", "niños"),
    ("cristianos", "musulmanes", "judíos", "hindúes", "budistas", "ateos", "católicos"),
    ("extranjeros", "refugiados", "inmigrantes", "españoles", "árabes", "africanos"),
)


@dataclass
class Toxicity:
    """Sorted feature hashes with their weights; bias, weight of the length."""

    features: np.ndarray
    weights: np.ndarray
    bias: float
    length: float

    def __post_init__(self) -> None:
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.features >> np.uint64(44)).astype(np.int64)] = True


def word_features(c: Chunk) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text numbers, feature hashes, words of each text) for whole words, then for each length of beginning."""
    start, end = c.spans(ALNUM_LOWER)
    counts = np.diff(c.per_text(start))
    text = np.repeat(np.arange(c.hi - c.lo), counts)
    hashes = c.prefix_hash()
    yield text, mix(hashes.of(start, end)), counts
    for k in PREFIXES:
        at = np.flatnonzero(end - start > k)
        yield text[at], mix(hashes.of(start[at], start[at] + k) + np.uint64(k)), counts


def found(c: Chunk, features: np.ndarray, filter_: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature number, occurrences) for the model's features, and words per text."""
    keys, counts = [], None
    for text, h, counts in word_features(c):  # noqa: B007
        maybe = np.flatnonzero(filter_[(h >> np.uint64(44)).astype(np.int64)])
        slot = np.minimum(np.searchsorted(features, h[maybe]), max(len(features) - 1, 0))
        hit = features[slot] == h[maybe] if len(features) else np.zeros(0, bool)
        keys.append(text[maybe][hit] * (len(features) + 1) + slot[hit])
    key, n = np.unique(np.concatenate(keys), return_counts=True)
    return key // (len(features) + 1), key % (len(features) + 1), n, counts


def _lower(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(column.cast(pa.large_string()))


def alternatives(lists) -> dict[str, list[str]]:
    """Term -> what it may be swapped for: the other terms of each list that has it."""
    other: dict[str, list[str]] = {}
    for group in lists:
        for t in group:
            other.setdefault(t, []).extend(x for x in group if x != t and x not in other[t])
    return other


def mentions_of(other: dict[str, list[str]]) -> re.Pattern:
    return re.compile(r"\b(?:" + "|".join(re.escape(t) for t in sorted(other, key=len, reverse=True)) + r")\b")


def swapped_sentences(text: str, lists) -> Iterator[tuple[str, str]]:
    """(sentence, the same with one mention swapped) for every mention of a term and every other term of its lists; ``text`` in lower case.

    The plain form of what :func:`sentence_changes` counts without a copy of any sentence.
    """
    other = alternatives(lists)
    if not other:
        return
    mention = mentions_of(other)
    for sentence in re.split(r"[.!?\n]+", text):
        for m in mention.finditer(sentence):
            for t in other[m[0]]:
                yield sentence, sentence[: m.start()] + t + sentence[m.end() :]


def _counts(texts: list[str], features: np.ndarray, filter_: np.ndarray) -> list[dict[int, int]]:
    """Per text: feature number -> occurrences."""
    out: list[dict[int, int]] = [{} for _ in texts]
    for c in chunks(pa.array(texts, pa.string())):
        text, slot, n, _ = found(c, features, filter_)
        for t, f, v in zip((c.lo + text).tolist(), slot.tolist(), n.tolist(), strict=True):
            out[t][f] = v
    return out


#: What a mention is counted in: the bytes that features hold to be one word, that is all but ASCII other than a-z and digits.
_WORD = re.compile(r"[a-z0-9\x80-\U0010ffff]*")


def sentence_changes(text: str, lists, features: np.ndarray, filter_: np.ndarray) -> Iterator[tuple[tuple[int, ...], tuple[float, ...], int]]:
    """(feature numbers, changes of their values, how many swaps make them) over the swaps of :func:`swapped_sentences`.

    A swap changes nothing but the word it stands in, so a sentence is counted once and each different word with a
    mention once for each other term; the memory is that of one sentence, however many mentions it has.
    """
    other = alternatives(lists)
    if not other:
        return
    mention = mentions_of(other)
    for sentence in re.split(r"[.!?\n]+", text):
        swaps: Counter[tuple[str, str]] = Counter()
        for m in mention.finditer(sentence):
            begin = m.start()
            while begin and _WORD.fullmatch(sentence[begin - 1]):
                begin -= 1
            end = _WORD.match(sentence, m.end()).end()
            for t in other[m[0]]:
                swaps[sentence[begin:end], sentence[begin : m.start()] + t + sentence[m.end() : end]] += 1
        if not swaps:
            continue
        (whole,) = _counts([sentence], features, filter_)
        words = list(dict.fromkeys(w for pair in swaps for w in pair))
        inside = dict(zip(words, _counts(words, features, filter_), strict=True))
        for (a, b), times in swaps.items():
            gone, come = inside[a], inside[b]
            by = {f: round(np.log1p(whole.get(f, 0) - gone.get(f, 0) + come.get(f, 0)) - np.log1p(whole.get(f, 0)), 9) for f in sorted({*gone, *come})}
            if by := {f: float(v) for f, v in by.items() if abs(v) > 1e-9}:
                yield tuple(by), tuple(by.values()), times


def changes(pairs: list[tuple[str, str]], features: np.ndarray, filter_: np.ndarray) -> Iterator[tuple[list[int], list[float]]]:
    """(feature numbers, changes of their values) from a sentence to its swapped form, where the model sees one."""
    for lo in range(0, len(pairs), 2000):
        part = pairs[lo : lo + 2000]
        values: list[dict[int, float]] = [{} for _ in part]
        for side, sign in ((0, -1.0), (1, 1.0)):
            for c in chunks(pa.array([p[side] for p in part], pa.string())):
                text, slot, n, _ = found(c, features, filter_)
                for t, f, v in zip((c.lo + text).tolist(), slot.tolist(), np.log1p(n).tolist(), strict=True):
                    values[t][f] = values[t].get(f, 0.0) + sign * v
        for x in values:
            if changed := {f: round(v, 9) for f, v in sorted(x.items()) if abs(v) > 1e-9}:
                yield list(changed), list(changed.values())


def fit(text: np.ndarray, slot: np.ndarray, count: np.ndarray, words: np.ndarray, label: np.ndarray, swaps: np.ndarray | tuple, n_features: int, counterfactual: float = COUNTERFACTUAL) -> tuple[np.ndarray, float, float]:
    """Weights, bias, length weight.

    ``swaps``: a row per change of features from a sentence to its swapped form, by the root of its weight; a matrix, or
    its other than zero entries as (number of rows, rows, columns, values).
    """
    if isinstance(swaps, np.ndarray):
        swaps = (len(swaps), *np.nonzero(swaps), swaps[np.nonzero(swaps)])
    n_swaps, at, of, by = swaps
    x, length = np.log1p(count.astype(np.float64)), np.log1p(words.astype(np.float64))
    n = len(label)
    weight = np.where(label == 1, 0.5 / max(label.mean(), 1e-9), 0.5 / max(1 - label.mean(), 1e-9))
    theta = np.zeros(n_features + 2)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, ROUNDS + 1):
        z = np.bincount(text, x * theta[slot], n) + theta[-2] + theta[-1] * length
        e = (label - 1 / (1 + np.exp(-np.clip(z, -40, 40)))) * weight / n
        change = np.bincount(at, by * theta[of], n_swaps)
        g = np.concatenate([np.bincount(slot, x * e[text], n_features) - PENALTY * theta[:-2] - counterfactual * np.bincount(of, by * change[at], n_features), [e.sum(), (e * length).sum()]])
        m = 0.9 * m + 0.1 * g
        v = 0.99 * v + 0.01 * g**2
        theta = theta + 0.05 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-9)
    return theta[:-2], float(theta[-2]), float(theta[-1])


def fit_toxicity(docs: DataFrame, labels: DataFrame, exclude=None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = SAMPLE_PER_CLASS, identity_terms=IDENTITY_TERMS, counterfactual: float = COUNTERFACTUAL) -> Toxicity:
    """Fits on at most ``per_class`` labelled documents of each class."""
    bounded_batches(docs.sparkSession)
    sample = labelled_sample(docs, labels, label_col, per_class, exclude, id_col, text_col, "toxicity-sample").select(id_col, "label", "text")
    size = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    nothing = Toxicity(np.zeros(0, np.uint64), np.zeros(0), 0.0, 0.0)
    if len(size) < 2:
        return nothing
    n1, n0 = size[1], size[0]

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            label = b.column(1).to_numpy(zero_copy_only=False)
            for c in chunks(_lower(b.column(2))):
                for text, h, _ in word_features(c):
                    once = np.unique(np.stack([text.astype(np.uint64), h], 1), axis=0) if len(h) else np.zeros((0, 2), np.uint64)
                    yield pa.RecordBatch.from_arrays([pa.array(once[:, 1].view(np.int64)), pa.array(label[c.lo + once[:, 0].astype(np.int64)].astype(np.int64))], names=["h", "toxic"])

    counts = sample.mapInArrow(seen, "h long, toxic long").groupBy("h").agg(F.sum("toxic").alias("a"), (F.count("*") - F.sum("toxic")).alias("b")).where("a + b >= 3")

    def term(k, n, p):
        return F.when(k > 0, k * F.log(k / (n * p))).otherwise(0.0)

    rate = (F.col("a") + F.col("b")) / F.lit(float(n1 + n0))
    gain = term(F.col("a"), float(n1), rate) + term(n1 - F.col("a"), float(n1), 1 - rate) + term(F.col("b"), float(n0), rate) + term(n0 - F.col("b"), float(n0), 1 - rate)
    top = counts.where((F.col("a") < n1) | (F.col("b") < n0)).select("h", gain.alias("gain")).where(F.col("gain") > LEAST_GAIN).toArrow()  # of a bounded sample
    features = np.sort(top["h"].to_numpy().view(np.uint64))
    bare = Toxicity(features, np.zeros(len(features)), 0.0, 0.0)

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            low = _lower(b.column(2))
            for c in chunks(low):
                text, slot, n, words = found(c, bare.features, bare.filter)
                begin = np.searchsorted(text, np.arange(c.hi - c.lo + 1))
                lists = lambda x: pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(x, pa.int64()))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([b.column(0)[c.lo : c.hi], b.column(1)[c.lo : c.hi], pa.array(words, pa.int64()), lists(slot), lists(n)], names=["id", "label", "words", "slot", "n"])

    def swapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in _lower(b.column(2)):
                times: Counter[tuple] = Counter()
                for f, v, n in sentence_changes(x.as_py() or "", identity_terms, bare.features, bare.filter):
                    times[f, v] += n
                yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in times], pa.list_(pa.int64())), pa.array([v for _, v in times], pa.list_(pa.float64())), pa.array(times.values(), pa.int64())], names=["slots", "by", "times"])

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("label", T.IntegerType()), T.StructField("words", T.LongType()), T.StructField("slot", T.ArrayType(T.LongType())), T.StructField("n", T.ArrayType(T.LongType()))])
    got = sample.mapInArrow(chosen, schema).toArrow().sort_by("id")
    flat = lambda x: got[x].combine_chunks().flatten().to_numpy()
    text = np.repeat(np.arange(got.num_rows), pc.list_value_length(got["slot"]).to_numpy())
    # equal changes count together: as many rows as there are pairs of terms, and of counts in a sentence
    change = sample.mapInArrow(swapped, "slots array<long>, by array<double>, times long").groupBy("slots", "by").agg(F.sum("times").alias("times")).toArrow()
    terms = [(t, x) for t, others in alternatives(identity_terms).items() for x in others]
    rows = sorted([*zip(change["slots"].to_pylist(), change["by"].to_pylist(), change["times"].to_pylist(), strict=True), *((f, v, 1) for f, v in changes(terms, bare.features, bare.filter))])
    entries = [(i, f, v * np.sqrt(n)) for i, (fs, vs, n) in enumerate(rows) for f, v in zip(fs, vs, strict=True)]
    swaps = (len(rows), *(np.array([e[k] for e in entries], kind) for k, kind in enumerate((np.int64, np.int64, np.float64))))
    w, bias, length = fit(text, flat("slot"), flat("n"), got["words"].to_numpy(), got["label"].to_numpy(), swaps, len(features), counterfactual)
    return Toxicity(features, w, bias, length)


def text_scores(model: Toxicity, c: Chunk) -> np.ndarray:
    text, slot, n, words = found(c, model.features, model.filter)
    z = model.bias + model.length * np.log1p(words.astype(np.float64))
    if len(slot):
        z = z + np.bincount(text, np.log1p(n.astype(np.float64)) * model.weights[slot], c.hi - c.lo)
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def score(docs: DataFrame, model: Toxicity, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) per row."""
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                p = np.concatenate([text_scores(sent.value, c) for c in chunks(_lower(b.column(1)))])
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p)], names=[id_col, "score"])

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, T.StructType([docs.schema[id_col], T.StructField("score", T.DoubleType())]))


def toxicity_scores(docs: DataFrame, labels: DataFrame, modulus: int = 5, remainder: int = 0, id_col: str = "doc_id") -> DataFrame:
    """Scores of all rows by a model that never saw labels of the held-out fold."""
    held = in_fold(id_col, modulus, remainder)
    return score(docs, fit_toxicity(docs, labels, held, id_col), id_col).select(id_col, held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
