"""SimHash near-duplicates, linked by Golay-code fuzzy hashing.

A fingerprint of 64 bits is cut into three segments of 22, 21 and 21 bits.  If two
fingerprints differ in two bits at most, then some segment i is equal while the
next one differs in one bit at most (pigeonhole: with both errors in one segment
the other two are equal; with the errors in two segments the third is equal, and
going round, the segment after it has one error).  So a key is made of segment i
exactly and of the index of a Golay codeword near the next segment.  The perfect
binary Golay code [23, 12, 7] decodes any 23 bits to one codeword within three
bits.  A segment whose nearest codeword is three bits off has five more codewords
at four bits; the six make its keys.  If x and y differ in one bit, y's own
codeword is always among the keys of x, so one side of the join carries the one
codeword and the other side all of them.  Candidates are verified by popcount.

A key that more than ``BUCKET`` different fingerprints share would give pairs
with the square of the group.  All fingerprints of such keys are linked exactly in
another way: each emits itself and its 64 one-bit neighbours; two fingerprints
share one of these points exactly if they differ in two bits at most, and no point
has over 65 fingerprints.

Texts with equal fingerprints are one node throughout, so copies cost nothing.

Two bits of 64 are near copies in the strictest sense: texts of a Jaccard similarity of
0.8 differ in about ten, which no selective key bears.  :func:`drop_near_duplicates` can
therefore add links by similarity: of each text's sorted different shingle hashes the
first ``SKETCH`` make small blocks, every three neighbours one, SimHashed by majority;
texts that share a block are compared by their whole sets of shingles.

Defined results: null or empty texts have fingerprint zero and link like any
other; rows with the same id each get a row; a null id takes part, and its
component is the least id that is not null (null if there is none).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from depweave.session import materialise

from .blocks import block_pairs, longer_side, rest_pairs, sent
from .components import connected_components
from .textbytes import bounded_batches

SHINGLE = 3
SEED = 42
MOST_BITS = 2
BUCKET = 16
#: Shingles of a text, the first by hash, that make its blocks.
SKETCH = 24
#: Widths of the segments from the top bit down, and how far each is shifted right.
SEGMENTS = ((22, 42), (21, 21), (21, 0))

_GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
_ONE_BIT = np.uint64(1) << np.arange(64, dtype=np.uint64)


def _golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndrome of each 23-bit word's low and high part, and the error patterns to the codewords that make its keys."""

    def rest(x: int) -> int:
        for i in range(22, 10, -1):
            if x >> i & 1:
                x ^= _GENERATOR << (i - 11)
        return x

    unit = np.array([rest(1 << i) for i in range(23)], np.int64)
    low, high = np.zeros(1 << 12, np.int64), np.zeros(1 << 11, np.int64)
    for i in range(12):
        low[1 << i : 2 << i] = low[: 1 << i] ^ unit[i]
    for i in range(11):
        high[1 << i : 2 << i] = high[: 1 << i] ^ unit[12 + i]
    patterns = np.zeros((2048, 6), np.int64)
    weight = np.zeros(2048, np.int64)
    four: list[list[int]] = [[] for _ in range(2048)]
    positions = range(23)
    for i in positions:
        patterns[unit[i], 0], weight[unit[i]] = 1 << i, 1
        for j in range(i):
            s = unit[i] ^ unit[j]
            patterns[s, 0], weight[s] = 1 << i | 1 << j, 2
            for k in range(j):
                s3 = s ^ unit[k]
                patterns[s3, 0], weight[s3] = 1 << i | 1 << j | 1 << k, 3
                for m in range(k):
                    four[s3 ^ unit[m]].append(1 << i | 1 << j | 1 << k | 1 << m)
    patterns[0, 0] = 0
    for s in range(2048):
        if weight[s] == 3:
            patterns[s, 1:] = four[s]  # five words of weight four share a syndrome with one of weight three
    return low, high, np.concatenate([patterns, weight[:, None]], 1)


_LOW, _HIGH, _PATTERNS = _golay()


def golay_keys(fingerprints: np.ndarray, several: bool) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, keys): per segment pair the exact segment and one or all near codewords of the next."""
    rows, keys = [], []
    parts = [(fingerprints >> np.uint64(shift)).astype(np.int64) & ((1 << width) - 1) for width, shift in SEGMENTS]
    for i in range(3):
        exact, near = parts[i], parts[(i + 1) % 3]
        syndrome = _LOW[near & 0xFFF] ^ _HIGH[near >> 12]
        pattern = _PATTERNS[syndrome]
        for k in range(6 if several else 1):
            at = np.flatnonzero((pattern[:, 6] == 3) | (k == 0))
            index = (near[at] ^ pattern[at, k]) >> 11  # the code is systematic: the upper 12 bits tell the codeword
            rows.append(at)
            keys.append((i << 34 | exact[at] << 12 | index).astype(np.int64))
    return np.concatenate(rows), np.concatenate(keys)


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """The fingerprint of one text: words without white space, ASCII lower-cased, in shingles."""
    h = shingle_hashes(text, size)
    if not len(h):
        return 0
    votes = np.zeros(64, np.int64)
    for lo in range(0, len(h), 1 << 16):
        votes += np.unpackbits(h[lo : lo + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(_ONE_BIT[2 * votes > len(h)].sum(dtype=np.uint64))


def fingerprints(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), size: int = SHINGLE) -> DataFrame:
    """The kept columns and ``fp``, the fingerprint's bits as a long."""
    bounded_batches(docs.sparkSession)
    slim = docs.select(*keep, F.col(text_col).cast("string").alias("__text"))
    schema = T.StructType([*[docs.schema[k] for k in keep], T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(x.as_py(), size) for x in b.column(len(keep))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(keep))], pa.array(fp, pa.int64())], names=[*keep, "fp"])

    return slim.mapInArrow(run, schema)


def _keys(fps: DataFrame, several: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False)
            rows, keys = golay_keys(fp.view(np.uint64), several)
            yield pa.RecordBatch.from_arrays([pa.array(fp[rows]), pa.array(keys)], names=["fp", "key"])

    return fps.select("fp").mapInArrow(run, "fp long, key long")


def links(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(a, b) between different fingerprints: every pair within two bits, or such pairs and points that connect them.

    ``fps`` has each fingerprint once in a column ``fp``.
    """
    own = materialise(_keys(fps, False), "golay-own")
    near = materialise(_keys(fps, True), "golay-near")
    crowded = materialise(own.groupBy("key").count().where(F.col("count") > bucket).select("key"), "golay-crowded")
    few = materialise(own.join(crowded, "key", "left_anti").select("key", F.col("fp").alias("other")), "golay-few")
    pairs = near.join(few, "key").where((F.col("fp") != F.col("other")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= MOST_BITS))
    pairs = pairs.select(F.least("fp", "other").alias("a"), F.greatest("fp", "other").alias("b"))
    dense = near.join(crowded, "key", "left_semi").select("fp").distinct()
    ball = [F.lit(0).cast("long"), *[F.lit(int(x)).cast("long") for x in _ONE_BIT.view(np.int64)]]
    points = dense.select("fp", F.explode(F.array(*ball)).alias("bit")).select("fp", F.col("fp").bitwiseXOR(F.col("bit")).alias("point"))
    least = points.groupBy("point").agg(F.min("fp").alias("a"), F.max("fp").alias("z"), F.collect_set("fp").alias("all")).where("a <> z")
    stars = least.select("a", F.explode("all").alias("b")).where("a <> b")
    return pairs.unionByName(stars)


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """The hashes of a text's shingles, repeats included."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    shingles = [b" ".join(words)] if len(words) < size else map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False))
    return np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64, max(1, len(words) - size + 1))


def block_fingerprints(hashes: np.ndarray) -> np.ndarray:
    """SimHashes of every three neighbours among the first ``SKETCH`` sorted different hashes; of one or two, one block."""
    h = np.unique(hashes)[:SKETCH]
    if len(h) < 3:
        return np.array([h.sum(dtype=np.uint64)]) if len(h) else h
    a, b, c = h[:-2], h[1:-1], h[2:]
    return (a & b) | (c & (a | b))


def similar_links(docs: DataFrame, text_col: str, size: int, similarity: float, bucket: int) -> DataFrame:
    """(a, b) that connect the fingerprints whose texts' sets of shingles have a Jaccard similarity of at least ``similarity``.

    ``docs`` has one text per fingerprint in columns ``fp`` and ``text_col``, equal rows
    of it count once.  The candidates share the SimHash of a block of shingles
    (:mod:`.blocks`): all pairs of crowded blocks that the links of the others leave in
    different groups are compared as well.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes = [shingle_hashes(x.as_py(), size) for x in b.column(1)]
            keys = [block_fingerprints(h).view(np.int64) for h in hashes]
            parts = [b.column(0), pa.array([len(np.unique(h)) for h in hashes], pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(parts, names=["item", "size", "keys"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = np.unique(shingle_hashes(x.as_py(), size)), np.unique(shingle_hashes(y.as_py(), size))
                common = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(common >= similarity * (len(x) + len(y) - common) - 1e-9)
            yield pa.RecordBatch.from_arrays(b.columns[:2], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    def verified(pairs: DataFrame) -> DataFrame:
        wanted = materialise(pairs.select(F.col("a").alias("fp")).unionByName(pairs.select(F.col("b").alias("fp"))).distinct(), "near-wanted")
        own = materialise(texts.join(sent(wanted), "fp").dropDuplicates(["fp"]), "near-texts")
        both = pairs.join(own.select(F.col("fp").alias("a"), F.col("text").alias("ta")), "a").join(own.select(F.col("fp").alias("b"), F.col("text").alias("tb")), "b")
        return materialise(both.select("a", "b", "ta", "tb").mapInArrow(verify, "a long, b long"), "near-links")

    texts = docs.select("fp", F.col(text_col).cast("string").alias("text"))
    blocks = materialise(texts.mapInArrow(run, "item long, size long, keys array<long>"), "near-blocks").dropDuplicates(["item"])
    members = materialise(blocks.select("item", "size", F.explode("keys").alias("key")), "near-members")
    fits = longer_side(similarity)
    pairs, crowded = block_pairs(members, fits, bucket, "near")
    near = verified(materialise(pairs.distinct(), "near-pairs"))
    rest = rest_pairs(crowded, connected_components(near, "near-rounds"), fits, "near")
    return near.unionByName(verified(rest)) if not rest.isEmpty() else near


def _grouped(marked: DataFrame, id_col: str, bucket: int, more: DataFrame | None = None) -> DataFrame:
    """(fp, root, component_id) for fingerprinted rows: the group of each fingerprint and the least id in it; ``more``: further links."""
    classes = materialise(marked.groupBy("fp").agg(F.min(id_col).alias("least")), "fingerprint-classes")
    near = links(classes, bucket)
    roots = connected_components(near if more is None else near.unionByName(more), "simhash")
    rooted = materialise(classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "fingerprint-roots")
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return materialise(rooted.join(ids, "root").select("fp", "root", "component_id"), "fingerprint-components")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, bucket: int = BUCKET) -> DataFrame:
    """Per row: the id, ``fp`` and ``component_id``, the least id of all rows reachable over links."""
    marked = materialise(fingerprints(docs, text_col, (id_col,), size), "fingerprints")
    return marked.join(_grouped(marked, id_col, bucket), "fp").select(id_col, "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, bucket: int = BUCKET, similarity: float | None = None) -> DataFrame:
    """One row of each group of near duplicates, all columns: that with the least id.

    Links are those of the fingerprints and, with a ``similarity``, also those of
    :func:`similar_links`.  Rows without an id come last; of rows that tie, the one with
    the least hash of id and text stays, and of rows equal in both any one.
    """
    slim = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    row = F.xxhash64("id", "text")
    marked = materialise(fingerprints(slim.withColumn("row", row), "text", ("id", "row"), size), "fingerprints")
    more = None
    if similarity is not None:
        rows = materialise(marked.groupBy("fp").agg(F.min("row").alias("row")), "near-rows")
        texts = slim.withColumn("row", row).join(sent(rows), "row")
        more = similar_links(texts, "text", size, similarity, bucket)
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row"))
    stay = marked.join(_grouped(marked, "id", bucket, more), "fp").groupBy("root").agg(first.alias("first")).select(F.col("first.row").alias("kept"))
    stay = materialise(stay, "near-kept")
    whole = docs.select(F.struct("*").alias("doc"), F.xxhash64(docs[id_col], docs[text_col].cast("string")).alias("row")).join(sent(stay.select(F.col("kept").alias("row"))), "row", "left_semi")
    repeated = sent(materialise(marked.groupBy("row").count().where(F.col("count") > 1).select("row"), "near-repeated"))
    # only rows equal in id and text are grouped, so the other texts need no shuffle
    one = whole.join(repeated, "row", "left_semi").dropDuplicates(["row"])
    return whole.join(repeated, "row", "left_anti").unionByName(one).select("doc.*")
