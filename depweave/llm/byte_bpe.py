"""Byte-level BPE by a sentencepiece model that is written straight from a vocabulary of ranks.

A rank file lists byte strings by merge rank.  Each becomes a piece of a sentencepiece BPE
model: its bytes mapped to characters one for one, its score the negative rank.  As that
model merges the pair of the highest score, and a rank vocabulary the pair of the least
rank, both make the same pieces.  The model normalises nothing and splits nothing; texts
are split into pre-tokens before, and a pre-token that is itself in the vocabulary is its
own token.  Nothing is trained, and the model exists only in the memory of the tasks.

Decoding is the inverse mapping: the bytes of each id, one after another.

Each row depends on itself alone: no shuffle.  A worker keeps the ids of a bounded number
of short pre-tokens; a long text is split lazily, so no list of all its pre-tokens exists.

Defined results: a null text is an empty text, which has no ids; null ids decode to no
bytes; repeated rows each give a row; an empty table gives no rows; other columns are
ignored.  An id outside the vocabulary ends the job with a ``KeyError``.
"""

from __future__ import annotations

import base64
import re
import struct
from collections.abc import Iterator
from itertools import batched

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textbytes import bounded_batches, returned

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Pre-tokens whose ids a worker keeps, and the characters of the longest that is kept.
KEPT, KEPT_CHARS = 200_000, 64
#: Texts of more characters are split lazily; ids are decoded so many at a time.
LONG_TEXT, IDS_AT_ONCE = 1_000_000, 1 << 16

#: Ranges of characters that ``regex`` holds to be letters or numbers and the character tables (Unicode 16) of
#: the library whose ids are to be matched do not.
LATER = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF),
    (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959),
    (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F),
    (0x12550, 0x12686), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2),
    (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96),
    (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F),
    (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
)
_LATER_SET = "[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in LATER) + "]"

#: Byte b is the character U+0100 + b: letters that no normalisation and no splitting touches.
_MAPPED = {b: 0x100 + b for b in range(256)}

_coders: dict[tuple[str, str], Coder] = {}


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def read_ranks(path: str) -> dict[bytes, int]:
    """Byte string -> id, of a file with a base64 string and a rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def mapped(data: bytes) -> str:
    return data.decode("latin-1").translate(_MAPPED)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _nested(number: int, body: bytes) -> bytes:
    """A length-delimited field of a protocol buffer."""
    return _varint(number << 3 | 2) + _varint(len(body)) + body


def _integer(number: int, value: int) -> bytes:
    return _varint(number << 3) + _varint(value)


def _float(number: int, value: float) -> bytes:
    return _varint(number << 3 | 5) + struct.pack("<f", value)


def serialise(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece model whose piece 0 is the unknown one and whose piece i + 1 is the i-th byte string by rank.

    Scores are 32-bit floats, which tell ranks below 2**24 apart.
    """
    if ranks and max(ranks.values()) >= 1 << 24:
        raise ValueError("ranks of 2**24 and more have no score of their own")
    unknown, bpe = 2, 2  # members of the format's enumerations of piece types and model types
    pieces = [_nested(1, b"<unk>") + _float(2, 0.0) + _integer(3, unknown)]
    pieces += [_nested(1, mapped(token).encode()) + _float(2, -float(rank)) for token, rank in sorted(ranks.items(), key=lambda x: x[1])]
    trainer = _integer(3, bpe) + _integer(40, 0)  # the unknown piece has id 0
    normaliser = _nested(1, b"identity") + _integer(3, 0) + _integer(4, 0) + _integer(5, 0)  # no dummy prefix, white space kept as it is
    return b"".join(_nested(1, p) for p in pieces) + _nested(2, trainer) + _nested(3, normaliser)


class Coder(dict):
    """Pre-token -> its ids as little-endian unsigned 32-bit integers; fills itself up to ``KEPT``."""

    def __init__(self, path: str, pattern: str):
        ranks = read_ranks(path)
        self.split = regex.compile(pattern)
        self.later = re.compile(_LATER_SET)
        older = {rf"\p{{{c}}}": rf"[\p{{{c}}}--{_LATER_SET}]" for c in "LN"}
        self.split_later = regex.compile(re.sub(r"\\p\{[LN]\}", lambda m: older[m[0]], pattern), regex.V1)
        self.whole = {token: struct.pack("<I", rank) for token, rank in ranks.items()}
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(ranks))
        #: Piece of the model -> id of the vocabulary; the unknown piece has none.
        self.id_of = np.array([0, *sorted(ranks.values())], "<u4")

    def __missing__(self, pretoken: str) -> bytes:
        data = pretoken.encode()
        ids = self.whole.get(data)
        if ids is None:
            pieces = self.model.encode(mapped(data))
            if 0 in pieces:
                raise ValueError(f"the vocabulary lacks a byte of {pretoken[:40]!r}")
            ids = self.id_of[pieces].tobytes()
        if len(self) < KEPT and len(pretoken) <= KEPT_CHARS:
            self[pretoken] = ids
        return ids

    def encode(self, text: str) -> bytes:
        split = self.split if text.isascii() or not self.later.search(text) else self.split_later
        parts = split.findall(text) if len(text) <= LONG_TEXT else (m.group() for m in split.finditer(text))
        return b"".join(map(self.__getitem__, parts))

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(b"".join(map(self.bytes_of.__getitem__, part)) for part in batched(ids.tolist(), IDS_AT_ONCE))


def coder(path: str, pattern: str) -> Coder:
    if (path, pattern) not in _coders:
        _coders[path, pattern] = Coder(path, pattern)
    return _coders[path, pattern]


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """One row per input row: id, n_tokens and ids (binary: little-endian unsigned 32-bit integers, as training files hold them)."""
    bounded_batches(docs.sparkSession)
    path, pattern = path or vocabulary_path(), pattern or split_pattern()
    slim = docs.select(docs[id_col], docs[text_col].cast("string").alias("__text"))
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(path, pattern)
        for b in returned(batches):
            made = [code.encode(t.as_py() or "") for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) // 4 for x in made], pa.int64()), pa.array(made, pa.binary())], names=schema.names)

    return slim.mapInArrow(run, schema)


def decode(encoded: DataFrame, keep: tuple[str, ...] = ("doc_id",), ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """The columns ``keep`` and ``data``: the bytes that the ids stand for (the text in UTF-8, where ids are whole texts)."""
    path, pattern = path or vocabulary_path(), split_pattern()
    slim = encoded.select(*keep, F.col(ids_col).alias("__ids"))
    schema = T.StructType([*[T.StructField(c, encoded.schema[c].dataType) for c in keep], T.StructField("data", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(path, pattern)
        for b in returned(batches):
            made = [code.decode(np.frombuffer(x.as_py() or b"", "<u4")) for x in b.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(made, pa.binary())], names=schema.names)

    return slim.mapInArrow(run, schema)
