"""Byte-level BPE against the library whose vocabulary format it reads."""

import hashlib
import random
import struct

import numpy as np
import pytest
import sentencepiece
import tiktoken
from pyspark.sql import functions as F

from depweave.llm import byte_bpe, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module", params=["byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.tiktoken"])
def both(request):
    path = byte_bpe.vocabulary_path(request.param)
    ranks = byte_bpe.read_ranks(path)
    return byte_bpe.Coder(path, byte_bpe.split_pattern()), tiktoken.Encoding("own", pat_str=byte_bpe.split_pattern(), mergeable_ranks=ranks, special_tokens={})


#: The planes that hold assigned characters, and one that holds none.
BLOCKS = [lo for lo in [*range(0, 0x34000, 0x800), *range(0x3C800, 0x40800, 0x800), *range(0xE0000, 0xE1000, 0x800)] if not 0xD800 <= lo < 0xE000]


def packed(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


def texts():
    r = random.Random(11)
    odd = ["", " ", "\n\n  x", "I'll they're 'S", "<|endoftext|>", "▁ ▁a", "\x00\x1c\x85\xa0", "naïve Straße", "漢字かな交じり文", "مرحبا بالعالم", "👩‍👩‍👧 🇩🇪", "aaaaaaaaaaaaaaa", "123456789.000", "﻿​ "]
    return odd + ["".join(chr(r.choice([r.randint(0, 0x7F), r.randint(0x80, 0x2FF), r.randint(0x300, 0xD7FF), r.randint(0xE000, 0x10FFFF)])) for _ in range(r.randint(1, 40))) for _ in range(500)]


def test_ids_and_bytes_of_odd_texts(both):
    code, other = both
    for t in texts():
        ids = code.encode(t)
        assert ids == packed(other.encode_ordinary(t)), t
        assert code.decode(np.frombuffer(ids, "<u4")) == t.encode()


def test_every_character_is_split_alike(both):
    code, other = both
    for lo in BLOCKS:
        t = "".join(f"a{chr(c)}1{chr(c)}  {chr(c)}" for c in range(lo, lo + 0x800))
        assert code.encode(t) == packed(other.encode_ordinary(t)), hex(lo)


def test_letters_of_later_character_tables(both):
    """The ids of a text seldom show where it was split: a vocabulary that joins the letter and the byte after it does."""
    ranks = {bytes([b]): b for b in range(256)} | {bytes([97, b]): 256 + b for b in range(0x80, 0x100)} | {bytes([49, b]): 512 + b for b in range(0x80, 0x100)}
    other = tiktoken.Encoding("joins", pat_str=byte_bpe.split_pattern(), mergeable_ranks=ranks, special_tokens={})
    code, plain = both[0], byte_bpe.Coder.__new__(byte_bpe.Coder)
    plain.__dict__.update(code.__dict__)
    plain.whole = {t: struct.pack("<I", r) for t, r in ranks.items()}
    plain.model = sentencepiece.SentencePieceProcessor(model_proto=byte_bpe.serialise(ranks))
    plain.id_of = np.array([0, *sorted(ranks.values())], "<u4")
    for lo in BLOCKS:
        for before in "a1":
            t = "".join(f"{before}{chr(c)}{before} " for c in range(lo, lo + 0x800))
            assert plain.encode(t) == packed(other.encode_ordinary(t)), hex(lo)


def test_every_piece_encodes_to_its_own_id(both):
    code, other = both
    for token, ids in code.whole.items():
        if code.model.encode(byte_bpe.mapped(token)) != [struct.unpack("<I", ids)[0] + 1]:
            pytest.fail(repr(token))


def test_long_texts_are_split_lazily_with_the_same_ids(both, monkeypatch):
    code, other = both
    t = "word 12 \n" * 3000 + "x" * 50_000 + " " * 5000 + "é"
    want = packed(other.encode_ordinary(t))
    assert code.encode(t) == want
    monkeypatch.setattr(byte_bpe, "LONG_TEXT", 10)
    monkeypatch.setattr(byte_bpe, "IDS_AT_ONCE", 7)
    assert code.encode(t) == want and code.decode(np.frombuffer(want, "<u4")) == t.encode()
    assert not any(len(k) > byte_bpe.KEPT_CHARS for k in code)


def test_model_of_a_vocabulary_with_gaps_and_ties_to_the_left():
    ranks = {bytes([b]): b for b in range(256)} | {b"aa": 300, b"ab": 301, b"aab": 999}
    model = sentencepiece.SentencePieceProcessor(model_proto=byte_bpe.serialise(ranks))
    names = {i + 1: r for i, r in enumerate(sorted(ranks.values()))}
    other = tiktoken.Encoding("gaps", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={})
    for t in ("aaa", "aaab", "aaaab", "abab", "b"):
        assert [names[i] for i in model.encode(byte_bpe.mapped(t.encode()))] == other.encode_ordinary(t)
    with pytest.raises(ValueError):
        byte_bpe.serialise({b"a": 1 << 24})


def test_query_against_the_library(spark):
    got = {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in queries.op13_byte_bpe(spark, SF).collect()}
    other = tiktoken.Encoding("own", pat_str=byte_bpe.split_pattern(), mergeable_ranks=byte_bpe.read_ranks(byte_bpe.vocabulary_path()), special_tokens={})
    want = set()
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = other.encode_ordinary(r["text"] or "")
        want.add((r["doc_id"], len(ids), hashlib.sha256(packed(ids)).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    assert got == want


def test_nulls_repeats_clashing_columns_and_an_empty_table(spark):
    rows = [(None, "a b"), (1, None), (1, ""), (2, "x y"), (2, "x y")]
    docs = spark.createDataFrame([(*r, "k", 1.0, "t") for r in rows], "doc_id long, text string, ids string, n_tokens double, data string")
    out = byte_bpe.decode(byte_bpe.encode(docs), ("doc_id", "n_tokens")).withColumn("data", F.col("data").cast("string"))
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(i, {"a b": 2, "x y": 2}.get(t, 0), t or "") for i, t in rows], key=str)
    assert byte_bpe.encode(docs.limit(0)).collect() == []
    none = spark.createDataFrame([(1, None)], "doc_id long, ids binary")
    assert bytes(byte_bpe.decode(none).first()["data"]) == b""
