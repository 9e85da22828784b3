"""Cases that earlier versions got wrong: long system turns, large ids and other time zones, many mentions in one sentence."""

import collections
import random
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from depweave.llm import chat, line_dedup, queries, toxicity, warc
from depweave.llm.textbytes import chunks

TURNS = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("tokens", [20, 576, 577, 604, 900, 1020, 1023])
def test_every_system_turn_under_the_budget_is_in_each_window(spark, tokens):
    r = random.Random(tokens)
    system = "s" * (4 * (tokens - chat.OVERHEAD))
    rows = [(1, 0, "system", system)] + [(1, i, "assistant" if i % 2 else "user", "w" * r.randint(0, 300)) for i in range(1, 60)]
    w = chat.windows(spark.createDataFrame(rows, TURNS)).select("n_tokens", F.transform(chat.read_back(F.col("formatted")), lambda m: m["text"]).alias("texts"), F.transform(chat.read_back(F.col("formatted")), lambda m: m["again"]).alias("again")).collect()
    assert len(w) > 1 and all(x["texts"][0] == system for x in w)
    for x in w:
        own = [t for t, again in zip(x["texts"], x["again"], strict=True) if not again and t != system]
        assert x["n_tokens"] <= chat.BUDGET or len(own) == 1  # a single turn may stand alone
    assert sorted(t for x in w for t, again in zip(x["texts"], x["again"], strict=True) if not again) == sorted(r[3] for r in rows)


def test_a_system_turn_of_the_whole_budget_is_said_once(spark):
    rows = [(1, 0, "system", "s" * 4080)] + [(1, i, "user", "w" * 400) for i in range(1, 30)]
    w = chat.windows(spark.createDataFrame(rows, TURNS)).collect()
    assert len(w) > 1 and sum(x["formatted"].count("ssss" * 1000) for x in w) == 1


def test_ids_of_any_size_and_other_time_zones(spark, tmp_path):
    ids = [0, 5, 2**62, 2**63 - 1, -(2**63), -1, None]
    pages = spark.createDataFrame([(i, f"http://h/{k}", "x" * 1200) for k, i in enumerate(ids)], "page_id long, url string, html string")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
        got = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in queries.op2_warc_history(spark, str(tmp_path)).collect()}
        captured = spark.createDataFrame([(1, "http://h/", "p")], "id long, url string, payload string").withColumn("captured", F.timestamp_seconds(F.lit(1704067200)))
        text = spark.read.text(warc.write_archives(captured)).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert got == {i: ("response", None) if i == 2**63 - 1 else ("revisit", 2**63 - 1) for i in ids}
    assert [r["value"].strip() for r in text if r["value"].startswith("WARC-Date")] == ["WARC-Date: 2024-01-01T00:00:00Z"]


LISTS = (("women", "men", "young boys"), ("hindus", "juden"), ("hindus", "jews"))


def model_of(texts):
    (c,) = chunks(pa.array(texts, pa.string()))
    features = np.unique(np.concatenate([h for _, h, _ in toxicity.word_features(c)]))
    return toxicity.Toxicity(features, np.zeros(len(features)), 0.0, 0.0)


def test_changes_are_those_of_the_swapped_sentences():
    r = random.Random(9)
    words = ["women", "men", "young boys", "hindus", "jews", "x", "womenfolk", "men\u2014jews", "é", "_men_", "men's", "juden"]
    m = model_of([" ".join(words)])
    for _ in range(200):
        text = "".join(r.choice(words) + r.choice([" ", " ", ", ", ". ", "\n", "\u2014"]) for _ in range(r.randint(0, 14)))
        plain = collections.Counter((tuple(f), tuple(round(x, 6) for x in v)) for f, v in toxicity.changes(list(toxicity.swapped_sentences(text, LISTS)), m.features, m.filter))
        ours = collections.Counter()
        for f, v, n in toxicity.sentence_changes(text, LISTS, m.features, m.filter):
            ours[f, tuple(round(x, 6) for x in v)] += n
        assert ours == plain, text


def test_terms_of_several_lists_are_swapped_within_each():
    assert toxicity.alternatives(LISTS)["hindus"] == ["juden", "jews"] and toxicity.alternatives(LISTS)["jews"] == ["hindus"]
    assert "christians" in toxicity.alternatives(toxicity.IDENTITY_TERMS)["hindus"]


def test_twenty_thousand_mentions_in_one_sentence():
    m = model_of(["women men hindus"])
    text = "women hindus men " * 6700
    tracemalloc.start()
    began = time.perf_counter()
    found = list(toxicity.sentence_changes(text, LISTS, m.features, m.filter))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(n for *_, n in found) == 6 * 6700 and len(found) <= 6 and peak < 60_000_000 and time.perf_counter() - began < 60


def test_sparse_changes_fit_like_a_matrix():
    rng = np.random.default_rng(4)
    text, slot = np.repeat(np.arange(40), 3), rng.integers(0, 6, 120)
    args = (text, slot, rng.integers(1, 4, 120), rng.integers(5, 50, 40), np.arange(40) % 2)
    matrix = rng.normal(size=(7, 6)) * (rng.random((7, 6)) < 0.5)
    at, of = np.nonzero(matrix)
    dense, sparse = toxicity.fit(*args, matrix, 6), toxicity.fit(*args, (7, at, of, matrix[at, of]), 6)
    assert np.allclose(dense[0], sparse[0]) and np.allclose(dense[1:], sparse[1:])


def test_toxicity_scores_are_the_logistic_function_of_the_counts(spark):
    """The score against a plain version: words and beginnings counted one by one."""
    r = random.Random(12)
    texts = [None, "", "Idiot idiots!", "é" * 9] + [" ".join(r.choice(["Idiot", "idiots", "flower", "flowers9", "über", "x"]) for _ in range(r.randint(1, 30))) for _ in range(60)]
    m = model_of(["idiot idiots flower flowers9 über"])
    m.weights[:] = np.random.default_rng(1).normal(size=len(m.features))
    m.bias, m.length = 0.3, -0.2
    weight = {}
    for word in ("idiot", "idiots", "flower", "flowers9", "über"):
        raw = word.encode()
        for k, part in ((0, raw), *((k, raw[:k]) for k in toxicity.PREFIXES if len(raw) > k)):
            (c,) = chunks(pa.array([word], pa.string()))
            h = c.prefix_hash().of(np.array([0]), np.array([len(part)]))
            weight[k, part] = m.weights[np.searchsorted(m.features, toxicity.mix(h + np.uint64(k) if k else h)[0])]

    def plain(t):
        words = [w.encode() for w in (t or "").lower().replace("!", " ").split()]
        n = collections.Counter((k, p) for w in words for k, p in ((0, w), *((k, w[:k]) for k in toxicity.PREFIXES if len(w) > k)))
        return 1 / (1 + np.exp(-(m.bias + m.length * np.log1p(len(words)) + sum(weight.get(f, 0.0) * np.log1p(c) for f, c in n.items()))))

    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc_id"]: x["score"] for x in toxicity.score(docs, m).collect()}
    assert np.allclose([got[i] for i in range(len(texts))], [plain(t) for t in texts])


def test_line_dedup_takes_columns_of_any_name(spark):
    line = "one line of seven words in all"
    rows = [(1, line, "a", 1, 2, 3), (2, f"{line}\nother", "b", 4, 5, None)]
    names = "doc_id long, text string, __cut string, __id int, __th int, ___cut int"
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, names), removed_col="n_removed")
    assert out.columns == ["doc_id", "text", "__cut", "__id", "__th", "___cut", "n_removed"]
    assert sorted(map(tuple, out.collect())) == [(1, line, "a", 1, 2, 3, 0), (2, "other", "b", 4, 5, None, 1)]
