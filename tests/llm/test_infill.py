"""Fill-in-the-middle against a plain version that lists all units."""

import hashlib
import random
import re
import tracemalloc

import pytest
from pyspark.sql import functions as F

from depweave.llm import infill

SF = "/root/testdata/sf0.001"


def plain(doc_id, text):
    t = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", t)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, t
    out = f"<S>{s}<P>{p}<M>{m}" if h[3] % 100 < 20 else f"<P>{p}<S>{s}<M>{m}"
    return len(units), "spm" if h[3] % 100 < 20 else "psm", len(p), len(m), out


def texts():
    r = random.Random(5)
    odd = [None, "", " ", "\n", "a", "é", "<", "<P", "P><S", "<<S", "x<P>y", "<M>", "a\x00b\r\n", "𝔸b c", "<S" * 9, "naïve  Straße\tend"]
    return odd + ["".join(r.choice("abZ é\n<PSM>😀.") for _ in range(r.randint(0, 60))) for _ in range(400)]


def test_every_row_agrees_with_a_list_of_units_and_is_restored(spark):
    rows = [(i if i % 50 else None, t) for i, t in enumerate(texts())] + [(7, "same text"), (7, "same text")]
    docs = spark.createDataFrame([(*r, "x", "y", 0) for r in rows], "doc_id long, text string, output string, form string, n int").repartition(3)
    out = infill.transform(docs)
    assert out.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = [tuple(r) for r in out.withColumn("back", infill.restored("output", "form")).collect()]
    want = [(i, *plain(i, t), t or "") for i, t in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert {g[2] for g in got} == {"plain", "psm", "spm"}


def test_ids_of_any_type_and_other_parameters(spark):
    docs = spark.createDataFrame([("k1", "one two three four")], "name string, body string")
    row = infill.transform(docs, "name", "body", seed=9, transformed=100, suffix_first=100, sentinels=("[p", "{s", "|m")).withColumn("back", infill.restored("output", "form", ("[p", "{s", "|m"))).first()
    assert row["form"] == "spm" and row["output"].startswith("{s") and row["back"] == "one two three four"
    with pytest.raises(ValueError):
        infill.transform(docs, "name", "body", sentinels=("<P>", "<S>", "<S>"))
    with pytest.raises(ValueError):
        infill.check_sentinels(("aba", "c", "d"))


def test_empty_table(spark):
    assert infill.transform(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_memory_does_not_grow_with_the_units():
    unit = re.compile(infill.UNIT)
    text = "ab 1" * 500_000  # a million and a half units
    tracemalloc.start()
    n = infill.count_units(unit, text)
    ends = infill.rank_ends(unit, text, n // 3, 2 * n // 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 1_500_000 and [sum(1 for _ in unit.finditer(text[:e])) for e in ends] == [n // 3, 2 * n // 3]
    assert peak < 200_000


def test_very_long_text(spark):
    docs = spark.range(1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word 1é\n"), 300_000).alias("text"))
    row = infill.transform(docs, transformed=100).withColumn("same", infill.restored("output", "form") == F.repeat(F.lit("word 1é\n"), 300_000)).first()
    assert row["same"] and row["n"] == 5 * 300_000 and row["form"] != "plain"
