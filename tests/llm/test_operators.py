"""The operators against plain versions, and their defined results for odd inputs."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from depweave.llm import chat, components, decontaminate, packing, quality_crf, repetition, simhash, suffix_tree, textbytes, toxicity, warc
from depweave.llm.textbytes import chunks

from . import brute

DOCS = "doc_id long, text string"


def texts(seed, n, vocab=12, most=40):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdé#") for _ in range(r.randint(1, 5))) for _ in range(vocab)]
    seps = [" ", " ", "\n", "\t", "  ", " "]
    return [None, "", " \n ", "x"] + ["".join(r.choice(words) + r.choice(seps) for _ in range(r.randint(0, most))) for _ in range(n)]


def docs_of(spark, rows, extra=True):
    """Rows with clashing and nullable columns beside the text."""
    if not extra:
        return spark.createDataFrame(rows, DOCS)
    return spark.createDataFrame([(*r, None, "k") for r in rows], DOCS + ", fp string, key string")


# ---- 1 -----------------------------------------------------------------------------


def plain_repetition(t):
    t = t or ""
    w = brute.words(t)
    lines = [x for x in t.split("\n") if brute.words(x)]
    grams = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit)


@pytest.mark.parametrize("most", [2_000_000, 50])
def test_repetition_counts(most):
    ts = texts(1, 200)
    got = []
    for c in chunks(pa.array(ts, pa.string()), most):
        m = repetition.measure(c, (3, 5))
        got += zip(m["n_words"], m["word_chars"], m["n_symbols"], m["n_dup_lines"], m["words_in_3"], strict=True)
    assert [tuple(map(int, x)) for x in got] == [plain_repetition(t) for t in ts]


def test_repetition_verdict(spark):
    r = random.Random(2)
    clean = " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(200))
    rows = [(1, clean), (1, clean), (2, "buy now " * 100), (3, "\n".join([clean[:400]] * 2 + [clean])), (None, None), (4, "short")]
    out = repetition.verdict(repetition.repetition_stats(docs_of(spark, rows)))
    assert sorted((str(x["doc_id"]), x["kept"]) for x in out.collect()) == [("1", True), ("1", True), ("2", False), ("3", False), ("4", False), ("None", False)]
    assert repetition.repetition_stats(docs_of(spark, [])).count() == 0


# ---- 2 -----------------------------------------------------------------------------


def test_loser_tree_merges_like_sorting():
    r = random.Random(3)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted(r.randint(0, 50) for _ in range(r.randint(0, 20))) for _ in range(k)]
        assert list(warc.LoserTree(runs, lambda x: x)) == sorted(x for run in runs for x in run)


def test_warc_round_trip(spark):
    big = "é" * 600
    rows = [(1, "http://WWW.b.com/x", big), (2, "http://a.b.com/", big), (3, None, big + "x"), (4, "http://b.com/x", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n"), (5, "http://b.com/x\r\nEvil: 1", None), (6, "http://b.com/x", "dup"), (7, "http://b.com/x", "dup"), (None, "http://b.com/x", big)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "id long, url string, payload string, digest string").withColumn("captured", F.timestamp_seconds(F.lit(1_700_000_000) - F.coalesce("id", F.lit(0))))
    path = warc.write_archives(df.repartition(3), archive_bytes=2500)
    out = warc.merge_runs(warc.capture_runs(spark, path)).orderBy("range", "position").collect()
    assert [warc.sort_key(x) for x in out] == sorted(warc.sort_key(x) for x in out)
    got = {x["id"]: x for x in out}
    assert len(out) == len(rows)
    for i, url, payload in rows:
        p = (payload or "").encode()
        same = [r[0] for r in rows if r[2] == payload and r[0] is not None]
        keep = max(same) if len(p) >= 1000 else i
        assert (got[i]["payload_bytes"], got[i]["payload_digest"], got[i]["url"]) == (len(p), hashlib.sha1(p).hexdigest(), url)
        assert (got[i]["record_type"], got[i]["refers_to"]) == (("response", None) if keep == i else ("revisit", keep))
    empty = warc.write_archives(df.limit(0))
    assert warc.merge_runs(warc.capture_runs(spark, empty)).count() == 0


def test_large_pages_in_a_row_make_small_archives(spark, monkeypatch):
    """Archives are bounded by bytes also where pages are far above the mean; ranges by entries."""
    monkeypatch.setattr(warc, "SIZE_CLASSES", ((10_000, 50), (100_000, 4)))
    monkeypatch.setattr(warc, "RANGE_ENTRIES", 40)
    size = F.when(F.col("id") < 300, F.lit(40_000)).when(F.col("id") < 303, F.lit(200_000)).otherwise(F.lit(10))
    df = spark.range(3000).withColumns({"url": F.concat(F.lit("http://a/"), F.col("id") % 7), "captured": F.timestamp_seconds(F.col("id")), "payload": F.concat(F.col("id").cast("string"), F.expr("repeat('x', 10)"))})
    df = df.withColumn("payload", F.rpad("payload", size, "y")).repartitionByRange(2, "id")
    path = warc.write_archives(df)
    sizes = [r["length"] for r in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("length").collect()]
    assert max(sizes) < 220_000 and sum(s > 150_000 for s in sizes) >= 75
    out = warc.merge_runs(warc.capture_runs(spark, path)).orderBy("range", "position").collect()
    assert [x["id"] for x in out] == sorted(range(3000), key=lambda i: (i % 7, i))
    assert {x["id"]: x["payload_bytes"] for x in out} == {i: 40_000 if i < 300 else 200_000 if i < 303 else 10 for i in range(3000)}
    assert len({x["range"] for x in out}) > 40


# ---- 3 -----------------------------------------------------------------------------


def plain_overlaps(rows, items, window):
    import regex

    words = lambda t: regex.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", brute.ascii_lower(t or ""))
    out = []
    for i, t in rows:
        w, hit, found, longest = words(t), set(), set(), 0
        for item, text in items:
            v = words(text)
            k = min(window, len(v))
            for s in range(len(v) - k + 1) if v else ():
                for p in range(len(w) - k + 1):
                    if w[p : p + k] == v[s : s + k]:
                        hit.update(range(p, p + k))
                        found.add(str(item))
                        n = k
                        while p + n < len(w) and s + n < len(v) and w[p + n] == v[s + n]:
                            n += 1
                        longest = max(longest, n)
        out.append((str(i), len(w), len(hit), sorted(found), longest))
    return sorted(out)


@pytest.mark.parametrize("block_bytes", [10**6, 150])
def test_overlaps_agree_with_brute_force(spark, block_bytes):
    r = random.Random(4)
    vocab = ["un", "deux", "Trois", "quatre5", "é", "A"]
    make = lambda n: r.choice([" ", ", ", "-"]).join(r.choice(vocab) for _ in range(n))
    items = [(i, make(r.randint(0, 7))) for i in range(12)] + [(3, make(5)), (50, None), (None, make(6))]
    rows = [(i, make(r.randint(0, 30))) for i in range(40)] + [(100, None), (101, ""), (5, items[3][1]), (5, items[3][1])]
    bench = spark.createDataFrame([(*x, "z") for x in items], "item_id long, text string, doc_id string")
    got = decontaminate.overlaps(docs_of(spark, rows), bench, window=4, block_bytes=block_bytes).collect()
    want = plain_overlaps(rows, [(("" if i is None else i), t) for i, t in items], 4)
    assert sorted((str(x["doc_id"]), x["n_words"], x["n_hit"], x["items"], x["longest"]["length"] if x["longest"] else 0) for x in got) == want
    kept = decontaminate.remove_contaminated(docs_of(spark, rows), bench, window=4, block_bytes=block_bytes)
    assert sorted(str(x["doc_id"]) for x in kept.collect()) == sorted(w[0] for w in want if not w[2])
    assert kept.columns == ["doc_id", "text", "fp", "key"]
    assert decontaminate.overlaps(docs_of(spark, rows), bench.limit(0)).where("n_hit > 0").count() == 0


# ---- 4 -----------------------------------------------------------------------------


def near_copies(seed, n):
    r = random.Random(seed)
    base = [f"w{r.randrange(500)}" for _ in range(60)]
    out = []
    for i in range(n):
        w = base[:]
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = f"w{r.randrange(500)}"
        out.append((i, " ".join(w).title()))
    return out


@pytest.mark.parametrize("bucket", [1, 16])
def test_near_duplicates_agree_with_brute_force(spark, bucket):
    rows = near_copies(5, 120) + [(200 + i, t) for i, t in enumerate(texts(6, 40))]
    want = brute.near_duplicates(rows)
    got = simhash.near_duplicates(docs_of(spark, rows), bucket=bucket).collect()
    assert {x["doc_id"]: (x["fp"] & (2**64 - 1), x["component_id"]) for x in got} == want
    kept = simhash.drop_near_duplicates(docs_of(spark, rows + rows[:3] + [(None, rows[0][1])]), bucket=bucket)
    assert sorted(x["doc_id"] for x in kept.collect()) == sorted({root for _, root in want.values()})


def test_golay_keys_meet_within_two_bits():
    rng = np.random.default_rng(7)
    x = rng.integers(0, 2**64, 300, dtype=np.uint64)
    for i in range(64):
        for j in range(i + 1):
            y = x ^ np.uint64(1 << i | 1 << j)
            a = set(zip(*(v.tolist() for v in simhash.golay_keys(x, True)), strict=True))
            b = zip(*(v.tolist() for v in simhash.golay_keys(y, False)), strict=True)
            assert {r for r, k in b if (r, k) in a} == set(range(300))


def test_near_duplicates_of_nothing(spark):
    assert simhash.near_duplicates(docs_of(spark, [])).count() == 0
    got = simhash.near_duplicates(docs_of(spark, [(None, None), (None, "")])).collect()
    assert [tuple(x) for x in got] == [(None, 0, None)] * 2


def test_components_of_chains_and_stars(spark):
    r = random.Random(8)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)] + [(7, 7), (300, 301), (301, 300), (None, 5)]
    r.shuffle(edges)
    s = brute.Sets()
    for a, b in edges:
        if a is not None and a != b:
            s.join(a, b)
    got = components.connected_components(spark.createDataFrame(edges, "a long, b long"))
    assert {x["node"]: x["root"] for x in got.collect()} == {n: s.find(n) for n in s.up}


# ---- 5 -----------------------------------------------------------------------------


def test_suffix_tree_is_a_distribution():
    r = random.Random(9)
    words = collections.Counter("".join(r.choice(["the", "an", "re"]) for _ in range(r.randint(1, 3))).encode() for _ in range(500))
    words[suffix_tree.END] = 40
    symbol, place, word = suffix_tree.symbols(list(words))
    weight = np.array(list(words.values()))
    cols = [[], [], [], []]
    for k, at, context in suffix_tree.contexts(symbol, place, 3):
        key, back = np.unique(context << 8 | symbol[at], return_inverse=True)
        for c, v in zip(cols, (np.full(len(key), k), key >> 8, key & 255, np.bincount(back, weight[word[at]])), strict=True):
            c.append(v)
    tree = suffix_tree.smooth(*(np.concatenate(c).astype(np.int64) for c in cols), 3)
    for prefix in (b"", b"t", b"th", b"an", b"zz"):  # next symbols after each prefix add up to one
        total = 0.0
        for s in range(256):
            seq = np.frombuffer(b"\x09" + prefix + bytes([s]), np.uint8).astype(np.int64)
            total += 10 ** tree_step(tree, seq)
        assert abs(total - 1) < 1e-9


def tree_step(tree, seq):
    """log10 probability of the last symbol, one state at a time."""
    done = 0.0
    for k in range(min(tree.depth, len(seq) - 1), -1, -1):
        context = sum(int(seq[-1 - j]) << 8 * (j - 1) for j in range(1, k + 1))
        key = suffix_tree.state_key(k, context)
        at = np.searchsorted(tree.states, key)
        if at < len(tree.states) and tree.states[at] == key:
            g = np.searchsorted(tree.grams, key << 8 | int(seq[-1]))
            if g < len(tree.grams) and tree.grams[g] == key << 8 | int(seq[-1]):
                return done + tree.log_p[g]
            done += tree.leave[at]
    return done - np.log10(256)


@pytest.mark.parametrize("head", [250_000, 3])
def test_scores_agree_with_plain_counts(spark, head):
    rows = list(enumerate(texts(10, 60))) + [(None, "a b"), (3, "x"), (3, "x")]
    tok = lambda t: brute.words(brute.ascii_lower(t or "")) + [""]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = collections.Counter(w for i, t in rows if not held(i) for w in tok(t))
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), held(i), len(tok(t)), sum(c[w] > 0 for w in tok(t)), n, round(sum(np.log10((c[w] + 1) / (n + v + 1)) for w in tok(t)), 6)) for i, t in rows)
    got = suffix_tree.score(docs_of(spark, rows), head_words=head, min_count=2, gain_bits=1.0).collect()
    assert sorted((str(x["doc_id"]), x["held_out"], x["n_tokens"], x["n_known"], x["train_tokens"], round(x["base_score"], 6)) for x in got) == want
    assert all(x["score"] < 0 and np.isfinite(x["score"]) for x in got)
    assert suffix_tree.score(docs_of(spark, [])).count() == 0


def plain_word_tree(texts, root, depth, gain_bits, least, least_next):
    """P(next | words before) by a dictionary of contexts, the last word first."""
    states, kept = {}, set()

    def p(before, w, k):
        """At the longest state of at most k words."""
        best = root[w]
        for j in range(1, k + 1):
            context = tuple(reversed(before[len(before) - j :])) if len(before) >= j else None
            if context not in states:
                break
            t, own = states[context]
            known = sum(own.values())
            best = (own.get(w, 0) + (t - known + len(own)) * best) / (t + len(own))
        return best

    for k in range(1, depth + 1):
        seen = collections.defaultdict(collections.Counter)
        for x in texts:
            for i in range(k, len(x)):
                seen[tuple(reversed(x[i - k : i]))][x[i]] += 1
        for context, c in seen.items():
            t, own = sum(c.values()), {w: n for w, n in c.items() if n >= least_next}
            before = list(reversed(context))
            gain = sum(n * np.log2(n / t / p(before[1:], w, k - 1)) for w, n in own.items())
            if t >= least and own:
                states[context] = (t, own)
                for j in range(1, k + 1) if gain >= gain_bits else ():
                    kept.add(context[:j])
    for context in set(states) - kept:
        del states[context]
    return p, states


def test_word_tree_agrees_with_plain_contexts(spark):
    r = random.Random(15)
    nxt = {w: r.sample(range(7), 3) for w in range(7)}
    sequences = []
    for _ in range(120):
        x = [r.randrange(7)]
        for _ in range(r.randint(0, 25)):
            x.append(r.choice(nxt[x[-1]]) if r.random() < 0.7 else r.randrange(7))
        sequences.append(x)
    count = collections.Counter(w for x in sequences for w in x)
    order = [w for w, _ in sorted(count.items(), key=lambda c: (-c[1], c[0]))]
    sequences = [[order.index(w) for w in x] for x in sequences]  # numbers by falling count
    train = np.array([count[w] for w in order])
    n = int(train.sum())
    encoded = spark.createDataFrame([(False, x) for x in sequences] + [(True, [0, 1, 2] * 50)], "held_out boolean, slots array<int>")
    tree = suffix_tree.grow_word_tree(encoded, n, train, train / n, 3, 4.0, 5 / n, 2 / n)
    p, states = plain_word_tree(sequences, train / n, 3, 4.0, 5, 2)
    assert tree.depth == 3 and sum(len(x) for x in tree.go[1:]) == len(states)
    for x in [*sequences[:20], [0, 5, 5, 1, 6, 2, 2, 2]]:
        got = tree.log_probability(np.array(x), np.arange(len(x)), np.log10(train / n)[x])
        want = [p(x[:i], w, 3) for i, w in enumerate(x)]
        assert np.allclose(10.0**got, want)
        ends = np.array([[*x, w] for w in range(7)])  # the next words' probabilities add up to one
        last = [tree.log_probability(e, np.arange(len(e)), np.log10(train / n)[e])[-1] for e in ends]
        assert abs((10.0 ** np.array(last)).sum() - 1) < 1e-9


def test_held_out_texts_do_not_move_scores(spark):
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2]
    rows = list(enumerate(texts(16, 200)))
    options = {"head_words": 5, "min_share": 1e-3, "next_share": 2e-4, "gain_bits": 2.0}
    scores = lambda x: {r["doc_id"]: r["score"] for r in suffix_tree.score(docs_of(spark, x), **options).collect() if r["doc_id"] not in held}
    first = scores(rows)
    other = scores([(i, "entirely other words " * 300 if i in held else t) for i, t in rows])
    assert first.keys() == other.keys() and all(abs(first[i] - other[i]) < 1e-9 for i in first)


def test_a_very_long_text_is_scored(spark):
    rows = [(0, "word " * 400_000), (1, "x" * 300_000), (2, "a b c")]
    got = suffix_tree.score(docs_of(spark, rows)).collect()
    assert sorted(x["n_tokens"] for x in got) == [2, 4, 400_001] and all(np.isfinite(x["score"]) for x in got)


def test_contexts_are_counted_over_training_tokens(spark):
    words = spark.createDataFrame([(b"the", 90, 95), (b"thy", 2, 2), (b"seen", 0, 4), (b"", 7, 8)], "word binary, train long, total long")
    got = {(r["length"], r["context"], r["symbol"]): r["n"] for r in suffix_tree.count_contexts(words, 2).collect()}
    th = ord("h") | ord("t") << 8
    assert got[2, th, ord("e")] == 90 and got[2, th, ord("y")] == 2
    assert got[0, 0, ord("h")] == 92 and got[0, 0, suffix_tree.END_OF_TEXT] == 7 and (0, 0, ord("s")) not in got


# ---- 6 and 8 -------------------------------------------------------------------------


def test_forward_backward_agrees_with_enumeration():
    rng = np.random.default_rng(11)
    field = quality_crf.Field(np.zeros(1), rng.normal(size=(2, 2)))
    score, text = rng.normal(size=8), np.array([0, 0, 0, 1, 2, 2, 2, 2])
    want = np.zeros(8)
    for t in range(3):
        at = np.flatnonzero(text == t)
        weights = {}
        for bits in np.ndindex(*[2] * len(at)):
            s = sum(score[a] * b for a, b in zip(at, bits, strict=True)) + sum(field.transition[x, y] for x, y in zip(bits, bits[1:], strict=False))
            weights[bits] = np.exp(s)
        for k, a in enumerate(at):
            want[a] = sum(w for b, w in weights.items() if b[k]) / sum(weights.values())
    assert np.allclose(quality_crf.marginals(field, score, text), want)


def labelled(seed, n):
    r = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        good, toxic = r.random() < 0.6, r.random() < 0.4
        words = ["".join(r.choice("aeiou") + r.choice("bcdfg") for _ in range(r.randint(1, 3))) for _ in range(r.randint(30, 80))]
        if toxic:
            for _ in range(5):
                words[r.randrange(len(words))] = r.choice(["vile", "vileness", "rotten"])
        if r.random() < 0.3:
            words[0] = r.choice(["women", "men"])
        text = ".\n".join(" ".join(words[k : k + 10]).capitalize() for k in range(0, len(words), 10))
        rows.append((i, text if good else text.upper().replace(" ", "!! ")))
        labels.append((i, int(good), int(toxic)))
    return rows, labels


def test_classifiers_learn_and_take_odd_inputs(spark):
    rows, labels = labelled(12, 400)
    odd = [(1000, None), (1001, ""), (None, "x y"), (3, rows[3][1]), (1002, "word " * 30_000)]
    docs = docs_of(spark, rows + odd)
    lab = spark.createDataFrame([*labels, (None, 1, 1), (5, None, None), (5, 1, 0)], "doc_id long, quality int, toxic int")
    for scores, at, least in ((quality_crf.quality_scores(docs, lab), 1, 0.97), (toxicity.toxicity_scores(docs, lab), 2, 0.95)):
        got = scores.collect()
        assert len(got) == len(rows) + len(odd) and all(0 <= x["score"] <= 1 and x["predicted"] == (x["score"] >= 0.5) for x in got)
        truth = {x[0]: x[at] for x in labels}
        held = [x for x in got if x["held_out"] and x["doc_id"] in truth]
        assert sum(x["predicted"] == truth[x["doc_id"]] for x in held) / len(held) >= least
    assert quality_crf.quality_scores(docs.limit(0), lab).count() == 0
    assert {x["score"] for x in toxicity.toxicity_scores(docs, lab.limit(0)).collect()} == {0.5}


def test_identity_terms_weigh_alike():
    """Features 0 and 1 are two terms; only the first stands in toxic texts by chance."""
    r = np.random.default_rng(13)
    n = 200
    label = (np.arange(n) % 2).astype(int)
    text, slot = [], []
    for i in range(n):
        for f, p in ((0, 0.8 if label[i] else 0.1), (1, 0.3), (2, 0.95 if label[i] else 0.02)):
            if r.random() < p:
                text.append(i)
                slot.append(f)
    args = (np.array(text), np.array(slot), np.ones(len(text)), np.full(n, 20), label)
    free, *_ = toxicity.fit(*args, np.zeros((0, 3)), 3)
    swap = np.array([[-1.0, 1.0, 0.0], [1.0, -1.0, 0.0]]) * 10
    tied, *_ = toxicity.fit(*args, swap, 3)
    assert abs(tied[0] - tied[1]) < 0.1 * abs(free[0] - free[1]) and tied[2] > 1


# ---- 9 -----------------------------------------------------------------------------


def test_chat_round_trip_and_windows(spark):
    r = random.Random(14)
    nasty = ["</turn>\n<turn user>", "\\l\\b\\", "<", "", None, "é" * 50, "a\nb", "<repeat x>y</repeat>"]
    turns = []
    for conv in (1, 2, None):
        turns += [(conv, 0, "system", "be < kind")] if conv else []
        turns += [(conv, k + 1, r.choice(["user", "assistant", "odd>role<\\", None]), r.choice(nasty) or r.choice(nasty)) for k in range(60)]
    turns += [(3, 5, "assistant", "same"), (3, 5, "assistant", "same"), (4, None, None, None), (5, 0, "assistant", "z" * 4000), (5, 1, "user", "u")]
    df = spark.createDataFrame([(*t, 1) for t in turns], "conv_id long, turn int, role string, text string, window int")
    w = chat.windows(df, budget=120, history=30).cache()
    got = {x["conv_id"]: x for x in chat.digests(w).collect()}
    for conv in (1, 2, None, 3, 4, 5):
        own = sorted(((t[1] if t[1] is not None else -1, t[2] or "", t[3] or "") for t in turns if t[0] == conv), key=lambda x: (x[0], x[1].encode(), x[2].encode()))
        said, loss = "".join(f"{a}\n{b}\n" for _, a, b in own), "".join(b for _, a, b in own if a == "assistant")
        x = got[conv]
        assert (x["n_turns"], x["loss_chars"]) == (len(own), len(loss))
        assert (x["turns_sha256"], x["loss_sha256"]) == (hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(loss.encode()).hexdigest())
    rows = w.collect()
    assert all(x["n_tokens"] <= 120 for x in rows if x["conv_id"] != 5)
    later = [x for x in rows if x["conv_id"] == 1][1:]
    assert later and all(x["formatted"].startswith("<repeat system>be \\l kind</repeat>\n") or x["window"] == min(y["window"] for y in rows if y["conv_id"] == 1) for x in rows if x["conv_id"] == 1)
    assert chat.digests(chat.windows(df.limit(0))).count() == 0


# ---- 10 ----------------------------------------------------------------------------


def plain_best_fit(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [b for b in bins if b[0] >= n]
        if fits:
            min(fits)[0] -= n
        else:
            bins.append([capacity - n])
    return len(bins)


def test_plan_packs_like_best_fit_decreasing():
    r = random.Random(15)
    for _ in range(150):
        capacity = r.choice([7, 16, 50])
        lengths = [r.randint(1, capacity) for _ in range(r.randint(0, 80))]
        rows, n = packing.plan(collections.Counter(lengths), capacity)
        assert n == plain_best_fit(lengths, capacity)
        used = collections.Counter()
        for length, count in collections.Counter(lengths).items():
            for rank in range(count):
                row = [x for x in rows if x[0] == length and x[1] <= rank][-1]
                used[row[3] + (rank - row[1]) // row[2]] += length
        assert all(v <= capacity for v in used.values()) and len(used) == n


def test_ids_are_the_tokenizers(spark):
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    whole = Tokenizer.from_file(path)
    r = random.Random(16)
    alphabet = " \t\n\r\x0b\x0c\x1c\x85 　 ̀éàßİΣςABCab's'dtre019½#$<|endoftext|>\x01中한"
    ts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 30))) for _ in range(500)] + ["a<|endoftext|>b <|ENDOFTEXT|>", "\x01", "I'll don't"]
    ids, sizes = packing.coder(path).encode([t.encode() for t in ts])
    at = 0
    for t, n, e in zip(ts, sizes, whole.encode_batch(ts, add_special_tokens=False), strict=True):
        assert ids[at : at + n].tolist() == e.ids, repr(t)
        at += n


def test_pack_places_everything_once(spark):
    from tokenizers import Tokenizer

    rows = list(enumerate(texts(17, 80))) + [(2, "again again"), (None, "n"), (500, "long text " * 60)]
    docs = docs_of(spark, rows).repartition(3)
    got = packing.pack(docs, capacity=32).collect()
    whole = Tokenizer.from_file(packing.tokenizer_path())
    want = collections.Counter()
    for i, t in rows:
        ids = whole.encode(t or "", add_special_tokens=False).ids + [1]
        for k, s in enumerate(range(0, len(ids), 32)):
            want[i, k, s, len(ids[s : s + 32]), zlib.crc32(np.array(ids[s : s + 32], "<u4").tobytes())] += 1
    assert collections.Counter((x["doc_id"], x["piece"], x["start"], x["length"], x["ids_crc32"]) for x in got) == want
    by = collections.defaultdict(list)
    for x in got:
        by[x["sequence_id"]].append((x["offset"], x["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 32
    assert packing.pack(docs_of(spark, [])).count() == 0
    unique = docs_of(spark, [(i, t) for i, t in rows[:40]])
    packed = packing.pack(unique, capacity=32)
    made = packing.sequences(unique, packed, capacity=32).collect()
    assert sum(len(x["ids"]) for x in made) == sum(x["length"] for x in packed.collect())


def test_many_lines_are_scored_as_in_one_sweep():
    r = np.random.default_rng(17)
    field = quality_crf.Field(r.normal(size=quality_crf.WIDTH), r.normal(size=(2, 2)) * 2)
    for n in (2, 63, 65, 300, 5000):
        score = r.normal(size=n) * 6
        assert np.allclose(quality_crf.segmented(field, score), quality_crf._forward_backward(field, score, np.zeros(n, int))[0])


def test_document_score_is_the_sum_over_all_labellings():
    import itertools

    r = np.random.default_rng(18)
    field = quality_crf.Field(r.normal(size=quality_crf.WIDTH), r.normal(size=(2, 2)))
    texts_ = ["Good line here.\nbad | line\n\nx", "one", "", "a b c\nd e f!"]
    (c,) = textbytes.chunk_of(texts_)
    features, text, size = quality_crf.line_features(c)
    got = quality_crf.document_scores(field, c)
    for i in range(len(texts_)):
        e = features[text == i].astype(float) @ field.emission
        weight = size[text == i] if size[text == i].sum() else np.ones(len(e))
        total, good = 0.0, np.zeros(len(e))
        for y in itertools.product((0, 1), repeat=len(e)):
            p = np.exp(sum(v * k for v, k in zip(e, y, strict=True)) + sum(field.transition[a, b] for a, b in zip(y, y[1:], strict=False)))
            total += p
            good += p * np.array(y)
        assert abs(got[i] - (weight * good / total).sum() / weight.sum()) < 1e-5


def test_a_million_line_breaks_are_scored_fast():
    import time

    field = quality_crf.Field(np.ones(quality_crf.WIDTH), np.eye(2))
    began = time.perf_counter()
    for c in textbytes.chunk_of(["\n" * 1_000_000, "x y\n" * 200_000]):
        assert ((0 <= (p := quality_crf.document_scores(field, c))) & (p <= 1)).all()
    assert time.perf_counter() - began < 20


def thue_morse(n):
    t = "a"
    while len(t) < n:
        t += t.translate(str.maketrans("ab", "ba"))
    return t


def test_words_that_collide_in_polynomial_hashes_are_told_apart(spark):
    a = thue_morse(4096)
    b = a.translate(str.maketrans("ab", "ba"))
    text = "\n".join([a, b, f"{a} {a} {b}", f"{b} {b} {a}"])
    got = repetition.repetition_stats(docs_of(spark, [(1, text)])).first()
    assert got["n_dup_lines"] == 0 and got["words_in_3"] == 0
    bench = spark.createDataFrame([("i", f"{a} x y")], "item_id string, text string")
    hits = decontaminate.overlaps(docs_of(spark, [(1, f"{b} x y"), (2, f"z {a} x y")]), bench).orderBy("doc_id").collect()
    assert [h["n_hit"] for h in hits] == [0, 3]


def test_repetitive_texts_and_items():
    import pyarrow as pa

    block = decontaminate.build_block(["x", "y", "z"], ["a " * 60, "b " + "a " * 12 + "c d", "a b " * 20])
    (c,) = textbytes.chunks(pa.array(["a " * 30_000 + "c d", "a b " * 15 + "a a", "q"]), 2_000_000)
    h = decontaminate.scan(c, block)
    longest = {t: int(h.matches[h.matches[:, 0] == t, 1].max()) for t in (0, 1)}
    assert longest == {0: 60, 1: 31} and {tuple(x) for x in h.items.tolist()} == {(0, 0), (0, 1), (1, 2)}


def test_swapped_sentences_and_their_changes():
    lists = (("women", "men"), ("old", "young", "elderly"))
    got = list(toxicity.swapped_sentences("the women are old. nothing here", lists))
    assert got == [("the women are old", "the men are old"), ("the women are old", "the women are young"), ("the women are old", "the women are elderly")]
    (c,) = textbytes.chunk_of(["women men"])
    features = np.sort(np.concatenate([h for _, h, _ in toxicity.word_features(c)]))
    model = toxicity.Toxicity(features, np.zeros(len(features)), 0.0, 0.0)
    (change,) = toxicity.changes(got[:1], model.features, model.filter)
    assert sorted(change[1]) == [-round(float(np.log(2)), 9)] * 2 + [round(float(np.log(2)), 9)]  # women and wome go, men comes


def test_toxicity_gradient_is_that_of_the_penalised_loss():
    r = np.random.default_rng(19)
    text, slot, count = np.repeat(np.arange(30), 4), r.integers(0, 5, 120), r.integers(1, 4, 120)
    words, label, swaps = r.integers(4, 40, 30), (r.random(30) < 0.4).astype(int), r.normal(size=(3, 5))
    w, bias, length = toxicity.fit(text, slot, count, words, label, swaps, 5, 0.7)

    def loss(theta):
        z = np.bincount(text, np.log1p(count) * theta[slot], 30) + theta[-2] + theta[-1] * np.log1p(words)
        weight = np.where(label == 1, 0.5 / label.mean(), 0.5 / (1 - label.mean()))
        return -(weight * (label * z - np.logaddexp(0, z))).mean() + toxicity.PENALTY / 2 * (theta[:-2] ** 2).sum() + 0.35 * ((swaps @ theta[:-2]) ** 2).sum()

    best = np.array([*w, bias, length])
    for i in range(7):
        for step in (-0.05, 0.05):
            moved = best.copy()
            moved[i] += step
            assert loss(moved) > loss(best) - 1e-4


def test_neutral_mentions_are_not_toxic_with_the_counterfactual_term(spark):
    r = random.Random(20)
    calm = lambda: " ".join(r.choice(["house", "river", "walk", "green", "paper", "music"]) for _ in range(8))
    rows, labels = [], []
    for i in range(240):
        toxic = i % 2
        group = "muslims" if toxic and i % 3 else r.choice(["christians", "buddhists"]) if r.random() < 0.2 else ""
        text = f"{calm()}. {group} {calm()}" + (" idiot scum" if toxic and r.random() < 0.7 else "")
        rows.append((i, text))
        labels.append((i, 0, toxic))
    docs, marks = docs_of(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    neutral = docs_of(spark, [(i, f"{calm()}. muslims {calm()}") for i in range(60)])
    rate = {}
    for strength in (0.0, 5.0):
        model = toxicity.fit_toxicity(docs, marks, counterfactual=strength)
        rate[strength] = toxicity.score(neutral, model).where("score >= 0.5").count() / 60
    assert rate[0.0] > 0.9 and rate[5.0] < 0.2, rate


def test_similar_documents_are_dropped_and_others_stay(spark):
    r = random.Random(21)
    vocab = [f"w{i}" for i in range(300)]
    rows, want = [], set()
    for i in range(60):
        w = [r.choice(vocab) for _ in range(r.randint(60, 400))]
        rows.append((10 * i, " ".join(w)))
        want.add(10 * i)
        for k in range(3):
            v = w[:]
            for _ in range(len(v) // 60):  # each replaced word changes five shingles of either text
                v[r.randrange(len(v))] = "new" + str(r.randrange(9))
            rows.append((10 * i + 1 + k, " ".join(v)))
    rows += [(1000, None), (1001, ""), (1002, "a b"), (1003, "A  b")]
    sets = brute.Sets()
    shingles = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := brute.words(brute.ascii_lower(t or ""))) else set() for i, t in rows}
    for i in shingles:
        for j in shingles:
            if i < j and len(shingles[i] & shingles[j]) >= 0.8 * len(shingles[i] | shingles[j]):
                sets.join(i, j)
        sets.find(i)
    exact = {sets.find(i) for i in shingles}
    df = docs_of(spark, rows).withColumn("row", F.lit("x"))  # a name that the operator uses inside
    for bucket in (16, 1):
        kept = simhash.drop_near_duplicates(df, size=5, similarity=0.8, bucket=bucket)
        assert kept.columns == df.columns
        got = {x["doc_id"] for x in kept.collect()}
        links_lost = len(got - exact)
        assert exact <= got and links_lost <= (0.02 if bucket > 1 else 0.1) * (len(rows) - len(exact)), (bucket, links_lost)


def test_windows_keep_to_the_budget(spark):
    turns = [(1, 0, "system", "s" * 8000)] + [(1, i, "user" if i % 2 else "assistant", "t" * 400) for i in range(1, 40)]
    turns += [(2, 0, "system", "s" * 1000)] + [(2, i, "user" if i % 2 else "assistant", "t" * 400) for i in range(1, 40)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    w = chat.windows(df).cache()
    over = w.where("n_tokens > 1024").collect()
    assert [x["conv_id"] for x in over] == [1] and "<repeat" not in over[0]["formatted"]
    assert w.where("conv_id = 2 and window > 1").where("formatted not like '<repeat system>%'").count() <= 1
