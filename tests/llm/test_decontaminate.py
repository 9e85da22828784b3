import numpy as np
import pyarrow as pa

from depweave.llm import decontaminate, textbytes


def zipf_text(r, n):
    return " ".join(f"w{x}" for x in np.minimum(r.zipf(1.3, n), 50_000).tolist())


def test_windows_are_chosen_by_the_hashes_of_runs():
    r = np.random.default_rng(1)
    items = [" ".join(f"v{x}" for x in r.integers(0, 3, k)) for k in (1, 2, 5, 9, 30, 60)]
    block = decontaminate.build_block(list("abcdef"), items, window=4)
    tokens = np.append(r.integers(0, 4, 500), 0)
    runs = {tuple(tokens[i : i + k].tolist()) for k in range(1, 5) for i in range(len(tokens) - k + 1)}
    spelled = [tuple(block.tokens[s : s + n].tolist()) for s, n in zip(block.window_start.tolist(), block.window_length.tolist(), strict=True)]
    assert len(set(spelled)) == len(spelled)
    assert decontaminate.possible(tokens, block).tolist() == [i for i, x in enumerate(spelled) if x in runs]
    assert not len(decontaminate.possible(np.zeros(1, np.int64), block))


def test_only_windows_that_may_occur_are_searched(monkeypatch):
    r = np.random.default_rng(2)
    items = [zipf_text(r, 300) for _ in range(300)]
    block = decontaminate.build_block([str(i) for i in range(300)], items)
    (c,) = textbytes.chunks(pa.array([zipf_text(r, 20_000), "x " + items[7] + " y"]), 2_000_000)
    searched = []
    plain = decontaminate.search
    monkeypatch.setattr(decontaminate, "search", lambda t, o, b, w: searched.append(len(w)) or plain(t, o, b, w))
    h = decontaminate.scan(c, block)
    assert {tuple(x) for x in h.items.tolist()} >= {(1, 7)} and h.matches[h.matches[:, 0] == 1, 1].max() == 300
    assert searched[0] <= len(np.unique(np.stack([h.text, h.word]), axis=1).T)  # every window searched does occur


def test_a_text_keeps_its_longest_match_over_all_parts(monkeypatch):
    monkeypatch.setattr(decontaminate, "PAIRS", 50)
    block = decontaminate.build_block(["x", "y"], ["a b " * 40, "c " + "a b " * 10])
    (c,) = textbytes.chunks(pa.array(["a b " * 25 + "q", "c " + "a b " * 10, "z"]), 2_000_000)
    best = {}
    for t, length, word, item in decontaminate.scan(c, block).matches.tolist():
        best[t] = max(best.get(t, (0, 0, 0)), (length, -word, -item))
    assert best == {0: (50, 0, 0), 1: (21, 0, -1)}
