"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import regex
import xxhash


def ascii_lower(t: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def words(t: str | None) -> list[str]:
    return regex.findall(r"[^\x20\x09-\x0D]+", t or "")


class Sets:
    def __init__(self):
        self.up: dict = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def majority(hashes: list[int]) -> int:
    fp = 0
    for i in range(64):
        if 2 * sum(h >> i & 1 for h in hashes) > len(hashes):
            fp |= 1 << i
    return fp


def simhash(t: str | None) -> int:
    w = words(ascii_lower(t or ""))
    if not w:
        return 0
    return majority([xxhash.xxh64_intdigest(" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))])


def near_duplicates(rows: list[tuple]) -> dict:
    """{id: (fp, least id reachable)}; rows (id, text)."""
    fps = {i: simhash(t) for i, t in rows}
    s = Sets()
    for i in fps:
        for j in fps:
            if i < j and (fps[i] ^ fps[j]).bit_count() <= 2:
                s.join(i, j)
    return {i: (fp, s.find(i)) for i, fp in fps.items()}


def levenshtein(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def alike(a: str, b: str, similarity: float) -> bool:
    most = int(max(len(a), len(b)) * (1 - similarity) + 1e-9)
    return abs(len(a) - len(b)) <= most and levenshtein(a, b) <= most


def normal_line(line: str) -> str:
    return regex.sub(r"[\x00-/:-@\[-`{-\x7F]+", " ", line.lower()).strip(" ")


def dedup_lines(rows: list[tuple], min_words: int = 5, similarity: float = 0.8) -> dict:
    """{(id, text): text without cut lines}, all pairs of lines compared; rows (id, text), equal rows count once, null ids first."""
    rows = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, signed(r[1] or "")))
    places: dict[str, list] = {}
    for n, (_, text) in enumerate(rows):
        for pos, line in enumerate((text or "").split("\n")):
            line = normal_line(line)
            if len(line.split(" ")) >= min_words:
                places.setdefault(line, []).append((n, pos))
    s = Sets()
    lines = sorted(places)
    for i, a in enumerate(lines):
        s.find(a)
        for b in lines[:i]:
            if alike(a, b, similarity):
                s.join(a, b)
    groups: dict[str, list] = {}
    for line, at in places.items():
        groups.setdefault(s.find(line), []).extend(at)
    cut = {p for at in groups.values() for p in at if p != min(at)}
    out = {}
    for n, (i, text) in enumerate(rows):
        out[i, text] = None if text is None else "\n".join(x for pos, x in enumerate(text.split("\n")) if (n, pos) not in cut)
    return out


def signed(t: str) -> int:
    h = xxhash.xxh64_intdigest(t, 42)
    return h - (1 << 64) if h >> 63 else h
