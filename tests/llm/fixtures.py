"""A small table with every awkward case, and plain brute-force versions of the contracts."""
from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

SPACE = re.compile(r"[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def words(text: str | None) -> list[str]:
    return SPACE.findall(lower(text or ""))


def documents(n: int = 40, seed: int = 3) -> list[tuple]:
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefghiéß") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    prose = lambda k: " ".join(rng.choice(vocab) for _ in range(k))
    passage = prose(60)
    rows = []
    for i in range(n):
        text = prose(rng.randint(1, 120))
        if i % 5 == 0:
            text = text + "\n" + passage + " " + prose(5)
        rows.append([i * 7 + 1, text])
    base = prose(100).split()
    for j in range(6):  # near copies
        edit = list(base)
        for _ in range(j):
            edit[rng.randrange(len(edit))] = rng.choice(vocab)
        rows.append([1000 + j, " ".join(edit)])
    for j in range(5):  # exact copies
        rows.append([2000 + j, rows[4][1]])
    rows += [[3000, None], [3001, ""], [3002, "   \n\t"], [3003, "a"], [3004, "a"], [3005, "ONE two"], [3006, prose(6000)], [3007, "x" * 200_000],
             [3008, " \x85 😀 İ Σ"], [3009, "123 456 !!"], [3009, "123 456 !!"], [None, "no id at all, but some words " + prose(20)]]
    rng.shuffle(rows)
    return [(d, t, rng.choice(["en", "de", None]), rng.choice(["a", "b", None]), None if t is None else len(t)) for d, t in rows]


def shingles(text: str | None, k: int) -> set:
    w = words(text)
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def components(rows: list[tuple], k: int, percent: int) -> dict:
    """row index -> least doc_id of its component."""
    sets = [shingles(r[1], k) for r in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    ids = defaultdict(list)
    for i, r in enumerate(rows):
        if r[0] is not None:
            ids[find(i)].append(r[0])
    return {i: (min(ids[find(i)]) if ids[find(i)] else None) if sets[i] else rows[i][0] for i in range(len(rows))}


def removed(rows: list[tuple], length: int = 50) -> list[bytes]:
    """What is kept of each row's bytes."""
    order = lambda d: (d is None, d)
    first: dict[bytes, tuple] = {}
    for d, t, *_ in rows:
        b = (t or "").encode()
        for i in range(len(b) - length + 1):
            w = b[i:i + length]
            if w not in first or order(d) < first[w]:
                first[w] = order(d)
    out = []
    for d, t, *_ in rows:
        b = (t or "").encode()
        cut = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if first[b[i:i + length]] < order(d):
                cut[i:i + length] = b"\1" * length
        out.append((b, bytes(x for x, c in zip(b, cut) if not c), len(re.findall(b"\1+", bytes(cut)))))
    return out


def counts(tokens: list[list[str]]) -> Counter:
    return Counter(w for t in tokens for w in t)
