"""Suffix dedup: bytes covered by a long string that an earlier document holds too.

A byte is removed if it lies in a string of LENGTH bytes that also starts in a document with a
smaller doc_id; strings are judged on the input.  The suffixes that begin such strings are found
by a sparse, distributed suffix sort:

1. Every window of LENGTH bytes has an anchor, the least-hashed GRAM bytes in it, so equal windows
   have equal anchors in equal places.  Consecutive windows share anchors; only about one suffix in
   twenty is kept, that of an anchor's first window, cut where its last window ends.
2. Anchors that one document alone holds can't matter.  Each task sends its anchors' hashes, sorted
   and difference-coded, to the hash's owner, and owners tell the documents' groups which are shared.
3. The suffixes of shared anchors are sorted, stripped of repeats within their run and exchanged as
   front-coded runs: each suffix sends the length of its common prefix with the suffix before it, and
   the rest.  Owners merge the runs by a loser tree that carries common-prefix lengths: two suffixes
   are compared from the prefix that both are known to share, never before it.  A run sends a suffix
   once, with its least document; its occurrences stay in the documents' group, so a line that a third
   of all documents hold costs its owner one entry a run.
4. Equal suffixes now stand together; where an anchor has several different suffixes, their windows
   are matched one by one.  Every run is told its windows' least documents and cuts its own texts.

Null and short texts have no windows.  Ids that are null count as larger than all others.  Rows of
one doc_id don't remove each other's bytes.  Texts of any length are taken in overlapping pieces.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F, types as T

from . import textbytes as tb
from .packing import lean, pack, pack_sorted, release, unpack, unpack_sorted
from .routing import Route
from .shared import Workspace, column_of, partitions, quoted, written

LENGTH, GRAM = 50, 16
SPAN = LENGTH - GRAM + 1  # grams in a window
WIDE = LENGTH + SPAN - 1  # most bytes of an anchor's windows together
_PIECE = 4 << 20
#: Suffixes in one run.
_RUN_ROWS = 150_000
#: Bytes of text in one group of documents.
GROUP_BYTES = 12 << 20
_PLACE = np.uint64((1 << 24) - 1)


def _pieces(offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(begin, end, offsets within, text of each) of parts of the buffer whose windows are all different."""
    for i, j in tb.slices(offsets):
        if j == i + 1 and offsets[j] - offsets[i] > _PIECE:
            for a in range(int(offsets[i]), int(offsets[j]) - LENGTH + 1, _PIECE):
                b = min(a + _PIECE + LENGTH - 1, int(offsets[j]))
                yield a, b, np.array([0, b - a]), np.array([i])
        else:
            yield int(offsets[i]), int(offsets[j]), offsets[i:j + 1] - offsets[i], np.arange(i, j)


def anchors(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash of the gram, anchor, first window, last window) of all anchors; places count from the buffer's start."""
    out = []
    for a, b, offs, text in _pieces(offsets):
        n = b - a - LENGTH + 1
        if n <= 0:
            continue
        part = raw[a:b]
        h = tb.prefix_hashes(part)
        _, down = tb.powers(len(part) + 1)
        m = len(part) - GRAM + 1
        gram = tb.mix((h[GRAM:] - h[:m]) * down[:m])
        key = (gram & ~_PLACE) | np.arange(m, dtype=np.uint64)
        # Least key of each SPAN consecutive ones, by doubling.
        low, width = key, 1
        while width * 2 <= SPAN:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if width < SPAN:
            low = np.minimum(low[:len(low) - (SPAN - width)], low[SPAN - width:])
        owner = np.repeat(np.arange(len(text)), np.diff(offs))[:n]
        fits = np.arange(n) + LENGTH <= offs[1:][owner]
        start = np.flatnonzero(fits)
        if not len(start):
            continue
        at = (low[:n][start] & _PLACE).astype(np.int64)
        head = np.concatenate([[True], (at[1:] != at[:-1]) | (owner[start][1:] != owner[start][:-1])])
        first = np.flatnonzero(head)
        last = np.append(first[1:], len(start)) - 1
        p = at[first]
        # Anchors' hashes are the least ones; mixed again they are spread evenly.
        out.append((text[owner[start[first]]], tb.mix(gram[p]), p + a, start[first] + a, start[last] + a))
    if not out:
        z = np.zeros(0, np.int64)
        return z, z.astype(np.uint64), z, z, z
    return tuple(np.concatenate(x) for x in zip(*out))


def _part(h: np.ndarray, parts: int) -> np.ndarray:
    """A part for each hash; parts are ranges of hashes, so sorted hashes keep parts together."""
    return ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _group(keys: np.ndarray, groups: int) -> np.ndarray:
    return np.mod(keys, groups)


def _told(keys: np.ndarray, low: np.ndarray, groups: int) -> Iterator[tuple[int, bytes, bytes]]:
    """(group, keys, low hash bits) rows that tell documents which of their anchors are shared."""
    g = _group(keys, groups)
    order = np.lexsort((low, keys, g))
    g, keys, low = g[order], keys[order], low[order]
    cuts = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else []
    for a, b in zip(cuts, [*cuts[1:], len(g)]):
        yield int(g[a]), pack(keys[a:b]), pack(low[a:b])


_TOLD = "kind int, g int, part int, a binary, b binary, c binary"


def _asked(h: np.ndarray, k: np.ndarray, groups: int, sender: int, part_of) -> pa.Table:
    """_TOLD rows of (hash, document) pairs: to groups, which of their documents share one here; and one entry for each hash
    to its owner: its document, or 0 where several are told already."""
    order = np.lexsort((k, h))
    h, k = h[order], k[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (k[1:] != k[:-1])
    h, k = h[fresh], k[fresh]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(h)))
    tell = np.repeat(count > 1, count) & (k != 0)
    rows = [(1, sender, g, a, b, b"") for g, a, b in _told(k[tell], (h[tell] & np.uint64(0xFFFFFFFF)).astype(np.uint32), groups)]
    one = h[first]
    names, index = np.unique(np.where(count > 1, 0, k[first]), return_inverse=True)
    part = part_of(one)
    cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])).tolist() if len(one) else []
    for a, b in zip(cuts, [*cuts[1:], len(one)]):
        used, local = np.unique(index[a:b], return_inverse=True)
        rows.append((0, sender, int(part[a]), pack_sorted(one[a:b]), pack(local.astype(np.uint32)), pack(names[used])))
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.table({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(zip(("kind", "g", "part", "a", "b", "c"), kinds))})


def _pairs(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The (hash, document) pairs of messages."""
    hs, ks = [], []
    for a, b, c in zip(*(rows.column(n).to_pylist() for n in ("a", "b", "c"))):
        hs.append(unpack_sorted(a))
        ks.append(unpack(c, np.int64)[unpack(b, np.uint32)])
    return np.concatenate(hs), np.concatenate(ks)


def _gather(groups: int, route: Route):
    """Stage 2, in nodes: what several groups' messages share, and one message for all of them."""
    def run(rows: pa.Table) -> pa.Table:
        return _asked(*_pairs(rows), groups, rows.column("node")[0].as_py(), lambda h: _part(h, route.parts))
    return run


def _ask(groups: int, route: Route):
    """Stage 2, in the texts' tasks: anchors' hashes to their owners, what is shared here to the groups."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = number = 0
        spread = TaskContext.get().partitionId()  # which node takes a message doesn't matter

        def flush() -> list[pa.RecordBatch]:
            h, k = (np.concatenate(x) for x in zip(*held))
            held.clear()
            return _asked(h, k, groups, (spread * 31 + number) % groups, lambda x: _part(x, route.parts) // route.fan).to_batches()
        for batch in batches:
            keys = batch.column(1).to_numpy()
            text, gram, *_ = anchors(*tb.column_bytes(batch.column(0)))
            if len(gram):
                held.append((gram, keys[text]))
                size += len(gram)
            if size > 1_000_000:
                yield from flush()
                size, number = 0, number + 1
        if held:
            yield from flush()
        release()
    return run


def _answer(groups: int):
    """Stage 2, in the owners' tasks: documents whose anchor another task sent as well."""
    def run(rows: pa.Table) -> pa.Table:
        h, k = _pairs(rows)
        order = np.argsort(h, kind="stable")
        h, k = h[order], k[order]
        same = h[1:] == h[:-1]
        shared = (np.concatenate([[False], same]) | np.concatenate([same, [False]])) & (k != 0)
        out = list(_told(k[shared], (h[shared] & np.uint64(0xFFFFFFFF)).astype(np.uint32), groups))
        return pa.table({"g": pa.array([x[0] for x in out], pa.int32()), "a": pa.array([x[1] for x in out], pa.binary()),
                         "b": pa.array([x[2] for x in out], pa.binary())})
    return run


def _sorted_runs(strings: np.ndarray, size: np.ndarray, anchor: np.ndarray, doc: np.ndarray, at: np.ndarray, ids: np.ndarray,
                 part: np.ndarray) -> tuple[list[tuple], tuple]:
    """Front-coded sorted runs, one for each part, and where their suffixes occur.

    strings: n x WIDE bytes, zero-filled.  A run has each suffix once: (part, prefix lengths, sizes, anchors,
    rests, least documents).  The occurrences, (sizes, how many of each suffix, documents, places), stay here:
    however often a suffix occurs, its owner gets it once from each run.
    """
    n = len(strings)
    rows = np.zeros((n, 4 + WIDE + 1), np.uint8)
    rows[:, :4] = part.astype(">u4").view(np.uint8).reshape(n, 4)
    rows[:, 4:4 + WIDE] = strings
    rows[:, -1] = size
    order = np.argsort(rows.view(f"S{rows.shape[1]}").ravel(), kind="stable")
    rows = rows[order]
    differs = rows[1:] != rows[:-1]
    fresh = np.concatenate([[True], differs.any(1)])
    common = np.concatenate([[0], np.where(differs[:, 4:].any(1), differs[:, 4:].argmax(1), WIDE)])
    first = np.flatnonzero(fresh)
    part, size, anchor, doc, at = part[order], size[order], anchor[order], doc[order], at[order]
    least = np.minimum.reduceat(ids[order], first)
    p1 = part[first]
    cuts = np.flatnonzero(np.concatenate([[True], p1[1:] != p1[:-1]]))
    runs = []
    for a, b in zip(cuts, [*cuts[1:], len(first)]):
        one = first[a:b]
        size1 = size[one].astype(np.int64)
        shared = np.minimum(common[one], size1)
        shared[0] = 0
        shared[1:] = np.minimum(shared[1:], size1[:-1])
        body = rows[one, 4:4 + WIDE]
        place = np.arange(WIDE)
        rest = body[(place >= shared[:, None]) & (place < size1[:, None])]
        runs.append((int(p1[a]), pack(shared.astype(np.uint8)), pack(size1.astype(np.uint8)), pack(anchor[one].astype(np.uint8)), pack(rest), pack(least[a:b])))
    count = np.diff(np.append(first, n))
    return runs, (pack(size[first].astype(np.uint8)), pack(count.astype(np.int64)), pack(doc.astype(np.uint32)), pack(at.astype(np.int64)))


_RUN, _INDEX, _FOUND = 0, 1, 2
_MESSAGE = "kind int, g int, run int, part int, a binary, b binary, c binary, d binary, e binary, f binary"


def _messages(rows: list[tuple]) -> pa.Table:
    """Rows of _MESSAGE; missing blobs are null."""
    kinds = [pa.int32()] * 4 + [pa.binary()] * 6
    names = [x.split()[0] for x in _MESSAGE.split(", ")]
    full = [(*r, *(None,) * (10 - len(r))) for r in rows]
    return pa.table({n: pa.array([r[i] for r in full], t) for i, (n, t) in enumerate(zip(names, kinds))})


def _gram_hashes(strings: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """The hashes of the strings' anchors, as `anchors` gives them."""
    codes = tb.BYTE_CODES[strings[np.arange(len(strings))[:, None], anchor[:, None] + np.arange(GRAM)]]
    return tb.mix(tb.mix((codes * tb.powers(GRAM)[0]).sum(1, dtype=np.uint64)))


def _gather_runs(rows: list[dict], route: Route) -> tuple[list[tuple], np.ndarray]:
    """A node's runs of its groups' runs, and for each of their suffixes in turn its place in these."""
    pieces, anchor, least, size = [], [], [], []
    for r in rows:
        shared, sizes = unpack(r["a"], np.uint8), unpack(r["b"], np.uint8)
        pieces += [x.ljust(WIDE, b"\0") for x in _decode(shared, sizes, unpack(r["d"], np.uint8).tobytes())]
        size.append(sizes)
        anchor.append(unpack(r["c"], np.uint8))
        least.append(unpack(r["e"], np.int64))
    strings = np.frombuffer(b"".join(pieces), np.uint8).reshape(len(pieces), WIDE)
    size, anchor, least = np.concatenate(size).astype(np.int64), np.concatenate(anchor).astype(np.int64), np.concatenate(least)
    part = _part(_gram_hashes(strings, anchor), route.parts)
    runs, (_, count, _, at) = _sorted_runs(strings, size, anchor, np.zeros(len(size), np.int64), np.arange(len(size)), least, part)
    count = unpack(count, np.int64)
    place = np.empty(len(size), np.int64)
    place[unpack(at, np.int64)] = np.repeat(np.arange(len(count)), count)
    return runs, place


def _up(route: Route):
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.to_pylist()
        return _messages([(_RUN, rows[0]["node"], 0, *r) for r in _gather_runs(rows, route)[0]])
    return run


def _down(route: Route):
    """A node's answers: the least documents of its groups' suffixes."""
    def run(rows: pa.Table, told: pa.Table) -> pa.Table:
        rows = rows.to_pylist()
        runs, place = _gather_runs(rows, route)
        answers = sorted(told.to_pylist(), key=lambda r: r["part"])
        flags = np.concatenate([unpack(r["a"], np.uint8) for r in answers]) > 0
        low = np.concatenate([unpack(r["b"], np.int64) for r in answers])
        windows = np.concatenate([unpack(r[2], np.uint8) for r in runs]).astype(np.int64) - (LENGTH - 1)
        held = np.where(flags, windows, 1)
        first = np.cumsum(held) - held
        out, begin = [], 0
        for r in rows:
            at = place[begin:begin + len(unpack(r["b"], np.uint8))]
            begin += len(at)
            n = held[at]
            entry = np.repeat(first[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            out.append((_FOUND, r["g"], r["run"], r["part"], pack(flags[at].astype(np.uint8)), pack(low[entry])))
        return _messages(out)
    return run


def _send(route: Route):
    """Stage 3, in the texts' groups: runs of the suffixes of shared anchors to their owners, occurrences to this group."""
    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        out = []
        if docs.num_rows and told.num_rows:
            g = docs.column("g")[0].as_py()
            keys = np.concatenate([unpack(x, np.int64) for x in told.column("a").to_pylist()])
            low = np.concatenate([unpack(x, np.uint32) for x in told.column("b").to_pylist()])
            asked = np.unique(keys)
            own = docs.column("key").combine_chunks().to_numpy()
            mine = np.flatnonzero(np.isin(own, asked))
            if len(mine):
                docs = docs.take(pa.array(mine))
                own = own[mine]
                ids = docs.column("doc_id").combine_chunks().to_numpy()
                raw, offsets = tb.column_bytes(docs.column("text"))
                text, gram, p, lo, hi = anchors(raw, offsets)
                # (document, hash) pairs that were told.
                salt = np.uint64(tb.BASE)
                want = np.unique(tb.mix(keys.view(np.uint64) * salt + low))
                have = tb.mix(own[text].view(np.uint64) * salt + (gram & np.uint64(0xFFFFFFFF)))
                keep = np.flatnonzero(np.isin(have, want))
                text, gram, p, lo, hi = text[keep], gram[keep], p[keep], lo[keep], hi[keep]
                size = hi - lo + LENGTH
                place = np.arange(WIDE)
                for number, a in enumerate(range(0, len(text), _RUN_ROWS)):
                    s = slice(a, a + _RUN_ROWS)
                    strings = np.zeros((len(size[s]), WIDE), np.uint8)
                    for b in range(0, len(strings), 10_000):
                        c = slice(a + b, min(a + b + 10_000, s.stop))
                        inside = place < size[c][:, None]
                        at = np.minimum(lo[c][:, None] + place, len(raw) - 1)
                        strings[b:b + 10_000] = np.where(inside, raw[at], np.uint8(0))
                    used, local = np.unique(text[s], return_inverse=True)
                    runs, index = _sorted_runs(strings, size[s], (p - lo)[s], local, lo[s] - offsets[text[s]], ids[text[s]], _part(gram[s], route.parts) // route.fan)
                    out += [(_RUN, g, number, *r) for r in runs]
                    out.append((_INDEX, g, number, 0, *index, pack(own[used]), pack(ids[used])))
        return _messages(out)
    return run


def _decode(shared: np.ndarray, sizes: np.ndarray, rest: bytes) -> list[bytes]:
    """The strings of a front-coded run."""
    out, last, at = [], b"", 0
    for s, n in zip(shared.tolist(), sizes.tolist()):
        more = n - s
        last = last[:s] + rest[at:at + more]
        at += more
        out.append(last)
    return out


def _common(x: bytes, y: bytes, known: int) -> int:
    """Length of the common prefix of x and y, which share `known` bytes."""
    n = min(len(x), len(y))
    d = int.from_bytes(x[known:n], "big") ^ int.from_bytes(y[known:n], "big")
    return n - ((d.bit_length() + 7) >> 3)


def merge_runs(runs: list[tuple[list[bytes], list[int]]]) -> Iterator[tuple[bytes, int, int, int]]:
    """Merges sorted runs of (strings, common prefix with the string before) by a loser tree.

    Yields (string, run, place in the run, common prefix with the string yielded before).  A node
    keeps the loser and its common prefix with the node's winner; since every contender's prefix with
    the last winner is known, unequal prefixes decide without looking at a byte, and equal ones are
    compared from there on.
    """
    runs = list(runs)
    width = 1
    while width < max(len(runs), 1):
        width *= 2
    strings = [r[0] for r in runs] + [[]] * (width - len(runs))
    prefix = [r[1] for r in runs] + [[]] * (width - len(runs))
    at = [0] * width
    loser, known = [-1] * width, [0] * width

    def play(node: int, x: int, cx: int, y: int, cy: int) -> tuple[int, int]:
        """Winner of contenders x and y (runs, or -1 for an ended one); the loser stays at the node."""
        if x < 0 or (y >= 0 and cy > cx):
            loser[node], known[node] = x, cx
            return y, cy
        if y < 0 or cx > cy:
            loser[node], known[node] = y, cy
            return x, cx
        sx, sy = strings[x][at[x]], strings[y][at[y]]
        c = _common(sx, sy, cx)
        if sx[c:c + 1] < sy[c:c + 1] or (sx[c:c + 1] == sy[c:c + 1] and x < y):
            loser[node], known[node] = y, c
            return x, cx
        loser[node], known[node] = x, c
        return y, cy

    def build(node: int) -> tuple[int, int]:
        if node >= width:
            run = node - width
            return (run, 0) if strings[run] else (-1, 0)
        (x, cx), (y, cy) = build(2 * node), build(2 * node + 1)
        return play(node, x, cx, y, cy)

    winner, shared = build(1) if width > 1 else ((0, 0) if strings and strings[0] else (-1, 0))
    while winner >= 0:
        i = at[winner]
        yield strings[winner][i], winner, i, shared
        run = winner
        at[run] = i = i + 1
        if i < len(strings[run]):
            x, cx = run, prefix[run][i]
        else:
            x, cx = -1, 0
        node = (run + width) >> 1
        while node:
            y, cy = loser[node], known[node]
            if x >= 0 and (y < 0 or cx > cy):
                pass
            elif y < 0 and x < 0:
                pass
            elif x < 0 or cy > cx:
                loser[node], known[node] = x, cx
                x, cx = y, cy
            else:
                sx, sy = strings[x][at[x]], strings[y][at[y]]
                c = _common(sx, sy, cx)
                bx, by = sx[c:c + 1], sy[c:c + 1]
                if bx < by or (bx == by and x < y):
                    known[node] = c
                else:
                    loser[node], known[node] = x, c
                    x, cx = y, cy
            node >>= 1
        winner, shared = x, cx


def _least_by_window(strings: list[bytes], anchor: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix its windows' least documents: (first entry of each suffix, entries).  The strings are emptied."""
    size = np.array([len(s) for s in strings], np.int64)
    windows = size - LENGTH + 1
    first = np.concatenate([[0], np.cumsum(windows)])
    out = np.repeat(least, windows)
    body = np.empty((len(strings), WIDE), np.uint8)
    for a in range(0, len(strings), 20_000):  # filled in blocks, and each block's strings are dropped
        some = strings[a:a + 20_000]
        body[a:a + len(some)] = np.frombuffer(b"".join([s.ljust(WIDE, b"\0") for s in some]), np.uint8).reshape(len(some), WIDE)
        strings[a:a + len(some)] = [b""] * len(some)
    grams = np.ascontiguousarray(body[np.arange(len(strings))[:, None], anchor[:, None] + np.arange(GRAM)])
    pair = grams.view(np.uint64)
    _, group = np.unique(tb.mix(pair[:, 0]) * np.uint64(tb.BASE) + pair[:, 1], return_inverse=True)
    several = np.flatnonzero(np.bincount(group)[group] > 1)
    # Suffixes of one anchor are matched together; chunks keep whole anchors.
    several = several[np.argsort(group[several], kind="stable")]
    ends = np.flatnonzero(np.concatenate([group[several][1:] != group[several][:-1], [True]])) + 1 if len(several) else []
    begin, total = 0, 0
    down = tb.powers(WIDE + 1)[1]
    for k, end in enumerate(ends):
        total = end - begin
        if total < 20_000 and k < len(ends) - 1:
            continue
        rows = several[begin:end]
        begin = end
        own = np.repeat(np.arange(len(rows)), windows[rows])
        offset = np.arange(len(own)) - np.repeat(np.concatenate([[0], np.cumsum(windows[rows])[:-1]]), windows[rows])
        h = np.zeros((len(rows), WIDE + 1), np.uint64)
        np.cumsum(tb.BYTE_CODES[body[rows]] * tb.powers(WIDE)[0], axis=1, out=h[:, 1:])
        w = tb.mix((h[own, offset + LENGTH] - h[own, offset]) * down[offset])
        order = np.argsort(w, kind="stable")
        w = w[order]
        head = np.concatenate([[True], w[1:] != w[:-1]])
        start = np.flatnonzero(head)
        low = np.minimum.reduceat(least[rows][own][order], start)
        value = np.empty(len(w), np.int64)
        value[order] = np.repeat(low, np.diff(np.append(start, len(w))))
        out[first[rows][own] + offset] = value
    return first, out


def _spans(keys: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping or touching spans of equal keys joined; sorted by key and begin."""
    if not len(keys):
        return keys, begin, end
    order = np.lexsort((begin, keys))
    keys, begin, end = keys[order], begin[order], end[order]
    fresh = np.concatenate([[True], keys[1:] != keys[:-1]])
    group = np.cumsum(fresh) - 1
    far = int(end.max()) + 1
    reach = np.maximum.accumulate(end + group * far) - group * far
    head = fresh | np.concatenate([[False], begin[1:] > reach[:-1]])
    first = np.flatnonzero(head)
    last = np.append(first[1:], len(keys)) - 1
    return keys[first], begin[first], reach[last]


def _merge(rows: pa.Table) -> pa.Table:
    """Stages 3 and 4, in the owners' tasks: runs merged, and each run told its windows' least documents."""
    rows = rows.to_pylist()
    runs, anchor_of, least_of = [], [], []
    for r in rows:
        shared, sizes = unpack(r["a"], np.uint8), unpack(r["b"], np.uint8)
        runs.append((_decode(shared, sizes, unpack(r["d"], np.uint8).tobytes()), shared.tolist()))
        anchor_of.append(unpack(r["c"], np.uint8))
        least_of.append(unpack(r["e"], np.int64))
    place = [np.empty(len(r[0]), np.int64) for r in runs]
    merged: list[bytes] = []
    anchor: list[int] = []
    for s, k, i, c in merge_runs(runs):
        if not merged or c < len(s) or len(merged[-1]) != len(s):
            merged.append(s)
            anchor.append(int(anchor_of[k][i]))
        place[k][i] = len(merged) - 1
    runs.clear()
    least = np.full(len(merged), np.iinfo(np.int64).max)
    np.minimum.at(least, np.concatenate(place), np.concatenate(least_of))
    first, low = _least_by_window(merged, np.array(anchor, np.int64), least)
    # One document for a suffix whose windows all have the same, else one for each window.
    several = np.minimum.reduceat(low, first[:-1]) != np.maximum.reduceat(low, first[:-1])
    windows = np.diff(first)
    out = []
    for r, at in zip(rows, place):
        flags = several[at]
        n = np.where(flags, windows[at], 1)
        entry = np.repeat(first[at] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        out.append((_FOUND, r["g"], r["run"], r["part"], pack(flags.astype(np.uint8)), pack(low[entry])))
    return _messages(out)


def _resolve(rows: pa.Table) -> pa.Table:
    """In the texts' groups: the spans to remove, from the occurrences and what the owners told of their suffixes."""
    index, told = {}, {}
    for r in rows.to_pylist():
        if r["kind"] == _INDEX:
            g = r["g"]
            index[r["run"]] = r
        else:
            told.setdefault(r["run"], []).append(r)
    found = []
    for number, r in index.items():
        answers = sorted(told[number], key=lambda x: x["part"])
        flags = np.concatenate([unpack(x["a"], np.uint8) for x in answers]) > 0
        low = np.concatenate([unpack(x["b"], np.int64) for x in answers])
        windows = unpack(r["a"], np.uint8).astype(np.int64) - (LENGTH - 1)
        which = np.repeat(np.arange(len(windows)), unpack(r["b"], np.int64))
        doc, at = unpack(r["c"], np.uint32), unpack(r["d"], np.int64)
        keys, ids = unpack(r["e"], np.int64)[doc], unpack(r["f"], np.int64)[doc]
        held = np.where(flags, windows, 1)
        first = np.cumsum(held) - held
        for a in range(0, len(which), 30_000):
            s = slice(a, a + 30_000)
            w = which[s]
            n = windows[w]
            own = np.repeat(np.arange(len(n)), n)
            offset = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
            hit = np.flatnonzero(low[first[w][own] + np.where(flags[w][own], offset, 0)] < ids[s][own])
            start = at[s][own[hit]] + offset[hit]
            found.append(_spans(keys[s][own[hit]], start, start + LENGTH))
    names = ("a", "b", "c")
    if not found:
        return pa.table({"g": pa.array([], pa.int32()), **{n: pa.array([], pa.binary()) for n in names}})
    spans = _spans(*(np.concatenate(x) for x in zip(*found)))
    return pa.table({"g": pa.array([g], pa.int32()), **{n: pa.array([pack(x)], pa.binary()) for n, x in zip(names, spans)}})


def _hash(doc_id: Column, text: Column, salt: int) -> Column:
    """A hash of id and text that is never 0."""
    h = F.xxhash64(F.lit(salt), doc_id.cast("long"), text)
    return F.when(h == 0, F.lit(1)).otherwise(h).cast("long")


def _document_key(docs: DataFrame) -> Column:
    """A number for each document: rows of equal id and text have it in common, and no others.

    It is a hash of 64 bits, which at 10^11 documents some hundreds of pairs would share.  So a second, independent hash
    is counted by the first, and documents whose first hash is not theirs alone get another one, until none is shared.
    """
    doc_id, text = (F.col(quoted(column_of(docs, c))) for c in ("doc_id", "text"))
    key, other = _hash(doc_id, text, 1), F.xxhash64(F.lit(0), text, doc_id.cast("long"))
    for salt in range(2, 10):
        kinds = docs.select(key.alias("key"), other.alias("other")).groupBy("key").agg(F.min("other").alias("a"), F.max("other").alias("b"))
        # About n * n / 2**65 keys, so 300 of 10^11 documents.
        shared = [r[0] for r in kinds.where("a <> b").select("key").limit(_SHARED_KEYS + 1).collect()]
        if not shared:
            return key
        if len(shared) > _SHARED_KEYS:
            break
        key = F.when(key.isin(shared), _hash(doc_id, text, salt)).otherwise(key)
    raise RuntimeError("documents' hashes are not spread")


#: More shared keys than any table that can be stored gives by chance.
_SHARED_KEYS = 100_000


def _dealt(docs: DataFrame, key: Column, groups: int) -> DataFrame:
    """(row, doc_id, text, key, g) of docs: row has its columns but the text by number; key as made above, g the group it is in."""
    doc_id, text = (F.col(quoted(column_of(docs, c))) for c in ("doc_id", "text"))
    row = F.struct(F.lit(0).alias("none"), *[F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(docs.columns) if c.lower() != "text"])
    return docs.select(row.alias("row"), doc_id.cast("long").alias("doc_id"), text.alias("text"), key.alias("key"),
                       F.pmod(key, F.lit(groups)).cast("int").alias("g"))


def find_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(g, keys, begins, ends) blobs of the spans to remove, and docs dealt to the same groups."""
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length(F.col(quoted(column_of(docs, "text")))))).first()[0] or 0
    groups = max(partitions(spark), int(total // GROUP_BYTES) + 1)
    order_id = F.coalesce("doc_id", F.lit(2**63 - 1)).alias("doc_id")
    dealt = _dealt(docs, _document_key(docs), groups)
    keyed = dealt.where(F.octet_length("text") >= LENGTH).select("text", "key", "g", order_id)
    route = Route(groups)
    with Workspace(spark) as work:
        asked = work.written(keyed.select("text", "key").mapInArrow(_ask(groups, route), _TOLD), "asked")
        up = route.up(asked.where("kind = 0"), _gather(groups, route), _TOLD, work, "gathered")
        answers = up.where("kind = 0").groupBy("part").applyInArrow(lean(_answer(groups)), "g int, a binary, b binary")
        told = [x.where("kind = 1").select(F.col("part").alias("g"), "a", "b") for x in ((asked, up) if route.fan > 1 else (asked,))]
        told = work.written(reduce(DataFrame.union, told, answers), "told")
        work.drop("asked")
        sent = work.written(keyed.groupBy("g").cogroup(told.groupBy("g")).applyInArrow(lean(_send(route)), _MESSAGE), "sent")
        work.drop("told")
        runs = sent.where(F.col("kind") == _RUN)
        up = route.up(runs, _up(route), _MESSAGE, work, "merged")
        found = work.written(up.groupBy("part").applyInArrow(lean(_merge), _MESSAGE), "found")
        found = route.down(runs, found, _down(route), _MESSAGE, work, "handed")
        both = sent.where(F.col("kind") == _INDEX).union(found)
        return written(both.groupBy("g").applyInArrow(lean(_resolve), "g int, a binary, b binary, c binary"), "spans"), dealt


def _spans_by_key(spans: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    if not spans.num_rows:
        return {}
    keys, begin, end = (np.concatenate([unpack(x, np.int64) for x in spans.column(c).to_pylist()]) for c in "abc")
    keys, begin, end = _spans(keys, begin, end)
    cuts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])).tolist() if len(keys) else []
    return {int(keys[a]): (begin[a:b], end[a:b]) for a, b in zip(cuts, [*cuts[1:], len(keys)])}


def _cut(data: bytes, spans: tuple[np.ndarray, np.ndarray] | None) -> bytes:
    if spans is None:
        return data
    out, at = [], 0
    for b, e in zip(spans[0].tolist(), spans[1].tolist()):
        out.append(data[at:b])
        at = e
    return b"".join([*out, data[at:]])


def removed(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans (array of begin and end) of every row."""
    spans, dealt = find_spans(docs)
    kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))

    def run(rows: pa.Table, found: pa.Table) -> pa.Table:
        by_key = _spans_by_key(found)
        out = []
        for doc_id, text, key in zip(*(rows.column(c).to_pylist() for c in ("doc_id", "text", "key"))):
            data = (text or "").encode()
            s = by_key.get(key)
            kept = _cut(data, s)
            pairs = [] if s is None else [{"begin": b, "end": e} for b, e in zip(s[0].tolist(), s[1].tolist())]
            out.append((doc_id, len(data), len(data) - len(kept), len(pairs), hashlib.sha256(kept).hexdigest(), pairs))
        names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), kind)
        return pa.table({n: pa.array([r[i] for r in out], t) for i, (n, t) in enumerate(zip(names, kinds))})
    return dealt.drop("row").groupBy("g").cogroup(spans.groupBy("g")).applyInArrow(
        lean(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<begin: long, end: long>>")


def cleaned(docs: DataFrame) -> DataFrame:
    """docs, all columns, with the spans cut from text (and n_chars, if there, made to fit).

    A character that is only half in a span goes with it.  Rows that lose their whole text are left out;
    null and empty texts stay.  Columns may have any names; text, doc_id and n_chars any case.
    """
    spans, dealt = find_spans(docs)

    def run(rows: pa.Table, found: pa.Table) -> pa.Table:
        by_key = _spans_by_key(found)
        texts, keep, cut = [], [], []
        for text, key in zip(rows.column("text").to_pylist(), rows.column("key").to_pylist()):
            s = by_key.get(key)
            new = text if s is None or text is None else _cut(text.encode(), s).decode("utf-8", "ignore")
            texts.append(new)
            cut.append(s is not None and text is not None)
            keep.append(not (text and not new))
        out = pa.table({"row": rows.column("row"), "text": pa.array(texts, pa.string()), "cut": pa.array(cut, pa.bool_())})
        return out.filter(pa.array(keep, pa.bool_()))
    rows = dealt.select("row", "text", "key", "g")
    schema = T.StructType([rows.schema["row"], T.StructField("text", T.StringType()), T.StructField("cut", T.BooleanType())])
    out = rows.groupBy("g").cogroup(spans.groupBy("g")).applyInArrow(lean(run), schema)

    def column(i: int, field: T.StructField):
        if field.name.lower() == "text":
            own = F.col("text").cast(field.dataType)
        elif field.name.lower() == "n_chars":
            own = F.when(F.col("cut"), F.length("text").cast(field.dataType)).otherwise(F.col(f"row.c{i}"))
        else:
            own = F.col(f"row.c{i}")
        return own.alias(field.name)
    return out.select(*[column(i, f) for i, f in enumerate(docs.schema)])
