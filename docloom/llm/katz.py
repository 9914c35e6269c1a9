"""Language-model scoring: Katz backoff of any order (3 by default) over all training documents.

Tokens are words (A-Z lower-cased) and one end token a document.  An n-gram that training holds has its
Good-Turing discounted relative frequency, P(w|h) = d(r) * r / N(h); another one backs off to the history
without its first word, P(w|h) = alpha(h) * P(w|h'), and a history that training doesn't hold passes on to
h' as it is.  alpha(h) = (1 - sum of P(w|h) over seen w) / (1 - sum of P(w|h') over seen w), so every
history sums to one exactly.  The recursion ends at words, which are discounted the same way; what is left
there is the probability of one unknown word.  Where nothing is discounted N(h) is one larger, so that
something is always left.  Good-Turing counts that are not usable (empty or rising count classes, as in tiny
corpora) leave their r undiscounted.  A text's first word has the start as its history, its second word the
start and the first word, and so on.

The counts are partitioned tables keyed by word and by history.  Documents are dealt into groups by a hash;
a group's tokens are read once and kept as numbers.  Order by order, a group asks each partition for the
n-grams and histories it holds, in sorted compact blobs, and gets their counts, names and alphas, aligned to
what it asked; its tokens' n-grams of the next order are made of these names.  Nothing of the model's size is
ever in one place, neither counts nor answers.  Histories more frequent than a partition's share are split
over several partitions by the following word.

An n-gram's name is a number of its own that its partition gives it, so names are exact at any size; words
are told apart by 64-bit hashes.  All counts and names have 64 bits.

Null texts are empty: an end token alone.  Rows that repeat an id are texts of their own.  Without training
documents every score is 0.
"""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import textbytes as tb
from .packing import lean, pack, pack_sorted, unpack, unpack_sorted
from .routing import Route
from .shared import Workspace, column_of, partitions, quoted, written

#: Exchanges of orders above 2, whose n-grams are most, are done in so many passes, over every PASSES-th group or partition:
#: only their messages are shuffled at once.
PASSES = 3
#: Counts up to this are discounted.
DISCOUNTED = 5
ORDER = 3
GROUP_BYTES = 8 << 20
END = np.uint64(0x456E64)  # the end token's hash
START = np.uint64(0xFFFFFFFFFFFFFFFF)  # the name of a text's start
NONE = np.uint64(0)  # the name of what training doesn't hold


def tokens(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all texts' tokens, end token included; first token of each text and one more)."""
    out, counts = [], []
    for i, j in tb.slices(offsets):
        part = tb.LOWER[raw[offsets[i]:offsets[j]]]
        starts, ends, first = tb.word_spans(part, offsets[i:j + 1] - offsets[i])
        n = np.diff(first)
        row = np.full(len(starts) + (j - i), END)
        word = np.ones(len(row), bool)
        word[np.cumsum(n + 1) - 1] = False
        row[word] = tb.span_hashes(part, starts, ends)
        out.append(row)
        counts.append(n + 1)
    counts = np.concatenate(counts or [np.zeros(0, np.int64)])
    return np.concatenate(out or [np.zeros(0, np.uint64)]), np.concatenate([[0], np.cumsum(counts)])


def discounts(n: dict[int, int], k: int = DISCOUNTED) -> np.ndarray:
    """Good-Turing discounts d[r] for r of 0 to k + 1; d is 1 from k + 1 on.  n: n-grams of each count."""
    d = np.ones(k + 2)
    n1 = n.get(1, 0)
    if not n1:
        return d
    common = (k + 1) * n.get(k + 1, 0) / n1
    for r in range(1, k + 1):
        if n.get(r, 0) and n.get(r + 1, 0) and common < 1:
            value = ((r + 1) * n[r + 1] / (n[r] * r) - common) / (1 - common)
            if 0 < value < 1:
                d[r] = value
    return d


def discounted(r: np.ndarray, d: np.ndarray) -> np.ndarray:
    return r * d[np.minimum(r, len(d) - 1).astype(np.int64)]


class Unigrams:
    """Unigram probabilities by count, and the base model's."""

    def __init__(self, n: dict[int, int]):
        self.n_tokens = sum(r * c for r, c in n.items())
        self.n_types = sum(n.values())
        self.d = discounts(n)
        kept = sum(r * c * self.d[min(r, DISCOUNTED + 1)] for r, c in n.items())
        # Rounding must not look like something left over.
        left = any(self.d[r] < 1 and n.get(r, 0) for r in range(1, DISCOUNTED + 1))
        self.total = self.n_tokens + (0 if left else 1)
        self.unknown = 1 - kept / self.total

    def p(self, r: np.ndarray) -> np.ndarray:
        return np.where(r > 0, discounted(r, self.d) / self.total, self.unknown)

    def base(self, r: np.ndarray) -> np.ndarray:
        return np.log10((r + 1) / (self.n_tokens + self.n_types + 1))


def backoff(total: np.ndarray, low_counts: np.ndarray, lower: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(N, log10 alpha) of histories.

    total: sums of the counts of what follows; low_counts: how many follow 1 to DISCOUNTED times; lower: what the
    lower order gives to all that follows.
    """
    r = np.arange(1, DISCOUNTED + 1)
    left = low_counts @ (r * (1 - d[1:-1]))
    some = low_counts[:, d[1:-1] < 1].sum(1) > 0
    n = total + ~some
    left = np.where(some, left, 1.0)
    return n, np.log10(np.maximum(left / np.maximum(n, 1), 1e-300)) - np.log10(np.maximum(1 - lower, 1e-300))


@dataclass
class Model:
    """What is known of the model as a whole: a few numbers, and histories split over partitions (one a partition at most)."""
    route: Route
    uni: Unigrams
    d: dict[int, np.ndarray] = field(default_factory=dict)
    hot: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=dict)  # names, N, log10 alpha


def _part(h: np.ndarray, parts: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _heads(x: np.ndarray) -> np.ndarray:
    """Where runs of equal neighbours begin."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)


def _cuts(x: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of equal neighbours."""
    first = _heads(x).tolist()
    return list(zip(first, [*first[1:], len(x)]))


# --- messages --------------------------------------------------------------------------------------------------

_TEXT, _ASK, _TOLD = 0, 1, 2
_BLOBS = "abcdefh"
_MESSAGE = "kind int, k int, g int, part int, " + ", ".join(f"{c} binary" for c in _BLOBS)


def _messages(rows: list[tuple]) -> pa.Table:
    """Rows of _MESSAGE; missing blobs are null."""
    full = [(*r, *(None,) * (4 + len(_BLOBS) - len(r))) for r in rows]
    return pa.table({n: pa.array([r[i] for r in full], pa.int32() if i < 4 else pa.binary()) for i, n in enumerate(("kind", "k", "g", "part", *_BLOBS))})


def _read(route: Route):
    """A group's texts as numbers, kept for all that follows, and its words with their training counts to their owners."""
    def run(docs: pa.Table) -> pa.Table:
        g = docs.column("g")[0].as_py()
        row, first = tokens(*tb.column_bytes(docs.column("text")))
        words, index = np.unique(row, return_inverse=True)
        train = docs.column("train").combine_chunks().to_numpy(zero_copy_only=False)
        n = np.diff(first)
        count = np.bincount(index[np.repeat(train, n)], minlength=len(words)).astype(np.uint64)
        part = _part(words, route.parts) // route.fan
        ids = docs.column("doc_id").combine_chunks()
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        # Frequent words have small numbers, which packs well.
        common = np.argsort(-np.bincount(index, minlength=len(words)), kind="stable").astype(np.uint32)
        number = np.empty(len(words), np.uint32)
        number[common] = np.arange(len(words), dtype=np.uint32)
        out = [(_TEXT, 0, g, 0, pack(number[index]), pack(n.astype(np.int64)), pack(train.astype(np.uint8)),
                pack(ids.fill_null(0).to_numpy()), pack(known.astype(np.uint8)), pack(common))]
        out += [(_ASK, 1, g, int(part[a]), pack_sorted(words[a:b]), pack(count[a:b])) for a, b in _cuts(part)]
        return _messages(out)
    return run


# --- owners of words and histories -----------------------------------------------------------------------------

def _named(count: np.ndarray, parts: int, part: int) -> np.ndarray:
    """A name for each entry of a partition: small for frequent ones, which packs well."""
    name = np.empty(len(count), np.uint64)
    name[np.argsort(-count, kind="stable")] = np.arange(len(count), dtype=np.uint64) * np.uint64(parts) + np.uint64(part + 1)
    return np.where(count > 0, name, NONE)


def _distinct_words(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(distinct words, their counts, place of each row's words)."""
    words = [unpack_sorted(r["a"]) for r in rows]
    counts = np.concatenate([unpack(r["b"], np.uint64) for r in rows])
    every, index = np.unique(np.concatenate(words), return_inverse=True)
    total = np.zeros(len(every), np.int64)
    np.add.at(total, index, counts.astype(np.int64))
    return every, total, np.split(index, np.cumsum([len(w) for w in words])[:-1])


def _gather_words(route: Route):
    """A node's questions to the owners."""
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.to_pylist()
        words, total, _ = _distinct_words(rows)
        part = _part(words, route.parts)
        return _messages([(_ASK, 1, rows[0]["node"], int(part[a]), pack_sorted(words[a:b]), pack(total[a:b].astype(np.uint64))) for a, b in _cuts(part)])
    return run


def _hand_words(rows: pa.Table, told: pa.Table) -> pa.Table:
    """A node's answers to its groups."""
    rows, told = rows.to_pylist(), sorted(told.to_pylist(), key=lambda r: r["part"])
    _, _, places = _distinct_words(rows)
    count, name = (np.concatenate([unpack(r[c], np.uint64) for r in told]) for c in "ab")
    return _messages([(_TOLD, 1, r["g"], r["part"], pack(count[i]), pack(name[i])) for r, i in zip(rows, places)])


_STATS = "r long, n long, name long, total long, low_counts array<long>, lower double"


def _stats(r: np.ndarray, n: np.ndarray, hot: tuple = ()) -> pa.Table:
    """Rows (r, n) of how many entries have a count, and rows (name, ...) of split histories."""
    name, total, low, lower = hot or (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros((0, DISCOUNTED), np.int64), np.zeros(0))
    a, b = len(r), len(name)
    long = lambda x, before, after: pa.concat_arrays([pa.nulls(before, pa.int64()), pa.array(np.asarray(x, np.int64)), pa.nulls(after, pa.int64())])
    return pa.table({"r": long(r, 0, b), "n": long(n, 0, b), "name": long(name.view(np.int64), a, 0), "total": long(total, a, 0),
                     "low_counts": pa.array([None] * a + low.tolist(), pa.list_(pa.int64())), "lower": pa.concat_arrays([pa.nulls(a, pa.float64()), pa.array(lower)])})


def _count_words(rows: pa.Table) -> pa.Table:
    _, total, _ = _distinct_words(rows.to_pylist())
    return _stats(*np.unique(total[total > 0], return_counts=True))


def _tell_words(parts: int):
    """Each group's words' counts and names."""
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.to_pylist()
        _, total, places = _distinct_words(rows)
        name = _named(total, parts, rows[0]["part"])
        return _messages([(_TOLD, 1, r["g"], r["part"], pack(total[i].astype(np.uint64)), pack(name[i])) for r, i in zip(rows, places)])
    return run


def _sorted_pairs(number: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The order by number, then word; by one key where both fit into 64 bits."""
    bits = int(word.max()).bit_length() if len(word) else 0
    if int(number.max() if len(number) else 0).bit_length() + bits <= 64:
        return np.argsort((number.astype(np.uint64) << np.uint64(min(bits, 63))) | word)
    return np.lexsort((word, number))


class _Grams:
    """Distinct n-grams of one order by the part they are asked of, as questions, and to take answers.

    They come sorted by history and word, and stay so within each part.  salt: over how many parts a history is split;
    word gives the words at places.  Only who asks needs `details`: word, lower count and N of the lower history.
    """

    def __init__(self, history: np.ndarray, salt: np.ndarray, word: Callable, route: Route, fan: int, details: tuple | None = None):
        part = _part(tb.mix(history), route.parts)
        split = np.flatnonzero(salt > 1)
        part[split] = (part[split] + (tb.mix(word(split)) % salt[split]).astype(np.int64)) % route.parts
        part = (part // fan).astype(np.uint16 if route.parts <= 1 << 16 else np.uint32)  # small numbers sort fast
        self.order = np.argsort(part, kind="stable")
        self.part, self.history = part[self.order], history[self.order]
        if details:
            self.salt = salt[self.order]
            self.word, self.lower, self.lower_n = (x[self.order] for x in details)

    def questions(self, sender: int, k: int, seen: np.ndarray) -> list[tuple]:
        out = []
        for i, j in _cuts(self.part):
            head = _heads(self.history[i:j])
            out.append((_ASK, k, sender, int(self.part[i]), pack_sorted(self.history[i:j][head]), pack(np.diff(np.append(head, j - i)).astype(np.uint32)),
                        pack(self.salt[i:j][head]), pack(self.word[i:j]), pack(self.lower[i:j].astype(np.uint64)),
                        pack(self.lower_n[i:j][head].astype(np.uint64)), pack(seen[i:j].astype(np.uint64))))
        return out

    def hear(self, told: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(count, name, N of the history, log10 alpha of the history) of each."""
        m = len(self.part)
        count, n, alpha, name = np.zeros(m, np.int64), np.ones(m, np.int64), np.zeros(m), np.zeros(m, np.uint64)
        answers = {r["part"]: r for r in told}
        for i, j in _cuts(self.part):
            r = answers[int(self.part[i])]
            count[i:j] = unpack(r["a"], np.uint64)
            if r["b"]:
                name[i:j] = unpack(r["b"], np.uint64)
            head = _heads(self.history[i:j])
            size = np.diff(np.append(head, j - i))
            n[i:j] = np.repeat(unpack(r["c"], np.uint64).astype(np.int64), size)
            need = np.logical_or.reduceat(count[i:j] == 0, head)
            own = np.zeros(len(head))
            own[need] = unpack(r["d"], np.float64)
            alpha[i:j] = np.repeat(own, size)
        return count, name, n, alpha


class _Counted:
    """All n-grams that a partition (or a node) is asked for, counted: history, word, count, and the lower order's counts."""

    def __init__(self, rows: list[dict]):
        self.row_history = [unpack_sorted(r["a"]) for r in rows]
        lengths = [unpack(r["b"], np.uint32).astype(np.int64) for r in rows]
        spread = lambda parts: np.concatenate([np.repeat(x, n) for x, n in zip(parts, lengths)])
        self.history, place = np.unique(np.concatenate(self.row_history), return_inverse=True)
        number = np.repeat(place, np.concatenate(lengths))
        word = np.concatenate([unpack(r["d"], np.uint64) for r in rows])
        order = _sorted_pairs(number, word)
        h, w = number[order], word[order]
        fresh = np.ones(len(order), bool)
        fresh[1:] = (h[1:] != h[:-1]) | (w[1:] != w[:-1])
        del w
        first = np.flatnonzero(fresh)
        index = np.empty(len(order), np.int64)
        index[order] = np.cumsum(fresh) - 1
        self.rows = np.split(index, np.cumsum([int(n.sum()) for n in lengths])[:-1])
        seen = np.concatenate([unpack(r["h"], np.uint64) for r in rows]).astype(np.int64)
        self.count = np.add.reduceat(seen[order], first) if len(first) else seen
        one = order[first]
        self.heads = _heads(h[first])
        self.number, self.word = h[first], word[one]
        self.salt = spread([unpack(r["c"], np.uint64) for r in rows])[one]
        self.lower_count = np.concatenate([unpack(r["e"], np.uint64) for r in rows])[one].astype(np.int64)
        self.gram_n = spread([unpack(r["f"], np.uint64) for r in rows])[one].astype(np.int64)

    def sums(self, d_lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(total, low_counts, lower) of each history, as `backoff` takes them."""
        if not len(self.heads):
            return np.zeros(0, np.int64), np.zeros((0, DISCOUNTED), np.int64), np.zeros(0)
        r, add = self.count, lambda x: np.add.reduceat(x, self.heads)
        lower = np.where(r > 0, discounted(self.lower_count, d_lower) / np.maximum(self.gram_n, 1), 0.0)
        return add(r), np.stack([add((r == i).astype(np.int64)) for i in range(1, DISCOUNTED + 1)], 1), add(lower)


def _count_grams(model: Model, k: int):
    def run(rows: pa.Table) -> pa.Table:
        c = _Counted(rows.to_pylist())
        at = np.flatnonzero(c.salt[c.heads] > 1)
        return _stats(*np.unique(c.count[(c.count > 0) & (c.count <= DISCOUNTED + 1)], return_counts=True),
                      hot=(c.history[at], *(x[at] for x in c.sums(model.d[k - 1]))))
    return run


def _answers(rows: list[dict], c: _Counted, k: int, name: np.ndarray | None, n: np.ndarray, alpha: np.ndarray) -> pa.Table:
    """Counts and names of each row's n-grams; N of their histories, and alpha where the row has something to back off."""
    out = []
    for r, index, own in zip(rows, c.rows, c.row_history):
        at = np.searchsorted(c.history, own)
        count = c.count[index]
        size = unpack(r["b"], np.uint32).astype(np.int64)
        need = np.logical_or.reduceat(count == 0, np.cumsum(size) - size) if len(size) else np.zeros(0, bool)
        out.append((_TOLD, k, r["g"], r["part"], pack(count.astype(np.uint64)), b"" if name is None else pack(name[index]),
                    pack(n[at].astype(np.uint64)), pack(alpha[at[need]])))
    return _messages(out)


def _tell_grams(model: Model, k: int, last: bool):
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.to_pylist()
        c = _Counted(rows)
        n, alpha = backoff(*c.sums(model.d[k - 1]), model.d[k])
        return _answers(rows, c, k, None if last else _named(c.count, model.route.parts, rows[0]["part"]), n, alpha)
    return run


def _gather_grams(route: Route, k: int):
    """A node's questions to the owners."""
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.to_pylist()
        c = _Counted(rows)
        grams = _Grams(c.history[c.number], c.salt, lambda at: c.word[at], route, 1, (c.word, c.lower_count, c.gram_n))
        return _messages(grams.questions(rows[0]["node"], k, c.count[grams.order]))
    return run


def _hand_grams(route: Route, k: int, last: bool):
    """A node's answers to its groups."""
    def run(rows: pa.Table, told: pa.Table) -> pa.Table:
        rows = rows.to_pylist()
        c = _Counted(rows)
        grams = _Grams(c.history[c.number], c.salt, lambda at: c.word[at], route, 1)
        own = []
        for x in grams.hear(told.to_pylist()):
            y = np.empty_like(x)
            y[grams.order] = x
            own.append(y)
        c.count, name, n, alpha = own
        if len(c.heads):
            # An alpha is told where something is backed off; groups know those of split histories anyway.
            alpha = np.minimum.reduceat(np.where(c.count == 0, alpha, np.inf), c.heads)
        return _answers(rows, c, k, None if last else name, n[c.heads], alpha)
    return run


# --- groups ----------------------------------------------------------------------------------------------------

def _ranks(name: np.ndarray) -> np.ndarray:
    out = np.empty(len(name), np.int32 if len(name) < 2**31 - 1 else np.int64)
    out[np.argsort(name)] = np.arange(len(name))  # only unknown ones are equal, and their order doesn't matter
    return out


class _Group:
    """A group's tokens, and order by order what training holds of the n-grams that end at them.

    Both sides of an exchange build it from the same messages, so answers are aligned to questions.
    """

    def __init__(self, rows: list[dict], model: Model):
        text = next(r for r in rows if r["kind"] == _TEXT)
        self.model, self.g = model, text["g"]
        self.index = unpack(text["f"], np.uint32).astype(np.int32)[unpack(text["a"], np.uint32)]
        lengths = unpack(text["b"], np.int64)
        self.first = np.concatenate([[0], np.cumsum(lengths)])
        self.train = unpack(text["c"], np.uint8) > 0
        self.ids, self.known_ids = unpack(text["d"], np.int64), unpack(text["e"], np.uint8) > 0
        self.begins = np.zeros(len(self.index), bool)
        self.begins[self.first[:-1]] = True
        self.told = [r for r in rows if r["kind"] == _TOLD]
        told = self._told(1)
        self.word_count = np.concatenate([unpack(r["a"], np.uint64) for r in told]).astype(np.int64)
        self.word_name = np.concatenate([unpack(r["b"], np.uint64) for r in told])
        self.word_rank = _ranks(self.word_name)
        # The n-grams of the order reached: which one ends at a token (or -1), their counts, names, and the N of their histories.
        self.gram, self.count, self.name = self.index, self.word_count, self.word_name
        self.n = np.full(len(self.name), model.uni.total)

    def _told(self, k: int) -> list[dict]:
        return sorted((r for r in self.told if r["k"] == k), key=lambda r: r["part"])

    def of_texts(self, x: np.ndarray) -> np.ndarray:
        """Sums of x, a number a token, over each text (none is empty: each has its end)."""
        return np.add.reduceat(x, self.first[:-1]) if len(x) else np.zeros(0, x.dtype)

    def look(self, k: int, asking: bool = False) -> None:
        """The distinct n-grams of order k after histories that training holds.

        What has the length of all tokens is kept in small numbers and dropped early: it decides a task's memory.
        """
        route, uni = self.model.route, self.model.uni
        self.grams = self.of = self.asked = None
        seen = (self.count > 0)[self.gram] & (self.gram >= 0)
        # Tokens with such a history: the n-gram of the order before that ends at the token before, or the start.
        small = np.int32 if len(self.index) < 2**31 else np.int64
        self.asked = np.arange(len(self.index), dtype=small) if k == 2 else (np.flatnonzero(~self.begins[1:] & seen[:-1]) + 1).astype(small)
        begins = self.begins[self.asked]
        # Ranks of names: what is sorted by them is sorted by history and word.  The start's name is the largest.
        rank = _ranks(self.name) if k > 2 else self.word_rank
        key = rank[self.gram[self.asked - 1]].astype(np.int64)
        key[begins] = len(self.name)
        key *= len(self.word_name) + 1
        own = self.word_rank[self.index[self.asked]]
        own += 1
        own[~seen[self.asked]] = 0
        key += own
        del own, rank, seen
        order = np.argsort(key)
        key = key[order]
        order = order.astype(small)
        fresh = np.ones(len(key), bool)
        fresh[1:] = key[1:] != key[:-1]
        del key
        one = order[fresh]
        of = np.empty(len(order), small)
        of[order] = np.cumsum(fresh, dtype=small) - 1
        del order, fresh
        at, begins = self.asked[one], begins[one]
        before = self.gram[at - 1]
        history = np.where(begins, START, self.name[before])
        salt = (np.where(begins, 0, self.count[before]) // max(uni.n_tokens // route.parts, 1) + 1).astype(np.uint64)
        salt[begins] = np.uint64(route.parts)

        def lower(places):
            own = self.gram[places]
            return np.where(own >= 0, self.count[own], 0), np.where(own >= 0, self.n[own], 1)

        def words(places):
            return np.where(lower(places)[0] > 0, self.word_name[self.index[places]], NONE)
        self.grams = _Grams(history, salt, lambda some: words(at[some]), route, route.fan, (words(at), *lower(at)) if asking else None)
        del before, history, salt
        place = np.empty(len(one), small)
        place[self.grams.order] = np.arange(len(one))
        self.of = place[of]  # asked token -> n-gram

    def questions(self, k: int) -> list[tuple]:
        hit = np.repeat(self.train, np.diff(self.first))[self.asked]
        return self.grams.questions(self.g, k, np.bincount(self.of[hit], minlength=len(self.grams.part)))

    def hear(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Takes the answers of order k: (count, N, log10 alpha) of the n-grams looked for."""
        count, name, n, alpha = self.grams.hear(self._told(k))
        # Histories split over parts have their sums from all of them.
        names, hot_n, hot_alpha = self.model.hot[k]
        if len(names):
            at = np.minimum(np.searchsorted(names, self.grams.history), len(names) - 1)
            hit = names[at] == self.grams.history
            n[hit], alpha[hit] = hot_n[at[hit]], hot_alpha[at[hit]]
        self.count, self.name, self.n = count, name, n
        self.gram = np.full(len(self.index), -1, self.of.dtype)
        self.gram[self.asked] = self.of
        return count, n, alpha

    def reach(self, k: int) -> None:
        """Goes up to the questions of order k."""
        for i in range(2, k):
            self.look(i)
            self.hear(i)
        self.look(k, asking=True)


def _ask_grams(model: Model, k: int):
    def run(rows: pa.Table) -> pa.Table:
        group = _Group(rows.to_pylist(), model)
        group.reach(k)
        return _messages(group.questions(k))
    return run


def _score(model: Model, order: int):
    def run(rows: pa.Table) -> pa.Table:
        group = _Group(rows.to_pylist(), model)
        words = group.word_count
        value = np.log10(model.uni.p(words))[group.index]
        for k in range(2, order + 1):
            group.look(k)
            count, total, alpha = group.hear(k)
            with np.errstate(divide="ignore"):
                direct = np.log10(discounted(count, model.d[k])) - np.log10(np.maximum(total, 1))
            of, asked, hit = group.of, group.asked, count > 0
            group.grams = None
            for a in range(0, len(asked), 1 << 18):
                some, at = of[a:a + (1 << 18)], asked[a:a + (1 << 18)]
                value[at] = np.where(hit[some], direct[some], alpha[some] + value[at])
        return pa.table({
            "doc_id": pa.array(group.ids, mask=~group.known_ids), "train": pa.array(group.train), "n_tokens": pa.array(np.diff(group.first)),
            "n_known": pa.array(group.of_texts((words > 0).astype(np.int64)[group.index])),
            "base_score": pa.array(group.of_texts(model.uni.base(words)[group.index])), "score": pa.array(group.of_texts(value))})
    return run


def score(docs: DataFrame, train: Column, order: int = ORDER) -> DataFrame:
    """Scores every row of docs by the model of the rows where `train` holds.

    doc_id, train, n_tokens, n_known (tokens that training holds), train_tokens, base_score (add-one
    unigrams) and score (log10 probability of the text).
    """
    if order < 1:
        raise ValueError(order)
    spark = docs.sparkSession
    text = F.coalesce(F.col(quoted(column_of(docs, "text"))), F.lit(""))
    rows = docs.select(F.col(quoted(column_of(docs, "doc_id"))).cast("long").alias("doc_id"), text.alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(partitions(spark), int(total // GROUP_BYTES) + 1)
    rows = rows.withColumn("g", F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)).cast("int"))

    with Workspace(spark) as work:
        def passes(rows: DataFrame, key: str, run, schema: str, name: str, n: int = 1) -> DataFrame:
            own = [(rows.where(F.col(key) % n == i) if n > 1 else rows).groupBy(key).applyInArrow(lean(run), schema) for i in range(n)]
            return reduce(DataFrame.union, [work.written(x, f"{name}-{i}") for i, x in enumerate(own)])

        def stats(asked: DataFrame, run, n: int = 1) -> tuple[dict[int, int], list]:
            found = passes(asked, "part", run, _STATS, "stats", n)
            counts = found.where("r is not null").groupBy("r").agg(F.sum("n")).collect()  # one row for each different count: at most sqrt(2 * tokens)
            # Only histories with more than 1 / groups of all tokens, and the start, are split: at most groups + 1 rows.
            lows = [F.sum(F.col("low_counts")[i]).alias(f"n{i}") for i in range(DISCOUNTED)]
            hot = found.where("name is not null").groupBy("name").agg(F.sum("total").alias("total"), F.sum("lower").alias("lower"), *lows).collect()
            return {r[0]: r[1] for r in counts}, hot

        def messages(kind: int) -> DataFrame:
            return read.where(F.col("kind") == kind).select(*columns)
        columns = [x.split()[0] for x in _MESSAGE.split(", ")]
        route = Route(groups)
        read = work.written(rows.groupBy("g").applyInArrow(lean(_read(route)), _MESSAGE), "read", by="kind")
        asked = messages(_ASK)
        up = route.up(asked, _gather_words(route), _MESSAGE, work, "words")
        model = Model(route, Unigrams(stats(up, _count_words)[0]))
        model.d[1] = model.uni.d
        told = passes(up, "part", _tell_words(groups), _MESSAGE, "told")
        told = route.down(asked, told, _hand_words, _MESSAGE, work, "handed-1")
        work.drop_part("read", f"kind={_ASK}")
        held = messages(_TEXT).union(told)
        for k in range(2, order + 1):
            n = PASSES if k > 2 else 1
            asked = passes(held, "g", _ask_grams(model, k), _MESSAGE, "asked", n)
            up = route.up(asked, _gather_grams(route, k), _MESSAGE, work, "gathered")
            counts, hot = stats(up, _count_grams(model, k), n)
            model.d[k] = discounts(counts)
            names = np.array([r["name"] for r in hot], np.int64).view(np.uint64)
            at = np.argsort(names)
            numbers = lambda c: np.array([r[c] for r in hot])[at]
            low = np.array([[r[f"n{i}"] for i in range(DISCOUNTED)] for r in hot], np.int64).reshape(len(hot), DISCOUNTED)[at]
            model.hot[k] = (names[at], *backoff(numbers("total"), low, numbers("lower"), model.d[k])) if hot else (names, np.zeros(0, np.int64), np.zeros(0))
            told = passes(up, "part", _tell_grams(model, k, k == order), _MESSAGE, "told", n)
            told = route.down(asked, told, _hand_grams(route, k, k == order), _MESSAGE, work, f"handed-{k}")
            work.drop(*[f"asked-{i}" for i in range(n)])
            held = held.union(told)
        out = written(held.groupBy("g").applyInArrow(
            lean(_score(model, order)), "doc_id long, train boolean, n_tokens long, n_known long, base_score double, score double"), "scores")
    return out.withColumn("train_tokens", F.lit(model.uni.n_tokens).cast("long"))
