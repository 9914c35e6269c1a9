"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items are word sequences (A-Z lower-cased).  Shared runs of `least` words
are the seeds that bring a document and an item together, in a join of both sides' seeds.  For such a
pair, the longest match of words not yet marked in either is found by Karp-Rabin hashes of windows (the
length by bisection, the place by equal hashes, then checked word by word), marked as a tile, and this is
repeated until no match of `least` words is left.  The share of an item's words under tiles is its
coverage; as tiles may lie in any order, a passage whose sentences were reordered is caught too.

1. Seeds of all items are a table.  Their bitmap, of fixed size, goes to the documents' tasks, and only
   documents' seeds with a bit there are sent to the join (others that share a bit cost a row each).
2. Words that a document can cover lie under seeds that it holds.  So each item leaves its commonest seeds out of the
   join, as many as together can't cover enough of it: a phrase that most documents share brings nothing together, and
   no match is lost.
3. A tile of L words has L - least + 1 seeds, so covered words are at most `least` for each of the item's
   seed places that the document holds too; pairs that can't reach the coverage by this bound are left out.  Seeds
   left out before are looked up for the pairs found only.
4. The remaining pairs get the texts of both sides and are tiled, each for itself.

An item of fewer than `least` words is matched whole: its seed is its whole sequence, and a document holds
it if that sequence occurs there.  Null texts have no words, and an item without words is never reported.
Rows that repeat a doc_id or item_id are reported for themselves.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import textbytes as tb
from .shared import Workspace, column_of, once, quoted, written

#: Bits of the map of the items' seeds that each task gets; 2**26 bits are 8 MB, however large the benchmark.
FILTER_BITS = 26


def words_of(texts: pa.Array) -> list[np.ndarray]:
    """Word hashes of each text, in order."""
    raw, offsets = tb.column_bytes(texts)
    out = []
    for i, j in tb.slices(offsets):
        part = tb.LOWER[raw[offsets[i]:offsets[j]]]
        starts, ends, first = tb.word_spans(part, offsets[i:j + 1] - offsets[i])
        words = tb.span_hashes(part, starts, ends)
        out += [words[a:b] for a, b in zip(first[:-1], first[1:])]
    return out


class _Rolling:
    """Karp-Rabin hashes of windows of any length of one word sequence."""

    def __init__(self, words: np.ndarray):
        self.words = words
        up, self.down = tb.powers(len(words) + 1)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * up[:-1])])

    def windows(self, size: int, free: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of the windows of `size` words that are all free (free: sums of marked words)."""
        n = len(self.words) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(free[size:] == free[:n])
        return at, (self.sums[at + size] - self.sums[at]) * self.down[at]


def tiles(doc: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy tiling: (start in doc, start in item, words), longest first, of equal ones the first in doc, then in item."""
    a, b = _Rolling(doc), _Rolling(item)
    marked_a, marked_b = np.zeros(len(doc), bool), np.zeros(len(item), bool)
    out = []
    top = min(len(doc), len(item))
    while top >= least:
        free_a = np.concatenate([[0], np.cumsum(marked_a)])
        free_b = np.concatenate([[0], np.cumsum(marked_b)])

        def shared(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            _, hb = b.windows(size, free_b)
            at, ha = a.windows(size, free_a)
            return at[np.isin(ha, hb)], at, ha
        if not len(shared(least)[0]):
            break
        low, high = least, top
        while low < high:  # a match of a length holds matches of every shorter one
            mid = (low + high + 1) // 2
            low, high = (mid, high) if len(shared(mid)[0]) else (low, mid - 1)
        found, at, ha = shared(low)
        at_b, hb = b.windows(low, free_b)
        # Places in the item by their window's hash: only equal ones are looked at, each of them used once.
        order = np.argsort(hb, kind="stable")
        sorted_b, place_b = hb[order], at_b[order]
        begin = np.searchsorted(sorted_b, ha[np.searchsorted(at, found)]).tolist()
        skip: dict[int, int] = {}
        new = 0
        for i, s in zip(found.tolist(), begin):
            if marked_a[i:i + low].any():
                continue
            k = skip.get(s, s)  # places before this are marked already
            first_free = None
            while k < len(place_b) and sorted_b[k] == sorted_b[s]:
                j = int(place_b[k])
                if not marked_b[j:j + low].any():
                    if np.array_equal(doc[i:i + low], item[j:j + low]):
                        marked_a[i:i + low] = marked_b[j:j + low] = True
                        out.append((i, j, low))
                        new += 1
                        break
                    first_free = k if first_free is None else first_free
                k += 1
            skip[s] = k if first_free is None else first_free
        top = low if new else low - 1
    return out


def _seeds(words: np.ndarray, least: int, sizes: range | None = None) -> np.ndarray:
    """Hashes of all runs of `least` words, or of each of the sizes."""
    return np.concatenate([tb.gram_hashes(words, k) for k in (sizes or [least])] or [np.zeros(0, np.uint64)])


def covers(doc: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """The tiles of an item in a document; a short item has one, where its whole sequence first occurs."""
    if len(item) >= least:
        seeds = np.unique(tb.gram_hashes(item, least))
        hit = np.flatnonzero(np.isin(tb.gram_hashes(doc, least), seeds))
        # Only words under some seed can be in a tile; others are replaced by a mark that no item holds.
        edge = np.zeros(len(doc) + 1, np.int64)
        np.add.at(edge, hit, 1)
        np.add.at(edge, hit + least, -1)
        own = np.cumsum(edge[:-1]) > 0
        keep = np.flatnonzero(own | np.concatenate([[False], own[:-1]]))
        part = np.where(own, doc, np.uint64(0))[keep]
        return [(int(keep[i]), j, n) for i, j, n in tiles(part, item, least)]
    n = len(item)
    at = np.flatnonzero(tb.gram_hashes(doc, n) == tb.gram_hashes(item, n)[0]) if n else []
    return [(int(i), 0, n) for i in at if np.array_equal(doc[i:i + n], item)][:1]


def item_seeds(items: DataFrame, least: int) -> DataFrame:
    """(seed, item_id, item_key, words, at) of items (item_id, item_key, text): each seed's places in an item of so many words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seeds, own, size, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
            for k, words in enumerate(words_of(batch.column(2))):
                n = len(words)
                if n:
                    grams = tb.gram_hashes(words, min(n, least))
                    order = np.argsort(grams, kind="stable")
                    seed, first = np.unique(grams[order], return_index=True)
                    seeds.append(seed)
                    own.append(np.full(len(seed), k))
                    size.append(np.full(len(seed), n))
                    at += np.split(order, first[1:])
            own = pa.array(np.concatenate(own))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate(seeds).view(np.int64)), batch.column(0).take(own), batch.column(1).take(own), pa.array(np.concatenate(size)),
                pa.array(at, pa.list_(pa.int64()))], ["seed", "item_id", "item_key", "words", "at"])
    return items.mapInArrow(run, "seed long, item_id long, item_key long, words long, at array<long>")


def left_out(words: int, at: list, heat: np.ndarray, least: int, coverage: float) -> np.ndarray:
    """Which seeds of an item needn't be joined: commonest first, as long as all of them together can't cover enough."""
    out, under = np.zeros(len(at), bool), np.zeros(words, bool)
    if words < least:
        return out
    for i in np.argsort(-heat, kind="stable"):
        more = under.copy()
        for place in at[i]:
            more[place:place + least] = True
        if more.sum() < coverage * words:
            under, out[i] = more, True
    return out


def chosen_seeds(seeds: DataFrame, mine: DataFrame, least: int, coverage: float) -> DataFrame:
    """(seed, item_id, item_key, places, needed, spare, joined) of the items' seeds that some document holds.

    places: how often the seed occurs in the item; needed: how many of the item's seed places a document must hold;
    joined: whether it takes part in the join; spare: the places of those of the item that don't.
    """
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("seed")
        n, at = rows.column("words")[0].as_py(), rows.column("at").to_pylist()
        out = left_out(n, at, rows.column("heat").to_numpy(), least, coverage)
        places = np.array([len(x) for x in at], np.int64)
        # At least coverage * n words, at most `least` words for each seed place.
        needed = max(1, -(-int(np.ceil(coverage * n)) // least)) if n >= least else 1
        return pa.table({**{c: rows.column(c) for c in ("seed", "item_id", "item_key")}, "places": pa.array(places),
                         "needed": pa.array(np.full(len(at), needed)), "spare": pa.array(np.full(len(at), places[out].sum())), "joined": pa.array(~out)})
    heat = mine.groupBy("seed").agg(F.count("*").alias("heat"))
    return seeds.join(heat, "seed").groupBy("item_id", "item_key").applyInArrow(
        run, "seed long, item_id long, item_key long, places long, needed long, spare long, joined boolean")


def candidates(mine: DataFrame, seeds: DataFrame, work: Workspace) -> DataFrame:
    """(doc_id, doc_key, item_id, item_key) of the pairs that hold as many seed places as their item needs."""
    names = ["doc_id", "doc_key", "item_id", "item_key"]
    # Rows that repeat a document only raise the number of places, which is a bound from above.
    found = mine.join(seeds.where("joined"), "seed").groupBy(*names).agg(
        F.sum("places").alias("places"), F.max("needed").alias("needed"), F.max("spare").alias("spare"))
    found = work.written(found.where("places + spare >= needed"), "found")
    open_, rest = found.where("places < needed"), seeds.where("not joined").select("seed", "item_id", "item_key", F.col("places").alias("more"))
    asked = open_.alias("f").join(rest.alias("s"), _same("f", "s", "item_id", "item_key")).select("f.*", "s.seed", "s.more")
    held = asked.alias("a").join(mine.alias("m"), (F.col("a.seed") == F.col("m.seed")) & _same("a", "m", "doc_id", "doc_key")).select("a.*")
    late = held.groupBy(*names).agg(F.max("places").alias("places"), F.max("needed").alias("needed"), F.sum("more").alias("more")).where("places + more >= needed")
    return work.written(found.where("places >= needed").select(*names).unionByName(late.select(*names)), "pairs")


def _bitmap(seeds: DataFrame) -> np.ndarray:
    """The seeds' map of 2**FILTER_BITS bits."""
    bit = F.col("seed").bitwiseAND(F.lit((1 << FILTER_BITS) - 1)) + 1
    with once(seeds.sparkSession):
        maps = seeds.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(
            F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")).collect()
    bits = np.zeros(1 << (FILTER_BITS - 3), np.uint8)  # buckets and positions count from 1
    for r in maps:
        bits[(r[0] - 1) * 4096:r[0] * 4096] = np.frombuffer(r[1], np.uint8)
    return bits


def document_seeds(rows: DataFrame, bits: np.ndarray, least: int, short: list[int]) -> DataFrame:
    """(seed, doc_id, doc_key): the distinct seeds of rows (doc_id, doc_key, text) that have a bit in the items' map.

    short: the lengths of items with fewer than `least` words.
    """
    shared = rows.sparkSession.sparkContext.broadcast(bits)  # 2**FILTER_BITS bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled, mask = shared.value, np.uint64((1 << FILTER_BITS) - 1)
        for batch in batches:
            seeds, own = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for k, words in enumerate(words_of(batch.column(2))):
                found = _seeds(words, least, [*short, least])
                at = (found & mask).astype(np.int64)
                found = np.unique(found[(filled[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0])
                seeds.append(found)
                own.append(np.full(len(found), k))
            own = pa.array(np.concatenate(own))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(seeds).view(np.int64)), batch.column(0).take(own), batch.column(1).take(own)],
                                             ["seed", "doc_id", "doc_key"])
    return rows.mapInArrow(run, "seed long, doc_id long, doc_key long")


_KIND = pa.list_(pa.struct([("doc_at", pa.int64()), ("item_at", pa.int64()), ("words", pa.int64())]))
_MATCH = ("doc_id long, doc_key long, item_id long, item_words long, covered_words long, coverage double, "
          "tiles array<struct<doc_at: long, item_at: long, words: long>>")


def _tiled(least: int, coverage: float):
    """Pairs with their texts to those whose coverage reaches the bound."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = []
                for k, (doc, item) in enumerate(zip(words_of(part.column(3)), words_of(part.column(4)))):
                    t = covers(doc, item, least)
                    n, covered = len(item), sum(x[2] for x in t)
                    if t and covered >= coverage * n:
                        found.append((k, n, covered, covered / n, [{"doc_at": x[0], "item_at": x[1], "words": x[2]} for x in t]))
                cols = list(zip(*found)) or [()] * 5
                own = pa.array(cols[0], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(c).take(own) for c in range(3)] + [
                    pa.array(c, t) for c, t in zip(cols[1:], (pa.int64(), pa.int64(), pa.float64(), _KIND))],
                    [x.split()[0] for x in _MATCH.split(", ")[:6]] + ["tiles"])
    return run


def _keyed(df: DataFrame, name: str, key: str) -> DataFrame:
    """(id, key, text): key is a hash of the text; only its rows of the same id are told apart by it."""
    text = F.col(quoted(column_of(df, "text")))
    return df.select(F.col(quoted(column_of(df, name))).cast("long").alias(name), F.xxhash64(text).alias(key), text.alias("text"))


def _same(a: str, b: str, *names: str) -> Column:
    """Equal names on both sides, null being equal to null."""
    out = F.lit(True)
    for n in names:
        out = out & F.col(f"{a}.{n}").eqNullSafe(F.col(f"{b}.{n}"))
    return out


def matches(docs: DataFrame, benchmark: DataFrame, least: int = 5, coverage: float = 0.5) -> DataFrame:
    """One row for each document and item whose coverage reaches the bound.

    doc_id, doc_key (a hash of the text), item_id, item_words, covered_words, coverage, and the tiles (start in doc,
    start in item, words).
    """
    with Workspace(docs.sparkSession) as work:
        rows, items = _keyed(docs, "doc_id", "doc_key"), work.written(_keyed(benchmark, "item_id", "item_key").where("text is not null"), "items")
        seeds = work.written(item_seeds(items.dropDuplicates(["item_id", "item_key"]).select("item_id", "item_key", "text"), least), "item-seeds")
        size = F.size(F.filter(F.split(F.regexp_replace("text", "[\\x20\\x09-\\x0D]+", " "), " "), lambda w: w != ""))
        short = sorted(r[0] for r in items.select(size.alias("n")).where(f"n between 1 and {least - 1}").distinct().collect())  # numbers below `least`
        mine = work.written(document_seeds(rows.select("doc_id", "doc_key", "text"), _bitmap(seeds), least, short), "document-seeds")
        pairs = candidates(mine, work.written(chosen_seeds(seeds, mine, least, coverage), "chosen-seeds"), work)
        both = (rows.alias("d").join(pairs.alias("p"), _same("d", "p", "doc_id", "doc_key"))
                .join(items.alias("i"), _same("p", "i", "item_id", "item_key"))
                .select("p.doc_id", "p.doc_key", "p.item_id", F.col("d.text").alias("doc_text"), F.col("i.text").alias("item_text")))
        return written(both.mapInArrow(_tiled(least, coverage), _MATCH), "matches")


def clean(docs: DataFrame, benchmark: DataFrame, least: int = 5, coverage: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, in which no item reaches the bound."""
    gone = matches(docs, benchmark, least, coverage).select("doc_id", "doc_key").distinct()
    names, text = docs.columns, F.col(quoted(column_of(docs, "text")))
    rows = docs.select(F.struct(*[F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(names)]).alias("row"),
                       F.col(quoted(column_of(docs, "doc_id"))).cast("long").alias("doc_id"), F.xxhash64(text).alias("doc_key"))
    left = rows.alias("d").join(gone.alias("g"), _same("d", "g", "doc_id", "doc_key"), "left_anti")
    return left.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(names)])
