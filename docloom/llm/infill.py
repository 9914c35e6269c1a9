"""Fill-in-the-middle examples, cut at the ends of units by a parallel automaton scan.

A deterministic automaton over bytes says where units (lines, by default) start.  Texts are cut into lanes; every lane
is run from every state at once and yields a function: for each state it may be entered in, the state it leaves in and
how many units start.  Functions compose associatively, so prefixes of them (by doubling) give each lane's true entry
state and count.  The lane that holds the wanted unit's start is then found by its count, and run once more to the byte.
A second automaton counts the markers that a text must not hold.

Texts of more than `whole` bytes are scanned by pieces in different tasks: each piece is a function as well, a document's
functions (a few numbers for each piece) meet and are composed, and the task that holds the text runs the two chosen
pieces again.  Results don't depend on lane, piece or `whole`.

A null text is empty.  An empty text, or one that holds a marker, is left plain.  A null doc_id counts as the empty
string in the draw.  Repeated rows have equal results; an empty table gives no rows; columns other than doc_id and text
are not read.  Ties: equal draws give an empty middle.
"""
from __future__ import annotations

import re
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import textbytes as tb
from .packing import lean
from .shared import column_of, partitions, quoted

MARKERS = ("<P>", "<S>", "<M>")
#: Bytes of a lane, of a piece that goes to a task of its own, and of the longest text that is scanned where it is read.
LANE, PIECE, WHOLE = 512, 1 << 20, 1 << 20
#: Bytes of text in one numpy step.
_STEP = 1 << 20
_OUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


@dataclass(frozen=True)
class Automaton:
    """States from 0, where texts begin.  table[state, byte] = 2 * next state + (does that byte count?)."""
    table: np.ndarray

    @property
    def states(self) -> int:
        return len(self.table)

    @staticmethod
    def lines() -> "Automaton":
        """Counts the first byte of each line; a line ends after its newline."""
        table = np.full((2, 256), 2, np.uint16)
        table[:, ord("\n")] = 0
        table[0] += 1
        return Automaton(table)

    @staticmethod
    def of_strings(strings: tuple[str, ...]) -> "Automaton":
        """Counts the bytes at which one of the strings ends (keyword tree with failure links)."""
        words = [s.encode() for s in strings]
        prefixes = sorted({w[:i] for w in words for i in range(len(w) + 1)}, key=lambda p: (len(p), p))
        number = {p: i for i, p in enumerate(prefixes)}
        table = np.zeros((len(prefixes), 256), np.uint16)
        for p, i in number.items():
            for byte in range(256):
                seen = p + bytes([byte])
                suffix = next(seen[k:] for k in range(len(seen) + 1) if seen[k:] in number)
                table[i, byte] = 2 * number[suffix] + any(seen.endswith(w) for w in words)
        return Automaton(table)


def lanes_of(offsets: np.ndarray, lane: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and length of each lane, and its number within its text; an empty text has none."""
    size = np.diff(offsets)
    many = -(-size // lane)
    text = np.repeat(np.arange(len(size)), many)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
    start = offsets[text] + nth * lane
    return start, np.minimum(lane, offsets[text + 1] - start), nth


def run_lanes(auto: Automaton, raw: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The function of each lane: (state it leaves in, count) for each state it is entered in."""
    order = np.argsort(-length, kind="stable")
    begin, left = start[order], -length[order]
    state = np.tile(np.arange(auto.states, dtype=np.uint16)[:, None], (1, len(start)))
    count = np.zeros((auto.states, len(start)), np.uint16 if len(length) and length.max() < 1 << 16 else np.int64)
    flat = auto.table.reshape(-1)
    for i in range(int(length.max()) if len(length) else 0):
        m = int(np.searchsorted(left, -i, side="left"))  # lanes longer than i come first
        step = flat[(state[:, :m] << np.uint16(8)) | raw[begin[:m] + i]]
        count[:, :m] += step & np.uint16(1)
        state[:, :m] = step >> np.uint16(1)
    ends, counts = np.empty((len(start), auto.states), np.int64), np.empty((len(start), auto.states), np.int64)
    ends[order], counts[order] = state.T, count.T
    return ends, counts


def compose(ends: np.ndarray, counts: np.ndarray, nth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The function of each lane's text up to and with that lane; nth numbers the lanes of each text in order."""
    ends, counts = ends.copy(), counts.copy()
    d = 1
    while len(nth) and d <= int(nth.max()):
        own = np.flatnonzero(nth >= d)
        first = ends[own - d]
        e, c = np.take_along_axis(ends[own], first, 1), counts[own - d] + np.take_along_axis(counts[own], first, 1)
        ends[own], counts[own] = e, c
        d *= 2
    return ends, counts


def entries(ends: np.ndarray, counts: np.ndarray, nth: np.ndarray, state: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """State and count at which each lane is entered, when its text is entered in `state`; of composed functions."""
    first = nth == 0
    before = np.maximum(np.arange(len(nth)) - 1, 0)
    return np.where(first, state, ends[before, state]), np.where(first, 0, counts[before, state])


def _starts(raw: np.ndarray, auto: Automaton, start: np.ndarray, length: np.ndarray, enter: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """For chosen lanes, entered in known states, the byte that counts as their number `rest`; -1 if there is none."""
    found = np.full(len(start), -1, np.int64)
    state, rest = enter.astype(np.uint16), rest.copy()
    flat = auto.table.reshape(-1)
    for i in range(int(length.max()) if len(length) else 0):
        on = np.flatnonzero((length > i) & (found < 0))
        step = flat[(state[on] << np.uint16(8)) | raw[start[on] + i]]
        hit = (step & 1) == 1
        found[on[hit & (rest[on] == 0)]] = start[on[hit & (rest[on] == 0)]] + i
        rest[on] -= hit
        state[on] = step >> np.uint16(1)
    return found


def place_of(auto: Automaton, data: np.ndarray, state: int, unit: int, lane: int = LANE) -> int:
    """The byte that counts as number `unit` (from 0) of data, entered in `state`."""
    start, length, nth = lanes_of(np.array([0, len(data)]), lane)
    enter, before = entries(*compose(*run_lanes(auto, data, start, length), nth), nth, state)
    at = np.searchsorted(before, [unit], side="right") - 1
    return int(_starts(data, auto, start[at], length[at], enter[at], unit - before[at])[0])


def cuts(auto: Automaton, marks: Automaton, raw: np.ndarray, offsets: np.ndarray, h1: np.ndarray, h2: np.ndarray, lane: int = LANE
         ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each text: its units, its markers, and the bytes (from its start) where prefix and middle end."""
    texts = len(offsets) - 1
    start, length, nth = lanes_of(offsets, lane)
    text = np.searchsorted(offsets, start, side="right") - 1
    ends, counts = compose(*run_lanes(auto, raw, start, length), nth)
    _, marked = compose(*run_lanes(marks, raw, start, length), nth)
    last = np.flatnonzero(np.append(text[1:] != text[:-1], True)) if len(text) else np.zeros(0, np.int64)
    n, hits = np.zeros(texts, np.int64), np.zeros(texts, np.int64)
    n[text[last]], hits[text[last]] = counts[last, 0], marked[last, 0]
    enter, before = entries(ends, counts, nth)
    # Counts of all texts in a row grow, so one search finds the lane of a unit.
    base = np.cumsum(n) - n
    upto = before + base[text]
    first = np.searchsorted(text, np.arange(texts))
    out = []
    for k in (np.minimum(h1 % (n + 1), h2 % (n + 1)), np.maximum(h1 % (n + 1), h2 % (n + 1))):
        at = np.diff(offsets).astype(np.int64)
        some = np.flatnonzero(k < n)
        chosen = np.searchsorted(upto, base[some] + k[some], side="right") - 1
        chosen = np.maximum(chosen, first[some])
        found = _starts(raw, auto, start[chosen], length[chosen], enter[chosen], base[some] + k[some] - upto[chosen])
        at[some] = found - offsets[some]
        out.append(at)
    return n, hits, *out


def check_markers(markers: tuple[str, str, str]) -> None:
    """Markers must be found again in an output whose parts hold none: none may begin within another or within its own rest."""
    if len(markers) != 3 or not all(markers) or any(a != b and b.startswith(a) for a in markers for b in markers) or len(set(markers)) < 3:
        raise ValueError("three markers, none of which begins another")
    if any(m[0] in other[1:] for m in markers for other in markers):
        raise ValueError("a marker's first character may occur nowhere else in the markers")


def _chars(data: bytes | memoryview) -> int:
    return int(np.count_nonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80))


def _result(doc_id, data: memoryview, n: int, hits: int, a: int, b: int, plain: bool, spm: bool, markers: tuple[bytes, bytes, bytes]) -> tuple:
    """A row of _OUT: the text rearranged."""
    if plain or hits or not len(data):
        return doc_id, n, "plain", None, None, bytes(data)
    p, s, m = markers
    prefix, middle, suffix = data[:a], data[a:b], data[b:]
    output = b"".join([s, suffix, p, prefix, m, middle] if spm else [p, prefix, s, suffix, m, middle])
    return doc_id, n, "spm" if spm else "psm", _chars(prefix), _chars(middle), output


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    ids, n, form, prefix, middle, output = zip(*rows)
    return pa.RecordBatch.from_arrays([
        pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()),
        pa.array(output, pa.binary()).cast(pa.string())], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])


def drawn(docs: DataFrame, seed: int, plain_percent: int, spm_percent: int) -> DataFrame:
    """(doc_id, text, copy, h1, h2, plain, spm): the draws of each row, from the digest of seed and id."""
    doc = F.col(quoted(column_of(docs, "doc_id"))).cast("long")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc.cast("string"), F.lit(""))), 256)
    rows = docs.select(doc.alias("doc_id"), F.coalesce(F.col(quoted(column_of(docs, "text"))), F.lit("")).alias("text"), digest.alias("digest"))
    h = [F.conv(F.substring("digest", 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]
    return rows.select("doc_id", "text", h[0].alias("h1"), h[1].alias("h2"), (h[2] % 100 < plain_percent).alias("plain"), (h[3] % 100 < spm_percent).alias("spm"))


def _whole(auto: Automaton, marks: Automaton, markers: tuple[bytes, bytes, bytes], lane: int):
    """Scans and rearranges texts in the task that reads them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = tb.column_bytes(batch.column(1))
            ids = batch.column(0).to_pylist()
            h1, h2 = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            plain, spm = batch.column(4).to_pylist(), batch.column(5).to_pylist()
            for i, j in tb.slices(offsets, _STEP):
                part, own = raw[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
                n, hits, a, b = (x.tolist() for x in cuts(auto, marks, part, own, h1[i:j], h2[i:j], lane))
                data, at = memoryview(part), own.tolist()
                yield _batch([_result(ids[i + k], data[at[k]:at[k + 1]], n[k], hits[k], a[k], b[k], plain[i + k], spm[i + k], markers) for k in range(j - i)])
    return run


_FUNCTION = "copy binary, piece int, ends array<long>, counts array<long>, marked_ends array<long>, marked array<long>"
_RESOLVED = "copy binary, n long, hits long, enter array<int>, before array<long>"


def _pieces(size: int):
    """The pieces of texts, each of a task's repeated texts once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: OrderedDict[bytes, None] = OrderedDict()
        for batch in batches:
            raw, offsets = tb.column_bytes(batch.column(1))
            for i, copy in enumerate(batch.column(0).to_pylist()):
                if copy in seen:
                    continue
                seen[copy] = None
                if len(seen) > 1 << 16:
                    seen.popitem(last=False)
                for k, at in enumerate(range(int(offsets[i]), int(offsets[i + 1]), size)):
                    data = raw[at:min(at + size, int(offsets[i + 1]))].tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([copy], pa.binary()), pa.array([k], pa.int32()), pa.array([data], pa.binary())], ["copy", "piece", "data"])
    return run


def _functions(auto: Automaton, marks: Automaton, lane: int):
    """The functions of each piece under both automata."""
    def of(a: Automaton, data: np.ndarray) -> tuple[list, list]:
        start, length, nth = lanes_of(np.array([0, len(data)]), lane)
        ends, counts = compose(*run_lanes(a, data, start, length), nth)
        return ends[-1].tolist(), counts[-1].tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = tb.column_bytes(batch.column(2))
            for i in range(batch.num_rows):
                data = raw[offsets[i]:offsets[i + 1]]
                columns = [pa.array([x], pa.list_(pa.int64())) for a in (auto, marks) for x in of(a, data)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), *columns], _names(_FUNCTION))
    return run


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _resolved(rows: pd.DataFrame) -> pd.DataFrame:
    """Composes the functions of one text's pieces: its units, its markers, and how each piece is entered."""
    rows = rows.sort_values("piece")
    nth = np.arange(len(rows))
    ends, counts = compose(np.stack(list(rows.ends)), np.stack(list(rows.counts)), nth)
    _, marked = compose(np.stack(list(rows.marked_ends)), np.stack(list(rows.marked)), nth)
    enter, before = entries(ends, counts, nth)
    return pd.DataFrame([[rows["copy"].iloc[0], int(counts[-1, 0]), int(marked[-1, 0]), enter, before]], columns=_names(_RESOLVED))


def _long(auto: Automaton, markers: tuple[bytes, bytes, bytes], piece: int, lane: int):
    """Rearranges texts whose pieces' entries are known: only the two chosen pieces are run again."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = tb.column_bytes(batch.column(1))
            for i in range(batch.num_rows):
                doc, h1, h2, plain, spm, n, hits, enter, before = (batch.column(k)[i].as_py() for k in (0, 2, 3, 4, 5, 6, 7, 8, 9))
                if n is None:
                    raise ValueError("a text changed between two readings of the table")
                data, at = raw[offsets[i]:offsets[i + 1]], []
                for x in sorted((h1 % (n + 1), h2 % (n + 1))):
                    if x == n:
                        at.append(len(data))
                        continue
                    k = int(np.searchsorted(before, x, side="right")) - 1
                    at.append(k * piece + place_of(auto, data[k * piece:(k + 1) * piece], enter[k], x - before[k], lane))
                yield _batch([_result(doc, memoryview(data), n, hits, *at, plain, spm, markers)])
    return run


def transform(docs: DataFrame, auto: Automaton | None = None, markers: tuple[str, str, str] = MARKERS, seed: int = 7, plain_percent: int = 0,
              spm_percent: int = 50, lane: int = LANE, piece: int = PIECE, whole: int = WHOLE) -> DataFrame:
    """doc_id, n (units of the whole text), form, prefix_chars, middle_chars and output of every row.

    The draw is made of the digest of seed and doc_id.  psm is prefix, suffix, middle, each after its marker; spm is
    suffix, prefix, middle; plain is the text as it is, for `plain_percent` of the documents and those that can't be
    told apart again.  Units are those of the automaton, whose starts must be at characters; lines by default.
    """
    check_markers(markers)
    auto = auto or Automaton.lines()
    marks, coded = Automaton.of_strings(markers), tuple(m.encode() for m in markers)
    rows = drawn(docs, seed, plain_percent, spm_percent)
    long = F.octet_length("text") > whole
    short = rows.where(~long).mapInArrow(lean(_whole(auto, marks, coded, lane)), _OUT)
    rows = rows.where(long).withColumn("copy", F.unhex(F.sha2("text", 256)))
    pieces = rows.select("copy", "text").mapInArrow(_pieces(piece), "copy binary, piece int, data binary")
    functions = pieces.repartition(partitions(docs.sparkSession), "copy", "piece").mapInArrow(_functions(auto, marks, lane), _FUNCTION)
    entered = functions.dropDuplicates(["copy", "piece"]).groupBy("copy").applyInPandas(_resolved, _RESOLVED)
    known = rows.join(entered, "copy", "left").select("doc_id", "text", "h1", "h2", "plain", "spm", "n", "hits", "enter", "before")
    return short.unionByName(known.mapInArrow(_long(auto, coded, piece, lane), _OUT))


def restored(form: Column, output: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text an output was made of."""
    parts = F.split(output, "|".join(re.escape(m) for m in markers))
    part = lambda i: F.get(parts, F.lit(i))
    return (F.when(form == "psm", F.concat(part(1), part(3), part(2)))
             .when(form == "spm", F.concat(part(2), part(3), part(1))).otherwise(output))
