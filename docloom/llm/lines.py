"""Line deduplication: lines that many documents hold stay in one of them.

A line's key is the line without blanks (bytes 20, 09-0D) at its ends, with A-Z lower-cased.  Keys of at least
`chars` code points that at least `documents` documents hold lose all their lines but those of the document
with the largest doc_id.  All other lines stay.

Only digests of keys travel: (line, doc, copy, place).  They are dealt by ranges of all four and sorted, so that a
key's documents follow each other, largest id first, and a key that most documents hold lies in many partitions.
One pass over each partition keeps first occurrences.  What it can't know (whether a key that touches the
partition's edge has an earlier document, or enough of them) leaves at most the rows of a few documents for each
edge, which a join settles.  The places that go come back as one compressed bitmap for each document.

Documents are told apart by their id; rows of one id that differ are one document with several texts, and repeated
rows are the same row.  A null text is one empty line.  Rows without an id count as one document below all others.
An empty table gives no rows.  Ties can't matter: equal keys of a document share their fate.
"""
from __future__ import annotations

import hashlib
import zlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .packing import lean
from .shared import Workspace, column_of, fresh_name, quoted, written
from .textbytes import LOWER, column_bytes

CHARS, DOCUMENTS = 20, 3
BLANK = bytes([0x20, *range(0x09, 0x0E)])
_LOWER = LOWER.tobytes()
#: Rows that a task remembers, so that it sends the lines of a repeated row once.
_REMEMBERED = 1 << 16
_NO_ID = -2**63
_OCCURRENCE = "line binary, doc long, copy binary, place int"


def line_keys(text: bytes, chars: int) -> Iterator[tuple[int, bytes]]:
    """Place and key of each line whose key has `chars` code points or more."""
    for place, line in enumerate(text.translate(_LOWER).split(b"\n")):
        key = line.strip(BLANK)
        if len(key) >= chars and (key.isascii() or len(key.decode()) >= chars):
            yield place, key


def _identity(docs: DataFrame) -> tuple[Column, Column, Column]:
    """A row's document, the digest that tells texts of one document apart, and its text."""
    text = F.coalesce(F.col(quoted(column_of(docs, "text"))), F.lit(""))
    return F.coalesce(F.col(quoted(column_of(docs, "doc_id"))).cast("long"), F.lit(_NO_ID)), F.unhex(F.md5(text)), text


def occurrences(docs: DataFrame, chars: int = CHARS) -> DataFrame:
    """A row for each line with a long enough key: its digest, its document and its place."""
    def emit(found: list[tuple]) -> pa.RecordBatch:
        line, doc, copy, place = zip(*found)
        return pa.RecordBatch.from_arrays([pa.array(line, pa.binary()), pa.array(doc, pa.int64()), pa.array(copy, pa.binary()), pa.array(place, pa.int32())],
                                          ["line", "doc", "copy", "place"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: OrderedDict[tuple, None] = OrderedDict()
        found = []
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                docs_, copies = part.column(0).to_pylist(), part.column(1).to_pylist()
                for doc, copy, text in zip(docs_, copies, part.column(2).cast(pa.binary()).to_pylist()):
                    if (doc, copy) in seen:
                        seen.move_to_end((doc, copy))
                        continue
                    seen[doc, copy] = None
                    if len(seen) > _REMEMBERED:
                        seen.popitem(last=False)
                    for place, key in line_keys(text, chars):
                        found.append((hashlib.blake2b(key, digest_size=16).digest(), doc, copy, place))
                        if len(found) == 1 << 16:
                            yield emit(found)
                            found = []
        if found:
            yield emit(found)
    doc, copy, text = _identity(docs)
    return docs.select(doc.alias("doc"), copy.alias("copy"), text.alias("text")).mapInArrow(run, _OCCURRENCE)


def _streamed(documents: int):
    """One pass over sorted occurrences: those that go, and undecided ones of the keys at the two edges.

    Undecided rows carry in `docs` how many documents of the key this partition has, as far as it matters; others null.
    """
    def tagged(rows: pa.Table, docs: int | None) -> Iterator[pa.RecordBatch]:
        yield from rows.append_column("docs", pa.array(np.full(rows.num_rows, docs or 0, np.int32), mask=np.full(rows.num_rows, docs is None))).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many, head = None, 0, True  # rows of the last key that may stay; its documents so far; is it the first key?
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
            rows = rows.combine_chunks()
            line = column_bytes(rows.column(0))[0].reshape(-1, 16).view(np.uint64)
            doc = rows.column(1).to_numpy()
            fresh = np.concatenate([[True], (line[1:] != line[:-1]).any(1)])
            first = np.flatnonzero(fresh)
            key = np.cumsum(fresh) - 1
            nth = np.cumsum(fresh | np.concatenate([[True], doc[1:] != doc[:-1]]))
            nth -= nth[first][key] - 1
            size = np.maximum.reduceat(nth, first)
            size[0] = max(size[0], many)
            goes = (nth > 1) & (size[key] >= documents)
            yield from tagged(rows.filter(pa.array(goes)), None)
            last = key == key[-1]
            if head and key[-1]:
                yield from tagged(rows.filter(pa.array((key == 0) & ~goes)), int(min(size[0], documents)))
                head = False
            held, many = rows.filter(pa.array(last & ~goes)), int(min(size[-1], documents))
        if held is not None:
            yield from tagged(held, many)
    return run


def dropped_lines(docs: DataFrame, work: Workspace, chars: int = CHARS, documents: int = DOCUMENTS) -> DataFrame:
    """(doc, copy, place) of the lines that go."""
    found = work.written(occurrences(docs, chars), "occurrences")
    order = ["line", F.desc("doc"), "copy", "place"]
    runs = found.repartitionByRange(*order).sortWithinPartitions(*order)
    runs = work.written(runs.mapInArrow(lean(_streamed(documents)), _OCCURRENCE + ", docs int"), "runs")
    work.drop("occurrences")
    edges = runs.where("docs is not null")
    # Of a key at an edge: its largest document is among the undecided rows of any partition that holds it first.
    known = edges.groupBy("line").agg(F.max("doc").alias("keeper"), F.max("docs").alias("docs"), F.count_distinct("doc").alias("parts"))
    known = work.written(known.where((F.col("docs") >= documents) | (F.col("parts") >= documents)).select("line", "keeper"), "edges")
    late = edges.join(known, "line").where(F.col("doc") < F.col("keeper"))
    return runs.where("docs is null").select("doc", "copy", "place").unionByName(late.select("doc", "copy", "place"))


@F.pandas_udf(T.BinaryType())
def _packed(places: pd.Series) -> pd.Series:
    def one(a) -> bytes:
        keep = np.ones(-(-(int(a.max()) + 1) // 8) * 8, bool)
        keep[a] = False
        return zlib.compress(np.packbits(keep).tobytes())
    return places.map(one)


def kept_lines(keep: bytes | None, n: int) -> np.ndarray:
    """Which of a document's n lines stay, by its bitmap; without one, and past its end, all do."""
    out = np.ones(n, bool)
    if keep is not None:
        bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8))[:n]
        out[:len(bits)] = bits.astype(bool)
    return out


def bitmaps(docs: DataFrame, chars: int = CHARS, documents: int = DOCUMENTS) -> DataFrame:
    """doc, copy, n_dropped and `keep` of each document that loses lines.

    `keep` is a zlib-compressed bitmap with a bit for each line, first line in the highest bit, set if the line stays.
    """
    with Workspace(docs.sparkSession) as work:
        gone = dropped_lines(docs, work, chars, documents).groupBy("doc", "copy").agg(F.collect_set("place").alias("places"))
        return written(gone.select("doc", "copy", F.size("places").cast("long").alias("n_dropped"), _packed("places").alias("keep")), "bitmaps")


def with_bitmaps(docs: DataFrame, chars: int = CHARS, documents: int = DOCUMENTS, texts: bool = True) -> DataFrame:
    """The columns of docs, with n_lines (before dropping), n_dropped and keep (null if all lines stay).

    Columns of docs with these names give way.  Without `texts` the text isn't carried through the join.
    """
    doc, copy, text = _identity(docs)
    own, twin = fresh_name(docs, "_doc"), fresh_name(docs, "_copy")
    taken = {"n_lines", "n_dropped", "keep"} | (set() if texts else {"text"})
    lines = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    rows = docs.select(*[F.col(quoted(c)) for c in docs.columns if c.lower() not in taken], lines.cast("long").alias("n_lines"), doc.alias(own), copy.alias(twin))
    found = bitmaps(docs, chars, documents).withColumnsRenamed({"doc": own, "copy": twin})
    joined = rows.join(found, [own, twin], "left").drop(own, twin)
    return joined.withColumn("n_dropped", F.coalesce("n_dropped", F.lit(0)).cast("long"))


@F.pandas_udf(T.StringType())
def cut(text: pd.Series, keep: pd.Series) -> pd.Series:
    """The lines of a text that its bitmap keeps, joined as they were."""
    def one(t: str, k: bytes | None) -> str:
        if k is None:
            return t
        lines = t.split("\n")
        return "\n".join(lines[i] for i in np.flatnonzero(kept_lines(k, len(lines))))
    return pd.Series([one(t, k) for t, k in zip(text, keep)], dtype=object)


def cleaned(docs: DataFrame, chars: int = CHARS, documents: int = DOCUMENTS) -> DataFrame:
    """docs with its texts cut (a null text becomes empty), and n_lines, n_dropped and keep."""
    name = column_of(docs, "text")
    return with_bitmaps(docs, chars, documents).withColumn(name, cut(F.coalesce(F.col(quoted(name)), F.lit("")), F.col("keep")))
