"""MinHash fingerprints, and near-duplicate pairs by bands with verified Jaccard.

A text's shingles are its distinct k-word hashes (A-Z lower-cased).  `perms` universal hash
permutations h -> (a * h + b) mod 2**64, cut to the high 32 bits, each keep their least value
over the shingles; a fingerprint holds the low 16 bits of each as hex.  Two fingerprints' likeness
is the share of equal places, which estimates the Jaccard similarity of the shingle sets.

A null text counts as empty.  Texts without shingles have the fingerprint of all ones: they are
alike (1.0) to each other and to no other text.  Repeated rows keep their own results.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import ngram_join, textbytes as tb
from .shared import Workspace, column_of, partitions, quoted, written

PERMS, SHINGLE = 128, 5
_EMPTY = np.uint32(0xFFFFFFFF)
#: Shingles handled at once, so that the table of permuted values stays in cache.
_CHUNK = 2048


def permutations(perms: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    a = rng.integers(1, 2**63, perms, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a, rng.integers(0, 2**63, perms, dtype=np.uint64)


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least permuted value of the shingles under each permutation."""
    if not len(shingles):
        return np.full(len(a), _EMPTY)
    best = np.full(len(a), 2**64 - 1, np.uint64)
    for i in range(0, len(shingles), _CHUNK):
        part = shingles[i:i + _CHUNK]
        table = np.multiply.outer(a, part)
        table += b[:, None]
        np.minimum(best, table.min(1), out=best)
    return (best >> np.uint64(32)).astype(np.uint32)


def signatures(texts: pa.Array, perms: int = PERMS, k: int = SHINGLE) -> np.ndarray:
    raw, offsets = tb.column_bytes(texts)
    a, b = permutations(perms)
    out = np.empty((len(offsets) - 1, perms), np.uint32)
    for i, g in enumerate(tb.shingles(raw, offsets, k)):
        out[i] = signature(g, a, b)
    return out


def as_hex(sig: np.ndarray) -> list[str]:
    low = (sig & 0xFFFF).astype(">u2")
    return [row.tobytes().hex() for row in low]


def likeness(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Share of equal places of each row pair; an empty text is only like an empty one."""
    same = ((x & 0xFFFF) == (y & 0xFFFF)).mean(1)
    ex, ey = (x == _EMPTY).all(1), (y == _EMPTY).all(1)
    return np.where(ex | ey, (ex & ey).astype(float), same)


def edited_text(text: str, following: str) -> str:
    """text with its last floor(n/2) code points replaced by the first as many of `following`."""
    n = len(text)
    return text[:n - n // 2] + following[:n // 2]


def with_neighbours(docs: DataFrame) -> DataFrame:
    """Rows dealt to parts by ranges of doc_id, each part followed by its successor's first row.

    Returns (doc_id, text, key, part, guest).  Sorted by part, guest, descending key and text, every
    row that is no guest is followed by the next row of the whole table in descending doc_id; the
    last row is followed by the first.  Nulls come last; ties of the id are ordered by the text.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"),
                       F.coalesce(F.col("doc_id").cast("long"), F.lit(-2**63)).alias("key"))
    n = 4 * partitions(docs.sparkSession)
    cuts = rows.agg(F.percentile_approx("key", [(i + 1) / n for i in range(n - 1)], 10000)).first()[0] or []
    bounds = np.array(sorted(set(cuts)), np.int64)

    def part_of(key: pd.Series) -> pd.Series:
        return pd.Series((len(bounds) - np.searchsorted(bounds, key.to_numpy(np.int64))).astype(np.int32))
    rows = rows.withColumn("part", F.pandas_udf(part_of, "int")("key"))
    # The first key of each part: one row for each part.
    tops = sorted(tuple(r) for r in rows.select("part", "key").groupBy("part").agg(F.max("key")).collect())
    used, first = np.array([t[0] for t in tops], np.int64), np.array([t[1] for t in tops], np.int64)
    before = np.roll(used, 1)  # the part whose rows come just before; the first part's is the last

    def also_in(part: pd.Series, key: pd.Series) -> pd.Series:
        at = np.searchsorted(used, part.to_numpy(np.int64))
        hit = first[at] == key.to_numpy(np.int64)
        return pd.Series(np.where(hit, before[at], -1).astype(np.int32))
    rows = rows.withColumn("also", F.pandas_udf(also_in, "int")("part", "key"))
    own = F.struct(F.col("part").alias("part"), F.lit(False).alias("guest"))
    seen = F.struct(F.col("also").alias("part"), F.lit(True).alias("guest"))
    out = rows.withColumn("at", F.explode(F.when(F.col("also") >= 0, F.array(own, seen)).otherwise(F.array(own))))
    return out.select("doc_id", "text", "key", F.col("at.part").alias("part"), F.col("at.guest").alias("guest"))


def compare_edits(docs: DataFrame, perms: int = PERMS, k: int = SHINGLE) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    The next document is that with the next smaller doc_id.  Only neighbouring rows meet: texts
    are shuffled once, by ranges of the id.
    """
    dealt = with_neighbours(docs).repartition(partitions(docs.sparkSession), "part").sortWithinPartitions(
        "part", "guest", F.desc("key"), F.desc("text")).drop("key")
    schema = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
              "near_edited double, near_next double")

    def results(ids: list, texts: list[str], follow: list[str], own: np.ndarray, after: np.ndarray) -> pa.RecordBatch:
        edits = [edited_text(t, f) for t, f in zip(texts, follow)]
        sig = signatures(pa.array(edits, pa.large_string()), perms, k)
        return pa.RecordBatch.from_arrays([
            pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edits], pa.string()),
            pa.array(as_hex(own), pa.string()), pa.array(as_hex(sig), pa.string()),
            pa.array(likeness(own, sig), pa.float64()), pa.array(likeness(own, after), pa.float64())],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row seen, waiting for the row after it: id, text, part, guest, signature
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                piece = batch.slice(at, 512)
                sig = signatures(piece.column(1), perms, k)
                ids, texts = piece.column(0).to_pylist(), piece.column(1).to_pylist()
                parts, guests = piece.column(2).to_pylist(), piece.column(3).to_pylist()
                if held is not None:
                    ids, texts = [held[0], *ids], [held[1], *texts]
                    parts, guests = [held[2], *parts], [held[3], *guests]
                    sig = np.vstack([held[4][None, :], sig])
                held = (ids[-1], texts[-1], parts[-1], guests[-1], sig[-1])
                # A part's own rows come first, then its guests (rows of an equal top id: the first counts).
                own = [i for i in range(len(ids) - 1) if not guests[i] and parts[i] == parts[i + 1]]
                if own:
                    nxt = [i + 1 for i in own]
                    yield results([ids[i] for i in own], [texts[i] for i in own], [texts[i] for i in nxt], sig[own], sig[nxt])

    return dealt.mapInArrow(run, schema)


def _banded(bands: int, perms: int):
    """An `incidence` whose columns are the bands of signatures: classes that share a band are candidates."""
    def find(docs: DataFrame, k: int, percent: int, work: Workspace) -> tuple[DataFrame, DataFrame]:
        width = perms // bands

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            a, b = permutations(perms)
            for batch in batches:
                for at in range(0, batch.num_rows, 512):
                    part = batch.slice(at, 512)
                    sets = [np.unique(g) for g in tb.shingles(*tb.column_bytes(part.column(1)), k)]
                    sig = np.array([signature(s, a, b) for s in sets], np.uint64).reshape(len(sets), bands, width)
                    keys = tb.mix(tb.mix(sig + tb.PLACE_CODES[:width]).sum(2) + np.arange(bands, dtype=np.uint64)).view(np.int64)
                    yield pa.RecordBatch.from_arrays([
                        part.column(0), part.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array([ngram_join.class_of(s) for s in sets], pa.int64()),
                        pa.array(list(keys), pa.list_(pa.int64()))], ["doc_id", "text_key", "n_shingles", "class", "bands"])
        text = F.col(quoted(column_of(docs, "text")))
        rows = docs.select(F.col(quoted(column_of(docs, "doc_id"))).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key"))
        rows = work.written(rows.mapInArrow(run, "doc_id long, text_key long, n_shingles long, class long, bands array<long>"), "bands")
        classes = rows.where("n_shingles > 0").select("class", F.col("n_shingles").cast("int").alias("n"), "bands").dropDuplicates(["class"])
        entries = classes.select(F.explode("bands").alias("gram"), "class", "n", F.lit(0).alias("place"))
        return rows.drop("bands"), work.written(entries, "entries")
    return find


def near_duplicates(docs: DataFrame, percent: int = 80, bands: int = 32, perms: int = PERMS, k: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles and component_id, the least id it is linked with, of every row.

    Texts of equal shingle sets are one class.  Classes that share a band of their signatures are candidates, and
    candidates are verified by the Jaccard similarity of their whole sets (`percent` or more links).  A band's rows
    meet pivots of its largest component, and whatever then still lies in several components meets all of the others
    (as in the n-gram join), so no candidate's link is lost, and a large group of near copies never makes all its pairs.
    At `percent` 80, 32 bands of 4 are expected to miss a pair of that very similarity once in 2 * 10^7 cases.

    Rows without shingles (null, empty, blank) are linked with nothing.  A null doc_id names no component.  Repeated
    rows keep a row each; ties make no difference, as only sets and least ids decide.
    """
    with Workspace(docs.sparkSession) as work:
        found = ngram_join.placed(docs, k, percent, work, _banded(bands, perms))
        return written(found.select("doc_id", "n_shingles", "component_id"), "near-duplicates")
