"""The largest dot product of each vector with those of another table, or with the others of its own group; exact.

Vectors are dealt to cells by the nearest of fixed random directions, and cells to blocks of bounded size, each with its
centre, the largest distance from it, and the largest length.  For two blocks these bound every
product of their vectors.  Each left block first meets the one with the nearest centre; then only those blocks whose
bound is above what its worst row has already, and of its rows only those whose own bound with the block is above what
they have.  Blocks meet in joins; nothing but counts comes to the driver.

How much is left out depends on the vectors: in tight clusters nearly all, in isotropic noise nothing.  Then every block
of a part meets every other one, in all rows^2 products, and rows / block copies of the vectors are shuffled.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..sources.scratch import kept

#: Directions for each block's worth of rows, and at most; room for rounding in bounds.
_FINE, _DIRECTIONS, _ROOM = 4, 4096, 1e-6
_BLOCK = ("part string, block string, ids array<long>, numbers array<long>, data binary, centre array<double>, radius double, reach double")


def _dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _pack(rows: pa.Table) -> pa.Table:
    """One row for a block: its vectors as bytes of numbers as they are, and what bounds their products."""
    v = rows.column("v").combine_chunks()
    own = v.flatten().to_numpy().reshape(len(v), -1)
    x = own.astype(np.float64)
    centre = x.mean(0)
    away = np.sqrt(((x - centre) ** 2).sum(1).max())
    reach = np.sqrt((x * x).sum(1).max())
    first = rows.slice(0, 1)
    one = lambda a, t: pa.array([a], t)
    return pa.table({"part": first.column("part"), "block": first.column("block"), "ids": one(rows.column("id").to_pylist(), pa.list_(pa.int64())),
                     "numbers": one(rows.column("number").to_pylist(), pa.list_(pa.int64())), "data": one(own.tobytes(), pa.binary()),
                     "centre": one(centre.tolist(), pa.list_(pa.float64())), "radius": one(float(away), pa.float64()), "reach": one(float(reach), pa.float64())})


def numbered(rows: DataFrame, key: str, vector: str, part: Column) -> DataFrame:
    """(number, part, id, v): rows with a vector and a part, written, with a number of their own."""
    v = F.col(vector) if dict(rows.dtypes)[vector] == "array<float>" else F.col(vector).cast("array<double>")
    known = rows.select(part.cast("string").alias("part"), F.col(key).cast("long").alias("id"), v.alias("v"))
    return kept(known.where("part is not null and v is not null").select(F.monotonically_increasing_id().alias("number"), "*"))


def blocks(rows: DataFrame, size: int, block: int) -> DataFrame:
    """Blocks of about `block` numbered rows of one part and cell, however many rows a cell, an id or a vector has."""
    most = rows.groupBy("part").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    directions = np.random.default_rng(size).standard_normal((min(_DIRECTIONS, 1 + _FINE * (most // block)), size))
    directions /= np.sqrt((directions ** 2).sum(1, keepdims=True))

    @F.pandas_udf("int")
    def cell(vectors: pd.Series) -> pd.Series:
        x = np.array(vectors.tolist(), np.float64).reshape(-1, size)
        return pd.Series(np.concatenate([(x[i:i + 512] @ directions.T).argmax(1) for i in range(0, len(x), 512)] or [[]]).astype(np.int32))
    celled = kept(rows.withColumn("cell", cell("v")))
    counts = celled.groupBy("part", "cell").agg(F.count("*").alias("n"))
    # Numbers, not values, split a large cell, so equal vectors are split too.
    place = F.pmod(F.xxhash64("number"), F.ceil(F.col("n") / block))
    dealt = celled.join(counts, ["part", "cell"]).withColumn("block", F.concat_ws("/", "part", "cell", place.cast("string")))
    return kept(dealt.select("part", "block", "id", "number", "v").groupBy("block").applyInArrow(_pack, _BLOCK))


def _bounded(left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, b, near, bound): pairs of a left and a right block of one part, their centres' product, and what no product of theirs exceeds."""
    side = lambda df, n: df.select("part", F.col("block").alias(n), *[F.col(c).alias(f"{n}_{c}") for c in ("centre", "radius", "reach")])
    pairs = side(left, "a").join(side(right, "b"), "part")
    far = F.sqrt(_dot("b_centre", "b_centre"))
    bound = _dot("a_centre", "b_centre") + F.col("a_radius") * far + F.col("a_reach") * F.col("b_radius")
    return pairs.select("a", "b", _dot("a_centre", "b_centre").alias("near"), (bound + _ROOM * (1 + F.col("a_reach") * F.col("b_reach"))).alias("bound"))


def _kind(rows: DataFrame):
    return np.float32 if dict(rows.dtypes)["v"] == "array<float>" else np.float64


def _products(size: int, kinds: tuple, exclude: bool):
    """For each pair of blocks the left rows that do better than `best`, and their products; the first pair of a block gives all its rows."""
    def better(x: np.ndarray, ids: np.ndarray, y: np.ndarray, others: np.ndarray) -> np.ndarray:
        out = np.full(len(x), np.nan)
        order = np.argsort(others, kind="stable")
        for i in range(0, len(x), 512):
            p = x[i:i + 512] @ y.T
            if exclude:
                low, high = (np.searchsorted(others[order], ids[i:i + 512], side) for side in ("left", "right"))
                for k in np.flatnonzero(high > low):
                    p[k, order[low[k]:high[k]]] = np.nan
            out[i:i + 512] = np.fmax.reduce(p, axis=1)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in (batch.slice(i, 1) for i in range(batch.num_rows)):
                r = {n: c[0] for n, c in zip(batch.schema.names, r.columns)}
                x, y = (np.frombuffer(r[c].as_buffer(), kind).reshape(-1, size).astype(np.float64) for c, kind in zip(("a_data", "b_data"), kinds))
                ids, numbers, others = (np.asarray(r[c].values) for c in ("a_ids", "a_numbers", "b_ids"))
                at = np.arange(len(x))
                if r["best"].is_valid:
                    best = np.asarray(r["best"].values.to_numpy(zero_copy_only=False), np.float64)
                    centre, radius = np.asarray(r["centre"].values), r["radius"].as_py()
                    most = x @ centre + np.sqrt((x * x).sum(1)) * radius
                    at = np.flatnonzero(~(most + _ROOM * (1 + np.abs(most)) <= best))
                got = better(x[at], ids[at], y, others)
                if r["best"].is_valid:
                    keep = np.flatnonzero(~np.isnan(got) & ~(got <= best[at]))
                    at, got = at[keep], got[keep]
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array([r["a"].as_py()] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(numbers[at]), pa.array(ids[at]),
                                                      pa.array(got, mask=np.isnan(got))], ["a", "at", "number", "id", "best"])
    return run


def best_products(left: DataFrame, right: DataFrame, size: int, exclude: bool = False, block: int = 4096, seen: list | None = None) -> DataFrame:
    """(number, id, best) of left rows that have a partner: the largest product with right rows of their part.

    left, right: numbered rows (or one and the same).  exclude: rows of the same id are no partners.  seen, if given,
    gets the pairs of blocks that there are, and of those that met.
    """
    a = blocks(left, size, block)
    b = a if right is left else blocks(right, size, block)
    pairs = kept(_bounded(a, b))
    first = kept(pairs.groupBy("a").agg(F.max_by("b", F.struct("near", "b")).alias("b")))
    own = a.select(F.col("block").alias("a"), F.col("ids").alias("a_ids"), F.col("numbers").alias("a_numbers"), F.col("data").alias("a_data"))
    other = b.select(F.col("block").alias("b"), F.col("ids").alias("b_ids"), F.col("data").alias("b_data"), "centre", "radius")
    schema = "a string, at int, number long, id long, best double"
    met = first.join(own, "a").join(other, "b").withColumn("best", F.lit(None).cast("array<double>"))
    found = kept(met.mapInArrow(_products(size, (_kind(left), _kind(right)), exclude), schema))
    # Each block's rows in order, and what its worst one has; nothing yet for rows without a partner in that block.
    none = F.lit(float("-inf"))
    known = kept(found.groupBy("a").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "best"))), lambda x: F.coalesce(x["best"], none)).alias("best"),
                                         F.min(F.coalesce("best", none)).alias("least")))
    rest = pairs.join(first.withColumnRenamed("b", "had"), "a").join(known, "a").where((F.col("b") != F.col("had")) & (F.col("bound") > F.col("least")))
    if seen is not None:
        seen += [pairs.count(), first.count() + rest.count()]
    later = rest.select("a", "b", "best").join(own, "a").join(other, "b").mapInArrow(_products(size, (_kind(left), _kind(right)), exclude), schema)
    every = found.unionByName(later).groupBy("number").agg(F.first("id").alias("id"), F.max("best").alias("best"))
    return every.where("best is not null")


def best_match(left: DataFrame, right: DataFrame, left_id: str, size: int, vector: str = "embedding", block: int = 4096) -> DataFrame:
    """(left_id, similarity) of each left row: its largest product with any right row; 0 if there is none, or its vector is null."""
    own = kept(left.select(F.monotonically_increasing_id().alias("row"), F.col(left_id).alias(left_id), F.col(vector).alias("v")))
    rows = numbered(own, "row", "v", F.lit("all"))
    found = best_products(rows, numbered(right.withColumn("_id", F.lit(0)), "_id", vector, F.lit("all")), size, block=block)
    return own.join(found.select(F.col("id").alias("row"), "best"), "row", "left").select(left_id, F.coalesce("best", F.lit(0.0)).alias("similarity"))


def best_other(rows: DataFrame, key: str, group: str, size: int, vector: str = "embedding", block: int = 4096) -> DataFrame:
    """(group, key, similarity): each row's largest product with a row of its group and another key; rows without one are left out."""
    kind = dict(rows.dtypes)[group]
    known = numbered(rows, key, vector, F.col(group))
    found = best_products(known, known, size, exclude=True, block=block)
    named = known.select("number", F.col("part").cast(kind).alias(group))
    return found.join(named, "number").select(group, F.col("id").alias(key), F.col("best").alias("similarity"))
