"""Sharding by a Hilbert curve over several metadata dimensions.

Each dimension is quantised into 2**bits levels of about equal row counts, the levels'
cell gets its index on a Hilbert curve, rows are sorted by that index and the sorted run
is cut into shards.  Neighbours on the curve are near in every dimension, so the min/max
statistics of a shard's files prune on any of them.  Texts are compared whole, however much of them is alike.

Equal texts are one group: all of them have the dimensions of the group's row with the least id,
so they lie side by side on the curve, in one shard or, where a cut falls between them, in
consecutive ones.

Two laws: `rows` (counts of any two shards differ by one at most) and `bytes` (a shard ends
where the running size passes its share).  Null dimensions count as the lowest level, null
texts as empty; an empty table gives no rows.  Ties on the curve are ordered by text digest
and id; repeated rows and rows without an id are all kept, each with a slot of its own.
"""
from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from .shared import Workspace, column_of, partitions, quoted, written


def hilbert_index(levels: np.ndarray, bits: int) -> np.ndarray:
    """Index on the Hilbert curve of each row of `levels` (n x dims, each below 2**bits).

    Gray-code transform of the transposed coordinates, after Skilling (2004).
    """
    x = levels.astype(np.int64).copy()
    dims = x.shape[1]
    top = 1 << (bits - 1)
    q = top
    while q > 1:
        low = q - 1
        for d in range(dims):
            hit = (x[:, d] & q) != 0
            swap = np.where(hit, 0, (x[:, 0] ^ x[:, d]) & low)
            x[:, 0] = np.where(hit, x[:, 0] ^ low, x[:, 0] ^ swap)
            x[:, d] ^= swap
        q >>= 1
    for d in range(1, dims):
        x[:, d] ^= x[:, d - 1]
    turn = np.zeros(len(x), np.int64)
    q = top
    while q > 1:
        turn ^= np.where((x[:, dims - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= turn[:, None]
    out = np.zeros(len(x), np.int64)
    for b in range(bits - 1, -1, -1):
        for d in range(dims):
            out = (out << 1) | ((x[:, d] >> b) & 1)
    return out


def _text_bounds(df: DataFrame, column: str, levels: int) -> list[str]:
    """The last text of each of `levels` even parts of all rows but the last part; nulls aside.

    Different texts are counted, sorted by ranges and written; with the counts of the ranges each text's place among all
    rows is known, and only the texts at the ends of parts go to the driver.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n"))
    with Workspace(df.sparkSession) as work:
        runs = counts.repartitionByRange(partitions(df.sparkSession), "v").sortWithinPartitions("v")
        runs = work.written(runs.withColumn("_at", F.monotonically_increasing_id()).withColumn("_run", F.shiftright("_at", 33)), "counts")
        sums = sorted(tuple(r) for r in runs.groupBy("_run").agg(F.sum("n")).collect())  # one row for each sorted run
        total = sum(n for _, n in sums)
        begun, done = [], 0
        for run, n in sums:
            begun.append((run, done))
            done += n
        if not total:
            return []
        starts = df.sparkSession.createDataFrame(begun, "_run long, _before long")
        upto = F.col("_before") + F.sum("n").over(Window.partitionBy("_run").orderBy("_at"))
        placed = runs.join(F.broadcast(starts), "_run").select("v", upto.alias("upto"), (upto - F.col("n")).alias("before"))
        # The row at which part i ends is one of the text's own rows.
        ends = F.array(*[F.lit(max(-(-i * total // levels), 1)) for i in range(1, levels)])
        found = placed.where(F.exists(ends, lambda e: (F.col("before") < e) & (e <= F.col("upto")))).select("v").collect()
    return sorted({r[0] for r in found}, key=lambda v: v.encode())  # the order of Spark's texts


def _bounds(df: DataFrame, dims: dict[str, str], bits: int) -> dict[str, list]:
    """Bounds between the levels of each dimension (named by its column): at most 2**bits - 1 values, of all rows.

    Numbers have approximate quantiles.  Whole texts are compared, so those that begin alike are told apart; their
    quantiles are exact.
    """
    levels = 1 << bits
    kinds = dict(df.dtypes)
    numbers = {k: c for k, c in dims.items() if kinds[c] != "string"}
    out = {}
    if numbers:
        cuts = [(i + 1) / levels for i in range(levels - 1)]
        found = df.agg(*[F.percentile_approx(F.col(c).cast("double"), cuts, 10000).alias(k) for k, c in numbers.items()]).first()
        out |= {k: sorted(set(found[k] or [])) for k in numbers}
    return out | {k: _text_bounds(df, dims[k], levels) for k in dims if k not in numbers}


def curve_cells(df: DataFrame, dims: dict[str, str], bits: int) -> DataFrame:
    """df with `curve`, the Hilbert index of the cell of its quantised dims (each the name of a column)."""
    bounds = _bounds(df, dims, bits)
    kinds = dict(df.dtypes)
    cell = F.lit(0)
    for k, c in dims.items():
        value = F.col(c) if kinds[c] == "string" else F.col(c).cast("double")
        level = F.lit(0)
        for cut in bounds[k]:
            level = level + F.coalesce((value > F.lit(cut)).cast("int"), F.lit(0))
        cell = cell * (1 << bits) + level
    n = len(dims)
    cells = np.arange(1 << (bits * n))
    levels = np.stack([(cells >> (bits * (n - 1 - d))) & ((1 << bits) - 1) for d in range(n)], 1)
    rows = [(int(a), int(b)) for a, b in zip(cells, hilbert_index(levels, bits))]
    # 2**(bits * dims) rows of two ints: a size set by the parameters, not by the data.
    lookup = df.sparkSession.createDataFrame(rows, "cell int, curve long")
    return df.withColumn("cell", cell.cast("int")).join(F.broadcast(lookup), "cell").drop("cell")


def _placed(docs: DataFrame, shards: int, law: str, bits: int, dims: tuple[str, ...], carry: bool) -> DataFrame:
    """(doc_id, size, text_crc32, curve, shard, slot) of every row and, if asked for, `row` with all its columns by number."""
    if law not in ("rows", "bytes"):
        raise ValueError(law)
    spark = docs.sparkSession
    named = {c: F.col(quoted(column_of(docs, c))) for c in dict.fromkeys(("doc_id", "text", *dims)) if c != "size"}
    text = F.coalesce(named.pop("text"), F.lit(""))
    row = [F.struct(F.lit(0).alias("none"), *[F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("row")] if carry else []
    own = docs.select(
        *[c.alias(n) for n, c in named.items()], *row,
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(F.encode(text, "utf-8")).alias("text_crc32"),
        F.xxhash64(text).alias("_digest"), F.md5(text).alias("_text"))
    with Workspace(spark) as work:
        # Without their rows the texts are read here, and only what is made of them further on.
        own = own if carry else work.written(own, "own")
        # Dimensions of a group of several equal texts: few rows of numbers, combined before they are shuffled.
        key = F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("id"), *[F.col(c).alias(f"d{i}") for i, c in enumerate(dims)])
        several = own.groupBy("_text").agg(F.min(key).alias("head"), F.count("*").alias("n")).where("n > 1")
        heads = work.written(several.select("_text", *[F.col(f"head.d{i}").alias(f"_d{i}") for i in range(len(dims))], F.lit(True).alias("_some")), "groups")
        own = own.join(heads, "_text", "left").withColumns({c: F.when(F.col("_some"), F.col(f"_d{i}")).otherwise(F.col(c)) for i, c in enumerate(dims) if c not in ("doc_id", "size")} | {
            f"_own_{c}": F.when(F.col("_some"), F.col(f"_d{i}")).otherwise(F.col(c)) for i, c in enumerate(dims) if c in ("doc_id", "size")})
        place = {c: f"_own_{c}" if c in ("doc_id", "size") else c for c in dims}
        own = curve_cells(own, place, bits)
        order = ["curve", "_digest", "_text", "doc_id"]
        runs = own.select("doc_id", "size", "text_crc32", *[r for r in ("row",) if carry], *order[:3])
        runs = runs.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
        # In the sorted runs: run number in the high bits, position in the run in the low 33.
        runs = written(runs.withColumn("_at", F.monotonically_increasing_id()), "runs")
    run, pos = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sums = sorted(tuple(r) for r in runs.groupBy(run.alias("run")).agg(
        F.count("*"), F.sum("size")).collect())  # one row for each sorted run
    total = sum(r[1] for r in sums)
    total_bytes = sum(r[2] for r in sums)
    begun, rows, done = [], 0, 0
    for r in sums:
        begun.append((r[0], rows, done))
        rows += r[1]
        done += r[2]
    starts = spark.createDataFrame(begun, "run int, before_rows long, before_bytes long")
    out = runs.withColumn("run", run.cast("int")).join(F.broadcast(starts), "run")
    rank = F.col("before_rows") + pos
    columns = ["doc_id", "size", "text_crc32", "curve", *[r for r in ("row",) if carry]]
    if law == "rows":
        # Shard s holds the ranks from ceil(s * total / shards): counts differ by one at most.
        s = F.expr(f"cast((before_rows + (_at & {(1 << 33) - 1})) * {shards} div {max(total, 1)} as int)")
        first = F.expr(f"cast((_shard * {total}L + {shards - 1}) div {shards} as long)")
        out = out.withColumn("_shard", s).withColumn("slot", rank - first)
        return out.select(*columns, F.col("_shard").alias("shard"), "slot")
    within = F.sum("size").over(Window.partitionBy("run").orderBy("_at")) - F.col("size")
    out = out.withColumn("_shard", F.least(
        F.lit(shards - 1), F.floor((F.col("before_bytes") + within) * shards / F.lit(max(total_bytes, 1)))).cast("int"))
    out = out.withColumn("_rank", rank)
    heads = out.groupBy("_shard").agg(F.min("_rank").alias("_head"))
    out = out.join(F.broadcast(heads), "_shard")  # one row a shard
    return out.select(*columns, F.col("_shard").alias("shard"), (F.col("_rank") - F.col("_head")).alias("slot"))


DIMS = ("source", "lang", "size", "doc_id")


def shard(docs: DataFrame, shards: int = 40, law: str = "rows", bits: int = 3, dims: tuple[str, ...] = DIMS) -> DataFrame:
    """doc_id, size, text_crc32, curve, shard and slot of every row.

    `size` is the text's UTF-8 bytes plus 16.  shard and slot follow the curve; slots of a
    shard run from 0 without gaps.  Only metadata is sorted; texts are read once, and not shuffled.
    """
    return _placed(docs, shards, law, bits, dims, carry=False)


def write_shards(docs: DataFrame, path: str, shards: int = 40, law: str = "rows", bits: int = 3, dims: tuple[str, ...] = DIMS) -> None:
    """Writes one folder (shard=N) of Parquet files for each shard, rows in curve order with their slot.

    Rows carry their columns along the curve, so every row is written once, whether or not its id is null or repeated.
    A column of docs that is called shard or slot gives way.
    """
    placed = _placed(docs, shards, law, bits, dims, carry=True)
    names = [(i, c) for i, c in enumerate(docs.columns) if c.lower() not in ("shard", "slot")]
    (placed.select(*[F.col(f"row.c{i}").alias(c) for i, c in names], "shard", "slot")
           .repartitionByRange(F.col("shard"), F.col("slot"))
           .sortWithinPartitions("shard", "slot")
           .write.partitionBy("shard").parquet(path))
