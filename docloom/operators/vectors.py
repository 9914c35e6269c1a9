"""Embeddings: similarity, best match, and a content-addressed cache."""
from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .. import fixed
from ..functions.text import content_key, let


def dot(a: Column, b: Column) -> Column:
    """Dot product of two arrays; the cosine of normalised ones."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def best_in_array(vector: Column, others: Column) -> Column:
    """Largest dot product with an array of vectors; 0 if there are none."""
    return let(vector, lambda v: F.coalesce(F.array_max(F.transform(others, lambda o: dot(v, o))), F.lit(0.0)))


#: Rows whose pairs of vectors are held at once.
_MULTIPLIED = 512


def _best_dots(one: pa.Array, others: pa.Array) -> pa.Array:
    """Of each row the largest dot of a vector with an array of others, with the same sums: entry after entry, all pairs at once.  Null where no dot is known."""
    row = np.repeat(np.arange(len(one)), pc.fill_null(pc.list_value_length(others), 0).to_numpy(zero_copy_only=False))
    flat = others.flatten()
    own, other = (pc.fill_null(pc.list_value_length(x), -1).to_numpy(zero_copy_only=False) for x in (one, flat))
    same, best = own[row] == other, np.full(len(one), -np.inf)
    for size in np.unique(other[same & (other >= 0)]):
        rows, pairs = np.flatnonzero(own == size), np.flatnonzero(same & (other == size))
        left, right = (x.take(pa.array(at)).flatten() for x, at in ((one, rows), (flat, pairs)))
        left_row = np.searchsorted(rows, row[pairs])
        known = np.ones(len(pairs), bool)
        for x, n, at in ((left, len(rows), left_row), (right, len(pairs), slice(None))):
            if x.null_count:
                known &= ~pc.is_null(x).to_numpy(zero_copy_only=False).reshape(n, size).any(axis=1)[at]
        left, right = (np.ascontiguousarray(x.to_numpy(zero_copy_only=False).reshape(n, size).T) for x, n in ((left, len(rows)), (right, len(pairs))))
        total = np.zeros(len(pairs))
        for x, y in zip(left.astype(np.float64), right):
            total += x[left_row] * y
        np.maximum.at(best, row[pairs[known]], total[known])
    return pa.array(best, mask=best == -np.inf)


@F.arrow_udf(T.DoubleType())
def _best_of_batch(one: pa.Array, others: pa.Array) -> pa.Array:
    parts = [_best_dots(one.slice(i, _MULTIPLIED), others.slice(i, _MULTIPLIED)) for i in range(0, len(one), _MULTIPLIED)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.float64())


def similarities(left: DataFrame, right: DataFrame, keys: list[str], vector: str, others: str) -> DataFrame:
    """left's rows with those of right that have equal keys, and `similarity`, the largest dot product of left's vector with right's array of `others`; null without any.

    Arrays of a few vectors spare rows; what is large is best given as several rows.
    """
    r = right.withColumnsRenamed({k: f"_{k}" for k in keys} | {others: "_others"})
    pairs = left.join(r, reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_{k}") for k in keys]), "left")
    return pairs.withColumn("similarity", _best_of_batch(F.col(vector), F.col("_others"))).drop("_others", *[f"_{k}" for k in keys])


def best_similarity(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, vector: str = "embedding") -> DataFrame:
    """For each left row its largest dot product with right rows of equal keys; 0 if there are none.

    An equi-join on the keys; every key's rows are streamed against the other side and combined at once.
    """
    pairs = similarities(left.select(*keys, left_id, vector), right.select(*keys, F.array(vector).alias("others")), keys, vector, "others")
    return pairs.groupBy(*keys, left_id).agg(F.coalesce(F.max("similarity"), F.lit(0.0)).alias("similarity"))


def hashing_encoder(size: int = fixed.EMBEDDING_SIZE) -> Callable[[list[str]], np.ndarray]:
    """The encoder used where no model is given: signed hashed words, normalised."""
    import zlib

    def encode(texts: list[str]) -> np.ndarray:
        words = [t.lower().split() for t in texts]
        hashes = np.array([zlib.crc32(w.encode()) for ws in words for w in ws], np.int64)
        cells = np.repeat(np.arange(len(texts)), [len(ws) for ws in words]) * size + hashes % size
        out = np.bincount(cells, np.where(hashes & 0x80000000, 1.0, -1.0), len(texts) * size).astype(np.float32).reshape(len(texts), size)
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm == 0, 1, norm)
    return encode


def encode_texts(texts: DataFrame, make_encoder: Callable[[], Callable[[list[str]], np.ndarray]], batch: int = 64) -> DataFrame:
    """(text_sha1, embedding) of (text_sha1, text); the encoder is made once for each worker task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = make_encoder()
        for rows in batches:
            found = [np.asarray(encode(rows.column("text").slice(a, batch).to_pylist()), np.float32) for a in range(0, len(rows), batch)]
            if found:
                ends = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * found[0].shape[1])
                yield pa.RecordBatch.from_arrays([rows.column("text_sha1"), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(found).ravel()))], ["text_sha1", "embedding"])
    return texts.select("text_sha1", "text").mapInArrow(run, "text_sha1 string, embedding array<float>")


def cache_misses(texts: DataFrame, cache: DataFrame, text: str = "text") -> DataFrame:
    """(text_sha1, text): texts that the cache doesn't hold, each once."""
    keyed = texts.select(content_key(F.col(text)).alias("text_sha1"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return keyed.dropDuplicates(["text_sha1"]).join(cache.select("text_sha1"), "text_sha1", "left_anti")


def embedded(texts: DataFrame, cache: DataFrame, text: str = "text") -> DataFrame:
    """texts with text_sha1 and, of the cache, embedding."""
    known = cache.select("text_sha1", "embedding").dropDuplicates(["text_sha1"])  # a cache may hold a text twice
    return texts.withColumn("text_sha1", content_key(F.col(text))).join(known, "text_sha1", "left")


def embed(texts: DataFrame, cache: DataFrame, make_encoder=hashing_encoder, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(texts with text_sha1 and embedding, new cache rows).  Only texts that the cache lacks are encoded, by each plan that uses them."""
    new = encode_texts(cache_misses(texts, cache, text), make_encoder)
    return embedded(texts, cache.select("text_sha1", "embedding").unionByName(new), text), new


def append_cache(new: DataFrame, path: str) -> None:
    """Adds encoded texts to the cache table."""
    new.select("text_sha1", "embedding").write.mode("append").parquet(path)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The cache table, each text once; empty where there is none yet."""
    schema = "text_sha1 string, embedding array<float>"
    try:
        return spark.read.schema(schema).parquet(path).dropDuplicates(["text_sha1"])
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise
