import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docloom.llm import bpe, decontaminate, ordinal

from . import fixtures as fx


def test_stages_and_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "suffix-array dedup", "benchmark decontamination", "BPE encoding and decoding"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_run_equals_brute_force(spark, sf_dir):
    P = pytest.importorskip("public_tokenizers")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = ordinal.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    keep = {r.doc_id for r in ordinal.score(docs, model).where("selected").collect()}
    rows = [tuple(r) for r in docs.collect() if r.doc_id in keep]
    part = fx.components(rows, 5, 80)
    rows = [r for i, r in enumerate(rows) if part[i] == r[0]]
    rows = [(r[0], k.decode("utf-8", "ignore")) for r, (b, k, _) in zip(rows, fx.removed(rows)) if k or not b]
    items = [fx.words(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    code = {}

    def coded(ws):
        return np.array([code.setdefault(w, len(code) + 1) for w in ws], np.uint64)

    def leaks(text):
        w = fx.words(text)
        grams = {tuple(w[i:i + 5]) for i in range(len(w) - 4)}
        return any(any(tuple(t[i:i + 5]) in grams for i in range(len(t) - 4))
                   and sum(n for *_, n in decontaminate.tiles(coded(w), coded(t), 5)) >= 0.5 * len(t) for t in items)
    rows = [r for r in rows if not leaks(r[1])]
    encoder = bpe.ForcedBoundaryBPE(P.path("word_bpe_49k.json"))
    want = sorted((d, hashlib.sha256(encoder.encode(t)).hexdigest()) for d, t in rows)
    got = sorted((r.doc_id, r.ids_sha256) for r in corpus_pipeline.run(spark, sf_dir).collect())
    assert got == want and len(want) > 50


def test_empty_and_odd_tables(spark, tmp_path):
    rows = fx.documents(10)
    for name, data in (("none", []), ("odd", rows)):
        d = f"{tmp_path}/{name}"
        df = spark.createDataFrame(data, fx.SCHEMA).withColumn("g", F.lit(1))
        df.write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([(r[0], 1, 0) for r in data[:3]], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        spark.createDataFrame([(1, None), (2, "a b c d e f g")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
        at = df
        for _, stage in corpus_pipeline.STAGES[:-1]:
            at = stage(spark, at, d)
            assert at.columns == df.columns
        assert corpus_pipeline.run(spark, d).count() == at.count()
