"""The corpus pipeline: documents in, token ids of the kept and cleaned documents out.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame that
is written as Parquet and reread as the next one's docs.  All stages but the last return the columns
of documents.  Each works on all that the stage before kept.

Rows with a null text are kept as they are (empty for the encoder); an empty table passes through.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docloom.llm import bpe, decontaminate, ngram_join, ordinal, suffixes
from docloom.llm.shared import table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal classifier selects; poor and toxic ones go."""
    model = ordinal.fit(docs, table(spark, sf_dir, "labels"))
    return ordinal.select(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the least id, of each group linked by 5-word shingles at 0.8."""
    return ngram_join.one_of_each(docs, k=5, percent=80)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 50 bytes that an earlier document holds."""
    return suffixes.cleaned(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and digests of the ids and of the decoded text."""
    import public_tokenizers
    return bpe.encode_decode(docs, public_tokenizers.path("word_bpe_49k.json")).drop("decoded")


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", suffix_dedup),
    ("benchmark decontamination", decontamination),
    ("BPE encoding and decoding", encoding),
]

#: SQL can express neither the classifier's fit nor the encoder; the tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"stage-{i}")
    return docs
