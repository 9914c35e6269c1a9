"""Extracts records from the documents that arrived since the last run.

    python -m jobs.extract_new --config jobs/extract_new.json --documents FOLDER --out FOLDER

Documents (doc_id, text) are Parquet files that are added to a folder.  A file stream with a checkpoint takes what is
new, in batches, and ends.  Below `out`:

    records/batch=N/study_type=X   the extracted records of batch N
    rejected/batch=N               rows without an id, as they came
    log/batch=N                    one row: rows read, written, rejected, and records of each study type
    checkpoint                     the stream's state, unless another place is given

A batch's folders are written anew if it has to be repeated, and the checkpoint repeats a batch with the very files it
had, so a run that broke off can be started again and leaves what one run would have left.  Output and checkpoint
belong together: to start over, give new folders for both.  A document that is delivered again replaces its record:
`current_records` takes the newest batch of each id; repeated rows of one batch all stay.
"""
from __future__ import annotations

import logging

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from docloom import fixed
from docloom.plans.extract import MEDICAL, Lexicons, extract_all
from docloom.sources.articles import document_text, from_documents

from .config import main

log = logging.getLogger("jobs.extract_new")

_TEXT = [c for c in fixed.COLUMNS if c != "conditions"]
RECORD = T.StructType([T.StructField(c, T.StringType()) for c in _TEXT if c != "study_type"] + [
    T.StructField("conditions", T.ArrayType(T.StringType())), T.StructField("batch", T.LongType()), T.StructField("study_type", T.StringType())])
LOG = "read long, written long, rejected long, study_types map<string, long>, batch long"


def _read(spark: SparkSession, path: str, schema) -> DataFrame:
    """A table of the job; empty where no batch has been written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def records(spark: SparkSession, out: str) -> DataFrame:
    """Every record of every batch."""
    return _read(spark, f"{out}/records", RECORD)


def current_records(spark: SparkSession, out: str) -> DataFrame:
    """The records of each id's newest batch."""
    every = records(spark, out)
    newest = every.groupBy(F.col("pmcids").alias("_id")).agg(F.max("batch").alias("_newest"))
    return every.join(newest, (F.col("pmcids") == F.col("_id")) & (F.col("batch") == F.col("_newest"))).drop("_id", "_newest")


def batches(spark: SparkSession, out: str) -> DataFrame:
    """The log: a row for each batch."""
    return _read(spark, f"{out}/log", LOG)


def extract_batch(docs: DataFrame, batch: int, out: str, word_lists: Lexicons = MEDICAL, tasks: int = 0) -> dict:
    """Writes one batch's folders and returns its log row."""
    spark = docs.sparkSession
    read = docs.count()  # of the files' footers
    known = docs.where("doc_id is not null")
    # Extraction takes far longer than reading: few large row groups are dealt out, whatever their ids.
    known = known.repartition(tasks) if tasks else known
    found = extract_all(from_documents(known), lexicons=word_lists, condition_text=document_text())
    found.write.mode("overwrite").partitionBy("study_type").parquet(f"{out}/records/batch={batch}")
    docs.where("doc_id is null").write.mode("overwrite").parquet(f"{out}/rejected/batch={batch}")
    types = {r["study_type"]: r["count"] for r in records(spark, out).where(F.col("batch") == batch).groupBy("study_type").count().collect()}  # a row each of two types
    rejected = spark.read.schema(docs.schema).parquet(f"{out}/rejected/batch={batch}").count()
    row = {"read": read, "written": sum(types.values()), "rejected": rejected, "study_types": types}
    if row["written"] + rejected != read:
        raise RuntimeError(f"batch {batch}: {row}")
    spark.createDataFrame([tuple(row.values())], LOG.removesuffix(", batch long")).write.mode("overwrite").parquet(f"{out}/log/batch={batch}")
    log.info("batch %d: read %d rows, wrote %d records %s, rejected %d", batch, read, row["written"], types, rejected)
    return row


def run(spark: SparkSession, documents: str, out: str, checkpoint: str | None = None, word_lists: Lexicons = MEDICAL,
        files_per_batch: int = 1000, tasks: int = 0) -> dict:
    """Extracts what is new below `documents` (a folder or a pattern of Parquet files) and returns what this run read and wrote."""
    schema = T.StructType([f for f in spark.read.parquet(documents).schema if f.name in ("doc_id", "text")])
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(documents)
    done = []

    def write(docs: DataFrame, batch: int) -> None:
        done.append(extract_batch(docs, batch, out, word_lists, tasks))
    query = (stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint or f"{out}/checkpoint")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    total = {"batches": len(done)} | {k: sum(r[k] for r in done) for k in ("read", "written", "rejected")}
    log.info("%s: %s to %s", documents, total, out)
    return total


if __name__ == "__main__":
    main(run)
