"""Makes the training set of a text classifier and a generator from documents and their ratings.

    python -m jobs.training_set --config jobs/training_set.json --documents PATH --labels PATH --out FOLDER

Raters rate documents, and copies of a text may be rated differently.  A row of the set is a text, known by its content
key: its label is what most of its ratings say (the lower label if as many say another), with the number of ratings, the
share that agree, and the number of documents that have the text.  A share of the texts is held out by their key, so
copies never lie on both sides; the rest is dealt to stratified folds and gets class weights, both of the rest alone.
Each row has the model's input: the article's context.  Below `out`:

    rows/split=S/fold=F     the set; texts that are held out have fold -1
    summary                 one row for each split, fold and label: rows, ratings, share of its split and fold

Both are written anew by each run, so that a run that broke off can be started again; equal tables give an equal set.
Ratings without a label and of unknown documents don't count, and are logged.
"""
from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession, functions as F

from docloom.functions import text, views
from docloom.operators import ranking
from docloom.sources.articles import from_documents

from .config import main

log = logging.getLogger("jobs.training_set")

SET = ("text_sha1 string, doc_id long, label string, ratings long, agreement double, copies long, weight double, context string, split string, fold int")


def rated_texts(docs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """(text_sha1, doc_id, label, ratings, agreement): each rated text, its least rated document, and what most ratings say."""
    told = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("string").alias("label")).where("label is not null")
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.content_key(F.col("text")).alias("text_sha1")).distinct()
    votes = keyed.join(told, "doc_id").groupBy("text_sha1", "label").agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id"))
    # One row for each text and label: the most votes, and the least label of those that have as many.
    most = F.max(F.struct("n")).alias("most")
    best = votes.groupBy("text_sha1").agg(most, F.sum("n").alias("ratings"), F.min("doc_id").alias("doc_id"), F.collect_list(F.struct("label", "n")).alias("votes"))
    top = F.array_min(F.transform(F.filter("votes", lambda v: v["n"] == F.col("most.n")), lambda v: v["label"]))
    return best.select("text_sha1", "doc_id", top.alias("label"), "ratings", (F.col("most.n") / F.col("ratings")).alias("agreement"))


def contexts(docs: DataFrame) -> DataFrame:
    """(text_sha1, copies, context) of each different text."""
    a = from_documents(docs.withColumn("_key", text.content_key(F.col("text"))).select("text", F.col("_key").alias("doc_id")))
    own = a.select(F.col("pmcid").alias("text_sha1"), views.article_context(F.col("title"), F.col("abstract"), F.col("sections")).alias("context"))
    return own.groupBy("text_sha1").agg(F.count("*").alias("copies"), F.first("context").alias("context"))  # equal texts have equal contexts


def training_set(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5, held_out_percent: int = 20) -> DataFrame:
    """The rows of the set, with split and fold."""
    place = F.conv(F.substring("text_sha1", 1, 8), 16, 10).cast("long") % 100
    rated = rated_texts(docs, labels, label).withColumn("split", F.when(place < held_out_percent, "held_out").otherwise("train"))
    train = ranking.stratified_folds(rated.where("split = 'train'"), "label", F.col("text_sha1"), folds)
    dealt = train.unionByName(rated.where("split <> 'train'").withColumn("fold", F.lit(-1)))
    weights = ranking.class_weights(train, "label")  # one row for each label
    return dealt.join(weights, "label", "left").join(contexts(docs), "text_sha1")


def run(spark: SparkSession, documents: str, labels: str, out: str, label: str = "quality", folds: int = 5, held_out_percent: int = 20) -> dict:
    """Writes the set and its summary below `out` and returns what was read and written."""
    docs, told = spark.read.parquet(documents), spark.read.parquet(labels)
    read = {"documents": docs.count(), "labels": told.count()}  # of the files' footers
    log.info("read %s", read)
    rows = training_set(docs, told, label, folds, held_out_percent)
    # A hint, so that a fold is written as few files of even size, however large it is.
    rows.select(*[c.split()[0] for c in SET.split(", ")]).hint("rebalance", "split", "fold").write.mode("overwrite").partitionBy("split", "fold").parquet(f"{out}/rows")
    made = spark.read.schema(SET).parquet(f"{out}/rows")
    summary = made.groupBy("split", "fold", "label").agg(F.count("*").alias("rows"), F.sum("ratings").alias("ratings"))
    total = made.groupBy("split", "fold").agg(F.count("*").alias("_rows"))
    summary = summary.join(total, ["split", "fold"]).withColumn("share", F.round(F.col("rows") / F.col("_rows"), 6)).drop("_rows")
    summary.coalesce(1).write.mode("overwrite").json(f"{out}/summary")  # a row for each split, fold and label
    found = spark.read.schema("split string, fold int, label string, rows long, ratings long, share double").json(f"{out}/summary").collect()
    wrote = {"texts": sum(r["rows"] for r in found), "ratings": sum(r["ratings"] for r in found)}
    for r in sorted(found, key=lambda r: (r["split"], r["fold"], r["label"])):
        log.info("%s fold %d label %s: %d texts, %d ratings", r["split"], r["fold"], r["label"], r["rows"], r["ratings"])
    log.info("wrote %s to %s; %d ratings don't count", wrote, out, read["labels"] - wrote["ratings"])
    return read | wrote


if __name__ == "__main__":
    main(run)
