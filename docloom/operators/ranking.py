"""Counts, rankings, folds and weights."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import fixed
from ..sources.scratch import scratch_dir


def label_distribution(df: DataFrame, label: str) -> DataFrame:
    """(label, n, share): share of the largest class is the majority rate."""
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))  # one row
    return counts.crossJoin(F.broadcast(total)).select("label", "n", (F.col("n") / F.col("total")).alias("share"))


def term_ranking(terms: DataFrame, keys: list[str]) -> DataFrame:
    """Terms (keys, term, pos) grouped ignoring case within keys: n, the first spelling, and the rank by (n, length, first place).

    Terms of rows that are dealt by the keys already (`repartition`) aren't shuffled any more.
    """
    # Spellings first, by numbers alone; only what is left of them is sorted.
    spelled = terms.groupBy(*keys, "term").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    groups = spelled.groupBy(*keys, F.lower("term").alias("key")).agg(
        F.sum("n").alias("n"), F.min_by("term", F.struct("first", "term")).alias("display"), F.min("first").alias("first"))
    order = Window.partitionBy(*keys).orderBy(F.desc("n"), F.desc(F.length("key")), "first")
    return groups.withColumn("rank", F.row_number().over(order))


def numbered_within(df: DataFrame, group: str, order: Column, name: str) -> DataFrame:
    """df with `name`, the number (from 0) of each row among those of its group in the given order.

    Rows are sorted by ranges of (group, order) and written; a group's rows before a range are found from counts, one
    for each range and group.  So a group that holds most rows lies in many tasks, where a window would need one.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    runs = df.withColumn("_order", order).repartitionByRange(parts, group, "_order").sortWithinPartitions(group, "_order")
    path = scratch_dir(spark)
    runs = runs.withColumn("_at", F.monotonically_increasing_id())  # run number in the high bits, place in the low 33
    runs.write.parquet(path)
    runs = spark.read.schema(runs.schema).parquet(path).withColumn("_run", F.shiftright("_at", 33))
    sizes = runs.groupBy("_run", group).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy(group).orderBy("_run")) - F.col("_n")
    starts = sizes.select("_run", F.col(group).alias("_group"), "_first", before.alias("_before"))
    found = runs.alias("r").join(starts.alias("s"), (F.col("r._run") == F.col("s._run")) & F.col(f"r.{group}").eqNullSafe(F.col("s._group")))
    return found.select(*[F.col(f"r.`{c}`") for c in df.columns], (F.col("_before") + F.col("_at") - F.col("_first")).alias(name))


def stratified_folds(df: DataFrame, label: str, order: Column, folds: int = 5) -> DataFrame:
    """df with fold: rows of a label, in the given order, dealt in turn."""
    return numbered_within(df, label, order, "fold").withColumn("fold", (F.col("fold") % folds).cast("int"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, weight) with weight = rows / (classes * rows of the class)."""
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"), F.count("*").alias("classes"))
    return counts.crossJoin(F.broadcast(total)).select("label", (F.col("total") / (F.col("classes") * F.col("n"))).alias("weight"))


def top_in_order(df: DataFrame, keys: list[str], p: str, pos: str, k: int, least: float = fixed.LEAST_PROBABILITY) -> DataFrame:
    """Of each key's rows the k with the largest p, if at least `least`; ties go to the earlier row.

    Rows keep their place in pos, so that sorting by it restores the document's order.
    """
    w = Window.partitionBy(*keys).orderBy(F.desc(p), pos)
    return df.withColumn("rank", F.row_number().over(w)).where((F.col("rank") <= k) & (F.col(p) >= least))


def in_document_order(df: DataFrame, keys: list[str], pos: str, text: str) -> DataFrame:
    """Each key's texts as one array in the order of pos."""
    rows = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(pos, text))).alias("rows"))
    return rows.select(*keys, F.transform("rows", lambda r: r[text]).alias("texts"))


def weak_label(inclusion: Column, exclusion: Column, least: float = fixed.LEAST_SIMILARITY) -> Column:
    """The side whose best similarity is larger, or none below the bound."""
    return (F.when(F.greatest(inclusion, exclusion) < least, "none").when(inclusion >= exclusion, "inclusion").otherwise("exclusion"))


def distinct_check(df: DataFrame, key: str) -> DataFrame:
    """One row: rows, distinct keys, and whether they agree."""
    return df.agg(F.count("*").alias("n_rows"), F.countDistinct(key).alias("n_keys")).withColumn("unique", F.col("n_rows") == F.col("n_keys"))


def macro_f1(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """One row with the unweighted mean of the classes' F1."""
    classes = df.select(F.col(label).alias("c")).union(df.select(F.col(prediction).alias("c"))).distinct()
    hit = df.where(F.col(label) == F.col(prediction)).groupBy(F.col(label).alias("c")).agg(F.count("*").alias("tp"))
    true = df.groupBy(F.col(label).alias("c")).agg(F.count("*").alias("n_true"))
    told = df.groupBy(F.col(prediction).alias("c")).agg(F.count("*").alias("n_told"))
    each = classes.join(hit, "c", "left").join(true, "c", "left").join(told, "c", "left").fillna(0)
    return each.agg(F.round(F.avg(2 * F.col("tp") / (F.col("n_true") + F.col("n_told"))), 4).alias("macro_f1"))
