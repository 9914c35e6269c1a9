"""The jobs as registered queries: each runs its job twice into one new folder and returns what is there then."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from docloom import queries as extraction
from docloom.sources.scratch import scratch_dir

from . import extract_new, training_set

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f
    return add


@query(extraction.EXTRACTED)
def job1_extract_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of all documents; the second run finds nothing new."""
    out = scratch_dir(spark)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for _ in range(2):
        extract_new.run(spark, f"{sf_dir}/documents.parque[t]", out, word_lists=extraction.FIRING, tasks=tasks)
    return extract_new.current_records(spark, out).drop("batch").withColumn("conditions", F.array_join("conditions", " | "))


@query(f"""WITH d AS (SELECT doc_id, sha1(text) AS k, {extraction.CONTEXT} AS context FROM {extraction.ARTICLE}),
v AS (SELECT k, CAST(quality AS VARCHAR) AS label, count(*) AS n, min(d.doc_id) AS doc_id FROM (SELECT DISTINCT doc_id, k FROM d) d JOIN labels l ON d.doc_id = l.doc_id
  WHERE quality IS NOT NULL GROUP BY k, quality),
m AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n DESC, label) AS r, sum(n) OVER (PARTITION BY k) AS ratings, min(doc_id) OVER (PARTITION BY k) AS least FROM v),
t AS (SELECT k, least AS doc_id, label, ratings, n / ratings AS agreement, CAST('0x' || substr(k, 1, 8) AS BIGINT) % 100 < 20 AS held FROM m WHERE r = 1),
f AS (SELECT *, CASE WHEN held THEN -1 ELSE (row_number() OVER (PARTITION BY held, label ORDER BY k) - 1) % 5 END AS fold FROM t),
w AS (SELECT label, sum(count(*)) OVER () / (count(*) OVER () * count(*)) AS weight FROM t WHERE NOT held GROUP BY label),
c AS (SELECT k, count(*) AS copies, any_value(context) AS context FROM d GROUP BY k)
SELECT f.k AS text_sha1, f.doc_id, f.label, CAST(ratings AS BIGINT) AS ratings, round(agreement, 6) AS agreement, copies, round(weight, 6) AS weight, context,
  CASE WHEN held THEN 'held_out' ELSE 'train' END AS split, CAST(fold AS INTEGER) AS fold
FROM f JOIN c ON f.k = c.k LEFT JOIN w ON f.label = w.label""")
def job2_training_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The training set of `quality`."""
    out = scratch_dir(spark)
    for _ in range(2):
        training_set.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/labels.parquet", out)
    rows = spark.read.schema(training_set.SET).parquet(f"{out}/rows")
    return rows.withColumns({c: F.round(c, 6) for c in ("agreement", "weight")})
