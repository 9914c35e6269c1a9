"""The registered queries of this subpackage, and SQL for those that SQL can express.

Each query applies its operator with production parameters to the whole table and derives
the contract's columns from what the operator returns.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, decontaminate, fingerprints, infill, katz, langid, lines, ngram_join, ordinal, sharding, suffixes, warc
from .shared import table

QUERIES = {}
ORACLE_SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def id_hash(modulus: int):
    """crc32 of doc_id as text, modulo."""
    return F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")) % modulus


@query
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(id_hash(4) == 2, F.lit(False))
    model = langid.fit(docs.where(~held))
    found = langid.predict(docs, model)
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "accepted")


@query
def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = ordinal.fit(docs, table(spark, sf_dir, "labels"))
    return ordinal.score(docs.select("doc_id", "text"), model).drop("text")


@query
def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.components_of(table(spark, sf_dir, "documents"), k=4, percent=85)


@query
def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = katz.score(docs, id_hash(7) != 2)
    return found.select("doc_id", F.coalesce(id_hash(7) == 2, F.lit(False)).alias("held_out"), "n_tokens", "n_known",
                        "train_tokens", "base_score", "score")


@query
def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_edits(table(spark, sf_dir, "documents"))


@query
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contaminated documents: one row for each document and benchmark item it holds."""
    found = decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "item_words", "covered_words", "coverage", F.size("tiles").alias("n_tiles"),
                        F.lit(True).alias("contaminated"))


@query
def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), keep_ids=False)


@query
def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.removed(table(spark, sf_dir, "documents")).drop("spans")


@query
def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.round_trip(table(spark, sf_dir, "pages"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(table(spark, sf_dir, "documents"), shards=40, law="rows")
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"), "curve")


@query
def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = infill.transform(table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c, 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"),
                       digest(infill.restored(F.col("form"), F.col("output"))).alias("restored_sha256"))


@query
def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = lines.cleaned(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE_SQL["op8_warc"] = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS digest FROM pages
), g AS (
  SELECT *, max(page_id) OVER (PARTITION BY digest) AS head FROM p
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN n >= 1000 AND page_id <> head THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id <> head THEN head END AS refers_to
FROM g
"""

# Words, shingles, links of all pairs that share one, and what links reach.
ORACLE_SQL["op2_ngram_jaccard"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
e AS (SELECT a AS u, b AS v FROM l UNION ALL SELECT b, a FROM l),
r(u, v) AS (SELECT DISTINCT u, u FROM e UNION SELECT r.u, e.v FROM r JOIN e ON r.v = e.u)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(m.least, d.doc_id) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT u, min(v) AS least FROM r GROUP BY u) m ON m.u = d.doc_id
"""

# Every string of 50 bytes, as hex, with the least document it starts in; runs of covered bytes; what is left.
ORACLE_SQL["op7_suffix_dedup"] = r"""
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT doc_id, place, substr(x, 2 * place + 1, 100) AS bytes50 FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2 - 49)) AS place FROM b)),
f AS (SELECT bytes50, min(doc_id) AS least FROM w GROUP BY bytes50),
c AS (SELECT doc_id, place FROM w JOIN f ON w.bytes50 = f.bytes50 WHERE f.least < doc_id),
g AS (SELECT doc_id, place, CASE WHEN place <= lag(place) OVER (PARTITION BY doc_id ORDER BY place) + 50 THEN 0 ELSE 1 END AS fresh FROM c),
i AS (SELECT doc_id, place, sum(fresh) OVER (PARTITION BY doc_id ORDER BY place) AS run FROM g),
t AS (SELECT doc_id, run, min(place) AS s, max(place) + 50 AS e FROM i GROUP BY doc_id, run),
k AS (SELECT t.doc_id, t.run, substr(x, 2 * coalesce(lag(e) OVER (PARTITION BY t.doc_id ORDER BY t.run), 0) + 1, 2 * (s - coalesce(lag(e) OVER (PARTITION BY t.doc_id ORDER BY t.run), 0))) AS part, e, s, x FROM t JOIN b ON t.doc_id = b.doc_id),
a AS (SELECT doc_id, count(*) AS n_spans, sum(e - s) AS n_removed, string_agg(part, '' ORDER BY run) || substr(any_value(x), 2 * max(e) + 1) AS kept FROM k GROUP BY doc_id)
SELECT b.doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(kept, x))) AS kept_sha256
FROM b LEFT JOIN a ON a.doc_id = b.doc_id
"""

# Lines as a list, the draws from the digest's first four groups.
ORACLE_SQL["op11_fill_in_middle"] = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), k AS (
  SELECT doc_id, t, u, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(u) + 1) AS x, CAST('0x' || h[9:16] AS BIGINT) % (len(u) + 1) AS y,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain' WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM d
), p AS (
  SELECT doc_id, t, n, form, coalesce(array_to_string(u[1:least(x, y)], ''), '') AS p, coalesce(array_to_string(u[least(x, y) + 1:greatest(x, y)], ''), '') AS m,
    coalesce(array_to_string(u[greatest(x, y) + 1:], ''), '') AS s FROM k
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN t ELSE p || m || s END) AS restored_sha256
FROM p
"""

# Every line with its key; keys of 20 characters in three documents, each with its largest document.
ORACLE_SQL["op12_line_dedup"] = r"""
WITH l AS (
  SELECT doc_id, generate_subscripts(a, 1) AS i, unnest(a) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents)
), k AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), g AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
j AS (SELECT k.doc_id, i, line, g.keeper IS NOT NULL AND g.keeper <> k.doc_id AS gone FROM k LEFT JOIN g ON g.key = k.key)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""
