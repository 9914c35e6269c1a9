"""Articles and tables from files, and the adapters of other tables to the article schema."""
from __future__ import annotations

import re
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .. import fixed
from ..functions import views
from ..functions.slices import row_udf
from ..functions.text import any_case, id_text, strip
from ..schema import ARTICLE
from . import markup

_FIELDS = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("slot", "kind", "text")]))


def _fields(find):
    """An Arrow UDF from markup to its labelled texts; markup that can't be read at all has none."""
    def one(data) -> list[dict]:
        try:
            return [{"slot": s, "kind": k, "text": t} for s, k, t in find(data)]
        except (ValueError, RecursionError, AssertionError):
            return []
    return row_udf(one, _FIELDS)


_article, _page = (_fields(f) for f in (markup.article_fields, markup.page_fields))


def record(fields: Column) -> dict[str, Column]:
    """pmid, title, abstract, keywords and sections of an array of labelled texts (slot, kind, text)."""
    def texts(slot: str, *rules) -> Column:
        own = F.filter(fields, lambda f: reduce(lambda a, b: a & b, [f["slot"] == slot, *[r(f) for r in rules]]))
        return F.transform(own, lambda f: f["text"])

    def first(a: Column) -> Column:
        return F.coalesce(F.get(F.filter(a, lambda x: x != ""), F.lit(0)), F.lit(""))

    def section(f: Column) -> Column:
        # A text that opens with its own heading loses it there.
        title = views.clean_title(f["kind"])
        opens = (f["slot"] == "section") & (title != "") & F.startswith(F.lower(f["text"]), F.lower(title))
        rest = F.when(opens, strip(F.substring(f["text"], F.length(title) + 1, F.length(f["text"])))).otherwise(f["text"])
        return F.struct(title.alias("title"), rest.alias("text"))
    is_pmid = (lambda f: f["kind"] == "pmid", lambda f: f["text"].rlike(r"^\p{IsDigit}+$"))
    shown = lambda f: ~F.lower(f["kind"]).isin(fixed.SKIPPED_ABSTRACTS)
    headless = F.transform(texts("abstract", shown), lambda t: strip(F.regexp_replace(t, any_case(fixed.ABSTRACT_HEAD), "")))
    parts = F.filter(fields, lambda f: f["slot"].isin("section", "part"))
    return {"pmid": first(texts("article-id", *is_pmid)), "title": F.coalesce(F.get(texts("article-title"), F.lit(0)), F.lit("")),
            "abstract": first(headless), "keywords": F.filter(texts("kwd"), lambda t: t != ""),
            "sections": F.filter(F.transform(parts, section), lambda s: s["text"] != "")}


def _columns(df: DataFrame, name: Column, fields: Column) -> DataFrame:
    """pmcid and the record.  The fields are a column of their own, so markup is parsed once a row."""
    out = df.select(name.alias("pmcid"), fields.alias("f"))
    return out.select("pmcid", *[c.alias(n) for n, c in record(F.col("f")).items()])


#: Files that are opened by their paths; more are read with their whole folder.
LISTED = 10_000


def _files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.nxml").load(path)


def _file_id() -> Column:
    return F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"^PMC|\.nxml$", "")


def read_asked(spark: SparkSession, path: str, ids: DataFrame, cache: str | None = None, listed: int = LISTED) -> DataFrame:
    """The articles of the ids (pmcids) that have a file, as `read_articles` gives them.

    The folder is listed without its contents and joined with the ids, and only files of theirs are opened.  Their paths
    go to the driver, up to `listed` of them; for more ids the folder is read and joined, with the same result.
    """
    asked = ids.select("pmcids").where("pmcids is not null").distinct()
    names = _files(spark, path).select("path", _file_id().alias("pmcids"))
    found = [r["path"] for r in names.join(asked, "pmcids", "left_semi").select("path").limit(listed + 1).collect()]
    if len(found) > listed:
        return read_articles(spark, path, cache).join(asked, F.col("pmcid") == F.col("pmcids"), "left_semi")
    if not found:
        return spark.createDataFrame([], ARTICLE)
    return read_articles(spark, [re.sub(r"([\[\]{}*?\\])", r"\\\1", x) for x in sorted(found)], cache)


def read_articles(spark: SparkSession, path: str | list[str], cache: str | None = None) -> DataFrame:
    """One article for each PMC<id>.nxml file; unreadable ones have defaults and keep their id.

    With a cache (a folder of Parquet files), files that it holds as they are, by path, size and time, aren't parsed
    again, and new ones are added to it.  Spark doesn't list files of length zero; `lookup` gives their ids the same
    defaults.
    """
    files, name = _files(spark, path), _file_id()
    if cache is None:
        return _columns(files, name, _article("content"))
    mark = ["path", "length", "modificationTime"]
    schema = T.StructType([f for f in files.schema if f.name in mark] + [T.StructField("f", _FIELDS)])
    try:
        known = spark.read.schema(schema).parquet(cache)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        known = spark.createDataFrame([], schema)
    fresh = files.join(known.select(mark), mark, "left_anti")  # the cache is read without its texts
    fresh.select(*mark, _article("content").alias("f")).write.mode("append").parquet(cache)
    now = spark.read.schema(schema).parquet(cache).dropDuplicates(mark)
    return _columns(files.select(mark).join(now, mark), name, F.col("f"))


def parse_articles(df: DataFrame, key: str, data: str) -> DataFrame:
    """Articles from a column of markup (string or binary)."""
    return _columns(df, F.col(key).cast("string"), _article(F.col(data)))


_FAULTS = T.ArrayType(T.StructType([T.StructField("byte", T.LongType()), T.StructField("rule", T.StringType())]))


def markup_faults(df: DataFrame, key: str, data: str) -> DataFrame:
    """(key, byte, rule): where markup isn't well formed, and which rule (markup.RULES) was used there; well-formed rows have none."""
    def one(x) -> list[dict]:
        return [{"byte": b, "rule": r} for b, r in markup.recovered(x)[1]] if x else []
    found = row_udf(one, _FAULTS)
    return df.select(F.col(key), F.explode(found(F.col(data))).alias("f")).select(key, "f.byte", "f.rule")


def file_faults(spark: SparkSession, path: str) -> DataFrame:
    """(pmcid, byte, rule) of the files of a folder."""
    return markup_faults(_files(spark, path).select(_file_id().alias("pmcid"), "content"), "pmcid", "content")


def from_pages(pages: DataFrame) -> DataFrame:
    """Web pages as articles: a section for each heading."""
    return _columns(pages, F.col("page_id").cast("string"), _page("html"))


def page_title(html: Column) -> Column:
    """A page's first title as it is written: white space of ASCII is collapsed, and no reference is read but &amp;.

    `from_pages` gives the title that a reader sees.  "" where there is none, null for a null page.  Two cuts, so that time
    grows with the page, however many titles are left open in it.
    """
    behind = F.get(F.split(html, "(?i)<title>", 2), F.lit(1))
    parts = F.split(behind, "(?i)</title>", 2)
    bare = F.trim(F.regexp_replace(F.get(F.when(F.size(parts) == 2, parts), F.lit(0)), r"[\t\n\f\r ]+", " "))
    return F.when(html.isNotNull(), F.coalesce(F.replace(bare, F.lit("&amp;"), F.lit("&")), F.lit("")))


def from_documents(docs: DataFrame) -> DataFrame:
    """Plain documents as articles: the first line as title, the rest as abstract, and the whole text as methods."""
    text = F.coalesce("text", F.lit(""))
    line = F.substring_index(text, "\n", 1)
    section = F.struct(F.lit("methods").alias("title"), text.alias("text"))
    return docs.select(
        F.col("doc_id").cast("string").alias("pmcid"), F.lit("").alias("pmid"), line.alias("title"),
        F.substring(text, F.length(line) + 2, F.length(text)).alias("abstract"), F.array().cast("array<string>").alias("keywords"),
        F.array(section).alias("sections"))


def document_text() -> Column:
    """The whole text of an article that `from_documents` made; "" for an id without one."""
    return F.coalesce(F.get(F.col("sections"), F.lit(0))["text"], F.lit(""))


def read_labels(spark: SparkSession, path: str, kind: str = "csv") -> DataFrame:
    """A table of labels: known columns that exist, ids normalised, rows without an id left out."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"') if kind == "csv" else spark.read
    rows = reader.format(kind).load(path)
    known = [c for c in fixed.COLUMNS if c in rows.columns]
    return normalise_ids(rows.select(*[F.col(c).cast("string").alias(c) for c in known]))


def normalise_ids(rows: DataFrame) -> DataFrame:
    return rows.withColumn("pmcids", id_text(F.col("pmcids"))).where(F.col("pmcids").isNotNull())


def lookup(ids: DataFrame, articles: DataFrame) -> DataFrame:
    """Each id's article; ids without one have the defaults."""
    found = ids.join(articles.withColumnRenamed("pmcid", "_pmcid"), F.col("pmcids") == F.col("_pmcid"), "left").drop("_pmcid")
    empty = {"string": F.lit(""), "array<string>": F.array().cast("array<string>")}
    for f in ARTICLE:
        if f.name != "pmcid":
            kind = f.dataType.simpleString()
            found = found.withColumn(f.name, F.coalesce(F.col(f.name), empty.get(kind, F.array().cast(kind))))
    return found


def write_submission(rows: DataFrame, path: str, one_file: bool = False) -> None:
    """CSV in canonical column order; missing columns and nulls are the sentinel.  Line ends and quotes survive."""
    full = rows.select(*[F.coalesce(F.col(c), F.lit(fixed.NOT_SPECIFIED)).alias(c) if c in rows.columns
                         else F.lit(fixed.NOT_SPECIFIED).alias(c) for c in fixed.COLUMNS])
    writer = full.coalesce(1) if one_file else full
    writer.write.mode("overwrite").option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option(
        "ignoreTrailingWhiteSpace", False).csv(path)


def read_submission(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def write_pairs(pairs: DataFrame, path: str) -> None:
    """One JSON object a line."""
    pairs.write.mode("overwrite").json(path)


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Pairs from JSON lines; blank lines are skipped."""
    from ..schema import PAIR
    return spark.read.schema(PAIR).json(path)
