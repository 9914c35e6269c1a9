"""Schemas of the engine's relations."""
from __future__ import annotations

from pyspark.sql import types as T

SECTIONS = T.ArrayType(T.StructType([T.StructField("title", T.StringType()), T.StructField("text", T.StringType())]))
ARTICLE = T.StructType([
    T.StructField("pmcid", T.StringType()), T.StructField("pmid", T.StringType()), T.StructField("title", T.StringType()),
    T.StructField("abstract", T.StringType()), T.StructField("keywords", T.ArrayType(T.StringType())), T.StructField("sections", SECTIONS)])
VECTOR_CACHE = "text_sha1 string, embedding array<float>"
PAIR = "pmcids string, input string, target string"
