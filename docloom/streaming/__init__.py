"""The rule plans over streams."""
from __future__ import annotations

from pyspark.sql import DataFrame

from ..plans.extract import MEDICAL, Lexicons, extract_all
from ..sources.articles import document_text, from_documents


def extract_stream(documents: DataFrame, lexicons: Lexicons = MEDICAL) -> DataFrame:
    """Extraction of a stream of documents.  It is stateless: each row's result depends on that row alone."""
    return extract_all(from_documents(documents), None, lexicons, condition_text=document_text())
