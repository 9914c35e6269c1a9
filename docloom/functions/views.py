"""Derived text views of an article's columns."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import fixed
from .text import any_case, squeeze, strip


def section_by(sections: Column, pattern: str) -> Column:
    """Texts of the sections whose title matches, joined by line ends."""
    hit = F.filter(sections, lambda s: s["title"].rlike(any_case(pattern)))
    return F.array_join(F.transform(hit, lambda s: s["text"]), "\n")


def methods_text(sections: Column) -> Column:
    return section_by(sections, fixed.METHODS_TITLES)


def title_abstract(title: Column, abstract: Column) -> Column:
    return strip(F.concat(title, F.lit(". "), abstract))


def lexical_text(title: Column, abstract: Column, sections: Column) -> Column:
    return strip(F.concat(title, F.lit(". "), abstract, F.lit(" "), methods_text(sections)))


def article_context(title: Column, abstract: Column, sections: Column, most: int = fixed.CONTEXT_CHARS) -> Column:
    parts = F.filter(F.array(title, abstract, section_by(sections, fixed.CONTEXT_TITLES)), lambda x: x != "")
    return F.substring(squeeze(F.array_join(parts, " . ")), 1, most)


def full_text(title: Column, abstract: Column, sections: Column) -> Column:
    return strip(F.array_join(F.concat(F.array(title, abstract), F.transform(sections, lambda s: s["text"])), "\n"))


def clean_title(c: Column) -> Column:
    """A section's title without its number."""
    return strip(F.regexp_replace(strip(F.coalesce(c, F.lit(""))), any_case(fixed.TITLE_NUMBER), ""))
