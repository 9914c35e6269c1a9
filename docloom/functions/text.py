"""Text kernels as Catalyst expressions.

Regular expressions are written for Unicode: (?U) for classes and word boundaries, (?iu) to ignore case.
Null texts give null (or an empty array from functions that return arrays).
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from .. import fixed


def any_case(pattern: str) -> str:
    return f"(?iuU){pattern}"


def word_pattern(words: list[str]) -> str:
    """A pattern of any of the words between word boundaries."""
    return r"\b(?:" + "|".join(words) + r")\b"


def whole_words(words: list[str]) -> str:
    return any_case(word_pattern(words))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


def strip_chars(c: Column, chars: str) -> Column:
    """c without any of the characters at its ends.  A run of them inside is followed from its first one only."""
    one = "[" + "".join("\\" + x if x in r"\-]^[" else x for x in chars) + "]"
    return F.regexp_replace(c, f"^{one}+|{one}(?<!{one}{one}){one}*+\\z", "")


def squeeze(c: Column) -> Column:
    """White space runs as one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def sentences(c: Column) -> Column:
    """Sentences of a text: split after [.!?;] before a capital, digit or bracket, but not after an abbreviation."""
    short = "|".join(a.replace(".", r"\.") for a in fixed.ABBREVIATIONS)
    cut = r"(?<=[.!?;])(?<!(?U:\b)(?iu:(?:" + short + r"))\.)\s+(?=[A-Z0-9(])"
    return F.filter(F.split(squeeze(F.coalesce(c, F.lit(""))), cut), lambda x: x != "")


def strip_bullet(c: Column) -> Column:
    return F.regexp_replace(c, "(?U)" + fixed.BULLET, "")


def let(c: Column, body: Callable[[Column], Column]) -> Column:
    """body of c, with c computed once: inside lambdas an expression is otherwise computed for every entry."""
    return F.get(F.transform(F.array(c), body), F.lit(0))


def nonempty(c: Column) -> Column:
    """A generator of the texts of c that aren't "".

    c is computed once, where a filter on its column computes it again.  Nor is what c is made of moved into it: Spark
    can't run a Python UDF on an expression in which a lambda uses an outer one's variable.
    """
    return F.explode(F.filter(F.array(c), lambda x: x != ""))


def ordered_distinct(a: Column) -> Column:
    """The array's first entry of each text, ignoring case."""
    return let(a, lambda x: let(F.transform(x, F.lower), lambda low: F.filter(x, lambda v, i: F.array_position(low, F.lower(v)) == i + 1)))


def first_distinct(a: Column, most: int) -> Column:
    """The first `most` entries of ordered_distinct(a).  Work grows with the array, not with its square."""
    def firsts(found: Column) -> Column:
        keys = F.slice(F.array_distinct(found["low"]), 1, most)
        return F.transform(keys, lambda k: F.get(found["a"], F.array_position(found["low"], k).cast("int") - 1))
    return let(let(a, lambda x: F.struct(x.alias("a"), F.transform(x, F.lower).alias("low"))), firsts)


def truncate_clean(c: Column, target: int = fixed.TRUNCATE_TARGET, extra: int = fixed.TRUNCATE_EXTRA) -> Column:
    """c cut at a bullet, sentence or word end near the target length; short texts stay."""
    least = -(-target * 6 // 10)
    window = F.substring(c, 1, target + extra)
    cuts = [F.regexp_extract(window, rf"(?s)\A(.{{{least},}})\n\*", 1),
            F.regexp_extract(window, rf"(?sU)\A(.{{{least - 2},}}[.;]\s)", 1),
            F.regexp_extract(F.substring(window, 1, target + 40), rf"(?s)\A(.{{{least},}}) ", 1),
            F.substring(c, 1, target)]
    cut = F.coalesce(*[F.nullif(x, F.lit("")) for x in cuts], F.lit(""))
    text = F.coalesce(c, F.lit(""))
    return F.when(F.length(text) <= target, text).otherwise(F.regexp_replace(cut, r"(?U)\s+\z", ""))


def truncate_hard(c: Column, most: int = fixed.HARD_CHARS) -> Column:
    return F.substring(c, 1, most)


def content_key(c: Column) -> Column:
    return F.sha1(F.coalesce(c, F.lit("")))


def prompt(prefix: str, context: Column) -> Column:
    return F.concat(F.lit(prefix), context)


def id_text(c: Column) -> Column:
    """An id as the text of a whole number where it is one, else as stripped text; blank is null."""
    number = c.cast("string").try_cast("double")
    whole = number.try_cast("bigint").cast("string")
    text = strip(c.cast("string"))
    return F.coalesce(F.when(~F.isnan(number), whole), F.when(text != "", text))
