"""Named conditions: cleaning, deduplication, matching and cell encoding."""
from __future__ import annotations

import ast
import re

import ahocorasick
from pyspark.sql import Column, functions as F, types as T

from .. import fixed
from .scan import pattern_matches
from .slices import row_udf
from .text import any_case, first_distinct, let, ordered_distinct, squeeze, strip, strip_chars, whole_words


def title_case(c: Column) -> Column:
    """Words capitalised; words of two or more capitals stay as they are."""
    def word(w: Column) -> Column:
        acronym = (w == F.upper(w)) & (w != F.lower(w)) & (F.length(w) > 1)
        # One letter may have a capital of two, of which only the first stays large.
        head = F.upper(F.substring(w, 1, 1))
        tail = F.concat(F.substring(head, F.lit(2), F.length(head)), F.substring(w, F.lit(2), F.length(w)))
        return F.when(acronym, w).otherwise(F.concat(F.substring(head, 1, 1), F.lower(tail)))
    words = F.filter(F.split(strip_chars(squeeze(c), " .,;:"), " "), lambda w: w != "")
    return F.array_join(F.transform(words, word), " ")


#: Words that a name goes without: numbers and single letters.
_DROPPED = r"(?<![^ ])(?:\p{IsDigit}+|\p{L})(?![^ ])"


def clean_condition(c: Column) -> Column:
    """A condition's clean name, or null where the text names none.

    Each step's text is bound once, and a phrase is searched as a whole, not word by word.
    """
    def name(led: Column, text: Column) -> Column:
        key = F.lower(text)
        good = ((F.length(text) >= 3) & (F.length(text) <= 60)
                & text.rlike(r"(?<![^ ])\p{L}{4,}(?![^ ])")
                & ~led.rlike(r"(?U)\b[A-Z]\.")
                & ~key.isin(fixed.CONDITION_GENERIC + fixed.CONDITION_BLOCKED)
                & ~text.rlike(whole_words(fixed.CONDITION_JUNK)))
        return F.when(good, title_case(text))

    def kept(led: Column) -> Column:
        text = F.trim(F.regexp_replace(F.regexp_replace(led, _DROPPED, ""), " +", " "))
        return let(text, lambda t: name(led, t))
    bare = strip_chars(squeeze(c), " .,;:-—–\t\n")
    return let(F.trim(F.regexp_replace(bare, any_case(r"^(?:(?:" + "|".join(fixed.CONDITION_LEADS) + r")\s+)++"), "")), kept)


def drop_contained(terms: Column) -> Column:
    """Terms that lie in no other, different term, ignoring case."""
    return let(terms, lambda all_terms: F.filter(all_terms, lambda t: ~F.exists(all_terms, lambda u: (t != u) & F.contains(F.lower(u), F.lower(t)))))


def _outside(keys: list[str]) -> list[bool]:
    """Whether each text lies in no longer one: an automaton of all of them reads each once."""
    automaton = ahocorasick.Automaton()
    for k in keys:
        if k:
            automaton.add_word(k, k)
    if not len(automaton):
        return [True] * len(keys)
    automaton.make_automaton()
    inner = {""}
    for k in set(keys):
        inner.update(hit for _, hit in automaton.iter(k) if len(hit) < len(k))
    return [k not in inner for k in keys]


def _outer_words(texts: list[str], lows: list[str]) -> list[str]:
    n: dict[str, int] = {}
    first: dict[str, tuple[int, str]] = {}
    for text, low in zip(texts, lows):
        for at in enumerate(text.split(" ")):
            if at[1]:
                key = low[at[0]]
                n[key] = n.get(key, 0) + 1
                if key not in first or at < first[key]:
                    first[key] = at
    ranked = sorted(n, key=lambda k: (-n[k], -len(k), first[k]))
    return [first[k][1] for k, outside in zip(ranked, _outside(ranked)) if outside]


_outer = row_udf(lambda texts, lows: _outer_words(texts, [x.split(" ") for x in lows]), T.ArrayType(T.StringType()))


def outer_words(texts: Column) -> Column:
    """Of the words of some texts, ignoring case, those that lie in no other: first spellings by rank, as `ranking.term_ranking` has it.

    Work grows with the texts' length, not with the square of their words' number.
    """
    bare = F.transform(texts, lambda t: F.regexp_replace(t, r"\s+", " "))
    return _outer(bare, F.transform(bare, F.lower))


def found_conditions(pool: Column, words: str = fixed.DISEASE_WORDS, suffixes: str = fixed.DISEASE_SUFFIX) -> Column:
    """Conditions that the vocabulary and then the suffix patterns find: cleaned, distinct, at most three; else the sentinel."""
    hits = pattern_matches(pool, [words, suffixes], exact=[suffixes])
    clean = F.filter(F.transform(hits, clean_condition), lambda x: x.isNotNull())
    top = F.slice(drop_contained(ordered_distinct(clean)), 1, fixed.CONDITIONS_FOUND)
    return F.when(F.size(top) > 0, top).otherwise(F.array(F.lit(fixed.NOT_SPECIFIED)))


def condition_pool(title: Column, abstract: Column, keywords: Column) -> Column:
    return F.concat(title, F.lit(" "), abstract, F.lit(" "), F.array_join(keywords, " ; "))


def generated_conditions(c: Column, most: int = fixed.CONDITIONS_GENERATED) -> Column:
    """A generated list of conditions as an array: distinct, at most `most`; else the sentinel."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), r"[,;]| and "), lambda p: strip_chars(p, " .;"))
    top = first_distinct(F.filter(parts, lambda p: p != ""), most)
    return F.when(F.size(top) > 0, top).otherwise(F.array(F.lit(fixed.NOT_SPECIFIED)))


#: What a literal of Python begins with, where that is a letter: a prefix of a text, or one of the names that are literals.
_LITERAL = re.compile(r"""[A-Za-z]{1,2}['"]|(?:None|True|False|set)\b""")


def _parsed(cell: str | None) -> list[str]:
    s = "" if cell is None else cell.strip()
    if not s:
        return []
    if s[0].isalpha() and not _LITERAL.match(s):
        return [s]
    # Most lists hold plain texts in single quotes, which need no parser.
    if s.startswith("['") and s.endswith("']") and len(s) > 3 and "\\" not in s and s.isprintable():
        parts = s[2:-2].split("', '")
        if s.count("'") == 2 * len(parts):
            return [x for x in map(str.strip, parts) if x]
    try:
        found = ast.literal_eval(s)
    except (ValueError, SyntaxError, MemoryError, RecursionError):
        return [s]
    return [str(x).strip() for x in found if str(x).strip()] if isinstance(found, (list, tuple)) else [s]


#: A cell that holds a Python list of texts as an array; other texts as its only entry (Arrow UDF).
parse_cell = row_udf(_parsed, T.ArrayType(T.StringType()))


#: Characters that Python shows by their number.
_HIDDEN = r"[\p{C}\p{Zl}\p{Zp}\p{Zs}&&[^ ]]"


def _shown(c: Column) -> Column:
    """A text as Python writes it: in single quotes, or in double ones where only single ones occur in it."""
    def number(x: Column) -> Column:
        code = F.ascii(x)  # of the whole character
        padded = lambda mark, n: F.concat(F.lit(mark), F.lpad(F.lower(F.hex(code)), n, "0"))
        return F.when(code < 0x100, padded("\\x", 2)).when(code < 0x10000, padded("\\u", 4)).otherwise(padded("\\U", 8))
    plain = c
    for letter, written in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        plain = F.replace(plain, F.lit(letter), F.lit(written))
    rare = F.array_join(F.transform(F.split(plain, ""), lambda x: F.when(x.rlike(_HIDDEN), number(x)).otherwise(x)), "")

    def quoted(text: Column) -> Column:
        only_single = F.contains(text, F.lit("'")) & ~F.contains(text, F.lit('"'))
        return F.when(only_single, F.concat(F.lit('"'), text, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("\\'")), F.lit("'")))
    return let(F.when(plain.rlike(_HIDDEN), rare).otherwise(plain), quoted)


#: What makes a list of texts more than these in quotes: white space (at ends it is left out), quotes and what is shown otherwise.
_SPECIAL = r"(?U)[\s'\\\\\p{C}\p{Z}]"


def to_cell(lists: Column | str) -> Column:
    """An array of texts as a cell that holds a Python list: stripped, without blank ones; the sentinel if none is left."""
    lists = F.col(lists) if isinstance(lists, str) else lists

    # No lambda uses the variable of one around it: Spark couldn't run a Python UDF on such a cell.
    def cell(found: Column) -> Column:
        given = found["given"]
        clean = F.filter(F.transform(given, strip), lambda x: x != "")
        full = let(clean, lambda a: F.when(F.size(a) > 0, a).otherwise(F.array(F.lit(fixed.NOT_SPECIFIED))))
        shown = F.concat(F.lit("["), F.array_join(F.transform(full, _shown), ", "), F.lit("]"))
        # Texts without anything of that kind are joined as they are.
        plain = F.concat(F.lit("['"), F.array_join(F.filter(given, lambda x: x != ""), "', '"), F.lit("']"))
        return F.when((found["all"] == "") | found["all"].rlike(_SPECIAL), shown).otherwise(plain)
    found = let(F.coalesce(lists, F.array().cast("array<string>")), lambda given: F.struct(given.alias("given"), F.array_join(given, "").alias("all")))
    return let(found, cell)
