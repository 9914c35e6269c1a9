"""Many patterns in one pass over a text (Arrow UDFs).

A regular expression for each pattern reads the text once for each.  Here one keyword automaton holds the literals that
the patterns' matches begin with; where one of them occurs, the pattern itself is tried at that very place.  Results are
those of the patterns alone: non-overlapping matches from left to right, ignoring case, whatever other patterns match
there.  A pattern whose matches don't begin with one of a few literals, but must hold one of a few (a suffix, say), is
searched only in the stretch of characters around such a literal that a match can lie in.  What has neither is searched
in the whole text.
"""
from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from re import _constants as sre, _parser as parser

import ahocorasick
from pyspark.sql import Column, types as T

from .slices import row_udf

#: Literals are worth looking up from so many characters on; a pattern may have so many of them.
_LEAST, _MOST = 2, 200
#: Letters beyond ASCII that equal one of ASCII when case is ignored; each stands for one character, so places stay.
_FOLD = {"İ": "i", "ı": "i", "ſ": "s"}


def folded(text: str) -> str | None:
    """text in lower case, character by character; null where lower case has another length."""
    if not text.isascii():
        for letter, plain in _FOLD.items():
            text = text.replace(letter, plain)
    low = text.lower()
    return low if len(low) == len(text) else None


def heads(items, tail: bool = False) -> set[str] | None:
    """Literals one of which every match of parsed items begins with; null if there is no such short list.

    Each may be cut off, but each is as long as it can be told.
    """
    found = {("", True)}  # literal, and whether the match goes on from its end
    for op, value in items:
        if op is sre.AT:
            continue
        if op is sre.LITERAL:
            step = {(chr(value), True)}
        elif op is sre.IN and all(o is sre.LITERAL for o, _ in value):
            step = {(chr(v), True) for _, v in value}
        elif op is sre.SUBPATTERN:
            step = _ends(value[-1])
        elif op is sre.BRANCH:
            step = set().union(*[_ends(b) for b in value[1]])
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and value[1] == 1:
            step = _ends(value[2]) | ({("", True)} if value[0] == 0 else set())
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and value[0] > 0:
            step = {(w, False) for w, _ in _ends(value[2])}
        else:
            step = {("", False)}
        found = {(a + b, on) if open_ else (a, False) for a, open_ in found for b, on in step}
        if len(found) > _MOST or not any(open_ for _, open_ in found):
            break
    words = {w for w, _ in found}
    return found if tail else (words if len(words) <= _MOST else None)


def _ends(items) -> set[tuple[str, bool]]:
    return heads(items, tail=True)


def needed(items) -> set[str] | None:
    """Literals one of which every match of parsed items holds; null if there is no such short list of long enough ones."""
    best = None
    for op, value in items:
        if op is sre.SUBPATTERN:
            own = needed(value[-1])
        elif op is sre.BRANCH or op is sre.LITERAL or op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and value[0] > 0:
            own = heads([(op, value)])
        else:
            continue
        if own and len(own) <= _MOST and min(map(len, own)) > (min(map(len, best)) if best else _LEAST - 1):
            best = own
    return best


def alphabet(items) -> set[int] | None:
    """ASCII characters that a match of parsed items may hold (128 stands for all others); null if that isn't told."""
    out: set[int] = set()
    for op, value in items:
        if op is sre.AT:
            continue
        if op is sre.LITERAL:
            own = {min(value, 128)}
        elif op is sre.RANGE:
            own = {min(c, 128) for c in range(value[0], min(value[1], 128) + 1)}
        elif op is sre.CATEGORY and value in (sre.CATEGORY_SPACE, sre.CATEGORY_DIGIT):
            kind = str.isspace if value is sre.CATEGORY_SPACE else str.isdigit
            own = {c for c in range(128) if kind(chr(c))} | {128}
        elif op is sre.IN:
            own = alphabet(value)
        elif op is sre.SUBPATTERN:
            own = alphabet(value[-1])
        elif op is sre.BRANCH:
            parts = [alphabet(b) for b in value[1]]
            own = None if None in parts else set().union(*parts)
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            own = alphabet(value[2])
        else:
            own = None
        if own is None:
            return None
        out |= own
    return out


class Scanner:
    """Matches of several patterns.  Those in `exact` heed case, others ignore it."""

    def __init__(self, patterns: tuple[str, ...], exact: tuple[str, ...] = ()):
        self.patterns = [re.compile(p, 0 if p in exact else re.I) for p in patterns]
        self.begin: dict[str, list[int]] = {}
        self.near: dict[str, list[int]] = {}
        self.outside: dict[int, re.Pattern] = {}
        self.whole: list[int] = []
        for i, p in enumerate(patterns):
            items = list(parser.parse(p, 0))
            first, inside, letters = heads(items), needed(items), alphabet(items)
            # Of one length, so that places come from left to right.
            size = min(map(len, first)) if first else 0
            if size >= _LEAST and all(folded(w) for w in first):
                for w in {folded(w)[:size] for w in first}:
                    self.begin.setdefault(w, []).append(i)
            elif inside and letters is not None and all(folded(w) for w in inside):
                if p not in exact:
                    letters |= {ord(chr(c).swapcase()) for c in letters if c < 128} | {128}
                inner = "".join(re.escape(chr(c)) for c in sorted(letters) if c < 128) + ("\\u0080-\\U0010ffff" if 128 in letters else "")
                self.outside[i] = re.compile(f"[^{inner}]")
                for w in inside:
                    self.near.setdefault(folded(w), []).append(i)
            else:
                self.whole.append(i)
        self.automaton = ahocorasick.Automaton()
        for w in self.begin.keys() | self.near.keys():
            self.automaton.add_word(w, (len(w), tuple(self.begin.get(w, ())), tuple(self.near.get(w, ()))))
        if len(self.automaton):
            self.automaton.make_automaton()

    def matches(self, text: str) -> list[list[re.Match]]:
        """The matches of each pattern, in order."""
        low = folded(text)
        if low is None:
            return [list(p.finditer(text)) for p in self.patterns]
        found: list[list[re.Match]] = [[] for _ in self.patterns]
        free = [0] * len(self.patterns)  # where the next match may begin
        hits: dict[int, list[int]] = {}
        for end, (size, begin, near) in self.automaton.iter(low) if len(self.automaton) else ():
            start = end - size + 1
            for i in begin:
                if start >= free[i]:
                    m = self.patterns[i].match(text, start)
                    if m and m.end() > start:
                        found[i].append(m)
                        free[i] = m.end()
            for i in near:
                hits.setdefault(i, []).append(start)
        for i, places in hits.items():
            found[i] = list(self._around(i, text, sorted(places)))
        for i in self.whole:
            found[i] = [m for m in self.patterns[i].finditer(text) if m.end() > m.start()]
        return found

    def _around(self, i: int, text: str, places: list[int]) -> Iterator[re.Match]:
        """Matches in the stretches around some places; what lies outside of a stretch's letters ends it."""
        edges = [-1, *[m.start() for m in self.outside[i].finditer(text)], len(text)]
        k, done = 0, -1
        for place in places:
            while edges[k + 1] <= place:
                k += 1
            if k != done and edges[k] < place:
                # With the character after it, so that the end of a word is seen there.
                yield from (m for m in self.patterns[i].finditer(text, edges[k] + 1, min(edges[k + 1] + 1, len(text))) if m.end() > m.start())
                done = k


@lru_cache(maxsize=64)
def scanner(patterns: tuple[str, ...], exact: tuple[str, ...] = ()) -> Scanner:
    """One for each worker and list of patterns."""
    return Scanner(patterns, exact)


@lru_cache(maxsize=64)
def _udf(kind: str, patterns: tuple[str, ...], exact: tuple[str, ...]) -> Callable[[Column], Column]:
    def counts(text: str | None) -> list[int] | None:
        return None if text is None else [len(m) for m in scanner(patterns, exact).matches(text)]

    def found(text: str | None) -> list[str] | None:
        return None if text is None else [m[0] for each in scanner(patterns, exact).matches(text) for m in each]
    scanner(patterns, exact)  # a pattern that can't be read is an error here, not in a task
    if kind == "counts":
        return row_udf(counts, T.ArrayType(T.IntegerType()))
    return row_udf(found, T.ArrayType(T.StringType()))


def pattern_counts(c: Column, patterns: list[str]) -> Column:
    """How many matches each pattern has in a text, as an array; null for a null text."""
    return _udf("counts", tuple(patterns), ())(c)


def pattern_matches(c: Column, patterns: list[str], exact: list[str] = ()) -> Column:
    """The matches of the first pattern, then of the second and so on, as one array; those in `exact` heed case."""
    return _udf("found", tuple(patterns), tuple(exact))(c)
