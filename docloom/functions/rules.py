"""Weighted lexicons and rule classifiers as expressions.  Lexicons are parameters."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from .. import fixed
from .scan import pattern_counts
from .text import any_case, word_pattern

Lexicon = list[tuple[str, int]]


def _score(counts: Column, lexicon: Lexicon, first: int = 0) -> Column:
    """Weights times counts; the lexicon's patterns are counted from place `first` on."""
    parts = [F.get(counts, F.lit(first + i)) * w for i, (_, w) in enumerate(lexicon)]
    return reduce(lambda a, b: a + b, parts).cast("bigint")


def lexicon_score(c: Column, lexicon: Lexicon) -> Column:
    """Sum of weight times number of matches.

    Each pattern is counted for itself: matches of different patterns may overlap, which one alternation would hide.
    """
    return _score(pattern_counts(c, [p for p, _ in lexicon]), lexicon)


class RuleCounts:
    """Counts of all patterns that tell study type and sex, found in one pass over a text."""

    def __init__(self, c: Column, interventional: Lexicon, observational: Lexicon, *sexes: list[str]):
        self.lexicons = interventional, observational
        self.counts = pattern_counts(c, [p for p, _ in interventional + observational] + [word_pattern(w) for w in sexes])

    def study_type(self) -> Column:
        first, second = self.lexicons
        return F.when(_score(self.counts, first) >= _score(self.counts, second, len(first)), "INTERVENTIONAL").otherwise("OBSERVATIONAL")

    def sex(self) -> Column:
        """A condition of one sex decides; else LOPSIDED mentions of one and none of the other."""
        f, m, nf, nm = (F.get(self.counts, F.lit(sum(map(len, self.lexicons)) + i)) for i in range(4))
        return (F.when((f > 0) & (m == 0), "FEMALE").when((m > 0) & (f == 0), "MALE")
                .when((nf >= fixed.LOPSIDED) & (nm == 0), "FEMALE").when((nm >= fixed.LOPSIDED) & (nf == 0), "MALE").otherwise("ALL"))


def study_type(c: Column, interventional: Lexicon = fixed.INTERVENTIONAL, observational: Lexicon = fixed.OBSERVATIONAL) -> Column:
    return RuleCounts(c, interventional, observational).study_type()


def sex(c: Column, female: list[str] = fixed.FEMALE_CONDITIONS, male: list[str] = fixed.MALE_CONDITIONS,
        only_female: list[str] = fixed.FEMALE_ONLY, only_male: list[str] = fixed.MALE_ONLY) -> Column:
    return RuleCounts(c, [], [], female, male, only_female, only_male).sex()


def minimum_age(c: Column, pediatric: str = fixed.PEDIATRIC) -> Column:
    """Null where the text is about children."""
    return F.when(F.get(pattern_counts(c, [pediatric]), F.lit(0)) == 0, fixed.ADULT_AGE)


def age_numbers(c: Column, pattern: str, group: int = 1) -> Column:
    """All ages of a pattern's group, as an array of int, for fixed.AGE_* patterns; numbers that are no age are left out."""
    found = F.transform(F.regexp_extract_all(c, F.lit(any_case(pattern)), F.lit(group)), lambda x: x.cast("int"))
    return F.filter(found, lambda n: (n > 0) & (n <= fixed.OLDEST))


def adults(c: Column) -> Column:
    return c.rlike(any_case(fixed.ADULT))


def inclusion_cue(c: Column, cues: str = fixed.INCLUSION_CUES) -> Column:
    return c.rlike(any_case(cues))


def exclusion_cue(c: Column, cues: str = fixed.EXCLUSION_CUES) -> Column:
    return c.rlike(any_case(cues))


def cue_features(c: Column, inclusion: str = fixed.INCLUSION_CUES, exclusion: str = fixed.EXCLUSION_CUES) -> Column:
    """[inclusion cue, exclusion cue, age hint, people hint, length / 200 up to 2] as floats."""
    low = F.lower(c)
    hint = lambda words: reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words])
    flags = [inclusion_cue(c, inclusion), exclusion_cue(c, exclusion), hint(fixed.AGE_HINTS), hint(fixed.PEOPLE_HINTS)]
    return F.array(*[x.cast("float") for x in flags], F.least(F.length(c) / 200.0, F.lit(2.0)).cast("float"))


def fit_length(c: Column) -> Column:
    return F.length(c).between(fixed.SENTENCE_LEAST, fixed.SENTENCE_MOST)
