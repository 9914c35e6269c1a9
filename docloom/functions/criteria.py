"""Eligibility criteria: sections to bullet lists, as expressions over arrays."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import fixed
from .rules import exclusion_cue, fit_length, inclusion_cue
from .text import any_case, first_distinct, let, sentences, squeeze, strip, strip_bullet
from .views import methods_text, section_by

_HEADING = any_case(r"^(?:inclusion|exclusion) criteria[:\s]*")


def format_criteria(inclusion: Column, exclusion: Column) -> Column:
    """Both lists under their headings; "" if both are empty."""
    def tidy(a: Column) -> Column:
        return F.filter(F.transform(a, squeeze), lambda x: x != "")

    def bullets(a: Column) -> Column:
        return F.when(F.size(a) > 0, F.array_join(F.transform(a, lambda x: F.concat(F.lit("* "), x)), "\n")).otherwise("* " + fixed.NOT_SPECIFIED)

    def text(both: Column) -> Column:
        inc, exc = both["inc"], both["exc"]
        whole = F.concat(F.lit("Inclusion Criteria:\n\n"), bullets(inc), F.lit("\n\nExclusion Criteria:\n\n"), bullets(exc))
        return F.when((F.size(inc) == 0) & (F.size(exc) == 0), "").otherwise(whole)
    return let(F.struct(tidy(inclusion).alias("inc"), tidy(exclusion).alias("exc")), text)


def parse_bullets(c: Column) -> Column:
    """struct(inclusion, exclusion) of the bullets in a criteria text, whichever heading comes first."""
    def bullets(chunk: Column) -> Column:
        raw = F.transform(F.split(chunk, r"\n+|(?<=\.)(?U:\s)*\*"), lambda x: strip(F.regexp_replace(strip(strip_bullet(x)), _HEADING, "")))
        return F.transform(F.filter(raw, lambda x: F.length(x) >= 5), squeeze)

    def sides(found: Column) -> Column:
        text, inc, exc = found["text"], found["inc"], found["exc"]

        def upto(begin: Column, end: Column) -> Column:
            return F.substring(text, begin, F.greatest(end - begin, F.lit(0)))
        stop = F.length(text) + 1
        none = F.lit("")
        inc_text = (F.when((inc == 0) & (exc == 0), text).when(inc == 0, none).when((exc == 0) | (inc >= exc), upto(inc, stop)).otherwise(upto(inc, exc)))
        exc_text = (F.when(exc == 0, none).when((inc == 0) | (inc < exc), upto(exc, stop)).otherwise(upto(exc, inc)))
        return F.struct(bullets(inc_text).alias("inclusion"), bullets(exc_text).alias("exclusion"))

    def places(text: Column) -> Column:
        find = lambda what: let(F.lower(text), lambda low: F.struct(*[F.locate(w, low).alias(n) for n, w in what.items()]))
        return let(find({"inc": "inclusion crit", "exc": "exclusion crit"}), lambda at: F.struct(text.alias("text"), at["inc"].alias("inc"), at["exc"].alias("exc")))
    # The text is made, and its headings are looked for, once: lambdas would do so at every mention.
    return let(let(F.regexp_replace(F.coalesce(c, F.lit("")), "\r", "\n"), places), sides)


def split_by_marker(parts: Column) -> Column:
    """struct(inc, exc) of sentences: each goes to the side of the last marker at a sentence's start.

    Markers cut the sentences into runs, each of which is taken as a whole: work grows with their number.
    """
    def told(s: Column) -> Column:
        inc, exc = (s.rlike(any_case(rf"\A{x}clusion crit")) for x in ("in", "ex"))
        own = F.when(inc | exc, strip(F.regexp_replace(s, any_case(r"^(?:in|ex)clusion criteria[:\s]*"), ""))).otherwise(s)
        return F.struct(F.when(inc, "inc").when(exc, "exc").alias("mark"), own.alias("own"))

    def sides(items: Column) -> Column:
        marks = F.filter(F.transform(items, lambda x, i: F.struct(x["mark"].alias("mode"), i.alias("at"))), lambda m: m["mode"].isNotNull())
        first = F.array(F.struct(F.lit("inc").alias("mode"), F.lit(0).alias("at")))

        def run(all_runs: Column, of: Column, i: Column) -> Column:
            end = F.coalesce(F.get(all_runs, i + 1)["at"], F.size(items))
            return F.struct(of["mode"].alias("mode"), F.slice(items, of["at"] + 1, end - of["at"]).alias("items"))
        runs = let(F.concat(first, marks), lambda m: F.transform(m, lambda of, i: run(m, of, i)))

        def side(found: Column, mode: str) -> Column:
            own = F.flatten(F.transform(F.filter(found, lambda r: r["mode"] == mode), lambda r: F.transform(r["items"], lambda x: x["own"])))
            return F.filter(own, lambda x: x != "").alias(mode)
        return let(runs, lambda found: F.struct(side(found, "inc"), side(found, "exc")))
    return let(F.transform(parts, lambda s: let(strip(strip_bullet(s)), told)), sides)


def explicit_source(sections: Column) -> Column:
    """The text that states criteria: matching sections in order of purpose, else the first that mentions them; null if none."""
    named = F.filter(F.array(*[section_by(sections, p) for p in fixed.CRITERIA_TITLES]), lambda x: x != "")
    mention = F.filter(F.transform(sections, lambda s: s["text"]), lambda t: t.rlike(any_case("inclusion crit|exclusion crit")))
    return F.when(F.size(named) > 0, F.array_join(named, "\n")).otherwise(F.get(mention, F.lit(0)))


def explicit_criteria(sections: Column) -> Column:
    def stated(source: Column) -> Column:
        formatted = let(split_by_marker(sentences(source)), lambda sides: format_criteria(sides["inc"], sides["exc"]))
        return F.when(F.coalesce(source, F.lit("")) != "", formatted)
    return let(explicit_source(sections), stated)


def reconstructed_criteria(sections: Column, title_abstract: Column, inclusion: str = fixed.INCLUSION_CUES, exclusion: str = fixed.EXCLUSION_CUES) -> Column:
    """Criteria from sentences with cues, in the methods or else in title and abstract."""
    def sides(parts: Column) -> Column:
        first = lambda side: F.slice(F.transform(F.filter(parts, lambda p: p["side"] == side), lambda p: p["text"]), 1, fixed.CRITERIA_EACH)
        return format_criteria(first("inc"), first("exc"))
    source = let(methods_text(sections), lambda methods: F.when(methods != "", methods).otherwise(title_abstract))
    cued = F.transform(F.filter(sentences(source), fit_length), lambda s: F.struct(
        F.when(inclusion_cue(s, inclusion), "inc").when(exclusion_cue(s, exclusion), "exc").alias("side"), s.alias("text")))
    return let(cued, sides)


def candidate_sentences(sections: Column, abstract: Column, most: int = fixed.CANDIDATES) -> Column:
    """Sentences that may tell who was selected: criteria sections, methods, abstract; distinct, the first `most`."""
    sources = [section_by(sections, fixed.CANDIDATE_TITLES), methods_text(sections), abstract]
    # A text that is several of the sources is split once; its sentences would be repetitions.
    parts = F.flatten(F.transform(F.array_distinct(F.array(*sources)), sentences))
    clean = F.filter(F.transform(parts, strip_bullet), fit_length)  # neither sentences nor what follows a bullet begin or end with white space
    return first_distinct(clean, most)


def eligibility(sections: Column, title_abstract: Column, inclusion: str = fixed.INCLUSION_CUES, exclusion: str = fixed.EXCLUSION_CUES) -> Column:
    """Stated criteria, else reconstructed ones, else the sentinel."""
    found = [explicit_criteria(sections), reconstructed_criteria(sections, title_abstract, inclusion, exclusion)]
    return F.coalesce(*[let(x, lambda v: F.when(v != "", v)) for x in found], F.lit(fixed.NOT_SPECIFIED))
