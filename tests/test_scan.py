"""One pass for many patterns, list cells and criteria of long texts against plain versions."""
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from docloom import fixed
from docloom.functions import conditions, criteria, rules, scan, text

MEDICAL = [p for p, _ in fixed.INTERVENTIONAL + fixed.OBSERVATIONAL] + [
    fixed.PEDIATRIC, fixed.DISEASE_WORDS, fixed.INCLUSION_CUES, fixed.EXCLUSION_CUES, fixed.AGE_LEAST, fixed.AGE_RANGE, fixed.DISEASE_SUFFIX,
    *[text.word_pattern(w) for w in (fixed.FEMALE_CONDITIONS, fixed.MALE_CONDITIONS, fixed.FEMALE_ONLY, fixed.MALE_ONLY)]]
#: Matches that overlap themselves, have several ends, begin in several ways, hold no literal, or may be empty.
ODD = ["a+", r"\bx{2,3}y?\b", "(?:ab|abc|b)c?", "[a-c]x", "aba", "ab|aba|b", "a*", r"\w+oma\b", "(?:x|yy)z", "trial|clinical trial", r"(?<=the )study", "[^a]rct", "Phase"]
WORDS = ("randomized randomised randomly assigned double-blind double blind placebo clinical trial RCT rct phase II phase iv 3 retrospectively case-control case report medical record "
         "records nationwide Type Cell Lung cancer Non-Small carcinoma arthritis oma éoma Big Bad Disease's disease. 5osis tumour tumor, childrens children pediatric paediatric infant "
         "women men male patients ab abc abcc ababa aaa xx xxxy xxz yyz ſtroke KINASE strokes, İinfant ıinfant aged at least 18 years to 20 yrs pregnan pregnant endometri; enrolled "
         "without were not the study").split(" ")


def random_text(rng):
    return "".join(rng.choice(WORDS) + rng.choice([" ", " ", " ", "\n", ", ", "-", "", " - ", "é", "5", " "]) for _ in range(rng.randint(0, 40)))


def test_matches_are_those_of_each_pattern_alone():
    patterns = MEDICAL + ODD
    exact = (fixed.DISEASE_SUFFIX, "Phase")
    s = scan.Scanner(tuple(patterns), exact)
    assert not set(MEDICAL) & {patterns[i] for i in s.whole} - {fixed.AGE_LEAST} and patterns.index(fixed.DISEASE_SUFFIX) in s.outside
    rng = random.Random(1)
    for _ in range(1500):
        t = random_text(rng)
        want = [[m.span() for m in re.finditer(p, t, 0 if p in exact else re.I) if m[0]] for p in patterns]
        assert [[m.span() for m in x] for x in s.matches(t)] == want, t


def test_random_patterns():
    """Alternations, options and repeats of few letters, in texts of the same letters."""
    rng = random.Random(5)

    def pattern(depth=3):
        if depth == 0:
            return rng.choice(["a", "b", "ab", "bc", "[ab]", "c", r"\b", " "])
        return rng.choice([lambda: pattern(depth - 1) + pattern(depth - 1), lambda: f"(?:{pattern(depth - 1)}|{pattern(depth - 1)})", lambda: f"(?:{pattern(depth - 1)})?",
                           lambda: f"(?:{pattern(depth - 1)}){{1,2}}", lambda: f"({pattern(depth - 1)})+?", lambda: pattern(0) + pattern(depth - 1)])()
    for _ in range(400):
        patterns = [pattern() for _ in range(4)]
        s = scan.Scanner(tuple(patterns))
        for _ in range(10):
            t = "".join(rng.choice("aabbcABC  é") for _ in range(rng.randint(0, 25)))
            assert [[m.span() for m in x] for x in s.matches(t)] == [[m.span() for m in re.finditer(p, t, re.I) if m[0]] for p in patterns], (patterns, t)


def test_columns(spark):
    rows = [(random_text(random.Random(i)),) for i in range(60)] + [("",), (None,), ("x" * 100_000,)]
    df = spark.createDataFrame(rows, "t string")
    got = df.select("t", scan.pattern_counts(F.col("t"), MEDICAL).alias("n"), scan.pattern_matches(F.col("t"), [fixed.DISEASE_WORDS, fixed.DISEASE_SUFFIX], [fixed.DISEASE_SUFFIX]).alias("m"),
                    rules.lexicon_score(F.col("t"), fixed.INTERVENTIONAL).alias("score")).collect()
    for r in got:
        if r.t is None:
            assert r.n is r.m is r.score is None
            continue
        count = lambda p: len(re.findall(p, r.t, re.I))
        assert r.n == [count(p) for p in MEDICAL] and r.score == sum(w * count(p) for p, w in fixed.INTERVENTIONAL)
        assert r.m == [m[0] for p, f in ((fixed.DISEASE_WORDS, re.I), (fixed.DISEASE_SUFFIX, 0)) for m in re.finditer(p, r.t, f)]
    with pytest.raises(re.error):
        scan.pattern_counts(F.col("t"), ["("])


def test_fields_share_one_pass(spark):
    """Study type and sex are read from one UDF's result."""
    c = rules.RuleCounts(F.col("t"), fixed.INTERVENTIONAL, fixed.OBSERVATIONAL, fixed.FEMALE_CONDITIONS, fixed.MALE_CONDITIONS, fixed.FEMALE_ONLY, fixed.MALE_ONLY)
    df = spark.createDataFrame([("randomized women with ovarian cancer",), ("retrospective registry of men, men and men",)], "t string").select(c.study_type().alias("a"), c.sex().alias("b"))
    assert [tuple(r) for r in df.collect()] == [("INTERVENTIONAL", "FEMALE"), ("OBSERVATIONAL", "MALE")]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert len(set(re.findall(r"ArrowEvalPython \[(.*?)\], \[", plan))) == 1 and plan.count("counts(t#") == 1


def test_cells_are_written_as_python_does(spark):
    rng = random.Random(3)
    letters = ["a", "B", "'", '"', "\\", "\n", "\t", "\r", " ", " ", "é", "😀", "​", "\x07", "\x7f", "\x85", " ", "", "ß", "\U000e0001", "–"]
    rows = [(["".join(rng.choice(letters) for _ in range(rng.randint(0, 8))) for _ in range(rng.randint(0, 4))],) for _ in range(400)] + [([],), (None,), (["it's", 'a "b"', "both ' and \""],), ([None, "x"],)]
    got = spark.createDataFrame(rows, "a array<string>").select("a", conditions.to_cell("a").alias("c")).collect()
    strip = lambda x: x.strip().strip("\x1c\x1d\x1e\x1f")
    for r in got:
        assert r.c == repr([strip(x) for x in r.a or [] if x and strip(x)] or [fixed.NOT_SPECIFIED])
    back = spark.createDataFrame([(r.c,) for r in got], "c string").select("c", conditions.parse_cell("c").alias("b")).collect()
    assert [r.b for r in back] == [eval(r.c) for r in got]


def plain_sides(parts):
    mode, out = "inc", {"inc": [], "exc": []}
    for s in parts:
        s = re.sub(fixed.BULLET, "", s).strip()
        for side in ("inc", "exc"):
            if s.lower().startswith(f"{side}lusion crit"):
                mode, s = side, re.sub(rf"^{side}lusion criteria[:\s]*", "", s, flags=re.I).strip()
        if s:
            out[mode].append(s)
    return out["inc"], out["exc"]


def test_sides_by_markers(spark):
    rng = random.Random(8)
    parts = ["Inclusion criteria: a", "exclusion Criteria", "Exclusion crit. x", "- Inclusion criteria:\n", "b", "* c", "", " ", "no inclusion criteria", "1) d"]
    rows = [([rng.choice(parts) for _ in range(rng.randint(0, 12))],) for _ in range(300)]
    for r in spark.createDataFrame(rows, "a array<string>").select("a", criteria.split_by_marker(F.col("a")).alias("s")).collect():
        assert (r.s.inc, r.s.exc) == plain_sides(r.a)


def test_long_sections_take_time_in_proportion(spark):
    """4,000 sentences take at most 5 times (with room for a busy machine, 8 times) what 1,000 take."""
    def seconds(n):
        whole = " ".join(f"{'Exclusion criteria: ' if i % 50 == 7 else ''}Sentence {i} says that the patient was enrolled." for i in range(n))
        df = spark.createDataFrame([(whole,)] * 8, "t string").select(F.array(F.struct(F.lit("Eligibility").alias("title"), F.col("t").alias("text"))).alias("s"))
        run = lambda: df.select(criteria.explicit_criteria(F.col("s")).alias("c")).write.format("noop").mode("overwrite").save()
        run()
        began = time.perf_counter()
        run()
        return time.perf_counter() - began
    seconds(1000)
    short, long = min(seconds(1000) for _ in range(2)), min(seconds(4000) for _ in range(2))
    assert long < 8 * short
