import re

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from docloom import fixed
from docloom.functions import conditions, criteria, rules, text, views


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "c string").select(column(F.col("c"))).first()[0]


@pytest.mark.parametrize("value, expected", [
    ("Seen by Dr. Ito. Then left; Next day ok", ["Seen by Dr. Ito.", "Then left;", "Next day ok"]),
    ("See e.g. Smith et al. (2010). Fine", ["See e.g. Smith et al. (2010).", "Fine"]),
    (None, []), ("", []), ("  \n ", [])])
def test_sentences(spark, value, expected):
    assert one(spark, text.sentences, value) == expected


@pytest.mark.parametrize("value, expected", [("18.5 kg", "5 kg"), ("(1) foo", "foo"), ("10 mg", "10 mg"), ("• x", "x"), (None, None)])
def test_strip_bullet(spark, value, expected):
    assert one(spark, text.strip_bullet, value) == expected


@pytest.mark.parametrize("value, expected", [("2.1. Methods", "Methods"), ("2.1 Methods", "1 Methods"), ("1 Intro", "1 Intro"), (None, "")])
def test_clean_title(spark, value, expected):
    assert one(spark, views.clean_title, value) == expected


@pytest.mark.parametrize("value, expected", [("123.0", "123"), ("12.9", "12"), ("nan", "nan"), ("A7 ", "A7"), (None, None), (" ", None)])
def test_id_text(spark, value, expected):
    assert one(spark, text.id_text, value) == expected


@pytest.mark.parametrize("value, expected", [
    ("randomized and retrospective", "INTERVENTIONAL"), ("retrospective registry", "OBSERVATIONAL"), ("", "INTERVENTIONAL")])
def test_study_type(spark, value, expected):
    assert one(spark, rules.study_type, value) == expected


@pytest.mark.parametrize("value, expected", [
    ("ovarian cancer", "FEMALE"), ("prostate cancer", "MALE"), ("ovarian and prostate", "ALL"), ("women women women", "FEMALE"),
    ("women women", "ALL"), ("pregnant only", "ALL")])
def test_sex(spark, value, expected):
    assert one(spark, rules.sex, value) == expected


def test_ages(spark):
    assert one(spark, rules.minimum_age, "children") is None
    assert one(spark, rules.minimum_age, "neonatal") == "18 Years"
    assert one(spark, lambda c: rules.age_numbers(c, fixed.AGE_LEAST), "at least 18 years, over 65 years, over 121 years, over 0 years") == [18, 65]
    assert one(spark, lambda c: rules.age_numbers(c, fixed.AGE_SPAN, 2), "5-12 years, 20 – 300 yrs") == [12]
    assert one(spark, lambda c: rules.age_numbers(c, fixed.AGE_OR_OLDER), "18 years or older; 60 yrs and above") == [18, 60]
    assert one(spark, rules.adults, "Adults") is True and one(spark, rules.adults, "adulthood") is False
    assert one(spark, rules.exclusion_cue, "were excluded") is False


def test_conditions(spark):
    assert one(spark, conditions.generated_conditions, "Asthma, asthma and COPD; HIV") == ["Asthma", "COPD"]
    assert one(spark, conditions.generated_conditions, None) == [fixed.NOT_SPECIFIED]
    assert one(spark, conditions.clean_condition, "the severe acute lung cancer 12 x") == "Lung Cancer"
    assert one(spark, conditions.clean_condition, "imaging of cancer") is None
    assert one(spark, conditions.title_case, " HIV infection of x.") == "HIV Infection Of X"
    assert one(spark, conditions.title_case, "ßa") == "Ssa"


@pytest.mark.parametrize("terms, expected", [(["Lung Cancer", "Cancer"], ["Lung Cancer"]), (["x", "X"], []), ([], [])])
def test_drop_contained(spark, terms, expected):
    df = spark.createDataFrame([(terms,)], "t array<string>")
    assert df.select(conditions.drop_contained(F.col("t"))).first()[0] == expected


def test_cells(spark):
    df = spark.createDataFrame([(["a'b"],), ([],), (None,)], "t array<string>")
    assert [r[0] for r in df.select(conditions.to_cell("t")).collect()] == ['["a\'b"]', "['Not Specified']", "['Not Specified']"]
    df = spark.createDataFrame([("['a', ' b ']",), ("x",), (None,), ("[1",)], "t string")
    assert [r[0] for r in df.select(conditions.parse_cell("t")).collect()] == [["a", "b"], ["x"], [], ["[1"]]


def test_format_criteria(spark):
    df = spark.createDataFrame([([], []), (["a"], [])], "i array<string>, e array<string>")
    got = [r[0] for r in df.select(criteria.format_criteria(F.col("i"), F.col("e"))).collect()]
    assert got == ["", "Inclusion Criteria:\n\n* a\n\nExclusion Criteria:\n\n* Not Specified"]


def test_parse_bullets_either_order(spark):
    got = one(spark, criteria.parse_bullets, "Exclusion Criteria:\n* under treatment\n\nInclusion Criteria:\n* adults all")
    assert (got.inclusion, got.exclusion) == (["adults all"], ["under treatment"])


def test_explicit_criteria(spark):
    rows = [([("Eligibility", "Adults only. Exclusion criteria: prior stroke. Renal failure.")],), ([("Other", "text")],), ([],)]
    df = spark.createDataFrame(rows, "s array<struct<title: string, text: string>>")
    got = [r[0] for r in df.select(criteria.explicit_criteria(F.col("s"))).collect()]
    assert got == ["Inclusion Criteria:\n\n* Adults only.\n\nExclusion Criteria:\n\n* prior stroke.\n* Renal failure.", None, None]
    twice = spark.createDataFrame([([("Inclusion and exclusion criteria", "Be well.")],)], "s array<struct<title: string, text: string>>")
    assert twice.select(criteria.explicit_source(F.col("s"))).first()[0] == "Be well.\nBe well."


def test_distinct_and_limits(spark):
    df = spark.createDataFrame([(["b", "B", "a", "A", "c"],)], "t array<string>")
    assert df.select(text.ordered_distinct(F.col("t")), text.first_distinct(F.col("t"), 2)).first()[:] == (["b", "a", "c"], ["b", "a"])


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.characters(codec="utf-8", exclude_categories=["Cs", "Cc"]), max_size=400), min_size=1, max_size=60))
def test_truncation_is_a_bounded_prefix(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "c string")
    for t, cut in df.select("c", text.truncate_clean(F.col("c"))).collect():
        assert t.startswith(cut) and len(cut) <= 190
        if len(t) <= 60:
            assert cut == t


def test_cue_features(spark):
    got = one(spark, rules.cue_features, "Patients aged 18 were included")
    assert got[:4] == [1.0, 0.0, 1.0, 1.0] and abs(got[4] - 30 / 200) < 1e-6


def test_sentence_split_matches_python(spark):
    short = re.compile(r"\b(?:" + "|".join(a.replace(".", r"\.") for a in fixed.ABBREVIATIONS) + r")\.$", re.I)
    cases = ["A b. C d! E; (F) g? 1 h.", "Mr. X met Dr. Y. They left.", "no. 5 is al. Z", "x.  Y\n\nZ. q"]
    for c in cases:
        pieces, out = re.split(r"(?<=[.!?;])\s+(?=[A-Z0-9(])", re.sub(r"\s+", " ", c).strip()), []
        for p in pieces:
            if out and short.search(out[-1]):
                out[-1] += " " + p
            else:
                out.append(p)
        assert one(spark, text.sentences, c) == out
