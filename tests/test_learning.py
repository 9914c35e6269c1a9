"""Counting inside rows, folds by subtraction, texts encoded once."""
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.operators import ml, ranking, vectors
from docloom.plans import training


def rows_of(n=120, seed=2):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["été", "a", "The", "x_1"]
    rows = []
    for i in range(n):
        label = "ab"[i % 2] if i % 11 else None
        own = ["alpha", "beta"][i % 2]
        text = " ".join(rng.choice([own, *rng.choices(words, k=4)]) for _ in range(rng.randint(0, 40)))
        rows.append((i, text if i % 13 else None, label))
    return rows + [(500, "alpha alpha alpha", "a"), (501, "alpha alpha alpha", "a"), (502, "", "b"), (503, "only once here", "c")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows_of(), "doc_id long, text string, label string").repartition(3).cache()


def plain_terms(text, stop, ngrams=2):
    import regex
    words = [w for w in regex.findall(r"[\p{L}\p{N}\p{M}_]{2,}", (text or "").lower()) if w not in stop]
    return Counter(words + [" ".join(words[i:i + n]) for n in range(2, ngrams + 1) for i in range(len(words) - n + 1)])


def test_terms_are_counted_inside_rows(spark):
    rng = random.Random(1)
    rows = [([rng.choice("abcdé") for _ in range(rng.randint(0, 30))],) for _ in range(200)] + [([],), (["x"] * 5000,)]
    for r in spark.createDataFrame(rows, "a array<string>").select("a", ml.term_runs(F.col("a")).alias("r")).collect():
        assert dict(zip(r.r.terms, r.r.tfs)) == Counter(r.a) and r.r.terms == sorted(set(r.a), key=str.encode)


@pytest.mark.parametrize("features", [30000, 25])
def test_weights_by_definition(spark, docs, features):
    stop = ["the", "w1"]
    model = ml.TfIdf.fit(docs, "text", features=features, stop_words=stop)
    rows = docs.collect()
    terms = [plain_terms(r.text, stop) for r in rows]
    df, total = Counter(t for c in terms for t in c), sum(terms, Counter())
    top = sorted((t for t in df if df[t] >= 2), key=lambda t: (-total[t], t))[:features]
    idf = {t: math.log((1 + len(rows)) / (1 + df[t])) + 1 for t in top}
    want = {}
    for r, c in zip(rows, terms):
        w = {t: (1 + math.log(n)) * idf[t] for t, n in c.items() if t in idf}
        norm = math.sqrt(sum(x * x for x in w.values()))
        want |= {(r.doc_id, t): x / norm for t, x in w.items()}
    got = {(r.doc_id, r.term): r.weight for r in model.weights(docs.select("doc_id", "text"), "text").collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)
    index = {r.term: r["index"] for r in model.vocabulary.collect()}
    for r in model.transform(docs, "text").collect():
        assert r.features.size == features and dict(zip(r.features.indices.tolist(), r.features.values)) == pytest.approx(
            {index[t]: x for (d, t), x in want.items() if d == r.doc_id})


def test_nothing_but_counts_is_shuffled(spark, docs):
    """Weighting has no exchange, and counting exchanges combined counts alone."""
    model = ml.TfIdf.fit(docs, "text", stop_words=[])
    plan = model.transform(docs.select("doc_id", "text"), "text")._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Join" not in plan


def test_folds_by_subtraction_equal_separate_fits(spark, docs):
    dealt = ranking.stratified_folds(docs, "label", F.col("doc_id"), 3)
    folds = ml.Folds(dealt, "text", "label", 3, stop_words=[], max_iter=15)
    told = folds.predictions("told", (True, False))
    for k in range(3):
        rest = dealt.where(F.col("fold") != k)
        alone = ml.TfIdf.fit(rest.where("label is not null"), "text", stop_words=[])
        assert sorted(map(tuple, folds.tfidf(k).vocabulary.collect())) == sorted(map(tuple, alone.vocabulary.collect()))
        own = dealt.where(F.col("fold") == k)
        for i, balanced in enumerate((True, False)):
            want = ml.fit_classifier(rest, "text", "label", balanced=balanced, max_iter=15, stop_words=[]).predict(own, "text", "told")
            assert sorted(told[k][i].select("doc_id", "told").collect()) == sorted(want.select("doc_id", "told").collect())
        assert told[k][0].columns == [*[c for c in dealt.columns if c != "text"], "told"] and told[k][0].count() == own.count()


def test_scores(spark, docs):
    score = ml.cross_validated_accuracy(docs, "doc_id", "text", "label", 3, stop_words=[], max_iter=15)
    model, balanced, best = ml.best_balance(docs, "doc_id", "text", "label", 3, stop_words=[], max_iter=15)
    assert 0.6 < score <= 1 and best >= score and model.labels == ["a", "b", "c"] and balanced in (True, False)
    none = docs.limit(0)
    assert ml.cross_validated_accuracy(none, "doc_id", "text", "label", 3, stop_words=[]) == 0.0


def test_every_text_is_encoded_once(spark, tmp_path):
    """60 candidate sentences and 40 bullets, some of them equal: as many texts as are different go to the encoder."""
    log = tmp_path / "log"

    def make():
        encode = vectors.hashing_encoder(16)

        def run(texts):
            with open(log, "a") as f:
                f.writelines(f"{len(t)}\n" for t in texts)
            return encode(texts)
        return run
    method = " ".join(f"Patient number {i} was enrolled in group {i % 7}." for i in range(60))
    schema = "pmcid string, pmid string, title string, abstract string, keywords array<string>, sections array<struct<title: string, text: string>>"
    a = spark.createDataFrame([("1", "", "T", "", [], [("Methods", method)])], schema)
    bullets = "\n".join(f"* Patient number {i} was enrolled in group {i % 7}." if i < 5 else f"* criterion number {i}" for i in range(20))
    gold = spark.createDataFrame([("1", f"Inclusion Criteria:\n{bullets}\nExclusion Criteria:\n" + "\n".join(f"* never {i} times" for i in range(20)))], "pmcids string, eligibility_criteria string")
    cache = spark.createDataFrame([], "text_sha1 string, embedding array<float>")
    found = training.labelled_sentences(a, gold, cache, make)
    assert found.count() == 60 and Counter(r.label for r in found.collect())["inclusion"] >= 5
    assert len(log.read_text().split()) == 60 + 15 + 20
