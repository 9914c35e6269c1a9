"""TF-IDF with logistic regression, and the sentence ranker, on pyspark.ml."""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel, StopWordsRemover
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .. import fixed
from ..functions.rules import cue_features
from ..functions.text import let
from ..sources.scratch import kept
from . import ranking


def word_terms(text: Column, stop_words: list[str], ngrams: int = 2) -> Column:
    """Words of two or more characters but stop words, then their n-grams, as one array."""
    low = F.lower(F.coalesce(text, F.lit("")))
    words = F.regexp_extract_all(low, F.lit(r"(?U)\b\w\w+\b"), F.lit(0))
    words = F.filter(words, lambda w: ~w.isin(stop_words)) if stop_words else words

    def grams(w: Column, n: int) -> Column:
        places = F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.concat_ws(" ", *[F.get(w, i + (k - 1)) for k in range(n)]))
    return let(words, lambda w: F.concat(w, *[grams(w, n) for n in range(2, ngrams + 1)]))


def term_runs(terms: Column) -> Column:
    """struct(terms, tfs): the different terms of an array in order, and how often each occurs; runs of the sorted array."""
    none = F.array().cast("array<int>")

    def runs(s: Column) -> Column:
        places = F.when(F.size(s) > 0, F.sequence(F.lit(0), F.size(s) - 1)).otherwise(none)
        begin = F.filter(places, lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return let(begin, lambda b: F.struct(F.transform(b, lambda i: F.get(s, i)).alias("terms"),
                                             F.transform(b, lambda i, k: F.coalesce(F.get(b, k + 1), F.size(s)) - i).alias("tfs")))
    return let(F.sort_array(terms), runs)


#: Rows that are weighed at once.
_WEIGHED = 256


@dataclass
class TfIdf:
    """A vocabulary (term, index, df, idf) of at most `features` terms, largest counts first.

    A row's terms are counted inside the row, and rows are weighted where they are: texts and occurrences are never
    shuffled, only the terms' counts, combined by each task before.
    """
    vocabulary: DataFrame
    size: int
    stop_words: list[str]
    ngrams: int = 2

    @classmethod
    def fit(cls, docs: DataFrame, text: str, features: int = 30000, min_df: int = 2, ngrams: int = 2, stop_words: list[str] | None = None) -> "TfIdf":
        stop = StopWordsRemover.loadDefaultStopWords("english") if stop_words is None else stop_words
        runs = docs.select(term_runs(word_terms(F.col(text), stop, ngrams)).alias("r"))
        pairs = runs.select(F.explode(F.arrays_zip("r.terms", "r.tfs")).alias("p"))
        terms = pairs.groupBy(F.col("p.terms").alias("term")).agg(F.count("*").alias("df"), F.sum("p.tfs").alias("total"))
        return cls.of_counts(terms, docs.count(), features, min_df, stop, ngrams)

    @classmethod
    def of_counts(cls, terms: DataFrame, n: int, features: int, min_df: int, stop_words: list[str], ngrams: int) -> "TfIdf":
        """Of (term, df, total) in n rows."""
        # At most `features` rows from here on.
        top = terms.where(F.col("df") >= min_df).orderBy(F.desc("total"), "term").limit(features)
        idf = F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1
        index = F.row_number().over(Window.orderBy("term")) - 1
        return cls(kept(top.select("term", index.alias("index"), "df", idf.alias("idf"))), features, stop_words, ngrams)

    def _counted(self, rows: DataFrame, terms: Column) -> tuple[DataFrame, np.ndarray]:
        """rows with `_counts`, struct(indices, values) of known terms in order, and the terms' idf.  Terms never leave the JVM."""
        found = self.vocabulary.select("term", "index", "idf").toArrow().sort_by("index")  # at most `features` rows
        model = CountVectorizerModel.from_vocabulary(found.column("term").to_pylist() or [""], inputCol="_terms", outputCol="_counts")  # no term is ""
        counted = model.transform(rows.withColumn("_terms", terms)).drop("_terms").withColumn("_counts", F.unwrap_udt("_counts"))
        return counted, found.column("idf").to_numpy()

    def _terms(self, text: str) -> Column:
        return word_terms(F.col(text), self.stop_words, self.ngrams)

    def weights(self, docs: DataFrame, text: str) -> DataFrame:
        """The columns of docs with term, index and weight: a row for each known term of each row."""
        counted, idf = self._counted(docs, self._terms(text))

        def weigh(c: Column) -> Column:
            raw = F.transform(c["values"], lambda tf, i: (1 + F.log(tf)) * F.get(F.lit(idf), F.get(c["indices"], i)))
            length = lambda x: F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, w: s + w * w))
            return let(raw, lambda x: let(length(x), lambda n: F.transform(x, lambda w, i: F.struct(F.get(c["indices"], i).alias("index"), (w / n).alias("weight")))))
        pairs = counted.withColumn("_p", F.explode(let(F.col("_counts"), weigh)))
        found = pairs.select(*docs.columns, "_p.index", "_p.weight").join(F.broadcast(self.vocabulary.select("term", "index")), "index")  # `features` rows at most
        return found.select(*docs.columns, "term", "index", "weight")

    def transform(self, docs: DataFrame, text: str) -> DataFrame:
        """docs with `features`; texts without known terms have the zero vector."""
        return self.vectors(docs, self._terms(text))

    def vectors(self, rows: DataFrame, terms: Column) -> DataFrame:
        """rows with `features`, of terms as `word_terms` makes them: (1 + ln tf) * idf of length 1, by index."""
        counted, idf = self._counted(rows, terms)
        shared, size = rows.sparkSession.sparkContext.broadcast(idf), self.size

        def few(indices: pa.Array, counts: pa.Array) -> pa.Array:
            n = len(indices)
            row = np.repeat(np.arange(n), pc.list_value_length(indices).to_numpy(zero_copy_only=False))
            at = indices.flatten()
            weight = (1 + np.log(counts.flatten().to_numpy(zero_copy_only=False))) * shared.value[at.to_numpy(zero_copy_only=False)]
            weight /= np.sqrt(np.bincount(row, weight * weight, n))[row]
            ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]).astype(np.int32))
            return pa.StructArray.from_arrays([pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, size, np.int32)), pa.ListArray.from_arrays(ends, at),
                                               pa.ListArray.from_arrays(ends, pa.array(weight))], ["type", "size", "indices", "values"])

        def run(indices: pa.Array, counts: pa.Array) -> pa.Array:
            # A few rows at once: their weights take some times the room of their counts.
            return pa.concat_arrays([few(indices.slice(i, _WEIGHED), counts.slice(i, _WEIGHED)) for i in range(0, len(indices), _WEIGHED)] or [few(indices, counts)])
        return counted.withColumn("features", F.arrow_udf(run, VectorUDT())("_counts.indices", "_counts.values")).drop("_counts")


def read_if_there(spark: SparkSession, schema: str, path: str):
    """The first row of a JSON table, or null where the path doesn't exist: an absent artifact is no error, rules take over."""
    try:
        return spark.read.schema(schema).json(path).first()
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


@dataclass
class TextClassifier:
    tfidf: TfIdf
    model: LogisticRegressionModel
    labels: list[str]

    def predict(self, docs: DataFrame, text: str, output: str) -> DataFrame:
        """docs with the predicted label."""
        found = self.model.transform(self.tfidf.transform(docs, text))
        names = F.array(*[F.lit(x) for x in self.labels])
        return found.withColumn(output, F.element_at(names, F.col("prediction").cast("int") + 1)).drop(
            "features", "rawPrediction", "probability", "prediction")

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(f"{path}/model")
        self.tfidf.vocabulary.write.mode("overwrite").parquet(f"{path}/vocabulary")
        spark = self.tfidf.vocabulary.sparkSession
        spark.createDataFrame([(self.labels, self.tfidf.size, self.tfidf.stop_words, self.tfidf.ngrams)],
                              "labels array<string>, size int, stop_words array<string>, ngrams int").write.mode("overwrite").json(f"{path}/meta")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "TextClassifier | None":
        """The saved classifier; null where there is none."""
        meta = read_if_there(spark, "labels array<string>, size int, stop_words array<string>, ngrams int", f"{path}/meta")
        if meta is None:
            return None
        tfidf = TfIdf(spark.read.parquet(f"{path}/vocabulary"), meta["size"], meta["stop_words"], meta["ngrams"])
        return TextClassifier(tfidf, LogisticRegressionModel.load(f"{path}/model"), meta["labels"])


#: Rows that one task of a fit's step takes at least.
_ROWS = 2048


def _regression(rows: DataFrame, c: float, balanced: bool, max_iter: int) -> LogisticRegressionModel:
    """The minimum of |w|^2 / 2 + C * weighted losses, as mean loss plus a penalty of 1 / (C * sum of weights)."""
    weight = F.lit(1.0)
    if balanced:
        weights = ranking.class_weights(rows, "label_index").withColumnRenamed("label", "label_index")
        rows = rows.join(F.broadcast(weights), "label_index")  # one row a class
        weight = F.col("weight")
    rows = rows.withColumn("_w", weight)
    total, n = rows.agg(F.sum("_w"), F.count("*")).first()
    # Every step of the fit is a job over all partitions; few rows need few of them.
    rows = rows.coalesce(1 + n // _ROWS)
    return LogisticRegression(featuresCol="features", labelCol="label_index", weightCol="_w", maxIter=max_iter, regParam=1 / (c * total),
                              standardization=False).fit(rows)


def _indexed(rows: DataFrame, label: str) -> tuple[DataFrame, list[str]]:
    labels = sorted(r[0] for r in rows.select(label).where(F.col(label).isNotNull()).distinct().collect())  # one row a class
    names = F.array(*[F.lit(x) for x in labels])
    return rows.where(F.col(label).isNotNull()).withColumn("label_index", (F.array_position(names, F.col(label)) - 1).cast("double")), labels


def class_names(rows: DataFrame, label: str) -> DataFrame:
    """(label, label_index): the number that stands for each class, in the order of names."""
    indexed, _ = _indexed(rows, label)
    return indexed.select(label, "label_index").distinct()


def fit_classifier(docs: DataFrame, text: str, label: str, c: float = 4.0, balanced: bool = True, max_iter: int = 100,
                   **tfidf_options) -> TextClassifier:
    rows, labels = _indexed(docs, label)
    tfidf = TfIdf.fit(rows, text, **tfidf_options)
    vectors = tfidf.transform(rows, text).select("label_index", "features").persist()
    model = _regression(vectors, c, balanced, max_iter)
    vectors.unpersist()
    return TextClassifier(tfidf, model, labels)


class Folds:
    """Cross-validation of text classifiers over dealt rows (with `fold`): one scan of the texts for all folds.

    Terms are counted inside each row, once; a table holds each term's counts over all rows and over each fold's, and the
    vocabulary that goes without a fold is made of their differences.  Rows without a label are predicted only.
    """

    def __init__(self, dealt: DataFrame, text: str, label: str, folds: int = 5, features: int = 30000, min_df: int = 2, ngrams: int = 2,
                 stop_words: list[str] | None = None, c: float = 4.0, max_iter: int = 100, parallelism: int = 2):
        self.parallelism = parallelism  # fits at once, each with its vectors in store
        self.stop = StopWordsRemover.loadDefaultStopWords("english") if stop_words is None else stop_words
        self.label, self.folds, self.features, self.min_df, self.ngrams, self.c, self.max_iter = label, folds, features, min_df, ngrams, c, max_iter
        # The texts themselves aren't needed any more.
        self.rows = kept(dealt.withColumn("_t", word_terms(F.col(text), self.stop, ngrams)).drop(text))
        rated = self.rows.where(F.col(label).isNotNull())
        pairs = rated.select("fold", term_runs(F.col("_t")).alias("r")).select("fold", F.explode(F.arrays_zip("r.terms", "r.tfs")).alias("p"))
        own = [f(F.when(F.col("fold") == k, x)).alias(f"{n}_{k}") for k in range(folds) for n, f, x in (("df", F.count, F.lit(1)), ("total", F.sum, F.col("p.tfs")))]
        terms = pairs.groupBy(F.col("p.terms").alias("term")).agg(F.count("*").alias("df"), F.sum("p.tfs").alias("total"), *own)
        self.terms = kept(terms.where(F.col("df") >= min_df))
        #: (label, fold) -> rows: one for each class and fold.
        self.sizes = {(r[0], r[1]): r[2] for r in rated.groupBy(label, "fold").count().collect()}

    def tfidf(self, k: int) -> TfIdf:
        """What the rows of all folds but k give."""
        less = lambda n: (F.col(n) - F.coalesce(F.col(f"{n}_{k}"), F.lit(0))).alias(n)
        n = sum(v for (_, fold), v in self.sizes.items() if fold != k)
        return TfIdf.of_counts(self.terms.select("term", less("df"), less("total")), n, self.features, self.min_df, self.stop, self.ngrams)

    def predictions(self, output: str, balanced: tuple[bool, ...] = (True,)) -> list[list[DataFrame]]:
        """For each fold and each choice of class weights the fold's rows (without their texts) and the label that the model of the other folds tells."""
        def fold(k: int) -> list[DataFrame]:
            labels = sorted({x for (x, fold) in self.sizes if fold != k})
            own = F.col("fold") == k
            if not labels:
                return [self.rows.where(own).drop("_t").withColumn(output, F.lit(None).cast("string"))] * len(balanced)
            names = F.array(*[F.lit(x) for x in labels])
            seen = self.tfidf(k).vectors(self.rows, F.col("_t")).drop("_t").withColumn("label_index", (F.array_position(names, F.col(self.label)) - 1).cast("double"))
            others = seen.where(~own & F.col("label_index").isNotNull()).select("label_index", "features").persist()
            models = [_regression(others, self.c, b, self.max_iter) for b in balanced]
            others.unpersist()
            told = lambda m: m.transform(seen.where(own)).withColumn(output, F.element_at(names, F.col("prediction").cast("int") + 1))
            return [told(m).drop("label_index", "features", "rawPrediction", "probability", "prediction") for m in models]
        with ThreadPool(self.parallelism) as pool:  # a fit is many small jobs, one after the other
            return pool.map(inheritable_thread_target(self.rows.sparkSession)(fold), range(self.folds))


def fold_predictions(dealt: DataFrame, text: str, label: str, output: str, folds: int = 5, balanced: bool = True, **options) -> list[DataFrame]:
    """For each fold its rows of dealt (with `fold`), without their texts, and the label that the model of the other folds predicts."""
    return [each[0] for each in Folds(dealt, text, label, folds, **options).predictions(output, (balanced,))]


def mean_fold_score(rows: DataFrame, label: str, told: str) -> float:
    """Mean over the folds (`fold`) of their shares of rows that are told right, to four places; rows without a label don't count."""
    scores = rows.where(F.col(label).isNotNull()).groupBy("fold").agg(F.avg(F.coalesce(F.col(told) == F.col(label), F.lit(False)).cast("double")).alias("s"))
    return scores.agg(F.round(F.avg("s"), 4)).first()[0] or 0.0


def first_best(scores: list[float]) -> int:
    """Which is the largest; the first of equal ones."""
    return scores.index(max(scores))


def _accuracy(told: list[DataFrame], label: str) -> float:
    return mean_fold_score(reduce(DataFrame.unionByName, told), label, "_told")


def _dealt(docs: DataFrame, key: str, label: str, folds: int, seed: int) -> DataFrame:
    return ranking.stratified_folds(docs, label, F.xxhash64(F.col(key), F.lit(seed)), folds)


def cross_validated_accuracy(docs: DataFrame, key: str, text: str, label: str, folds: int = 5, seed: int = 0, **options) -> float:
    """Mean accuracy over stratified folds, to four places."""
    return _accuracy(fold_predictions(_dealt(docs, key, label, folds, seed), text, label, "_told", folds, **options), label)


def best_balance(docs: DataFrame, key: str, text: str, label: str, folds: int = 5, seed: int = 0, **options) -> tuple[TextClassifier, bool, float]:
    """The classifier of the better cross-validated choice of class weights; the first wins ties.  Both are tried on the same folds."""
    choices = (False, True)
    told = Folds(_dealt(docs, key, label, folds, seed), text, label, folds, **options).predictions("_told", choices)
    scores = [_accuracy([each[i] for each in told], label) for i in range(len(choices))]
    at = first_best(scores)
    return fit_classifier(docs, text, label, balanced=choices[at], **options), choices[at], scores[at]


# --- sentence ranker -------------------------------------------------------------------------------------------

def sentence_features(embedding: Column, text: Column) -> Column:
    """Embedding and cue features as one vector."""
    return array_to_vector(F.concat(embedding, cue_features(text)))


@dataclass
class Ranker:
    model: LogisticRegressionModel
    labels: list[str]

    def probabilities(self, sentences: DataFrame) -> DataFrame:
        """sentences (with embedding and text) and p_inclusion, p_exclusion; 0 for a class that training lacked."""
        found = self.model.transform(sentences.withColumn("features", sentence_features(F.col("embedding"), F.col("text"))))
        p = vector_to_array("probability")
        for side in ("inclusion", "exclusion"):
            value = p[self.labels.index(side)] if side in self.labels else F.lit(0.0)
            found = found.withColumn(f"p_{side}", value)
        return found.drop("features", "rawPrediction", "probability", "prediction")

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(f"{path}/model")
        SparkSession.getActiveSession().createDataFrame([(self.labels,)], "labels array<string>").write.mode("overwrite").json(f"{path}/meta")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "Ranker | None":
        """The saved ranker; null where there is none."""
        meta = read_if_there(spark, "labels array<string>", f"{path}/meta")
        return Ranker(LogisticRegressionModel.load(f"{path}/model"), meta["labels"]) if meta else None


def cross_validated_macro_f1(sentences: DataFrame, key: str, folds: int = 3, max_iter: int = 100) -> float | None:
    """Mean macro-F1 of rankers over stratified folds, to four places; null if a fold lacks what a fit needs."""
    dealt = ranking.stratified_folds(sentences, "label", F.xxhash64(key, "text"), folds)
    scores = []
    for k in range(folds):
        train = dealt.where(F.col("fold") != k)
        if train.select("label").distinct().count() < 2:
            break
        ranker = fit_ranker(train, max_iter=max_iter)
        names = F.array(*[F.lit(x) for x in ranker.labels])
        told = ranker.model.transform(dealt.where(F.col("fold") == k).withColumn("features", sentence_features(F.col("embedding"), F.col("text"))))
        told = told.withColumn("told", F.element_at(names, F.col("prediction").cast("int") + 1))
        scores.append(ranking.macro_f1(told, "label", "told").first()[0])
    return round(sum(scores) / folds, 4) if len(scores) == folds and None not in scores else None


def fit_ranker(sentences: DataFrame, label: str = "label", c: float = 1.0, max_iter: int = 100) -> Ranker:
    """A three-class balanced regression over embeddings and cues."""
    # The fit reads its rows several times; cues are looked for once.
    rows, labels = _indexed(kept(sentences.select(label, sentence_features(F.col("embedding"), F.col("text")).alias("features"))), label)
    return Ranker(_regression(rows, c, True, max_iter), labels)


def ranked_criteria(scored: DataFrame, key: str) -> DataFrame:
    """(key, inclusion, exclusion): the best sentences of each side in document order, as arrays."""
    sides = []
    for side, k in (("inclusion", fixed.TOP_INCLUSION), ("exclusion", fixed.TOP_EXCLUSION)):
        top = ranking.top_in_order(scored, [key], f"p_{side}", "pos", k)
        sides.append(ranking.in_document_order(top, [key], "pos", "text").withColumnRenamed("texts", side))
    empty = F.array().cast("array<string>")
    both = sides[0].join(sides[1], key, "full")
    return both.select(key, *[F.coalesce(s, empty).alias(s) for s in ("inclusion", "exclusion")])

