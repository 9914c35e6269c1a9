"""Training plans: labelled articles to classifiers, ranker, and generator pairs."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import fixed
from ..functions import conditions, criteria, text, views
from ..operators import ml, ranking, vectors
from ..sources.scratch import kept
from .extract import Models, sentences_of


def labelled_sentences(articles: DataFrame, gold: DataFrame, cache: DataFrame, make_encoder=vectors.hashing_encoder) -> DataFrame:
    """(pmcid, pos, text, embedding, label): candidate sentences weakly labelled by their similarity to gold bullets."""
    return weakly_labelled(kept(sentences_of(articles)), gold, cache, make_encoder)


#: Bullets of an article that meet a sentence in one row.
_TOGETHER = 16


def weakly_labelled(sentences: DataFrame, gold: DataFrame, cache: DataFrame, make_encoder=vectors.hashing_encoder) -> DataFrame:
    """labelled_sentences of (pmcid, pos, text), a table that is read several times."""
    own = gold.join(sentences.select(F.col("pmcid").alias("pmcids")).distinct(), "pmcids", "left_semi")  # others' bullets meet no sentence
    parsed = own.select(F.col("pmcids").alias("pmcid"), criteria.parse_bullets(F.col("eligibility_criteria")).alias("b"))
    named = lambda s: F.transform(f"b.{s}", lambda x: F.struct(F.lit(s).alias("side"), x.alias("text")))
    each = F.posexplode(F.concat(named("inclusion"), named("exclusion"))).alias("pos", "x")
    bullets = kept(parsed.select("pmcid", each).select("pmcid", F.expr(f"pos div {_TOGETHER}").alias("part"), "x.side", "x.text"))
    # Every text of either side is encoded once, whichever uses it later on.
    texts = sentences.select("text").unionByName(bullets.select("text"))
    new = kept(vectors.encode_texts(vectors.cache_misses(texts, cache), make_encoder))
    known = cache.select("text_sha1", "embedding").unionByName(new)
    candidates = kept(vectors.embedded(sentences, known))
    # Both sides' bullets meet the sentences in one join.
    parts = vectors.embedded(bullets, known).groupBy("pmcid", "part", "side").agg(F.collect_list("embedding").alias("others")).drop("part")
    pairs = vectors.similarities(candidates.select("pmcid", "pos", "embedding"), parts, ["pmcid"], "embedding", "others")
    most = {s: F.coalesce(F.max(F.when(F.col("side") == s, F.col("similarity"))), F.lit(0.0)) for s in ("inclusion", "exclusion")}
    best = pairs.groupBy("pmcid", "pos").agg(ranking.weak_label(most["inclusion"], most["exclusion"]).alias("label"))
    return candidates.join(best, ["pmcid", "pos"]).select("pmcid", "pos", "text", "embedding", "label")


def train(articles: DataFrame, gold: DataFrame, cache: DataFrame, make_encoder=vectors.hashing_encoder,
          folds: int = 5, **options) -> tuple[Models, DataFrame]:
    """Models of study type, sex and criteria sentences, and a one-row table of what was measured."""
    spark: SparkSession = articles.sparkSession
    own = articles.withColumn("_lexical", views.lexical_text(F.col("title"), F.col("abstract"), F.col("sections"))).select("pmcid", "_lexical")
    rows = gold.select(F.col("pmcids").alias("pmcid"), F.upper("study_type").alias("study_type"), F.upper(text.strip(F.col("sex"))).alias("sex")).join(own, "pmcid")
    study_score = ml.cross_validated_accuracy(rows, "pmcid", "_lexical", "study_type", folds, **options)
    study = ml.fit_classifier(rows, "_lexical", "study_type", **options)
    sex, balanced, sex_score = ml.best_balance(rows, "pmcid", "_lexical", "sex", folds, **options)
    sentences = kept(labelled_sentences(articles, gold, cache, make_encoder))
    some = sentences.select("label").distinct().count() > 1
    f1 = ml.cross_validated_macro_f1(sentences, "pmcid", max_iter=options.get("max_iter", 100)) if some else None
    ranker = ml.fit_ranker(sentences) if some else None
    meta = spark.createDataFrame([(rows.count(), study_score, sex_score, balanced, f1, fixed.LEAST_SIMILARITY, fixed.TOP_INCLUSION, fixed.TOP_EXCLUSION, spark.version)],
                                 "n_train long, study_type_cv_acc double, sex_cv_acc double, sex_balanced boolean, ranker_cv_f1_macro double, ranker_rel_thresh double, "
                                 "topk_inc int, topk_exc int, spark string")
    return Models(study, sex, ranker, cache, make_encoder), meta


def generator_pairs(articles: DataFrame, gold: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conditions pairs, eligibility pairs): pmcids, input, target; articles without context and empty golds are left out."""
    context = views.article_context(F.col("title"), F.col("abstract"), F.col("sections"))
    own = articles.select("pmcid", text.nonempty(context).alias("context"))
    names = F.array_join(conditions.parse_cell("conditions"), ", ")

    def pairs(prefix: str, target: Column) -> DataFrame:
        rows = gold.select("pmcids", text.nonempty(target).alias("target")).join(own, F.col("pmcids") == F.col("pmcid"))
        return rows.select("pmcids", text.prompt(prefix, F.col("context")).alias("input"), "target")
    return pairs(fixed.CONDITION_PROMPT, names), pairs(fixed.ELIGIBILITY_PROMPT, text.strip(F.col("eligibility_criteria"))).where("lower(target) <> 'nan'")
