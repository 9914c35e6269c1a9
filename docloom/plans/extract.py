"""Extraction plans: articles in, one typed record for each out.

Every plan runs on rules alone; learned models and external recognisers are optional hooks, and
rows that a cheaper step settles never reach a more expensive one.
"""
from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import fixed
from ..functions import conditions, criteria, rules, text, views
from ..operators import ml, ranking, vectors
from ..sources.scratch import kept


def batched(make: Callable[[], Callable[[list[str]], list[str]]], batch: int) -> Callable[[Column], Column]:
    """A hook from a Python model: make is called once in each worker, and what it returns gets `batch` texts at a time."""
    @F.pandas_udf("string")
    def run(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for c in columns:
            yield pd.Series([x for a in range(0, len(c), batch) for x in model(c.iloc[a:a + batch].tolist())], dtype=object)
    return run


@dataclass
class Models:
    """Optional parts; whatever is missing falls back to rules."""
    study_type: ml.TextClassifier | None = None
    sex: ml.TextClassifier | None = None
    ranker: ml.Ranker | None = None
    embedding_cache: DataFrame | None = None
    make_encoder: Callable = vectors.hashing_encoder
    #: Recogniser of diseases: a Column function from text to an array of names in order of mention.
    diseases: Callable[[Column], Column] | None = None
    #: Generator of a list of conditions: a Column function from a prompt to text.
    generate: Callable[[Column], Column] | None = None

    @staticmethod
    def load(spark: SparkSession, path: str, **hooks) -> "Models":
        """What a folder holds of study_type, sex, ranker and cache.  A part that is absent or can't be read is left out, with a warning for the latter."""
        def part(name: str, read: Callable):
            try:
                found = read(spark, f"{path}/{name}")
                if name == "cache" and found is not None:
                    found.limit(1).collect()  # a table that can't be read shows when it is
                return found
            except Exception as e:  # noqa: BLE001 - whatever is wrong with an artifact, rules take over
                warnings.warn(f"{path}/{name} can't be read: {str(e)[:300]}", stacklevel=3)
                return None
        return Models(part("study_type", ml.TextClassifier.load), part("sex", ml.TextClassifier.load), part("ranker", ml.Ranker.load),
                      part("cache", vectors.read_cache), **hooks)

    def save(self, path: str) -> None:
        for name in ("study_type", "sex", "ranker"):
            if getattr(self, name):
                getattr(self, name).save(f"{path}/{name}")

    @property
    def available(self) -> bool:
        return any((self.study_type, self.sex, self.ranker))


@dataclass
class Lexicons:
    """Word lists of the rules; parameters, so that other domains can use the same plans."""
    interventional: rules.Lexicon
    observational: rules.Lexicon
    female: list[str]
    male: list[str]
    only_female: list[str]
    only_male: list[str]
    pediatric: str
    inclusion: str = fixed.INCLUSION_CUES
    exclusion: str = fixed.EXCLUSION_CUES
    disease_words: str = fixed.DISEASE_WORDS
    disease_suffix: str = fixed.DISEASE_SUFFIX


MEDICAL = Lexicons(fixed.INTERVENTIONAL, fixed.OBSERVATIONAL, fixed.FEMALE_CONDITIONS, fixed.MALE_CONDITIONS, fixed.FEMALE_ONLY, fixed.MALE_ONLY, fixed.PEDIATRIC)


def with_rule_fields(articles: DataFrame, lexicons: Lexicons = MEDICAL) -> DataFrame:
    """articles with study_type, sex, minimum_age and maximum_age (null where unknown) by rules."""
    head = views.title_abstract(F.col("title"), F.col("abstract"))
    whole = F.concat(head, F.lit(" "), views.methods_text(F.col("sections")))
    age_text = F.concat(views.section_by(F.col("sections"), fixed.AGE_TITLES), F.lit(" "), head)
    found = rules.RuleCounts(whole, lexicons.interventional, lexicons.observational, lexicons.female, lexicons.male, lexicons.only_female, lexicons.only_male)
    return articles.withColumns({
        "study_type": found.study_type(), "sex": found.sex(),
        "minimum_age": rules.minimum_age(age_text, lexicons.pediatric),
        "maximum_age": F.lit(None).cast("string")})


def numbered(articles: DataFrame) -> DataFrame:
    """articles with _row, a number of each row, so that repeated ids stay apart."""
    return kept(articles.withColumn("_row", F.monotonically_increasing_id()))


def recognised_conditions(articles: DataFrame, recognise: Callable[[Column], Column], key: str = "pmcid") -> DataFrame:
    """(key, found): the most frequent cleaned disease of title (twice), abstract and methods, else of the full text.

    Only articles without a hit in the first text have their full text read.
    """
    def best(df: DataFrame, source: Column) -> DataFrame:
        names = df.select(key, F.posexplode(recognise(F.substring(source, 1, fixed.NER_CHARS))).alias("pos", "raw"))
        clean = names.select(key, "pos", conditions.clean_condition(F.col("raw")).alias("term")).where("term is not null")
        ranked = ranking.term_ranking(clean, [key])
        terms = ranked.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", "display"))).alias("t"))
        names = conditions.drop_contained(F.transform("t", lambda x: x["display"]))
        return terms.select(key, F.slice(names, 1, 1).alias("found")).where(F.size("found") > 0)
    methods = F.substring(views.methods_text(F.col("sections")), 1, fixed.METHODS_CHARS)
    first = best(articles, F.concat_ws(" . ", "title", "title", "abstract", methods))
    rest = articles.join(first, key, "left_anti")
    return first.unionByName(best(rest, views.full_text(F.col("title"), F.col("abstract"), F.col("sections"))))


def extract_all(articles: DataFrame, models: Models | None = None, lexicons: Lexicons = MEDICAL, most_chars: int = fixed.HARD_CHARS,
                condition_text: Column | None = None) -> DataFrame:
    """The seven output columns of every article; conditions as an array, unknown values as the sentinel.

    The rule of conditions reads `condition_text`, by default title, abstract and keywords.
    """
    m = models or Models()
    if m.ranker or m.diseases:
        # These plans read articles several times over: markup is parsed once.
        articles = numbered(articles)
    out = with_rule_fields(articles, lexicons)
    if m.study_type or m.sex:
        out = out.withColumn("_lexical", views.lexical_text(F.col("title"), F.col("abstract"), F.col("sections")))
        for name, model in (("study_type", m.study_type), ("sex", m.sex)):
            if model:
                out = model.predict(out.withColumnRenamed(name, "_rule"), "_lexical", name).withColumn(
                    name, F.coalesce(F.col(name), F.col("_rule"))).drop("_rule")
    sections, head = F.col("sections"), views.title_abstract(F.col("title"), F.col("abstract"))
    if m.ranker:
        stated = criteria.explicit_criteria(sections)
        out = kept(out.withColumn("_stated", F.nullif(stated, F.lit(""))))
        ranked = rank_eligibility(out.where("_stated is null"), m, "_row")
        out = out.join(ranked, "_row", "left")
        rebuilt = criteria.reconstructed_criteria(sections, head, lexicons.inclusion, lexicons.exclusion)
        eligibility = F.coalesce("_stated", F.nullif(F.col("ranked"), F.lit("")), F.nullif(rebuilt, F.lit("")), F.lit(fixed.NOT_SPECIFIED))
    else:
        eligibility = criteria.eligibility(sections, head, lexicons.inclusion, lexicons.exclusion)
    pool = conditions.condition_pool(F.col("title"), F.col("abstract"), F.col("keywords")) if condition_text is None else condition_text
    by_rule = conditions.found_conditions(pool, lexicons.disease_words, lexicons.disease_suffix)
    if m.generate:
        context = views.article_context(F.col("title"), F.col("abstract"), sections)
        out = out.withColumn("conditions", conditions.generated_conditions(m.generate(text.prompt(fixed.CONDITION_PROMPT, context))))
    elif m.diseases:
        out = out.join(recognised_conditions(out, m.diseases, "_row"), "_row", "left").withColumn("conditions", F.coalesce("found", by_rule))
    else:
        out = out.withColumn("conditions", by_rule)
    unknown = F.lit(fixed.NOT_SPECIFIED)
    return out.select(F.col("pmcid").alias("pmcids"), "conditions", "study_type", "sex", F.coalesce("minimum_age", unknown).alias("minimum_age"),
                      F.coalesce("maximum_age", unknown).alias("maximum_age"), text.truncate_hard(eligibility, most_chars).alias("eligibility_criteria"))


def sentences_of(articles: DataFrame, key: str = "pmcid") -> DataFrame:
    """(key, pos, text): each article's candidate sentences."""
    found = criteria.candidate_sentences(F.col("sections"), F.col("abstract"))
    return articles.select(key, F.posexplode(found).alias("pos", "text"))


def rank_eligibility(articles: DataFrame, models: Models, key: str = "pmcid") -> DataFrame:
    """(key, ranked): criteria of the ranker's best candidate sentences; "" where none is good enough."""
    return rank_sentences(kept(sentences_of(articles, key)), models, key)


def rank_sentences(sentences: DataFrame, models: Models, key: str = "pmcid") -> DataFrame:
    """rank_eligibility of (key, pos, text), a table that is read several times."""
    cache = models.embedding_cache
    if cache is None:
        cache = sentences.sparkSession.createDataFrame([], "text_sha1 string, embedding array<float>")
    embedded, _ = vectors.embed(sentences, cache, models.make_encoder)
    scored = kept(models.ranker.probabilities(embedded).select(key, "pos", "text", "p_inclusion", "p_exclusion"))  # both sides read it
    sides = ml.ranked_criteria(scored, key)
    return sides.select(key, criteria.format_criteria(F.col("inclusion"), F.col("exclusion")).alias("ranked"))


def inference(ids: DataFrame, articles: DataFrame, models: Models | None = None, lexicons: Lexicons = MEDICAL,
              condition_text: Column | None = None) -> DataFrame:
    """A submission row of texts for each id: looked-up article, extraction, criteria cut near a sentence's end.

    Ids without an article get what an empty article gives.
    """
    from ..sources.articles import lookup
    found = lookup(ids.select("pmcids"), articles).withColumnRenamed("pmcids", "pmcid")
    rows = extract_all(found, models, lexicons, most_chars=1 << 30, condition_text=condition_text)
    cut = text.truncate_clean(F.col("eligibility_criteria"))
    return rows.withColumn("eligibility_criteria", F.when(cut != "", cut).otherwise(fixed.NOT_SPECIFIED)).withColumn(
        "conditions", conditions.to_cell("conditions")).select(*fixed.COLUMNS)
