import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from jobs import queries as job_queries
from docloom import fixed, queries
from docloom.operators import ml, ranking, similarity, vectors
from docloom.plans import extract, training
from docloom.sources import articles, markup

JATS = ('<article xmlns:x="u"><front><article-id pub-id-type="pmid">77</article-id><article-title>A <i>b</i></article-title>'
        '<abstract abstract-type="graphical">no</abstract><abstract>Abstract: H<sub>2</sub>O</abstract><kwd>k</kwd></front>'
        '<body><sec><title>2.1. Methods</title><p>Methods text &amp; x</p></sec><sec><title>Intro</title>Intro hello</sec></body></article>')


def parsed(spark, *data):
    rows = articles.parse_articles(spark.createDataFrame(list(enumerate(data)), "id int, x string"), "id", "x").collect()
    return [r.asDict(recursive=True) for r in sorted(rows, key=lambda r: int(r.pmcid))]


def test_article(spark):
    got, = parsed(spark, JATS)
    assert got == {"pmcid": "0", "pmid": "77", "title": "A b", "abstract": "H 2 O", "keywords": ["k"],
                   "sections": [{"title": "Methods", "text": "2.1. Methods Methods text & x"}, {"title": "Intro", "text": "Intro hello"}]}


def test_broken_markup_has_defaults_or_less(spark):
    for got in parsed(spark, None, "", "plain", "<", "<a", "<!DOCTYPE x [<!ENTITY a 'b'>]>"):
        assert got["sections"] == got["keywords"] == [] and got["title"] == got["pmid"] == got["abstract"] == ""
    assert markup.article_fields(b"\xff\xfe") == []


def test_references_do_not_part_words(spark):
    got, = parsed(spark, "<a><article-title>AT&amp;T caf&#233; p&lt;0.05 x<!-- c -->y<?pi z?>z <![CDATA[a<]]>b</article-title></a>")
    assert got["title"] == "AT&T café p<0.05 x y z a<b"
    loose, = parsed(spark, "<a><article-title>AT&amp;T caf&#233; p&lt;0.05 x<!-- c -->y</article-title><br>")
    assert loose["title"] == "AT&T café p<0.05 x y"


@pytest.mark.parametrize("data, fields, faults", [
    ("<a><kwd>x &foo; y &eacute; &amp; z</kwd></a>", "x y é & z", [(10, "undeclared entity"), (18, "undeclared entity")]),
    ("<a><kwd>AT&T & co</kwd></a>", "AT&T & co", [(10, "bare ampersand"), (13, "bare ampersand")]),
    ("<a><kwd>é < 0.05 <1</kwd></a>", "é < 0.05 <1", [(11, "bare bracket"), (18, "bare bracket")]),
    ("<a><kwd>k</kwd><title", "k", [(15, "truncated tag"), (21, "left open")]),
    ("<a><kwd>k</kw", "k", [(9, "truncated tag"), (13, "left open")]),
    ("<a><kwd>k<!-- never <b> ended</kwd></a>", "k", [(9, "truncated tag"), (39, "left open")]),
    ("<a><kwd>k<![CDATA[ never ended</kwd></a>", "k", [(9, "truncated tag"), (40, "left open")]),
    ("<a><kwd x=1 y='2' y='3'>k</kwd></a>", "k", [(8, "bad attribute"), (18, "bad attribute")]),
    ("<a><q:kwd>k</q:kwd></a>", "k", [(3, "undeclared prefix")]),
    ("<a></b><kwd>k</kwd></a>", "k", [(3, "stray end")]),
    ("<a><kwd><i>k</kwd></a>", "k", [(12, "wrong nesting")]),
    ("<a><kwd>k", "k", [(9, "left open")]),
    ("<a><kwd>k</kwd></a><kwd>l</kwd> tail", "k", [(19, "after the end"), (31, "after the end")]),
    (b"<a><kwd>k\xff\xc3\xa9</kwd>\xfe</a>", "k\ufffdé", [(9, "bad byte"), (18, "bad byte")]),
    ("<a><kwd>k\x01l&#1;</kwd></a>", "kl", [(9, "control character"), (11, "control character")]),
    ("<A><KWD>no</KWD><kwd>yes</kwd><b></A>", "yes", [(33, "wrong nesting")]),
    ("<?xml version='1.0'?><!DOCTYPE a PUBLIC 'x' 'y'><!-- c --><a><kwd>k<?p q?> l<![CDATA[<&]]></kwd></a", "k l<&", [(96, "truncated tag"), (99, "left open")]),
    ("<a><kwd>fine</kwd></a>", "fine", [])])
def test_rules_of_recovery(data, fields, faults):
    assert [f[2] for f in markup.article_fields(data)] == [fields]
    assert markup.recovered(data)[1] == faults and {r for _, r in faults} <= markup.RULES.keys()


def test_recovery_takes_time_in_proportion():
    import time

    def seconds(piece, n):
        data = "<a><body><sec>" + piece * n
        began = time.perf_counter()
        markup.article_fields(data)
        return time.perf_counter() - began
    for piece in ("<b> < c & ", "<!-- x ", "<![CDATA[ ", "<? ", "</q>", "<a b='", "<b>", "&x;", "< "):
        seconds(piece, 2000)
        assert seconds(piece, 40_000) < 40 * max(seconds(piece, 4_000), 0.01), piece


def test_what_an_article_is_made_of(spark):
    got, = parsed(spark, "<a><article-id pub-id-type='pmid'>x1</article-id><article-id pub-id-type='pmid'>12<!-- c -->3</article-id><article-id pub-id-type='pmid'>9</article-id>"
                  "<abstract abstract-type='TEASER'>t</abstract><abstract>ABSTRACT :</abstract><abstract>abstracts</abstract><kwd> </kwd><kwd>a</kwd>"
                  "<body><p>out</p><sec><title>IV. the aims</title><p>The aims</p></sec><sec><title>Only</title></sec><sec/></body><body><sec>second</sec></body></a>")
    assert (got["pmid"], got["abstract"], got["keywords"]) == ("12", "abstracts", ["a"])
    assert got["sections"] == [{"title": "the aims", "text": "IV. the aims The aims"}]


def test_cut_off_markup_keeps_what_is_there(spark):
    got, = parsed(spark, JATS[:-60])
    assert got["pmid"] == "77" and got["sections"] == [{"title": "Methods", "text": "2.1. Methods Methods text & x"}]


def test_body_without_sections(spark):
    got, deep = parsed(spark, "<article><body>all <b>text</b></body></article>", "<article><body>" + "<p>" * 5000 + "x" + "</p>" * 5000 + "</body></article>")
    assert got["sections"] == [{"title": "", "text": "all text"}] and deep["sections"] == [{"title": "", "text": "x"}]


def test_only_asked_files_are_opened(spark, tmp_path):
    """Files of other ids aren't among what is read; empty, missing and repeated ids, and odd folder names."""
    folder = tmp_path / "a [b] {c}"
    folder.mkdir()
    for i in range(30):
        (folder / f"PMC{i}.nxml").write_text(JATS.replace("77", str(i)))
    (folder / "PMC40.nxml").write_text("")
    (folder / "other.txt").write_text("x")
    path = "file://" + str(folder).replace("[", "\\[").replace("]", "\\]").replace("{", "\\{").replace("}", "\\}")
    ids = spark.createDataFrame([("3",), ("7",), ("7",), ("40",), ("99",), (None,)], "pmcids string")
    found = articles.read_asked(spark, path, ids)
    assert {f.rsplit("/", 1)[1] for f in found.inputFiles()} == {"PMC3.nxml", "PMC7.nxml"}
    want = sorted((r.pmcid, r.pmid, r.title) for r in articles.read_articles(spark, path).where("pmcid in ('3', '7')").collect())
    got = lambda **k: sorted((r.pmcid, r.pmid, r.title) for r in articles.read_asked(spark, path, ids, **k).collect())
    assert got() == want == got(listed=1) == got(cache=f"file://{tmp_path}/kept") == got(cache=f"file://{tmp_path}/kept") and len(want) == 2
    assert spark.read.parquet(f"file://{tmp_path}/kept").count() == 2
    assert articles.read_asked(spark, path, ids.limit(0)).collect() == []
    assert articles.file_faults(spark, path).collect() == []
    (folder / "PMC41.nxml").write_text("<a>&")
    assert [tuple(r) for r in articles.file_faults(spark, path).collect()] == [("41", 3, "bare ampersand"), ("41", 4, "left open")]
    rows = articles.lookup(ids.where("pmcids is not null"), articles.read_asked(spark, path, ids)).collect()
    assert sorted((r.pmcids, r.pmid) for r in rows) == [("3", "3"), ("40", ""), ("7", "7"), ("7", "7"), ("99", "")]


def test_parsed_articles_are_cached(spark, tmp_path, monkeypatch):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "PMC1.nxml").write_text(JATS)
    cache, path = f"file://{tmp_path}/cache", f"file://{tmp_path}/in"
    want = articles.read_articles(spark, path).collect()
    assert articles.read_articles(spark, path, cache).collect() == want
    (tmp_path / "in" / "PMC2.nxml").write_text("<")
    assert articles.read_articles(spark, path, cache).count() == 2
    assert spark.read.parquet(cache).count() == 2  # the first file wasn't parsed again
    assert sorted(map(str, articles.read_articles(spark, path, cache).collect())) == sorted(map(str, articles.read_articles(spark, path).collect()))


def test_read_articles_and_lookup(spark, tmp_path):
    (tmp_path / "PMC12.nxml").write_text(JATS)
    (tmp_path / "PMC13.nxml").write_text("<")
    found = articles.read_articles(spark, f"file://{tmp_path}")
    rows = {r.pmcid: r for r in found.collect()}
    assert set(rows) == {"12", "13"} and rows["12"].title == "A b" and rows["13"].title == ""
    ids = spark.createDataFrame([("12",), ("99",)], "pmcids string")
    got = {r.pmcids: r for r in articles.lookup(ids, found).collect()}
    assert got["99"].sections == [] and got["99"].title == "" and len(got["12"].sections) == 2


def test_csv_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("1", 'a "q"\nline, \\x ', None)], "pmcids string, eligibility_criteria string, sex string")
    articles.write_submission(rows, f"file://{tmp_path}/out", one_file=True)
    got = articles.read_submission(spark, f"file://{tmp_path}/out")
    assert got.columns == fixed.COLUMNS
    assert got.first().eligibility_criteria == 'a "q"\nline, \\x ' and got.first().sex == fixed.NOT_SPECIFIED
    import glob

    import pandas as pd
    pdf = pd.read_csv(glob.glob(f"{tmp_path}/out/*.csv")[0])
    assert pdf["eligibility_criteria"][0] == 'a "q"\nline, \\x '


def test_labels_reader(spark, tmp_path):
    (tmp_path / "l.csv").write_text("pmcids,sex,other\n12.0,ALL,x\n,MALE,y\n")
    got = articles.read_labels(spark, f"file://{tmp_path}/l.csv")
    assert got.columns == ["pmcids", "sex"] and [r.pmcids for r in got.collect()] == ["12"]


def test_ranking(spark):
    df = spark.createDataFrame([("d", i, p, str(i)) for i, p in enumerate([0.5, 0.9, 0.3])], "doc string, pos int, p double, text string")
    top = ranking.top_in_order(df, ["doc"], "p", "pos", 2)
    assert ranking.in_document_order(top, ["doc"], "pos", "text").first().texts == ["0", "1"]
    labels = spark.createDataFrame([(.44, .44), (.5, .5), (.4, .6)], "i double, e double")
    assert [r[0] for r in labels.select(ranking.weak_label(F.col("i"), F.col("e"))).collect()] == ["none", "inclusion", "exclusion"]
    told = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b")], "label string, told string")
    assert ranking.macro_f1(told, "label", "told").first()[0] == round(2 / 3, 4)


def test_embedding_cache(spark, tmp_path):
    texts = spark.createDataFrame([("a b",), ("a b",), ("c",), (None,)], "text string")
    empty = spark.createDataFrame([], "text_sha1 string, embedding array<float>")
    found, new = vectors.embed(texts, empty, lambda: vectors.hashing_encoder(16))
    assert new.count() == 3 and found.count() == 4 and found.where("embedding is null").count() == 0
    again, none = vectors.embed(texts, new, lambda: vectors.hashing_encoder(16))
    assert none.count() == 0
    path = f"file://{tmp_path}/cache"
    assert vectors.read_cache(spark, path).count() == 0
    vectors.append_cache(new, path)
    vectors.append_cache(new, path)
    assert vectors.read_cache(spark, path).count() == 3


def test_best_similarity(spark):
    e = spark.createDataFrame([(1, 1, [1.0, 0.0]), (1, 2, [0.0, 1.0]), (2, 3, [1.0, 0.0])], "k int, id int, embedding array<float>")
    right = spark.createDataFrame([(1, [1.0, 0.0])], "k int, embedding array<float>")
    got = {r.id: r.similarity for r in vectors.best_similarity(e, right, ["k"], "id").collect()}
    assert got == {1: 1.0, 2: 0.0, 3: 0.0}
    blocks = {r.id: r.similarity for r in similarity.best_match(e, right, "id", 2).collect()}
    assert blocks[1] == 1.0
    assert {r.id: r.similarity for r in similarity.best_match(e, right.limit(0), "id", 2).collect()} == {1: 0.0, 2: 0.0, 3: 0.0}


def test_cosine_max_whole_has_partners_of_every_id(spark, tmp_path):
    e = [(1, [1.0] + [0.0] * 63, 1), (200, [0.6, 0.8] + [0.0] * 62, 1), (201, [0.0, 1.0] + [0.0] * 62, 1), (300, [1.0] + [0.0] * 63, 2), (301, [1.0] + [0.0] * 63, 2),
         (302, [1.0] + [0.0] * 63, 3)]
    rows = spark.createDataFrame(e, "vec_id long, embedding array<float>, label int")
    rows.write.parquet(f"{tmp_path}/embeddings.parquet")
    want = {1: 0.6, 200: 0.8, 201: 0.8, 300: 1.0, 301: 1.0}
    assert {r.vec_id: r.similarity for r in entry.queries()["cosine_max"](spark, str(tmp_path)).collect()} == want
    blocks = similarity.best_other(rows, "vec_id", "label", 64, block=1).collect()
    assert {r.vec_id: round(r.similarity, 4) for r in blocks} == want


@pytest.fixture(scope="module")
def cohort(spark):
    good = "Patients were randomized to placebo. We included adults with asthma. Subjects without consent were not eligible here."
    rows = [(str(i), "", f"Trial {i}" if i % 2 else f"Registry {i}", good if i % 2 else "A retrospective registry of records.", [], [("Methods", good)]) for i in range(12)]
    a = spark.createDataFrame(rows, "pmcid string, pmid string, title string, abstract string, keywords array<string>, sections array<struct<title: string, text: string>>")
    gold = spark.createDataFrame([(str(i), "['Asthma']", "interventional" if i % 2 else "observational", "ALL" if i % 3 else "male ", "Inclusion Criteria:\n* We included adults with asthma.\nExclusion Criteria:\n* Subjects without consent") for i in range(12)],
                                 "pmcids string, conditions string, study_type string, sex string, eligibility_criteria string")
    return a, gold


def test_training_and_models(spark, cohort, tmp_path):
    a, gold = cohort
    cache = spark.createDataFrame([], "text_sha1 string, embedding array<float>")
    models, meta = training.train(a, gold, cache, lambda: vectors.hashing_encoder(32), folds=2, max_iter=10, stop_words=[])
    assert meta.first().n_train == 12 and models.available
    got = extract.extract_all(a, models).collect()
    assert len(got) == 12 and {r.study_type for r in got} <= {"INTERVENTIONAL", "OBSERVATIONAL"}
    assert all(r.eligibility_criteria for r in got)
    models.study_type.save(f"file://{tmp_path}/m")
    loaded = ml.TextClassifier.load(spark, f"file://{tmp_path}/m")
    assert loaded.labels == models.study_type.labels
    assert ml.TextClassifier.load(spark, f"file://{tmp_path}/none") is None
    models.save(f"file://{tmp_path}/all")
    back = extract.Models.load(spark, f"file://{tmp_path}/all", make_encoder=lambda: vectors.hashing_encoder(32))
    assert back.available and back.ranker.labels == models.ranker.labels and back.embedding_cache.count() == 0
    assert sorted(map(str, extract.extract_all(a, back).collect())) == sorted(map(str, got))
    assert not extract.Models.load(spark, f"file://{tmp_path}/none").available
    assert meta.first().ranker_cv_f1_macro is None or 0 <= meta.first().ranker_cv_f1_macro <= 1


def test_repeated_ids_stay_apart(spark, cohort):
    a, gold = cohort
    twice = a.where("pmcid = '1'").withColumn("title", F.lit("Stroke")).union(a.where("pmcid = '1'").withColumn("title", F.lit("Asthma")))
    recognise = lambda c: F.regexp_extract_all(c, F.lit("(Stroke|Asthma)"), F.lit(1))
    assert sorted(r.conditions[0] for r in extract.extract_all(twice, extract.Models(diseases=recognise)).collect()) == ["Asthma", "Stroke"]
    model = ml.fit_classifier(spark.createDataFrame([(1, "good fine words", "x"), (1, "bad words here", "y"), (2, "good fine day", "x"), (2, "bad day here", "y")], "id int, t string, label string"),
                              "t", "label", stop_words=[], max_iter=20)
    told = model.predict(spark.createDataFrame([(1, "good fine words"), (1, "bad words here"), (1, "bad words here"), (None, None)], "id int, t string"), "t", "told").collect()
    assert sorted((r.t or "", r.told) for r in told)[1:] == [("bad words here", "y")] * 2 + [("good fine words", "x")]


def test_broken_artifacts_are_left_out(spark, cohort, tmp_path):
    (tmp_path / "study_type" / "meta").mkdir(parents=True)
    (tmp_path / "study_type" / "meta" / "part-0.json").write_text('{"labels": ["A"], "size": 3, "stop_words": [], "ngrams": 1}')
    (tmp_path / "cache").mkdir()
    (tmp_path / "cache" / "part-0.parquet").write_text("no parquet")
    with pytest.warns(UserWarning):
        models = extract.Models.load(spark, f"file://{tmp_path}")
    assert not models.available and models.embedding_cache is None
    assert extract.extract_all(cohort[0], models).count() == 12


def test_rows_are_numbered_within_groups(spark):
    rows = [(i, "hot" if i % 10 else None if i % 20 else "cold") for i in range(400)]
    got = ranking.numbered_within(spark.createDataFrame(rows, "id int, label string").repartition(7), "label", -F.col("id"), "n").collect()
    for label in ("hot", "cold", None):
        own = sorted((r for r in got if r.label == label), key=lambda r: r.n)
        assert [r.n for r in own] == list(range(len(own))) and [r.id for r in own] == sorted((i for i, x in rows if x == label), reverse=True)


def test_embedding_cache_with_repeated_keys(spark):
    key = spark.range(1).select(queries.text.content_key(F.lit("a"))).first()[0]
    cache = spark.createDataFrame([(key, [1.0]), (key, [1.0])], "text_sha1 string, embedding array<float>")
    found, new = vectors.embed(spark.createDataFrame([("a",)], "text string"), cache, lambda: vectors.hashing_encoder(4))
    assert found.count() == 1 and new.count() == 0


def test_generator_pairs(spark, cohort, tmp_path):
    a, gold = cohort
    first, second = training.generator_pairs(a, gold)
    assert first.first().target == "Asthma" and first.first().input.startswith(fixed.CONDITION_PROMPT) and second.count() == 12
    articles.write_pairs(first, f"file://{tmp_path}/p")
    assert articles.read_pairs(spark, f"file://{tmp_path}/p").count() == 12


def test_hooks(spark, cohort):
    a, _ = cohort
    found = extract.extract_all(a, extract.Models(diseases=lambda c: F.array(F.lit("lung cancer"), F.lit("asthma"), F.lit("Asthma"))))
    assert {tuple(r.conditions) for r in found.collect()} == {("Asthma",)}
    made = extract.extract_all(a, extract.Models(generate=lambda p: F.lit("Flu and Cold")))
    assert {tuple(r.conditions) for r in made.collect()} == {("Flu", "Cold")}


def test_inference_columns(spark, cohort):
    a, _ = cohort
    got = extract.inference(spark.createDataFrame([("1",), ("x",)], "pmcids string"), a)
    assert got.columns == fixed.COLUMNS and got.count() == 2
    assert got.where("eligibility_criteria is null or length(eligibility_criteria) > 190").count() == 0


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n not in ("tfidf_classifier", "ranker_criteria")])
def test_queries_match_sql(spark, sf_dir, name):
    duckdb = pytest.importorskip("duckdb")
    got = entry.queries()[name](spark, sf_dir).toPandas()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert len(got)
        return
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.sql(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    want = con.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)

    def rows(df):
        return sorted(tuple("" if v is None or v != v else format(v, ".9g") if isinstance(v, float) else str(v) for v in r)
                      for r in df[sorted(df.columns)].astype(object).itertuples(index=False))
    assert rows(got) == rows(want)


def test_command_line(spark, tmp_path):
    from docloom.__main__ import main
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "PMC12.nxml").write_text(JATS)
    (tmp_path / "ids.csv").write_text("pmcids\n12\n99\n")
    main(["--articles", f"file://{tmp_path}/a", "--ids", f"file://{tmp_path}/ids.csv", "--out", f"file://{tmp_path}/out"])
    assert {r.pmcids for r in articles.read_submission(spark, f"file://{tmp_path}/out").collect()} == {"12", "99"}


def test_command_line_trains_and_generates(spark, tmp_path, monkeypatch):
    from docloom.__main__ import main
    (tmp_path / "a").mkdir()
    lines = ["pmcids,conditions,study_type,sex,eligibility_criteria"]
    for i in range(8):
        kind = "Randomized trial" if i % 2 else "Retrospective registry"
        (tmp_path / "a" / f"PMC{i}.nxml").write_text(f"<article><article-title>{kind} {i}</article-title><abstract>We included adults with asthma number {i}.</abstract></article>")
        lines.append(f'{i},"[\'Asthma\']",{"interventional" if i % 2 else "observational"},{"ALL" if i % 3 else "MALE"},"Inclusion Criteria:\n* We included adults with asthma"')
    (tmp_path / "gold.csv").write_text("\n".join(lines))
    (tmp_path / "hooks_of_test.py").write_text("def lister(device='none'):\n    return lambda texts: [f'{device} and n{len(texts)}' for _ in texts]\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    spark.sparkContext.addPyFile(str(tmp_path / "hooks_of_test.py"))
    at = lambda x: f"file://{tmp_path}/{x}"
    main(["train", "--articles", at("a"), "--gold", at("gold.csv"), "--models", at("m"), "--folds", "2", "--max-iter", "5", "--parsed", at("parsed")])
    assert spark.read.json(at("m/measured")).first().n_train == 8
    main(["pairs", "--articles", at("a"), "--gold", at("gold.csv"), "--out", at("pairs")])
    assert articles.read_pairs(spark, at("pairs/gen_cond")).count() == 8
    main(["--articles", at("a"), "--ids", at("gold.csv"), "--out", at("out"), "--models", at("m"), "--generator", "hooks_of_test:lister", "--device", "cpu", "--batch", "3", "--parsed", at("parsed")])
    rows = articles.read_submission(spark, at("out")).collect()
    assert len(rows) == 8 and all(r.conditions.startswith("['cpu', 'n") for r in rows)


def test_streaming_equals_batch(spark, sf_dir):
    known = entry.queries()
    a, b = (sorted(tuple(r) for r in known[n](spark, sf_dir).select("pmcids", "study_type", "sex").collect()) for n in ("extract_all", "stream_extract"))
    assert a == b


@pytest.mark.parametrize("name", ["extract_all", "stream_extract", "submission"])
def test_conditions_far_into_a_document(spark, tmp_path, name):
    rows = [(1, "first line\n" + "some words of prose " * 500 + "with severe thtion at last"), (2, "thtion"), (3, None), (4, "one\n" + "w" * 492 + " thtions")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.pmcids: r.conditions.strip("[]'") for r in entry.queries()[name](spark, str(tmp_path)).collect()}
    got.pop("none", None)
    assert got == {"1": "Thtion", "2": "Thtion", "3": fixed.NOT_SPECIFIED, "4": fixed.NOT_SPECIFIED}


def test_every_labelled_document_is_predicted_and_every_document_ranked(spark, sf_dir):
    documents, labels = ({r.doc_id for r in spark.read.parquet(f"{sf_dir}/{t}.parquet").select("doc_id").collect()} for t in ("documents", "labels"))
    told = entry.queries()["tfidf_classifier"](spark, sf_dir).collect()
    assert sorted(r.doc_id for r in told) == sorted(documents & labels) and {r.told for r in told} <= {"0", "1"}
    ranked = entry.queries()["ranker_criteria"](spark, sf_dir).collect()
    assert sorted(r.doc_id for r in ranked) == sorted(documents) and any(r.ranked for r in ranked if r.doc_id not in labels)


def test_entry_without_the_subpackage(tmp_path):
    """Without docloom/llm the other queries are there; a package that it needs and that isn't installed is an error."""
    import os
    import shutil
    import subprocess
    import sys
    here = os.path.dirname(os.path.abspath(entry.__file__))
    shutil.copytree(f"{here}/docloom", tmp_path / "docloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copytree(f"{here}/jobs", tmp_path / "jobs", ignore=shutil.ignore_patterns("__pycache__"))
    shutil.copy(f"{here}/__spark_entry__.py", tmp_path)

    def run():
        return subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, env=os.environ | {"PYTHONPATH": ""},
                              capture_output=True, text=True)
    assert run().stdout.split() == [str(len(queries.QUERIES) + len(job_queries.QUERIES)), str(len(queries.ORACLE_SQL) + len(job_queries.ORACLE_SQL))]
    (tmp_path / "docloom" / "llm").mkdir()
    (tmp_path / "docloom" / "llm" / "__init__.py").write_text("")
    (tmp_path / "docloom" / "llm" / "queries.py").write_text("import not_installed_anywhere")
    assert "not_installed_anywhere" in run().stderr
