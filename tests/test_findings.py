"""What a review found, each as a test that failed before."""
import ast
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F, types as T
from pyspark.util import PythonEvalType

import __spark_entry__ as entry
from docloom import fixed
from docloom.functions import conditions, scan, slices, text
from docloom.llm import sharding
from docloom.operators import ml, vectors
from docloom.plans import extract, training
from docloom.sources import articles


def against_sql(spark, folder, name, tables):
    """A query's rows over small tables (name: (rows, schema)) and those of its SQL."""
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{t}.parquet")
        con.sql(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet/*.parquet')")
    got = entry.queries()[name](spark, str(folder))
    want = con.sql(entry.oracle_sql()[name])
    assert got.columns == want.columns
    return (sorted((tuple(r) for r in rows), key=repr) for rows in (got.collect(), want.fetchall()))


def test_page_titles_are_as_written(spark, tmp_path):
    pages = ["<title>a &quot;b&quot; &amp; c &amp</title>", "<TITLE>\n x\t y </Title><title>z</title>", "<h1>none</h1>", None, "<title>open", "<title>a<title>b</title>",
             "<title>é  \U0001f600</title>", "<title></title>", "<title>" * 3000 + "x"]
    got, want = against_sql(spark, tmp_path, "html_title", {"pages": ([(i, "u", h) for i, h in enumerate(pages)], "page_id long, url string, html string")})
    assert got == want and got[0] == (0, 'a &quot;b&quot; & c &amp')
    # The record of a page still has the title that a reader sees.
    seen = articles.from_pages(spark.createDataFrame([(1, pages[0])], "page_id long, html string")).first()
    assert seen.title == 'a "b" & c &'


DOCUMENTS = "doc_id long, text string"


def test_contained_terms_of_whole_documents(spark, tmp_path):
    # Across phrases, beyond the twentieth term, of single words, of repeated ids and of none.
    many = " ".join(f"w{i}x" for i in range(40))
    texts = [(1, "lung cancer. Cancers, lungs"), (2, many + " 1x w39"), (3, "one"), (4, ""), (5, None), (6, "Ab AB ab abc"), (7, "a aa aaa b"),
             (8, "left"), (8, "lefts"), (None, "x"), (None, "yx")]
    got, want = against_sql(spark, tmp_path, "drop_contained_terms", {"documents": (texts, DOCUMENTS)})
    assert got == want
    kept = dict(got)
    assert kept[1] == "Cancers, | cancer. | lungs" and kept[2].count("|") == 39 and kept[8] == "lefts" and kept[None] == "yx"


def test_contained_terms_take_time_in_proportion():
    start = time.perf_counter()
    assert sum(conditions._outside([f"{i:06d}." for i in range(100_000)])) == 100_000
    assert time.perf_counter() - start < 5


def test_ranked_words_are_shuffled_as_whole_texts(spark, tmp_path):
    spark.createDataFrame([(i, "A word and a Word " * 50) for i in range(50)], DOCUMENTS).write.parquet(f"{tmp_path}/documents.parquet")
    found = entry.queries()["term_frequency_rank"](spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.index("Generate") < plan.index("Exchange hashpartitioning")  # printed from the top
    assert {tuple(r)[1:] for r in found.collect()} == {("word", 100, "word", 1), ("and", 50, "and", 3), ("a", 100, "A", 2)}


def test_no_more_than_a_few_rows_are_python_objects_at_once(monkeypatch):
    """An Arrow batch is given to a row's function in slices."""
    taken = []
    rows = pa.array([f"t{i}" for i in range(1000)])
    monkeypatch.setattr(slices.F, "arrow_udf", lambda run, kind: run)
    run = slices.row_udf(lambda x: taken.append(x) or [x], T.ArrayType(T.StringType()))
    assert run(rows).to_pylist() == [[x] for x in rows.to_pylist()] and len(taken) == 1000
    assert run(rows[:0]).to_pylist() == [] and run(pa.array([None, "a"])).to_pylist() == [[None], ["a"]]


def test_texts_stay_arrow_arrays(spark):
    """Of a batch no column of Python objects is made, whatever its size."""
    rows = spark.range(3).select(F.lit("<p>x</p>").alias("x"))
    for c in (articles._article(F.col("x")), articles._page(F.col("x")), conditions.parse_cell(F.col("x")), scan.pattern_counts(F.col("x"), ["x"])):
        plan = rows.select(c.alias("y"))._jdf.queryExecution().executedPlan().toString()
        assert "ArrowEvalPython" in plan and plan.rstrip().count(f"], {PythonEvalType.SQL_SCALAR_ARROW_UDF}")


@pytest.mark.parametrize("cell", ["['a', 'b']", "['a']", "['']", "[' a ', '']", "['a'b']", "['a', \"b's\"]", "['a\\n']", "['a', 'b'", "[]", "('a', 'b')", "'a', 'b'", "1, 2", "None", "None, 1",
                                  "word, ['a']", "b'x', 'y'", "R'x', 'y'", "set(), 1", "['a' 'b']", "['a' , 'b']", "['a'+'b']", "['a', 'b', ]", "['a ']", "['\x00']", "", "  ", "fr'x'", "True, False"])
def test_cells_are_those_of_the_parser(cell):
    def plain(v):
        s = v.strip()
        if not s:
            return []
        try:
            found = ast.literal_eval(s)
        except (ValueError, SyntaxError, MemoryError, RecursionError):
            return [s]
        return [str(x).strip() for x in found if str(x).strip()] if isinstance(found, (list, tuple)) else [s]
    assert conditions._parsed(cell) == plain(cell)


def test_lists_of_plain_texts_are_written_like_others(spark):
    lists = [["a", "b"], ["", "a"], [], [None, "é"], [None], None, [" a "], ["a b"], ["a'b"], ['a"b'], ["a\\"], [" "], ["​"], ["x" * 9, "\U0001f600"], ["a\n"]]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, x array<string>")
    clean = [[t.strip() for t in x or [] if t is not None and t.strip()] or [fixed.NOT_SPECIFIED] for x in lists]
    assert [r.c for r in rows.select("i", conditions.to_cell("x").alias("c")).orderBy("i").collect()] == [str(x) for x in clean]


def test_bounds_of_text_dimensions_come_from_all_rows(spark):
    # 50,000 rows of 8 values, each an eighth: the bounds are the first seven, whatever a sample would give.
    rows = spark.range(50_000).select("id", F.concat(F.lit("v"), F.expr("id % 8")).alias("v"), F.format_string("%06d", F.expr("(id * 7919) % 50000")).alias("all"))
    found = sharding._bounds(rows, {"v": "v", "all": "all"}, 3)
    assert found["v"] == [f"v{i}" for i in range(7)]
    assert found["all"] == [f"{6250 * i - 1:06d}" for i in range(1, 8)]
    assert sharding._bounds(rows.where("id < 0"), {"v": "v"}, 3) == {"v": []}
    nulls = spark.createDataFrame([(None,), ("b",), ("a",)], "v string")
    assert sharding._bounds(nulls, {"v": "v"}, 1) == {"v": ["a"]}


def test_ranker_makes_sentences_and_bullets_once(spark, tmp_path, monkeypatch):
    """Sentences are made once for both plans, bullets once and only of documents that have sentences to label, and each text is encoded once by each plan."""
    rows = [(i, f"Title {i}\nPatients of group {i} were included.\nSubjects below {i} years were excluded. Nothing else is told here.") for i in range(40)]
    spark.createDataFrame(rows, DOCUMENTS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i,) for i in range(0, 40, 4)], "doc_id long").write.parquet(f"{tmp_path}/labels.parquet")
    made, parsed = [], []
    sentences_of, parse = extract.sentences_of, training.criteria.parse_bullets
    monkeypatch.setattr(extract, "sentences_of", lambda *a: made.append(1) or sentences_of(*a))
    monkeypatch.setattr(training, "sentences_of", extract.sentences_of)
    written = training.kept
    monkeypatch.setattr(training, "kept", lambda df: parsed.append((df.columns, (out := written(df)))) or out)
    got = entry.queries()["ranker_criteria"](spark, str(tmp_path)).collect()
    assert len(got) == 40 and len(made) == 1
    bullets = [df for columns, df in parsed if "side" in columns]
    assert len(bullets) == 1 and {int(r.pmcid) % 4 for r in bullets[0].collect()} == {0}


def test_largest_products_of_arrays_are_those_of_single_pairs():
    rng = np.random.default_rng(3)
    some = lambda n: rng.normal(size=n).astype(np.float32).tolist()
    one = [some(3), None, some(3), some(2), [], some(3), [1.0, None, 2.0], some(3)] * 100
    others = [[some(3), some(3)], [some(3)], [], [some(3), some(2)], [[]], None, [some(3)], [None, [1.0, None, 0.0], some(3)]] * 100

    def plain(a, b):
        return sum((float(x) * float(y) for x, y in zip(a, b)), 0.0) if a is not None and b is not None and len(a) == len(b) and None not in a + b else None
    want = [max((d for d in (plain(a, b) for b in bs or []) if d is not None), default=None) for a, bs in zip(one, others)]
    kind = pa.list_(pa.float32())
    assert vectors._best_dots(pa.array(one, kind), pa.array(others, pa.list_(kind))).to_pylist() == want


def test_terms_stay_in_the_jvm(spark):
    """Weighting has no Python step, and vectors' Python step gets numbers of known terms in place of all terms."""
    docs = spark.createDataFrame([(1, "one two three one"), (2, "two one two"), (3, None), (4, "alone"), (5, "one two")], DOCUMENTS)
    model = ml.TfIdf.fit(docs, "text", stop_words=[])
    weights, vectors_ = model.weights(docs, "text"), model.transform(docs, "text")
    assert "ArrowEvalPython" not in weights._jdf.queryExecution().executedPlan().toString()
    assert "run(_counts" in vectors_._jdf.queryExecution().executedPlan().toString()
    found = {r.doc_id: r.features for r in vectors_.collect()}
    index = {r.term: r["index"] for r in model.vocabulary.collect()}
    assert set(index) == {"one", "two", "one two"} and found[3].numNonzeros() == found[4].numNonzeros() == 0
    for r in weights.collect():
        assert found[r.doc_id][index[r.term]] == pytest.approx(r.weight, rel=1e-12)
    none = ml.TfIdf.fit(docs.where("doc_id > 2"), "text", stop_words=[])  # no term is in two rows
    assert none.weights(docs, "text").count() == 0 and none.transform(docs, "text").count() == 5


def test_pairs_of_cells_that_spark_makes(spark, tmp_path):
    """Cells may be made by any expression: one whose lambdas use an outer one's variable once came to the filter as a Python UDF that couldn't be run."""
    rows = [(1, "Asthma\nrest"), (2, "it's \"x\"\ty \nrest"), (3, ""), (4, None), (5, "only one line"), (6, "\nno title"), (7, "a\\b\n")]
    got, want = against_sql(spark, tmp_path, "generator_pairs", {"documents": (rows[:1] + rows[2:6], DOCUMENTS)})
    assert got == want and len(got) == 2
    docs = spark.createDataFrame(rows, DOCUMENTS)
    title = F.substring_index(F.coalesce("text", F.lit("")), "\n", 1)
    cells = docs.select("doc_id", "text", conditions.to_cell(F.array(title)).alias("cell"))
    parsed = F.array_join(conditions.parse_cell("cell"), ", ")
    assert {r.doc_id for r in cells.where(parsed != "Not Specified").collect()} == {1, 2, 5, 7}
    outer = conditions.let(F.array(title), lambda a: conditions.let(F.array_join(a, ""), lambda s: F.when(s != "", F.concat(F.lit("['"), F.array_join(a, ""), F.lit("', ' z ']")))))
    gold = docs.select(F.col("doc_id").cast("string").alias("pmcids"), outer.alias("conditions"),
                       F.element_at(F.array(F.lit(" NaN"), F.lit(" all adults\n"), F.lit(" "), F.lit(None)), (F.col("doc_id") % 4 + 1).cast("int")).alias("eligibility_criteria"))
    first, second = training.generator_pairs(articles.from_documents(docs), gold)
    assert {r.pmcids: r.target for r in first.collect()} == {"1": "Asthma, z", "2": "['it's \"x\"\ty ', ' z ']", "5": "only one line, z", "7": "a\x08, z"}
    assert {r.pmcids: r.target for r in second.collect()} == {"1": "all adults", "5": "all adults"}


def test_phrases_of_many_leading_words(spark, tmp_path):
    """Each leading word once took a piece of the stack, whose end loses an executor: junk such as "A A A" has thousands of them in a row."""
    texts = ["A " * 20000 + "lung cancer", "A " * 20000, "the  Severe\tacute " * 5000 + "asthma. of of ofx COPD disease", "an\n" + "In a " * 9000 + "HIV infection,a", "a lung an cancer", None, "",
             "lung " + "-" * 60000 + " cancer", "- " * 60000 + "renal failure" + " :" * 60000]
    began = time.time()
    got, want = against_sql(spark, tmp_path, "clean_conditions", {"documents": (list(enumerate(texts)), DOCUMENTS)})
    assert got == want and [r[2] for r in got] == ["Lung Cancer", "Asthma", "Ofx COPD Disease", "HIV Infection", "Lung An Cancer", "Renal Failure"]
    assert time.time() - began < 60


def test_phrases_are_cleaned_once(spark, tmp_path):
    spark.createDataFrame([(1, "the lung cancer. x")], DOCUMENTS).write.parquet(f"{tmp_path}/documents.parquet")
    found = entry.queries()["clean_conditions"](spark, str(tmp_path))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("underlying|severe") == 1 and [tuple(r) for r in found.collect()] == [(1, 0, "Lung Cancer")]


def test_ends_are_stripped_as_python_does(spark):
    rng = np.random.default_rng(5)
    chars = " .,;:-—–\t\n"
    rows = [("".join(rng.choice(list(chars + "ab]^\\"), size=n)),) for n in rng.integers(0, 12, 400)] + [("a" + "- " * 30000 + "b--",)]
    got = spark.createDataFrame(rows, "t string").select("t", text.strip_chars(F.col("t"), chars).alias("x"), text.strip_chars(F.col("t"), r"]^\-").alias("y")).collect()
    assert all(r.x == r.t.strip(chars) and r.y == r.t.strip(r"]^\-") for r in got)
