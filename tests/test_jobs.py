"""The jobs: growing input, runs that break off, whole results, command lines."""
import hashlib
import json
import logging
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import jobs.queries
from docloom import queries
from docloom.plans import extract
from docloom.sources import articles
from jobs import config, extract_new, training_set

DOCS = "doc_id long, text string"


def add(spark, folder, rows, files=1):
    """New files in a folder of documents, with columns that the job doesn't read."""
    spark.createDataFrame(rows, DOCS).withColumns({"batch": F.lit("x"), "pmcids": F.lit(1)}).repartition(files).write.mode("append").parquet(folder)


def told(spark, rows):
    """What extraction gives for the rows, in one go."""
    docs = spark.createDataFrame([r for r in rows if r[0] is not None], DOCS)
    found = extract.extract_all(articles.from_documents(docs), lexicons=queries.FIRING, condition_text=articles.document_text())
    return Counter(map(str, found.select(sorted(found.columns)).collect()))


def have(df):
    df = df.drop("batch")
    return Counter(map(str, df.select(sorted(df.columns)).collect()))


@pytest.fixture
def place(tmp_path):
    return f"file://{tmp_path}/in", f"file://{tmp_path}/out"


def texts(n, start=0, word="the"):
    return [(start + i, f"Title {i}\n{word} {'was' if i % 3 else 'with'} here.\n" + "la la la " * (i % 4)) for i in range(n)]


def test_new_documents_only(spark, place):
    """Two runs over growing input: the second takes only what was added, and a third nothing."""
    source, out = place
    first = [*texts(20), (7, None), (8, "the same"), (8, "the same"), (None, "no id"), (None, None)]
    add(spark, source, first, 3)
    got = extract_new.run(spark, source, out, word_lists=queries.FIRING, tasks=3)
    assert got == {"batches": 1, "read": 25, "written": 23, "rejected": 2}
    assert have(extract_new.current_records(spark, out)) == told(spark, first)
    more = [*texts(5, 100), (3, "changed, that was der text"), (None, "again none")]
    add(spark, source, more)
    assert extract_new.run(spark, source, out, word_lists=queries.FIRING) == {"batches": 1, "read": 7, "written": 6, "rejected": 1}
    now = [r for r in first if r[0] != 3] + more
    assert have(extract_new.current_records(spark, out)) == told(spark, now) and extract_new.records(spark, out).count() == 29
    before = have(extract_new.records(spark, out))
    assert extract_new.run(spark, source, out, word_lists=queries.FIRING) == {"batches": 0, "read": 0, "written": 0, "rejected": 0}
    assert have(extract_new.records(spark, out)) == before
    log = extract_new.batches(spark, out).orderBy("batch").collect()
    assert [(r.batch, r.read, r.written, r.rejected, sum(r.study_types.values())) for r in log] == [(0, 25, 23, 2, 23), (1, 7, 6, 1, 6)]
    rejected = spark.read.schema(DOCS + ", batch long").parquet(f"{out}/rejected")
    assert {(r.text, r.batch) for r in rejected.collect()} == {("no id", 0), (None, 0), ("again none", 1)}


def test_batches_of_few_files(spark, place):
    source, out = place
    add(spark, source, texts(30), 5)
    got = extract_new.run(spark, source, out, word_lists=queries.FIRING, files_per_batch=2)
    assert got["batches"] == 3 and got["read"] == 30 and have(extract_new.current_records(spark, out)) == told(spark, texts(30))


def test_a_run_that_breaks_off_is_started_again(spark, place, monkeypatch):
    """Whatever of a batch was written before is written anew, with the batch's own files."""
    source, out = place
    add(spark, source, texts(10))
    extract_new.run(spark, source, out, word_lists=queries.FIRING)
    add(spark, source, texts(10, 50))
    whole = extract_new.extract_batch

    def breaks(docs, batch, *rest):
        whole(docs, batch, *rest)
        raise OSError("lost")
    monkeypatch.setattr(extract_new, "extract_batch", breaks)
    with pytest.raises(Exception, match="lost"):
        extract_new.run(spark, source, out, word_lists=queries.FIRING)
    monkeypatch.undo()
    add(spark, source, texts(10, 90))  # arrives before the next run: a batch of its own
    extract_new.run(spark, source, out, word_lists=queries.FIRING)
    assert have(extract_new.records(spark, out)) == told(spark, texts(10) + texts(10, 50) + texts(10, 90))
    assert sorted((r.batch, r.read) for r in extract_new.batches(spark, out).collect()) == [(0, 10), (1, 10), (2, 10)]


def test_no_documents(spark, place):
    source, out = place
    spark.createDataFrame([], DOCS).write.parquet(source)
    got = extract_new.run(spark, source, out)
    assert got["read"] == got["written"] == 0 and extract_new.current_records(spark, out).collect() == []
    add(spark, source, texts(2))
    assert extract_new.run(spark, source, out)["written"] == 2


def plain_set(docs, labels, folds=5, held_out=20):
    """text key -> (doc_id, label, ratings, agreement, copies, split, fold)."""
    key = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    copies, votes, ids = Counter(key(t) for _, t in docs), defaultdict(Counter), defaultdict(set)
    for d, k in {(d, key(t)) for d, t in docs}:
        for ld, label in labels:
            if ld == d and d is not None and label is not None:
                votes[k][str(label)] += 1
                ids[k].add(d)
    out, dealt = {}, Counter()
    for k in sorted(votes):
        n = max(votes[k].values())
        label = min(x for x, c in votes[k].items() if c == n)
        held = int(k[:8], 16) % 100 < held_out
        out[k] = (min(ids[k]), label, sum(votes[k].values()), n / sum(votes[k].values()), copies[k], "held_out" if held else "train", -1 if held else dealt[label] % folds)
        dealt[label] += not held
    return out


def test_training_set_equals_a_plain_version(spark, tmp_path, caplog):
    docs = [(i, f"text {i % 60}\nand more of it" if i % 9 else None) for i in range(200)] + [(5, "another text of 5"), (5, "another text of 5"), (None, "text 3\nand more of it"), (900, "never rated")]
    labels = [(i, i % 3 if i % 7 else None) for i in range(0, 220, 2)] + [(5, 0), (5, 1), (3, 2), (3, 2), (None, 1), (12, 1), (12, 1)]
    paths = [f"file://{tmp_path}/{n}" for n in ("docs", "labels", "out")]
    spark.createDataFrame(docs, DOCS).withColumn("label", F.lit("not this")).repartition(4).write.parquet(paths[0])
    spark.createDataFrame(labels, "doc_id long, quality int").withColumn("text", F.lit("not this")).write.parquet(paths[1])
    want = plain_set(docs, labels)
    read = lambda: spark.read.schema(training_set.SET).parquet(f"{paths[2]}/rows").collect()
    with caplog.at_level(logging.INFO, "jobs.training_set"):
        got = training_set.run(spark, *paths)
    assert got == {"documents": len(docs), "labels": len(labels), "texts": len(want), "ratings": sum(w[2] for w in want.values())}
    assert any("ratings don't count" in r.getMessage() for r in caplog.records)
    rows = read()
    assert {r.text_sha1: (r.doc_id, r.label, r.ratings, r.agreement, r.copies, r.split, r.fold) for r in rows} == want and len(rows) == len(want)
    train = Counter(w[1] for w in want.values() if w[5] == "train")
    for r in rows:
        assert r.weight == pytest.approx(sum(train.values()) / (len(train) * train[r.label]))
        whole = next(t or "" for _, t in docs if hashlib.sha1((t or "").encode()).hexdigest() == r.text_sha1)
        title, _, rest = whole.partition("\n")
        assert r.context == " ".join(" . ".join(x for x in (title, rest, whole) if x).split())[:3000]
    folds = Counter((r.label, r.fold) for r in rows if r.split == "train")
    assert all(max(c) - min(c) <= 1 for label in train for c in [[folds[label, k] for k in range(5)]])
    # A second run, and one over smaller tables, leave what a first one would.
    training_set.run(spark, *paths)
    assert sorted(read()) == sorted(rows)
    training_set.run(spark, paths[0], paths[1], paths[2], folds=2, held_out_percent=100)
    assert {r.fold for r in read()} == {-1} and len(read()) == len(want)


def test_training_set_of_nothing(spark, tmp_path):
    paths = [f"file://{tmp_path}/{n}" for n in ("docs", "labels", "out")]
    spark.createDataFrame([], DOCS).write.parquet(paths[0])
    spark.createDataFrame([(1, 1)], "doc_id long, quality int").write.parquet(paths[1])
    assert training_set.run(spark, *paths) == {"documents": 0, "labels": 1, "texts": 0, "ratings": 0}


def test_command_lines(monkeypatch, tmp_path):
    """Options come from the config file and then from the arguments; the session is made and stopped here only."""
    calls = []

    class Session:
        def stop(self):
            calls.append("stopped")

    class Builder:
        def appName(self, name):
            return self

        def getOrCreate(self):
            return Session()
    monkeypatch.setattr(config, "SparkSession", type("S", (), {"builder": Builder()}))

    def run(spark, documents, out, word_lists=None, tasks=0):
        calls.append((documents, out, word_lists, tasks))
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"out": "a", "tasks": 3, "word_lists": {"female": ["x"], "interventional": [["y", 2]]}}))
    config.main(run, ["--config", str(path), "--documents", "d", "--out", "b", "--tasks", "4"])
    (documents, out, words, tasks), stopped = calls
    assert (documents, out, tasks, stopped) == ("d", "b", 4, "stopped")
    assert words.female == ["x"] and words.interventional == [("y", 2)] and words.male == extract.MEDICAL.male
    with pytest.raises(SystemExit):
        path.write_text('{"nothing": 1}')
        config.main(run, ["--config", str(path)])


@pytest.mark.parametrize("job", [extract_new, training_set])
def test_shipped_configs_name_options(job):
    import inspect
    with open(job.__file__.replace(".py", ".json")) as f:
        assert set(json.load(f)) <= set(inspect.signature(job.run).parameters)


def test_registered_jobs_use_new_folders(spark, sf_dir):
    """Each call has a folder of its own and leaves settings as they were."""
    before = dict(spark.conf.getAll)
    a, b = (jobs.queries.job2_training_set(spark, sf_dir) for _ in range(2))
    assert not set(a.inputFiles()) & set(b.inputFiles()) and sorted(a.collect()) == sorted(b.collect())
    assert dict(spark.conf.getAll) == before
