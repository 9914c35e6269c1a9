import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docloom.llm import (bpe, components, decontaminate, fingerprints, katz, langid, ngram_join, ordinal, packing, queries, routing, shared,
                         sharding, suffixes, textbytes as tb, warc)

from . import fixtures as fx

ROWS = fx.documents()


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, fx.SCHEMA)
    # Extra columns whose names the operators use themselves, and the text's name in another case.
    odd = ("g", "key", "part", "class", "grade", "selected", "size", "curve", "component_id", "_key", "_g", "_text", "_digest", "digest", "row", "text_key", "train",
           "shard", "slot", "a.b", "seed", "item_id", "kind", "cut")
    return df.withColumns({c: F.lit("x") for c in odd}).withColumnRenamed("text", "TEXT").repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], fx.SCHEMA)


def by_id(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0] is None, r[0] or 0))


# --- kernels ---------------------------------------------------------------------------------------------------

def test_shingle_hashes_tell_sets_apart():
    texts = [t for _, t, *_ in ROWS]
    got = [len(np.unique(g)) for g in tb.shingles(*tb.column_bytes(pa.array(texts, pa.string())), 4)]
    assert got == [len(fx.shingles(t, 4)) for t in texts]


def test_slices_of_a_sliced_array():
    a = pa.array(["x", None, "abc def", "", "é"], pa.string()).slice(1, 4)
    raw, offsets = tb.column_bytes(a)
    assert bytes(raw) == "abc defé".encode() and offsets.tolist() == [0, 0, 7, 7, 9]


def test_packing():
    for x in (np.array([], np.uint64), np.array([0, 0, 5, 2**64 - 1], np.uint64)):
        assert (packing.unpack_sorted(packing.pack_sorted(x)) == x).all()
    y = np.array([-3, 7], np.int64)
    assert (packing.unpack(packing.pack(y), np.int64) == y).all()


def test_workspace_and_shared_folder(spark, monkeypatch):
    with shared.Workspace(spark) as work:
        a = work.written(spark.range(5).withColumn("kind", F.col("id") % 2), "a", by="kind")
        work.drop_part("a", "kind=0")
        b = work.written(a.where("kind = 1"), "b")
        assert b.count() == 2
        folder = work.folder
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    assert not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    class Cluster:
        conf = type("C", (), {"get": staticmethod(lambda *a: "")})
        sparkContext = type("S", (), {"master": "spark://host:7077", "getConf": staticmethod(lambda: Cluster.conf)})
    with pytest.raises(RuntimeError):
        shared.shared_dir(Cluster)


def test_components_grow_by_new_links(spark):
    rng = random.Random(2)
    links = [(rng.randrange(80), rng.randrange(80)) for _ in range(70)]
    frame = lambda x: spark.createDataFrame(x, "a long, b long")
    whole = components.connected(frame(links[:30]))
    for at in (30, 50):
        whole = components.joined(whole, frame(links[at:at + 20]))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, components.connected(frame(links)).collect()))


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)] + [(5, 5), (None, 3)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x
    for a, b in links:
        if a is not None and a != b:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.node: r.component_id for r in components.connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent if any(x in (a, b) and a != b for a, b in links)}
    assert components.connected(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.fixture
def nodes(monkeypatch):
    """Messages go by way of nodes, as they do from some thousand groups on."""
    monkeypatch.setattr(routing, "DIRECT", 1)
    for module in (katz, ngram_join, suffixes):
        monkeypatch.setattr(module, "GROUP_BYTES", 4000)


def test_routes():
    for n in (1, 2, 7, 1025, 10**6):
        r = routing.Route(n)
        assert (r.fan > 1) == (n > 1024) and r.fan * r.ranges >= n


def test_language_model_by_way_of_nodes(docs, nodes):
    test_katz(docs, 3)


def test_ngram_join_by_way_of_nodes(docs, nodes):
    test_ngram_join(docs, 4, 85)


def test_suffix_dedup_by_way_of_nodes(docs, none, nodes):
    test_suffix_dedup(docs, none)


# --- 1 ---------------------------------------------------------------------------------------------------------

def test_language_id(spark, docs, none):
    rng = random.Random(2)
    make = {"aa": "the of and with this", "bb": "der und nicht ein ist", "cc": "le la que dans été"}
    rows = [(i, " ".join(rng.choice(make[lang].split()) for _ in range(rng.randint(1, 40))), lang) for i, lang in enumerate(sorted(make) * 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df.where("doc_id % 4 <> 0"))
    got = langid.predict(df, model).join(df, "doc_id").where("doc_id % 4 = 0")
    assert got.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()[0] > 0.95
    odd = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    for d in (3000, 3001, 3002, 3009):
        assert (odd[d].lang_pred, odd[d].score, odd[d].accepted) == ("und", 0.0, False)
    assert langid.predict(docs, model).count() == len(ROWS)
    assert langid.fit(none) is None
    assert {r.lang_pred for r in langid.predict(docs, None).collect()} == {"und"}


def test_rejection_bound():
    score, right = np.array([.9, .8, .7, .6]), np.array([True, True, False, True])
    assert langid.rejection_bound(score, right, 0.01) == 0.8
    assert langid.rejection_bound(score, ~right, 0.01) == 1.0


# --- 2 ---------------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("k, percent", [(4, 85), (5, 80), (2, 50)])
def test_ngram_join(docs, k, percent):
    want = fx.components(ROWS, k, percent)
    expected = Counter((r[0], len(fx.shingles(r[1], k)), want[i]) for i, r in enumerate(ROWS))
    assert Counter(tuple(r) for r in ngram_join.components_of(docs, k, percent).collect()) == expected


def test_ngram_join_of_chains_and_dense_groups(spark):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(150):  # near copies around several similarities
        edit = list(base)
        for _ in range(rng.randint(0, 4)):
            edit[rng.randrange(60)] = f"e{rng.randrange(40)}"
        rows.append((i, " ".join(edit)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = fx.components(rows, 4, 85)
    assert {r.doc_id: r.component_id for r in ngram_join.components_of(df).collect()} == {rows[i][0]: c for i, c in want.items()}


def test_one_of_each_goes_by_id_and_text(spark):
    base = [f"w{i}" for i in range(60)]
    near = " ".join(base[:-1] + ["x"])
    rows = [(1, " ".join(base)), (5, near), (5, "quite another text that has no copy at all"), (7, near), (9, "alone here it is"), (9, "alone here it is"),
            (11, " ".join(base[::-1])), (11, " ".join(base[:1:-1]))]
    got = Counter((r.doc_id, r.text) for r in ngram_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got.pop((1, rows[0][1])) == got.pop((5, rows[2][1])) == got.pop((9, rows[4][1])) == 1
    assert len(got) == 1 and next(iter(got))[0] == 11 and sum(got.values()) == 1  # two texts of one id in one component: one stays


def test_one_of_each(docs, none):
    got = ngram_join.one_of_each(docs)
    assert got.columns == docs.columns
    want = fx.components(ROWS, 5, 80)
    keep = Counter(r[0] for i, r in enumerate(ROWS) if r[0] is None or want[i] == r[0])
    keep[3009] = 1  # the repeated row
    assert Counter(r.doc_id for r in got.collect()) == keep
    assert ngram_join.one_of_each(none).count() == 0
    assert ngram_join.components_of(none).count() == 0


# --- 3 ---------------------------------------------------------------------------------------------------------

def brute_katz(rows, train, order):
    """Katz backoff by its definition, a call for each history."""
    tokens = [fx.words(t) + [None] for t in rows]
    counts = [Counter() for _ in range(order + 1)]  # of each order's n-grams; a history may begin with the start
    for t, own in zip(tokens, train):
        if own:
            whole = ["<s>", *t]
            for i in range(1, len(whole)):
                counts[1][whole[i],] += 1
                for k in range(2, min(order, i + 1) + 1):
                    counts[k][tuple(whole[i - k + 1:i + 1])] += 1
    d = [None] + [katz.discounts(Counter(c.values())) for c in counts[1:]]
    kept = lambda k, r: r * d[k][min(r, katz.DISCOUNTED + 1)]
    total = sum(counts[1].values())
    size = total + (0 if any(kept(1, r) < r for r in counts[1].values()) else 1)
    unknown = 1 - sum(kept(1, r) for r in counts[1].values()) / size
    after = defaultdict(list)
    for c in counts[2:]:
        for g, r in c.items():
            after[g[:-1]].append((g[-1], r))
    seen = {}

    def of(h):
        if h not in seen:
            k = len(h) + 1
            n = sum(r for _, r in after[h]) + (0 if any(kept(k, r) < r for _, r in after[h]) else 1)
            seen[h] = n, (1 - sum(kept(k, r) for _, r in after[h]) / n) / (1 - sum(p(h[1:], w) for w, _ in after[h]))
        return seen[h]

    def p(h, w):
        if not h:
            return kept(1, counts[1][w,]) / size if (w,) in counts[1] else unknown
        if h not in after:
            return p(h[1:], w)
        k = len(h) + 1
        return kept(k, counts[k][*h, w]) / of(h)[0] if (*h, w) in counts[k] else of(h)[1] * p(h[1:], w)
    for h in random.Random(1).sample(sorted(after, key=str), min(60, len(after))):
        assert abs(sum(p(h, w) for w, in counts[1]) + p(h, "never seen") - 1) < 1e-9
    out = []
    for t in tokens:
        whole = ["<s>", *t]
        out.append((len(t), sum((w,) in counts[1] for w in t), total, sum(math.log10((counts[1][w,] + 1) / (total + len(counts[1]) + 1)) for w in t),
                    sum(math.log10(p(tuple(whole[max(0, i - order + 1):i]), whole[i])) for i in range(1, len(whole)))))
    return out


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_katz(docs, order):
    train = [r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 != 2 for r in ROWS]
    got = sorted((tuple(r) for r in katz.score(docs, queries.id_hash(7) != 2, order).select(
        "doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()), key=str)
    want = sorted(((r[0], *x) for r, x in zip(ROWS, brute_katz([r[1] for r in ROWS], train, order))), key=str)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert np.allclose([g[4:] for g in got], [w[4:] for w in want], rtol=1e-9)


def test_katz_takes_counts_and_names_beyond_32_bits():
    big = np.array([2**40 + 3, 5, 2**33], np.uint64)
    row = lambda g, n: {"g": g, "part": 0, "a": packing.pack_sorted(np.array([1, 2, 3], np.uint64)), "b": packing.pack(np.array([n, 1, 0], np.uint64))}
    _, total, _ = katz._distinct_words([row(0, 2**40), row(1, 2**40 + 1)])
    assert total.tolist() == [2**41 + 1, 2, 0]
    ask = {"part": 0, "a": packing.pack_sorted(np.array([2**40, 2**40 + 2**33], np.uint64)), "b": packing.pack(np.array([2, 1], np.uint32)),
           "c": packing.pack(np.array([3, 1], np.uint64)), "d": packing.pack(np.array([7, 7 + 2**32, 7], np.uint64)), "e": packing.pack(big),
           "f": packing.pack(big[:2]), "h": packing.pack(big)}
    c = katz._Counted([ask, ask])
    assert c.count.tolist() == (2 * big.astype(np.int64)).tolist() and c.history.tolist() == [2**40, 2**40 + 2**33]
    assert c.sums(np.ones(7))[0].tolist() == [2**41 + 16, 2**34] and c.lower_count.tolist() == big.tolist()


def test_katz_without_training(docs, none):
    assert {r.score for r in katz.score(docs, F.lit(False)).collect()} == {0.0}
    assert katz.score(none, F.lit(True)).count() == 0


# --- 4 ---------------------------------------------------------------------------------------------------------

def test_fingerprints(spark, docs, none):
    rows = [r for r in ROWS if r[0] not in (None, 3009)]
    got = by_id(fingerprints.compare_edits(docs.where("doc_id is not null and doc_id <> 3009")))
    order = sorted(rows, key=lambda r: -r[0])
    for i, r in enumerate(order):
        own, nxt = r[1] or "", order[(i + 1) % len(order)][1] or ""
        edited = own[:len(own) - len(own) // 2] + nxt[:len(own) // 2]
        g = next(x for x in got if x[0] == r[0])
        assert g[1:3] == (len(own), hashlib.sha256(edited.encode()).hexdigest())
        a, b = fx.shingles(own, 5), fx.shingles(edited, 5)
        assert abs(g[5] - (len(a & b) / len(a | b) if a or b else 1)) < 0.2
    prints = {r[0]: r[3] for r in got}
    assert prints[3003] == prints[3004] and prints[2000] == prints[2001] and prints[3000] == prints[3001]
    assert fingerprints.compare_edits(docs).count() == len(ROWS)
    assert fingerprints.compare_edits(none).count() == 0
    one = spark.createDataFrame([(5, "abcd")], "doc_id long, text string")
    assert fingerprints.compare_edits(one).first().edited_sha256 == hashlib.sha256(b"abab").hexdigest()


def test_near_duplicates(docs, none):
    want = fx.components(ROWS, 5, 80)
    expected = Counter((r[0], len(fx.shingles(r[1], 5)), want[i]) for i, r in enumerate(ROWS))
    assert Counter(tuple(r) for r in fingerprints.near_duplicates(docs).collect()) == expected
    assert fingerprints.near_duplicates(none).count() == 0


def test_near_duplicates_of_families_loses_no_link(spark):
    """Families whose texts are just below the bound to each other, with planted links just above it."""
    rng = random.Random(12)
    rows, n = [], 0
    for family in range(3):
        base = [f"f{family}w{i}" for i in range(90)]
        for _ in range(60):
            text = base + [f"own{rng.randrange(10**9)}" for _ in range(8)]
            rows.append((n, " ".join(text)))
            n += 1
            if rng.random() < 0.3:
                edit = list(text)
                edit[-rng.randint(1, 2)] = f"e{rng.randrange(10**9)}"
                rows.append((n, " ".join(edit)))
                n += 1
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = fx.components(rows, 5, 85)
    got = {r.doc_id: r.component_id for r in fingerprints.near_duplicates(df, percent=85).collect()}
    assert got == {rows[i][0]: c for i, c in want.items()} and len(set(want.values())) > 20


# --- 5 ---------------------------------------------------------------------------------------------------------

def brute_tiles(doc, item, least):
    """Greedy string tiling by looking at every pair of places."""
    ma, mb, covered = [False] * len(doc), [False] * len(item), 0
    while True:
        best, found = least - 1, []
        for i in range(len(doc)):
            for j in range(len(item)):
                n = 0
                while i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n] and not ma[i + n] and not mb[j + n]:
                    n += 1
                if n > best:
                    best, found = n, [(i, j)]
                elif n == best and n >= least:
                    found.append((i, j))
        if not found or best < least:
            return covered
        for i, j in found:
            if not any(ma[i:i + best]) and not any(mb[j:j + best]):
                ma[i:i + best], mb[j:j + best] = [True] * best, [True] * best
                covered += best


def test_tiles_match_brute_force():
    rng = random.Random(4)
    for _ in range(60):
        item = [rng.randrange(8) for _ in range(rng.randint(1, 25))]
        doc = [rng.randrange(8) for _ in range(rng.randint(0, 30))] + item[5:] + item[:5]
        a, b = (np.array(x, np.uint64) + np.uint64(10) for x in (doc, item))
        t = decontaminate.tiles(a, b, 3)
        for i, j, n in t:
            assert (a[i:i + n] == b[j:j + n]).all()
        assert len({x for i, _, n in t for x in range(i, i + n)}) == sum(n for *_, n in t) == len({x for _, j, n in t for x in range(j, j + n)})
        assert sum(n for *_, n in t) == brute_tiles(doc, item, 3)


def test_decontamination(spark, docs, none):
    item = " ".join(f"Word{i}" for i in range(24))
    mixed = " ".join(item.split()[12:] + ["and"] + item.split()[:12])  # reordered halves
    bench = spark.createDataFrame([(1, item), (2, None), (3, "too short"), (1, item), (4, " "), (None, "word20 word21 word22 word23 end")], "item_id long, text string")
    held = spark.createDataFrame([(9001, "say " + item.upper() + " end"), (9002, mixed), (9003, " ".join(item.split()[:8])), (9004, None), (9005, "it is TOO  short"),
                                  (9006, "too"), (9003, "short too"), (None, item), (9002, mixed)], "doc_id long, TEXT string")
    got = decontaminate.matches(held, bench).collect()
    assert Counter((r.doc_id, r.item_id, round(r.coverage, 2), len(r.tiles)) for r in got) == Counter(
        {(9001, 1, 1.0, 1): 2, (9002, 1, 1.0, 2): 4, (None, 1, 1.0, 1): 2, (9005, 3, 1.0, 1): 1, (9001, None, 1.0, 1): 1})
    assert Counter(r.doc_id for r in decontaminate.clean(held, bench).collect()) == Counter([9003, 9003, 9004, 9006])
    got = decontaminate.clean(docs, bench)
    assert got.count() == len(ROWS) and got.columns == docs.columns
    assert decontaminate.matches(none, bench).count() == 0 and decontaminate.matches(docs, bench.limit(0)).count() == 0
    assert decontaminate.clean(docs, bench.limit(0)).count() == len(ROWS)


def test_decontamination_equals_brute_force(spark, monkeypatch):
    """Every pair of document and item tiled, against the seed join; a tiny map of seeds changes nothing."""
    rng = random.Random(21)
    vocab = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([1, 3, 4, 5, 9, 14, 30])))) for i in range(25)]
    docs = []
    for d in range(120):
        words = [rng.choice(vocab) for _ in range(rng.randint(0, 60))]
        if d % 3 == 0:  # a reordered or shortened passage
            w = rng.choice(items)[1].split()
            k = rng.randint(0, len(w))
            words[5:5] = w[k:] + ["x"] * (d % 2) + w[:k]
        docs.append((d, " ".join(words)))
    code = {}

    def coded(text):
        return np.array([code.setdefault(w, len(code) + 1) for w in text.split()], np.uint64)
    want = set()
    for d, text in docs:
        for i, item in items:
            a, b = coded(text), coded(item)
            if len(b) < 5:
                if any((a[k:k + len(b)] == b).all() for k in range(len(a) - len(b) + 1)):
                    want.add((d, i, len(b)))
            elif (c := brute_tiles(a, b, 5)) >= 0.5 * len(b):
                want.add((d, i, c))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = lambda: {(r.doc_id, r.item_id, r.covered_words) for r in decontaminate.matches(df, bench).collect()}
    assert found() == want and len(want) > 40
    monkeypatch.setattr(decontaminate, "FILTER_BITS", 15)
    assert found() == want


def test_a_phrase_that_all_share_joins_nothing(spark):
    """2,000 documents and 300 items share a phrase of eight words: no pair is made; what also shares more is found."""
    rng = random.Random(6)
    word = lambda: f"w{rng.randrange(10**9)}"
    phrase = "we are happy to be here with you"
    items = [(i, " ".join([word() for _ in range(6)] + [phrase] + [word() for _ in range(8)])) for i in range(300)]
    docs = [(d, " ".join([word() for _ in range(20)] + [phrase] + [word() for _ in range(10)])) for d in range(2000)]
    docs += [(5000 + i, f"{word()} {text}") for i, text in items[:20]]
    # The phrase and one seed more of the item: found by that seed alone, and enough words with the phrase.
    docs += [(6000 + i, f"{phrase} {word()} {' '.join(text.split()[-5:])} {word()}") for i, text in items[20:40]]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    with shared.Workspace(spark) as work:
        seeds = work.written(decontaminate.item_seeds(decontaminate._keyed(bench, "item_id", "item_key"), 5), "a")
        mine = work.written(decontaminate.document_seeds(decontaminate._keyed(df, "doc_id", "doc_key"), np.full(1 << (decontaminate.FILTER_BITS - 3), 255, np.uint8), 5, []), "b")
        chosen = work.written(decontaminate.chosen_seeds(seeds, mine, 5, 0.5), "c")
        assert chosen.where("not joined").count() >= 4 * 300
        assert mine.join(chosen.where("joined"), "seed").count() < 20 * 20 * 2
        assert mine.join(chosen, "seed").count() > 4 * 2000 * 300
    got = {(r.doc_id, r.item_id) for r in decontaminate.matches(df, bench).collect()}
    assert got == {(5000 + i, i) for i in range(20)} | {(6000 + i, i) for i in range(20, 40)}


def test_tiles_of_repetitive_texts():
    a = np.array([1, 2] * 20_000, np.uint64)
    found = decontaminate.tiles(a, np.array([1, 2] * 3000 + [3], np.uint64), 5)
    assert sum(n for *_, n in found) == 6000


# --- 6 ---------------------------------------------------------------------------------------------------------

def test_bpe_equals_the_library(spark, docs, none):
    P, T = pytest.importorskip("public_tokenizers"), pytest.importorskip("tokenizers")
    path = P.path("word_bpe_49k.json")
    theirs = T.Tokenizer.from_file(path)
    rng = random.Random(1)
    chars = "aA'sßé ÉΣσςİ  \x1c\x85 ​😀²½٣Ⅷ中あ<|startoftext|>ǅ́x1'll!?"
    texts = [r[1] or "" for r in ROWS] + ["".join(rng.choice(chars) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    texts += ["<|startoftext|>Hi<|endoftext|>", "a<|endoftext|", "ΟΔΟΣ ΟΔΟΣ."] + [
        "".join(chr(rng.choice([rng.randint(1, 0xD7FF), rng.randint(0x10000, 0x1FFFF)])) for _ in range(30)) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in bpe.encode_decode(df, path).collect():
        ids = theirs.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded == theirs.decode(ids, skip_special_tokens=False)
    assert bpe.encode_decode(docs, path).count() == len(ROWS) and bpe.encode_decode(none, path).count() == 0


def test_bpe_with_small_caches_and_long_texts():
    P, T = pytest.importorskip("public_tokenizers"), pytest.importorskip("tokenizers")
    path = P.path("word_bpe_49k.json")
    theirs, small = T.Tokenizer.from_file(path), bpe.ForcedBoundaryBPE(path, cached_bytes=20_000)
    rng = random.Random(4)
    texts = ["hello world " * 30_000, "x" * 50_000, "".join(rng.choice("abcdefg hé") for _ in range(60_000))]
    for t in texts:
        assert np.frombuffer(small.encode(t), np.uint32).tolist() == theirs.encode(t, add_special_tokens=False).ids
        assert small.words.held <= 20_000 and sum(map(len, small.words)) <= 20_000


def test_bpe_ids_beyond_16_bits(tmp_path):
    """A vocabulary whose ids differ in their upper halves only: pairs must not be mixed up."""
    import json
    P = pytest.importorskip("public_tokenizers")
    with open(P.path("word_bpe_49k.json"), encoding="utf-8") as f:
        spec = json.load(f)
    shift = {i: (i << 16) + 7 for i in spec["model"]["vocab"].values()}
    spec["model"]["vocab"] = {t: shift[i] for t, i in spec["model"]["vocab"].items()}
    path = tmp_path / "big.json"
    path.write_text(json.dumps(spec), encoding="utf-8")
    big, own = bpe.ForcedBoundaryBPE(str(path)), bpe.ForcedBoundaryBPE(P.path("word_bpe_49k.json"))
    for t in ("hello world", "The quick brown foxes jump", "éàü 中あ 123"):
        assert np.frombuffer(big.encode(t), np.uint32).tolist() == [shift[i] for i in np.frombuffer(own.encode(t), np.uint32).tolist()]


def test_forced_boundaries_are_certain():
    P = pytest.importorskip("public_tokenizers")
    b = bpe.ForcedBoundaryBPE(P.path("word_bpe_49k.json"))
    assert b.fragments_of("中あ") != [("中あ").encode()]
    for w in ("hello", "ßéx", "中あ", "a"):
        assert b"".join(b.fragments_of(w)) == w.encode()


# --- 7 ---------------------------------------------------------------------------------------------------------

def test_suffix_dedup(docs, none):
    want = sorted(((r[0], len(b), len(b) - len(k), n, hashlib.sha256(k).hexdigest()) for r, (b, k, n) in zip(ROWS, fx.removed(ROWS))), key=str)
    got = sorted((tuple(r)[:5] for r in suffixes.removed(docs).collect()), key=str)
    assert got == want and any(w[2] for w in want)
    assert suffixes.removed(none).count() == 0


def test_suffix_dedup_of_repetitive_texts(spark):
    rng = random.Random(9)
    rows = [(i, "".join(rng.choice("ab") for _ in range(3)) * rng.randint(1, 60) + "ab" * rng.randint(0, 40)) for i in range(30)]
    rows += [(100 + i, "é" * rng.randint(20, 60)) for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {r[0]: (len(b) - len(k), hashlib.sha256(k).hexdigest()) for r, (b, k, _) in zip(rows, fx.removed(rows))}
    assert {r.doc_id: (r.n_removed, r.kept_sha256) for r in suffixes.removed(df).collect()} == want


def test_documents_whose_hashes_agree_are_told_apart(docs, monkeypatch):
    """With a first hash of 20 values, and a second of 30, most documents get a third one; the result is the same."""
    whole = suffixes._hash
    monkeypatch.setattr(suffixes, "_hash", lambda d, t, salt: F.pmod(whole(d, t, salt), F.lit({1: 20, 2: 30}.get(salt, 1 << 62))) + 1)
    want = Counter((r[0], hashlib.sha256(kept).hexdigest()) for r, (_, kept, _) in zip(ROWS, fx.removed(ROWS)))
    assert Counter((r.doc_id, r.kept_sha256) for r in suffixes.removed(docs).collect()) == want
    monkeypatch.setattr(suffixes, "_hash", lambda d, t, salt: F.lit(7).cast("long"))
    with pytest.raises(RuntimeError):
        suffixes.removed(docs)


def test_cleaned_texts(docs):
    got = {(r.doc_id, r.n_chars): r.TEXT for r in suffixes.cleaned(docs).collect()}
    kept = Counter()
    for r, (b, k, _) in zip(ROWS, fx.removed(ROWS)):
        text = None if r[1] is None else k.decode("utf-8", "ignore")
        if not (r[1] and not text):
            kept[r[0]] += 1
            assert any(d == r[0] and t == text for (d, _), t in got.items())
    assert suffixes.cleaned(docs).columns == docs.columns and suffixes.cleaned(docs).count() == sum(kept.values())


def test_long_texts_are_taken_in_pieces(monkeypatch):
    rng = random.Random(3)
    text = "".join(rng.choice("abc ") for _ in range(5000))
    whole = suffixes.anchors(*tb.column_bytes(pa.array([text, text[:60]])))
    monkeypatch.setattr(suffixes, "_PIECE", 700)
    monkeypatch.setattr(tb, "slices", lambda o, most=0: [(i, i + 1) for i in range(len(o) - 1)])
    cut = suffixes.anchors(*tb.column_bytes(pa.array([text, text[:60]])))
    windows = lambda a: {(w, p) for p, lo, hi in zip(*(x.tolist() for x in a[2:])) for w in range(lo, hi + 1)}
    assert windows(whole) == windows(cut)


def test_merge_runs_is_a_sort():
    rng = random.Random(6)
    for runs in range(0, 9):
        data = [sorted({bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 8))) for _ in range(rng.randint(0, 20))}) for _ in range(runs)]
        coded = [(r, [0, *(suffixes._common(x, y, 0) for x, y in zip(r, r[1:]))][:len(r)]) for r in data]
        out = list(suffixes.merge_runs(coded))
        assert [s for s, *_ in out] == sorted(s for r in data for s in r)
        assert all(data[k][i] == s for s, k, i, _ in out)
        for (x, *_), (y, _, _, c) in zip(out, out[1:]):
            assert c == suffixes._common(x, y, 0)


# --- 8 ---------------------------------------------------------------------------------------------------------

PAGES = [(i, f"http://h/{i} é", ("<p>" + "long " * 300 if i % 3 == 0 else f"page {i} " * (i * 20))) for i in range(12)] + [
    (50, None, None), (51, "u", ""), (52, "v", "<p>" + "long " * 300), (52, "v", "<p>" + "long " * 300), (None, "w", "z" * 1200)]


def test_warc_round_trip(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    back = warc.round_trip(df.withColumn("digest", F.lit(1)))
    assert back.where("kind = 'gap'").count() == 0
    head = {}
    for p, _, h in PAGES:
        if p is not None and len((h or "").encode()) >= 1000:
            head[h] = max(head.get(h, p), p)
    want = []
    for p, _, h in PAGES:
        b = (h or "").encode()
        again = head.get(h) not in (None, p) and len(b) >= 1000 and p is not None
        want.append((p, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", head[h] if again else None))
    got = [tuple(r) for r in back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_warc_of_long_and_repeated_pages(spark):
    """A very long page, and one page of which there are many copies."""
    rng = random.Random(3)
    rows = [(1, "u", "".join(rng.choice("abc<>") for _ in range(1_500_000)))] + [(i, "copy", "c" * 2000) for i in range(10, 400)] + [(i, None, "small") for i in range(400, 420)]
    got = {r.page_id: r for r in warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, HTML string").repartition(4)).collect()}
    assert len(got) == len(rows) and got[1].payload_digest == hashlib.sha1(rows[0][2].encode()).hexdigest()
    assert {r.refers_to for p, r in got.items() if 10 <= p < 399} == {399} and got[399].record_type == "response"
    assert {got[i].record_type for i in range(400, 420)} == {"response"}


def test_archive_of_an_earlier_attempt_is_replaced(tmp_path):
    import pyarrow.fs as pafs
    fs = pafs.LocalFileSystem()
    (tmp_path / "part.warc.gz").write_bytes(b"old")
    (tmp_path / ".draft").write_bytes(b"new")
    warc.replace(fs, f"{tmp_path}/.draft", f"{tmp_path}/part.warc.gz")
    assert (tmp_path / "part.warc.gz").read_bytes() == b"new" and not (tmp_path / ".draft").exists()


def test_round_trip_fails_on_a_damaged_archive(spark, monkeypatch):
    monkeypatch.setattr(warc, "read_archives", lambda s, f, payloads: s.createDataFrame([("record", 1), ("gap", None)], "kind string, page_id long"))
    with pytest.raises(RuntimeError):
        warc.round_trip(spark.createDataFrame([(1, "u", "a"), (2, "u", "b")], "page_id long, url string, html string"))


@pytest.mark.parametrize("plain", [False, True])
def test_salvage(plain):
    import gzip
    members = [warc.record(i, f"u{i}", f"payload {i} ".encode() * 40, None, False) for i in range(8)]
    if plain:
        members = [gzip.decompress(m) for m in members]
    good = b"".join(members)
    assert [k for k, *_ in warc.salvage(good)] == ["record"] * 8
    at = [0, *np.cumsum([len(m) for m in members]).tolist()]
    bad = bytearray(good)
    bad[at[3] + len(members[3]) // 2] ^= 0xFF  # a damaged record
    bad = bytes(bad[:at[5] + 10]) + bytes(bad[at[6]:])  # a torn one
    found = list(warc.salvage(b"junk" + bad))
    ids = [f["warc-record-id"] for k, _, _, f in found if k == "record"]
    assert ids == [f"<urn:page:{i}>" for i in (0, 1, 2, 4, 6, 7)]
    assert [k for k, *_ in found].count("gap") == 3
    assert all(x[2] == y[1] for x, y in zip(found, found[1:])) and found[0][1] == 0 and found[-1][2] == len(bad) + 4
    assert list(warc.salvage(b"")) == [] and [k for k, *_ in warc.salvage(b"nothing here")] == ["gap"]


# --- 9 ---------------------------------------------------------------------------------------------------------

def test_hilbert_curve_visits_neighbours():
    for dims, bits in ((2, 3), (3, 2), (4, 2)):
        n = 1 << (dims * bits)
        cells = np.stack([(np.arange(n) >> (bits * d)) & ((1 << bits) - 1) for d in range(dims)], 1)
        index = sharding.hilbert_index(cells, bits)
        assert sorted(index.tolist()) == list(range(n))
        assert (np.abs(np.diff(cells[np.argsort(index)], axis=0)).sum(1) == 1).all()


@pytest.mark.parametrize("law", ["rows", "bytes"])
def test_sharding(docs, none, law):
    got = sharding.shard(docs, 7, law).collect()
    assert len(got) == len(ROWS)
    want = Counter((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in ROWS)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(7))
    if law == "rows":
        assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1 and len(slots) == 7
    assert sharding.shard(none, 7, law).count() == 0


def test_sharding_follows_the_curve(docs):
    """Placement against a plain version: levels, curve index of every row, one sort, cuts."""
    got = sharding.shard(docs, 7, bits=2, dims=("source", "size")).collect()
    size = lambda r: len((r[1] or "").encode()) + 16
    head = {}
    for r in ROWS:
        key = (2**63 - 1 if r[0] is None else r[0], r[3] is not None, r[3] or "")
        head[r[1] or ""] = min(head.get(r[1] or "", key), key)
    place = Counter()
    sources = [head[r[1] or ""][2] if head[r[1] or ""][1] else None for r in ROWS]
    known = sorted(s for s in sources if s is not None)
    cut = lambda values, v: 0 if v is None else sum(v > c for c in {values[max(0, math.ceil(q * len(values) / 4) - 1)] for q in (1, 2, 3)})
    sizes = sorted(map(size, ROWS))
    for r, s in zip(ROWS, sources):
        levels = np.array([[cut(known, s), cut(sizes, size(r))]])
        place[r[0], int(sharding.hilbert_index(levels, 2)[0])] += 1
    assert Counter((r.doc_id, r.curve) for r in got) == place
    order = sorted(got, key=lambda r: (r.shard, r.slot))
    assert [r.curve for r in order] == sorted(r.curve for r in got)
    assert [r.shard for r in order] == sorted(i * 7 // len(ROWS) for i in range(len(ROWS)))


def test_curve_fills_half_grids_one_by_one():
    for dims, bits in ((2, 3), (3, 2), (4, 2), (4, 3)):
        n = 1 << (dims * bits)
        cells = np.stack([(np.arange(n) >> (bits * d)) & ((1 << bits) - 1) for d in range(dims)], 1)
        path = cells[np.argsort(sharding.hilbert_index(cells, bits))]
        for wide in range(1, bits):
            halves = (path >> wide).reshape(1 << (dims * (bits - wide)), -1, dims)
            assert (halves == halves[:, :1]).all()


def test_texts_that_begin_alike_are_told_apart(spark):
    """Sources with a long common beginning, of every dimension the curve has: shards hold few of them."""
    rows = [(i, f"text {i}", "en", f"https://host{i % 8}.example/", 1) for i in range(800)]
    got = sharding.shard(spark.createDataFrame(rows, fx.SCHEMA), 8, dims=("source",)).collect()
    held = defaultdict(set)
    for r in got:
        held[r.shard].add(r.doc_id % 8)
    assert all(len(s) == 1 for s in held.values()) and len(held) == 8
    got = sharding.shard(spark.createDataFrame(rows, fx.SCHEMA), 40).collect()
    held = defaultdict(set)
    for r in got:
        held[r.shard].add(r.doc_id % 8)
    assert sum(map(len, held.values())) < 40 * 4


def test_all_four_dimensions(spark, docs):
    """Every row's cell of the operator's own dimensions from plain quantiles; the curve's order of cells is a curve."""
    got = sharding.shard(docs, 7, bits=2).collect()
    head = {}
    for r in ROWS:
        key = (2**63 - 1 if r[0] is None else r[0], *[x for v in (r[3], r[2]) for x in (v is not None, v or "")])
        head[r[1] or ""] = min(head.get(r[1] or "", key), key)
    size = lambda r: len((r[1] or "").encode()) + 16

    def own(r):
        h, several = head[r[1] or ""], sum((x[1] or "") == (r[1] or "") for x in ROWS) > 1
        if several:
            return [h[2] if h[1] else None, h[4] if h[3] else None, size(r), None if h[0] == 2**63 - 1 else h[0]]
        return [r[3], r[2], size(r), r[0]]
    values = [own(r) for r in ROWS]
    columns = [sorted(v[d] for v in values if v[d] is not None) for d in range(4)]
    cut = lambda known, v: 0 if v is None else sum(v > c for c in {known[max(0, math.ceil(q * len(known) / 4) - 1)] for q in (1, 2, 3)})
    cells = {tuple(cut(k, x) for k, x in zip(columns, v)) for v in values}
    order = {c: int(sharding.hilbert_index(np.array([c]), 2)[0]) for c in cells}
    place = Counter((r[0], order[tuple(cut(k, x) for k, x in zip(columns, v))]) for r, v in zip(ROWS, values))
    assert Counter((r.doc_id, r.curve) for r in got) == place


@pytest.mark.parametrize("law", ["rows", "bytes"])
def test_equal_texts_are_neighbours(docs, law):
    text = {}
    for d, t, *_ in ROWS:
        text.setdefault(d, t or "")
    order = [text[r.doc_id] for r in sorted(sharding.shard(docs, 7, law).collect(), key=lambda r: (r.shard, r.slot))]
    assert all(order.index(t) + order.count(t) == len(order) - order[::-1].index(t) for t in set(order))


@pytest.mark.parametrize("law", ["rows", "bytes"])
def test_written_shards(spark, docs, tmp_path, law):
    sharding.write_shards(docs, f"file://{tmp_path}/s", 4, law)
    back = spark.read.parquet(f"file://{tmp_path}/s")
    assert Counter((r.doc_id, r.TEXT, r["_key"]) for r in back.collect()) == Counter((r[0], r[1], "x") for r in ROWS)
    want = Counter((r.doc_id, r.shard, r.slot) for r in sharding.shard(docs, 4, law).collect())
    assert {k[1:] for k in Counter((r.doc_id, r.shard, r.slot) for r in back.collect())} == {k[1:] for k in want}


# --- 10 --------------------------------------------------------------------------------------------------------

def test_ordinal_classifier(spark, docs, none):
    rng = random.Random(8)
    plain = [f"word{i}" for i in range(80)]
    rows, labels = [], []
    for i in range(600):
        w = [rng.choice(plain) for _ in range(rng.randint(20, 60))]
        kind = i % 3
        if kind == 1:
            for _ in range(4):
                w[rng.randrange(len(w))] = rng.choice(["vile", "rude"])
        text = " ".join(x.upper() + "!!" for x in w) if kind == 0 else " ".join(w)
        rows.append((i, text))
        labels.append((i, int(kind > 0), int(kind == 1)))
    df, rated = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels + [(1, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = ordinal.fit(df, rated.where("doc_id % 4 <> 0 or doc_id is null"))
    assert (np.diff(model.thresholds) > 0).all()
    got = ordinal.score(df, model).join(rated.where("quality is not null"), "doc_id").where("doc_id % 4 = 0").collect()
    right = [r.selected == (r.quality == 1 and r.toxic == 0) for r in got]
    assert sum(right) / len(right) > 0.93
    assert all(0 <= r.tail_2 <= r.tail_1 <= 1 and abs(r.expected_grade - r.tail_1 - r.tail_2) < 1e-9 for r in got)
    assert ordinal.score(docs, model).count() == len(ROWS)
    kept = ordinal.select(docs, model)
    assert kept.columns == docs.columns and kept.where("doc_id = 3000").count() == 1
    assert ordinal.fit(none, rated) is None and ordinal.fit(df, rated.limit(0)) is None
    assert ordinal.select(docs, None).count() == len(ROWS) and {r.selected for r in ordinal.score(docs, None).collect()} == {True}


def test_contract_columns(spark, sf_dir):
    want = {
        "op1_language_id": ["doc_id", "held_out", "lang_pred", "score"], "op2_ngram_jaccard": ["doc_id", "n_shingles", "component_id"],
        "op3_lm_scoring": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        "op4_fingerprints": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        "op6_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"], "op7_suffix_dedup": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        "op8_warc": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
        "op9_sharding": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]}
    for name, columns in want.items():
        got = queries.QUERIES[name](spark, sf_dir)
        assert got.columns[:len(columns)] == columns, name


def test_held_out_language_accuracy(spark, sf_dir):
    got = queries.QUERIES["op1_language_id"](spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id")
    row = got.where("held_out and lang is not null").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert row[1] > 10 and row[0] > 0.95


def test_native_words_agree_with_the_pattern():
    texts = ["a\x0bB\tc d\x85e\xa0f", " ", "É é"]
    raw, offsets = tb.column_bytes(pa.array(texts))
    low = tb.LOWER[raw]
    s, e, f = tb.word_spans(low, offsets)
    got = [[bytes(low[a:b]).decode() for a, b in zip(s[i:j], e[i:j])] for i, j in zip(f, f[1:])]
    assert got == [fx.words(t) for t in texts]
    assert pd.Series(got).map(len).tolist() == [len(re.findall(r"[^\x20\x09-\x0d]+", t)) for t in texts]
