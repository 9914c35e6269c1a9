"""The registered queries over whole tables against plain versions of what they compute."""
import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docloom.llm import decontaminate, fingerprints, langid, ordinal, queries, textbytes as tb

from . import fixtures as fx
from .test_operators import brute_katz, brute_tiles

MASK = (1 << 64) - 1


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    return [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]


def run(spark, sf_dir, name):
    return queries.QUERIES[name](spark, sf_dir).collect()


def fold(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def plain_mix(x):
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & MASK
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & MASK
    return x ^ (x >> 31)


def plain_sum(data):
    return sum(int(tb.BYTE_CODES[b]) * pow(tb.BASE, i, 1 << 64) for i, b in enumerate(data)) & MASK


def plain_subwords(text):
    """Buckets of the n-grams of 3 to 5 bytes that hold a blank at their ends at most."""
    data = " " + "".join(c if c.isascii() and c.isalpha() or not c.isascii() else " " for c in fx.lower(text)) + " "
    data = data.encode()
    out = []
    for k in langid.ORDERS:
        for i in range(len(data) - k + 1):
            g = data[i:i + k]
            if b" " not in g[1:-1]:
                out.append((plain_sum(g) + k) * tb.BASE % (1 << 64) >> (64 - langid.BUCKET_BITS))
    return Counter(out)


def test_language_features_by_definition():
    texts = ["The quick brown fox!", "", "a", "été à l'eau", "  x  ", "12 ab"]
    bucket, text = langid.subwords(*tb.column_bytes(pa.array(texts)))
    for i, t in enumerate(texts):
        assert Counter(bucket[text == i].tolist()) == plain_subwords(t)


def test_op1_scores_by_definition(spark, sf_dir, rows):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = langid.fit(docs.where(queries.id_hash(4) != 2))
    got = {r.doc_id: r for r in run(spark, sf_dir, "op1_language_id")}
    assert len(got) == len(rows) and {r.held_out == (fold(d, 4) == 2) for d, r in got.items()} == {True}
    for d, text, *_ in rows[:40]:
        n = plain_subwords(text or "")
        if not any(c.isalpha() for c in text or ""):
            assert (got[d].lang_pred, got[d].score) == ("und", 0.0)
            continue
        mean = sum((c * model.embeddings[b].astype(float) for b, c in n.items()), np.zeros(model.embeddings.shape[1])) / max(sum(n.values()), 1)
        z = (mean @ model.layer + model.bias) / model.temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert got[d].lang_pred == model.langs[int(p.argmax())] and abs(got[d].score - p.max()) < 1e-4


def test_many_languages_are_all_learned(spark):
    """More languages than embedding dimensions: none is left out, and both forms of the model agree."""
    rows = [(i, " ".join(f"{chr(97 + i % 20)}{chr(97 + (i * 7 + j) % 5)}x{chr(97 + i % 20)}" for j in range(12)), f"l{i % 20:02}") for i in range(400)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), most_rows=200)
    assert len(model.langs) == 20
    raw = tb.column_bytes(pa.array([r[1] for r in rows[:20]]))
    few = langid.LanguageModel(model.langs, model.embeddings, model.layer, model.bias)
    few.tables, few.last = (model.embeddings @ model.layer).T.astype(float), np.eye(20)
    assert np.allclose(few.logits(*raw), model.logits(*raw), atol=1e-4)
    with pytest.raises(ValueError):
        langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), most_rows=10)


def test_every_language_is_sampled(spark):
    """As many languages as rows allowed, each with a row repeated: all of them are in the sample, once."""
    rows = [(f"word of {i} {j % 2}", f"l{i}") for i in range(3000) for j in range(3)]
    found = langid.sample(spark.createDataFrame(rows, "text string, label string"), 800, 3000).collect()
    assert len(found) == len({r.label for r in found}) == 3000


def test_repeated_rows_do_not_grow_the_sample(spark):
    rows = [(f"only text of {i}", f"l{i}") for i in range(20)] * 2000 + [(f"text {j}", "many") for j in range(5000)] + [("text 1", "many")] * 5000
    df = spark.createDataFrame(rows, "text string, label string").repartition(6)
    found = langid.sample(df, 800, 100_000).collect()
    counts = Counter(r.label for r in found)
    assert len(counts) == 21 and counts["many"] == 800 and len({r.text for r in found}) == len(found) == 820
    # Which texts are taken depends on neither order nor repeats nor ids.
    again = langid.sample(df.distinct().repartition(3), 800, 100_000).collect()
    assert sorted(found) == sorted(again)
    assert Counter(r.label for r in langid.sample(df, 800, 210).collect()) == {**{f"l{i}": 1 for i in range(20)}, "many": 10}


def test_repeated_ids_do_not_grow_the_rated_sample(spark, monkeypatch):
    """An id that most documents share is fitted once, and the fit doesn't depend on the repeats."""
    docs = [(i, f"clean text number {i} about things" if i % 2 else f"junk junk {i} buy now") for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    sizes = []
    whole = ordinal.train
    monkeypatch.setattr(ordinal, "train", lambda rows, grades: (sizes.append(len(grades)), whole(rows, grades))[1])
    one = ordinal.fit(spark.createDataFrame(docs, "doc_id long, text string"), labels)
    many = ordinal.fit(spark.createDataFrame(docs + [docs[7]] * 3000, "doc_id long, text string").repartition(5), labels)
    assert sizes == [60, 60] and np.array_equal(one.weights, many.weights)
    ordinal.fit(spark.createDataFrame(docs + [(7, f"another text {i}") for i in range(3000)], "doc_id long, text string"), labels)
    assert sizes[-1] == 60


def test_op2_components(spark, sf_dir, rows):
    want = fx.components(rows, 4, 85)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in run(spark, sf_dir, "op2_ngram_jaccard")} == {
        (r[0], len(fx.shingles(r[1], 4)), want[i]) for i, r in enumerate(rows)}


def test_op3_scores(spark, sf_dir, rows):
    want = {r[0]: x for r, x in zip(rows, brute_katz([r[1] for r in rows], [fold(r[0], 7) != 2 for r in rows], 3))}
    got = run(spark, sf_dir, "op3_lm_scoring")
    assert len(got) == len(rows)
    for r in got:
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (fold(r.doc_id, 7) == 2, *want[r.doc_id][:3])
        assert math.isclose(r.base_score, want[r.doc_id][3], rel_tol=1e-9) and math.isclose(r.score, want[r.doc_id][4], rel_tol=1e-9)


def plain_fingerprint(text):
    """The least of each permutation over the shingles' hashes, its lower 16 of the upper 32 bits."""
    grams = [int(x) for g in tb.shingles(*tb.column_bytes(pa.array([text])), fingerprints.SHINGLE) for x in g]
    a, b = fingerprints.permutations(fingerprints.PERMS)
    least = [min(((int(x) * g + int(y)) & MASK for g in grams)) >> 32 if grams else 0xFFFFFFFF for x, y in zip(a, b)]
    return "".join(f"{v & 0xFFFF:04x}" for v in least)


def test_op4_fingerprints(spark, sf_dir, rows):
    order = sorted(rows, key=lambda r: -r[0])
    got = {r.doc_id: r for r in run(spark, sf_dir, "op4_fingerprints")}
    assert len(got) == len(rows)
    same = lambda x, y: np.mean([x[i:i + 4] == y[i:i + 4] for i in range(0, len(x), 4)])
    for i, r in enumerate(order):
        own, after = r[1] or "", order[(i + 1) % len(order)][1] or ""
        edited = own[:len(own) - len(own) // 2] + after[:len(own) // 2]
        g = got[r[0]]
        assert (g.n_chars, g.edited_sha256) == (len(own), hashlib.sha256(edited.encode()).hexdigest())
        if i < 25 and len(own) < 3000:
            assert g.fingerprint == plain_fingerprint(own) and g.edited_fingerprint == plain_fingerprint(edited)
            if fx.words(own) and fx.words(edited):
                assert g.near_edited == same(g.fingerprint, g.edited_fingerprint)
        nxt = got[order[(i + 1) % len(order)][0]]
        if fx.words(own) and fx.words(after):
            assert g.near_next == same(g.fingerprint, nxt.fingerprint)


def test_op5_pairs(spark, sf_dir, rows):
    code = defaultdict(lambda: len(code) + 1)
    coded = lambda text: np.array([code[w] for w in fx.words(text)], np.uint64)
    items = [(r.item_id, coded(r.text)) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    want = set()
    for d, text, *_ in rows:
        words = coded(text)
        grams = {tuple(words[i:i + 5].tolist()) for i in range(len(words) - 4)}
        for k, item in items:
            if any(tuple(item[i:i + 5].tolist()) in grams for i in range(len(item) - 4)):
                covered = sum(n for *_, n in decontaminate.tiles(words, item, 5))
                assert len(words) > 400 or covered == brute_tiles(words.tolist(), item.tolist(), 5)
                if covered >= 0.5 * len(item):
                    want.add((d, k, len(item), covered))
    assert {(r.doc_id, r.item_id, r.item_words, r.covered_words) for r in run(spark, sf_dir, "op5_decontamination")} == want and want


def test_op6_ids(spark, sf_dir, rows):
    P, T = pytest.importorskip("public_tokenizers"), pytest.importorskip("tokenizers")
    theirs = T.Tokenizer.from_file(P.path("word_bpe_49k.json"))
    text = {r[0]: r[1] or "" for r in rows}
    got = run(spark, sf_dir, "op6_bpe")
    assert len(got) == len(rows)
    for r in got:
        ids = theirs.encode(text[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(theirs.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_op7_kept_bytes(spark, sf_dir, rows):
    want = {(r[0], len(b), len(b) - len(k), n, hashlib.sha256(k).hexdigest()) for r, (b, k, n) in zip(rows, fx.removed(rows))}
    assert {tuple(r) for r in run(spark, sf_dir, "op7_suffix_dedup")} == want


def test_op9_shards(spark, sf_dir, rows):
    got = run(spark, sf_dir, "op9_sharding")
    want = {(r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in rows}
    assert {(r.doc_id, r["size"], r.text_crc32) for r in got} == want and len(got) == len(rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert set(slots) == set(range(40)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    text = {r[0]: r[1] or "" for r in rows}
    order = [text[r.doc_id] for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    assert all(order.index(t) + order.count(t) == len(order) - order[::-1].index(t) for t in set(order))


def plain_features(text):
    """{bucket: value} of a text, kind by kind."""
    top = lambda h: h >> (64 - ordinal.BITS)
    edge = {c for c in map(chr, range(128)) if not c.isalnum()}
    low = "".join(" " if c in edge else c for c in fx.lower(text))
    words = [w.encode() for w in low.split(" ") if w]
    hashed = lambda x: plain_mix((plain_sum(x) + len(x)) & MASK)
    kinds = [[top(hashed(w)) for w in words]]
    kinds += [[top(plain_mix((plain_sum(w[:k]) + (k << 32)) & MASK)) for w in words if len(w) > k] for k in ordinal.OPENINGS]
    shapes = []
    for w in fx.SPACE.findall(text):
        runs = []
        for b in w.encode():
            c = 65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else b
            if not runs or runs[-1] != c:
                runs.append(c)
        shapes.append(top(hashed(bytes(runs)) ^ 0x5BD1E995))
    kinds.append(shapes)
    out = Counter()
    for kind in kinds:
        for bucket, n in Counter(kind).items():
            out[bucket] += math.sqrt(n / len(kind))
    if not words:
        return out
    again = sum(a == b for a, b in zip(words, words[1:]))
    if again:
        out[1] += math.sqrt(again / len(words))
    out[2 + min(int(math.log2(len(words))), 15)] += 1
    return out


def test_op10_by_definition(spark, sf_dir, rows):
    model = ordinal.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    got = {r.doc_id: r for r in run(spark, sf_dir, "op10_quality_classifier")}
    assert len(got) == len(rows)
    for d, text, *_ in rows[:60]:
        s = sum(v * model.weights[b] for b, v in plain_features(text or "").items())
        tails = [1 / (1 + math.exp(t - s)) for t in model.thresholds]
        tails = {g: p for g, p in zip(model.grades[1:], tails)}
        assert abs(got[d].tail_2 - tails[2]) < 1e-9 and abs(got[d].expected_grade - sum(
            p * (g - b) for (g, p), b in zip(sorted(tails.items()), model.grades))) < 1e-9
        assert got[d].selected == (got[d].tail_2 >= model.cut)


def test_op8_records(spark, sf_dir):
    pages = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html").collect()]
    head = {}
    for p, h in pages:
        head[h] = max(head.get(h, p), p)
    want = set()
    for p, h in pages:
        data = (h or "").encode()
        again = len(data) >= 1000 and head[h] != p
        want.add((p, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", head[h] if again else None))
    assert {tuple(r) for r in run(spark, sf_dir, "op8_warc")} == want


def test_registered_queries_keep_every_row(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/documents.parquet").agg(F.count("*")).first()[0]
    for name in ("op1_language_id", "op2_ngram_jaccard", "op4_fingerprints", "op9_sharding"):
        assert queries.QUERIES[name](spark, sf_dir).select("doc_id").distinct().count() == n, name
