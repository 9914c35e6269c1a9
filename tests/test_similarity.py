"""Exact similarity by bounded blocks against all pairs."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.operators import similarity

SCHEMA = "id long, g string, v array<float>"


def cloud(n, size, clusters, noise, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((clusters, size))
    x = centres[rng.integers(0, clusters, n)] + noise * rng.standard_normal((n, size))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32).astype(float)


def awkward(n=90, size=6):
    """Clusters and noise, equal vectors, repeated ids and rows, a vector of length 0, groups of one and none, nulls."""
    x = np.concatenate([cloud(n, size, 4, 0.02), cloud(n, size, 50, 1.0, 2)])
    rows = [(i, "abc"[i % 3], v.tolist()) for i, v in enumerate(x)]
    rows += [(1000 + i, "a", [1.0] + [0.0] * (size - 1)) for i in range(20)] + [(7, "a", (3 * x[5]).tolist()), (8, "b", x[8].tolist()), (8, "b", x[8].tolist())]
    rows += [(2000, "alone", x[0].tolist()), (2001, "pair", x[0].tolist()), (2001, "pair", x[1].tolist()), (2002, "a", [0.0] * size), (2003, None, x[3].tolist()), (2004, "a", None)]
    return rows


@pytest.mark.parametrize("block", [1, 7, 1024])
def test_best_other_equals_all_pairs(spark, block):
    rows = awkward()
    want = sorted((g, i, max(float(np.dot(v, w)) for j, h, w in rows if h == g and j != i and w)) for i, g, v in rows if g and v and any(h == g and j != i and w for j, h, w in rows))
    got = sorted(tuple(r) for r in similarity.best_other(spark.createDataFrame(rows, SCHEMA).repartition(3), "id", "g", 6, "v", block).collect())
    assert [r[:2] for r in got] == [r[:2] for r in want] and np.allclose([r[2] for r in got], [r[2] for r in want], atol=1e-6)


@pytest.mark.parametrize("block", [1, 10, 1024])
def test_best_match_equals_all_pairs(spark, block):
    rows = awkward()
    left, right = [r for r in rows if r[0] % 3], [r for r in rows if r[0] % 3 == 0]
    df = lambda x: spark.createDataFrame(x, SCHEMA)
    want = sorted((i, max(float(np.dot(v, w)) for _, _, w in right if w) if v else 0.0) for i, _, v in left)
    got = sorted(tuple(r) for r in similarity.best_match(df(left), df(right), "id", 6, "v", block).collect())
    assert [r[0] for r in got] == [r[0] for r in want] and np.allclose([r[1] for r in got], [r[1] for r in want], atol=1e-6)
    none = similarity.best_match(df(left), df([]), "id", 6, "v", block).collect()
    assert len(none) == len(left) and {r.similarity for r in none} == {0.0}
    assert similarity.best_match(df([]), df(right), "id", 6, "v", block).collect() == []


def test_negative_products_stay(spark):
    """The best of opposite vectors is below 0."""
    df = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "a", [-1.0, 0.0])], SCHEMA)
    assert [r.similarity for r in similarity.best_other(df, "id", "g", 2, "v", 1).collect()] == [-1.0, -1.0]


def test_most_blocks_of_clusters_never_meet(spark):
    """In tight clusters nearly all pairs of blocks are left out; in noise none may be."""
    share = {}
    for name, clusters, noise in (("clusters", 40, 0.01), ("noise", 1500, 1.0)):
        x = cloud(1500, 16, clusters, noise)
        rows = similarity.numbered(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<float>"), "id", "v", F.lit("all"))
        seen = []
        got = similarity.best_products(rows, rows, 16, exclude=True, block=32, seen=seen).collect()
        p = x @ x.T
        np.fill_diagonal(p, -9)
        assert np.allclose([r.best for r in sorted(got, key=lambda r: r.id)], p.max(1), atol=1e-6)
        share[name] = 1 - seen[1] / seen[0]
    assert share["clusters"] > 0.8, share


def test_equal_vectors_are_split(spark):
    """A vector that most rows have lies in many blocks of bounded size."""
    rows = [(1, "a", [1.0, 0.0])] * 700 + [(i, "a", [0.0, 1.0]) for i in range(100)]
    known = similarity.numbered(spark.createDataFrame(rows, SCHEMA), "id", "v", F.col("g"))
    sizes = [len(r.ids) for r in similarity.blocks(known, 2, 50).select("ids").collect()]
    assert sum(sizes) == 800 and max(sizes) < 100
