import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.llm.vptree import Tree, inner, nearest

SCHEMA = "vec_id long, embedding array<float>, kind string, v string"


def brute(ids, vectors, queries, k):
    out = {}
    for q in queries:
        scores = inner(np.repeat(vectors[[q]], len(ids), axis=0), vectors)
        out[ids[q]] = sorted(((-s, i) for s, i in zip(scores, ids, strict=True) if i != ids[q]))[:k]
    return out


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(10, 32))
    x = (centres[rng.integers(0, 10, 3000)] + rng.normal(size=(3000, 32))).astype(np.float32)
    x[100:400] = x[7]  # one vector many times
    return np.arange(3000), x.astype(float)


def test_factor_one_is_exact_and_less_keeps_recall(spark, clustered):
    ids, x = clustered
    want = brute(ids, x, [i for i in ids if i % 20 == 0], 10)
    table = spark.createDataFrame([(int(i), v.tolist(), "a", "b") for i, v in zip(ids, x, strict=True)], SCHEMA)
    for relax, least in ((1.0, 1.0), (0.5, 0.9)):
        got = {}
        for r in nearest(table, F.col("vec_id") % 20 == 0, 10, relax, shard_rows=200).collect():
            got.setdefault(r.query_id, []).append((r.rank, -r.score, r.vec_id))
        got = {q: [(s, i) for _, s, i in sorted(v)] for q, v in got.items()}
        assert got.keys() == want.keys()
        if least == 1.0:
            assert got == want
        assert np.mean([len({i for _, i in got[q]} & {i for _, i in want[q]}) / 10 for q in want]) >= least


def test_pruning_passes_over_leaves():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(np.eye(4)[c], 0.01, size=(200, 4)) for c in range(4)])
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    tree = Tree(np.arange(800), x, 5, 50)
    list(tree.search(np.array([3]), x[[3]], 1.0))
    assert 0 <= tree.visits <= len(tree.leaves) // 2


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 0.5]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, []), (None, [1.0, 1.0]), (2, [0.5, 0.5]), (9, [1.0, 2.0, 3.0])]
    table = spark.createDataFrame([(i, v, None, None) for i, v in rows], SCHEMA)
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in nearest(table, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 20, 1.0), (0, 3, 2, 0.5), (20, 1, 0, 1.0), (20, 2, 1, 1.0), (20, 3, 2, 0.5)]
    assert nearest(table.limit(0), F.lit(True)).count() == 0
