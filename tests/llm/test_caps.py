import numpy as np

from weft.llm import caps
from weft.llm.caps import Code, near_dedup

SCHEMA = "vec_id long, embedding array<float>, label int, v string, rep long, filter long"


def brute(rows, threshold=0.93):
    ids = sorted({r[0] for r in rows})
    by = {r[0]: r for r in rows}
    links = {i: set() for i in ids}
    for i in ids:
        for j in ids:
            a, b = np.array(by[i][1], float), np.array(by[j][1], float)
            if i != j and by[i][2] is not None and by[i][2] == by[j][2] and a @ b / np.sqrt((a @ a) * (b @ b)) >= threshold:
                links[i].add(j)
    out = {}
    for i in ids:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        out[i] = (len(links[i]), min(seen), min(seen) == i)
    return out


def near(rng, x, cosine):
    e = rng.normal(size=x.shape)
    x = x / np.linalg.norm(x)
    e -= (e @ x) * x
    return cosine * x + np.sqrt(1 - cosine**2) * e / np.linalg.norm(e)


def made(rng, n=220, dim=64):
    x = [rng.normal(size=dim) for _ in range(n)]
    for i in range(1, n):
        if rng.random() < 0.5:
            x[i] = near(rng, x[int(rng.integers(0, i))], rng.uniform(0.9, 0.99)) * rng.uniform(0.1, 9)
    ids = rng.permutation(n)
    return [(int(ids[i]), [float(np.float32(v)) for v in x[i]], int(rng.integers(0, 2)), "a", 1, 2) for i in range(n)]


def test_against_brute_force(spark, monkeypatch):
    for block, small in ((1024, 24), (16, 4)):
        monkeypatch.setattr(caps, "BLOCK", block)
        monkeypatch.setattr(caps, "SMALL", small)
        rows = made(np.random.default_rng(block))
        rows += [(500 + i, rows[3][1], rows[3][2], None, None, None) for i in range(40)] + [(600, [0.3] * 64, None, None, None, None)]
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_dedup(spark.createDataFrame(rows, SCHEMA)).collect()}
        assert got == brute(rows)
        assert max(n for n, _, _ in got.values()) >= 40


def test_a_group_of_near_copies_is_dealt_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(caps, "BLOCK", 32)
    rng = np.random.default_rng(8)
    centre = rng.normal(size=64)
    rows = [(i, near(rng, centre, 0.985).tolist(), 1, None, None, None) for i in range(300)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_dedup(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute([(i, [float(np.float32(x)) for x in v], *r) for i, v, *r in rows])


def test_lists_are_the_best_directions():
    made_ = Code(12, 64)
    x = np.random.default_rng(0).normal(size=(20, 12))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for v, found in zip(x, made_.lists(x), strict=True):
        want = []
        for k, (turn, book) in enumerate(zip(made_.turns, made_.books, strict=True)):
            t = v @ turn
            sums = (book[0] @ t[slice(*made_.parts[0])])[:, None] + (book[1] @ t[slice(*made_.parts[1])])[None, :]
            want += (np.argsort(-sums.ravel())[: caps.LISTED] + k * made_.words**2).tolist()
        assert sorted(want) == found.tolist()


def test_recall_of_the_filters():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for filters in (2_000, 200_000, 30_000_000, 10**10):
        code = Code(64, filters)
        y = np.array([near(rng, v, 0.93) for v in x])
        met = [len(np.intersect1d(a, b)) > 0 for a, b in zip(code.lists(x), code.lists(y), strict=True)]
        assert np.mean(met) > 0.995, filters


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(9, [1.0, 0.0], 1), (4, [2.0, 0.01], 1), (4, [2.0, 0.01], 1), (5, [1.0, 0.0], None), (6, None, 1), (7, [0.0, -0.0], 1), (8, [nan, 1.0], 1), (10, [inf, 1.0], 1), (11, [None, 1.0], 1), (12, [], 1), (13, [1.0, 0.0, 0.0], 1), (14, [1.0], 1), (15, [3.0], 1), (16, [-1.0], 1), (None, [1.0, 0.0], 1), (17, [1.0, 0.0], 2)]
    table = spark.createDataFrame([(i, v, n, None, None, None) for i, v, n in rows], SCHEMA)
    got = sorted((r.vec_id is None, r.vec_id, r.n_links, r.component_id, r.kept) for r in near_dedup(table).collect())
    linked = {9: (1, 4, False), 4: (1, 4, True), 14: (1, 14, True), 15: (1, 14, False)}
    assert got == sorted((i is None, i, *linked.get(i, (0, i, i is not None))) for i, *_ in rows)
    assert near_dedup(table.limit(0)).count() == 0
    assert near_dedup(table.where("vec_id = 6")).count() == 1
