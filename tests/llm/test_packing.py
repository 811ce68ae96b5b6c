import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from weft.llm.packing import boundaries, pack, word_count


def padding(lengths, tops):
    return sum(min(t for t in tops if t >= n) - n for n in lengths)


def test_boundaries_are_the_best():
    rng = random.Random(2)
    for _ in range(40):
        lengths = [rng.choice([1, 2, 3, 5, 8, 13, 40, 41, 90]) for _ in range(rng.randint(1, 30))]
        top, count = np.unique(lengths, return_counts=True)
        for k in (1, 2, 3, 20):
            got = boundaries(top, count, top * count, k)
            best = min(padding(lengths, (*c, top[-1])) for m in range(k) for c in itertools.combinations(top[:-1].tolist(), min(m, len(top) - 1)))
            assert len(got) <= k and padding(lengths, got) == best
    assert boundaries(np.array([]), np.array([]), np.array([]), 4) == []


def check(rows, budget):
    by = {}
    for r in rows:
        assert 0 <= r.n_tokens <= r.bucket and r.padding == r.bucket - r.n_tokens
        by.setdefault((r.bucket, r.batch), []).append(r.place)
    for (bucket, _), places in by.items():
        assert sorted(places) == list(range(len(places)))
        assert len(places) == 1 or len(places) * bucket <= budget or bucket == 0
    for bucket in {b for b, _ in by}:
        own = sorted(n for b, n in by if b == bucket)
        assert own == list(range(len(own)))
        fit = max(1, budget // max(bucket, 1))
        assert all(len(by[bucket, n]) == fit for n in own[:-1])


def test_batches_are_full_and_within_the_budget(docs):
    rng = random.Random(3)
    texts = ["w " * rng.choice([0, 1, 3, 7, 7, 7, 20, 50, 200]) for _ in range(300)]
    for cell_rows in (4096, 10):
        rows = pack(docs(texts), buckets=4, token_budget=100, cell_rows=cell_rows).collect()
        assert {r.doc_id: r.n_tokens for r in rows} == {i: len(t.split()) for i, t in enumerate(texts)}
        check(rows, 100)
        assert len({r.bucket for r in rows}) <= 4
        assert sum(r.padding for r in rows) == padding([len(t.split()) for t in texts], sorted({r.bucket for r in rows}))


def test_every_boundary_is_tried():
    rng = random.Random(4)
    for n, k in ((300, 5), (120, 16)):
        top = np.array(sorted(rng.sample(range(1, 200_000), n)))
        count = np.array([rng.choice([1, 1, 2, 50, 10**10]) for _ in top])
        # brute force over all cuts with whole numbers
        least = {0: [0] + [None] * n}
        for layer in range(1, k + 1):
            least[layer] = list(least[layer - 1])
            for j in range(1, n + 1):
                pad, options = 0, []
                for i in range(j - 1, -1, -1):
                    pad += (int(top[j - 1]) - int(top[i])) * int(count[i])
                    if least[layer - 1][i] is not None:
                        options.append(least[layer - 1][i] + pad)
                if options and (least[layer][j] is None or min(options) < least[layer][j]):
                    least[layer][j] = min(options)
        got = boundaries(top, count, top * count, k)
        assert len(got) <= k and sum((min(t for t in got if t >= a) - int(a)) * int(c) for a, c in zip(top, count, strict=True)) == least[k][n]


def test_long_lengths_are_packed_too(spark):
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("").alias("text"), (F.col("id") * 37 + 1).alias("n"))
    got = pack(rows, buckets=8, length=F.col("n")).collect()
    assert len(got) == 20_000 and len({r.bucket for r in got}) <= 8
    check(got, 65_536)


def test_odd_tables(messy, empty, spark):
    rows = pack(messy).collect()
    assert len(rows) == 13 and {r.doc_id: r.n_tokens for r in rows}[0] == 0
    check(rows, 65_536)
    assert pack(empty).count() == 0
    assert spark.range(1).select(word_count(F.lit(" a\tb\n c ")).alias("n")).first().n == 3


def test_query_counts_tokens(spark):
    import public_tokenizers

    from weft.llm import pieces, queries
    from weft.session import table

    sf = "/root/testdata/sf0.001"
    docs = table(spark, sf, "documents")
    want = {r.doc_id: r.n_pieces for r in pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), with_ids=False).collect()}
    rows = queries.op5_packing(spark, sf).collect()
    assert {r.doc_id: r.n_tokens for r in rows} == want
    assert {r.unit for r in rows} == {"piece_bpe_32k tokens"}
    assert sum(want.values()) > sum(len((r.text or "").split()) for r in docs.collect())
    check(rows, 65_536)
