import zlib
from datetime import datetime, timedelta
from itertools import product

import numpy as np

from weft.llm import patterns
from weft.llm.patterns import SECOND, click_events, micros, mine

EVENTS = "client long, t long, type string, pattern string, events string"


def occurs(events, want, gap, span):
    """Whether the types occur in order under the limits, by trying everything."""

    def go(k, first, last):
        return k == len(want) or any(x == want[k] and (k == 0 or (last < t <= last + gap and t - first <= span)) and go(k + 1, t if k == 0 else first, t) for t, x in events)

    return go(0, None, None)


def brute(rows, gap, percent, longest, least, least_percent):
    by = {}
    for c, t, x, *_ in rows:
        if None not in (c, t, x):
            by.setdefault(c, set()).add((t, x))
    types = sorted({x for e in by.values() for _, x in e})
    kept = {}
    for n in range(1, longest + 1):
        for p in product(types, repeat=n):
            who = [c for c, e in by.items() if occurs(e, p, gap * SECOND, gap * SECOND * percent // 100)]
            if len(who) >= least and len(who) * 100 >= least_percent * len(by):
                kept[p] = (len(who), sum(zlib.crc32(str(c).encode()) for c in who))
    inside = lambda a, b: len(a) < len(b) and all(x in it for it in [iter(b)] for x in a)
    return {(">".join(p), len(p), *v, n := sum(inside(p, q) and w[0] == v[0] for q, w in kept.items()), n == 0) for p, v in kept.items()}


def test_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(5)
    monkeypatch.setattr(patterns, "BATCH_EVENTS", 40)
    for seed in range(3):
        rows = [(int(rng.integers(0, 9)) if rng.random() < 0.7 else 4, int(rng.integers(-30, 60)) * 100 * SECOND + int(rng.integers(0, 2)), "abc"[int(rng.integers(0, 3))], "x", None) for _ in range(160)]
        for gap, percent in ((600, 200), (250, 150)):
            got = {tuple(r) for r in mine(spark.createDataFrame(rows, EVENTS), gap, percent, least_percent=30).collect()}
            assert got == brute(rows, gap, percent, 4, 2, 30), seed


def test_limits_and_bin_borders(spark):
    width, us = patterns.BIN_SECONDS, SECOND
    at = width - 100  # the occurrence crosses the border of a bin
    good = [at, at + 500, at + 1000, at + 1200]
    late = [at, at + 500, at + 1000, at + 1200 + 1e-6]  # a microsecond too long
    apart = [at, at + 600.000001, at + 700, at + 800]
    rows = [(c, round(t * us), x, None, None) for c, times in ((1, good), (2, good), (3, late), (4, apart)) for t, x in zip(times, "abcd", strict=True)]
    got = {r.pattern: r.support for r in mine(spark.createDataFrame(rows, EVENTS)).collect()}
    assert got["a>b>c>d"] == 2 and got["a>b>c"] == 3 and got["b>c>d"] == 4 and "b>a" not in got and "a>d" not in got


def test_ties_nulls_and_empty(spark):
    rows = [(1, 5, "a", None, None), (1, 5, "b", None, None), (2, 5, "a", None, None), (2, 6, "b", None, None), (3, 5, "a", None, None), (3, 7, "b", None, None), (3, 7, "b", None, None)]
    rows += [(None, 5, "a", None, None), (1, None, "b", None, None), (1, 9, None, None, None)]
    got = {r.pattern: (r.support, r.n_wider, r.closed) for r in mine(spark.createDataFrame(rows, EVENTS)).collect()}
    assert got == {"a": (3, 0, True), "b": (3, 0, True), "a>b": (2, 0, True)}  # events at one time don't follow each other
    assert mine(spark.createDataFrame([], EVENTS)).count() == 0
    assert mine(spark.createDataFrame(rows[:1], EVENTS)).count() == 0


def test_a_client_with_most_events_is_spread(spark):
    rows = [(7, i * 1000 * SECOND, "a", None, None) for i in range(3000)] + [(8, 0, "a", None, None)]
    held = patterns.bins(spark.createDataFrame(rows, EVENTS), spark.createDataFrame([(0, "a")], "code int, type string"), 1200 * SECOND)
    assert held.where("client = 7").count() > 250 and max(len(r.events) for r in held.collect()) <= 13


def test_clicks(spark):
    from pyspark.sql import functions as F

    hit = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 0)
    miss = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5)
    at = datetime(2024, 3, 31, 2, 30, 0, 123456)  # an hour that some zones leave out
    rows = [(hit, at, 1, "view"), (miss, at, 2, "view"), (None, at, 3, "view"), (hit, None, 1, "view"), (hit, at, None, "view"), (hit, at, 1, None)]
    clicks = spark.createDataFrame(rows, "click_id long, ts timestamp_ntz, client_id long, kind string").withColumn("t", F.lit("clash"))
    t = (at - datetime(1970, 1, 1)) // timedelta(microseconds=1)
    assert sorted(map(tuple, click_events(clicks).collect())) == sorted([(1, t, "view"), (1, t - SECOND, "open"), (1, t + SECOND, "shut"), (2, t, "view"), (3, t, "view")])
    old = spark.sql("SELECT TIMESTAMP_NTZ'1969-12-31 23:59:59.999999' AS ts")
    assert old.select(micros(old, "ts").alias("t")).first().t == -1
