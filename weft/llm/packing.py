"""Packing by optimal length buckets: documents of like length share padded batches.

One aggregate gives the global histogram of lengths. Dynamic programming over it picks the bucket
boundaries that minimise padding, the sum over documents of boundary minus length. Inside a bucket
documents are numbered and cut into batches whose padded size stays within a token budget.

The histogram holds every length that occurs, each with its number of documents. As the lengths that occur add up to no more
than all tokens, it has at most sqrt(2 * tokens) rows (122 000 at 30 GB, 7 million at 100 TB, and no more than the
longest document has tokens), and the optimum is over all boundaries.

Numbering doesn't gather a bucket in one task: rows are dealt into cells by a hash of their id,
numbered within the cell, and moved on by the sizes of the bucket's cells before.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.session import materialize

WORD = "[^\\x20\\x09-\\x0D]+"
BLANK = " \t\n\x0b\x0c\r"
BUCKETS = 16
TOKEN_BUDGET = 65_536
CELL_ROWS = 4096


def word_count(text: Column) -> Column:
    """Number of runs without ASCII white space; 0 for null."""
    inner = F.trim(F.coalesce(text, F.lit("")), F.lit(BLANK))
    return F.when(inner == "", F.lit(0)).otherwise(F.size(F.split(inner, "[\\x20\\x09-\\x0D]+"))).cast("long")


def boundaries(top: np.ndarray, count: np.ndarray, total: np.ndarray, buckets: int) -> list[int]:
    """The greatest lengths of the buckets that minimise padding; bins in ascending order, at most so many buckets.

    best[j] is the least padding of the first j bins with the buckets so far. A bucket of bins i..j-1 pads
    top[j-1] * (their documents) - (their lengths), so for a given j the cuts i are lines in top[j-1] with ever smaller
    slopes, asked at ever greater places: their lower hull gives each best[j] in constant time on average. All numbers are
    whole and exact. Ties go to the first cut, and fewer buckets are taken where more don't save anything.
    """
    tops, n = [int(x) for x in top], len(top)
    if not n:
        return []
    c, s = [0], [0]
    for k, t in zip(count, total, strict=True):
        c.append(c[-1] + int(k))
        s.append(s[-1] + int(t))
    best = [0] + [tops[j] * c[j + 1] - s[j + 1] for j in range(n)]
    cuts = [[0] * (n + 1)]
    for _ in range(1, min(buckets, n)):
        new, cut = [0], [0]
        hull: list[tuple[int, int, int]] = []  # (documents before the cut, best + lengths before it, the cut)
        at = 0
        for j in range(1, n + 1):
            c3, b3 = c[j - 1], best[j - 1] + s[j - 1]
            # the middle one of three lines goes if the last one comes under the first no later than it does
            while len(hull) > 1 and (b3 - hull[-2][1]) * (hull[-1][0] - hull[-2][0]) <= (hull[-1][1] - hull[-2][1]) * (c3 - hull[-2][0]):
                hull.pop()
            hull.append((c3, b3, j - 1))
            at, x = min(at, len(hull) - 1), tops[j - 1]
            while at + 1 < len(hull) and hull[at + 1][1] - x * hull[at + 1][0] < hull[at][1] - x * hull[at][0]:
                at += 1
            new.append(hull[at][1] - x * hull[at][0] + x * c[j] - s[j])
            cut.append(hull[at][2])
        if new[n] >= best[n]:
            break
        cuts.append(cut)
        best = new
    out, j = [], n
    for cut in reversed(cuts):
        out.append(tops[j - 1])
        j = cut[j]
        if j == 0:
            break
    return out[::-1]


def pack(docs: DataFrame, buckets: int = BUCKETS, token_budget: int = TOKEN_BUDGET, cell_rows: int = CELL_ROWS, id_col: str = "doc_id", length: Column | None = None, unit: str = "words") -> DataFrame:
    """``doc_id, n_tokens, bucket, batch, place, padding, unit`` for every row.

    ``length`` is the number of tokens of a row, by default its words (null and empty texts: 0, null
    lengths: 0); ``unit`` says what is counted and stands in every row. bucket is the greatest length in the row's bucket, batch the number of its batch there
    (from 0), place its position in the batch (from 0), padding bucket minus n_tokens. A batch holds
    as many rows as fit ``token_budget`` at the padded length, at least one: a longer document is a
    batch of its own. Rows are numbered in the order of cell, id and length; equal rows follow each
    other in either order. Rows with a null id are packed too. An empty table gives no rows; extra
    columns are ignored.
    """
    measure = F.coalesce(length if length is not None else word_count(F.col("text")), F.lit(0)).cast("long")
    rows = materialize(docs.select(F.col(id_col).cast("long").alias("doc_id"), measure.alias("n_tokens")), "lengths")
    found = rows.groupBy("n_tokens").agg(F.count("*").alias("n")).toPandas().sort_values("n_tokens")
    tops = boundaries(found.n_tokens.to_numpy(), found.n.to_numpy(), found.n_tokens.to_numpy() * found.n.to_numpy(), buckets) or [0]
    cells = max(1, math.ceil(float(found.n.sum()) / cell_rows))
    bucket = F.coalesce(*[F.when(F.col("n_tokens") <= t, F.lit(t)) for t in tops[:-1]], F.lit(tops[-1])).cast("long")
    dealt = rows.select("doc_id", "n_tokens", bucket.alias("bucket"), F.pmod(F.xxhash64("doc_id", "n_tokens"), F.lit(cells)).alias("cell"))
    # at most buckets x cells rows: one for each few thousand documents
    sizes = dealt.groupBy("bucket", "cell").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("bucket").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("bucket", "cell", F.coalesce(before, F.lit(0)).alias("before"))
    number = F.row_number().over(Window.partitionBy("bucket", "cell").orderBy("doc_id", "n_tokens")) - 1
    numbered = dealt.withColumn("number", number).join(sizes, ["bucket", "cell"])
    at = F.col("number") + F.col("before")
    fit = F.greatest(F.lit(1), F.floor(F.lit(token_budget) / F.greatest(F.col("bucket"), F.lit(1)))).cast("long")
    return numbered.select("doc_id", "n_tokens", "bucket", F.floor(at / fit).cast("long").alias("batch"), F.pmod(at, fit).cast("long").alias("place"), (F.col("bucket") - F.col("n_tokens")).alias("padding"), F.lit(unit).alias("unit"))
