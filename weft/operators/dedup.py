"""Duplicate pages: cosine pairs, nearest neighbours, clusters, whitelist and batches; and page merges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.operators.components import connected_components
from weft.session import materialize

THRESHOLD, TOP_K, MOST_PAGES, LEAST_COVERAGE = 0.68, 8, 5_000, 0.8
BLOCK_ROWS = 4_096


def coverage(pages: DataFrame, vector: str = "vector") -> DataFrame:
    """One row: pages, how many have a vector, their share, and whether that allows a scan."""
    seen = pages.agg(F.count("*").alias("pages"), F.count(vector).alias("embedded"))
    share = F.col("embedded") / F.greatest("pages", F.lit(1))
    return seen.select("pages", "embedded", share.alias("coverage"), ((share >= LEAST_COVERAGE) & (F.col("embedded") >= 2)).alias("enough"))


def cosine_pairs(table: DataFrame, threshold: float = THRESHOLD, top_k: int | None = None, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """(a, b, similarity) of all pairs a < b with a cosine of ``threshold`` or more; with ``top_k`` only pairs that are
    among the k nearest of one of the two.

    An all-pairs comparison by blocks: rows are dealt into blocks by a hash, each pair of blocks is one matrix product
    in a task of its own. With n rows and blocks of ``BLOCK_ROWS``, each row is sent to n / BLOCK_ROWS tasks. Vectors
    that are null, zero, or not finite match nothing.
    """
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    usable = F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.where(usable).withColumn("d", F.size("v"))
    blocks = max(1, -(-rows.count() // BLOCK_ROWS))
    mine = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    sent = mine.select("id", "v", "d", "block", other.alias("o"))
    sent = sent.select("id", "v", "d", F.least("block", "o").alias("x"), F.greatest("block", "o").alias("y"), (F.col("block") <= F.col("o")).alias("left"), (F.col("block") >= F.col("o")).alias("right"))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        m = np.array(part.v.tolist(), float)
        m /= np.sqrt((m * m).sum(1, keepdims=True))
        left, right, ids = part.left.to_numpy(), part.right.to_numpy(), part.id.to_numpy()
        out = []
        for at in range(0, int(left.sum()), 512):
            i = np.flatnonzero(left)[at : at + 512]
            j = np.flatnonzero(right)
            s = m[i] @ m[j].T
            p, q = np.nonzero(s >= threshold)
            a, b, v = ids[i[p]], ids[j[q]], s[p, q]
            keep = a != b
            out.append(pd.DataFrame({"a": np.minimum(a, b)[keep], "b": np.maximum(a, b)[keep], "similarity": v[keep]}))
        return pd.concat(out) if out else pd.DataFrame({"a": [], "b": [], "similarity": []})

    pairs = sent.groupBy("x", "y", "d").applyInPandas(run, "a long, b long, similarity double").groupBy("a", "b").agg(F.max("similarity").alias("similarity"))
    return pairs if top_k is None else nearest_pairs(pairs, top_k)


def nearest_pairs(pairs: DataFrame, k: int = TOP_K) -> DataFrame:
    """Of pairs (a, b, similarity) those among the k nearest of either end (ties: the smaller id)."""
    ends = pairs.select("a", "b", "similarity").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity"))
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.round("similarity", 12).desc(), "b"))
    best = ends.withColumn("r", rank).where(F.col("r") <= k)
    return best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity").groupBy("a", "b").agg(F.max("similarity").alias("similarity"))


def clusters(pairs: DataFrame) -> DataFrame:
    """(id, cluster): the components of the pairs, named by their smallest id."""
    found = connected_components(pairs.select(F.col("a").alias("u"), F.col("b").alias("v")))
    return found.select(F.col("node").alias("id"), F.col("component").alias("cluster"))


def group_key(ids: Column) -> Column:
    """The canonical key of a group: its ids in lower case, sorted."""
    return F.array_join(F.array_sort(F.transform(ids, lambda x: F.lower(x.cast("string")))), "|")


def drop_whitelisted(groups: DataFrame, whitelist: DataFrame, ids: str = "ids") -> DataFrame:
    """Groups whose canonical key isn't on the whitelist (column ``key``)."""
    return groups.withColumn("_key", group_key(F.col(ids))).join(whitelist.select(F.col("key").alias("_key")).distinct(), "_key", "left_anti").drop("_key")


#: Clusters that ``pack_clusters`` means for a range, a fixed value.
RANGE_CLUSTERS = 250_000


def _batch_steps(sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of clusters on a line, and for each which one begins the next batch if it begins one (their number: one behind them).

    The next batch begins at the first cluster that ends beyond ``most`` members from the start, and beyond the first cluster itself."""
    ends = np.cumsum(sizes)
    starts = ends - sizes
    return starts, ends, np.searchsorted(ends, np.maximum(starts + most, ends), side="right")


def _range_function(sizes: np.ndarray, most: int) -> tuple[list[int], list[int]]:
    """What a range of clusters makes of each number of members that a batch from before may still reach into it, from 0 to ``most`` - 1: how far its own last
    batch reaches into the next range, and how many batches begin in it."""
    starts, ends, to = _batch_steps(sizes, most)
    reach, begun = np.arange(most), np.zeros(most, int)
    at = np.searchsorted(ends, reach, side="right")
    while (on := at < len(sizes)).any():
        now = at[on]
        reach[on], at[on] = np.maximum(starts[now] + most, ends[now]), to[now]
        begun[on] += 1
    return (reach - ends[-1]).tolist(), begun.tolist()


def pack_clusters(members: DataFrame, most: int = 80) -> DataFrame:
    """(id, cluster, batch): clusters in order fill batches of at most ``most`` members; none is split, a larger one stands alone.

    The greedy fold, in parallel. Clusters are dealt in order into ranges of a bounded number. Of the batches before it a range needs to know only how many
    members the last one still reaches over, which is less than ``most``: so each range works out for each such number what it hands on, all ranges at once. The
    driver follows one number from range to range (a row of ``most`` small numbers for each), then all ranges number their batches at once.
    Rows without a cluster have no batch and are left out; ids may repeat."""
    rows = members.where("cluster is not null")
    spark = rows.sparkSession
    sizes = materialize(rows.groupBy("cluster").agg(F.count("*").alias("n")), "sizes")
    n_ranges = max(spark.sparkContext.defaultParallelism, -(-sizes.count() // RANGE_CLUSTERS))
    line = materialize(sizes.repartitionByRange(n_ranges, "cluster").withColumn("range", F.spark_partition_id()), "line")

    def hand_on(part: pa.Table) -> pa.Table:
        part = part.sort_by("cluster")
        reach, begun = _range_function(part.column("n").to_numpy(), most)
        return pa.table({"range": part.column("range").slice(0, 1), "reach": pa.array([reach], pa.list_(pa.int64())), "begun": pa.array([begun], pa.list_(pa.int64()))})

    functions = materialize(line.groupBy("range").applyInArrow(hand_on, "range int, reach array<long>, begun array<long>"), "functions")
    over, batch, entries = 0, 0, []
    for r in functions.orderBy("range").toLocalIterator():
        entries.append((r.range, over, batch))
        over, batch = r.reach[over], batch + r.begun[over]
    entered = F.broadcast(spark.createDataFrame(entries, "range int, over long, before long"))  # one row for each range

    def number(part: pa.Table) -> pa.Table:
        part = part.sort_by("cluster")
        _, ends, to = _batch_steps(part.column("n").to_numpy(), most)
        over, before = (part.column(c)[0].as_py() for c in ("over", "before"))
        at, first = int(np.searchsorted(ends, over, side="right")), np.zeros(len(ends), int)
        while at < len(first):
            first[at], at = 1, to[at]
        return pa.table({"cluster": part.column("cluster"), "batch": pa.array(before - 1 + np.cumsum(first), pa.int32())})

    kind = line.schema["cluster"].dataType.simpleString()
    numbered = line.join(entered, "range").groupBy("range").applyInArrow(number, f"cluster {kind}, batch int")
    return rows.join(numbered, "cluster").select("id", "cluster", "batch")


def near_duplicates(pages: DataFrame, threshold: float = THRESHOLD, top_k: int = TOP_K) -> DataFrame:
    """(id, cluster) of pages (id, vector): pairs by cosine among the nearest, then components."""
    return clusters(materialize(cosine_pairs(pages, threshold, top_k), "pairs"))


# ---- merges


def union_ci(*lists: Column) -> Column:
    """Union of string arrays without regard to case; the first spelling stays, in order of first sight."""
    every = F.concat(*[F.coalesce(x, F.array().cast("array<string>")) for x in lists])
    return F.aggregate(every, F.array().cast("array<string>"), lambda out, x: F.when(F.exists(out, lambda y: F.lower(y) == F.lower(x)), out).otherwise(F.array_append(out, x)))


def except_ci(items: Column, gone: Column) -> Column:
    return F.filter(items, lambda x: F.lower(x) != F.lower(gone))


def delete_decision(sources: Column, gone: Column) -> Column:
    """What becomes of a page when a source goes: skip if it doesn't name it, delete if it names nothing else, else keep."""
    left = except_ci(sources, gone)
    decision = F.when((F.size(sources) == 0) | (F.size(left) == F.size(sources)), "skip").when(F.size(left) == 0, "delete").otherwise("keep")
    return F.struct(decision.alias("decision"), left.alias("left"))


def merge_pages(old: DataFrame, new: DataFrame, least_share: float = 0.7) -> DataFrame:
    """Pages (path, type, title, created, sources, tags, related, body) after a rewrite.

    Lists are united, type, title and created stay as they were, and a new body shorter than ``least_share`` of the
    longer one is turned down: both bodies are kept, the old one first. New pages come as they are."""
    o = old.select("path", *[F.col(c).alias(f"o_{c}") for c in ("type", "title", "created", "sources", "tags", "related", "body")])
    rows = o.join(new, "path", "full_outer")
    known = F.col("o_body").isNotNull()
    longer = F.greatest(F.char_length("o_body"), F.char_length("body"))
    body = F.when(~known, F.col("body")).when(F.col("body").isNull(), F.col("o_body")).when(F.char_length("body") >= least_share * longer, F.col("body")).otherwise(F.concat_ws("\n\n", "o_body", "body"))
    locked = [F.coalesce(f"o_{c}", c).alias(c) for c in ("type", "title", "created")]
    united = [union_ci(F.col(f"o_{c}"), F.col(c)).alias(c) for c in ("sources", "tags", "related")]
    return rows.select("path", *locked, *united, body.alias("body"))


def rewrite_links(content: Column, redirects: dict[str, str]) -> Column:
    """Links to old pages lead to the new ones; aliases stay."""
    import re as _re

    for old, new in sorted(redirects.items()):
        content = F.regexp_replace(content, rf"(?i)\[\[\s*{_re.escape(old)}\s*(\|[^\]]*)?\]\]", f"[[{new}$1]]")
    return content


def remap_list(items: Column, redirects: dict[str, str]) -> Column:
    """A list of page ids after a merge, each once."""
    if not redirects:
        return items
    table = F.create_map(*[x for k, v in redirects.items() for x in (F.lit(k.lower()), F.lit(v))])
    return union_ci(F.transform(items, lambda x: F.coalesce(table[F.lower(x)], x)))


def drop_index_lines(content: Column, ids: list[str]) -> Column:
    """An index without the list items that refer to these pages, by [[id]], [[id|..]] or (id.md)."""
    import re as _re

    either = "|".join(map(_re.escape, ids))
    bad = rf"(?i)^\s*[-*]\s.*(\[\[({either})(\|[^\]]*)?\]\]|\((\.?/)?([^)\s]*/)?({either})\.md\))"
    return F.array_join(F.filter(F.split(content, "\n"), lambda line: ~line.rlike(bad)), "\n")


# ---- embedding


def embed(rows: DataFrame, embedder, text_col: str = "text", batch: int = 64, dim: int | None = None, tries: int = 3, least_bytes: int = 64) -> DataFrame:
    """``rows`` with ``vector`` and ``error``: an injected function from texts to vectors, called for batches.

    A batch that fails is tried text by text; a text that fails is halved up to ``tries`` times, not below ``least_bytes``. Wrong
    counts, lengths and values that aren't finite are errors of the row, not of the job."""
    names = rows.columns

    def one(text: str) -> tuple[list[float] | None, str | None]:
        error = ""
        for _ in range(tries + 1):
            try:
                v = [float(x) for x in embedder([text])[0]]
                if not v or not np.isfinite(v).all() or (dim and len(v) != dim):
                    return None, "invalid vector"
                return v, None
            except Exception as e:  # noqa: BLE001 - an external function
                error = str(e)
                if len(text.encode()) <= least_bytes:
                    break
                text = text[: len(text) // 2]
        return None, error

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, batch):
                some = b.slice(at, batch)
                texts = [t or "" for t in some.column(names.index(text_col)).to_pylist()]
                try:
                    got = [[float(x) for x in v] for v in embedder(texts)]
                    if len(got) != len(texts) or any(not v or not np.isfinite(v).all() or (dim and len(v) != dim) for v in got):
                        raise ValueError("invalid answer")
                    found = [(v, None) for v in got]
                except Exception:  # noqa: BLE001
                    found = [one(t) for t in texts]
                yield pa.record_batch([*some.columns, pa.array([v for v, _ in found], pa.list_(pa.float64())), pa.array([e for _, e in found], pa.string())], names=[*names, "vector", "error"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{schema}, vector array<double>, error string")
