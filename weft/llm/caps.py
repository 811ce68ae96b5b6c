"""Near-duplicate vectors by spherical-cap filters: random product codes, list decoding, a join on filters, verification.

A filter is a direction; a vector falls into the filters whose inner product with it exceeds a bound, a cap of the sphere
around each. Directions are all sums of one random code word of each block of a rotated space, so B words in each of m
blocks make B^m filters, and a vector's list is decoded from its best words of each block instead of trying
every direction: of the k best sums none holds a word that isn't among the k best of its block. Sums of the
same words are alike, so a fixed bound would leave many vectors without a filter and others with hundreds (measured); the bound
is each vector's own instead, that of its ``LISTED`` best directions in each of ``CODES`` independent codes.
Vectors of one label meet in the filters that they share and are verified with their full cosines.

The number of filters grows with the largest label, so that far vectors meet at a fixed small rate; two vectors with a
cosine of 0.93 share about half of their lists.

Equal vectors are one, with a weight. In a filter, the rows are held against each other in blocks of matrix products; a filter over
``BLOCK`` rows is dealt to several tasks by pairs of blocks. Only counts and links to each local group's least member
leave a task, never pairs; a pair counts in the first of the filters that it shares. The work within a group of near, but different copies
is the square of its size, as its exact link counts ask for.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.operators.components import connected_components
from weft.session import materialize

THRESHOLD = 0.93
#: Codes of two blocks (twice as many of three, and so on), filters that a vector falls into in each, and far vectors that it meets in one on average.
CODES, LISTED, MET = 8, 5, 0.2
#: The most words of a block; beyond that, codes have more blocks.
WORDS = 512
BLOCK = 1024
SMALL = 24
SEED = 20240


class Code:
    """Random product codes over ``dim`` dimensions, each with at least ``filters`` directions."""

    def __init__(self, dim: int, filters: int) -> None:
        rng = np.random.default_rng([SEED, dim])
        blocks = 2
        while filters > WORDS**blocks and blocks < 8:
            blocks += 1
        self.blocks = min(blocks, dim)
        self.words = max(LISTED, int(np.ceil(filters ** (1 / blocks))))
        cuts = np.linspace(0, dim, self.blocks + 1).astype(int)
        self.parts = list(zip(cuts[:-1], cuts[1:], strict=True))
        self.turns, self.books = [], []
        for _ in range(CODES * (blocks - 1)):
            self.turns.append(np.linalg.qr(rng.normal(size=(dim, dim)))[0])
            words = [rng.normal(size=(self.words, b - a)) for a, b in self.parts]
            self.books.append([w / np.sqrt((w * w).sum(1, keepdims=True)) for w in words])

    def lists(self, unit: np.ndarray) -> np.ndarray:
        """(vector, place): the numbers of the filters of unit vectors, sorted."""
        out = []
        for number, (turn, book) in enumerate(zip(self.turns, self.books, strict=True)):
            turned = unit @ turn
            total, names = np.zeros((len(unit), 1)), np.zeros((len(unit), 1), np.int64)
            for (a, b), words in zip(self.parts, book, strict=True):
                scores = np.round(turned[:, a:b] @ words.T, 9)
                best = np.argpartition(-scores, LISTED - 1, axis=1)[:, :LISTED]
                sums = (total[:, :, None] + np.take_along_axis(scores, best, 1)[:, None, :]).reshape(len(unit), -1)
                spelt = (names[:, :, None] * self.words + best[:, None, :]).reshape(len(unit), -1)
                kept = np.argpartition(-sums, LISTED - 1, axis=1)[:, :LISTED]
                total, names = np.take_along_axis(sums, kept, 1), np.take_along_axis(spelt, kept, 1)
            out.append(names + number * self.words**self.blocks)
        return np.sort(np.concatenate(out, axis=1), axis=1)


@lru_cache(maxsize=8)
def code(dim: int, filters: int) -> Code:
    return Code(dim, filters)


def _vectors(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(len(column), -1)


def packed(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``(vec_id, label, dim, v)``: the bytes of each vector's doubles; null where it is null, empty, zero or has a component that is null or not finite."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for x in b.column(2).to_pylist():
                v = np.array(x if x is not None and None not in x else [], "<f8") + 0.0  # no negative zeros
                out.append(v.tobytes() if len(v) and np.isfinite(v).all() and v.any() else None)
            yield pa.record_batch([b.column(0), b.column(1), pa.array([0 if v is None else len(v) // 8 for v in out], pa.int32()), pa.array(out, pa.binary())], names=["vec_id", "label", "dim", "v"])

    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    return rows.mapInArrow(run, "vec_id long, label string, dim int, v binary")


def listed(reps: DataFrame, sizes: dict[int, int]) -> DataFrame:
    """``(label, dim, filter, rep)``: the filters of each vector; ``sizes``: the largest label of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column(1).to_numpy()
            for dim in np.unique(dims):
                part = b.filter(pa.array(dims == dim))
                made = code(int(dim), int(LISTED * sizes[int(dim)] / MET) + 1)
                for at in range(0, part.num_rows, 512):
                    some = part.slice(at, 512)
                    v = _vectors(some.column(3))
                    found = made.lists(v / np.sqrt((v * v).sum(1, keepdims=True)))
                    rows = pa.array(np.repeat(np.arange(len(found)), found.shape[1]))
                    yield pa.record_batch([some.column(0).take(rows), some.column(1).take(rows), pa.array(found.ravel()), some.column(2).take(rows)], names=["label", "dim", "filter", "rep"])

    return reps.select("label", "dim", "rep", "v").mapInArrow(run, "label string, dim int, filter long, rep long")


def _local_groups(close: np.ndarray) -> np.ndarray:
    """The least index that each row reaches through a symmetric matrix of links."""
    label = np.arange(len(close))
    while True:
        now = np.minimum(label, np.where(close, label[None, :], len(close)).min(1))
        now = now[now]
        if (now == label).all():
            return label
        label = now


def _held(group: dict, threshold: float, links: list, edges: list) -> None:
    """Verify one filter's rows (or two of its blocks) against each other by a matrix product."""
    unit, rep, weight, left, right, number, lists = (group[k] for k in ("unit", "rep", "weight", "left", "right", "filter", "lists"))
    close = (unit @ unit.T >= threshold) & (left[:, None] & right[None, :])
    close |= close.T
    np.fill_diagonal(close, False)
    if not close.any():
        return
    some = np.flatnonzero(close.any(1))
    close, rep, weight = close[np.ix_(some, some)], rep[some], weight[some]
    # filters before this one: who shares one of them has met there
    before = [lists[i][lists[i] < number] for i in some]
    names, at = np.unique(np.concatenate(before), return_inverse=True)
    member = np.zeros((len(some), len(names)), np.float32)
    member[np.repeat(np.arange(len(some)), [len(x) for x in before]), at] = 1
    first = close & (member @ member.T == 0)
    links.append((rep, first @ weight))
    order = np.argsort(rep)
    root = _local_groups(close[np.ix_(order, order)])
    edges.append((rep[order], rep[order][root]))


def verified(met: DataFrame, threshold: float) -> DataFrame:
    """``(rep, root, links)``: for rows (label, dim, filter, x, y, rep, w, v, lists, left, right) sorted by their filter and block pair, each
    vector's links counted there, and the least vector of its group there."""

    def flush(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        dims = rows["dim"].to_numpy()
        for dim in np.unique(dims):
            yield flushed(rows.filter(pa.array(dims == dim)).combine_chunks())

    def flushed(rows: pa.Table) -> pa.RecordBatch:
        v = _vectors(rows["v"].combine_chunks())
        unit = v / np.sqrt((v * v).sum(1, keepdims=True))
        rep, weight, number = (rows[c].to_numpy() for c in ("rep", "w", "filter"))
        left, right = (np.asarray(rows[c].to_pylist(), bool) for c in ("left", "right"))
        column = rows["lists"].combine_chunks()
        ends, values = column.offsets.to_numpy(), column.values.to_numpy()
        lists = [values[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        keys = _keys(rows)
        starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        sizes = np.diff(np.append(starts, len(keys)))
        links, edges = [], []
        for at, n in zip(starts[sizes > SMALL], sizes[sizes > SMALL], strict=True):
            s = slice(at, at + n)
            _held({"unit": unit[s], "rep": rep[s], "weight": weight[s], "left": left[s], "right": right[s], "filter": number[at], "lists": lists[at : at + n]}, threshold, links, edges)
        small = np.repeat(sizes <= SMALL, sizes)
        for step in range(1, min(SMALL, int(sizes.max(initial=0)))):  # small filters all at once: each row with the one ``step`` behind
            i = np.flatnonzero((keys[:-step] == keys[step:]) & small[:-step])
            j = i + step
            ok = (left[i] & right[j]) | (left[j] & right[i])
            hit = ok & (np.einsum("ij,ij->i", unit[i], unit[j]) >= threshold)
            i, j = i[hit], j[hit]
            if len(i):
                first = np.array([np.intersect1d(lists[a], lists[b], assume_unique=True)[0] == number[a] for a, b in zip(i, j, strict=True)])
                links += [(rep[i], weight[j] * first), (rep[j], weight[i] * first)]
                edges.append((np.maximum(rep[i], rep[j]), np.minimum(rep[i], rep[j])))
        counted = [(a, a, n) for a, n in links] + [(a, b, np.zeros(len(a), np.int64)) for a, b in edges]
        if not counted:
            return pa.record_batch([pa.array([], pa.int64())] * 3, names=["rep", "root", "links"])
        return pa.record_batch([pa.array(np.concatenate([np.asarray(x[k], np.int64) for x in counted])) for k in range(3)], names=["rep", "root", "links"])

    def _keys(rows: pa.Table) -> np.ndarray:
        """A number for each run of rows of one filter and block pair; rows are sorted by these."""
        change = np.zeros(rows.num_rows, bool)
        for c in ("label", "dim", "filter", "x", "y"):
            values = rows[c].combine_chunks().dictionary_encode()
            codes = np.concatenate([k.indices.to_numpy(zero_copy_only=False) for k in values.chunks]) if isinstance(values, pa.ChunkedArray) else values.indices.to_numpy(zero_copy_only=False)
            change[1:] |= codes[1:] != codes[:-1]
        return np.cumsum(change)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            held = now if held is None else pa.concat_tables([held, now])
            if held.num_rows >= 4 * BLOCK:
                keys = _keys(held)
                last = int(np.searchsorted(keys, keys[-1]))
                if last:
                    yield from flush(held.slice(0, last))
                    held = held.slice(last).combine_chunks()
        if held is not None and held.num_rows:
            yield from flush(held)

    return met.mapInArrow(run, "rep long, root long, links long")


def near_dedup(table: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row.

    Two vectors of one label that isn't null and of one length are linked if they share a filter and their cosine, in double precision, is ``threshold`` or more.
    ``n_links``: how many other vectors are linked directly; ``component_id``: the smallest vec_id that links reach, its own included;
    ``kept``: whether that is its own. Vectors that are null, empty, zero or have components that are null or not finite, and those without a label, link with nothing. Rows
    with a null id link with nothing and have no component. Rows of one id and vector are one vector; an id with
    several vectors counts for each. An empty table gives no rows; extra columns are ignored.
    """
    rows = materialize(packed(table, id_col, vector_col, label_col), "packed")
    usable = rows.where("v is not null and label is not null and vec_id is not null")
    copies = usable.select("label", "dim", "v", "vec_id").distinct()
    reps = materialize(copies.groupBy("label", "dim", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("w")).withColumn("key", F.concat_ws("/", "label", "dim", "rep")), "reps")
    sizes = {r.dim: r.n for r in reps.groupBy("label", "dim").count().groupBy("dim").agg(F.max("count").alias("n")).collect()}

    lists = materialize(listed(reps, sizes), "filters")
    place = ["label", "dim", "filter"]
    shared = lists.groupBy(*place).agg(F.count("*").alias("size")).where("size > 1")
    live = materialize(lists.join(shared, place), "live")
    own = live.groupBy("label", "dim", "rep").agg(F.sort_array(F.collect_list("filter")).alias("lists"), F.collect_list(F.struct("filter", "size")).alias("in"))
    found = reps.join(own, ["label", "dim", "rep"]).select("label", "dim", "rep", "w", "v", "lists", F.explode("in").alias("f"))
    blocks = F.ceil(F.col("f.size") / BLOCK).cast("int")
    dealt = found.select(*[c for c in found.columns if c != "f"], F.col("f.filter").alias("filter"), F.pmod(F.xxhash64("rep"), blocks).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("o"))
    dealt = dealt.select("label", "dim", "filter", F.least("block", "o").alias("x"), F.greatest("block", "o").alias("y"), "rep", "w", "v", "lists", (F.col("block") <= F.col("o")).alias("left"), (F.col("block") >= F.col("o")).alias("right"))
    sort = ["dim", "label", "filter", "x", "y"]
    checked = materialize(verified(dealt.repartition(*sort).sortWithinPartitions(*sort), threshold), "links")

    reach = connected_components(checked.where("rep <> root").select(F.col("rep").alias("u"), F.col("root").alias("v")))
    counts = checked.groupBy("rep").agg(F.sum("links").alias("links"))
    result = reps.join(counts, "rep", "left").join(reach.select(F.col("node").alias("rep"), "component"), "rep", "left")
    result = result.select("label", "dim", "v", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("links"), F.coalesce("component", "rep").alias("component"))
    known = usable.join(result, ["label", "dim", "v"]).select("vec_id", "links", "component")
    rest = rows.where("v is null or label is null or vec_id is null").select("vec_id", F.lit(0).cast("long").alias("links"), F.col("vec_id").alias("component"))
    return known.unionByName(rest).select("vec_id", F.col("links").alias("n_links"), F.col("component").alias("component_id"), F.coalesce(F.col("vec_id") == F.col("component"), F.lit(False)).alias("kept"))
