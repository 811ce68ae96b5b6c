"""Hybrid retrieval: keyword scan, vector search, rank fusion and one hop over the link graph.

Pages have path, title, content and links. Scoring is one projection, ranks are windows over the hits
that are ordered and limited first, and joins are on page keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.functions import measures as M
from weft.functions import text as T
from weft.session import materialize

SCAN_CAP = 10_000
DEFAULT_RESULTS, MOST_RESULTS = 20, 50


def clamp(top_k: int | None, default: int = DEFAULT_RESULTS) -> int:
    return min(max(top_k if top_k else default, 1), MOST_RESULTS)


def keyword_scores(pages: DataFrame, query: str) -> DataFrame:
    """The pages that match a query, with ``score``, ``title_match`` and ``snippet``."""
    s = T.keyword_signals(F.col("title"), T.file_name(F.col("path")), F.col("content"), query)
    return pages.where(s["hit"]).select("path", "title", s["score"].alias("score"), s["title_match"].alias("title_match"), T.snippet(F.col("content"), query).alias("snippet"))


def ranked(hits: DataFrame, score: str = "score", key: str = "path", name: str = "rank") -> DataFrame:
    """Position by score, best first, then key. The input should be limited: one order over all rows is one task."""
    return hits.withColumn(name, F.row_number().over(Window.orderBy(F.col(score).desc(), key)))


def vector_hits(chunks: DataFrame, query: Column, k: int, squared: bool = True) -> DataFrame:
    """The k nearest chunks (page_id, chunk_index, chunk_text, heading_path, vector): an exact scan, best ``score`` first."""
    d = M.squared_distance(F.col("vector"), query)
    scored = chunks.withColumn("score", M.distance_score(d if squared else F.sqrt(d)))
    return scored.drop("vector").orderBy(F.col("score").desc(), "page_id", "chunk_index").limit(k)


def over_fetch(k: int) -> int:
    return max(3 * k, 30)


def page_blend(hits: DataFrame) -> DataFrame:
    """Chunk hits by page: blended score, and the text and heading of the best chunk (first on ties)."""
    best = F.max_by(F.struct("chunk_text", "heading_path", "chunk_index"), F.struct(F.col("score"), -F.col("chunk_index")))
    grouped = hits.groupBy("page_id").agg(F.max("score").alias("top"), F.sum("score").alias("total"), best.alias("best"), F.count("*").alias("chunks"))
    return grouped.select("page_id", M.blended(F.col("top"), F.col("total")).alias("score"), "best.chunk_text", "best.heading_path", "chunks")


def fuse(keyword: DataFrame, vector: DataFrame, key: str = "page_id") -> DataFrame:
    """Full outer join of two rankings (key, rank) with the fused score; missing ranks count nothing."""
    joined = keyword.select(key, F.col("rank").alias("keyword_rank")).join(vector.select(key, F.col("rank").alias("vector_rank")), key, "full_outer")
    return joined.withColumn("score", M.rrf(F.col("keyword_rank"), F.col("vector_rank")))


def graph_candidates(seeds: DataFrame, links: DataFrame) -> DataFrame:
    """Neighbours of the seeds (page_id, rank, title) that aren't seeds: sum of 1/rank, and the seeds' titles in order.

    ``links`` are (src, dst); they count once and in both directions."""
    both = links.select("src", "dst").union(links.select("dst", "src")).where("src <> dst").distinct()
    s = seeds.select(F.col("page_id").alias("src"), F.col("rank").alias("seed_rank"), F.col("title").alias("seed_title"))
    reached = both.join(s, "src").join(seeds.select(F.col("page_id").alias("dst")), "dst", "left_anti")
    return reached.groupBy(F.col("dst").alias("page_id")).agg(F.sum(1.0 / F.col("seed_rank")).alias("graph_score"), F.array_sort(F.collect_set("seed_title")).alias("related_to"))


def blend_graph(results: DataFrame, links: DataFrame, titles: DataFrame, limit: int, n_vector: int) -> DataFrame:
    """Ranked results (page_id, score, rank) with graph neighbours at the end, ``limit`` rows.

    The best ``min(limit, 20)`` results are seeds; the best candidates up to the quota go behind the others, those
    that were ranked keep their score, new ones get their graph score over 61. ``titles``: (page_id, title). The results, which
    the caller limits, and the few best candidates are each worked out once and written, as several joins read them.
    """
    results = materialize(results, "ranked")
    named = results.join(titles, "page_id")
    seeds = named.where(F.col("rank") <= min(limit, M.GRAPH_SEEDS))
    best = graph_candidates(seeds, links).join(titles.select("page_id"), "page_id", "left_semi").orderBy(F.col("graph_score").desc(), "page_id").limit(M.graph_quota(limit, n_vector))
    best = best.withColumn("graph_rank", F.row_number().over(Window.orderBy(F.col("graph_score").desc(), "page_id")))
    best = materialize(best, "neighbours")
    base = results.join(best.select("page_id"), "page_id", "left_anti")
    base = base.withColumn("place", F.row_number().over(Window.orderBy("rank")))
    taken = best.agg(F.count("*").alias("taken"))
    base = base.join(F.broadcast(taken), F.col("place") <= limit - F.col("taken")).select("page_id", "score", F.lit(0).alias("section"), "place", F.lit(None).cast("array<string>").alias("related_to"))
    tail = best.join(results.select("page_id", "score"), "page_id", "left")
    tail = tail.select("page_id", F.coalesce("score", F.col("graph_score") / (M.RRF_K + 1.0)).alias("score"), F.lit(1).alias("section"), F.col("graph_rank").alias("place"), "related_to")
    return base.unionByName(tail).orderBy("section", "place")


def resolve_links(pages: DataFrame) -> DataFrame:
    """``(src, dst)`` of all links that lead to another page: a link matches a page's path, path below wiki/, stem or title;
    of several pages the last by path and kind of alias wins."""
    below = F.regexp_replace("path", "^wiki/", "")
    names = F.posexplode(F.array(T.alias_key(F.col("path")), T.alias_key(below), T.alias_key(T.file_stem(F.col("path"))), T.alias_key(F.col("title"))))
    aliases = pages.select("path", names.alias("ordinal", "alias")).groupBy("alias").agg(F.max_by("path", F.struct("path", "ordinal")).alias("dst"))
    out = pages.select(F.col("path").alias("src"), F.explode("links").alias("link")).select("src", T.alias_key(F.col("link")).alias("alias"))
    return out.join(aliases, "alias").where("src <> dst").select("src", "dst").distinct()


def search(pages: DataFrame, query: str, top_k: int | None = None, chunks: DataFrame | None = None, query_vector: Column | None = None, cap: int = SCAN_CAP) -> DataFrame:
    """Hybrid search over pages (path, title, content, links) and, where given, their chunks (page_id is the file's stem).

    Returns path, title, score, section (0 ranked, 1 graph), place, related_to, vector_score, in the final order: at most
    ``top_k`` (1 to 50) rows. Only the best ``cap`` keyword hits are ranked, in one task; a page beyond them can come in by its
    vector or its links alone, so a larger ``cap`` can change no row but through the fused score of such a page.
    """
    limit = clamp(top_k)
    hits = keyword_scores(pages, query)
    pooled = ranked(hits.orderBy(F.col("score").desc(), "path").limit(cap)).withColumn("page_id", F.col("path"))
    n_vector, vector = 0, None
    if chunks is not None and query_vector is not None:
        stems = pages.select("path", T.file_stem(F.col("path")).alias("stem")).groupBy("stem").agg(F.max("path").alias("page_id"))
        found = page_blend(vector_hits(chunks, query_vector, over_fetch(max(limit, 10)))).orderBy(F.col("score").desc(), "page_id").limit(max(limit, 10))
        found = ranked(found, key="page_id").withColumnRenamed("page_id", "stem").join(stems, "stem")
        vector = found.select("page_id", "rank", F.col("score").alias("vector_score"))
        n_vector = vector.count()  # at most 50 rows
    if n_vector:
        fused = fuse(pooled, vector).select("page_id", "score")
    else:
        fused = pooled.select("page_id", "score")
    top = fused.orderBy(F.col("score").desc(), "page_id").limit(cap)
    top = top.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), "page_id")))
    titles = pages.select(F.col("path").alias("page_id"), "title")
    out = blend_graph(top, resolve_links(pages), titles, limit, n_vector).join(titles, "page_id", "left")
    out = out.join(vector.select("page_id", "vector_score"), "page_id", "left") if vector is not None else out.withColumn("vector_score", F.lit(None).cast("double"))
    return out.withColumnRenamed("page_id", "path").orderBy("section", "place")
