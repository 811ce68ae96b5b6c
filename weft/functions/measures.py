"""Scores and distances as columns or plain functions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

RRF_K = 60.0
#: How much of a result window the graph may take.
GRAPH_SHARE_LEAST, GRAPH_SHARE_MOST = 0.15, 0.30
GRAPH_SEEDS = 20


def _double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for null vectors, unequal lengths and zero norms."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(a.isNull() | b.isNull() | (F.size(a) != F.size(b)) | (norms == 0), 0.0).otherwise(dot(a, b) / norms)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def distance_score(distance: Column) -> Column:
    return 1 / (1 + distance)


def rrf(*ranks: Column) -> Column:
    """Reciprocal rank fusion; a missing rank counts nothing."""
    return sum((F.coalesce(1 / (RRF_K + r), F.lit(0.0)) for r in ranks), F.lit(0.0))


def blended(scores_top: Column, scores_sum: Column) -> Column:
    """A page's score from its chunks' best and sum: the best, and 0.3 of the rest as far as it stays under one."""
    return scores_top + F.least(0.3 * (scores_sum - scores_top), F.greatest(F.lit(0.0), 1 - scores_top))


def graph_quota(limit: int, vector_hits: int) -> int:
    """How many of ``limit`` results the graph may take."""
    if limit < 2:
        return 0
    covered = min(vector_hits, limit) / limit
    share = GRAPH_SHARE_MOST - (GRAPH_SHARE_MOST - GRAPH_SHARE_LEAST) * covered
    return min(max(math.ceil(limit * share), 1), limit - 1)


def search_mode(token_hits: int, vector_hits: int, graph_hits: int) -> str:
    if graph_hits > 0:
        return "hybrid"
    if vector_hits == 0:
        return "keyword"
    return "vector" if token_hits == 0 else "hybrid"


DEFAULT_CONTEXT = 204_800


def context_budget(size: int) -> dict[str, int]:
    """Characters of a model's context for pages, the index, the answer and a single page."""
    size = size if size and size > 0 else DEFAULT_CONTEXT
    pages = math.floor(size * 0.5)
    return {"size": size, "index": math.floor(size * 0.05), "pages": pages, "response": math.floor(size * 0.15), "page": min(pages, max(5_000, math.floor(pages * 0.3)))}


# Affinity of page types, row by row; 0.5 where a pair is missing.
TYPE_AFFINITY = {
    "entity": {"concept": 1.2, "entity": 0.8, "source": 1.0, "synthesis": 1.0, "query": 0.8},
    "concept": {"entity": 1.2, "concept": 0.8, "source": 1.0, "synthesis": 1.2, "query": 1.0},
    "source": {"entity": 1.0, "concept": 1.0, "source": 0.5, "query": 0.8, "synthesis": 1.0},
    "query": {"concept": 1.0, "entity": 0.8, "synthesis": 1.0, "source": 0.8, "query": 0.5},
    "synthesis": {"concept": 1.2, "entity": 1.0, "source": 1.0, "query": 1.0, "synthesis": 0.8},
}
AFFINITY_DEFAULT = 0.5
DIRECT_LINK, SOURCE_OVERLAP, COMMON_NEIGHBOR, AFFINITY = 3.0, 4.0, 1.5, 1.0
DISTANT_TYPES = (("source", "concept"), ("concept", "source"), ("source", "synthesis"), ("synthesis", "source"), ("query", "entity"), ("entity", "query"))


def fnv1a32(text: str) -> int:
    """FNV-1a over UTF-16 code units, 32 bits."""
    h, raw = 0x811C9DC5, text.encode("utf-16-le", "surrogatepass")
    for i in range(0, len(raw), 2):
        h = ((h ^ (raw[i] | raw[i + 1] << 8)) * 0x01000193) & 0xFFFFFFFF
    return h


def fnv1a64(data: bytes) -> int:
    h = 0xCBF29CE484222325
    for b in data:
        h = ((h ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return h


def fnv1a32_column(text: Column) -> Column:
    """``fnv1a32`` of a column, for text in the basic plane; JVM only."""
    units = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.conv(F.hex(F.encode(c, "UTF-16BE")), 16, 10).cast("long"))
    return F.aggregate(units, F.lit(0x811C9DC5).cast("long"), lambda h, u: (h.bitwiseXOR(u) * F.lit(0x01000193).cast("long")).bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))


def review_id(kind: Column, title: Column) -> Column:
    from weft.functions.text import review_title_key

    return F.concat(F.lit("review-"), F.lpad(F.lower(F.hex(fnv1a32_column(F.concat(kind, F.lit("::"), review_title_key(title))))), 8, "0"))


def ingest_budget(size: Column, fixed: Column) -> Column:
    """Characters of a source that one pass takes, beside ``fixed`` characters of other context, in a model's context of ``size``
    (the default where that's null or not above zero)."""
    size = F.when(size > 0, size).otherwise(DEFAULT_CONTEXT).cast("long")
    share = lambda x: F.floor(size * x)
    least = F.greatest(F.lit(12_000), fixed.cast("long"))
    left = size - share(0.15) - F.least(share(0.25), least) - F.greatest(F.lit(12_000), share(0.08))
    most = F.least(F.lit(300_000), F.greatest(F.lit(8_000), share(0.6)))
    return F.least(F.greatest(left, F.lit(8_000)), most)


def generation_tokens(size: Column) -> Column:
    """Tokens that a model of such a context may write for a page; a review takes half, from 4 096 to 8 192."""
    size = F.when(size > 0, size).otherwise(DEFAULT_CONTEXT)
    return F.when(size >= 512_000, 32_768).when(size >= 256_000, 24_576).when(size >= 128_000, 16_384).otherwise(8_192)


def review_tokens(size: Column) -> Column:
    return F.least(F.lit(8_192), F.greatest(F.lit(4_096), F.floor(generation_tokens(size) / 2)))


def density_scale(nodes: Column) -> Column:
    """How much smaller nodes are drawn in graphs of more than 150."""
    return F.when(nodes <= 150, 1.0).otherwise(F.greatest(F.lit(0.35), F.sqrt(150 / nodes)))


def node_size(links: Column, most_links: Column, nodes: Column, scale: float = 1.0, least: float = 8.0, most: float = 28.0) -> Column:
    """A node's size: with the root of its share of the most linked one's links; the least where nothing is linked."""
    return F.when(most_links == 0, least).otherwise((least + F.sqrt(links / most_links) * (most - least)) * density_scale(nodes) * scale)


def weak_edge(nodes: Column) -> Column:
    """The share of the largest weight below which edges are passed over."""
    return F.when(nodes > 2_500, 0.16).when(nodes > 1_200, 0.1).when(nodes > 700, 0.05).otherwise(0.0)


def label_size(nodes: Column) -> Column:
    """The size from which nodes carry labels."""
    return F.when(nodes > 2_500, 18).when(nodes > 1_200, 14).when(nodes > 600, 10).otherwise(6)


def label_density(nodes: Column) -> Column:
    return F.when(nodes > 2_500, 0.08).when(nodes > 1_200, 0.14).when(nodes > 600, 0.24).otherwise(0.4)
