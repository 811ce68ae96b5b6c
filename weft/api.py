"""The engine's surface for a project: one object, methods that return DataFrames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.functions import chunker
from weft.functions import text as T
from weft.operators import changes, dedup, graph, lifecycle, lint, reviews, search
from weft.operators.pages import index_sections
from weft.sources import readers
from weft.sources.sinks import VectorStore


class Project:
    """A wiki folder, its vector store and its reviews.

    ``pages`` may be given instead of a folder: path, title, type, content, links, sources. An embedder is any function from a
    list of texts to a list of vectors.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, pages: DataFrame | None = None, store: str | None = None, embedder: Callable | None = None) -> None:
        self.spark, self.folder, self._pages, self.embedder = spark, folder, pages, embedder
        self.vectors = VectorStore(spark, store) if store else None

    def pages(self) -> DataFrame:
        return self._pages if self._pages is not None else readers.wiki_pages(self.spark, self.folder)

    def search(self, query: str, top_k: int = 10, include_content: bool = False, query_embedding: list[float] | None = None) -> DataFrame:
        """Hybrid search; without an embedding and an embedder that works, by keywords and links only."""
        vector = self._query_vector(query, query_embedding)
        chunks = self.vectors.read() if self.vectors and vector is not None else None
        found = search.search(self.pages(), query, top_k, chunks, vector)
        return found.join(self.pages().select("path", "content"), "path", "left").orderBy("section", "place") if include_content else found

    def _query_vector(self, query: str, given: list[float] | None) -> Column | None:
        if given is not None:
            if not given or any(x != x or abs(x) == float("inf") for x in given):
                raise ValueError("the query's vector is empty or not finite")
            return F.array(*map(F.lit, map(float, given)))
        if self.embedder is None or self.vectors is None:
            return None
        try:
            return F.array(*map(F.lit, map(float, self.embedder([query])[0])))
        except Exception:  # noqa: BLE001 - a service that fails leaves keyword search
            return None

    def links(self) -> DataFrame:
        return search.resolve_links(self.pages())

    def page_links(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Outgoing links, backlinks and missing targets: paths as they are, bare names by file name."""
        p = self.pages()
        raw = p.select(F.col("path").alias("src"), F.explode("links").alias("raw")).distinct()
        bare = p.groupBy(T.file_stem(F.col("path")).alias("raw")).agg(F.min("path").alias("dst"))
        exact = p.select(F.explode(F.array("path", F.regexp_replace("path", r"\.md$", ""))).alias("raw"), F.col("path").alias("dst"))
        targets = exact.where(F.contains("raw", F.lit("/"))).unionByName(bare).groupBy("raw").agg(F.min("dst").alias("dst"))
        resolved = raw.join(targets, "raw").select("src", "dst", "raw")
        return graph.page_links(p, resolved.where("src <> dst"), raw.join(resolved.where("src = dst").select("src", "raw"), ["src", "raw"], "left_anti"))

    def graph(self, q: str = "", node_type: str | None = None, limit: int = 200) -> tuple[DataFrame, DataFrame]:
        edges = graph.undirected(self.links())
        nodes = self.pages().select(F.col("path").alias("id"), F.col("title").alias("label"), "type").join(graph.degrees(edges), "id", "left").na.fill(0, ["degree"])
        return graph.api_graph(nodes, edges, q, node_type, limit)

    def lint(self) -> DataFrame:
        p = self.pages().where(~T.file_stem(F.col("path")).isin("index", "log"))
        place = F.row_number().over(Window.orderBy("path")).cast("long")
        return lint.lint(p.select(place.alias("id"), T.file_stem(F.col("path")).alias("slug"), F.regexp_replace("path", "^wiki/", "").alias("short_name"), "title", T.suggestion_tokens(F.concat_ws(" ", "title", F.substring("content", 1, 4000))).alias("tokens"), F.col("links").alias("outlinks")))

    def duplicates(self, threshold: float = dedup.THRESHOLD) -> DataFrame:
        """Clusters of pages by the mean of their chunks' vectors."""
        if self.vectors is None:
            raise ValueError("duplicates need a vector store")
        each = self.vectors.read().select("page_id", F.posexplode("vector").alias("i", "x")).groupBy("page_id", "i").agg(F.avg("x").alias("x"))
        mean = each.groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda v: v.x).alias("vector"))
        ids = mean.withColumn("id", F.xxhash64("page_id"))
        return dedup.near_duplicates(ids, threshold).join(ids.select("id", "page_id"), "id").select("page_id", "cluster")

    def reviews(self, table: DataFrame, status: str | None = None, kind: str | None = None, limit: int = 200) -> DataFrame:
        return reviews.select(reviews.merge(reviews.with_ids(table)), None if status is None else status == "resolved", kind, limit)

    def resolve_reviews(self, table: DataFrame, ids: list[str]) -> DataFrame:
        asked = self.spark.createDataFrame(list(enumerate(ids)), "pos int, id string")
        return reviews.resolve_many(reviews.with_ids(table), asked)

    def files(self, folder: str | None = None, max_files: int = 2_000) -> DataFrame:
        return readers.listing(self.spark, folder or self.folder, max_files=min(max_files, 10_000))

    def rescan(self, old: DataFrame) -> DataFrame:
        """Changes since an old snapshot (path, hash, size)."""
        now = readers.files(self.spark, self.folder).select("path", changes.content_hash(F.col("size"), F.col("content")).alias("hash"), "size")
        return changes.diff(old, now)

    def related_pages(self, source: str) -> DataFrame:
        return lifecycle.related_pages(self.pages(), source)

    def rebuild_index(self) -> DataFrame:
        return index_sections(self.pages().select("type", "title", T.file_stem(F.col("path")).alias("target")))

    def reindex(self, options: chunker.Options = chunker.Options()) -> dict[str, int]:
        """Chunks of all pages, embedded and stored anew."""
        if self.vectors is None or self.embedder is None:
            raise ValueError("reindexing needs a vector store and an embedder")
        p = self.pages().select(T.file_stem(F.col("path")).alias("page_id"), "content", "title")
        chunks = chunker.chunk_pages(p, options=options).join(p.select("page_id", "title"), "page_id")
        text = F.concat_ws("\n\n", "title", F.when(F.col("heading_path") != "", F.col("heading_path")), "text")
        rows = chunks.select("page_id", F.col("index").alias("chunk_index"), F.col("text").alias("chunk_text"), "heading_path", text.alias("text"))
        return self.vectors.rebuild(dedup.embed(rows, self.embedder).drop("text"))
