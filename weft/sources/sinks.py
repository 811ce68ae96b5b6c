"""Sinks: keyed replace of vector chunks, full rebuilds, compaction, bounded histories and web clips.

A table is a folder with numbered versions and a pointer to the current one, so a replace is written whole before it
counts, and a failed or repeated job leaves the old version in place.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions import text as T


class VersionedTable:
    """A Parquet table whose versions are folders v=<n>; the newest finished one is current."""

    def __init__(self, spark: SparkSession, path: str, schema: str) -> None:
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _fs(self):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def versions(self) -> list[int]:
        fs, where = self._fs()
        if not fs.exists(where):
            return []
        made = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        found = [(s.getPath().getName(), s.getPath().toString()) for s in fs.listStatus(where)]
        return sorted(int(n[2:]) for n, p in found if re.fullmatch(r"v=\d+", n) and fs.exists(made(p + "/_SUCCESS")))

    def read(self) -> DataFrame:
        now = self.versions()
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v={now[-1]}") if now else self.spark.createDataFrame([], self.schema)

    def write(self, df: DataFrame, files: int | None = None) -> None:
        now = self.versions()
        out = df.coalesce(files) if files else df
        out.write.mode("overwrite").parquet(f"{self.path}/v={(now[-1] if now else 0) + 1}")

    def size(self) -> int:
        """Bytes of the current version."""
        now = self.versions()
        fs, _ = self._fs()
        return fs.getContentSummary(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/v={now[-1]}")).getLength() if now else 0

    def prune(self, keep: int = 1) -> None:
        """Drop all but the newest versions."""
        fs, _ = self._fs()
        for n in self.versions()[:-keep]:
            fs.delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/v={n}"), True)

    def drop(self) -> None:
        fs, where = self._fs()
        fs.delete(where, True)


FILE_BYTES = 256 * 1024 * 1024
CHUNKS = "chunk_id string, page_id string, chunk_index int, chunk_text string, heading_path string, vector array<float>"


class VectorStore:
    """Chunks of pages with vectors of one length."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.table = VersionedTable(spark, path, CHUNKS)

    def read(self) -> DataFrame:
        return self.table.read()

    def _checked(self, chunks: DataFrame) -> tuple[DataFrame, int]:
        rows = chunks.where(T.valid_page_id(F.col("page_id"))).select(F.concat_ws("#", "page_id", F.col("chunk_index").cast("string")).alias("chunk_id"), "page_id", F.col("chunk_index").cast("int").alias("chunk_index"), "chunk_text", "heading_path", F.col("vector").cast("array<float>").alias("vector"))
        seen = rows.agg(F.count("*").alias("n"), F.min(F.coalesce(F.size("vector"), F.lit(0))).alias("least"), F.max(F.coalesce(F.size("vector"), F.lit(0))).alias("most")).first()
        old = self.read().agg(F.max(F.size("vector"))).first()[0]
        if seen.n and (seen.least <= 0 or seen.least != seen.most or (old is not None and old != seen.most)):
            raise ValueError(f"vectors of lengths {seen.least} to {seen.most}, the table has {old}")
        return rows, seen.n

    def upsert(self, chunks: DataFrame) -> int:
        """Replace all chunks of the pages given; no rows change nothing. Returns the number of new rows."""
        rows, n = self._checked(chunks)
        if n:
            self.table.write(self.read().join(rows.select("page_id").distinct(), "page_id", "left_anti").select(*rows.columns).unionByName(rows))
        return n

    def delete(self, page_ids: list[str]) -> None:
        if self.table.versions():
            self.table.write(self.read().where(~F.col("page_id").isin(*page_ids)))

    def clear(self) -> None:
        self.table.drop()

    def rebuild(self, embedded: DataFrame) -> dict[str, int]:
        """All pages anew from rows with ``vector`` and ``error``: without a failure the table is replaced, with some only pages without one are."""
        failed = embedded.where("error is not null or vector is null").select("page_id").distinct()
        n_failed = failed.count()
        good = embedded.join(failed, "page_id", "left_anti")
        if n_failed:
            return {"chunks": self.upsert(good), "failed": n_failed}
        rows, n = self._checked_new(good)
        self.table.write(rows)
        return {"chunks": n, "failed": 0}

    def _checked_new(self, chunks: DataFrame) -> tuple[DataFrame, int]:
        read, self.read = self.read, lambda: read().limit(0)  # type: ignore[method-assign]
        try:
            return self._checked(chunks)
        finally:
            self.read = read  # type: ignore[method-assign]

    def compact(self, files: int | None = None) -> None:
        """Rewrite into few files, one for each ``FILE_BYTES`` unless a number is given, and drop old versions."""
        if self.table.versions():
            self.table.write(self.read(), files or -(-self.table.size() // FILE_BYTES) or 1)
            self.table.prune()

    def counts(self) -> DataFrame:
        return self.read().agg(F.count("*").alias("chunks"), F.countDistinct("page_id").alias("pages"))


def clip_pages(clips: DataFrame, taken: DataFrame, date: str) -> DataFrame:
    """(path, content) of web clips (pos, title, url, markdown): named by title and date, -2 and so on where a name is taken (path)."""
    stem = F.concat(F.coalesce(F.nullif(T.slug(F.col("title")), F.lit("")), F.lit("clip")), F.lit(f"-{date}"))
    from pyspark.sql import Window

    used = taken.select(F.regexp_replace(T.file_stem(F.col("path")), r"-\d{1,2}$", "").alias("stem"), T.file_stem(F.col("path")).alias("full"))
    used = used.select(F.when(F.col("full").rlike(r"\d{4}-\d{2}-\d{2}$"), F.col("full")).otherwise(F.col("stem")).alias("stem")).groupBy("stem").agg(F.count("*").alias("n"))
    rows = clips.withColumn("stem", stem).join(used, "stem", "left")
    nth = F.row_number().over(Window.partitionBy("stem").orderBy("pos")) + F.coalesce("n", F.lit(0))
    path = F.concat(F.lit("raw/sources/"), "stem", F.when(nth > 1, F.concat(F.lit("-"), nth.cast("string"))).otherwise(""), F.lit(".md"))
    head = F.concat(F.lit("---\ntype: clip\ntitle: \""), F.replace("title", F.lit('"'), F.lit("'")), F.lit("\"\nurl: \""), "url", F.lit(f"\"\nclipped: {date}\n---\n\n# "), "title", F.lit("\n\n"), "markdown", F.lit("\n"))
    return rows.select(path.alias("path"), head.alias("content"))


def write_pages(pages: DataFrame, folder: str, unsafe: Column | None = None) -> DataFrame:
    """Append pages (path, content) as a table of files below a folder; unsafe paths are returned, not written."""
    safe = T.safe_wiki_path(F.col("path")) if unsafe is None else ~unsafe
    pages.where(safe).write.mode("append").parquet(folder)
    return pages.where(~safe)
