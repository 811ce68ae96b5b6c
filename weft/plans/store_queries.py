"""Queries of merges that are carried out in a store of pages made from documents, and of archives."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.operators import merges
from weft.session import checkpoint_dir, remove_at_end, table
from weft.sources import archive
from weft.sources.store import Store


def _keep_first():
    """Of a group's pages the canonical one, made where workers get it by value."""
    return lambda canonical, contents: contents[0]


def merge_transaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages that link to the next one; of equal texts the second is merged into the first, and every page is read back."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    said = F.concat("text", F.lit("\n[["), F.concat(F.lit("Doc-"), F.col("id") + 1), F.lit("|next]]"))
    pages = docs.select(F.concat(F.lit("wiki/doc-"), "id", F.lit(".md")).alias("path"), said.alias("content"))
    keys = docs.select("id", F.sha2("text", 256).alias("key"))  # texts are compared by their hashes, so they stay where they are
    first = keys.groupBy("key").agg(F.min("id").alias("a"), F.count("*").alias("n")).where("n > 1")
    pairs = keys.join(first, "key").where("id > a").groupBy("a").agg(F.min("id").alias("b"))
    name = lambda c: F.concat(F.lit("doc-"), c)
    groups = pairs.select(F.explode(F.array("a", "b")).alias("id"), "a").select(name(F.col("id")).alias("page"), name(F.col("a")).alias("canonical"))
    folder = f"{checkpoint_dir(spark)}/weft-store-{uuid.uuid4().hex}"
    remove_at_end(spark, folder)
    store = Store(spark, folder, merges.SCHEMAS)
    run = store.claim()
    store.commit(run, {"pages": store.stage(pages, "pages")})
    merges.execute(store, run, groups, _keep_first(), "first", "2024-05-01")
    saved = store.read("backup").select("path", F.lit(True).alias("saved"))
    return store.read("pages").join(saved, "path", "left").select("path", F.md5("content").alias("md5"), F.coalesce("saved", F.lit(False)).alias("saved"))


MERGED_SQL = """
WITH d AS (SELECT doc_id AS id, coalesce(text, '') AS text FROM documents), r AS (SELECT *, row_number() OVER w AS n, count(*) OVER (PARTITION BY text) AS copies, min(id) OVER (PARTITION BY text) AS a FROM d WINDOW w AS (PARTITION BY text ORDER BY id)),
g AS (SELECT id, a FROM r WHERE copies > 1 AND n = 2)
SELECT 'wiki/doc-' || r.id || '.md' AS path, r.n = 1 AND copies > 1 OR next.id IS NOT NULL AS saved,
    md5(CASE WHEN r.n = 1 AND copies > 1 THEN '---' || chr(10) || 'updated: 2024-05-01' || chr(10) || '---' || chr(10) || text || chr(10) || '[[Doc-' || (r.id + 1) || '|next]]'
        ELSE text || chr(10) || CASE WHEN next.id IS NULL THEN '[[Doc-' || (r.id + 1) ELSE '[[doc-' || next.a END || '|next]]' END) AS md5
FROM r LEFT JOIN g next ON next.id = r.id + 1 WHERE NOT (copies > 1 AND n = 2)
"""

def archive_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a project, written into zips and read back."""
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("wiki/doc-"), "doc_id", F.lit(".md")).alias("path"), F.coalesce("text", F.lit("")).alias("content"))
    folder = f"{checkpoint_dir(spark)}/weft-archive-{uuid.uuid4().hex}"
    remove_at_end(spark, folder)
    archive.write_archive(docs, folder)
    # the bounds are for archives from elsewhere; this one is our own
    found = archive.read_archive(spark, folder, most_bytes=1 << 62, most_entries=1 << 62, index=None)
    return found.select("path", F.octet_length("content").cast("long").alias("bytes"), F.sha2("content", 256).alias("sha256"))


ARCHIVE_SQL = "SELECT 'wiki/doc-' || doc_id || '.md' AS path, octet_length(encode(coalesce(text, '')))::BIGINT AS bytes, sha256(coalesce(text, '')) AS sha256 FROM documents"

QUERIES = {"archive_round_trip": (archive_round_trip, ARCHIVE_SQL), "merge_transaction": (merge_transaction, MERGED_SQL)}
