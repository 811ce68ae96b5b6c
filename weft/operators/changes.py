"""Change capture over file snapshots: diffs, moves, and a keyed queue of changes."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.session import materialize

LEAST_MOVED_SIZE = 32
MOST_RETRIES = 3
HASH_CAP = 32 * 1024 * 1024


def content_hash(size: Column, content: Column) -> Column:
    """MD5 of files up to the cap, null beyond it."""
    return F.when(size <= HASH_CAP, F.md5(content))


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, kind) between two snapshots (path, hash, size): Created, Deleted, or Modified where hash or size differ, nulls included."""
    rows = old.select("path", F.col("hash").alias("oh"), F.col("size").alias("os"), F.lit(True).alias("was")).join(new.select("path", F.col("hash").alias("nh"), F.col("size").alias("ns"), F.lit(True).alias("now")), "path", "full_outer")
    same = F.col("oh").eqNullSafe(F.col("nh")) & F.col("os").eqNullSafe(F.col("ns"))
    kind = F.when(F.col("was").isNull(), "Created").when(F.col("now").isNull(), "Deleted").when(~same, "Modified")
    return rows.select("path", kind.alias("kind")).where("kind is not null")


def needs_hash(old: DataFrame, new: DataFrame) -> DataFrame:
    """Files of the new listing (path, size, mtime) whose size or time isn't that of the old one: only these are read."""
    return new.join(old.select("path", F.col("size").alias("os"), F.col("mtime").alias("om")), "path", "left").where("os is null or os <> size or om <> mtime").select(*new.columns)


def moves(deleted: DataFrame, created: DataFrame) -> DataFrame:
    """(from_path, to_path) where one deleted and one created file (path, hash, size) alone share a hash, of 32 bytes and more."""
    alone = lambda df: df.where((F.col("size") >= LEAST_MOVED_SIZE) & F.col("hash").isNotNull()).groupBy("hash").agg(F.count("*").alias("n"), F.min("path").alias("p")).where("n = 1")
    return alone(deleted).select("hash", F.col("p").alias("from_path")).join(alone(created).select("hash", F.col("p").alias("to_path")), "hash").select("from_path", "to_path")


def expand_deleted(paths: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Known files at or below deleted paths: each file is joined by its ancestors, not compared with every path."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    return snapshot.select("path", F.explode(above).alias("gone")).join(paths.select(F.col("path").alias("gone")).distinct(), "gone", "left_semi").select("path").distinct()


def merged_kind(kind: Column, incoming: Column) -> Column:
    """The kind of a pending change after another one of the same path."""
    return (
        F.when(incoming == "Modified", "Modified")
        .when((kind == "Deleted") & (incoming == "Created"), "Modified")
        .when((kind == "Created") & (incoming == "Deleted"), "Modified")
        .otherwise(incoming)
    )


def fold_kinds(kinds: Column) -> Column:
    """The kind after all changes of an array, in order."""
    return F.aggregate(kinds, F.lit(None).cast("string"), lambda s, k: F.when(s.isNull(), k).otherwise(merged_kind(s, k)))


def fold_changes(events: DataFrame, key: str = "path", order: str = "ts", kind: str = "kind") -> DataFrame:
    """(key, kind, n): one live change for each key, from its events in order."""
    grouped = events.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order), F.col(kind)))).alias("e"))
    return grouped.select(key, fold_kinds(F.transform("e", lambda x: x[kind])).alias("kind"), F.size("e").alias("n"))


def upsert(queue: DataFrame, changes: DataFrame) -> DataFrame:
    """The queue (path, kind, status, retries, needs_rerun, updated_at) after new changes (path, kind, updated_at), one a path.

    A pending task takes the merged kind; a failed one becomes pending again if it has tries left; one in work is
    marked to run again; done and superseded ones are replaced."""
    c = changes.select("path", F.col("kind").alias("ck"), F.col("updated_at").alias("cu"))
    rows = queue.join(c, "path", "full_outer")
    live = F.col("status").isin("Pending", "Processing", "Failed")
    hit = F.col("ck").isNotNull()
    kind = F.when(~hit, F.col("kind")).when(live, merged_kind(F.col("kind"), F.col("ck"))).otherwise(F.col("ck"))
    retry = (F.col("status") == "Failed") & (F.col("retries") < MOST_RETRIES)
    status = F.when(~hit, F.col("status")).when(F.col("status") == "Processing", "Processing").when((F.col("status") == "Failed") & ~retry, "Failed").otherwise("Pending")
    return rows.select(
        "path", kind.alias("kind"), status.alias("status"), F.when(hit & ~F.coalesce(live, F.lit(False)), 0).otherwise(F.col("retries")).alias("retries"),
        (F.coalesce("needs_rerun", F.lit(False)) | (hit & (F.coalesce("status", F.lit("")) == "Processing"))).alias("needs_rerun"), F.coalesce("cu", "updated_at").alias("updated_at"),
    )


def process(queue: DataFrame, results: DataFrame) -> DataFrame:
    """The queue after work: results (path, ok, version) count only if the task's updated_at is still the version.

    Done tasks go, or are pending again where a rerun is due; failed ones count a try."""
    rows = queue.join(results.select("path", "ok", "version"), "path", "left")
    valid = F.col("ok").isNotNull() & (F.col("version") == F.col("updated_at"))
    again = valid & F.col("ok") & F.col("needs_rerun")
    status = F.when(again, "Pending").when(valid & ~F.col("ok"), "Failed").otherwise(F.col("status"))
    retries = F.col("retries") + F.when(valid & ~F.col("ok"), 1).otherwise(0)
    return rows.where(~(valid & F.col("ok") & ~F.col("needs_rerun")) | ~valid).select("path", "kind", status.alias("status"), retries.alias("retries"), F.when(again, False).otherwise(F.col("needs_rerun")).alias("needs_rerun"), "updated_at")


def status_counts(queue: DataFrame) -> DataFrame:
    names = ("Pending", "Processing", "Done", "Failed", "Superseded")
    return queue.agg(*[F.count_if(F.col("status") == s).alias(s.lower()) for s in names], F.count("*").alias("total"))


# ---- differences of a workspace

WHOLE_BYTES, EDGE_BYTES, MOST_CHANGES = 8 * 1024 * 1024, 64 * 1024, 50


def _arrow(uri: str):
    """Arrow's file system of an address and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri) if re.match(r"[a-z0-9]+:", uri) else f"file://{uri}")


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """(path, uri, len, modified) of the files below a folder, empty ones too, their contents unread: ``path`` is below the folder, ``uri`` is where it is.

    One task lists the folder itself, then its folders are listed whole, each by a task."""
    top = folder.rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for name, whole in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                where, at = _arrow(top)
                found = where.get_file_info(fs.FileSelector(f"{at}/{name}" if name else at, recursive=whole))
                kept = [i for i in found if i.is_file or (not whole and i.type == fs.FileType.Directory)]
                paths = [i.path[len(at) :].lstrip("/") for i in kept]
                yield pa.record_batch([pa.array(paths, pa.string()), pa.array([f"{top}/{p}" for p in paths], pa.string()), pa.array([i.size for i in kept], pa.int64()), pa.array([i.mtime for i in kept], pa.timestamp("us", "UTC")), pa.array([i.is_file for i in kept], pa.bool_())], names=["path", "uri", "len", "modified", "file"])

    schema = "path string, uri string, len long, modified timestamp, file boolean"
    first = materialize(spark.createDataFrame([("", False)], "name string, whole boolean").mapInArrow(run, schema), "listing")
    below = first.where("not file").select(F.col("path").alias("name"), F.lit(True).alias("whole")).repartition("name").mapInArrow(run, schema)
    return first.where("file").unionByName(below).select("path", "uri", "len", "modified")


def signatures(files: DataFrame, whole: int = WHOLE_BYTES, edge: int = EDGE_BYTES) -> DataFrame:
    """``files`` (uri, len, ..) with ``signature`` and ``bytes_read``: the SHA-256 of length and content up to ``whole`` bytes; of a longer file only its
    first and last ``edge`` bytes are read. Files that can't be read have no signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, read = [], []
            for uri, size in zip(batch.column("uri").to_pylist(), batch.column("len").to_pylist(), strict=True):
                digest, n = hashlib.sha256(str(size).encode()), 0
                try:
                    where, at = _arrow(uri)
                    with where.open_input_file(at) as f:
                        for start, length in [(0, size)] if size <= whole else [(0, edge), (size - edge, edge)]:
                            part = f.read_at(length, start)
                            digest.update(part)
                            n += len(part)
                    found.append(digest.hexdigest())
                except OSError:
                    found.append(None)
                read.append(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string()), pa.array(read, pa.int64())], names=[*batch.schema.names, "signature", "bytes_read"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields)
    return files.mapInArrow(run, f"{schema}, signature string, bytes_read long")


def workspace_changes(before: DataFrame, after: DataFrame, most: int = MOST_CHANGES) -> DataFrame:
    """(path, bytes, existed_before) of the files (path, len, modified, signature) that are new or differ in any of the three, the first ``most`` by path.

    Deleted files aren't changes; nulls equal nulls."""
    old = before.select("path", F.struct("len", "modified", "signature").alias("old"))
    rows = after.select("path", "len", F.struct("len", "modified", "signature").alias("new")).join(old, "path", "left")
    return rows.where(~F.col("new").eqNullSafe(F.col("old"))).select("path", F.col("len").alias("bytes"), F.col("old").isNotNull().alias("existed_before")).orderBy("path").limit(most)


# ---- bounded histories and windows


def last_n(rows: DataFrame, by: str, order: str, n: int) -> DataFrame:
    """The last n rows of each group."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(F.col(order).desc()))).where(F.col("_r") <= n).drop("_r")


def history(rows: DataFrame, by: str, order: str, content: str, n: int = 30, most_bytes: int = 512 * 1024) -> DataFrame:
    """A bounded history: entries over the size limit and those equal to the entry before are left out, the last n stay."""
    small = rows.where(F.octet_length(content) <= most_bytes)
    before = F.lag(content).over(Window.partitionBy(by).orderBy(order))
    return last_n(small.withColumn("_b", before).where(F.col("_b").isNull() | (F.col("_b") != F.col(content))).drop("_b"), by, order, n)


def budget_prefix(rows: DataFrame, by: str, order: Column, text: str, budget: int) -> DataFrame:
    """Rows of each group until a budget of characters is spent; the last one is cut to what is left."""
    used = F.coalesce(F.sum(F.char_length(text)).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("used", used).where(F.col("used") < budget).withColumn(text, F.substring(F.col(text), F.lit(1), (F.lit(budget) - F.col("used")).cast("int"))).drop("used")
