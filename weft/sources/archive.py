"""Project archives: files written by tasks into zips, and read back behind guards.

Each task writes a whole zip of its own, and a manifest, written at the end, names those that count; what a failed or repeated
task left isn't named. A project of one task gives one zip for other programs. Before any content is read, all entries are listed by
tasks and checked together: no path outside the folder, no links, bounded number and size, and the index page is there.
"""

from __future__ import annotations

import re
import stat
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_BYTES, MOST_ENTRIES = 4 * 1024**3, 100_000
INDEX = "wiki/index.md"
UNSAFE = r"^$|^/|^[A-Za-z]:|\\|(^|/)\.{1,2}(/|$)|\x00"


def _arrow(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri) if re.match(r"[a-z0-9]+:", uri) else f"file://{uri}")


def write_archive(files: DataFrame, folder: str) -> DataFrame:
    """Write files (path, content) into zips below a new folder, one for each task; the manifest (archive, entries, bytes).

    Null contents are empty files; unsafe, null and repeated paths are errors, found before anything is written."""
    spark, folder = files.sparkSession, folder.rstrip("/")
    bad = files.groupBy("path").agg(F.count("*").alias("n")).where(F.col("path").isNull() | F.col("path").rlike(UNSAFE) | (F.col("n") > 1)).limit(5).collect()
    if bad:
        raise ValueError(f"unsafe or repeated paths: {[r.path for r in bad]}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        where, at = _arrow(folder)
        where.create_dir(at, recursive=True)
        name, n, size = f"part-{uuid.uuid4().hex}.zip", 0, 0
        with where.open_output_stream(f"{at}/{name}") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for batch in (b for group in ([first], batches) for b in group):
                for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    z.writestr(zipfile.ZipInfo(path, (2024, 1, 1, 0, 0, 0)), content or b"", zipfile.ZIP_DEFLATED)
                    n, size = n + 1, size + len(content or b"")
        yield pa.record_batch([pa.array([name]), pa.array([n], pa.int64()), pa.array([size], pa.int64())], names=["archive", "entries", "bytes"])

    rows = files.select("path", F.col("content").cast("binary").alias("content"))
    rows.mapInArrow(run, "archive string, entries long, bytes long").write.parquet(f"{folder}/_manifest")
    return spark.read.parquet(f"{folder}/_manifest")


def _entries(archives: DataFrame) -> DataFrame:
    """(uri, path, size, link) of what the zips (uri) say that they hold, without folders."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                where, at = _arrow(uri)
                with where.open_input_file(at) as f, zipfile.ZipFile(f) as z:
                    held = [i for i in z.infolist() if not i.is_dir()]
                yield pa.record_batch([pa.array([uri] * len(held), pa.string()), pa.array([i.filename for i in held], pa.string()), pa.array([i.file_size for i in held], pa.int64()), pa.array([stat.S_ISLNK(i.external_attr >> 16) for i in held], pa.bool_())], names=["uri", "path", "size", "link"])

    return archives.mapInArrow(run, "uri string, path string, size long, link boolean")


def read_archive(spark: SparkSession, source: str, most_bytes: int = MOST_BYTES, most_entries: int = MOST_ENTRIES, index: str | None = INDEX) -> DataFrame:
    """(path, content) of a folder that ``write_archive`` made, or of one zip; an error if it isn't safe.

    An entry that unpacks to more than it says fails its task. Zips are read by one task each."""
    source = source.rstrip("/")
    if source.endswith(".zip"):
        archives = spark.createDataFrame([(source,)], "uri string")
    else:
        archives = spark.read.parquet(f"{source}/_manifest").select(F.concat(F.lit(f"{source}/"), "archive").alias("uri")).repartition("uri")
    held = _entries(archives)
    unsafe = F.col("path").rlike(UNSAFE) | F.col("link")
    seen = held.agg(F.count("*").alias("n"), F.countDistinct("path").alias("paths"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count_if(unsafe).alias("unsafe"), F.count_if(F.col("path") == index).alias("indexed")).first()
    for wrong, why in ((seen.unsafe, "paths outside the folder or links"), (seen.n != seen.paths, "repeated paths"), (seen.n > most_entries, f"more than {most_entries} entries"), (seen.bytes > most_bytes, f"more than {most_bytes} bytes"), (index and not seen.indexed, f"no {index}")):
        if wrong:
            raise ValueError(f"{source}: {why}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                where, at = _arrow(uri)
                with where.open_input_file(at) as f, zipfile.ZipFile(f) as z:
                    for info in z.infolist():
                        if info.is_dir():
                            continue
                        with z.open(info) as entry:
                            content = entry.read(info.file_size + 1)
                            if len(content) != info.file_size or entry.read(1):
                                raise ValueError(f"{info.filename} isn't as long as it says")
                        yield pa.record_batch([pa.array([info.filename]), pa.array([content], pa.binary())], names=["path", "content"])

    return archives.mapInArrow(run, "path string, content binary")
