"""Structured Streaming: file events to batches, a keyed queue of changes, and ingest by micro-batch.

Timing is that of processing; event-time windows over ``events`` are an extension, named so.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from weft.functions.rowwise import rowwise, rowwise_pair
from weft.operators import changes as C
from weft.session import checkpoint_dir

EVENT = "path string, kind string, ts timestamp"


def watch(spark: SparkSession, folder: str, schema: str = EVENT, files_per_batch: int = 100) -> DataFrame:
    """File events that land as JSON files in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(folder)


def quiet_batches(events: DataFrame, gap: str = "700 milliseconds", late: str = "10 seconds") -> DataFrame:
    """(start, end, paths, n): bursts of events that end with a pause, each path once."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w")).agg(F.array_sort(F.collect_set("path")).alias("paths"), F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "paths", "n")


def latest(events: DataFrame, key: str = "path", window: str = "250 milliseconds", late: str = "10 seconds") -> DataFrame:
    """The last event of each key in each short window."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), F.col(key)).agg(F.max_by("kind", "ts").alias("kind"), F.max("ts").alias("ts")).select(key, "kind", "ts")


def _fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    kind, n = state.get if state.exists else (None, 0)
    for part in parts:
        for incoming in part.sort_values("ts").kind:
            if kind is None:
                kind = incoming
            elif incoming == "Modified" or {kind, incoming} == {"Created", "Deleted"}:
                kind = "Modified"
            else:
                kind = incoming
            n += 1
    state.update((kind, n))
    yield pd.DataFrame({"path": [key[0]], "kind": [kind], "n": [n]})


def live_queue(events: DataFrame) -> DataFrame:
    """(path, kind, n) of each path after every batch: one live change a path, kept as state (update mode)."""
    return events.groupBy("path").applyInPandasWithState(_fold, "path string, kind string, n long", "kind string, n long", "update", GroupStateTimeout.NoTimeout)


def without_own_writes(events: DataFrame, own: DataFrame, seconds: int = 4) -> DataFrame:
    """Events that don't follow a write of our own (path, written) within some seconds."""
    e, o = events.alias("e"), own.alias("o")
    near = (F.col("e.path") == F.col("o.path")) & (F.col("e.ts") >= F.col("o.written")) & (F.col("e.ts") <= F.col("o.written") + F.expr(f"INTERVAL {seconds} SECONDS"))
    return e.join(o, near, "left_anti")


def run_once(stream: DataFrame, each: Callable[[DataFrame, int], None], name: str, mode: str = "append") -> None:
    """All that is there now, through ``each(batch, number)``; a later call goes on where this one ended. ``each`` must bear repeats."""
    folder = f"{checkpoint_dir(stream.sparkSession)}/stream-{name}"
    query = stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", folder).trigger(availableNow=True).start()
    query.awaitTermination()


def queue_sink(table, process: Callable[[DataFrame], DataFrame] | None = None) -> Callable[[DataFrame, int], None]:
    """A batch of events (path, kind, ts) into a queue table (``VersionedTable``): folded by path, then merged; ``process`` may
    work it off, giving results (path, ok, version). A repeated batch merges into the same kinds."""

    def each(batch: DataFrame, number: int) -> None:
        folded = C.fold_changes(batch, "path", "ts").join(batch.groupBy("path").agg(F.max("ts").alias("updated_at")), "path").select("path", "kind", "updated_at")
        queue = C.upsert(table.read(), folded)
        queue = queue.select("path", "kind", "status", F.coalesce("retries", F.lit(0)).alias("retries"), "needs_rerun", "updated_at")
        if process is not None:
            queue = C.process(queue, process(queue))
        table.write(queue)
        table.prune(2)

    return each


QUEUE = "path string, kind string, status string, retries int, needs_rerun boolean, updated_at timestamp"


def ingest_sink(cache, pages, generate: Callable[[str, str], str]) -> Callable[[DataFrame, int], None]:
    """A batch of sources (path, content) into pages: known contents are skipped, an injected function (path, text) gives FILE
    blocks, safe ones replace pages by path, and the cache remembers sources whose blocks were all whole."""
    from weft.functions.parse import file_blocks_column, sanitize

    generated, clean = rowwise_pair(generate, "string"), rowwise(sanitize, "string")

    def each(batch: DataFrame, number: int) -> None:
        fresh = batch.withColumn("hash", F.sha2("content", 256)).join(cache.read().select("path", "hash"), ["path", "hash"], "left_anti")
        blocks = fresh.withColumn("blocks", file_blocks_column(generated(F.col("path"), F.col("content").cast("string")))).persist()
        rows = blocks.select(F.col("path").alias("source"), F.explode("blocks").alias("b")).select("source", "b.*")
        new = rows.where("problem is null").select("path", clean(F.col("content")).alias("content"), "source").dropDuplicates(["path"])
        pages.write(pages.read().join(new.select("path"), "path", "left_anti").unionByName(new))
        whole = blocks.where(~F.exists("blocks", lambda b: b.problem.isNotNull()) & (F.size("blocks") > 0))
        done = whole.select("path", "hash", F.transform("blocks", lambda b: b.path).alias("outputs"))
        cache.write(cache.read().join(done.select("path"), "path", "left_anti").unionByName(done))
        blocks.unpersist()

    return each


# ---- extensions beyond the stated operators


def event_windows(events: DataFrame, size: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Extension: counts and sums of events by type in tumbling or sliding windows of event time; batch or stream."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    e = e.withWatermark("ts", "10 minutes") if e.isStreaming else e
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    return e.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Extension: sessions of users by pauses in event time."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    e = e.withWatermark("ts", "10 minutes") if e.isStreaming else e
    return e.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")
