"""Sources too long for one pass: semantic chunks folded in order into a digest, with every step kept in a store.

A step needs the digest of the step before, so a source's steps are a sequence; sources run beside each other. A round takes the next
``steps`` chunks of every source that has some left, so a task holds a bounded part of a source whatever its length, and commits what came out
in one transaction. A run that ends early, or whose executors are lost, leaves whole rounds; the next run goes on behind them. Steps count only
for the same text cut the same way.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions import chunker
from weft.functions.parse import heading_section
from weft.session import materialize
from weft.sources.store import Store

# Sizes in characters, and the mark of a cut.
CHUNK_LEAST, CHUNK_MOST = 12_000, 60_000
OVERLAP_LEAST, OVERLAP_MOST = 800, 3_000
DIGEST_MOST, NOTE_MOST = 15_000, 40_000
CUT = "\n\n[...trimmed for prompt budget...]"

_CUTTING = "page_id string, source_hash string, target int, overlap int, total int"
CHUNK = f"{_CUTTING}, index int, heading_path string, char_start int, char_end int, overlap_before string, text string"
STEP = f"{_CUTTING}, index int, note string, digest string, problem string, run long"
SCHEMAS = {"steps": STEP}
KEY = ["page_id", "source_hash", "target", "overlap", "total"]

#: The model's place: takes the digest so far and a chunk's fields, and returns an answer with the sections "Chunk Analysis" and "Updated Global Digest".
Call = Callable[[str, dict], str]


def trimmed(text: str, most: int) -> str:
    """A text cut to ``most`` characters, with a mark where it was cut."""
    return text if len(text) <= most else text[:most].rstrip() + CUT


def chunk_sizes(budget: Column) -> tuple[Column, Column]:
    """Characters of a chunk, and of the part of the one before that comes with it, for sources that may take ``budget`` characters."""
    target = F.least(F.greatest(F.floor(budget * 0.55), F.lit(CHUNK_LEAST)), F.lit(CHUNK_MOST))
    return target.cast("int"), F.least(F.greatest(F.floor(target * 0.08), F.lit(OVERLAP_LEAST)), F.lit(OVERLAP_MOST)).cast("int")


def cut_sources(sources: DataFrame) -> DataFrame:
    """A row for each chunk of the sources (page_id, content, budget) that are longer than one; chunks are numbered from 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                text = row.pop("content")
                found = chunker.semantic_chunks(text, row["target"], row["overlap"])
                if len(found) > 1:
                    paths, _, ends = zip(*chunker.sections(text, 0))
                    # a section's heading begins where the section before ends; a chunk is where its first words are
                    of = lambda c: paths[bisect_right(ends[:-1], c["char_end"] - len(c["text"].lstrip()))]
                    rows = [row | c | {"total": len(found), "index": c["index"] + 1, "heading_path": of(c)} for c in found]
                    yield pa.RecordBatch.from_pylist([{f.name: r[f.name] for f in schema} for r in rows], schema)

    kinds = {"string": pa.string(), "int": pa.int32()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (part.split() for part in CHUNK.split(", "))])
    target, overlap = chunk_sizes(F.col("budget"))
    rows = sources.select(F.col("page_id").cast("string").alias("page_id"), F.sha2("content", 256).alias("source_hash"), target.alias("target"), overlap.alias("overlap"), F.col("content").cast("string").alias("content"))
    return rows.where(F.col("page_id").isNotNull() & (F.char_length("content") > F.col("target"))).mapInArrow(run, CHUNK)


def progress(steps: DataFrame) -> DataFrame:
    """How far each source is: its key, ``done`` and ``digest``."""
    return steps.where("problem is null").groupBy(*KEY).agg(F.max("index").alias("done"), F.max_by("digest", F.when(F.col("digest").isNotNull(), F.col("index"))).alias("digest"))


def _folded(call: Call, run: int):
    trim, section, digest_most, note_most = trimmed, heading_section, DIGEST_MOST, NOTE_MOST

    def fold(part):
        import pandas as pd

        part = part.drop_duplicates("index").sort_values("index")
        head = part.iloc[0][KEY].to_dict()
        digest = part.before.iloc[0] if isinstance(part.before.iloc[0], str) else ""
        out = []
        for chunk in part.drop(columns=["before"]).to_dict("records"):
            try:
                raw = call(trim(digest, digest_most), chunk)
            except Exception as e:  # noqa: BLE001 - a failed call ends the source's run, and is told
                out.append(head | {"index": chunk["index"], "note": None, "problem": f"{type(e).__name__}: {e}"})
                break
            said = section(raw, "Chunk Analysis") or raw.strip()
            where = f" — {chunk['heading_path']}" if chunk["heading_path"] else ""
            digest = trim(section(raw, "Updated Global Digest") or "\n\n".join(filter(None, [digest, said])), digest_most)
            out.append(head | {"index": chunk["index"], "note": f"## Chunk {chunk['index']}/{chunk['total']}{where}\n{trim(said, note_most)}", "problem": None})
        done = [r for r in out if r["problem"] is None]
        for row in out:
            row |= {"digest": digest if done and row is done[-1] else None, "run": run}
        return pd.DataFrame(out, columns=[p.split()[0] for p in STEP.split(", ")])

    return fold


def analyse(sources: DataFrame, store: Store, run: int, call: Call, steps: int = 16, rounds: int | None = None) -> int:
    """Work through the chunks of long sources (page_id, content, budget) and return the number of rounds that were made.

    ``store`` holds SCHEMAS and was claimed as ``run``; a newer run's claim ends this one with ``StaleRun``. A source whose call fails keeps
    its steps so far and waits for the next run. With ``rounds`` the run ends after so many. Sources without an id are passed over, repeated
    rows count once, null and short texts need no steps."""
    chunks = materialize(cut_sources(sources), "chunks")
    made = 0
    while rounds is None or made < rounds:
        known = store.read("steps")
        failed = known.where((F.col("run") == run) & F.col("problem").isNotNull()).select(*KEY).distinct()
        rows = chunks.join(progress(known).withColumnRenamed("digest", "before"), KEY, "left").join(failed, KEY, "left_anti")
        done = F.coalesce("done", F.lit(0))
        due = rows.where((F.col("index") > done) & (F.col("index") <= done + steps)).drop("done")
        folder = store.stage(due.groupBy(*KEY).applyInPandas(_folded(call, run), STEP), "steps")
        if store.staged("steps", folder).isEmpty():
            store.discard([folder])
            break
        store.commit(run, append={"steps": folder})
        made += 1
    return made


def plans(sources: DataFrame, store: Store) -> DataFrame:
    """``page_id, chunked, done, total, analysis, context, problem`` for every source row: what later steps read instead of the text.

    A source of one chunk has no analysis, and its own text as context. ``done`` below ``total`` tells one that isn't finished, ``problem``
    the last failure since its last step."""
    target, overlap = chunk_sizes(F.col("budget"))
    rows = sources.select("page_id", "content", "budget", F.sha2("content", 256).alias("source_hash"), target.alias("target"), overlap.alias("overlap"))
    steps = store.read("steps")
    good = steps.where("problem is null")
    notes = good.groupBy(*KEY).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("index", "note"))), lambda x: x.note), "\n\n").alias("notes"))
    bad = steps.where("problem is not null").groupBy(*KEY).agg(F.max("index").alias("at"), F.max_by("problem", F.struct("index", "run")).alias("problem"))
    state = progress(steps).join(notes, KEY).join(bad, KEY, "full")
    same = ["page_id", "source_hash", "target", "overlap"]
    found = rows.withColumn("page_id", F.col("page_id").cast("string")).join(state, same, "left")
    chunked = F.col("total").isNotNull()
    digest = F.when(F.coalesce("digest", F.lit("")) != "", F.col("digest")).otherwise("(No digest produced.)")
    most = F.greatest(F.col("budget"), F.lit(NOTE_MOST)).cast("int")
    cut = F.when(F.char_length("notes") > most, F.concat(F.regexp_replace(F.left("notes", most), r"\s+$", ""), F.lit(CUT))).otherwise(F.coalesce("notes", F.lit("")))
    final = F.concat(F.lit("## Final Global Digest\n"), digest)
    analysis = F.concat(F.lit("# Consolidated Long-Document Analysis\n\n"), final, F.lit("\n\n## Per-Chunk Analyses\n"), F.coalesce("notes", F.lit("")))
    told = F.concat(F.lit("# Long Source Context: "), "page_id", F.lit("\n\nRead in "), "total", F.lit(" overlapping chunks; what follows stands for the whole source.\n\n"), final, F.lit("\n\n## Chunk Analysis Notes\n"), cut)
    problem = F.when(F.col("at") > F.coalesce("done", F.lit(0)), F.col("problem"))
    return found.select(
        "page_id", chunked.alias("chunked"), F.when(chunked, F.coalesce("done", F.lit(0))).alias("done"), "total", F.when(chunked, analysis).otherwise("").alias("analysis"), F.when(chunked, told).otherwise(F.col("content")).alias("context"), problem.alias("problem")
    )
