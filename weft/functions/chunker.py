"""Cutting pages into chunks for embedding: by headings, blocks, paragraphs, lines, sentences and words.

A chunk is a span of the text, so offsets are exact; chunks of a section follow each other without gaps. Fenced
code and tables are never cut. The work is local to a page, so pages run through one Arrow function.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FRONT = re.compile(r"\A---[ \t]*\r?\n.*?\r?\n---[ \t]*(?:\r?\n|\Z)", re.S)
HEADING = re.compile(r"(#{1,6})[ \t]+(.*?)[ \t#]*$")
FENCE = re.compile(r"[ \t]{0,3}(`{3,}|~{3,})")
#: Where a text that is too long may be cut, the best place first.
BREAKS = (re.compile(r"\n[ \t]*\n+"), re.compile(r"\n"), re.compile(r"[.!?;][ \n]+|[。！？；]"), re.compile(r"[ \t　]+"))
SENTENCE_END = re.compile(r"[。！？!?.;；]\s*")


@dataclass(frozen=True)
class Options:
    target: int = 1000
    most: int = 1500
    least: int = 200
    overlap: int = 200

    def sane(self) -> Options:
        most = max(self.most, self.target)
        return Options(self.target, most, self.least, self.target // 2 if self.overlap >= self.target else self.overlap)


Span = tuple[int, int]


def sections(text: str, at: int) -> Iterator[tuple[str, int, int]]:
    """(heading path, start, end) of the parts between headings outside of fences."""
    path: dict[int, str] = {}
    start, fence = at, ""
    for m in re.finditer(r".*(?:\n|\Z)", text[at:]):
        line, a = m[0].rstrip("\r\n"), at + m.start()
        mark = FENCE.match(line)
        if mark and (not fence or (mark[1][0] == fence[0] and len(mark[1]) >= len(fence))):
            fence = "" if fence else mark[1]
        head = None if fence or mark else HEADING.match(line)
        if head:
            yield " > ".join(path[k] for k in sorted(path)), start, a
            level = len(head[1])
            path = {k: v for k, v in path.items() if k < level} | {level: f"{head[1]} {head[2]}"}
            start = at + m.end()
    yield " > ".join(path[k] for k in sorted(path)), start, len(text)


def _atoms(text: str, start: int, end: int) -> Iterator[tuple[Span, bool]]:
    """Spans of a section, and whether each must stay whole: fenced code, and two table lines and more."""
    run, plain, fence, table = start, start, "", []

    def flush(upto: int) -> Iterator[tuple[Span, bool]]:
        if upto > plain:
            yield (plain, upto), False

    for m in re.finditer(r".*(?:\n|\Z)", text[start:end]):
        if m.start() == m.end():
            break
        line, a, b = m[0].rstrip("\r\n"), start + m.start(), start + m.end()
        mark = FENCE.match(line)
        if fence:
            if mark and mark[1][0] == fence[0] and len(mark[1]) >= len(fence) and not line.strip(" \t`~"):
                yield (run, b), True
                fence, plain = "", b
            continue
        if line.lstrip().startswith("|") and len(line.strip()) > 1:
            table.append((a, b))
            continue
        if len(table) > 1:
            yield from flush(table[0][0])
            yield (table[0][0], table[-1][1]), True
            plain = table[-1][1]
        table = []
        if mark:
            yield from flush(a)
            fence, run, plain = mark[1], a, a
    if fence:
        yield (run, end), True
        return
    if len(table) > 1:
        yield from flush(table[0][0])
        yield (table[0][0], table[-1][1]), True
        plain = table[-1][1]
    yield from flush(end)


def _split(text: str, span: Span, size: int, level: int = 0) -> list[Span]:
    """A span as spans of at most ``size`` characters, cut at the best places that do."""
    a, b = span
    if b - a <= size:
        return [span]
    if level == len(BREAKS):
        return [(i, min(i + size, b)) for i in range(a, b, size)]
    cuts = [a, *[m.end() for m in BREAKS[level].finditer(text, a, b) if m.end() < b], b]
    return [piece for x, y in zip(cuts[:-1], cuts[1:], strict=True) if y > x for piece in _split(text, (x, y), size, level + 1)]


def _packed(spans: list[Span], options: Options) -> list[Span]:
    """Neighbours joined up to the target; then a small one with the next, up to the most."""
    out: list[Span] = []
    for a, b in spans:
        if out and b - out[-1][0] <= options.target:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    merged: list[Span] = []
    for a, b in out:
        if merged and merged[-1][1] - merged[-1][0] < options.least and b - merged[-1][0] <= options.most:
            merged[-1] = (merged[-1][0], b)
        else:
            merged.append((a, b))
    return merged


def _overlapped(text: str, start: int, size: int, floor: int) -> int:
    """Where a chunk starts with up to ``size`` characters of the one before, from the start of a sentence or word."""
    at = max(floor, start - size)
    tail = text[at:start]
    end = SENTENCE_END.search(tail)
    if end and 0 < end.end() < len(tail):
        return at + end.end()
    blank = re.search(r"\s", tail)
    return at + blank.start() + 1 if blank and blank.start() < len(tail) - 1 else at


def chunk(text: str | None, options: Options = Options()) -> list[dict]:
    """The chunks of a page: index, text, heading_path, char_start, char_end, oversized. None for blank pages."""
    options, text = options.sane(), text or ""
    front = FRONT.match(text)
    out: list[dict] = []
    for path, start, end in sections(text, front.end() if front else 0):
        if not text[start:end].strip():
            continue
        spans = [s for atom, whole in _atoms(text, start, end) for s in ([atom] if whole else _split(text, atom, options.target))]
        packed = [s for s in _packed(spans, options) if text[slice(*s)].strip()]
        for i, (a, b) in enumerate(packed):
            own = a if i == 0 or options.overlap <= 0 else _overlapped(text, a, options.overlap, packed[i - 1][0])
            out.append({"index": len(out), "text": text[own:b], "heading_path": path, "char_start": own, "char_end": b, "oversized": b - a > options.most})
    return out


CHUNK = pa.list_(pa.struct([("index", pa.int32()), ("text", pa.string()), ("heading_path", pa.string()), ("char_start", pa.int32()), ("char_end", pa.int32()), ("oversized", pa.bool_())]))


def chunk_pages(pages: DataFrame, id_col: str = "page_id", text_col: str = "content", options: Options = Options()) -> DataFrame:
    """A row for each chunk of each page: page_id, chunk_id and the chunk's fields."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                some = batch.slice(at, 64)
                yield pa.record_batch([some.column(0), pa.array([chunk(t, options) for t in some.column(1).to_pylist()], CHUNK)], names=["page_id", "chunks"])

    rows = pages.select(F.col(id_col).cast("string").alias("page_id"), F.col(text_col).alias("content"))
    found = rows.mapInArrow(run, "page_id string, chunks array<struct<index: int, text: string, heading_path: string, char_start: int, char_end: int, oversized: boolean>>")
    return found.select("page_id", F.inline("chunks")).withColumn("chunk_id", F.concat_ws("#", "page_id", F.col("index").cast("string")))


def semantic_chunks(text: str | None, target: int = 6000, overlap: int = 400) -> list[dict]:
    """Pieces of a long source for step-by-step analysis: paragraphs packed to the target, each with the end of the one before."""
    text = text or ""
    packed = _packed(_split(text, (0, len(text)), target), Options(target, target, 0, 0)) if text.strip() else []
    return [{"index": i, "text": text[a:b], "overlap_before": text[_overlapped(text, a, overlap, packed[i - 1][0]) : a] if i else "", "char_start": a, "char_end": b} for i, (a, b) in enumerate(packed)]


def fold_chunks(chunks: DataFrame, analyse, checkpoint: DataFrame | None = None) -> DataFrame:
    """(page_id, done, digest): chunks of a page folded in order by an injected function (digest, text) to digest.

    A checkpoint (page_id, done, digest) says how many chunks of a page are done; the fold goes on from there."""
    import pandas as pd

    state = checkpoint if checkpoint is not None else chunks.sparkSession.createDataFrame([], "page_id string, done int, digest string")
    rows = chunks.select("page_id", "index", "text").join(state, "page_id", "left")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("index")
        done = 0 if pd.isna(part.done.iloc[0]) else int(part.done.iloc[0])
        digest = part.digest.iloc[0] if isinstance(part.digest.iloc[0], str) else ""
        for text in part.text.iloc[done:]:
            digest, done = analyse(digest, text), done + 1
        return pd.DataFrame({"page_id": [part.page_id.iloc[0]], "done": [done], "digest": [digest]})

    return rows.groupBy("page_id").applyInPandas(run, "page_id string, done int, digest string")
