"""Readers: wiki folders, listings, documents of many formats, state files, and address lists.

Files are read by Spark (binaryFile or text), so any store that Spark reads will do. Formats are told by extension and
turned into Markdown by plain functions of the standard library inside one Arrow function, with errors as a column.
"""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions import text as T
from weft.sources.compound import doc, xls
from weft.sources.mobi import mobi
from weft.sources.pdf import pdf

MOST_BYTES = 256 * 1024 * 1024
MOST_CHAPTERS = 2_000


def files(spark: SparkSession, folder: str, content: bool = True, pattern: str | None = None) -> DataFrame:
    """(path, file, size, mtime[, content]) of all files below a folder; path is relative to it."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    df = (reader.option("pathGlobFilter", pattern) if pattern else reader).load(folder)
    relative = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/*", "/"), "^" + re.escape("/" + re.sub(r"^[a-z]+:/*", "", folder).strip("/")) + "/", "")
    columns = [relative.alias("path"), F.col("path").alias("file"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime")]
    return df.select(*columns, *(["content"] if content else []))


def wiki_pages(spark: SparkSession, folder: str, cap: int | None = None) -> DataFrame:
    """Pages of a wiki: path, title, type, content, links and sources of its Markdown files, hidden files left out: all of them, or
    the first ``cap`` by path where that is given."""
    found = files(spark, folder, pattern="*.md").where(~T.hidden(F.col("path")))
    found = found if cap is None else found.orderBy("path").limit(cap)
    text = F.decode("content", "UTF-8")
    rows = found.select("path", text.alias("content"), T.file_name(F.col("path")).alias("name"))
    return rows.select("path", T.title(F.col("content"), F.col("name")).alias("title"), T.page_type(F.col("content")).alias("type"), "content", T.wikilinks(F.col("content")).alias("links"), T.list_field(F.col("content"), "sources").alias("sources"))


def listing(spark: SparkSession, folder: str, hidden: bool = False, max_depth: int = 30, max_files: int | None = None) -> DataFrame:
    """(path, name, parent, is_dir, size) of files and their folders, folders first, then by name. More files than
    ``max_files`` is an error, not a cut."""
    found = files(spark, folder, content=False)
    found = found if hidden else found.where(~T.hidden(F.col("path")))
    found = found.where(F.size(F.split("path", "/")) <= max_depth)
    if max_files is not None and found.limit(max_files + 1).count() > max_files:
        raise ValueError(f"more than {max_files} files")
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    folders = found.where(F.size(parts) > 1).select(F.explode(above).alias("path")).distinct().select("path", F.lit(True).alias("is_dir"), F.lit(None).cast("long").alias("size"))
    rows = found.select("path", F.lit(False).alias("is_dir"), "size").unionByName(folders)
    parent = F.when(F.instr("path", "/") > 0, F.regexp_replace("path", "/[^/]*$", "")).otherwise("")
    return rows.select("path", T.file_name(F.col("path")).alias("name"), parent.alias("parent"), "is_dir", "size").orderBy("parent", F.col("is_dir").desc(), F.lower("name"), "path")


# ---- formats

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def _zip(data: bytes) -> zipfile.ZipFile:
    z = zipfile.ZipFile(io.BytesIO(data))
    if sum(i.file_size for i in z.infolist()) > MOST_BYTES:
        raise ValueError("archive unpacks to too much")
    return z


def pipe_table(rows: list[list[str]]) -> str:
    """Rows as a Markdown table: padded, with pipes escaped."""
    width = max(map(len, rows), default=0)
    clean = [[c.replace("|", "\\|").replace("\n", " ").strip() for c in r] + [""] * (width - len(r)) for r in rows]
    lines = ["| " + " | ".join(r) + " |" for r in clean]
    return "\n".join([*lines[:1], "|" + " --- |" * width, *lines[1:]]) if width else ""


def docx(data: bytes) -> str:
    def runs(p) -> str:
        out = []
        for r in p.iter(f"{W}r"):
            t = "".join(x.text or "" if x.tag == f"{W}t" else "\t" if x.tag == f"{W}tab" else "\n" if x.tag == f"{W}br" else "" for x in r)
            on = lambda tag, r=r: (e := r.find(f"{W}rPr/{W}{tag}")) is not None and e.get(f"{W}val") not in ("0", "false")
            if t.strip():
                t = f"**{t.strip()}**" if on("b") else t
                t = f"*{t.strip()}*" if on("i") else t
            out.append(t)
        return "".join(out).strip()

    def block(e) -> str:
        if e.tag == f"{W}tbl":
            return pipe_table([[" ".join(runs(p) for p in c.iter(f"{W}p")) for c in row.findall(f"{W}tc")] for row in e.findall(f"{W}tr")])
        style = e.find(f"{W}pPr/{W}pStyle")
        name, text = (style.get(f"{W}val") or "") if style is not None else "", runs(e)
        head = re.fullmatch(r"(?i)heading\s*([1-6])", name)
        if text and head:
            return "#" * int(head[1]) + " " + text
        if text and e.find(f"{W}pPr/{W}numPr") is not None:
            return "- " + text
        return ("# " if text and name.lower() == "title" else "") + text

    body = ET.fromstring(_zip(data).read("word/document.xml")).find(f"{W}body")
    return "\n\n".join(b for b in (block(e) for e in body if e.tag in (f"{W}p", f"{W}tbl")) if b)


def pptx(data: bytes) -> str:
    z = _zip(data)
    slides = sorted((int(m[1]), n) for n in z.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
    out = []
    for number, name in slides:
        lines = [t for p in ET.fromstring(z.read(name)).iter(f"{A}p") if (t := "".join(x.text or "" for x in p.iter(f"{A}t")).strip())]
        out.append("\n".join([f"## Slide {number}", *[f"**{t}**" if i == 0 else f"- {t}" for i, t in enumerate(lines)]]))
    return "\n\n".join(out)


def cell_text(value: str) -> str:
    """A number as an integer where it's one, else with two decimals; other text as it is."""
    try:
        x = float(value)
    except ValueError:
        return value
    return str(int(x)) if x == int(x) and abs(x) < 1e15 else f"{x:.2f}"


#: Errors in cells and their names.
CELL_ERRORS = {"#NULL!": "Null", "#DIV/0!": "Div0", "#VALUE!": "Value", "#REF!": "Ref", "#NAME?": "Name", "#NUM!": "Num", "#N/A": "NA", "#GETTING_DATA": "GettingData"}


def xlsx(data: bytes) -> str:
    z = _zip(data)
    shared = ["".join(t.text or "" for t in s.iter(f"{S}t")) for s in ET.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in z.namelist() else []
    names = [s.get("name") for s in ET.fromstring(z.read("xl/workbook.xml")).iter(f"{S}sheet")]
    sheets = sorted((int(m[1]), n) for n in z.namelist() if (m := re.fullmatch(r"xl/worksheets/sheet(\d+)\.xml", n)))
    out = []
    for (_, path), name in zip(sheets, names, strict=False):
        rows = []
        for row in ET.fromstring(z.read(path)).iter(f"{S}row"):
            cells: list[str] = []
            for c in row.findall(f"{S}c"):
                letters = re.match("[A-Z]+", c.get("r") or "")
                if letters:
                    at = 0
                    for ch in letters[0]:
                        at = at * 26 + ord(ch) - 64
                    cells += [""] * (min(at, 16_384) - 1 - len(cells))
                v = c.find(f"{S}v")
                value = (v.text or "") if v is not None else "".join(t.text or "" for t in c.iter(f"{S}t"))
                kind = c.get("t")
                if kind in ("b", "e") and value:
                    value = str(value == "1").lower() if kind == "b" else "ERR:" + CELL_ERRORS.get(value, value)
                cells.append(shared[int(value)] if kind == "s" and value else value if kind in ("str", "inlineStr", "b", "e") else cell_text(value) if value else "")
            rows.append(cells)
        table = pipe_table([r for r in rows if any(r)])
        if table:
            out.append((f"## {name}\n\n" if len(sheets) > 1 else "") + table)
    return "\n\n".join(out)


def opendocument(data: bytes) -> str:
    root = ET.fromstring(_zip(data).read("content.xml"))
    lines = ["".join(e.itertext()).strip() for e in root.iter() if e.tag.endswith("}p") or e.tag.endswith("}h")]
    return "\n".join(x for x in lines if x)


def epub(data: bytes) -> str:
    from weft.functions.html import markdown, parse

    z = _zip(data)
    if "META-INF/encryption.xml" in z.namelist():
        raise ValueError("protected book")
    root = ET.fromstring(z.read("META-INF/container.xml"))
    opf = next(e.get("full-path") for e in root.iter() if e.tag.endswith("}rootfile"))
    pack, base = ET.fromstring(z.read(opf)), opf.rpartition("/")[0]
    meta = {e.tag.rsplit("}", 1)[-1]: (e.text or "").strip() for e in pack.iter() if "purl.org/dc" in e.tag}
    items = {e.get("id"): e.get("href") for e in pack.iter() if e.tag.endswith("}item")}
    order = [items[i] for e in pack.iter() if e.tag.endswith("}itemref") and (i := e.get("idref")) in items][:MOST_CHAPTERS]
    head = [f"# {meta['title']}"] * bool(meta.get("title")) + [f"**Author:** {meta['creator']}"] * bool(meta.get("creator"))
    chapters = [markdown(parse(z.read(f"{base}/{href}" if base else href).decode("utf-8", "replace"))) for href in order]
    return "\n\n".join([*head, *[c for c in chapters if c]])


def org(data: bytes) -> str:
    """Org-mode as Markdown: headings, blocks, keywords, tables and links."""
    out, code = [], False
    for line in data.decode("utf-8", "replace").replace("\r\n", "\n").split("\n"):
        block = re.match(r"(?i)\s*#\+(begin|end)_(\w+)\s*(\S*)", line)
        if block:
            kind, opens = block[2].lower(), block[1].lower() == "begin"
            if kind in ("src", "example"):
                code = opens
                out.append("```" + (block[3] if opens else ""))
            continue
        if code:
            out.append(line)
            continue
        key = re.match(r"(?i)\s*#\+(\w+):\s*(.*)$", line)
        if key:
            if key[1].lower() == "title":
                out.append(f"# {key[2]}")
            continue
        head = re.match(r"(\*+)\s+(?:(?:TODO|DONE)\s+)?(.*?)(?:\s+:[\w:@]+:)?\s*$", line)
        if head:
            out.append("#" * min(len(head[1]), 6) + " " + head[2])
            continue
        if re.match(r"\s*\|[-+|]+\|?\s*$", line):
            line = re.sub(r"[^|+]+", " --- ", line.strip().strip("|")).replace("+", "|")
            line = f"|{line}|"
        line = re.sub(r"\[\[([^\]]+)\]\[([^\]]+)\]\]", r"[\2](\1)", line)
        line = re.sub(r"\[\[(https?:[^\]]+)\]\]", r"<\1>", line)
        line = re.sub(r"(?<!\S)/([^/\s][^/]*)/(?!\w)", r"*\1*", re.sub(r"(?<!\S)\*([^*\s][^*]*)\*(?!\w)", r"**\1**", line))
        out.append(re.sub(r"(?<!\S)[=~]([^=~]+)[=~](?!\w)", r"`\1`", line))
    return "\n".join(out).strip()


def _text(data: bytes) -> str:
    return data.decode("utf-8", "replace")


def _page(data: bytes) -> str:
    from weft.functions.html import article, markdown

    return markdown(article(_text(data)))


FORMATS: dict[str, Callable[[bytes], str]] = {"docx": docx, "pptx": pptx, "xlsx": xlsx, "odt": opendocument, "odp": opendocument, "ods": opendocument, "epub": epub, "mobi": mobi, "org": org, "html": _page, "htm": _page, "pdf": pdf, "doc": doc, "xls": xls}
MEDIA = ("png", "jpg", "jpeg", "gif", "webp", "svg", "bmp", "ico", "mp4", "webm", "mov", "avi", "mkv", "mp3", "wav", "ogg", "flac", "m4a")
#: Formats that aren't read; their rows say so.
UNSUPPORTED = ("ppt",)


def extract(rows: DataFrame) -> DataFrame:
    """(path, text, error) of files (path, content): Markdown by extension, a placeholder for media, an error for formats that
    aren't supported or broken files."""

    def one(path: str, data: bytes) -> tuple[str | None, str | None]:
        ext = path.rsplit(".", 1)[-1].lower()
        if ext in MEDIA:
            return f"[{ext} file: {path.rsplit('/', 1)[-1]}]", None
        if ext in UNSUPPORTED:
            return None, f"{ext} is not supported"
        try:
            return FORMATS.get(ext, _text)(data or b""), None
        except Exception as e:  # noqa: BLE001 - any broken file
            return None, f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 16):
                some = batch.slice(at, 16)
                found = [one(p, d) for p, d in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True)]
                yield pa.record_batch([some.column(0), pa.array([t for t, _ in found], pa.string()), pa.array([e for _, e in found], pa.string())], names=["path", "text", "error"])

    return rows.select("path", "content").mapInArrow(run, "path string, text string, error string")


def cached_extract(sources: DataFrame, cache: DataFrame) -> DataFrame:
    """(path, text, error, mtime): cached texts (path, text, mtime) as new as their file (path, content, mtime), the rest read anew."""
    fresh = cache.select("path", "text", F.col("mtime").alias("cached"))
    hits = sources.join(fresh, "path").where("cached >= mtime").select("path", "text", F.lit(None).cast("string").alias("error"), "mtime")
    missed = sources.join(hits.select("path"), "path", "left_anti")
    return hits.unionByName(extract(missed).join(missed.select("path", "mtime"), "path"))


def images(rows: DataFrame, least: int = 100, most: int = 500) -> DataFrame:
    """(path, index, mime, width, height, sha256, page) of images inside office files, books and PDF files (``pdf_images`` says which), of
    100 pixels and more, the first 500 a file; ``page`` is a PDF file's. Broken files give none from the place where they break."""
    import hashlib
    import struct
    import zlib

    from weft.sources.pdf_images import pdf_images

    def size(data: bytes) -> tuple[str, int, int] | None:
        if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
            return ("image/png", *struct.unpack(">II", data[16:24]))
        if data[:6] in (b"GIF87a", b"GIF89a") and len(data) >= 10:
            return ("image/gif", *struct.unpack("<HH", data[6:10]))
        if data[:2] == b"\xff\xd8":
            at = 2
            while at + 9 < len(data) and data[at] == 0xFF:
                if data[at + 1] in range(0xC0, 0xC4):
                    h, w = struct.unpack(">HH", data[at + 5 : at + 9])
                    return "image/jpeg", w, h
                at += 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
        return None

    def found(path: str, data: bytes) -> list[tuple]:
        out = []
        if b"%PDF-" in data[:1024]:
            try:
                for i in pdf_images(data, least, most):
                    out.append((path, len(out), i.mime, i.width, i.height, hashlib.sha256(i.content).hexdigest(), i.page))
            except (ValueError, KeyError, TypeError, zlib.error):
                return out
            return out
        try:
            z = _zip(data)
            for name in sorted(n for n in z.namelist() if re.search(r"(?i)\.(png|jpe?g|gif)$", n)):
                raw = z.read(name)
                s = size(raw)
                if s and s[1] >= least and s[2] >= least and len(out) < most:
                    out.append((path, len(out), *s, hashlib.sha256(raw).hexdigest(), None))
        except (zipfile.BadZipFile, ValueError):
            return out
        return out

    names = ["path", "index", "mime", "width", "height", "sha256", "page"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, d in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                got = found(p, d or b"")
                if got:
                    yield pa.record_batch([pa.array(x) for x in zip(*got, strict=True)], names=names).cast(pa.schema([("path", pa.string()), ("index", pa.int32()), ("mime", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("sha256", pa.string()), ("page", pa.int32())]))

    return rows.select("path", "content").mapInArrow(run, "path string, index int, mime string, width int, height int, sha256 string, page int")


# ---- addresses

PRIVATE = r"(?i)^(localhost|.*\.local|0\.0\.0\.0|127\.|10\.|192\.168\.|169\.254\.|172\.(1[6-9]|2\d|3[01])\.|\[?::1|\[?f[cd])"


def url_lines(text: Column) -> Column:
    """Trimmed lines of a pasted list that aren't empty."""
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def url_batch(lists: DataFrame, column: str = "text", most: int = 50) -> DataFrame:
    """(pos, url) of one pasted list: http(s) addresses without credentials and outside private networks, without fragments,
    each once in order. More than ``most`` is an error."""
    rows = lists.select(F.posexplode(url_lines(F.col(column))).alias("pos", "raw"))
    url = F.regexp_replace("raw", "#.*$", "")
    host = F.regexp_extract(url, r"^https?://([^/?]+)", 1)
    good = rows.select("pos", url.alias("url"), host.alias("host")).where(F.col("url").rlike(r"(?i)^https?://[^\s/]+") & ~F.contains("host", F.lit("@")) & ~F.col("host").rlike(PRIVATE))
    out = good.groupBy("url").agg(F.min("pos").alias("pos")).select("pos", "url")
    if out.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} addresses")
    return out.orderBy("pos")


def json_state(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A state file (an array of objects, or objects by line) with its schema."""
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def scheduled_import(listing_: DataFrame, known: DataFrame, cap: int = 100 * 1024 * 1024) -> DataFrame:
    """New and changed files (path, size, content) of a listing: within the size cap, of a readable kind, not hidden, not
    sensitive configuration, and not known (path, md5)."""
    from weft.functions.files import ingestable

    rows = listing_.where((F.col("size") <= cap) & ingestable(F.col("path")) & ~T.sensitive_config(F.col("path"))).withColumn("md5", F.md5("content"))
    return rows.join(known.select("path", "md5"), ["path", "md5"], "left_anti")


def cache_probe(files_: DataFrame, cache: DataFrame, existing: DataFrame) -> DataFrame:
    """Sources (path, content) with ``hit``: the cached hash (path, hash, outputs) is that of the content and all outputs (path) exist."""
    out = cache.select(F.col("path").alias("src"), "hash", F.explode_outer("outputs").alias("path")).join(existing.select("path", F.lit(True).alias("there")), "path", "left")
    whole = out.groupBy("src", "hash").agg(F.bool_and(F.col("path").isNull() | F.coalesce("there", F.lit(False))).alias("whole"))
    rows = files_.withColumn("hash", F.sha2("content", 256)).join(whole.withColumnRenamed("src", "path"), ["path", "hash"], "left")
    return rows.withColumn("hit", F.coalesce("whole", F.lit(False))).drop("whole")
