"""Token ids in plane files: write a corpus once, read it back whole or by chunk.

A file holds documents one after another, each ending with an end id. Ids are 32-bit and cut into
blocks of a fixed size; a block is transposed into planes (four byte planes, or 32 bit planes), each
compressed with zstandard; planes of zeros take no room. Behind the blocks stand the chunk index
(place, number of ids and plane sizes of each block) and the document table, so that a reader can
seek to any block:

    magic | plane bytes of block 0, 1, ... | footer (zstd of JSON line + arrays) | footer size (8 bytes) | magic

Documents are dealt to files by ranges of doc_id, so files in order hold documents in ascending
order. A file is written under a new name for each attempt of a task, and the manifest, itself written
to shared storage, names the files of the attempts that counted: a lost executor or a repeated task
leaves a file that nobody reads. Files are reached through Arrow's file systems (local, HDFS, S3, ...).
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.arrow import Numbered, pieces
from weft.session import checkpoint_dir, materialize, remove_at_end

MAGIC = b"WFTPLN01"
BLOCK_IDS = 1 << 16
#: Bytes of text that a file is made for; more text makes more files.
FILE_BYTES = 256 << 20
END_ID = 0
MEMO_PIECES = 600_000
MANIFEST = "part int, path string, n_docs long, n_tokens long, n_bytes long"


# ---- ids


def _parts(piece: str) -> list[str]:
    """A piece cut at single line breaks, and before a last mark of punctuation behind a letter: the library splits there too."""
    if "\n" not in piece:
        return [piece[:-1], piece[-1]] if piece[-1] in ".,;:!?" and len(piece) > 2 and piece[-2].isalpha() else [piece]
    out = []
    for i, line in enumerate(piece.split("\n")):
        if not line or line[0].isspace() and i or line[-1].isspace():
            return [piece]
        out += ["\n"] if i else []
        out += [line[:-1], line[-1]] if line[-1] in ".,;:!?" and len(line) > 2 and line[-2].isalpha() else [line]
    return out


class Encoder:
    """Ids of whole texts by a byte-level BPE of the tokenizers library.

    The library splits a text before it merges, and no split reaches over the space that starts a
    word. So a text is cut before each single space that stands between non-space characters, and
    the library encodes each distinct piece once; the memo of pieces is bounded. A text where a cut
    could matter (double spaces, space at an end or next to other white space) goes to the library whole.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._clear()

    def _clear(self) -> None:
        self.numbers, self.parts = Numbered(), Numbered()
        self.ids: list[bytes | None] = []
        self.part_ids: list[bytes] = []

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [array("I", x.ids).tobytes() for x in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _encode_parts(self, parts: list[str]) -> list[bytes]:
        """The ids of each part. Parts of a space and letters stay apart in the library even side by side, so many go to it
        as one text, whose words it numbers; if it counts other words than parts, they go one by one."""
        out: list[bytes | None] = [None] * len(parts)
        simple = [i for i, p in enumerate(parts) if p[0] == " " and p[1:].isalpha()]
        for at in range(0, len(simple), 512):
            some = simple[at : at + 512]
            found = self.tokenizer.encode("".join([parts[i] for i in some]), add_special_tokens=False)
            words = np.array(found.word_ids, np.int64)
            if words[-1] + 1 == len(some):
                raw, cuts = array("I", found.ids).tobytes(), (4 * np.searchsorted(words, np.arange(len(some) + 1))).tolist()
                for i, a, b in zip(some, cuts[:-1], cuts[1:], strict=True):
                    out[i] = raw[a:b]
        rest = [i for i, x in enumerate(out) if x is None]
        for at in range(0, len(rest), 4096):
            some = rest[at : at + 4096]
            for i, ids in zip(some, self._encode([parts[j] for j in some]), strict=True):
                out[i] = ids
        return out

    def texts(self, texts: list[bytes | None]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        if len(self.numbers) > MEMO_PIECES:
            self._clear()
        whole = [(t or b"").decode("utf-8", "replace") for t in texts]
        number, split = self.numbers.__getitem__, []
        for t in whole:
            words = t.split(" ")
            words[0] = " " + words[0]  # marks the piece that has no space before it; no other piece holds one
            split.append(list(map(number, words)))
        fresh = self.numbers.take()
        found: list[bytes | None] = [None] * len(fresh)
        part, cut, at = self.parts.__getitem__, [], []
        for i, p in enumerate(fresh):
            first = p[:1] == " "
            own = p[1:] if first else p
            if own and not own[0].isspace() and not own[-1].isspace():
                cut.append(list(map(part, _parts(own if first else " " + own))))
                at.append(i)
        self.part_ids += self._encode_parts(self.parts.take())
        of = self.part_ids.__getitem__
        for i, parts in zip(at, cut, strict=True):
            found[i] = b"".join(map(of, parts))
        self.ids += found
        ids, out = self.ids.__getitem__, []
        for t, s in zip(whole, split, strict=True):
            parts = list(map(ids, s))
            out.append(self._encode([t])[0] if None in parts else b"".join(parts))
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


# ---- blocks


def pack(ids: np.ndarray, planes: str, level: int = 3) -> list[bytes]:
    """The compressed planes of a block; a plane of zeros is empty."""
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if planes == "byte":
        rows = [np.ascontiguousarray(raw[:, i]) for i in range(4)]
    else:
        bits = np.unpackbits(raw, axis=1, bitorder="little")
        rows = [np.packbits(bits[:, i], bitorder="little") for i in range(32)]
    squeeze = zstandard.ZstdCompressor(level=level).compress
    return [squeeze(r.tobytes()) if r.any() else b"" for r in rows]


def unpack(parts: list[bytes], n: int, planes: str) -> np.ndarray:
    """The ids of a block of n."""
    width = n if planes == "byte" else -(-n // 8)
    expand = zstandard.ZstdDecompressor().decompress
    rows = [np.frombuffer(expand(p, max_output_size=width), np.uint8) if p else np.zeros(width, np.uint8) for p in parts]
    if planes == "byte":
        return np.ascontiguousarray(np.stack(rows, axis=1)).view("<u4").ravel()
    bits = np.stack([np.unpackbits(r, count=n, bitorder="little") for r in rows], axis=1)
    return np.ascontiguousarray(np.packbits(bits, axis=1, bitorder="little")).view("<u4").ravel()


class Writer:
    """Streams documents into one file; holds one block of ids, and 16 bytes for each document."""

    def __init__(self, sink, planes: str = "byte", block_ids: int = BLOCK_IDS) -> None:
        self.sink, self.planes, self.block = sink, planes, block_ids
        self.sink.write(MAGIC)
        self.at = len(MAGIC)
        self.waiting = bytearray()
        self.chunks: list[tuple[int, int, list[int]]] = []
        self.docs: list[int | None] = []
        self.sizes: list[int] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append(doc_id)
        self.sizes.append(len(ids) // 4)
        self.waiting += ids
        size = 4 * self.block
        if len(self.waiting) >= size:
            whole = len(self.waiting) // size * size
            for a in range(0, whole, size):
                self._put(bytes(self.waiting[a : a + size]))
            del self.waiting[:whole]

    def _put(self, raw: bytes) -> None:
        parts = pack(np.frombuffer(raw, "<u4"), self.planes)
        self.chunks.append((self.at, len(raw) // 4, [len(p) for p in parts]))
        for p in parts:
            self.sink.write(p)
            self.at += len(p)

    def close(self) -> int:
        if self.waiting:
            self._put(bytes(self.waiting))
        n = 4 if self.planes == "byte" else 32
        head = json.dumps({"planes": self.planes, "chunks": len(self.chunks), "docs": len(self.docs)}).encode() + b"\n"
        index = np.array([[a, k, *s] for a, k, s in self.chunks], "<i8").reshape(-1, 2 + n)
        known = np.array([d is not None for d in self.docs], np.uint8)
        ids = np.array([d or 0 for d in self.docs], "<i8")
        footer = zstandard.ZstdCompressor().compress(head + index.tobytes() + known.tobytes() + ids.tobytes() + np.array(self.sizes, "<i8").tobytes())
        self.sink.write(footer + struct.pack("<q", len(footer)) + MAGIC)
        return self.at + len(footer) + 8 + len(MAGIC)


class Reader:
    """Reads a file's tables, and any block by its number."""

    def __init__(self, source) -> None:
        size = source.size()
        source.seek(size - 8 - len(MAGIC))
        tail = source.read(8 + len(MAGIC))
        if tail[8:] != MAGIC:
            raise ValueError("not a plane file, or not a whole one")
        length = struct.unpack("<q", tail[:8])[0]
        source.seek(size - 8 - len(MAGIC) - length)
        raw = zstandard.ZstdDecompressor().decompressobj().decompress(source.read(length))
        head, _, rest = raw.partition(b"\n")
        self.about = json.loads(head)
        width = 2 + (4 if self.about["planes"] == "byte" else 32)
        a = 8 * width * self.about["chunks"]
        n = self.about["docs"]
        self.index = np.frombuffer(rest[:a], "<i8").reshape(-1, width)
        known = np.frombuffer(rest[a : a + n], np.uint8)
        ids = np.frombuffer(rest[a + n : a + 9 * n], "<i8")
        self.docs = [int(i) if k else None for i, k in zip(ids, known, strict=True)]
        self.sizes = np.frombuffer(rest[a + 9 * n :], "<i8")
        self.source = source

    def block(self, number: int) -> np.ndarray:
        at, n, *sizes = self.index[number].tolist()
        self.source.seek(at)
        raw = self.source.read(sum(sizes))
        cuts = np.cumsum([0, *sizes])
        return unpack([raw[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)], n, self.about["planes"])

    def documents(self) -> Iterator[tuple[int | None, Iterator[np.ndarray]]]:
        """(doc_id, its ids in one or more arrays), in order; take the arrays before the next document."""
        number, held = 0, np.zeros(0, "<u4")

        def parts(left: int) -> Iterator[np.ndarray]:
            nonlocal number, held
            while left:
                if not len(held):
                    held, number = self.block(number), number + 1
                some, held = held[:left], held[left:]
                left -= len(some)
                yield some

        for doc_id, size in zip(self.docs, self.sizes.tolist(), strict=True):
            yield doc_id, parts(size)


# ---- a corpus


def write(docs: DataFrame, path: str, folder: str, end_id: int = END_ID, planes: str = "byte", files: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and write every whole text; returns the manifest, one row for each file, with its ``start``.

    Null and empty texts are an end id alone. Documents lie in ascending order of id, null ids first,
    equal ids in an order of their text's hash; repeated rows are all kept. ``start`` is the number of
    ids in all files before. There's a file for each ``FILE_BYTES`` of text, and at least one for each shuffle
    partition. An empty table gives an empty manifest. Extra columns are ignored.
    """
    spark = docs.sparkSession
    if files is None:
        stored = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
        files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-stored // FILE_BYTES))
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        part, name = TaskContext.get().partitionId(), None
        writer = sink = None
        for batch, texts in pieces(batches, "text"):
            if writer is None:
                fs.create_dir(base, recursive=True)
                name = f"{base}/part-{part:06d}-{uuid.uuid4().hex}.wft"
                sink = fs.open_output_stream(name)
                writer = Writer(sink, planes)
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder(path).texts(texts), strict=True):
                writer.add(doc_id, ids + end)
        if writer is not None:
            size = writer.close()
            sink.close()
            row = pd.DataFrame({"part": [part], "path": [name], "n_docs": [len(writer.docs)], "n_tokens": [sum(writer.sizes)], "n_bytes": [size]})
            yield pa.RecordBatch.from_pandas(row, schema=pa.schema([("part", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64())]), preserve_index=False)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ordered = rows.repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    manifest = materialize(ordered.mapInArrow(run, MANIFEST), "manifest")
    # one row for each file that was written, so at most the number of files
    table = manifest.orderBy("part").toPandas()
    table["start"] = table.n_tokens.cumsum() - table.n_tokens
    table["folder"] = folder
    return spark.createDataFrame(table.astype({"part": "int32"}), f"{MANIFEST}, start long, folder string") if len(table) else manifest.withColumns({"start": F.lit(0).cast("long"), "folder": F.lit(folder)}).limit(0)


def read(manifest: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in the files, from their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, _ = pafs.FileSystem.from_uri(row["folder"])
                with fs.open_input_file(row["path"]) as source:
                    reader, start, out = Reader(source), row["start"], []
                    for doc_id, parts in reader.documents():
                        crc = n = 0
                        for part in parts:
                            crc, n = zlib.crc32(part.tobytes(), crc), n + len(part)
                        out.append((doc_id, start, n, crc))
                        start += n
                        if len(out) >= 8192:
                            yield _digest(out)
                            out = []
                    if out:
                        yield _digest(out)

    files = max(1, manifest.count())
    return manifest.select("part", "path", "start", "folder").repartitionByRange(files, "part").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _digest(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def output_folder(docs: DataFrame) -> str:
    """A new folder in the storage that all executors share, with the scheme that Spark gives it; it goes when the driver ends."""
    spark = docs.sparkSession
    path = f"{checkpoint_dir(spark)}/weft-ids-{uuid.uuid4().hex}"
    remove_at_end(spark, path)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    full = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(where).toString()
    return full.replace("file:/", "file:///", 1) if full.startswith("file:/") and not full.startswith("file:///") else full
