"""SentencePiece encoding and decoding by a batched numpy Viterbi.

Equal-length words, of whatever length, advance together, one position at a time. The hashes of the
substrings that end at a position are looked up among the sorted hashes of the pieces, each that is a piece
is a path (the score of the best path to its start, and its own), a vectorised maximum over the paths of each
word stores the back-pointer, and back-pointers give the segmentation.

The public model is a BPE model: its right segmentation is that of the merges, not the one with the
largest sum of scores. Yet it has the shape that a Viterbi needs: the last piece of each prefix is
unique, and a piece may follow another exactly if the two stay apart when merged on their own. So a
transition counts minus infinity where the pair would merge otherwise, and the best path is exactly
the library's result. ``compatible`` decides that by undoing the merges of both pieces in turn; each
pair is decided once.

Unknown characters become their UTF-8 bytes, as the model asks for. Words are cut before each run of
spaces: no piece has a space inside, so none reaches over a cut. Distinct words are encoded once.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.arrow import Numbered
from weft.llm.arrow import pieces as slices

SPACE = "▁"
BASE = np.uint64(0x9E3779B97F4A7C15)
NONE = np.int64(1 << 40)
MEMO_WORDS = 400_000
SLOT_BITS = 21
#: Substrings that are looked up at once, some 100 MB of working memory.
AT_ONCE = 1_000_000
#: Score of a character that no piece holds, under that of any piece.
UNKNOWN = -1e6
SOME_BITS = 20
WORDS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


class Model:
    """The tables of a SentencePiece BPE model, in the order of its merges."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        self.n = sp.vocab_size()
        self.bytes_of = np.full(256, sp.unk_id())
        self.text_of: list[bytes] = []
        normal = []
        for i in range(self.n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(piece[3:5], 16)
                self.bytes_of[value] = i
                self.text_of.append(bytes([value]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.text_of.append(b"")
            else:
                self.text_of.append(piece.encode())
                normal.append((len(piece) > 1, -sp.get_score(i), i, piece))
        normal.sort()
        # a piece's number here is its turn: single characters, then merges, the earliest first
        self.ids = np.array([x[2] for x in normal])
        self.pieces = [x[3] for x in normal]
        self.scores = np.array([-x[1] for x in normal])
        self.longest = max(map(len, self.pieces))
        self.lengths = np.array([len(p) for p in self.pieces])
        turn = {p: i for i, p in enumerate(self.pieces)}
        self.left, self.right = np.arange(len(self.pieces)), np.arange(len(self.pieces))
        reached = np.ones(len(self.pieces), bool)
        for i, p in enumerate(self.pieces):
            if len(p) > 1:
                parts = list(p)
                while len(parts) > 2:
                    best = min(((turn.get(a + b, self.n + 1), k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False))), default=(self.n + 1, 0))
                    if best[0] > self.n:
                        break
                    parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
                if len(parts) == 2 and parts[0] in turn and parts[1] in turn:
                    self.left[i], self.right[i] = turn[parts[0]], turn[parts[1]]
                else:
                    reached[i] = False  # no merges lead to it
        with np.errstate(over="ignore"):
            self.power = np.cumprod(np.concatenate(([np.uint64(1)], np.full(2 * self.longest, BASE))))
            self.hash = np.array([self._hash(p) for p in self.pieces], np.uint64)
        order = np.argsort(self.hash)
        self.keys, self.turns, self.reached = self.hash[order], order, reached
        if len(np.unique(self.keys)) != len(self.keys):
            raise ValueError("two pieces have one hash")
        # which buckets of hashes hold a piece at all: most substrings are settled by that
        self.some = np.zeros(1 << SOME_BITS, bool)
        self.some[(self.keys >> np.uint64(64 - SOME_BITS)).astype(np.int64)] = True
        self._forget()

    def _forget(self) -> None:
        """Empty the table of decided pairs: a slot holds the last pair that hashed to it."""
        self.known, self.verdicts = np.full(1 << SLOT_BITS, -1, np.int64), np.zeros(1 << SLOT_BITS, bool)

    @staticmethod
    def _hash(piece: str) -> np.uint64:
        h = np.uint64(0)
        for c in piece:
            h = h * BASE + np.uint64(ord(c) + 1)
        return h

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("known", "verdicts")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._forget()

    def hits(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of these hashes are a piece's, in order, and the pieces."""
        may = np.flatnonzero(self.some[(hashes >> np.uint64(64 - SOME_BITS)).astype(np.int64)])
        asked = hashes[may]
        i = np.searchsorted(self.keys, asked)
        i[i == len(self.keys)] = 0
        hit = self.keys[i] == asked
        return may[hit], self.turns[i[hit]]

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The pieces with these hashes, NONE where there's none."""
        out = np.full(len(hashes), NONE)
        at, found = self.hits(hashes)
        out[at] = found
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether pieces a and b, side by side, stay as they are under the merges."""
        if not len(a):
            return np.zeros(0, bool)
        codes = a * self.n + b
        with np.errstate(over="ignore"):
            slots = (codes.astype(np.uint64) * BASE >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        verdict, old = self.verdicts[slots], self.known[slots] == codes
        if not old.all():
            fresh = np.unique(codes[~old])
            decided = self._decide(fresh // self.n, fresh % self.n)
            verdict[~old] = decided[np.searchsorted(fresh, codes[~old])]
            self.known[slots[~old]], self.verdicts[slots[~old]] = codes[~old], verdict[~old]
        return verdict

    def _decide(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Undo the later merge of the two, again and again: if before the merges that are left a merge over the border
        comes first, the pair doesn't stay."""
        out = np.zeros(len(a), bool)
        live, limit = np.arange(len(a)), np.full(len(a), NONE)
        a, b = a.copy(), b.copy()
        while len(live):
            x, y = a[live], b[live]
            with np.errstate(over="ignore"):
                joint = self.find(self.hash[x] * self.power[self.lengths[y]] + self.hash[y])
            stays = joint >= limit[live]
            live, x, y = live[stays], x[stays], y[stays]
            left_simple, right_simple = self.left[x] == x, self.left[y] == y
            done = left_simple & right_simple
            out[live[done]] = True
            live, x, y = live[~done], x[~done], y[~done]
            left_simple, right_simple = left_simple[~done], right_simple[~done]
            undo_left = ~left_simple & (right_simple | (x > y))
            one, two = live[undo_left], live[~undo_left]
            limit[one], a[one] = x[undo_left], self.right[x[undo_left]]
            limit[two], b[two] = y[~undo_left] + 1, self.left[y[~undo_left]]
        return out

    def segment(self, words: list[str]) -> list[np.ndarray]:
        """The ids of each word."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(words)
        for some, turns, ends in self._batches(words):
            is_piece = turns != NONE
            flat, cuts = turns[is_piece], [0, *np.cumsum(is_piece.sum(1)).tolist()]
            ids = self.ids[np.maximum(flat, 0)]
            for i, a, b in zip(some, cuts[:-1], cuts[1:], strict=True):
                out[i] = ids[a:b]
            for row in np.flatnonzero((turns < 0).any(axis=1)).tolist():
                word = words[some[row]]
                parts = [[self.ids[t]] if t >= 0 else self.bytes_of[list(word[e - 1].encode())] for t, e in zip(turns[row], ends[row], strict=True) if t != NONE]
                out[some[row]] = np.concatenate(parts).astype(np.int64)
        return out

    def sizes(self, words: list[str]) -> np.ndarray:
        """The number of ids of each word."""
        out = np.zeros(len(words), np.int64)
        for some, turns, ends in self._batches(words):
            out[some] = (turns != NONE).sum(1)
            for row, place in zip(*(x.tolist() for x in np.nonzero(turns < 0)), strict=True):
                out[some[row]] += len(words[some[row]][ends[row, place] - 1].encode()) - 1
        return out

    def _batches(self, words: list[str]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
        """Words of one length advance together: which words, the pieces of each (-1: an unknown character; NONE fills up
        paths of fewer pieces, in front), and where each ends."""
        lengths = np.array([len(w) for w in words], int)
        for n in np.unique(lengths[lengths > 0]).tolist():
            which = np.flatnonzero(lengths == n).tolist()
            step = max(1, 400_000 // n)
            for at in range(0, len(which), step):
                some = which[at : at + step]
                yield some, *self._paths([words[i] for i in some], n)

    def _paths(self, words: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
        """The best path through each of the words of ``n`` characters. Tables have a row for each position, a column for each word."""
        rows, most = np.arange(len(words)), min(n, self.longest)
        chars = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), n).T.astype(np.uint64)
        prefix = np.zeros((n + 1, len(words)), np.uint64)
        score = np.zeros((n + 1, len(words)))  # of the best path to a position
        last = np.full((n + 1, len(words)), -1, np.int64)  # the piece that ends at a position; -1: an unknown character, or none
        back = np.ones((n + 1, len(words)), np.int32)  # its length
        with np.errstate(over="ignore"):
            for i in range(n):
                prefix[i + 1] = prefix[i] * BASE + chars[i] + np.uint64(1)
        block = max(1, AT_ONCE // (len(words) * most))
        for low in range(1, n + 1, block):
            # all substrings that end at some positions: by end, then by size
            ends = np.arange(low, min(low + block, n + 1))
            starts = ends[:, None] - np.arange(1, most + 1)
            there = starts >= 0
            of_end, of_start = np.broadcast_to(ends[:, None], starts.shape)[there], starts[there]
            with np.errstate(over="ignore"):
                hashes = prefix[of_end] - prefix[of_start] * self.power[of_end - of_start][:, None]
            at, piece = self.hits(hashes.ravel())
            at, piece = at[self.reached[piece]], piece[self.reached[piece]]
            substring, who = np.divmod(at, len(words))
            start, cost = of_start[substring], self.scores[piece]
            cuts = np.searchsorted(of_end[substring], np.append(ends, n + 1)).tolist()
            for end, a, b in zip(ends.tolist(), cuts[:-1], cuts[1:], strict=True):
                w, s, p = who[a:b], start[a:b], piece[a:b]
                before = last[s, w]
                good = before < 0
                ask = np.flatnonzero(~good)
                good[ask] = self.compatible(before[ask], p[ask])
                w, s, p = w[good], s[good], p[good]
                paths = score[s, w] + cost[a:b][good]
                best = np.full(len(words), -np.inf)
                np.maximum.at(best, w, paths)
                top = paths == best[w]
                last[end, w[top]], back[end, w[top]] = p[top], end - s[top]
                score[end] = np.where(np.isneginf(best), score[end - 1] + UNKNOWN, best)
        ends, found = np.full(len(words), n), []
        while (ends > 0).any():
            found.append((np.where(ends > 0, last[ends, rows], NONE), ends))
            ends = np.where(ends > 0, ends - back[ends, rows], 0)
        return np.stack([t for t, _ in found][::-1], axis=1), np.stack([e for _, e in found][::-1], axis=1)


class Codec:
    """Encodes and decodes whole texts; holds a bounded memo of words."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self._clear()

    def _clear(self) -> None:
        self.numbers = Numbered()
        self.ids: list[bytes] = []
        self.sizes: dict[str, int] = {}

    @staticmethod
    def words(text: bytes | None) -> list[str]:
        """The words of a text, none over a space or line break; a space before a word is left out."""
        s = (text or b"").decode("utf-8", "replace")
        if not s:
            return []
        if "  " in s or " \n" in s or s[0] == " " or s[-1] == " " or SPACE in s:
            return WORDS.findall(SPACE + s.replace(" ", SPACE))
        # a line break is in no piece, so none reaches over it; other words stand behind a space that is left out
        return s.replace("\n", " \n").split(" ")

    @staticmethod
    def spaced(words: list[str]) -> list[str]:
        return [w if w[:1] in (SPACE, "\n") else SPACE + w for w in words]

    def encode(self, texts: list[bytes | None]) -> list[np.ndarray]:
        """The ids of each text; null and empty texts have none."""
        if len(self.numbers) > MEMO_WORDS:
            self._clear()
        number = self.numbers.__getitem__
        split = [list(map(number, self.words(t))) for t in texts]
        self.ids += [x.astype("<i4").tobytes() for x in self.model.segment(self.spaced(self.numbers.take()))]
        ids = self.ids.__getitem__
        return [np.frombuffer(b"".join(map(ids, words)), "<i4") for words in split]

    def count(self, texts: list[bytes | None]) -> list[int]:
        """The number of ids of each text."""
        if len(self.sizes) > MEMO_WORDS:
            self.sizes = {}
        split = [self.words(t) for t in texts]
        fresh = list(set().union(*split) - self.sizes.keys())
        self.sizes.update(zip(fresh, self.model.sizes(self.spaced(fresh)).tolist(), strict=True))
        size = self.sizes.__getitem__
        return [sum(map(size, words)) for words in split]

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        """The texts of these ids."""
        get, space = self.model.text_of.__getitem__, SPACE.encode()
        return [b"".join(map(get, x.tolist())).replace(space, b" ")[1:] for x in ids]


_codecs: dict[str, Codec] = {}


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """``doc_id, n_pieces, ids_crc32, round_trip[, ids]`` for every whole text.

    ids are those of the model in the file ``path`` without control ids; null and empty texts have none.
    round_trip says whether decoding gives the text back (its bytes; a literal U+2581 reads back as a space,
    as with any decoder). ids_crc32 is over little-endian 32-bit ids. Repeated rows are encoded each;
    extra columns are ignored; an empty table gives no rows. The model goes to the executors once, some
    megabytes whatever the corpus is.
    """
    held = docs.sparkSession.sparkContext.broadcast(Model(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _codecs:
            _codecs[path] = Codec(held.value)
        codec = _codecs[path]
        for batch, texts in slices(batches, "text", 4096, 16_000_000):
            ids = codec.encode(texts)
            same = [a == (b or b"") for a, b in zip(codec.decode(ids), texts, strict=True)]
            columns = [batch.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()), pa.array(same)]
            names = ["doc_id", "n_pieces", "ids_crc32", "round_trip"]
            if with_ids:
                columns.append(pa.array([x for x in ids], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.record_batch(columns, names=names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_pieces long, ids_crc32 long, round_trip boolean" + ", ids array<int>" * with_ids)


def count(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_pieces`` for every whole text: as ``encode``, but nothing is put together or decoded."""
    held = docs.sparkSession.sparkContext.broadcast(Model(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _codecs:
            _codecs[path] = Codec(held.value)
        for batch, texts in slices(batches, "text", 4096, 16_000_000):
            yield pa.record_batch([batch.column(0), pa.array(_codecs[path].count(texts), pa.int64())], names=["doc_id", "n_pieces"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_pieces long")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``; null ids give an empty text, ids out of the vocabulary are an error."""
    held = encoded.sparkSession.sparkContext.broadcast(Model(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(held.value)
        for batch in batches:
            texts = codec.decode([np.array(x or [], np.int64) for x in batch.column(1).to_pylist()])
            yield pa.record_batch([batch.column(0), pa.array([t.decode("utf-8", "replace") for t in texts])], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")
