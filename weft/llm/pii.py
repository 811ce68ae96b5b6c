"""Personal data: exact patterns, and a skip-chain conditional random field over the words near them.

The base is four patterns (email, ip, card, phone), matched leftmost and without overlap per kind over
whole texts. The field labels every word of a document with one of the kinds or none, under the rule that a word
without a digit or an @ is none, as no kind can do without one. Neighbours in the text share a potential
(chain), and so do words that repeat or have the same digits, and numbers that end alike, anywhere in the document (skip): a number that is a phone
in one place speaks for its bare repetition elsewhere. Loopy message passing enforces that the labels
agree across each document.

A word that the rule settles is a constant: it parts the chain, and all that it tells its neighbours is the potential
of none beside them. So the messages only run between the other words, with that potential added where a settled word
stands next to one; their marginals are those of the field over all words (tested against the sum over all labellings).

Words of one number (digits and separators side by side, up to the next + or address) are added whole or not at all:
if all of them have the same kind with a high marginal, and no base span touches one.

The weights are trained here, by pseudo-likelihood, on silver labels: the base spans of a bounded
sample of documents (``SAMPLE_DOCS`` and ``SAMPLE_BYTES``, drawn by a hash of the id among those of at most
``SAMPLE_DOC_BYTES``); words of matches that the base drops for too many digits have no label. Everything else reads every text.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.arrow import pieces

KINDS = ("email", "ip", "card", "phone")
SAMPLE_DOCS = 20_000
SAMPLE_BYTES = 64 << 20
SAMPLE_DOC_BYTES = 1 << 18
FEATURES = 1 << 13
ROUNDS = 8
MARGINAL = 0.95
#: Digits of a number that two numbers must share at their ends to be linked.
TAIL = 7

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SIGN = re.compile(r"[0-9@]")
#: Words that can be part of a number that runs over several words.
NUMERIC = re.compile(r"[(\[+]*[0-9][0-9().+/-]*[.,;:!?)\]]*")
ADDRESS = re.compile(r"[0-9]+(?:\.[0-9]+){3}\b")
#: The digits that an added span of a kind has: none wanted, an address, a card, a phone.
DIGITS = ((0, 1 << 62), (4, 12), (12, 19), (7, 15))

Span = tuple[int, int, int]  # start, kind, end


# ---- the base


def luhn(digits: str) -> bool:
    """Whether the check digit of a card number is right."""
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of a local part, @ and a dotted domain, in time linear in the text: a match can only start where the run
    of local characters before an @ starts, or where the last match ended."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            end = found.end()
        else:
            end = max(end, at + 1)
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[Span]:
    """The spans of all kinds by start, then kind; failing matches are dropped without another try."""
    out: list[Span] = []
    if "@" in text:
        out += [(a, 0, b) for a, b in _emails(text)]
    if DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p[-4:]) < 256 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            if 14 <= m.end() - m.start() <= 40:
                digits = DIGIT.findall(m[0])
                if 14 <= len(digits) <= 19 and luhn("".join(digits)):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(DIGIT.findall(m[0])) <= 15]
    return sorted(out)


def doubtful_spans(text: str) -> list[tuple[int, int]]:
    """Matches that the base drops for too many digits: a phone or card may stand in them beside something else."""
    if not DIGIT.search(text):
        return []
    return [m.span() for pattern, most in ((CARD, 19), (PHONE, 15)) for m in pattern.finditer(text) if len(DIGIT.findall(m[0])) > most]


def spans_text(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


# ---- the field

LETTERS = re.compile(r"[^\W\d_]+")
DIGITS_RUN = re.compile(r"[0-9]+")


def _shape(word: str) -> str:
    """Runs of digits as 9, of letters as a."""
    return LETTERS.sub("a", DIGITS_RUN.sub("9", word))


class Nodes:
    """The free nodes of a document: the words with a digit or @."""

    def __init__(self, text: str) -> None:
        words = [(m.start(), m.end()) for m in WORD.finditer(text)]
        marks, i = [], 0
        for m in SIGN.finditer(text):
            while words[i][1] <= m.start():
                i += 1
            if not marks or marks[-1] != i:
                marks.append(i)
        self.words = [words[i] for i in marks]
        texts = [text[a:b] for a, b in self.words]
        self.chain = np.array([(k, k + 1) for k, (a, b) in enumerate(zip(marks, marks[1:], strict=False)) if b == a + 1], int).reshape(-1, 2)
        #: Whether a settled word stands before, and behind.
        free = set(marks)
        self.beside = np.array([(i > 0 and i - 1 not in free, i + 1 < len(words) and i + 1 not in free) for i in marks], bool).reshape(-1, 2)
        self.numbers = self._numbers(texts, marks)
        last: dict[str, tuple[int, int]] = {}
        skip = set()

        def link(key: str, k: int) -> None:
            if key in last and last[key][1] != marks[k] - 1:
                skip.add((last[key][0], k))
            last[key] = (k, marks[k])

        for k, word in enumerate(texts):
            digits = "".join(DIGIT.findall(word))
            key = digits if len(digits) >= 5 and "@" not in word else word.strip(".,;:!?()[]{}\"'<>").lower()
            if len(key) > 2:
                link(key, k)
        for number in self.numbers:
            digits = "".join(c for k in number for c in DIGIT.findall(texts[k]))
            if len(digits) >= TAIL:
                link(f"tail {digits[-TAIL:]}", number[-1])
        self.skip = np.array(sorted(skip), int).reshape(-1, 2)
        around = lambda i: text[slice(*words[i])] if 0 <= i < len(words) else ""
        length = {k: sum(len(DIGIT.findall(texts[j])) for j in number) for number in self.numbers for k in number}
        self.features = [self._features(texts[k], [around(i + d) for d in (-1, 1, -2, 2)], length.get(k, 0)) for k, i in enumerate(marks)]

    @staticmethod
    def _numbers(texts: list[str], marks: list[int]) -> list[list[int]]:
        """Runs of words, side by side, of digits and separators; a + or an address begins a new one, an address ends one."""
        out: list[list[int]] = []
        for k, word in enumerate(texts):
            if not NUMERIC.fullmatch(word):
                continue
            begins = word.lstrip("([")[:1] == "+" or ADDRESS.match(word)
            if out and out[-1][-1] == k - 1 and marks[k - 1] == marks[k] - 1 and not begins and not ADDRESS.match(texts[k - 1]):
                out[-1].append(k)
            else:
                out.append([k])
        return out

    @staticmethod
    def _features(word: str, near: list[str], length: int) -> list[int]:
        digits = "".join(DIGIT.findall(word))
        own = ["b", f"s{_shape(word)}", f"n{len(digits)}", f"l{len(word).bit_length()}", f"@{'@' in word}", f"+{word[:1] == '+'}", f"d{word.count('.')}", f"L{len(digits) >= 14 and luhn(digits)}", f"N{length}"]
        own += [f"{name}{_shape(other)}" for name, other in zip("pqPQ", near, strict=True)]
        return [zlib.crc32(x.encode()) % FEATURES for x in own]

    def labels(self, spans: list[Span], doubtful: list[tuple[int, int]] = ()) -> np.ndarray:
        """Silver labels: the kind of a base span that a word overlaps, 0 for none, -1 (not known) in a doubtful span."""
        out = np.zeros(len(self.words), int)
        starts = [a for a, _ in self.words]
        for a, b, label in [*((a, b, -1) for a, b in doubtful), *((a, b, kind + 1) for a, kind, b in spans)]:
            k = max(0, bisect_right(starts, a) - 1)
            while k < len(out) and self.words[k][0] < b:
                if self.words[k][1] > a:
                    out[k] = label
                k += 1
        return out


N_LABELS = len(KINDS) + 1


class Field:
    """Weights of the unary, chain and skip potentials."""

    def __init__(self) -> None:
        self.unary = np.zeros((FEATURES, N_LABELS))
        self.chain = np.zeros((N_LABELS, N_LABELS))
        self.skip = np.zeros((N_LABELS, N_LABELS))

    def train(self, features: np.ndarray, labels: np.ndarray, chain: np.ndarray, skip: np.ndarray, beside: np.ndarray | None = None, epochs: int = 60, rate: float = 0.3, decay: float = 1e-4) -> None:
        """Pseudo-likelihood: each known label given its features and the known labels of its neighbours; AdaGrad."""
        n, eye, known = len(labels), np.eye(N_LABELS), labels >= 0
        chain, skip = chain[known[chain].all(1)], skip[known[skip].all(1)]
        labels = np.maximum(labels, 0)
        beside = np.zeros((n, 2), bool) if beside is None else beside
        squares = [np.full(w.shape, 1e-3) for w in (self.unary, self.chain, self.skip)]
        for _ in range(epochs):
            score = self.unary[features].sum(1) + self.settled(beside)
            np.add.at(score, chain[:, 0], self.chain[:, labels[chain[:, 1]]].T)
            np.add.at(score, chain[:, 1], self.chain[labels[chain[:, 0]]])
            np.add.at(score, skip[:, 0], self.skip[:, labels[skip[:, 1]]].T)
            np.add.at(score, skip[:, 1], self.skip[labels[skip[:, 0]]])
            p = np.exp(score - score.max(1, keepdims=True))
            miss = (eye[labels] - p / p.sum(1, keepdims=True)) / n * known[:, None]
            grads = [np.zeros_like(self.unary), np.zeros_like(self.chain), np.zeros_like(self.skip)]
            for f in features.T:
                np.add.at(grads[0], f, miss)
            for g, edges in ((grads[1], chain), (grads[2], skip)):
                np.add.at(g.T, labels[edges[:, 1]], miss[edges[:, 0]])
                np.add.at(g, labels[edges[:, 0]], miss[edges[:, 1]])
            grads[1][0] += miss[beside[:, 0]].sum(0)
            grads[1][:, 0] += miss[beside[:, 1]].sum(0)
            for w, g, s in zip((self.unary, self.chain, self.skip), grads, squares, strict=True):
                g -= decay * w / max(1, n)
                s += (g * n) ** 2 / n
                w += rate * g * n / np.sqrt(s * n)
        self.skip = (self.skip + self.skip.T) / 2

    def settled(self, beside: np.ndarray) -> np.ndarray:
        """What settled words before and behind each node tell it."""
        return beside[:, :1] * self.chain[0] + beside[:, 1:] * self.chain[:, 0]

    def marginals(self, features: np.ndarray, chain: np.ndarray, skip: np.ndarray, rounds: int = ROUNDS, beside: np.ndarray | None = None) -> np.ndarray:
        """Beliefs of all nodes after so many rounds of sum-product messages, all documents of a batch at once."""
        unary = self.unary[features].sum(1)
        if beside is not None:
            unary = unary + self.settled(beside)
        edges = np.concatenate([chain, skip])
        if not len(edges):
            p = np.exp(unary - unary.max(1, keepdims=True))
            return p / p.sum(1, keepdims=True)
        pot = np.concatenate([np.broadcast_to(self.chain, (len(chain), N_LABELS, N_LABELS)), np.broadcast_to(self.skip, (len(skip), N_LABELS, N_LABELS))])
        src, dst = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
        pot = np.concatenate([pot, pot.transpose(0, 2, 1)])
        back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
        log = np.zeros((len(src), N_LABELS))
        for _ in range(rounds):
            belief = unary.copy()
            np.add.at(belief, dst, log)
            given = belief[src] - log[back]
            new = np.logaddexp.reduce(given[:, :, None] + pot, axis=1)
            new -= np.logaddexp.reduce(new, axis=1, keepdims=True)
            log = 0.5 * log + 0.5 * new
        belief = unary.copy()
        np.add.at(belief, dst, log)
        p = np.exp(belief - belief.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


def _joined(parts: list[np.ndarray], sizes: list[int]) -> np.ndarray:
    starts = np.cumsum([0, *sizes[:-1]])
    return np.concatenate([p + s for p, s in zip(parts, starts, strict=True)]).reshape(-1, 2).astype(int)


def _plausible(span: str, kind: int) -> bool:
    """An @ inside, the number of digits of the kind, and a card's check digit."""
    digits = "".join(DIGIT.findall(span))
    low, high = DIGITS[kind]
    return low <= len(digits) <= high and ("@" in span[1:-1] if kind == 0 else luhn(digits) if kind == 2 else True)


def added_spans(texts: list[str], bases: list[list[Span]], field: Field | None) -> list[list[Span]]:
    """The spans that the field adds to each text: whole numbers, and words outside numbers, of one kind, away from base spans."""
    out: list[list[Span]] = [[] for _ in texts]
    which = [i for i, t in enumerate(texts) if SIGN.search(t)] if field is not None else []
    if not which:
        return out
    nodes = [Nodes(texts[i]) for i in which]
    sizes = [len(n.words) for n in nodes]
    p = field.marginals(np.array([f for n in nodes for f in n.features]), _joined([n.chain for n in nodes], sizes), _joined([n.skip for n in nodes], sizes), beside=np.concatenate([n.beside for n in nodes]))
    label = np.where(p.max(1) >= MARGINAL, p.argmax(1), 0)
    at = 0
    for i, n in zip(which, nodes, strict=True):
        own, text = label[at : at + len(n.words)], texts[i]
        at += len(n.words)
        if not own.any():
            continue
        touched = n.labels(bases[i]) > 0
        inside = {k for number in n.numbers for k in number}
        # a base span parts a number: what is left of it on either side is a number of its own
        units = [[k] for k in range(len(own)) if k not in inside]
        for number in n.numbers:
            part: list[int] = []
            for k in number:
                if touched[k]:
                    units.append(part)
                    part = []
                else:
                    part.append(k)
            units.append(part)
        for unit in units:
            kind = int(own[unit[0]]) - 1 if unit else -1
            if kind < 0 or (own[unit] != kind + 1).any() or touched[unit].any():
                continue
            a, b = n.words[unit[0]][0], n.words[unit[-1]][1]
            while a < b and not (text[a].isalnum() or text[a] in "+("):
                a += 1
            while b > a and not text[b - 1].isalnum():
                b -= 1
            if a < b and _plausible(text[a:b], kind):
                out[i].append((a, kind, b))
    return [sorted(spans) for spans in out]


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Field | None:
    """A field trained on the base spans of about ``sample_docs`` documents, or None if these have no span.

    Documents over ``SAMPLE_DOC_BYTES`` aren't drawn, and those drawn have about ``SAMPLE_BYTES`` at most: so the nodes that reach the driver are bounded."""
    size = F.octet_length("text")
    docs = docs.where(size <= SAMPLE_DOC_BYTES)
    held = docs.agg(F.count("*").alias("n"), F.sum(size).alias("bytes")).first()
    share = min(1.0, sample_docs / max(1, held.n), SAMPLE_BYTES / max(1, held.bytes or 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in pieces(batches, "text"):
            rows = []
            for t in texts:
                text = (t or b"").decode("utf-8", "replace")
                if SIGN.search(text):
                    n = Nodes(text)
                    rows.append((np.array(n.features).ravel().tolist(), n.labels(base_spans(text), doubtful_spans(text)).tolist(), n.chain.ravel().tolist(), n.skip.ravel().tolist(), n.beside.ravel().astype(int).tolist()))
            if rows:
                yield pa.record_batch([pa.array(x, pa.list_(pa.int32())) for x in zip(*rows, strict=True)], names=["features", "labels", "chain", "skip", "beside"])

    spot = F.pmod(F.xxhash64(F.lit("pii"), F.col("doc_id")), F.lit(1_000_000)) / 1e6
    drawn = docs.where(spot < share).select("text").mapInArrow(run, "features array<int>, labels array<int>, chain array<int>, skip array<int>, beside array<int>").toPandas()
    sizes = [len(x) for x in drawn.labels]
    if not sum(sizes):
        return None
    labels = np.concatenate(drawn.labels.to_list()).astype(int)
    if not (labels > 0).any():
        return None
    features = np.concatenate(drawn.features.to_list()).astype(int).reshape(len(labels), -1)
    field = Field()
    field.train(features, labels, _joined([np.array(x, int).reshape(-1, 2) for x in drawn.chain], sizes), _joined([np.array(x, int).reshape(-1, 2) for x in drawn["skip"]], sizes), np.concatenate(drawn.beside.to_list()).reshape(-1, 2) > 0)
    return field


def _found(texts: list[bytes | None], field: Field | None) -> list[tuple[str, list[Span], list[Span]]]:
    """(text, base spans, all spans) of each text."""
    plain = [(t or b"").decode("utf-8", "replace") for t in texts]
    bases = [base_spans(t) if "@" in t or DIGIT.search(t) else [] for t in plain]
    return [(t, b, sorted(b + more)) for t, b, more in zip(plain, bases, added_spans(plain, bases, field), strict=True)]


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` for every row.

    The counts and the hash are of the base spans, ``spans`` of all: kind:start:end in code points, end
    exclusive, by start, then kind, joined by commas. Null texts are empty. Repeated rows are judged
    each; extra columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    held = docs.sparkSession.sparkContext.broadcast(fit(rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches, "text"):
            found = _found(texts, held.value)
            counts = [pa.array([sum(s[1] == k for s in b) for _, b, _ in found], pa.int64()) for k in range(len(KINDS))]
            digest = [hashlib.sha256(spans_text(b).encode()).hexdigest() for _, b, _ in found]
            yield pa.record_batch([batch.column(0), *counts, pa.array(digest), pa.array([spans_text(s) for _, _, s in found])], names=["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])

    return rows.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def mask(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans become one, named by the first."""
    out, end = [], 0
    for a, kind, b in spans:
        if a >= end:
            out += [text[end:a], f"[{KINDS[kind].upper()}]"]
        end = max(end, b)
    return "".join([*out, text[end:]])


def redact(docs: DataFrame) -> DataFrame:
    """All rows and columns of ``docs``, with the personal data in ``text`` masked and ``n_chars`` counted anew if it is there.

    Null texts stay null; texts without a span stay as they are."""
    held = docs.sparkSession.sparkContext.broadcast(fit(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))))

    @F.pandas_udf("string")
    def masked(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            out: list[str | None] = []
            for at in range(0, len(part), 256):
                some = [t if isinstance(t, str) else None for t in part.iloc[at : at + 256]]
                found = _found([None if t is None else t.encode() for t in some], held.value)
                out += [None if t is None else mask(t, spans) if spans else t for t, (_, _, spans) in zip(some, found, strict=True)]
            yield pd.Series(out, dtype=object)

    out = docs.withColumn("text", masked(F.col("text")))
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
