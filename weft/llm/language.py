"""Language identification by interpolated Kneser-Ney character models in sorted hash arrays.

Words are lower-cased, keep their letters, and are padded; a model of order four per language gives
each letter a probability. All languages share one sorted array of n-gram hashes with a row of
weights each: ``alpha`` (discounted share of the n-gram) and ``gamma`` (mass left to the shorter
context). A text's cross-entropy is the mean over its letters and word ends; the lowest wins.
A temperature and a rejection limit are calibrated on sampled documents the models didn't see; a
language without sampled letters outside the calibration part is learned from that part instead.

The models are a classifier fitted on a bounded sample: about ``sample_docs`` whole documents of
each language, drawn by a hash of the id. Executors count their words; only the counts of distinct
words of the sample reach the driver. Prediction covers every whole text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.arrow import Numbered, pieces

ORDER = 4
DISCOUNT = 0.75
SAMPLE_DOCS = 600
CALIBRATION_SHARE = 0.15
#: Bits a letter above the worst calibration document; beyond that no learned language fits.
MARGIN_BITS = 0.75
BASE = np.uint64(0x9E3779B97F4A7C15)
START, END = 1, 2
MEMO_WORDS = 300_000


def letters(word: str) -> str:
    """The lower-cased letters of a word."""
    word = word.lower()
    return word if word.isalpha() else "".join(filter(str.isalpha, word))


def _grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all padded words, one after another; positions of the letters and word ends; the word of each."""
    lengths = np.array([len(w) + ORDER for w in words])
    ends = np.cumsum(lengths)
    flat = np.full(int(ends[-1]) if len(words) else 0, START, np.uint64)
    whose = np.repeat(np.arange(len(words)), lengths)
    place = np.arange(len(flat)) - np.repeat(ends - lengths, lengths)
    inside = (place >= ORDER - 1) & (place < lengths[whose] - 1)
    flat[inside] = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    flat[ends - 1] = END
    at = np.flatnonzero(place >= ORDER - 1)
    return flat, at, whose[at]


def _hashes(flat: np.ndarray, at: np.ndarray, skip_last: bool = False) -> list[np.ndarray]:
    """Hashes of the 1..ORDER symbols that end at each position, or of the 1..ORDER-1 before it."""
    out, now = [], np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for o in range(ORDER):
            if skip_last and o == 0:
                continue
            now = now * BASE + flat[at - o] + np.uint64(o + 1)
            now = now ^ (now >> np.uint64(29))
            out.append(now * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(o + (100 if skip_last else 0)))
    return out


@dataclass
class Models:
    languages: list[str]
    keys: np.ndarray
    alpha: np.ndarray
    context_keys: np.ndarray
    gamma: np.ndarray
    uniform: float
    scale: float = 20.0
    limit: float = np.inf

    def chances(self, flat: np.ndarray, spots: np.ndarray) -> np.ndarray:
        """The probability of the symbol at each of ``spots`` behind those before it, for each language."""
        grams, contexts = _hashes(flat, spots), _hashes(flat, spots, skip_last=True)
        p = np.full((len(spots), len(self.languages)), self.uniform)
        for o in range(ORDER):
            i = np.searchsorted(self.keys, grams[o]).clip(max=len(self.keys) - 1)
            hit = (self.keys[i] == grams[o])[:, None]
            context = contexts[o - 1] if o else np.zeros(1, np.uint64)
            j = np.searchsorted(self.context_keys, context).clip(max=len(self.context_keys) - 1)
            left = np.where((self.context_keys[j] == context)[:, None], self.gamma[j], 1.0)
            p = np.where(hit, self.alpha[i], 0.0) + left * p
        return p

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(letters and word ends, bits for each language) of normalised, non-empty words."""
        bits, n = np.zeros((len(words), len(self.languages))), np.zeros(len(words))
        at = 0
        while at < len(words):  # about a million letters at a time
            end, size = at, 0
            while end < len(words) and (end == at or size < 1_000_000):
                size += len(words[end]) + ORDER
                end += 1
            flat, spots, whose = _grams(words[at:end])
            cost = -np.log2(self.chances(flat, spots))
            starts = np.flatnonzero(np.diff(whose, prepend=-1))
            bits[at:end] = np.add.reduceat(cost, starts, axis=0)
            n[at:end] = np.diff([*starts, len(whose)])
            at = end
        return n, bits


def train(counts: pd.DataFrame) -> Models:
    """Interpolated Kneser-Ney models from rows (lang, word, n); the highest order counts occurrences, lower ones
    count the distinct symbols before."""
    languages = sorted(counts.lang.unique())
    alphas, gammas, symbols = [], [], set("".join(counts.word))
    for lang in languages:
        own = counts[counts.lang == lang]
        flat, at, whose = _grams(own.word.tolist())
        grams, contexts = _hashes(flat, at), _hashes(flat, at, skip_last=True)
        n = own.n.to_numpy(float)[whose]
        alpha, gamma = {}, {}
        for o in range(ORDER):
            table = pd.DataFrame({"gram": grams[o], "context": contexts[o - 1] if o else np.zeros(len(at), np.uint64), "n": n})
            if o < ORDER - 1:  # once for each distinct longer gram
                table = table.assign(longer=grams[o + 1]).drop_duplicates("longer").assign(n=1.0)
            table = table.groupby(["gram", "context"], as_index=False).n.sum()
            total = table.groupby("context").n.agg(["sum", "count"])
            of = total.loc[table.context]
            alpha.update(zip(table.gram, np.maximum(table.n - DISCOUNT, 0).to_numpy() / of["sum"].to_numpy(), strict=True))
            gamma.update(zip(total.index, (np.minimum(DISCOUNT, 1) * total["count"] / total["sum"]).to_numpy(), strict=True))
        alphas.append(pd.Series(alpha))
        gammas.append(pd.Series(gamma))
    alpha = pd.concat(alphas, axis=1).fillna(0.0).sort_index()
    gamma = pd.concat(gammas, axis=1).sort_index().fillna(1.0)
    return Models(languages, alpha.index.to_numpy(np.uint64), alpha.to_numpy(), gamma.index.to_numpy(np.uint64), gamma.to_numpy(), 1 / (len(symbols) + 1000))


class Scorer:
    """Cross-entropies of texts; each distinct word is scored once, and the memo of words is bounded."""

    def __init__(self, models: Models) -> None:
        self.models = models
        self._clear()

    def _clear(self) -> None:
        self.numbers = Numbered()
        self.table = np.zeros((0, len(self.models.languages) + 1))

    def texts(self, texts: list[bytes | None]) -> np.ndarray:
        """A row for each text: letters and word ends, then bits for each language."""
        if len(self.numbers) > MEMO_WORDS:
            self._clear()
        number = self.numbers.__getitem__
        split = [np.array(list(map(number, (t or b"").decode("utf-8", "replace").split())), np.int64) for t in texts]
        plain = [letters(w) for w in self.numbers.take()]
        if plain:
            rows = np.zeros((len(plain), self.table.shape[1]))
            some = np.array([i for i, w in enumerate(plain) if w], int)
            if len(some):
                rows[some, 0], rows[some, 1:] = self.models.words([plain[i] for i in some])
            self.table = np.concatenate([self.table, rows])
        out = np.zeros((len(texts), self.table.shape[1]))
        for i, ids in enumerate(split):
            if len(ids):
                out[i] = self.table[ids].sum(0)
        return out


def _sampled(docs: DataFrame, train_rows: Column, sample_docs: int) -> DataFrame:
    """(part, lang, text) of about so many documents of each language, by a hash of the id; part 1 is for calibration."""
    rows = docs.where(train_rows & F.col("lang").isNotNull())
    langs = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not langs:
        return rows.limit(0).select(F.lit(0).alias("part"), "lang", "text")
    share = F.create_map(*[x for lang, n in langs.items() for x in (F.lit(lang), F.lit(min(1.0, sample_docs / n)))])
    spot = F.pmod(F.xxhash64(F.lit("sample"), F.col("doc_id")), F.lit(1_000_000)) / 1e6
    part = (F.pmod(F.xxhash64(F.lit("part"), F.col("doc_id")), F.lit(1000)) < 1000 * CALIBRATION_SHARE).cast("int")
    return rows.where(spot < share[F.col("lang")]).select(part.alias("part"), "lang", "text")


def fit(docs: DataFrame, train_rows: Column, sample_docs: int = SAMPLE_DOCS) -> Models | None:
    """Models of the languages in ``lang`` of the rows that ``train_rows`` holds for, or None without any."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches, "text"):
            by: dict[str, Counter] = {}
            for lang, text in zip(batch.column(0).to_pylist(), texts, strict=True):
                by.setdefault(lang, Counter()).update((text or b"").decode("utf-8", "replace").split())
            rows = [(lang, w, n) for lang, words in by.items() for raw, n in words.items() if (w := letters(raw))]
            if rows:
                yield pa.record_batch([pa.array(x) for x in zip(*rows, strict=True)], names=["key", "word", "n"])

    sample = _sampled(docs, train_rows, sample_docs)
    keyed = sample.select(F.concat(F.col("part").cast("string"), "lang").alias("key"), "text")
    words = keyed.mapInArrow(count, "key string, word string, n long")
    counts = words.groupBy("key", "word").agg(F.sum("n").alias("n")).toPandas()
    if counts.empty:
        return None
    counts["part"], counts["lang"] = counts.key.str[0].astype(int), counts.key.str[1:]
    fitted = set(counts.lang[counts.part == 0])
    # a language that has all its letters in the calibration part is learned from them, and calibrates nothing
    models = train(counts[(counts.part == 0) | ~counts.lang.isin(fitted)].drop(columns=["key", "part"]))
    held = docs.sparkSession.sparkContext.broadcast(models)

    def entropy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(held.value)
        for batch, texts in pieces(batches, "text"):
            got = scorer.texts(texts)
            yield pa.record_batch([batch.column(0), pa.array(got.tolist(), pa.list_(pa.float64()))], names=["lang", "bits"])

    seen = sample.where("part = 1").select("lang", "text").mapInArrow(entropy, "lang string, bits array<double>").toPandas()
    seen = seen[[b[0] > 0 and lang in fitted for b, lang in zip(seen.bits, seen.lang, strict=True)]]
    if len(seen):
        bits = np.array(seen.bits.tolist())
        h, truth = bits[:, 1:] / bits[:, :1], np.array([models.languages.index(x) for x in seen.lang])
        loss = {}
        for scale in (1, 2, 5, 10, 20, 40):
            z = -h * scale
            z -= z.max(1, keepdims=True)
            loss[scale] = -(z[np.arange(len(z)), truth] - np.log(np.exp(z).sum(1))).mean()
        models.scale = float(min(loss, key=loss.get))
        models.limit = float(h.min(1).max() + MARGIN_BITS)
    return models


def identify(docs: DataFrame, train_rows: Column | None = None, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """``doc_id, lang_pred, score, cross_entropy, rejected`` for every row.

    ``docs`` needs doc_id, text and lang; models are learned from text and lang of rows that
    ``train_rows`` holds for (all by default; rows with a null lang never count). lang_pred is the
    learned language of the lowest length-normalised cross-entropy, ties to the first by name, or
    ``und`` with score 0 if the text is null, empty or without a letter, or nothing was learned. score
    is the calibrated probability. rejected is true for ``und`` and for texts beyond the calibrated
    limit. Repeated rows are predicted each; extra columns are ignored; an empty table gives no rows.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), F.coalesce(train_rows if train_rows is not None else F.lit(True), F.lit(False)).alias("learn"))
    models = fit(base, F.col("learn"), sample_docs)
    held = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = held.value
        scorer = Scorer(models) if models else None
        for batch, texts in pieces(batches, "text"):
            n = len(texts)
            pred, score, low, out = ["und"] * n, np.zeros(n), np.full(n, np.nan), np.ones(n, bool)
            if scorer:
                got = scorer.texts(texts)
                some = np.flatnonzero(got[:, 0] > 0)
                h = got[some, 1:] / got[some, :1]
                best = h.argmin(1) if len(some) else np.zeros(0, int)
                z = np.exp(-models.scale * (h - h.min(1, keepdims=True))) if len(some) else h
                for i, b in zip(some, best, strict=True):
                    pred[i] = models.languages[b]
                if len(some):
                    score[some], low[some] = (1 / z.sum(1)).clip(0, 1), h.min(1)
                    out[some] = low[some] > models.limit
            yield pa.record_batch([batch.column(0), pa.array(pred), pa.array(score), pa.array(low, mask=np.isnan(low)), pa.array(out)], names=["doc_id", "lang_pred", "score", "cross_entropy", "rejected"])

    return base.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, cross_entropy double, rejected boolean")


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents in a learned language, with all their columns; a missing lang is filled with the prediction.

    Rows are predicted and passed on in one pass, without a join. See ``identify`` for the rules."""
    base = docs.select("doc_id", "text", "lang")
    models = fit(base, F.lit(True))
    held = docs.sparkSession.sparkContext.broadcast(models)

    @F.pandas_udf("lang_pred string, rejected boolean")
    def judge(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        models = held.value
        scorer = Scorer(models) if models else None
        for part in parts:
            preds, rejects = [], []
            for at in range(0, len(part), 256):
                texts = [t.encode() if isinstance(t, str) else None for t in part.iloc[at : at + 256]]
                got = scorer.texts(texts) if scorer else np.zeros((len(texts), 1))
                for row in got:
                    h = row[1:] / row[0] if row[0] > 0 else None
                    preds.append(models.languages[int(h.argmin())] if h is not None else "und")
                    rejects.append(bool(h is None or h.min() > models.limit))
            yield pd.DataFrame({"lang_pred": preds, "rejected": rejects})

    found = "judged"
    while found in docs.columns:
        found += "_"
    # not deterministic for the optimizer: else it works the models out once for the filter and again for the columns
    seen = docs.withColumn(found, judge.asNondeterministic()(F.col("text").cast("string")))
    return seen.where(~F.col(f"{found}.rejected")).withColumn("lang", F.coalesce("lang", f"{found}.lang_pred")).drop(found)
