import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from weft.llm.language import DISCOUNT, END, ORDER, START, Scorer, _grams, identify, keep_identified, letters, train
from weft.session import table

SF = "/root/testdata/sf0.01"


def test_chances_are_finite_and_sorted():
    models = train(pd.DataFrame({"lang": ["a"] * 3 + ["b"], "word": ["abab", "abc", "b", "xyz"], "n": [5, 2, 1, 3]}))
    alphabet = sorted(set("abcxyz"))
    n, bits = models.words(["ab" + c for c in alphabet])
    assert (n == 4).all()
    assert np.isfinite(bits).all() and (bits > 0).all()
    assert bits[alphabet.index("a"), 0] < bits[alphabet.index("x"), 0]
    assert models.keys.tolist() == sorted(models.keys.tolist())


def plain_chance(words, symbol, before, alphabet):
    """Interpolated Kneser-Ney by its formula, from counted words."""
    grams = {}
    for word, n in words.items():
        line = [START] * (ORDER - 1) + [ord(c) for c in word] + [END]
        for i in range(ORDER - 1, len(line)):
            key = tuple(line[i - ORDER + 1 : i + 1])
            grams[key] = grams.get(key, 0) + n
    levels = [grams]
    while len(levels) < ORDER:  # lower orders count the distinct longer grams
        lower = {}
        for key in levels[-1]:
            lower[key[1:]] = lower.get(key[1:], 0) + 1
        levels.append(lower)
    p = 1 / alphabet
    for k, level in enumerate(reversed(levels)):
        context = tuple(before[len(before) - k :])
        own = {key: n for key, n in level.items() if key[:-1] == context}
        if own:
            total = sum(own.values())
            p = max(own.get((*context, symbol), 0) - DISCOUNT, 0) / total + DISCOUNT * len(own) / total * p
    return p


def test_chances_are_those_of_the_formula_and_sum_to_one():
    words = {"abab": 5, "abc": 2, "b": 1, "cabba": 1}
    models = train(pd.DataFrame({"lang": ["a"] * len(words), "word": list(words), "n": list(words.values())}))
    size = round(1 / models.uniform)  # all symbols that the models reckon with
    for start in ("", "a", "ab", "abab", "xyz", "cabb"):
        known = sorted(set("abc"))
        flat, spots, whose = _grams([start + c for c in known] + [start, start + "q"])
        p = models.chances(flat, spots)[:, 0]
        place = np.arange(len(spots)) - np.searchsorted(whose, whose)
        at = p[place == len(start)]  # each known letter, the end, an unknown letter
        assert np.isclose(at[:-1].sum() + (size - len(at) + 1) * at[-1], 1)
        before = [START] * (ORDER - 1) + [ord(c) for c in start]
        assert np.allclose(at, [plain_chance(words, x, before, size) for x in [*map(ord, known), END, ord("q")]])


def test_every_language_is_learned(docs):
    rows = docs(["the cat sat on the mat and the dog ran"] * 41).withColumn("lang", F.when(F.col("doc_id") == 5, "fr").otherwise("en"))
    rows = rows.withColumn("text", F.when(F.col("doc_id") == 5, "le chat est sur la table avec le chien").otherwise(F.col("text")))
    assert {r.doc_id: r.lang_pred for r in identify(rows).collect()} == {i: "fr" if i == 5 else "en" for i in range(41)}
    for i in range(8):  # one document alone, whatever part it falls in
        one = docs(["some letters", None, "12 34"], start=3 * i)
        assert [r.lang_pred for r in identify(one).orderBy("doc_id").collect()] == ["en", "und", "und"]


def test_words_score_as_one_by_one():
    models = train(pd.DataFrame({"lang": ["a", "b"], "word": ["hello", "monde"], "n": [5, 5]}))
    words = ["hello", "monde", "é", "hellomonde", "z" * 500]
    n, bits = models.words(words)
    for i, w in enumerate(words):
        n1, b1 = models.words([w])
        assert n[i] == n1[0] == len(w) + 1 and np.allclose(bits[i], b1[0])
    scorer = Scorer(models)
    both = scorer.texts([b"hello monde", b"Hello, MONDE!", b"", None, b"123 -"])
    assert np.allclose(both[0], both[1]) and not both[2:].any()


def test_held_out_accuracy(spark):
    docs = table(spark, SF, "documents")
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    got = identify(docs, part != 1).join(docs.select("doc_id", "lang"), "doc_id").where(part == 1).toPandas()
    assert len(got) > 250 and (got.lang == got.lang_pred).mean() >= 0.97
    assert got.score.between(0, 1).all() and got.rejected.mean() < 0.01


def test_nothing_but_text_counts(docs):
    texts = ["the cat sat on the mat and the dog", "le chat est sur la table avec le chien"] * 20
    rows = docs(texts).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "en").otherwise("fr"))
    a = {r.doc_id: r.lang_pred for r in identify(rows).collect()}
    assert a == {i: ("en", "fr")[i % 2] for i in range(40)}
    hidden = rows.withColumn("source", F.lit("other")).withColumn("lang", F.when(F.col("doc_id") < 20, F.col("lang")))
    assert {r.doc_id: r.lang_pred for r in identify(hidden).collect()} == a


def test_odd_tables(messy, empty):
    got = identify(messy).collect()
    assert len(got) == 13
    assert all(r.lang_pred == "und" and r.score == 0 and r.rejected for r in got if r.doc_id in (0, 1, 2))
    assert all(r.lang_pred == "en" for r in got if r.doc_id in (3, 4, 5, 6, 8))
    kept = keep_identified(messy)
    assert kept.columns == messy.columns and {r.doc_id for r in kept.collect()}.isdisjoint({0, 1, 2})
    assert identify(empty).count() == 0 and keep_identified(empty).count() == 0
    unlabelled = identify(messy.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in unlabelled} == {"und"}


def test_letters():
    assert letters("Don't") == "dont" and letters("123") == "" and letters("Été!") == "été"
