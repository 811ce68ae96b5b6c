import random
import re
from collections import Counter

from weft.llm import divergence
from weft.llm.divergence import audit, terms

WORD = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SCALE = 10**9


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute(rows, least=3, most=200):
    docs = [(lang or "", source or "", [lower(w) for w in WORD.findall(text or "")]) for text, lang, source in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        seen = Counter(w for x, _, words in docs if x == lang for w in set(words))
        kept = sorted(w for w, n in seen.items() if n >= least)
        sources = {s for x, s, _ in docs if x == lang}
        count = {s: Counter(w for x, y, words in docs if (x, y) == (lang, s) for w in words if seen[w] >= least) for s in sources}
        whole = sum(count.values(), Counter())
        share = lambda c: {w: 1 + SCALE * (c[w] + 1) // (sum(c.values()) + len(kept)) for w in kept}
        far = lambda p, q: (p - q) ** 2 // q
        p, q = {s: share(c) for s, c in count.items()}, share(whole)
        for s in sources:
            pairs = sorted(((-sum(far(p[s][w], p[o][w]) for w in kept), o.encode()) for o in sources if o != s))
            best = sorted(((-far(p[s][w], q[w]), w.encode()) for w in kept if count[s][w] and p[s][w] > q[w]))[:most]
            out |= {(lang, s, part, i.decode(), -v, k) for part, found in (("pair", pairs), ("term", best)) for k, (v, i) in enumerate(found, 1)}
    return out


def result(spark, rows, **kw):
    docs = spark.createDataFrame([(t, x, s, "a", 1) for t, x, s in rows], "text string, lang string, source string, term string, n int")
    return {tuple(r) for r in audit(docs, **kw).collect()}


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 5)
    rng = random.Random(2)
    words = ["The", "the", "été", "ÉTÉ", "x1y", "漢字", "a_b", "naïve", "zoo", "Zoo-keeper"] + [f"w{chr(97 + i)}" for i in range(12)]
    rows = [(" ".join(rng.choices(words, k=rng.randint(0, 30))), rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", "é", ""])) for _ in range(60)]
    rows += [("only here", "fr", "a"), (None, "en", None), ("", "en", "silent"), (None, None, None)]
    assert result(spark, rows) == brute(rows)
    assert result(spark, rows, least_docs=1, most_terms=3) == brute(rows, 1, 3)


def test_no_kept_term_and_empty(spark):
    rows = [("one two", "en", "a"), ("three", "en", "b"), ("lonely", "xx", "c")]
    assert result(spark, rows) == {("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)}
    assert result(spark, []) == set()


def test_long_text_and_repeated_rows(spark):
    rows = [("Word " * 200_000 + "x" * 300_000, "en", "a")] * 3 + [("word other", "en", "b")]
    assert result(spark, rows) == brute(rows)


def test_terms_of_odd_characters():
    text = "A\u0000b[c]D{e}~\u007f\u0080ß😀 Z9z"
    assert [t.decode() for t in terms(text.encode()) if t] == [lower(w) for w in WORD.findall(text)]
