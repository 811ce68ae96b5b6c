import random

import pytest

from weft.llm.line_dedup import dedup_lines, edit_distance


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def plain(rows, threshold=2, similarity=0.8):
    """(text, repeated, similar) of each row (id, text) in order."""
    seen, out = [], []
    for _, text in rows:
        kept, repeated, similar = [], 0, 0
        for line in (text or "").split("\n"):
            if not line.strip(" \t\n\x0b\x0c\r"):
                kept.append(line)
                continue
            if line in seen:
                repeated += 1
                continue
            near = any(abs(len(s) - len(line)) <= threshold and distance(s, line) <= min(threshold, (1 - similarity) * max(len(s), len(line)) + 1e-9) for s in seen)
            seen.append(line)
            if near:
                similar += 1
            else:
                kept.append(line)
        out.append((None if text is None else "\n".join(kept), repeated, similar))
    return out


def corpus():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdeé漢") for _ in range(rng.randint(1, 6)))
    bases = [" ".join(word() for _ in range(rng.randint(1, 14))) for _ in range(30)]

    def edited(line):
        s = list(line)
        for _ in range(rng.randint(0, 4)):
            kind, at = rng.randrange(3), rng.randrange(len(s) + 1)
            if kind == 0:
                s.insert(at, rng.choice("abx "))
            elif s and at < len(s):
                if kind == 1:
                    del s[at]
                else:
                    s[at] = rng.choice("xyz ")
        return "".join(s)

    return ["\n".join(edited(rng.choice(bases)) if rng.random() < 0.8 else rng.choice(["", "  ", "\t"]) for _ in range(rng.randint(0, 9))) for _ in range(60)]


@pytest.mark.parametrize("hot_rows", [256, 0])  # 0: every shared segment takes the way of hot ones
def test_lines_are_those_of_plain_code(docs, hot_rows):
    texts = corpus()
    want = plain(list(enumerate(texts)))
    got = {r.doc_id: (r.text, r.n_repeated, r.n_similar) for r in dedup_lines(docs(texts), hot_rows=hot_rows).collect()}
    assert got == dict(enumerate(want))
    assert sum(w[1] for w in want) > 5 and sum(w[2] for w in want) > 20


def test_short_lines_are_similar_by_their_share(docs):
    lines = ["abc", "abd", "abcd", "abce", "abcde", "abcdf", "abxde", "bcde", "abcdefgh", "abcdefxx", "abcdefgx", "abcdefghij", "abcdefghxx", "xbcdefghi", "abcdefghijk", "cdefghijk", "😀é漢字abc", "😀é漢字abd", "é漢字abc"]
    for seed in range(6):
        texts = random.Random(seed).sample(lines, len(lines))
        for similarity in (0.8, 0.6):
            got = {r.doc_id: r.text for r in dedup_lines(docs(texts), similarity=similarity).collect()}
            assert got == {i: w[0] for i, w in enumerate(plain(list(enumerate(texts)), similarity=similarity))}


@pytest.mark.parametrize("hot_rows", [256, 0])
def test_groups_of_near_lines_keep_their_first(docs, hot_rows):
    rng = random.Random(3)
    base = "the same template line with changing characters in it"
    texts = ["".join(rng.choice("xyz") if i in rng.sample(range(len(base)), 2) else c for i, c in enumerate(base)) for _ in range(40)]
    texts += ["".join(rng.choice("abcdefgh") for _ in range(12)) + " a common tail of all these lines" for _ in range(40)]
    rng.shuffle(texts)
    got = {r.doc_id: (r.text, r.n_repeated, r.n_similar) for r in dedup_lines(docs(texts), hot_rows=hot_rows).collect()}
    assert got == dict(enumerate(plain(list(enumerate(texts)))))


@pytest.mark.parametrize("threshold", [1, 2, 3, 5])
def test_bit_parallel_distance(spark, threshold):
    rng = random.Random(threshold)
    pairs = [("", ""), ("", "a"), ("abc", ""), ("a" * 200, "a" * 199 + "b")]
    for _ in range(250):
        one = "".join(rng.choice("abé😀") for _ in range(rng.randint(0, 12)))
        two = list(one) if rng.random() < 0.8 else [rng.choice("abé😀") for _ in range(rng.randint(0, 12))]
        for _ in range(rng.randint(0, 6)):
            at = rng.randrange(len(two) + 1)
            two[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "b"])
        pairs.append((one, "".join(two)))
    df = spark.createDataFrame([(list(a), list(b)) for a, b in pairs], "one array<string>, two array<string>")
    for r in edit_distance(df, "one", "two", threshold, "d").collect():
        want = distance(r.one, r.two)
        assert r.d == (want if want <= threshold else None), (r.one, r.two)
    assert spark.sql("select split('a😀é', '') as c").first().c == ["a", "😀", "é"]


def test_threshold_of_one(docs):
    texts = corpus()
    got = {r.doc_id: r.text for r in dedup_lines(docs(texts), threshold=1).collect()}
    assert got == {i: w[0] for i, w in enumerate(plain(list(enumerate(texts)), 1))}


def test_order_counts(docs):
    got = {r.doc_id: r.text for r in dedup_lines(docs(["one line that is here\nother", "new\none line that is here", "one line that is hers"])).collect()}
    assert got == {0: "one line that is here\nother", 1: "new", 2: ""}


def test_odd_tables(messy, empty):
    out = dedup_lines(messy, counts=False)
    assert out.columns == messy.columns
    got = out.collect()
    assert len(got) == 13
    by = {r.doc_id: r.text for r in got if r.doc_id is not None}
    assert by[0] is None and by[1] == "" and by[2] == " \n\t " and by[4] == "same text of five words here" and by[5] == "" and len(by[7]) == 300_000
    assert dedup_lines(empty).count() == 0


def test_no_python_in_the_plan(docs):
    plan = dedup_lines(docs(["a\nb"]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
