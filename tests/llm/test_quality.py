import random
import re
from collections import Counter

from weft.llm.quality import RULES, compile_rules, judge

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    covered = {j for i, w in enumerate(windows) if times[w] > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed)


def texts():
    rng = random.Random(9)
    out = []
    for n in (0, 1, 2, 3, 4, 5, 49, 50, 51, 120, 400):
        for size in (2, 5, 60):
            out.append("".join(rng.choice([" ", " ", "\n", "\t", " \n "]) + rng.choice([f"w{rng.randrange(size)}", "the", "é#", "漢字", "a b"]) for _ in range(n)))
    return out + ["a b c\na b c\n a b c", "x y z " * 30, "# * | < >"]


def test_measures_are_those_of_plain_code(docs):
    every = texts()
    got = {r.doc_id: tuple(r[1:7]) for r in judge(docs(every)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()}
    assert got == {i: plain(t) for i, t in enumerate(every)}


def test_rules(docs):
    good = " ".join(f"word{i} the of" for i in range(60))
    junk = " ".join(f"word{i}%%% word{i + 500}###" for i in range(60))
    got = {r.doc_id: (r.base_failed, r.kept) for r in judge(docs([good, junk, good + " " + junk[:40], "short"])).collect()}
    assert got == {0: (False, True), 1: (False, False), 2: (False, True), 3: (True, False)}
    assert "kept" in judge(docs([good]), rules=()).columns and judge(docs([junk]), rules=()).first().kept
    assert compile_rules(RULES) is not None


def test_no_python_in_the_plan(docs):
    plan = judge(docs(["a"]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_odd_tables(messy, empty):
    got = judge(messy).collect()
    assert len(got) == 13 and sorted(r.n_words for r in got)[-1] == 220_000
    assert all(r.base_failed and not r.kept and r.n_words == 0 for r in got if r.doc_id in (0, 1, 2))
    assert judge(empty).count() == 0
