import math
import os
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from weft.llm import licenses as L

TEXTS = [
    "Some prose of the day.\nLicensed under the Apache License, Version 2.0.\nMore prose here.",
    "Released under the MIT License. And so on.",
    "This work is licensed under the GNU General Public License, version 3.",
    "A licensed driver released the brake.\nIt was under the bridge.",
    "Licensed under CC BY-NC 4.0.\nLicensed under CC BY 4.0.",
    "no licence at all",
    "",
    None,
    "All rights reserved.",
    "SPDX-License-Identifier: MIT",
]


def plain(texts):
    """(licence, score) of the best sentence of each text by cosines over all templates, without anchors."""
    every = [*L.HEADERS, *L.FILES]
    vocabulary = {t for _, x in every for t in L.terms(x)}
    df = Counter(t for x in texts for t in set(L.terms(x or "")) & vocabulary)
    idf = {t: math.log((len(texts) + 1) / (df[t] + 1)) + 1 for t in vocabulary}
    rare = math.log(len(texts) + 1) + 1
    out = []
    for text in texts:
        best = (0.0, 0, "")
        for sentence in re.split(r"\n|(?<=[.!?;])[ \t]+", text or ""):
            tf = Counter(L.terms(sentence))
            norm = math.sqrt(sum((k * idf[t]) ** 2 if t in idf else k * rare**2 for t, k in tf.items()))
            for i, (name, template) in enumerate(L.HEADERS):
                v = Counter(L.terms(template))
                dot = sum(tf[t] * idf[t] * k * idf[t] for t, k in v.items() if t in tf)
                score = round(dot / norm / math.sqrt(sum((k * idf[t]) ** 2 for t, k in v.items())), 9) if norm else 0.0
                best = max(best, (score, -i, name))
        out.append((best[2], best[0]) if best[0] >= L.THRESHOLD else (None, None))
    return out


def test_headers_are_those_of_all_cosines(docs):
    got = {r.doc_id: (r.license, r.score) for r in L.scan(docs(TEXTS), F.concat(F.lit("d"), "doc_id", F.lit("/f"))).collect()}
    for i, (name, score) in enumerate(plain(TEXTS)):
        assert got[i][0] == name and (score is None) == (got[i][1] is None)
        assert score is None or got[i][1] == pytest.approx(score, abs=1e-6)
    assert [got[i][0] for i in range(6)] == ["Apache-2.0", "MIT", "GPL-3.0", None, "CC-BY-NC-4.0", None]


def test_anchors_lose_nothing():
    _, vectors = L.weigh(L.HEADERS, 1000, {"the": 900, "under": 400})
    marks = set(L.anchors(vectors, 0.75))
    for _, _, v in vectors:
        assert sum(w * w for t, w in v.items() if t not in marks) < 0.75**2


def test_nearest_directory_counts(spark):
    rows = [("LICENSE", dict(L.FILES)["MIT"]), ("a/x.py", "code"), ("a/b/COPYING", "This work is licensed under the GNU General Public License, version 3."), ("a/b/c/y.py", "code"), ("a/b/z.py", "Released under the MIT License."), ("ab/q.py", None), (None, "code")]
    df = spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(rows)], "doc_id long, path string, text string")
    got = {r.doc_id: (r.license, r.origin, r.inherited_from) for r in L.scan(df, F.col("path")).collect()}
    assert got[0][0] == "MIT" and got[1] == ("MIT", "inherited", "LICENSE")
    assert got[3] == ("GPL-3.0", "inherited", "a/b/COPYING") and got[4][:2] == ("MIT", "header")
    assert got[5] == ("MIT", "inherited", "LICENSE") and got[6] == (None, None, None)


@pytest.mark.parametrize("few", [L.BROADCAST_FOLDERS, 0])  # 0: the way of many directories
def test_whole_licence_texts_hold_for_their_directory(spark, monkeypatch, few):
    monkeypatch.setattr(L, "BROADCAST_FOLDERS", few)
    passages, files = dict(L.PASSAGES), dict(L.FILES)
    legal = "\n\n".join(f"{i}. Terms of part {i}. You may convey a work under this section, and the work must carry prominent notices stating the day." for i in range(300))
    wrapped = lambda text: "\n   ".join(re.findall(r".{1,60}(?:\s|$)", text))
    texts = {"GPL-3.0": wrapped(passages["GPL-3.0"]) + "\n\nPreamble\n\n" + legal, "Apache-2.0": wrapped(passages["Apache-2.0"]) + "\n\n" + legal, "MPL-2.0": "Mozilla Public License Version 2.0\n====\n1. Definitions\n1.1. " + wrapped(passages["MPL-2.0"]) + "\n" + legal, "LGPL-3.0": legal + "\n" + wrapped(passages["LGPL-3.0"]), "MIT": "MIT License\n\nCopyright (c) 2020 A. Person\n\n" + wrapped(files["MIT"].removeprefix("MIT License. ")), "BSD-3-Clause": "Copyright (c) 1999, Some Body\nAll rights reserved.\n\n" + wrapped(files["BSD-3-Clause"]), "ISC": wrapped(files["ISC"])}
    shelf = "/usr/share/common-licenses"
    if os.path.isdir(shelf):
        texts |= {f"{name}@": open(f"{shelf}/{own}").read() for name, own in (("GPL-3.0", "GPL-3"), ("GPL-2.0", "GPL-2"), ("LGPL-3.0", "LGPL-3"), ("Apache-2.0", "Apache-2.0"), ("MPL-2.0", "MPL-2.0"), ("CC0-1.0", "CC0-1.0"), ("BSD-3-Clause", "BSD"))}
    rows = [(f"{i}/legal.txt", t) for i, t in enumerate(texts.values())] + [(f"{i}/src/code.py", "code") for i in range(len(texts))] + [("none/code.py", legal)]
    df = spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(rows)], "doc_id long, path string, text string")
    got = {r.doc_id: (r.license, r.origin) for r in L.scan(df, F.col("path")).collect()}
    want = [name.rstrip("@") for name in texts]
    assert [got[i + len(want)] for i in range(len(want))] == [(name, "inherited") for name in want]
    assert [got[i][0] for i in range(len(want))] == want
    assert got[2 * len(want)] == (None, None)


def test_a_missing_source_is_no_folder(spark, tmp_path):
    from weft.llm import queries

    rows = [(0, "This work is licensed under the GNU General Public License, version 3.", None), (1, "code", None), (2, "code", "s"), (None, "code", "s"), (4, dict(L.FILES)["MIT"], "s")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.path, r.license, r.origin) for r in queries.op9_licenses(spark, str(tmp_path)).collect()}
    assert got[0] == (None, "GPL-3.0", "header") and got[1] == (None, None, None) and got[2] == ("s/2", "MIT", "inherited") and got[None] == (None, None, None)


def test_no_python_in_the_plan(docs):
    plan = L.scan(docs(TEXTS), F.lit("a/b"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_odd_tables(messy, empty):
    got = L.scan(messy, F.concat_ws("/", "source", F.col("doc_id").cast("string"))).collect()
    assert len(got) == 13 and {r.license for r in got} == {None}
    assert L.scan(empty, F.lit("x")).count() == 0


def test_common_words_beside_a_statement_weigh_little(docs):
    texts = [f"en prosa {i} por la casa" for i in range(400)] + ["en Released under the MIT License en", "por en la All rights reserved", "Released under the MIT License zzq"]
    got = {r.doc_id: (r.license, r.score) for r in L.scan(docs(texts), F.lit("a/b")).collect()}
    df = Counter(t for x in texts for t in set(L.terms(x)))
    idf = lambda t: math.log((len(texts) + 1) / (df[t] + 1)) + 1
    for i, template in ((400, "Released under the MIT License."), (401, "All rights reserved."), (402, "Released under the MIT License.")):
        tf, v = Counter(L.terms(texts[i])), Counter(L.terms(template))
        norm = lambda x: math.sqrt(sum((k * idf(t)) ** 2 for t, k in x.items()))
        want = sum(tf[t] * k * idf(t) ** 2 for t, k in v.items()) / norm(tf) / norm(v)
        assert want >= L.THRESHOLD and got[i][1] == pytest.approx(want, abs=1e-6)
    assert (got[400][0], got[401][0], got[402][0], got[0][0]) == ("MIT", "Proprietary", "MIT", None)


def test_wrapped_statements_count(spark):
    wrapped = ["This program is free software: you can redistribute it and/or modify", "it under the terms of the GNU General Public License as published by", "the Free Software Foundation, either version 3 of the License, or", "(at your option) any later version."]
    rows = [
        ("a/LICENSE", "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n" + "prose of a long licence text\n" * 50 + "\n".join(wrapped) + "\nThe end of it."),
        ("a/b.py", "code"),
        ("c/d.c", "int x;\n/*\n" + "\n".join(f" * {x}" for x in wrapped) + "\n */\nint y;"),
        ("c/e.py", "\n".join(f"# {x}" for x in "Released under\nthe\nMIT License.".split("\n"))),
        ("c/f.py", "it was released\nlast week and the program\nis under review"),
    ]
    df = spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(rows)], "doc_id long, path string, text string")
    got = {r.doc_id: (r.license, r.origin) for r in L.scan(df, F.col("path")).collect()}
    assert got == {0: ("GPL-3.0", "header"), 1: ("GPL-3.0", "inherited"), 2: ("GPL-3.0", "header"), 3: ("MIT", "header"), 4: (None, None)}
