"""License scans: sparse TF-IDF cosines of headers and licence files to templates, and inheritance along directories.

Every sentence of a text, and every run of neighbouring sentences and lines (wrapped statements; comment marks are
no terms), is a header that may state a licence. A text is a licence file if it is, as a whole, like the whole text
of a short licence, or if a run of its lines is like a passage that only the text of a long licence holds, however long the
rest is. All are sparse TF-IDF vectors, compared by cosine with the templates. Document frequencies of all
terms are counted over all texts, in one table. A file without a statement of its own inherits from the
nearest directory above it that holds a licence file: paths are joined with their ancestors.

Only runs with an anchor are scored: the rarest terms of each template, as many as are needed
that the other terms alone can't reach the threshold (by Cauchy-Schwarz their cosine is at most their
share of the template's norm). Terms outside the templates are first taken to weigh 1, the least that a term
can; only the bags that reach the threshold so have their other terms looked up in the table. So no match is lost.
The templates are a fixed table of this module; their weights go into the plan as literals.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.session import materialize

#: Licence statements as they stand in headers and notices: (SPDX id, sentence).
HEADERS = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or any later version."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("Proprietary", "All rights reserved."),
)
#: Passages that stand in the text of a licence itself, for licences whose texts are long: (SPDX id, passage).
PASSAGES = (
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("MPL-2.0", "Contributor means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software."),
    ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal CREATIVE COMMONS CORPORATION IS NOT A LAW FIRM AND DOES NOT PROVIDE LEGAL SERVICES."),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International Public License By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions"),
)
#: Whole texts of short licences.
FILES = (
    (
        "MIT",
        "MIT License. Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software "
        "without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom "
        "the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of "
        "the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR "
        "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
        "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain "
        "the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
        "the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be "
        "used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND "
        "ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE "
        "COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS "
        "OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR "
        "OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "ISC",
        "ISC License. Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this "
        "permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF "
        "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR "
        "PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
)
THRESHOLD = 0.75
FILE_THRESHOLD = 0.6
#: File names that hold the licence of their directory whatever they say otherwise.
FILE_NAME = r"(?i)^(licen[cs]e|copying|notice|unlicense)(\.(md|txt|rst))?$"
TERM = "[a-z0-9][a-z0-9.+-]*[a-z0-9+]|[a-z0-9]"
#: Rows of the table of frequencies up to which the asked part is broadcast, some 10 MB.
BROADCAST_TERMS = 200_000
#: Directories that inherit, up to which they're broadcast, some 10 MB; more are joined with the rows of a directory dealt to so many tasks.
BROADCAST_FOLDERS = 100_000
SALTS = 16
BREAK = "\\n|(?<=[.!?;])[\\x20\\t]+"

Template = tuple[str, str, dict[str, float]]


def terms(text: str) -> list[str]:
    """The terms of a text: lower-case runs of letters, digits and inner . + -."""
    return re.findall(TERM, text.lower())


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def document_frequencies(docs: DataFrame) -> DataFrame:
    """``(term, df)``: in how many texts each term stands; the number of rows is that of the term " n"."""
    return docs.select(F.explode(F.array_append(F.array_distinct(F.coalesce(_words(F.col("text")), F.array().cast("array<string>"))), F.lit(" n"))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def weigh(templates: tuple[tuple[str, str], ...], n: int, df: dict[str, int]) -> tuple[dict[str, float], list[Template]]:
    """Inverse document frequencies, and the normalised vectors of the templates."""
    idf = {t: math.log((n + 1) / (df.get(t, 0) + 1)) + 1 for _, text in templates for t in terms(text)}
    out = []
    for name, text in templates:
        tf = Counter(terms(text))
        norm = math.sqrt(sum((k * idf[t]) ** 2 for t, k in tf.items()))
        out.append((name, text, {t: k * idf[t] / norm for t, k in tf.items()}))
    return idf, out


def anchors(templates: list[Template], threshold: float) -> list[str]:
    """Terms without which no vector reaches the threshold with any template."""
    out: set[str] = set()
    for _, _, vector in templates:
        left = 1.0
        for t, w in sorted(vector.items(), key=lambda x: (-x[1], x[0])):
            if left < threshold**2 - 1e-9:
                break
            out.add(t)
            left -= w * w
    return sorted(out)


def _summed(rows: DataFrame, bags: str, templates: list[Template], idf: dict[str, float]) -> DataFrame:
    """``rows`` with ``_summed``: for each bag ``w`` of terms in the array column ``bags`` a struct of ``w``, ``n`` (its terms
    outside the templates), ``known`` (squared norm of the others) and ``dots`` (products with the templates).

    Each step is a column of its own, so that the plan stays as small as the work; the weights are one literal."""
    weights = {t: {"i": idf[t], "w": [v.get(t, 0.0) for _, _, v in templates]} for _, _, vector in templates for t in vector}
    table = F.from_json(F.lit(json.dumps(weights)), "map<string, struct<i: double, w: array<double>>>")
    known = F.transform(bags, lambda w: F.struct(w.alias("w"), F.transform(F.array_intersect(w, _vocabulary(templates)), lambda t: F.struct(t.alias("t"), _count(w, t).alias("k"))).alias("b")))
    rows = rows.withColumn("_known", known)
    weighed = F.transform("_known", lambda x: F.struct(x.w.alias("w"), F.transform(x.b, lambda y: F.struct(y.k.alias("k"), table[y.t].alias("v"))).alias("b")))
    rows = rows.withColumn("_weighed", weighed)
    strange = lambda x: F.size(x.w) - F.aggregate(x.b, F.lit(0), lambda s, y: s + y.k)
    norm2 = lambda x: F.aggregate(x.b, F.lit(0.0), lambda s, y: s + y.k * y.k * y.v.i * y.v.i)
    dots = lambda x: F.aggregate(x.b, F.array_repeat(F.lit(0.0), len(templates)), lambda s, y: F.zip_with(s, y.v.w, lambda p, q: p + q * y.k * y.v.i))
    rows = rows.withColumn("_summed", F.transform("_weighed", lambda x: F.struct(x.w.alias("w"), strange(x).alias("n"), norm2(x).alias("known"), dots(x).alias("dots"))))
    return rows.drop("_known", "_weighed")


def _vocabulary(templates: list[Template]) -> Column:
    return F.array(*map(F.lit, sorted({t for _, _, vector in templates for t in vector})))


def _count(bag: Column, term: Column) -> Column:
    return F.size(F.filter(bag, lambda x: x == term))


def _windows(rows: DataFrame, pieces: str, marks: Column, templates: list[Template], idf: dict[str, float], threshold: float, out: str) -> DataFrame:
    """``rows`` with ``out``: the bags of all runs of neighbouring bags in ``pieces`` that may reach the threshold.

    A shortest run with a statement has a term of it in every piece, so no run needs more pieces than the longest
    template has terms; and it holds an anchor. Products add up over pieces, and squared norms of a run are at least
    the sum of its pieces', each term outside the templates at its least weight, 1."""
    most = max(len(terms(text)) for _, text, _ in templates)
    rows = rows.withColumn("_at", F.filter(F.transform(pieces, lambda w, i: F.when(F.arrays_overlap(w, marks), i)), lambda i: i.isNotNull()))
    near = F.transform(pieces, lambda w, i: F.when(F.exists("_at", lambda a: F.abs(a - i) < most), w).otherwise(F.array().cast("array<string>")))
    rows = rows.withColumn("_near", F.when(F.size("_at") > 0, near))
    rows = _summed(rows, "_near", templates, idf).withColumn("_light", F.transform("_summed", lambda x: F.struct(x.dots.alias("dots"), (x.known + x.n).alias("norm2"))))
    zero = F.struct(F.array_repeat(F.lit(0.0), len(templates)).alias("dots"), F.lit(0.0).alias("norm2"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("hits"))

    def add(s: Column, x: Column) -> Column:
        return F.struct(F.zip_with(s.dots, x.dots, lambda p, q: p + q).alias("dots"), (s.norm2 + x.norm2).alias("norm2"), (s.n + 1).alias("n"), F.when(s.n > 0, F.when(F.array_max(s.dots) >= (threshold - 1e-6) * F.sqrt(s.norm2), F.array_append(s.hits, s.n)).otherwise(s.hits)).otherwise(s.hits).alias("hits"))

    def last(s: Column) -> Column:
        return F.when(F.array_max(s.dots) >= (threshold - 1e-6) * F.sqrt(s.norm2), F.array_append(s.hits, s.n)).otherwise(s.hits)

    starts = F.filter(F.transform("_light", lambda x, i: F.when((F.array_max(x.dots) > 0) & F.exists("_at", lambda a: (a >= i) & (a < i + most)), i)), lambda i: i.isNotNull())
    rows = rows.withColumn("_starts", starts)
    rows = rows.withColumn("_runs", F.transform("_starts", lambda i: F.struct(i.alias("i"), F.aggregate(F.slice("_light", i + 1, F.lit(most)), zero, add, last).alias("n"))))
    rows = rows.withColumn(out, F.flatten(F.transform("_runs", lambda r: F.transform(r.n, lambda k: F.flatten(F.slice("_near", r.i + 1, k))))))
    return rows.drop("_at", "_near", "_summed", "_light", "_starts", "_runs")


def _bounded(rows: DataFrame, bags: str, templates: list[Template], idf: dict[str, float], threshold: float) -> DataFrame:
    """``rows`` with the bags of terms in the array column ``bags`` that may reach the threshold, as structs of
    ``dots`` (products with the templates), ``known`` (squared norm of the templates' terms) and ``others`` (t, k: the other terms).

    Each other term counts for its least weight, 1, at first."""
    rows = _summed(rows, bags, templates, idf)
    rows = rows.withColumn("_left", F.filter("_summed", lambda x: F.array_max(x.dots) >= (threshold - 1e-6) * F.sqrt(x.known + x.n)))
    others = lambda w: F.transform(F.array_except(w, _vocabulary(templates)), lambda t: F.struct(t.alias("t"), _count(w, t).alias("k")))
    kept = F.transform("_left", lambda x: F.struct(x.dots.alias("dots"), x.known.alias("known"), others(x.w).alias("others")))
    return rows.withColumn(bags, F.coalesce(kept, F.array().cast("array<struct<dots: array<double>, known: double, others: array<struct<t: string, k: int>>>>"))).drop("_summed", "_left")


def _best(found: DataFrame, bags: dict[str, str], frequencies: DataFrame, n: int) -> DataFrame:
    """``row`` and for each of ``bags`` (column of ``_bounded``, name of the result) the best (score, minus the template's number)."""
    each = [found.select("row", F.lit(out).alias("kind"), F.posexplode(c).alias("pos", "bag")) for c, out in bags.items()]
    bag = each[0]
    for more in each[1:]:
        bag = bag.unionByName(more)
    terms_of = bag.select("row", "kind", "pos", F.explode("bag.others").alias("x")).select("row", "kind", "pos", F.col("x.t").alias("term"), F.col("x.k").alias("k"))
    asked = frequencies.join(terms_of.select("term").distinct(), "term", "left_semi")
    if asked.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS:
        asked = F.broadcast(asked)
    idf = F.log(F.lit(n + 1.0) / (F.coalesce("df", F.lit(0)) + 1)) + 1
    norms = terms_of.join(asked, "term", "left").groupBy("row", "kind", "pos").agg(F.sum(F.col("k") * F.col("k") * idf * idf).alias("strange"))
    scored = bag.join(norms, ["row", "kind", "pos"], "left").withColumn("norm", F.sqrt(F.col("bag.known") + F.coalesce("strange", F.lit(0.0))))
    best = F.array_max(F.transform("bag.dots", lambda d, i: F.struct(F.round(d / F.col("norm"), 9).alias("score"), (-i).alias("template"))))
    return scored.groupBy("row").agg(*[F.max(F.when(F.col("kind") == out, best)).alias(out) for out in bags.values()])


def own_licenses(docs: DataFrame, headers: tuple[tuple[str, str], ...] = HEADERS, files: tuple[tuple[str, str], ...] = FILES, passages: tuple[tuple[str, str], ...] = PASSAGES, threshold: float = THRESHOLD, file_threshold: float = FILE_THRESHOLD) -> DataFrame:
    """``doc_id, path, header, header_score, file, file_score``: the best statement in each text and its likeness to a licence file."""
    frequencies = materialize(document_frequencies(docs), "df")
    templates = (*headers, *passages, *files)
    wanted = sorted({t for _, text in templates for t in terms(text)} | {" n"})
    df = {r.term: r.df for r in frequencies.where(F.col("term").isin(wanted)).collect()}  # a row for each term of the templates
    n = df.pop(" n", 0)
    idf, vectors = weigh(templates, n, df)
    # kind: column of its bags, templates, their names, threshold
    kinds = {
        "h": ("_headers", vectors[: len(headers)], headers, threshold),
        "p": ("_passages", vectors[len(headers) : len(headers) + len(passages)], passages, threshold),
        "f": ("_files", vectors[len(headers) + len(passages) :], files, file_threshold),
    }
    marks = {k: F.array(*map(F.lit, anchors(own, least))) for k, (_, own, _, least) in kinds.items()}
    rows = docs.withColumn("_split", F.transform(F.split("text", BREAK), _words))
    rows = rows.withColumn("_lines", F.filter("_split", lambda w: F.size(w) > 0)).withColumn("_whole", F.flatten("_lines"))
    marked = {k: F.arrays_overlap("_whole", marks[k]) for k in kinds}
    rows = rows.select("doc_id", "path", F.when(marked["h"], F.col("_lines")).alias("_of_h"), F.when(marked["p"], F.col("_lines")).alias("_of_p"), F.when(marked["f"], F.array("_whole")).alias("_files"))
    for k in "hp":
        rows = _windows(rows, f"_of_{k}", marks[k], kinds[k][1], idf, threshold, kinds[k][0]).drop(f"_of_{k}")
    for bags, own, _, least in kinds.values():
        rows = _bounded(rows, bags, own, idf, least)
    found = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "bags")  # numbered once, as it's written
    best = _best(found, {bags: k for k, (bags, _, _, _) in kinds.items()}, frequencies, n)
    rows = found.select("row", "doc_id", "path").join(best, "row", "left")

    def hit(k: str) -> tuple[Column, Column]:
        _, _, named, least = kinds[k]
        score = F.when(F.col(f"{k}.score") >= least, F.col(f"{k}.score"))
        return F.when(score.isNotNull(), F.get(F.array(*[F.lit(x) for x, _ in named]), -F.col(f"{k}.template"))), score

    (header, header_score), (passage, passage_score), (whole, whole_score) = map(hit, "hpf")
    by_passage = passage_score.isNotNull() & (whole_score.isNull() | (passage_score >= whole_score))
    file, file_score = F.when(by_passage, passage).otherwise(whole), F.when(by_passage, passage_score).otherwise(whole_score)
    return rows.select("doc_id", "path", header.alias("header"), header_score.alias("header_score"), file.alias("file"), file_score.alias("file_score"))


def _directory(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def _spread(rows: DataFrame, folders: DataFrame, on: str, how: str) -> DataFrame:
    """``rows`` joined with a table of one row for each directory: broadcast if its rows, counted, are few; else the rows of a
    directory go to several tasks, as one may hold a third of all and the root is above every one."""
    if folders.limit(BROADCAST_FOLDERS + 1).count() <= BROADCAST_FOLDERS:
        return rows.join(F.broadcast(folders), on, how)
    dealt = folders.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int")).join(dealt, [on, "salt"], how).drop("salt")


def inherit(found: DataFrame) -> DataFrame:
    """``doc_id, path, license, score, origin, inherited_from`` from the rows of ``own_licenses``.

    origin is ``header`` (a statement), ``file`` (the text is a licence file), ``inherited``, or null."""
    found = materialize(found, "found")
    name = F.element_at(F.split("path", "/"), -1)
    holders = found.where(F.col("file").isNotNull() | (name.rlike(FILE_NAME) & F.col("header").isNotNull()))
    best = F.max_by(F.struct(F.coalesce("file", "header").alias("license"), F.col("path").alias("from")), F.struct(F.coalesce("file_score", "header_score"), F.col("path")))
    by_folder = materialize(holders.where("path is not null").groupBy(_directory(F.col("path")).alias("folder")).agg(best.alias("held")), "holders")
    own = F.coalesce("file", "header")
    # one row for each folder that needs a licence, then its ancestors, and the nearest that has one
    folders = found.where(own.isNull() & F.col("path").isNotNull()).select(_directory(F.col("path")).alias("at")).distinct()
    parts = F.split("at", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    up = folders.select("at", F.posexplode(F.array_distinct(above)).alias("depth", "folder"))
    nearest = materialize(_spread(up, by_folder, "folder", "inner").groupBy("at").agg(F.max_by("held", "depth").alias("held")), "nearest")
    out = _spread(found.withColumn("at", F.when(own.isNull(), _directory(F.col("path")))), nearest, "at", "left")
    origin = F.when(F.col("file").isNotNull(), "file").when(F.col("header").isNotNull(), "header").when(F.col("held").isNotNull(), "inherited")
    return out.select("doc_id", "path", F.coalesce(own, "held.license").alias("license"), F.coalesce("file_score", "header_score").alias("score"), origin.alias("origin"), F.col("held.from").alias("inherited_from"))


def scan(docs: DataFrame, path: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, path, license, score, origin, inherited_from`` for every row.

    ``path`` is the file's path with / between directories, without one at either end; null paths
    neither give nor inherit. Null and empty texts state nothing but inherit. A licence file has its own
    licence, any other text that of its best header (ties: the first template); several licence files in a directory count by their
    score, ties to the last path. Repeated rows are judged each; extra columns are ignored; an empty table
    gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), path.alias("path"))
    return inherit(own_licenses(rows))
