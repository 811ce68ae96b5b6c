import datetime as dt

import random

import pytest
from pyspark.sql import functions as F

from weft.operators import changes as C
from weft.operators import dedup as D
from weft.operators import graph as G
from weft.operators import lint as L
from weft.operators import pages as P
from weft.operators import reviews as R
from weft.operators import search as S
from weft.operators.components import connected_components


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect()) if columns else sorted(map(tuple, df.collect()))


def make_pages(spark, pages):
    return spark.createDataFrame([(p, t, c, l) for p, t, c, l in pages], "path string, title string, content string, links array<string>")


def test_rank_fusion(spark):
    keyword = spark.createDataFrame([("a", 1), ("b", 2)], "page_id string, rank int")
    vector = spark.createDataFrame([("b", 1), ("c", 2)], "page_id string, rank int")
    got = {r.page_id: r.score for r in S.fuse(keyword, vector).collect()}
    assert got == pytest.approx({"b": 0.0325224749, "a": 0.0163934426, "c": 0.0161290323})


def test_search_takes_graph_neighbours(spark):
    pages = make_pages(spark, [("wiki/p1.md", "One", "needle here", ["Second Page"]), ("wiki/p2.md", "Second Page", "other", []), ("wiki/p3.md", "Third", "other", [])])
    got = S.search(pages, "needle", 10).collect()
    assert [(r.path, r.related_to) for r in got] == [("wiki/p1.md", None), ("wiki/p2.md", ["One"])]
    assert got[1].score == pytest.approx(1 / 61)
    assert [r.path for r in S.search(pages, "needle", 1).collect()] == ["wiki/p1.md"]
    assert S.search(pages, "absent", 5).count() == 0


def test_hybrid_search_uses_vectors(spark):
    pages = make_pages(spark, [("wiki/p1.md", "One", "needle here", []), ("wiki/p2.md", "Two", "other", []), ("wiki/p3.md", "Three", "other", [])])
    chunks = spark.createDataFrame([("p2", 0, "t", "", [1.0, 0.0]), ("p3", 0, "t", "", [0.0, 1.0]), ("p2", 1, "u", "", [0.9, 0.0])], "page_id string, chunk_index int, chunk_text string, heading_path string, vector array<float>")
    got = S.search(pages, "needle", 5, chunks, F.array(F.lit(1.0), F.lit(0.0))).collect()
    assert [r.path for r in got] == ["wiki/p1.md", "wiki/p2.md", "wiki/p3.md"] and got[1].vector_score == pytest.approx(1.0) and got[0].vector_score is None
    assert got[0].score == got[1].score == pytest.approx(1 / 61)


def test_phrase_beats_scattered_words(spark):
    pages = make_pages(spark, [("wiki/a.md", "A", "alpha x beta", []), ("wiki/b.md", "B", "alpha beta", [])])
    assert [r.path for r in S.search(pages, "alpha beta").collect()] == ["wiki/b.md", "wiki/a.md"]


def test_link_resolution(spark):
    links = spark.createDataFrame([("s", "Foo Bar"), ("s", "foo-bar"), ("s", "FOO-BAR"), ("s", "none"), ("foo-bar", "foo-bar")], "src string, raw string")
    ids = spark.createDataFrame([("foo-bar", 0), ("Foo Bar", 1), ("s", 2)], "id string, ordinal int")
    got = rows(G.resolve_targets(links, ids), "src", "raw", "dst")
    assert got == [("s", "FOO-BAR", "foo-bar"), ("s", "Foo Bar", "Foo Bar"), ("s", "foo-bar", "foo-bar")]
    pages = make_pages(spark, [("wiki/a.md", "Same", "", ["Same", "b#part", "wiki/b", "c.md"]), ("wiki/b.md", "Same", "", []), ("wiki/x/c.md", "C", "", [])])
    assert rows(S.resolve_links(pages)) == [("wiki/a.md", "wiki/b.md"), ("wiki/a.md", "wiki/x/c.md")]


def test_relevance(spark):
    edges = spark.createDataFrame([("A", "B"), ("B", "A"), ("A", "N"), ("B", "N")], "src string, dst string")
    nodes = spark.createDataFrame([("A", "entity", ["s"]), ("B", "concept", ["s"]), ("N", "other", [])], "id string, type string, sources array<string>")
    pair = spark.createDataFrame([("A", "B")], "a string, b string")
    assert G.relevance(pair, edges, nodes).first().relevance == pytest.approx(13.3640425614)


def test_communities_and_surprise(spark):
    nodes = spark.createDataFrame([(i, f"n{i}", "source" if i < 3 else "concept", 0 if i < 3 else 1 if i < 6 else 2, 2) for i in range(7)], "id long, label string, type string, community int, degree long")
    edges = spark.createDataFrame([(0, 1, 3.0), (1, 2, 3.0), (0, 2, 3.0), (3, 4, 3.0), (4, 5, 3.0), (2, 3, 1.5)], "src long, dst long, weight double")
    got = {r.community: (r.number, r["size"], r.cohesion) for r in G.communities(nodes, edges).collect()}
    assert got[0] == (0, 3, 1.0) and got[1][2] == pytest.approx(2 / 3) and got[2] == (2, 1, 0.0)
    assert [(r.src, r.dst, r.score) for r in G.surprising(nodes, edges).collect()] == [(2, 3, 8)]
    assert rows(G.induced(nodes.where("id < 2"), edges), "src", "dst") == [(0, 1)]
    assert rows(G.undirected(spark.createDataFrame([(2, 1), (1, 2)], "src long, dst long"))) == [(1, 2)]


def test_packing_is_the_greedy_fold(spark):
    rng = random.Random(1)
    for most in (9,):
        sizes = [rng.choice([1, 2, 3, most, most + 7, rng.randint(1, most)]) for _ in range(150)]
        rows_ = [(m, f"c{c:03}") for c, n in enumerate(sizes) for m in range(n)] + [(0, None)]
        got = {r.cluster: r.batch for r in D.pack_clusters(spark.createDataFrame(rows_, "id int, cluster string"), most).collect()}
        want, batch, used = {}, 0, 0
        for c, n in enumerate(sizes):
            if used and used + n > most:
                batch, used = batch + 1, 0
            used += n
            want[f"c{c:03}"] = batch
        assert got == want
    assert D.pack_clusters(spark.createDataFrame([], "id int, cluster string")).count() == 0


def test_workspace_signatures_read_the_ends_of_long_files(spark, tmp_path):
    big = bytes(range(256)) * 2000
    (tmp_path / "a").mkdir()
    for name, data in (("a/small.txt", b"abc"), ("empty", b""), ("big", big), ("same", b"12345")):
        (tmp_path / name).write_bytes(data)
    look = lambda: C.signatures(C.listing(spark, str(tmp_path)), whole=1000, edge=64).collect()
    before = look()
    assert {r.path: r.bytes_read for r in before} == {"a/small.txt": 3, "empty": 0, "big": 128, "same": 5}
    (tmp_path / "big").write_bytes(big[:-1] + b"!")
    (tmp_path / "new").write_bytes(b"n")
    (tmp_path / "empty").unlink()
    now = spark.createDataFrame(look())
    old = spark.createDataFrame(before)
    got = rows(C.workspace_changes(old.withColumn("modified", F.lit(0)), now.withColumn("modified", F.lit(0))), "path", "bytes", "existed_before")
    assert got == [("big", len(big), True), ("new", 1, False)]
    assert C.workspace_changes(old, now, 1).count() == 1 and C.workspace_changes(old, old).count() == 0


def test_louvain_finds_cliques(spark):
    cliques = [(a + o, b + o, 1.0) for o in (0, 10, 20) for a in range(5) for b in range(a)] + [(0, 10, 1.0), (10, 20, 1.0)]
    edges = spark.createDataFrame(cliques, "src long, dst long, weight double")
    got = {r.id: r.community for r in G.louvain(edges).collect()}
    assert len(got) == 15 and all(len({got[o + i] for i in range(5)}) == 1 for o in (0, 10, 20)) and len(set(got.values())) == 3
    alone = spark.createDataFrame([(i, i) for i in got], "id long, community long")
    assert G.modularity(edges, G.louvain(edges)).first()[0] > G.modularity(edges, alone).first()[0] + 0.5


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7), (200, 200)]
    got = dict(rows(connected_components(spark.createDataFrame(chain, "u long, v long"))))
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_cosine_pairs_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_ROWS", 3)
    v = [[1.0, 0.0], [1.0, 0.1], [0.0, 1.0], [0.1, 1.0], None, [0.0, 0.0], [float("nan"), 1.0], [1.0, 1.0], [1.0, 0.0]]
    table = spark.createDataFrame(list(enumerate(v)), "id long, vector array<double>")
    got = rows(D.cosine_pairs(table, 0.9), "a", "b")
    assert got == [(0, 1), (0, 8), (1, 8), (2, 3)]
    assert rows(D.near_duplicates(table, 0.9)) == [(0, 0), (1, 0), (2, 2), (3, 2), (8, 0)]
    assert D.coverage(table).first().embedded == 8


def test_groups(spark):
    pairs = spark.createDataFrame([("a", "b"), ("b", "c")], "a string, b string")
    assert rows(D.clusters(pairs)) == [("a", "a"), ("b", "a"), ("c", "a")]
    groups = spark.createDataFrame([(["B", "a"],), (["c", "d"],)], "ids array<string>")
    allowed = spark.createDataFrame([("a|b",)], "key string")
    assert [r.ids for r in D.drop_whitelisted(groups, allowed).collect()] == [["c", "d"]]
    members = spark.createDataFrame([(i, i // 3) for i in range(9)], "id long, cluster long")
    got = {r.id: r.batch for r in D.pack_clusters(members, 7).collect()}
    assert [got[i] for i in range(9)] == [0] * 6 + [1] * 3


def test_merges(spark):
    a = lambda *x: F.array(*map(F.lit, x))
    one = spark.range(1)
    assert one.select(D.union_ci(a("A.pdf", "b.md"), a("a.PDF", "c"))).first()[0] == ["A.pdf", "b.md", "c"]
    decide = lambda items: tuple(one.select(D.delete_decision(items, F.lit("x")).alias("d")).first().d)
    assert decide(F.array().cast("array<string>")) == ("skip", []) and decide(a("x")) == ("delete", []) and decide(a("X", "y")) == ("keep", ["y"]) and decide(a("y")) == ("skip", ["y"])
    schema = "path string, type string, title string, created string, sources array<string>, tags array<string>, related array<string>, body string"
    old = spark.createDataFrame([("p", "entity", "T", "2020", ["a"], [], [], "x" * 100)], schema)
    new = spark.createDataFrame([("p", "other", "U", "2024", ["A", "b"], ["t"], [], "y" * 80), ("q", "q", "Q", "1", [], [], [], "z")], schema)
    got = {r.path: r for r in D.merge_pages(old, new).collect()}
    assert got["p"].type == "entity" and got["p"].sources == ["a", "b"] and got["p"].body == "y" * 80 and got["q"].body == "z"
    short = new.withColumn("body", F.lit("short"))
    assert {r.path: r.body for r in D.merge_pages(old, short).collect()}["p"].endswith("\n\nshort")
    assert one.select(D.rewrite_links(F.lit("[[Old]] [[old|x]] [[older]]"), {"old": "new"})).first()[0] == "[[new]] [[new|x]] [[older]]"
    assert one.select(D.remap_list(a("old", "k", "New"), {"old": "new"})).first()[0] == ["new", "k"]
    assert one.select(D.drop_index_lines(F.lit("# I\n- [[a]]\n- [[b|B]]\n* [c](x/c.md)\n- d"), ["a", "c"])).first()[0] == "# I\n- [[b|B]]\n- d"


def test_embedding(spark):
    def embedder(texts):
        if len(texts) > 1 and any("bad" in t for t in texts):
            raise ValueError("no batch")
        if any(len(t) > 100 for t in texts):
            raise ValueError("too long")
        return [[float("nan")] if "bad" in t else [1.0, float(len(t))] for t in texts]

    table = spark.createDataFrame([(0, "ok"), (1, "bad"), (2, "y" * 300), (3, None)], "id long, text string").coalesce(1)
    got = {r.id: (r.vector, r.error) for r in D.embed(table, embedder).collect()}
    assert got[0] == ([1.0, 2.0], None) and got[1] == (None, "invalid vector") and got[2] == ([1.0, 75.0], None) and got[3][0] == [1.0, 0.0]


def test_lint(spark):
    schema = "id long, slug string, short_name string, title string, tokens array<string>, outlinks array<string>"
    common = ["shared", "words", "here"]
    table = spark.createDataFrame([(0, "transformer", "a/transformer.md", "Transformer", common, ["attention"]), (1, "attention", "a/attention.md", "Attention", common, ["transfomer", "Transformer"]), (2, "lonely", "b/lonely.md", "Lonely", common, [])], schema)
    got = {(r.type, r.page): (r.target, r.suggestion) for r in L.lint(table).collect()}
    assert got == {("broken-link", "a/attention.md"): ("transfomer", "a/transformer.md"), ("orphan", "b/lonely.md"): (None, "a/transformer.md"), ("no-outlinks", "b/lonely.md"): (None, "a/transformer.md")}


def test_related_score(spark):
    tokens = spark.createDataFrame([(i, t) for i, ts in enumerate((["a1", "b1", "c1", "d1"], ["a1", "b1", "x1", "y1"])) for t in ts], "id long, token string")
    folders = spark.createDataFrame([(0, "f"), (1, "f")], "id long, folder string")
    assert {(r.id, r.other, round(r.score, 9)) for r in L.related(tokens, folders).collect()} == {(0, 1, 0.58), (1, 0, 0.58)}


def test_changes(spark):
    kinds = {("Created", "Created"): "Created", ("Created", "Modified"): "Modified", ("Created", "Deleted"): "Modified", ("Modified", "Created"): "Created", ("Modified", "Modified"): "Modified", ("Modified", "Deleted"): "Deleted", ("Deleted", "Created"): "Modified", ("Deleted", "Modified"): "Modified", ("Deleted", "Deleted"): "Deleted"}
    for (a, b), want in kinds.items():
        assert spark.range(1).select(C.merged_kind(F.lit(a), F.lit(b))).first()[0] == want
    schema = "path string, hash string, size long"
    old = spark.createDataFrame([("a", "1", 5), ("b", "2", 5), ("c", None, 9), ("d", "x", 40)], schema)
    new = spark.createDataFrame([("a", "1", 5), ("b", "3", 5), ("c", None, 9), ("e", "x", 40)], schema)
    assert rows(C.diff(old, new)) == [("b", "Modified"), ("d", "Deleted"), ("e", "Created")]
    assert rows(C.moves(old.where("path = 'd'"), new.where("path = 'e'"))) == [("d", "e")]
    assert C.moves(old.where("path = 'd'"), new.where("path = 'e'").union(new.where("path = 'e'").withColumn("path", F.lit("f")))).count() == 0
    assert C.moves(old.withColumn("size", F.lit(31)), new.where("path = 'e'")).count() == 0
    assert rows(C.expand_deleted(spark.createDataFrame([("x",), ("y/z",)], "path string"), spark.createDataFrame([("x/a",), ("x/b/c",), ("xx/d",), ("y/z",), ("y/zz",)], "path string"))) == [("x/a",), ("x/b/c",), ("y/z",)]


def test_queue(spark):
    t = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    schema = "path string, kind string, status string, retries int, needs_rerun boolean, updated_at timestamp"
    queue = spark.createDataFrame([("p", "Created", "Pending", 0, False, t(0)), ("w", "Modified", "Processing", 0, False, t(0)), ("f", "Created", "Failed", 1, False, t(0)), ("g", "Created", "Failed", 3, False, t(0)), ("k", "Deleted", "Pending", 0, False, t(0))], schema)
    changes = spark.createDataFrame([(p, "Deleted", t(1)) for p in "pwfgn"], "path string, kind string, updated_at timestamp")
    got = {r.path: (r.kind, r.status, r.needs_rerun) for r in C.upsert(queue, changes).collect()}
    assert got == {"p": ("Modified", "Pending", False), "w": ("Deleted", "Processing", True), "f": ("Modified", "Pending", False), "g": ("Modified", "Failed", False), "k": ("Deleted", "Pending", False), "n": ("Deleted", "Pending", False)}
    again = queue.withColumn("needs_rerun", F.col("path") == "w")
    results = spark.createDataFrame([("p", True, t(0)), ("w", True, t(0)), ("f", False, t(0)), ("k", True, t(9))], "path string, ok boolean, version timestamp")
    left = {r.path: (r.status, r.retries, r.needs_rerun) for r in C.process(again, results).collect()}
    assert left == {"w": ("Pending", 0, False), "f": ("Failed", 2, False), "g": ("Failed", 3, False), "k": ("Pending", 0, False)}
    assert C.status_counts(queue).first().failed == 2


def test_histories(spark):
    table = spark.createDataFrame([("u", i, x) for i, x in enumerate("aabbbca")], "k string, i int, x string")
    assert [(r.i, r.x) for r in C.history(table, "k", "i", "x", n=3).orderBy("i").collect()] == [(2, "b"), (5, "c"), (6, "a")]
    text = spark.createDataFrame([("u", 0, "abc"), ("u", 1, "defg"), ("u", 2, "hi")], "k string, i int, t string")
    assert [r.t for r in C.budget_prefix(text, "k", F.col("i"), "t", 5).orderBy("i").collect()] == ["abc", "de"]


def test_reviews(spark):
    schema = "pos int, type string, title string, description string, resolved boolean, created_at long, pages array<string>, queries array<string>, options array<struct<label: string, action: string>>"
    table = R.with_ids(spark.createDataFrame([(0, "duplicate", "X", "", False, 5, ["a"], ["q"], [("l1", "go")]), (1, "duplicate", "Duplicate page: x", "d", True, 3, ["b", "a"], [], [("l2", "go"), ("l3", "no")])], schema))
    m = R.merge(table).collect()
    assert len(m) == 1 and m[0].resolved and m[0].created_at == 3 and m[0].description == "d" and m[0].pages == ["a", "b"] and [o.label for o in m[0].options] == ["l1", "l3"]
    assert [o.label for o in R.merge(table, last_option=True).first().options] == ["l2", "l3"]
    assert R.select(R.merge(table), resolved=False).count() == 0
    pages = spark.createDataFrame([("foo-bar", "Foo"), ("kept", "K")], "page_id string, title string")
    asked = spark.createDataFrame([("1", "missing-page", "Missing page: Foo Bar", None), ("2", "missing-page", "Nope", None), ("3", "duplicate", "d", ["kept.md", "gone.md"]), ("4", "duplicate", "d", ["kept"]), ("5", "contradiction", "Foo", ["gone"]), ("6", "missing-page", "FOO", None)], "id string, type string, title string, pages array<string>")
    assert rows(R.sweep(asked, pages)) == [("1", "page-exists"), ("3", "page-gone"), ("6", "page-exists")]
    old = spark.createDataFrame([("r", "t", "T", "old", True, 1)], "id string, type string, title string, description string, resolved boolean, created_at long")
    new = spark.createDataFrame([("r", "t", "T", "new", False, 9), ("s", "t", "S", "", False, 9)], old.schema)
    assert rows(R.update(old, new), "id", "description", "resolved", "created_at")[0] == ("r", "new", True, 1)


def test_pages(spark):
    table = spark.createDataFrame([("a.md", 0), ("a.md", 1), ("b", 2), ("b", 3)], "name string, i int")
    assert rows(P.unique_names(table, "name", F.col("i")), "unique") == [("a-2.md",), ("a.md",), ("b",), ("b-2",)]
    old, new = (spark.createDataFrame(x, "k string, i int") for x in ([("a", 0), ("b", 1)], [("b", 0), ("c", 1)]))
    assert [r.k for r in P.recent(old, new, "k", "i", 2).collect()] == ["b", "c"]
    pages = spark.createDataFrame([(["in/x.pdf", "x.pdf", "y"],)], "sources array<string>")
    known = spark.createDataFrame([("in/x.pdf",)], "path string")
    assert P.move_source(pages, "in/x.pdf", "out/x.pdf", known).first().sources == ["out/x.pdf", "y"]
    assert P.move_source(pages, "in/x.pdf", "out/x.pdf", known.union(spark.createDataFrame([("o/X.pdf",)], "path string"))).first().sources == ["out/x.pdf", "x.pdf", "y"]
    assert spark.range(1).select(P.answer_title(F.lit("<think>a\nb</think>\n<!-- c -->\n## Title here\nx"))).first()[0] == "Title here"


def test_louvain_covers_all_links(spark):
    from weft.plans import graph_queries
    from weft.plans.common import edges

    sf = "/root/testdata/sf0.01"
    e = edges(spark, sf)
    ends = {x for r in e.collect() for x in (r.src, r.dst)}
    import duckdb

    found = graph_queries.louvain(spark, sf).toPandas()
    got, links = dict(zip(found.id, found.community, strict=True)), e.toPandas()
    total = "(SELECT sum(weight) FROM links)"
    checked = duckdb.sql(f"""WITH l AS (SELECT a.community AS x, b.community AS y, weight FROM links JOIN found a ON a.id = src JOIN found b ON b.id = dst),
        k AS (SELECT c, sum(weight) AS k FROM (SELECT x AS c, weight FROM l UNION ALL SELECT y, weight FROM l) GROUP BY 1)
        SELECT (SELECT sum(weight) FROM l WHERE x = y) / {total} - (SELECT sum(k * k) FROM k) / (4 * {total} * {total})""").fetchall()[0][0]
    assert links is not None and abs(checked - found.modularity[0]) < 1e-8 and found.modularity.nunique() == 1
    assert got.keys() == ends and len(ends) > 1_000
    assert set(got.values()) <= ends
