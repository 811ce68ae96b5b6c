"""Contexts of pages, gaps of graphs, and long sources read over several runs."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from weft.functions import text as T
from weft.functions.parse import heading_section
from weft.operators import contexts as X
from weft.operators import graph as G
from weft.operators import long_sources as L
from weft.sources.store import StaleRun, Store


def make(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_scanned_links_and_addresses(spark):
    texts = ["[[a|b]] x [[ c ]] [[]] [[|d]] [[e", "[[[[f]] g]] [[h\ni]]", "none", "", None, "[[" * 20_000, "]] [[x"]
    found = [r.l for r in make(spark, [(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(T.scanned_links(F.col("t")).alias("l")).collect()]
    assert found == [["a", "c"], ["[[f", "h\ni"], [], [], None, [], []]
    rows = make(spark, [("Wiki\\Big Page.md.md#part",), ("  A B ",), ("x.md ",)], "t string").select(T.link_address(F.col("t")).alias("a")).collect()
    assert [r.a for r in rows] == ["wiki/big-page", "a-b", "x"]


def test_page_contexts(spark):
    pages = [
        ("wiki/a.md", "---\ntitle: First\ntags: [t2, t1]\n---\n[[B]] [[b|again]] [[second page]] [[gone]] [[First]]"),
        ("wiki/x/b.md", "# Second Page\n[[a.md#top]]"),
        ("wiki/c.md", "---\ntitle: First\n---\n[[wiki/x/b.md]]"),
        ("wiki/d.md", None),
        (None, "[[a]]"),
    ]
    df = make(spark, pages, "path string, content string")
    found = {r.path: r for r in X.page_contexts(df).collect()}
    assert set(found) == {"wiki/a.md", "wiki/x/b.md", "wiki/c.md", "wiki/d.md"}
    a, b, c, d = found["wiki/a.md"], found["wiki/x/b.md"], found["wiki/c.md"], found["wiki/d.md"]
    # the title First is that of two pages, the last path has it
    assert (a.tags, a.outgoing, a.backlinks, a.neighbours, a.link_count) == (["t2", "t1"], ["B", "First", "b", "gone", "second page"], ["wiki/x/b.md"], ["wiki/c.md", "wiki/x/b.md"], 6)
    assert (b.outgoing, b.backlinks, b.link_count) == (["a.md#top"], ["wiki/a.md", "wiki/c.md"], 3)
    assert (c.backlinks, c.link_count) == (["wiki/a.md"], 2)
    assert (d.tags, d.outgoing, d.backlinks, d.neighbours, d.link_count) == ([], [], [], [], 0)
    cut = {r.path: r for r in X.page_contexts(df, most=1).collect()}["wiki/a.md"]
    assert (cut.tags, cut.outgoing, cut.neighbours, cut.link_count) == (["t2"], ["B"], ["wiki/c.md"], 6)
    assert X.page_contexts(df.limit(0)).count() == 0
    assert [r.path for r in X.matching(X.page_contexts(df), df, ["GONE"]).collect()] == ["wiki/a.md"]


def test_enriched_results(spark):
    contexts = X.page_contexts(make(spark, [("p", "[[q]]"), ("q", "")], "path string, content string"))
    history = make(spark, [("p", 1, "x", "t"), ("p", 3, "a", "t"), ("p", 3, "b", "s"), ("p", None, "z", "z")], "path string, timestamp int, author string, tool string")
    results = make(spark, [("p", 0.5, ["q"]), ("q", 0.4, []), ("lost", 0.3, None)], "path string, score double, near array<string>")
    found = {r.path: r for r in X.enriched(results, contexts, history, F.col("near")).collect()}
    assert (found["p"].kind, found["p"].related_to, found["p"].link_count, tuple(found["p"].latest_version)) == ("graph", ["q"], 1, (3, "b", "s"))
    assert (found["q"].kind, found["q"].backlinks, found["q"].latest_version) == ("wiki", ["p"], None)
    assert (found["lost"].link_count, found["lost"].score) == (None, 0.3)


def test_knowledge_gaps(spark):
    ring = [(f"r{i:02}", f"R{i}", "concept", 1, 2) for i in range(20)]
    others = [(f"s{i}", f"S{i}", "entity", 2 + i, 2) for i in range(3)]
    alone = [("index", "I", "x", 9, 0), ("o", "O", "overview", 9, 0), ("lone", "L", "concept", 8, 1)]
    nodes = make(spark, ring + others + alone, "id string, label string, type string, community int, degree long")
    edges = make(spark, [(f"r{i:02}", f"r{(i + 1) % 20:02}") for i in range(20)] + [("r00", "s0"), ("r00", "s1"), ("index", "s0"), ("index", "s1"), ("index", "s2")], "src string, dst string")
    gaps = G.knowledge_gaps(nodes, edges)
    assert [(r.kind, r.subject, r.title, r.n_pages) for r in gaps.collect()] == [
        ("isolated-node", "", "1 isolated page", 1), ("sparse-community", "1", "Sparse cluster: R0", 20), ("bridge-node", "r00", "Key bridge: R0", 1),
    ]
    pages = {(r.kind, r.id) for r in G.gap_pages(nodes, gaps).collect()}
    assert pages == {("isolated-node", "lone"), ("bridge-node", "r00")} | {("sparse-community", r[0]) for r in ring}
    assert G.knowledge_gaps(nodes.limit(0), edges.limit(0)).count() == 0
    assert len(G.knowledge_gaps(nodes, edges, limit=2).collect()) == 2


def test_heading_section():
    raw = "intro\n## chunk analysis \n one\n### inner\ntwo \n## Updated Global Digest\nlast"
    assert heading_section(raw, "Chunk Analysis") == "one\n### inner\ntwo"
    assert heading_section(raw, "Updated Global Digest") == "last"
    assert heading_section("## Chunk Analysisx\na", "Chunk Analysis") == heading_section(None, "x") == ""


def _book(n: int) -> str:
    return "".join(f"# Part {i}\n\n" + f"Sentence {i} of a part. " * 400 + "\n\n" for i in range(n))


def _call(fail_at: int | None = None):
    def call(digest, chunk):
        if chunk["index"] == fail_at and chunk["page_id"] == "b":
            raise ValueError("no answer")
        return f"## Chunk Analysis\nsaid {chunk['index']}\n## Updated Global Digest\n{digest}{chunk['index']};"

    return call


def test_long_sources_go_on_where_they_ended(spark, tmp_path):
    book = _book(12)
    sources = make(spark, [("a", book, 20_000), ("a", book, 20_000), ("b", book + "x", 20_000), ("short", "text", 20_000), ("none", None, 20_000), (None, book, 20_000)], "page_id string, content string, budget int")
    store = Store(spark, str(tmp_path), L.SCHEMAS)
    run = store.claim()
    assert L.analyse(sources, store, run, _call(fail_at=3), steps=2, rounds=2) == 2
    found = {r.page_id: r for r in L.plans(sources.where("page_id is not null").distinct(), store).collect()}
    total = found["a"].total
    assert total > 4 and (found["a"].done, found["b"].done, found["b"].problem) == (4, 2, "ValueError: no answer")
    assert (found["short"].chunked, found["short"].context, found["none"].context) == (False, "text", None)
    # another run goes on behind the steps that are there, and the first one can't commit any more
    later = store.claim()
    with pytest.raises(StaleRun):
        L.analyse(sources, store, run, _call())
    L.analyse(sources, store, later, _call(), steps=3)
    assert L.analyse(sources, store, later, _call()) == 0
    steps = store.read("steps").where("problem is null")
    assert steps.groupBy("page_id", "index").count().where("count > 1").count() == 0
    found = {r.page_id: r for r in L.plans(sources.where("page_id is not null").distinct(), store).collect()}
    for page in "ab":
        r = found[page]
        assert (r.done, r.problem) == (total, None)
        assert f"## Final Global Digest\n{''.join(f'{i};' for i in range(1, total + 1))}\n" in r.analysis
        notes = r.analysis.split("## Per-Chunk Analyses\n")[1].split("\n\n")
        assert [n.split(" — ")[0] for n in notes] == [f"## Chunk {i}/{total}" for i in range(1, total + 1)] and "Part" in notes[-1]
        assert notes[2].endswith("\nsaid 3") and r.context.endswith(f"said {total}")
    # a text that changed starts anew
    changed = make(spark, [("a", book + "more", 20_000)], "page_id string, content string, budget int")
    assert L.plans(changed, store).first().chunked is False
    L.analyse(changed, store, later, lambda digest, chunk: "plain answer " * 2_000)
    r = L.plans(changed, store).first()
    assert r.done == r.total and "[...trimmed for prompt budget...]" in r.analysis and len(r.context) < 20_000 + 60_000


def test_long_sources_of_an_empty_table(spark, tmp_path):
    store = Store(spark, str(tmp_path), L.SCHEMAS)
    empty = make(spark, [], "page_id string, content string, budget int")
    assert L.analyse(empty, store, store.claim(), _call()) == 0 and L.plans(empty, store).count() == 0
