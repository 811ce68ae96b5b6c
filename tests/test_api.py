import hashlib

import pytest
from pyspark.sql import functions as F

from weft.api import Project
from weft.operators import lifecycle as L


@pytest.fixture(scope="module")
def project(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("p")
    embedder = lambda texts: [[float(t.lower().count("cat")) + 0.1, float(t.lower().count("dog")) + 0.1] for t in texts]
    for name, text in {"a.md": "---\ntitle: Cats\ntype: concept\nsources: [s.pdf]\n---\nAll about the cat. [[b]] [[gone]]", "b.md": "# Dogs\nAll about the dog, the \"s.pdf\" says.", "c.md": "# Cat two\ncat cat cat cat", "x/d.md": "# Deep\nSee [[a]] and [[x/d]]"}.items():
        p = folder / "wiki" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    return Project(spark, str(folder / "wiki"), store=f"file://{folder}/v", embedder=embedder)


def test_search_and_reindex(project):
    assert project.reindex() == {"chunks": 4, "failed": 0}
    got = [r.path for r in project.search("cat", 3).collect()]
    assert set(got[:2]) == {"a.md", "c.md"} and len(got) == 3
    assert project.search("dog", 2, include_content=True, query_embedding=[0.1, 1.1]).first().content.startswith("# Dogs")
    with pytest.raises(ValueError):
        project.search("x", query_embedding=[float("nan")])
    assert {r.cluster for r in project.duplicates(0.99).where("page_id in ('a', 'c')").collect()} and project.duplicates(0.99).count() >= 2


def test_links_graph_lint(project):
    out, back, missing = (sorted(map(tuple, x.collect())) for x in project.page_links())
    assert out == [("a.md", "b.md"), ("x/d.md", "a.md")] and back == [("a.md", "x/d.md"), ("b.md", "a.md")] and missing == [("a.md", "gone")]
    nodes, edges = project.graph("", None)
    assert nodes.count() == 4 and edges.count() == 2
    found = {(r.type, r.page) for r in project.lint().collect()}
    assert ("broken-link", "a.md") in found and ("orphan", "c.md") in found and ("no-outlinks", "b.md") in found


def test_files(project, spark):
    assert project.files().where("not is_dir").count() == 4
    old = spark.createDataFrame([("a.md", "x", 1), ("z.md", "y", 2)], "path string, hash string, size long")
    assert {(r.path, r.kind) for r in project.rescan(old).collect()} >= {("a.md", "Modified"), ("z.md", "Deleted"), ("b.md", "Created")}
    assert sorted(r.path for r in project.related_pages("in/s.pdf").collect()) == ["a.md", "b.md"]
    assert {r.type: r.entries for r in project.rebuild_index().collect()} == {"concept": 1, "other": 3}


def test_lifecycle(spark):
    make = spark.createDataFrame
    got = {r.name: r.path for r in L.destination_names(make([("a.md",), ("b.md",)], "name string"), make([("a.md",), ("a-D.md",)], "path string"), "D", 7).collect()}
    assert got == {"a.md": "a-D-2.md", "b.md": "b.md"}
    drafts = {r.id: (r.title, r.type, r.path) for r in L.page_drafts(make([("1", "missing-page", "Missing page: Big Idea"), ("2", "contradiction", "What?"), ("3", "suggestion", "Compare A and B")], "id string, type string, title string")).collect()}
    assert drafts == {"1": ("Big Idea", "concept", "wiki/concepts/big-idea.md"), "2": ("What?", "query", "wiki/queries/what.md"), "3": ("Compare A and B", "comparison", "wiki/comparisons/compare-a-and-b.md")}
    edits = make([("p", "a", "b", "c", "X"), ("q", "a", "b", "c", "X")], "path string, prefix string, selection string, suffix string, replacement string")
    assert {r.path: (r.content, r.applied) for r in L.guarded_edits(make([("p", "abc"), ("q", "abd")], "path string, content string"), edits).collect()} == {"p": ("aXc", True), "q": ("abd", False)}
    pages = make([("a", ["d/x.pdf"]), ("b", ["X.pdf", "y"]), ("c", ["e/x.pdf"])], "path string, sources array<string>")
    assert {r.path: r.decision for r in L.cascade_delete(pages, "d/x.pdf").collect()} == {"a": "delete", "b": "keep", "c": "skip"}
    refs = make([(0, "page", "a", "A", "s  t"), (1, "page", "a", "A", ""), (2, "web", "a", "B", "")], "pos int, kind string, path string, title string, snippet string")
    assert L.distinct_references(refs).count() == 2 and L.distinct_evidence(refs).first().evidence == 2
    assert L.answer_from_references(refs, 1).first().answer == "- **A** (a): s t"
    links = make([("a", "b"), ("a", "c"), ("b", "a"), ("a", "b")], "src string, dst string")
    ctx = {r.id: (r.outgoing, r.backlinks, r.link_count) for r in L.knowledge_context(make([("a",), ("z",)], "id string"), links, 1).collect()}
    assert ctx == {"a": (["b"], ["b"], 3), "z": ([], [], 0)}
    totals = L.change_totals(make([(1, "b", 1, 0, "t"), (0, "a", 2, 1, "t"), (2, "b", 3, 4, "u")], "pos int, path string, added int, removed int, tool string")).collect()
    assert [(r.path, r.added, r.removed, r.tools) for r in totals] == [("a", 2, 1, ["t"]), ("b", 4, 4, ["t", "u"])]
    images = make([(10, "x"), (2, "z"), (2, "y"), (None, "w")], "page int, path string")
    assert [(r.page, r.paths) for r in L.image_groups(images).collect()] == [("Page 2", ["y", "z"]), ("Page 10", ["x"]), ("Document", ["w"])]
    results = make([(1, "p", [("u", "one"), ("v", "a cat")]), (2, "q", [("u", "cat")])], "rank int, path string, images array<struct<url: string, alt: string>>")
    assert [(r.url, r.path) for r in L.distinct_images(results, "cat").collect()] == [("v", "p"), ("u", "p")]
    assert L.dismissed(make([(2, 1), (3, 4)], "src long, dst long"), make([("1:::2",)], "key string")).count() == 1
    assert [tuple(r) for r in L.image_sources(make([("wiki/media/my-doc/1.png",)], "path string"), make([("raw/My Doc.pdf",)], "path string")).collect()] == [("wiki/media/my-doc/1.png", "raw/My Doc.pdf")]
    one = spark.range(1)
    s, u = L.fit_context(F.lit("s" * 9000), F.lit("u" * 100), 1)
    assert one.select(F.char_length(s), F.char_length(u)).first()[:] == (7900, 100)
    assert one.select(L.caption_context(F.lit("a" * 200 + "IMG" + "b" * 200), F.lit("IMG"), 5)).first()[0] == "aaaaaIMGbbbbb"
    assert L.whitelist_insert(make([("a|b",)], "key string"), make([(["B", "a"],), (["c", "d"],)], "ids array<string>")).count() == 2
    assert hashlib.md5(b"").hexdigest() == one.select(F.md5(F.lit(""))).first()[0]
