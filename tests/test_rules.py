import pytest
from pyspark.sql import functions as F

from weft.functions import text as T
from weft.operators import rules


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_ordered_tokens(spark):
    got = lambda text: value(spark, rules.ordered_tokens(F.lit(text)))
    assert got("What is the Graph-Database of a graph?") == ["graph", "database", "graph?"]
    assert got("知识图谱的 数据") == ["知识", "识图", "图谱", "谱的", "知", "识", "图", "谱", "知识图谱的", "数据"]
    assert got("a 😀 b1 b1") == ["😀", "b1"]  # one character of two units counts
    assert got("the of") == [] and got("") == []
    assert {"the", "of", "的"} <= set(T.STOP_WORDS)


def test_lint_fixes():
    assert rules.link_target("wiki\\a//B.MD") == "a/B"
    assert rules.add_related("x [[Wiki/b.md|B]]", "B") == "x [[Wiki/b.md|B]]"
    assert rules.add_related("x\n\n", "b") == "x\n\n## Related\n- [[b]]\n"
    assert rules.add_related("x\n## related \n- [[a]]", "b") == "x\n## related \n- [[b]]\n- [[a]]"
    assert rules.retarget("[[B|x]] [[c]] [[wiki/b.md]]", "b", "wiki/new.md") == "[[new|x]] [[c]] [[new]]"
    assert rules.stub_path("wiki/Some Page!.md") == "queries/some-page.md" and rules.stub_path("A B/C.md") == "a-b/c.md" and rules.stub_path("") == "queries/missing-page.md"


def test_routing_and_summaries(spark):
    folders = {"entity": "wiki/entities", "concept": "wiki/concepts"}
    issue = lambda path, kind: value(spark, rules.routing_issue(F.lit(path), F.lit(kind), folders))
    assert issue("wiki/entities/a.md", "entity") is None and issue("wiki/entities/a.md", None) is None and issue("x.md", "thesis") is None
    assert issue("x.md", "entity") == 'Page type "entity" must be under "wiki/entities/". Current directory: "".'
    assert issue("wiki/concepts/a.md", "thesis").startswith('Pages under "wiki/concepts/"')
    page = "---\ntitle: \"T\"\ntags: [a, b]\n---\n# H\n| t |\n\nfirst " + "x" * 300
    got = value(spark, rules.entity_summary(F.lit("wiki/e/slug.md"), F.lit(page)))
    assert (got.slug, got.type, got.title, got.tags) == ("slug", "unknown", "T", ["a", "b"]) and len(got.description) == 200 and got.description.endswith("…")
    assert value(spark, rules.entity_summary(F.lit("a.md"), F.lit("no frontmatter"))) is None
    assert value(spark, rules.similarity_text(F.lit("a/b"), F.lit(""), F.array().cast("array<string>"), F.lit("body"))) == "b\nbody"


@pytest.mark.parametrize(("text", "target", "want"), [("这是一个很长的中文页面，用来检查目标语言是否正确。", "Japanese", True), ("これは日本語で書かれた長いページです、確認のため。", "English", False), ("short", "Chinese", True), ("هذه صفحة طويلة مكتوبة باللغة العربية للتحقق", "Arabic", True), ("هذه صفحة طويلة مكتوبة باللغة العربية للتحقق", "English", False), ("a plain English page with enough words", "German", True)])
def test_language_guard(spark, text, target, want):
    assert value(spark, rules.in_target_language(F.lit(f"---\na: b\n---\n{text}"), target)) is want


def test_unions_and_paths(spark):
    a = spark.createDataFrame([(0, "x"), (1, "y")], "pos int, url string")
    b = spark.createDataFrame([(0, "y"), (1, "z")], "pos int, url string")
    assert [r.url for r in rules.provider_union([a, b], 20).collect()] == ["x", "y", "z"]
    assert [r.url for r in rules.provider_union([b, a], 2).collect()] == ["y", "z"]
    files = spark.createDataFrame([("raw/b/F.md",), ("raw/a/f.md",)], "path string")
    links = spark.createDataFrame([("RAW\\b\\f.md",), ("f.md",), ("g.md",)], "link string")
    assert {r.link: r.path for r in rules.resolve_paths(links, files).collect()} == {"RAW\\b\\f.md": "raw/b/F.md", "f.md": "raw/a/f.md", "g.md": None}
    blocks = spark.createDataFrame([(0, "a"), (1, "b"), (2, "a")], "pos int, path string")
    assert [(r.pos, r.path) for r in rules.allowed_blocks(blocks, spark.createDataFrame([("a",)], "path string")).collect()] == [(0, "a")]


def test_components_are_those_of_union_find(spark):
    import random

    from weft.operators.components import connected_components

    rng = random.Random(1)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)]
    least = {}

    def root(x):
        while least.setdefault(x, x) != x:
            x = least[x]
        return x

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        least[y] = x
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {x: root(x) for x in got} and set(got) >= {x for pair in links if pair[0] != pair[1] for x in pair}
