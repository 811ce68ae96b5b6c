"""The rules for texts of pages on cases that tables don't hold."""

from pyspark.sql import functions as F

from weft.functions import measures as M
from weft.functions import page_rules as R


def results(spark, schema, rows, *columns):
    return [r[0] if len(columns) == 1 else tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_formulas(spark):
    rows = [(r"a $\alpha$ b $$x \leq y$$ $f \rightarrow \pi$ $5 $\nope$",), (r"$\text$ $\frac a\sqrt b$",), ("$a",), ("",), (None,)]
    assert results(spark, "t string", rows, R.formulas_as_text(F.col("t"))) == ["a α b \nx \\leq y\n f → π $5 \\nope", " / a√ b", "$a", "", None]


def test_messages(spark):
    rows = [("Hello!! ",), ("  你好啊。",), ("hello world",), ("What's up?",), ("good morning " + "x" * 20,), ("",), (None,)]
    assert results(spark, "t string", rows, R.greeting(F.col("t"))) == [True, True, False, True, False, False, False]
    rows = [("Write to wiki: the graph",), ("a GRAPH online",), ("最新",), ("the source file today",), ("ok",), ("ok " * 20,), ("why",), (None,)]
    assert results(spark, "t string", rows, R.intent(F.col("t"))) == ["write", "graph", "external", "raw_source", "chat", "ambiguous", "ambiguous", "ambiguous"]


def test_image_addresses(spark):
    cases = [
        ("../assets/i.png", "/p", "raw/sources", "/p/raw/assets/i.png"), ("media/%E6%98%93.png", "/p", "wiki/x", "/p/wiki/media/易.png"), ("../media/a.png", "/p", None, "/p/wiki/media/a.png"),
        ("a.png", "/p/", "/p/wiki/b/", "/p/wiki/b/a.png"), ("../../../etc", "/p", "wiki", "../../../etc"), ("/p/x/../y.png", "/p/", None, "/p/y.png"), ("/pq/y.png", "/p", None, "/pq/y.png"),
        ("HTTP://a/b", "/p", None, "HTTP://a/b"), ("C:\\P\\a.png", "c:/p", None, "C:/P/a.png"), ("a%zz+b.png", "/p", "", "/p/wiki/a%zz+b.png"), ("x", None, None, "x"), ("", "/p", None, ""), (None, "/p", None, None),
    ]
    found = results(spark, "s string, p string, f string", [c[:3] for c in cases], R.image_address(F.col("s"), F.col("p"), F.col("f")))
    assert found == [c[3] for c in cases]


def test_dates(spark):
    day = F.lit("2024-01-02")
    pages = ["---\ntitle: a\ncreated: 2020\n---\nbody\ncreated: 1", "---\r\nUpdated : x\r\n---\r\nb", "---\nrecreated: 1\n---", "no", "", None]
    want = ["---\ntitle: a\ncreated: 2024-01-02\nupdated: 2024-01-02\n---\nbody\ncreated: 1", "---\r\nUpdated : 2024-01-02\ncreated: 2024-01-02\r\n---\r\nb", "---\nrecreated: 1\ncreated: 2024-01-02\nupdated: 2024-01-02\n---", "no", "", None]
    assert results(spark, "t string", [(p,) for p in pages], R.stamped(F.col("t"), day)) == want
    logs = ["# Log\n\n## [YYYY-MM-DD] a\n## [2020-01-01] b", "## 2020-01-01 x\n## 2020-01-02", "text ## 2020-01-01", None]
    assert results(spark, "t string", [(p,) for p in logs], R.stamped_log(F.col("t"), day)) == ["# Log\n\n## [2024-01-02] a\n## [2020-01-01] b", "## 2024-01-02 x\n## 2020-01-02", "text ## 2020-01-01", None]
    long = "---\n" + "key: value\n" * 20_000 + "---\n" + "text " * 200_000
    assert len(results(spark, "t string", [(long,)], R.stamped(F.col("t"), day))[0]) == len(long) + len("\ncreated: 2024-01-02\nupdated: 2024-01-02")


def test_sources(spark):
    rows = [(["raw/sources/A.pdf", "a.pdf", "/x", "..\\b", "wiki/index.md", ".llm-wiki/x", "p/raw/sources/c.md", "C.md", "./d", ""], "A.pdf"), (None, "q/z.md"), (["z.md"], "q/Z.md"), (["x", "y"], "Y")]
    assert results(spark, "s array<string>, o string", rows, R.canonical_sources(F.col("s"), F.col("o"))) == [["A.pdf", "c.md", "./d"], ["q/z.md"], ["q/Z.md"], ["x", "Y"]]
    rows = [("---\nsources:\n  - a.md\n  - b.md\ntitle: t\n---\nbody\nsources: x", "a.md"), ("---\ntitle: t\n---\nsources: y", 'a$1\\"b'), ("none", "a"), (None, "a")]
    assert results(spark, "t string, o string", rows, R.page_with_sources(F.col("t"), F.col("o"))) == ['---\nsources: ["a.md", "b.md"]\ntitle: t\n---\nbody\nsources: x', '---\ntitle: t\nsources: ["a$1\\\\\\"b"]\n---\nsources: y', "none", None]


def test_reasoning(spark):
    lines = [
        ('data: {"choices":[{"delta":{"reasoning_content":"a\\"b😀","content":"x"}},{"delta":{"reasoning":"c"}}]}', 7, ['a"b😀', "c"]),
        ('data: {"delta":{"type":"thinking_delta","thinking":"t"}}', 0, ["t"]), ('data: {"delta":{"type":"text_delta","text":"t"}}', 0, []),
        ('data: {"candidates":[{"content":{"parts":[{"text":"p","thought":true},{"text":"q"}]}},{}]}', 0, ["p"]),
        ('"reasoning": "seen"', 4, []), ("data: [DONE]", 0, []), ("data: {broken", 0, []), ("", 0, []), (None, None, []), ('data: {"reasoning":"' + '\\"' * 100_000 + '"}', 200_000, []),
    ]
    assert results(spark, "t string", [(x[0],) for x in lines], R.reasoning_units(F.col("t")), R.reasoning_texts(F.col("t"))) == [x[1:] for x in lines]


def test_reviews_and_names(spark):
    rows = [('{"type":"a","title":"T","x":1,"description":5,"options":[{"label":"l","z":1},3,{}],"affectedPages":["p",2],"searchQueries":"q","resolved":true,"createdAt":5,"id":"i"}',), ('{"id":"i","resolved":"no","createdAt":true}',), ("[1]",), ("x",), (None,)]
    got = results(spark, "t string", rows, R.review_fields(F.col("t")))
    assert got[0]["item"] == '{"affectedPages":["p"],"createdAt":5.0,"id":"i","options":[{"label":"l"}],"resolved":true,"title":"T","type":"a"}' and got[0]["id"].startswith("review-")
    assert [tuple(r) for r in got[1:]] == [("i", '{"id":"i"}'), (None, None), (None, None), (None, None)]
    moment = F.lit("2026-04-23 14:30:52").cast("timestamp")
    names = results(spark, "t string", [("Ünï  ﬁ — x!",), ("-a--b-",), ("x" * 60,), ("!!",), (None,)], R.answer_file(F.col("t"), moment))
    assert names == [f"{slug}-2026-04-23-143052.md" for slug in ("ünï-fi-x", "a-b", "x" * 50, "query", "query")]


def test_measures(spark):
    n = F.col("n")
    assert results(spark, "n long", [(0,), (204_800,), (1_000_000,), (8_000,), (None,)], M.ingest_budget(n, F.lit(0)), M.generation_tokens(n), M.review_tokens(n)) == [(122_880, 16_384, 8_192), (122_880, 16_384, 8_192), (300_000, 32_768, 8_192), (8_000, 8_192, 4_096), (122_880, 16_384, 8_192)]
    assert results(spark, "n long", [(100,), (600,), (5_000,)], F.round(M.node_size(F.lit(4), F.lit(16), n), 6), M.weak_edge(n), M.label_size(n), M.label_density(n)) == [(18.0, 0.0, 6, 0.4), (9.0, 0.0, 6, 0.4), (6.3, 0.16, 18, 0.08)]
    assert results(spark, "n long", [(5,)], M.node_size(F.lit(0), F.lit(0), n)) == [8.0]
