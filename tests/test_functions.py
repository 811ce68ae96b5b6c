import random
import time

import pytest
from pyspark.sql import functions as F

from weft.functions import chunker, files, html, languages, parse
from weft.functions import measures as M
from weft.functions import text as T


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_tokenizer(spark):
    cases = {"the attention": ["attention"], "self-attention": ["attention", "self"], "?!": [], "What IS it": []}
    for query, want in cases.items():
        assert T.tokenize_query(query) == want
        assert value(spark, T.tokenize(F.lit(query))) == want
    assert len(T.tokenize_query("默会知识")) == 8 and value(spark, T.tokenize(F.lit("默会知识"))) == T.tokenize_query("默会知识")
    assert T.query_terms("?!") == ["?!"]


@pytest.mark.parametrize(("times", "want"), [(1, 316.0), (10, 456.0)])
def test_keyword_score(spark, times, want):
    body = "---\ntitle: Alpha\n---\n# Alpha\n" + "alpha " * times
    s = T.keyword_signals(F.lit("Alpha"), F.lit("alpha.md"), F.lit(body), "alpha")
    assert value(spark, s["score"]) == want


def test_page_fields(spark):
    page = "---\ntitle: \"A b\"\ntype: Entity\nsources: [x.pdf, 'y z.md']\ntags:\n  - one\n  - \"two\"\n---\n# Head\nsee [[One]] and [[ two |2]] ![i](a.png) ![j](a.png)"
    c = F.lit(page)
    assert value(spark, T.title(c, F.lit("f.md"))) == "A b" and value(spark, T.page_type(c)) == "entity"
    assert value(spark, T.list_field(c, "sources")) == ["x.pdf", "y z.md"] and value(spark, T.list_field(c, "tags")) == ["one", "two"]
    assert value(spark, T.wikilinks(c)) == ["One", "two"] and value(spark, T.image_refs(c)) == ["a.png"]
    assert value(spark, T.title(F.lit("text\ntitle: no\n# H 1"), F.lit("f.md"))) == "H 1"
    assert value(spark, T.title(F.lit("text"), F.lit("a-b_c.md"))) == "a b_c"
    assert value(spark, T.title(F.lit("text"), F.lit("a-b_c.md"), underscores=True)) == "a b c"


def test_snippets(spark):
    text = "x" * 100 + "\nneedle " + "y" * 100
    got = value(spark, T.snippet_around(F.lit(text), F.lit("NEEDLE")))
    assert got.startswith("...") and got.endswith("...") and " needle " in got and len(got) == 80 + 6 + 80 + 6
    assert value(spark, T.snippet_around(F.lit("short"), F.lit("none"))) == "short"
    assert value(spark, T.vector_snippet(F.lit("a\nb"), F.lit("H > I"))) == "H > I: a b" and value(spark, T.vector_snippet(F.lit("  "), F.lit("H"))) == ""


def test_similarity(spark):
    cases = {("transfomer", "transformer"): 1 - 1 / 11, ("a/b", "c/b"): 0.96, ("wiki/X.md", "x"): 1.0, ("long-name", "long-name-two"): 0.82, ("abcd", "abce"): 0.0, ("", "x"): 0.0}
    for (a, b), want in cases.items():
        assert value(spark, T.string_similarity(F.lit(a), F.lit(b))) == pytest.approx(want)
    assert sorted(value(spark, T.bigrams(F.lit("Abab")))) == ["ab", "ba"]


def test_predicates(spark):
    safe = {"wiki/a.md": True, "wiki/../a": False, "raw/a": False, "wiki/con.md": False, "wiki/a /b": False, "wiki/a:b": False, "wiki/x/": False, "wiki/con/x.md": False, "wiki/a.": False}
    for path, want in safe.items():
        assert value(spark, T.safe_wiki_path(F.lit(path))) is want, path
        assert parse._safe(path) is want, path
    for page, want in {"a b": True, "": False, "a/b": False, "a​b": False, "x" * 257: False, "it's": False}.items():
        assert value(spark, T.valid_page_id(F.lit(page))) is want
    assert value(spark, T.glob(F.lit("A/b.PDF"), "*.pdf")) and not value(spark, T.glob(F.lit("a.pdfx"), "*.pdf")) and value(spark, T.glob(F.lit("漢x"), "?x"))
    assert value(spark, T.sensitive_config(F.lit("a/config/x.json"))) and not value(spark, T.sensitive_config(F.lit("config.json")))
    w = lambda p, **k: value(spark, T.watched(F.lit(p), **k))
    assert w("raw/sources/a.pdf", include=["pdf"]) and not w("raw/sources/a.txt", include=["pdf"]) and w("wiki/a.txt", include=["pdf"])
    assert not w("x/node/a", folders=["node"]) and not w("a/.git/x") and not w("x/a.tmp", globs=["*.tmp"])


def test_measures(spark):
    assert [M.graph_quota(*x) for x in ((1, 0), (2, 0), (10, 0), (10, 10), (10, 100), (20, 0), (20, 10), (20, 20), (50, 0), (50, 50))] == [0, 1, 3, 2, 2, 6, 5, 3, 15, 8]
    assert [M.context_budget(n)["page"] for n in (8_000, 32_000, 128_000, 0, 1_000_000)] == [4_000, 5_000, 19_200, 30_720, 150_000]
    assert [M.search_mode(*x) for x in ((1, 0, 1), (1, 0, 0), (0, 1, 0), (1, 1, 0))] == ["hybrid", "keyword", "vector", "hybrid"]
    for scores, want in (((0.6, 0.5, 0.4), 0.87), ((0.9, 0.9), 1.0), ((0.5,), 0.5)):
        assert value(spark, M.blended(F.lit(max(scores)), F.lit(sum(scores)))) == pytest.approx(want)
    v = lambda *x: F.array(*map(F.lit, x))
    assert value(spark, M.cosine(v(1.0, 0.0), v(1.0, 1.0))) == pytest.approx(0.5**0.5) and value(spark, M.cosine(v(0.0), v(1.0))) == 0 and value(spark, M.cosine(v(1.0), v(1.0, 2.0))) == 0
    assert value(spark, M.distance_score(M.squared_distance(v(1.0, 2.0), v(1.0, 4.0)))) == 0.2


def test_review_ids(spark):
    for kind, title, want in (("missing-page", "Missing page: Attention", "review-dbdcf949"), ("duplicate", "注意力机制", "review-5dcb5ec8")):
        assert value(spark, M.review_id(F.lit(kind), F.lit(title))) == want
    assert M.fnv1a64(b"") == 0xCBF29CE484222325 and M.fnv1a64(b"a") == 0xAF63DC4C8601EC8C
    assert value(spark, T.review_title_key(F.lit("  Possible duplicate:  A   b "))) == "a b"


def test_languages(spark):
    cases = {"これは漢字です": "Japanese", "这是中文": "Chinese", "한국어입니다": "Korean", "это русский": "Russian", "der Hund und die Katze": "German", "le chat et la table": "French", "los perros del rey": "Spanish", "hello there": "English", "não é uma ação": "Portuguese", "سلام پدر": "Persian", "مرحبا بكم": "Arabic", "": "English"}
    for text, want in cases.items():
        assert value(spark, languages.detect(F.lit(text))) == want, text


def test_categories(spark):
    for path, want in {"a/b.MD": "markdown", "x.pdf": "pdf", "Dockerfile": "code", "a.b/c": "code", "a.b/cc": "unknown", "a\\b.Kt": "code", "x.rtf": "text", "x.xlsx": "document", "x.tar.jsonl": "data", "x.svg": "code", ".md": "markdown"}.items():
        assert value(spark, files.category(F.lit(path))) == want
    for path, want in {"a/b.MD": True, "a/.b.md": False, "raw/.cache/b.md": False, "b.py": False, "b.xls": True, "b": False, ".git/b.md": True}.items():
        assert value(spark, files.ingestable(F.lit(path))) is want
    assert [value(spark, files.code_language(F.lit(p))) for p in ("a.py", "a.yml", "a.lua", "x/B.TSX")] == ["python", "yaml", "lua", "typescript"]
    names = ["p10", "p2", "P1"]
    assert [r.v for r in spark.createDataFrame([(n,) for n in names], "v string").orderBy(files.natural_key(F.col("v"))).collect()] == ["P1", "p2", "p10"]


def test_chunks():
    fence = "```py\n" + "x = 1\n" * 400 + "```\n"
    rows = "| a | b |\n|---|---|\n" + "| 1 | 2 |\n" * 200
    text = "---\nt: 1\n---\nintro\n# One\n" + "Some sentence here. " * 200 + "\n\n## Two\n" + fence + "after\n" + rows + "# Three\nshort\n"
    got = chunker.chunk(text)
    assert got == chunker.chunk(text) and [c["index"] for c in got] == list(range(len(got)))
    assert all(text[c["char_start"] : c["char_end"]] == c["text"] for c in got)
    assert any(fence.strip() in c["text"] for c in got) and any(rows.strip() in c["text"] for c in got)
    assert {c["heading_path"] for c in got} == {"", "# One", "# One > ## Two", "# Three"}
    assert all(len(c["text"]) <= 1500 + 200 or c["oversized"] for c in got)
    covered = set().union(*(range(c["char_start"], c["char_end"]) for c in got))
    body = text.index("intro")
    left = [text[i] for i in range(body, len(text)) if i not in covered and not text[i].isspace()]
    assert "".join(left) == "#One##Two#Three"
    for blank in ("", " \n", "---\na: 1\n---\n", None):
        assert chunker.chunk(blank) == []
    assert len(chunker.chunk("x" * 5000, chunker.Options(100, 50, 10, 500))) >= 50


def test_chunk_property():
    rng = random.Random(1)
    for _ in range(150):
        text = "".join(rng.choice(["word ", "x. ", "\n", "\n\n", "# h\n", "```\n", "| a |\n", "漢字。", "y" * 90]) for _ in range(rng.randint(0, 80)))
        got = chunker.chunk(text, chunker.Options(60, 90, 20, 15))
        covered = set().union(*(range(c["char_start"], c["char_end"]) for c in got)) if got else set()
        for c in got:
            assert text[c["char_start"] : c["char_end"]] == c["text"] and c["text"].strip()
        lines, at = text.split("\n"), 0
        for line in lines:
            if line.strip() and not line.startswith("# "):
                assert all(i in covered for i in range(at, at + len(line)) if not text[i].isspace()), (text, line)
            at += len(line) + 1


def test_semantic_chunks_and_fold(spark):
    text = "\n\n".join(f"Paragraph {i}. " + "word " * 50 for i in range(40))
    got = chunker.semantic_chunks(text, 1000, 100)
    assert "".join(text[c["char_start"] : c["char_end"]] for c in got) == text and all(len(c["overlap_before"]) <= 100 for c in got)
    rows = spark.createDataFrame([("p", i, f"t{i}") for i in (2, 0, 1)], "page_id string, index int, text string")
    fold = lambda digest, t: digest + t
    assert chunker.fold_chunks(rows, fold).first().digest == "t0t1t2"
    state = spark.createDataFrame([("p", 2, "X")], "page_id string, done int, digest string")
    assert tuple(chunker.fold_chunks(rows, fold, state).first()) == ("p", 3, "Xt2")


def test_frontmatter():
    fields, body = parse.frontmatter("---\ntitle: X\nn: 3\nflag: true\ntags: [a, \"b, c\"]\nrelated: [[one]], [[two]]\n---\nbody")
    assert fields["title"] == "X" and fields["n"] == "3" and fields["flag"] == "true" and fields["tags"] == ["a", "b, c"] and fields["related"] == ["[[one]]", "[[two]]"] and body == "body"
    assert parse.frontmatter("text only") == ({}, "text only")
    assert parse.frontmatter("intro\n---\na: 1\n---\nrest")[0] == {"a": "1"}
    assert parse.frontmatter("```yaml\n---\na: 1\n---\nx\n```")[0] == {"a": "1"}
    assert parse.frontmatter(None) == ({}, "")
    assert parse.set_list("---\ntags:\n  - a\ntype: x\n---\nb", "tags", ["q", 'r"']) == '---\ntags: ["q", "r\\""]\ntype: x\n---\nb'
    assert parse.sanitize("```markdown\ntype: x\n---\nb\n```") == "---\ntype: x\n---\nb\n"


def test_blocks():
    text = "---FILE: wiki/a.md---\r\nA\r\n```\r\n---END FILE---\r\n```\r\n--- end file ---\r\n---FILE: ../b---\nB\n---END FILE---\n---FILE:---\nC\n---END FILE---\n---file: wiki/d.md--- \nD"
    assert [(b["path"], b["problem"]) for b in parse.file_blocks(text)] == [("wiki/a.md", None), ("../b", "unsafe"), ("", "empty-path"), ("wiki/d.md", "truncated")]
    assert parse.file_blocks(text)[0]["content"] == "A\n```\n---END FILE---\n```"
    review = parse.review_blocks("---REVIEW: missing-page | Title ---\nWhy.\nOPTIONS: Create | Skip\nPAGES: a.md, b.md\nSEARCH: q one | q two\n---END REVIEW---\n---REVIEW: odd | T2 ---\nx\n---END REVIEW---")
    assert review[0] == {"type": "missing-page", "title": "Title", "description": "Why.", "options": ["Create", "Skip"], "pages": ["a.md", "b.md"], "queries": ["q one", "q two"]}
    assert review[1]["type"] == "confirm" and review[1]["options"] == ["Approve", "Skip"]
    assert parse.lint_blocks("---LINT: stale | warning | Old ---\nd\nPAGES: a.md\n---END LINT---")[0]["pages"] == ["a.md"]
    assert parse.marked_section("x <digest> d </digest>", "digest") == "d"


def test_json():
    rng = random.Random(3)
    import json

    for _ in range(200):
        obj = {"k": rng.choice(["}", "{", '"', "\\", "a"]) * rng.randint(0, 3), "n": {"m": rng.randint(0, 9)}}
        raw = json.dumps(obj)
        assert parse.first_json(f"some prose {raw} and more }} text") == raw
    assert parse.first_json("none") is None and parse.first_json("{ open") is None
    groups = parse.detected_groups('x {"groups": [{"slugs": ["a", "b"], "confidence": "odd"}, {"slugs": ["a"]}, 3]}')
    assert groups == [{"slugs": ["a", "b"], "reason": "", "confidence": "low"}]
    assert parse.web_results({"web": {"results": [{"url": "u", "description": "d"}]}}, "s") == [{"title": "u", "url": "u", "snippet": "d", "source": "s"}]
    good = {"data": [{"index": 1, "embedding": [2]}, {"index": 0, "embedding": [1]}]}
    assert parse.embedding_response(good, 2) == [[1.0], [2.0]]
    for bad in ({"data": []}, {"data": [{"index": 0, "embedding": [1]}] * 2}, {"data": [{"index": 5, "embedding": [1]}, {"index": 0, "embedding": [1]}]}, {"data": [{"index": 0, "embedding": [1]}, {"index": 1, "embedding": [1, 2]}]}, {"data": [{"index": 0, "embedding": [float("nan")]}, {"index": 1, "embedding": [1]}]}):
        with pytest.raises(ValueError):
            parse.embedding_response(bad, 2)


def test_text_edits():
    assert parse.query_slug("Ｗhat  is 漢字?!") == "what-is-漢字"
    diff = parse.word_diff("a b c", "a x c")
    assert "".join(t for k, t in diff if k != "+") == "a b c" and "".join(t for k, t in diff if k != "-") == "a x c"
    assert parse.word_diff("a b", "c d", most_cells=1) == [("-", "a b"), ("+", "c d")]
    assert parse.locate_selection("x a  b y", "a b") == (2, 6) and parse.locate_selection("a a", "a") is None
    assert parse.enrich_links("---\nt: Cat\n---\nThe Cat and Cat [[Dog]]", [("Cat", "cat"), ("Dog", "Dog")]) == "---\nt: Cat\n---\nThe [[cat|Cat]] and Cat [[Dog]]"
    assert parse.strip_dead_links("[[gone page|G]] [[Gone-Page]] [[kept]]", ["wiki/gone-page.md"]) == "G Gone-Page [[kept]]"
    assert parse.to_commonmark("[[a b|c]] `[[x]]` ![[i.png]]") == "[c](a%20b.md) `[[x]]` ![i.png](i.png)"


def test_html(spark):
    page = "<html><head><title>T</title><script>x</script></head><body><nav><a href='/'>home</a></nav><div class='sidebar'>side</div><article><h1>Head</h1>" + "<p>A long paragraph, with commas, and <b>bold</b> and <a href='u'>link</a> text that goes on and on.</p>" * 5 + "<ul><li>one</li><li>two</li></ul><table><tr><th>a</th></tr><tr><td>1|2</td></tr></table><img src='s.png' width='10'><pre>code\n x</pre></article></body></html>"
    got = html.markdown(html.article(page))
    assert "**bold**" in got and "[link](u)" in got and "- one\n- two" in got and "| 1\\|2 |" in got and "```\ncode\n x\n```" in got
    assert "home" not in got and "side" not in got and "s.png" not in got
    began = time.time()
    deep = html.markdown(html.article("<p>" + "<b><i><a href='u'>" * 200 + "x"))
    assert "x" in deep and time.time() - began < 1
    nested = "".join(f"<table><tbody><tr><td>cell {i}, of some length | here</td><td>" for i in range(60)) + "inmost" + "</td></tr></tbody></table>" * 60
    began = time.time()
    for page in (nested, "<div>" + "".join(f"<div><p>Paragraph {i}, long enough to give points, with <a href='u'>a link</a>." for i in range(2000))):
        out = html.markdown(html.article(page))
        assert all(out.count(word) == 1 for word in (("inmost",) if page is nested else ("Paragraph 1999,",)))
    assert time.time() - began < 2
    shown = html.markdown(html.parse(nested))
    assert all(shown.count(f"cell {i},") == 1 for i in range(60)) and len(shown) < 2 * len(nested) and shown.count("\\|") == 60
    for text in ("", "  a, b ", " <a href='#x'> c ,d </a> <p> </p>", "<a href='u'>  all </a> "):
        root = html.parse(f"<div>{text}</div>")
        whole, links = root.text().strip(), [n for n in root.walk() if n.tag == "a"]
        share = sum(len(n.text().strip()) * (0.3 if n.attrs["href"].startswith("#") else 1) for n in links)
        m = html._measured(root)[id(root)]
        assert (m.stripped, m.linked) == (len(whole), share)
    assert html.markdown(html.article("")) == "" and html.markdown(html.article("plain")) == "plain"
    assert value(spark, html.fallback_text(F.lit("<p>a &amp; b</p><style>x</style><br> c"))) == "a & b\nc"
    assert value(spark, html.truncated(F.lit("abc"), 2)).startswith("ab\n") and value(spark, html.readable(F.lit("<p>x</p>"))) == "x"


def test_review_ids_see_whole_passages(spark, tmp_path):
    from weft.plans import corpus_queries

    same = "The same forty characters and more of a passage, then "
    spark.createDataFrame([(1, same + "one end"), (2, same + "another end")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    ids = {r.item_id: r.review_id for r in corpus_queries.review_ids(spark, str(tmp_path)).collect()}
    assert ids.keys() == {1, 2} and ids[1] != ids[2]
    h = 0x811C9DC5
    for c in ("missing-page::" + same + "one end").lower():
        h = (h ^ ord(c)) * 0x01000193 % 2**32
    assert ids[1] == f"review-{h:08x}"
