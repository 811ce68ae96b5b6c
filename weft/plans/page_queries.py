"""Queries of page, text, review, queue and merge rules, on pages made from the tables, with SQL that spells their results out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions import html, parse
from weft.functions import measures as M
from weft.functions import text as T
from weft.functions.rowwise import rowwise
from weft.operators import changes as C
from weft.operators import dedup as D
from weft.operators import lifecycle as L
from weft.operators import pages as P
from weft.operators import reviews as R
from weft.operators import rules
from weft.session import table

QUERIES: dict = {}


def query(sql: str | None):
    """Registers a query under its name, with its SQL."""
    return lambda fn: QUERIES.setdefault(fn.__name__, (fn, sql))


def said(*parts) -> Column:
    """Parts side by side; strings stand for themselves, columns for their values as text."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("id"), F.col("p_name").alias("name"), F.col("p_size").cast("int").alias("size"))


PARTS = "WITH w AS (SELECT p_partkey::BIGINT AS id, p_name AS name, p_size::INT AS size FROM part) "


# ---- frontmatter and text


@query(PARTS + """SELECT id, CASE size % 3 WHEN 0 THEN 'concept' WHEN 1 THEN 'source' ELSE 'other' END AS type, CASE WHEN id % 2 = 0 THEN 'T ' || name ELSE 'Head ' || id END AS title, '# Head ' || id || ' text ' || id AS body FROM w""")
def page_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Type, title and body of pages: from the frontmatter, else the heading."""
    kind = F.when(F.col("size") % 3 == 0, "type: Concept\n").when(F.col("size") % 3 == 1, 'type: "source"\n').otherwise("")
    title = F.when(F.col("id") % 2 == 0, said('title: "T ', F.col("name"), '"\n')).otherwise("")
    page = parts(spark, sf_dir).withColumn("page", said("---\n", kind, title, "tags: [a]\n---\n\n# Head ", F.col("id"), "\ntext ", F.col("id"), "\n"))
    return page.select("id", T.page_type(F.col("page")).alias("type"), T.title(F.col("page"), F.lit("x.md")).alias("title"), T.collapse(T.strip_frontmatter(F.col("page"))).alias("body"))


@query(PARTS + "SELECT id, 'a' || id || '.pdf|b c.md' AS sources, 2 AS n FROM w")
def page_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of the frontmatter in block and inline form."""
    block = said("sources:\n  - a", F.col("id"), '.pdf\n  - "b c.md"\n')
    inline = said('sources: ["a', F.col("id"), ".pdf\", 'b c.md']\n")
    page = parts(spark, sf_dir).withColumn("page", said("---\ntype: x\n", F.when(F.col("id") % 2 == 0, block).otherwise(inline), "---\nbody"))
    return page.select("id", F.array_join(T.list_field(F.col("page"), "sources"), "|").alias("sources"), F.size(T.list_field(F.col("page"), "sources")).alias("n"))


@query(PARTS + "SELECT id, 0 AS pos, 'P' || id % 7 AS target FROM w UNION ALL SELECT id, 1, 'Q ' || name FROM w UNION ALL SELECT id, 2, 'P1' FROM w")
def wikilinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = said("See [[ P", F.col("id") % 7, " ]] and [[Q ", F.col("name"), "|alias]], then [[P1]].")
    return parts(spark, sf_dir).select("id", F.posexplode(T.wikilinks(page)).alias("pos", "target"))


@query(PARTS + "SELECT id, 'u1.png|u' || id || '.png' AS images FROM w WHERE id <> 1 UNION ALL SELECT id, 'u1.png' FROM w WHERE id = 1")
def image_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = said("![a](u1.png) text ![b](u", F.col("id"), ".png) ![c d](u1.png)")
    return parts(spark, sf_dir).select("id", F.array_join(T.image_refs(page), "|").alias("images"))


@query(PARTS + "SELECT id, 'my-page-' || id AS alias, 'sub/page ' || id AS target, 'myfile' || id || 'x' AS reference FROM w")
def link_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How links are compared in retrieval, in linting, and as references."""
    i = F.col("id")
    return parts(spark, sf_dir).select("id", T.alias_key(said("My  Page ", i, ".md#Some Part")).alias("alias"), T.target_key(said("wiki\\Sub/Page ", i, ".MD")).alias("target"), T.reference_key(said("raw/My-File_", i, " x.md")).alias("reference"))


@query(PARTS + "SELECT id, 'raw/a/' || id || '.tar.gz' AS path, id || '.tar.gz' AS name, id || '.tar' AS stem, 'raw > a' AS folders FROM w")
def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = T.normalize_path(said("raw\\a//", F.col("id"), ".tar.gz/"))
    return parts(spark, sf_dir).select("id", p.alias("path")).select("id", "path", T.file_name(F.col("path")).alias("name"), T.file_stem(F.col("path")).alias("stem"), T.folder_context(F.col("path")).alias("folders"))


@query(PARTS + """SELECT id, 'a b' || id || ' c' AS plain, '&lt;a b=&quot;' || id || '&quot;&gt; &amp; &apos;' AS xml, 'word' || id AS bare, 2 + id % 2 AS times FROM w""")
def text_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blanks collapsed, XML escaped, separators trimmed, a needle counted without overlap."""
    i = F.col("id")
    times = T.count_occurrences(said("aaaa b", F.when(i % 2 == 1, "aa").otherwise("a")), "aa")
    return parts(spark, sf_dir).select("id", T.collapse(said("  a \n\t b", i, "  c ")).alias("plain"), T.xml_escape(said('<a b="', i, "\"> & '")).alias("xml"), T.trim_punctuation(said(",(word", i, "?)")).alias("bare"), times.cast("long").alias("times"))


@query(PARTS + "SELECT id, 'the name ' || id AS key FROM w")
def review_title_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    prefix = F.element_at(F.array(*map(F.lit, ("Missing page: ", "missing-page:", "Possible duplicate： ", "Duplicate Page:", "缺失页面：", " "))), (F.col("id") % 6 + 1).cast("int"))
    return parts(spark, sf_dir).select("id", T.review_title_key(said(prefix, " The \t Name ", F.col("id"))).alias("key"))


@query(PARTS + "SELECT id, id % 8 IN (0, 5) AS safe, id % 4 = 0 AS valid, id % 3 = 0 AS sensitive FROM w")
def path_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated paths, page ids and configuration files that are let through or not."""
    pick = lambda *c: F.element_at(F.array(*[x if isinstance(x, Column) else F.lit(x) for x in c]), (F.col("id") % len(c) + 1).cast("int"))
    path = pick("wiki/a.md", "wiki/../a.md", "raw/a.md", "wiki/con.md", "wiki/a /b.md", "wiki/x/y.md", "wiki/x/", "wiki/a:b.md")
    page_id = pick(said("page ", F.col("id")), "a/b", "", F.repeat(F.lit("x"), 257))
    return parts(spark, sf_dir).select("id", T.safe_wiki_path(path).alias("safe"), T.valid_page_id(page_id).alias("valid"), T.sensitive_config(pick("config/app.json", "src/app.json", "config/readme.md")).alias("sensitive"))


@query("""WITH t AS (SELECT item_id, list_filter(string_split_regex(lower(text), '[\\s,，。！？、；：""''（）()\\-_/\\\\·~～…]+'), lambda x: length(x) > 1 AND NOT list_contains(['的', '是', '了', '什么', '在', '有', '和', '与', '对', '从',
    'the', 'is', 'a', 'an', 'what', 'how', 'are', 'was', 'were', 'do', 'does', 'did', 'be', 'been', 'being', 'have', 'has', 'had', 'it', 'its', 'in', 'on', 'at', 'to', 'for', 'of', 'with', 'by', 'this', 'that', 'these', 'those'], x)) AS l FROM benchmark),
p AS (SELECT item_id, unnest(l) AS token, unnest(range(len(l))) AS i FROM t), f AS (SELECT item_id, token, min(i) AS i FROM p GROUP BY 1, 2) SELECT item_id, string_agg(token, ' ' ORDER BY i) AS tokens FROM f GROUP BY 1""")
def tokens_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct tokens of the passages in the order of first sight."""
    found = table(spark, sf_dir, "benchmark").select("item_id", F.array_join(rules.ordered_tokens(F.col("text")), " ").alias("tokens"))
    return found.where("tokens <> ''")


@query(PARTS + "SELECT id, id || chr(10) || name || chr(10) || CASE WHEN id % 2 = 0 THEN 'a b' || chr(10) ELSE '' END || substr(repeat('body ', 400), 1, 1500) AS text FROM w")
def similarity_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = F.when(F.col("id") % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>"))
    return parts(spark, sf_dir).select("id", rules.similarity_text(said("entities/", F.col("id")), F.col("name"), tags, F.repeat(F.lit("body "), 400)).alias("text"))


@query(PARTS + """SELECT id, 'p' || id AS slug, 'entity' AS type, CASE WHEN id % 2 = 0 THEN name ELSE 'p' || id END AS title,
    CASE WHEN id % 3 = 0 THEN 'own ' || id WHEN id % 3 = 1 THEN 'first line ' || id ELSE substr(repeat('long ', 60), 1, 199) || '…' END AS description FROM w""")
def entity_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("id")
    head = said("---\ntype: entity\n", F.when(i % 2 == 0, said("title: ", F.col("name"), "\n")).otherwise(""), F.when(i % 3 == 0, said("description: own ", i, "\n")).otherwise(""), "---\n")
    body = F.when(i % 3 == 2, said("| a | b |\n", F.repeat(F.lit("long "), 60))).otherwise(said("# H\n\n## I\n  first line ", i, "\nmore"))
    s = rules.entity_summary(said("wiki/entities/p", i, ".md"), said(head, body))
    return parts(spark, sf_dir).select("id", s.alias("s")).select("id", "s.slug", "s.type", "s.title", "s.description")


@query(PARTS + """SELECT id, CASE id % 4 WHEN 1 THEN 'Page type "entity" must be under "wiki/entities/". Current directory: "wiki/concepts".'
    WHEN 2 THEN 'Pages under "wiki/concepts/" must use type "concept", but found "thesis".' END AS issue FROM w""")
def routing_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose type and folder disagree, one way or the other."""
    kind = F.element_at(F.array(*map(F.lit, ("entity", "entity", "thesis", ""))), (F.col("id") % 4 + 1).cast("int"))
    path = F.when(F.col("id") % 4 == 0, said("wiki/entities/", F.col("id"), ".md")).otherwise(said("wiki/concepts/", F.col("id"), ".md"))
    return parts(spark, sf_dir).select("id", rules.routing_issue(path, kind, {"entity": "wiki/entities", "concept": "wiki/concepts"}).alias("issue"))


@query(PARTS + "SELECT id, id % 5 <> 1 AS english, id % 5 IN (1, 4) AS chinese FROM w")
def language_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether pages are written in the target's family of languages."""
    text = F.element_at(F.array(*[F.lit(x) for x in ("The cat sat on the mat and looked at the dog.", "这是一个很长的中文页面，用来检查目标语言是否正确，没有别的意思。", "le chat est sur la table avec le chien de la maison", "the code ```这是中文这是中文``` is left out of what is looked at", "short")]), (F.col("id") % 5 + 1).cast("int"))
    page = said("---\ntype: x\n---\n", text)
    return parts(spark, sf_dir).select("id", rules.in_target_language(page, "English").alias("english"), rules.in_target_language(page, "Chinese").alias("chinese"))


@query(PARTS + """SELECT id, CASE id % 3 WHEN 0 THEN 'has [[wiki/Old Page.md|x]] ' || id WHEN 1 THEN 'a' || chr(10) || '## Related' || chr(10) || '- [[Old Page]]' || chr(10) || '- [[b]] ' || id
    ELSE 'text ' || id || chr(10) || chr(10) || '## Related' || chr(10) || '- [[Old Page]]' || chr(10) END AS added, CASE id % 3 WHEN 0 THEN 'has [[new|x]] ' || id ELSE kept END AS led, 'sub-' || id % 3 || '/broken-name.md' AS stub
FROM (SELECT id, CASE id % 3 WHEN 1 THEN 'a' || chr(10) || '## Related' || chr(10) || '- [[b]] ' || id ELSE 'text ' || id || '  ' || chr(10) END AS kept FROM w)""")
def lint_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A related link added, a broken target replaced, and the path of a stub."""
    i = F.col("id")
    page = F.when(i % 3 == 0, said("has [[wiki/Old Page.md|x]] ", i)).when(i % 3 == 1, said("a\n## Related\n- [[b]] ", i)).otherwise(said("text ", i, "  \n"))
    rows = parts(spark, sf_dir).select("id", page.alias("page"))
    add, lead, stub = rowwise(lambda t: rules.add_related(t, "Old Page.md"), "string"), rowwise(lambda t: rules.retarget(t, "old page", "wiki/new.md"), "string"), rowwise(rules.stub_path, "string")
    return rows.select("id", add(F.col("page")).alias("added"), lead(F.col("page")).alias("led"), stub(said("wiki/Sub ", i % 3, "/Broken  Name!.md")).alias("stub"))


# ---- blocks and answers


@query(PARTS + """SELECT id, '{"id": ' || id || ', "s": "}{\\"", "o": {}}' AS object FROM w""")
def first_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first balanced object of answers with noise around it."""
    return parts(spark, sf_dir).select("id", parse.first_json_column(said('Answer {: ```json\n{"id": ', F.col("id"), ', "s": "}{\\"", "o": {}}\n``` tail {"x": 1}')).alias("object"))


@query(PARTS + "SELECT id, 'a' || id || '|b' AS slugs, CASE WHEN id % 2 = 0 THEN 'same' ELSE '' END AS reason, CASE WHEN id % 3 = 0 THEN 'high' ELSE 'low' END AS confidence FROM w")
def detected_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of a duplicate detector's answers; groups of one are none."""
    i = F.col("id")
    answer = said('Sure: {"groups": [{"slugs": ["a', i, '", "b", "b"]', F.when(i % 2 == 0, ', "reason": "same"').otherwise(""), F.when(i % 3 == 0, ', "confidence": "high"').otherwise(', "confidence": "odd"'), '}, {"slugs": ["one"]}]}')
    groups = rowwise(parse.detected_groups, "array<struct<slugs: array<string>, reason: string, confidence: string>>")
    return parts(spark, sf_dir).select("id", F.explode(groups(answer)).alias("g")).select("id", F.array_join("g.slugs", "|").alias("slugs"), "g.reason", "g.confidence")


@query(PARTS + "SELECT id, CASE WHEN id % 4 = 3 THEN 'u' || id ELSE 'T' || id END AS title, 'u' || id AS url, 's' AS snippet, 'web' AS source FROM w")
def search_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of search services of several shapes; those without an address are left out."""
    import json

    i = F.col("id")
    row = said('{"title": "T', i, '", "url": "u', i, '", "content": " s "}')
    answer = F.when(i % 4 == 0, said('{"results": [', row, ', {"title": "no address"}]}')).when(i % 4 == 1, said('{"web": {"results": [', row, "]}}")).when(i % 4 == 2, said('{"webPages": {"value": [{"name": "T', i, '", "link": "u', i, '", "snippet": "s"}]}}')).otherwise(said('{"data": [{"url": "u', i, '", "description": "s"}]}'))
    results = rowwise(lambda t: parse.web_results(json.loads(t), "web"), "array<struct<title: string, url: string, snippet: string, source: string>>")
    return parts(spark, sf_dir).select("id", F.explode(results(answer)).alias("r")).select("id", "r.*")


@query(PARTS + "SELECT id, 2 AS n, id::DOUBLE AS first, 0.5::DOUBLE AS second FROM w")
def embedding_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of an embedding service, in the order of their texts."""
    import json

    vectors = rowwise(lambda t: parse.embedding_response(json.loads(t), 2), "array<array<double>>")
    answer = said('{"data": [{"index": 1, "embedding": [0.5]}, {"index": 0, "embedding": [', F.col("id"), "]}]}")
    return parts(spark, sf_dir).select("id", vectors(answer).alias("v")).select("id", F.size("v").alias("n"), F.col("v")[0][0].alias("first"), F.col("v")[1][0].alias("second"))


@query(PARTS + """SELECT id, CASE WHEN id % 2 = 0 THEN 'missing-page' ELSE 'confirm' END AS type, 'Title ' || id AS title, 'Some text ' || id AS description, CASE WHEN id % 3 = 0 THEN 'Yes|No' ELSE 'Approve|Skip' END AS options, 'a.md|b.md' AS pages, 'q1|q2' AS queries FROM w""")
def review_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("id")
    text = said("x\r\n---REVIEW: ", F.when(i % 2 == 0, "Missing-Page").otherwise("odd"), " | Title ", i, " ---\nSome text ", i, "\n", F.when(i % 3 == 0, "OPTIONS: Yes | No\n").otherwise(""), "PAGES: a.md, b.md\nSEARCH: q1 | q2\n---END REVIEW---\n")
    join = lambda c: F.array_join(f"b.{c}", "|").alias(c)
    return parts(spark, sf_dir).select("id", F.explode(parse.review_blocks_column(text)).alias("b")).select("id", "b.type", "b.title", "b.description", join("options"), join("pages"), join("queries"))


@query(PARTS + "SELECT id, 'stale' AS type, 'warning' AS severity, 'Old ' || id AS title, 'what is wrong' AS detail, CASE WHEN id % 2 = 0 THEN 'a.md|b.md' ELSE '' END AS pages FROM w")
def lint_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("id")
    text = said("---LINT: stale | warning | Old ", i, " ---\nwhat is wrong\n", F.when(i % 2 == 0, "PAGES: a.md, b.md\n").otherwise(""), "---END LINT---")
    return parts(spark, sf_dir).select("id", F.explode(parse.lint_blocks_column(text)).alias("b")).select("id", "b.type", "b.severity", "b.title", "b.detail", F.array_join("b.pages", "|").alias("pages"))


@query(PARTS + "SELECT id, 'inner ' || id AS section FROM w")
def marked_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts(spark, sf_dir).select("id", rowwise(lambda t: parse.marked_section(t, "plan"), "string")(said("a <Plan>\n inner ", F.col("id"), " </plan> b")).alias("section"))


@query(PARTS + "SELECT id, 'Answer ' || id || ' here' AS clean, 'Title ' || id AS title FROM w")
def saved_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers without thinking and comments, and their titles."""
    i = F.col("id")
    return parts(spark, sf_dir).select("id", P.clean_answer(said("<think>no\nno</think>Answer ", i, " here<!-- x\ny -->")).alias("clean"), P.answer_title(said("<thinking>a</thinking>\n\n ## Title ", i, "\nrest")).alias("title"))


@query(PARTS + "SELECT id, '---' || chr(10) || 'type: x' || chr(10) || '---' || chr(10) || 'body ' || id || chr(10) AS page FROM w")
def sanitized_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated pages in a fence, under a stray line, or without their opening fence."""
    i = F.col("id")
    page = F.when(i % 3 == 0, said("```markdown\n---\ntype: x\n---\nbody ", i, "\n```")).when(i % 3 == 1, said("frontmatter:\n---\ntype: x\n---\nbody ", i)).otherwise(said("type: x\n---\nbody ", i, "\n\n"))
    return parts(spark, sf_dir).select("id", rowwise(parse.sanitize, "string")(page).alias("page"))


@query(PARTS + """SELECT id, '---' || chr(10) || 'a: 1' || chr(10) || CASE WHEN id % 2 = 0 THEN 'tags: ["x", "y"]' || chr(10) || 'b: 2' ELSE 'b: 2' || chr(10) || 'tags: ["x", "y"]' END || chr(10) || '---' || chr(10) || 'body' || id AS page FROM w""")
def written_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list written into the frontmatter, in its place or at the end."""
    i = F.col("id")
    page = said("---\na: 1\n", F.when(i % 2 == 0, "tags:\n  - old\n  - older\nb: 2\n").otherwise("b: 2\n"), "---\nbody", i)
    return parts(spark, sf_dir).select("id", rowwise(lambda t: parse.set_list(t, "tags", ["x", "y"]), "string")(page).alias("page"))


@query(PARTS + "SELECT id, 'see Alias and gone-b but [[kept]] ' || id AS dead, 'The [[alpha|Alpha]] and alpha, [[beta]] ' || id AS enriched, 'a [Alias](t.md) and [u](u.md) `[[code]]` ' || id AS common FROM w")
def link_rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dead links as text, first mentions as links, links as plain Markdown."""
    i, rows = F.col("id"), parts(spark, sf_dir)
    dead = rowwise(lambda t: parse.strip_dead_links(t, ["gone-a", "gone-b"]), "string")(said("see [[gone-a|Alias]] and [[gone-b]] but [[kept]] ", i))
    enriched = rowwise(lambda t: parse.enrich_links(t, [("Alpha", "alpha"), ("beta", "beta")]), "string")(said("The Alpha and alpha, beta ", i))
    return rows.select("id", dead.alias("dead"), enriched.alias("enriched"), rowwise(parse.to_commonmark, "string")(said("a [[t|Alias]] and [[u]] `[[code]]` ", i)).alias("common"))


@query(PARTS + "SELECT id, '=one |-two|+2| =three' || id AS diff, CASE WHEN id % 2 = 0 THEN 4 ELSE -1 END AS at FROM w")
def edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word diffs of two texts, and where a selection stands if it stands once."""
    def shown(pair: str) -> str:
        a, b = pair.split("\x00")
        return "|".join(f"{k}{v}" for k, v in parse.word_diff(a, b))

    def place(pair: str) -> int:
        found = parse.locate_selection(*pair.split("\x00"))
        return found[0] if found else -1

    i = F.col("id")
    diff = rowwise(lambda t: shown(t).replace("|= ", "| ="), "string")(said("one two three", i, "\x00one 2 three", i))
    at = rowwise(place, "int")(F.when(i % 2 == 0, said("abc sel  ect", i, "\x00sel ect", i)).otherwise(said("sel sel ", i, "\x00sel")))
    return parts(spark, sf_dir).select("id", diff.alias("diff"), at.alias("at"))


# ---- merges and deletions


@query(PARTS + """SELECT id, CASE WHEN id % 3 = 0 THEN 'New' ELSE 'Old' END AS title, CASE WHEN id % 3 = 0 THEN 'a.PDF|c' || id % 2 WHEN id % 3 = 1 THEN 'A.pdf|b.md' ELSE 'A.pdf|b.md|c' || id % 2 END AS sources,
    CASE WHEN id % 3 = 0 THEN repeat('n', (5 + id % 11)::INT) WHEN id % 3 = 1 THEN repeat('o', (10 + id % 7)::INT) WHEN 5 + id % 11 >= 0.7 * greatest(10 + id % 7, 5 + id % 11) THEN repeat('n', (5 + id % 11)::INT) ELSE repeat('o', (10 + id % 7)::INT) || chr(10) || chr(10) || repeat('n', (5 + id % 11)::INT) END AS body FROM w""")
def page_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages after a rewrite: lists united, titles locked, short new bodies turned down."""
    rows, i = parts(spark, sf_dir), F.col("id")
    none = F.array().cast("array<string>")
    made = lambda title, first, last, body: (said("p", i).alias("path"), F.lit("x").alias("type"), F.lit(title).alias("title"), F.lit("d").alias("created"), F.array(F.lit(first), last).alias("sources"), none.alias("tags"), none.alias("related"), body.alias("body"))
    old = rows.where("id % 3 <> 0").select(*made("Old", "A.pdf", F.lit("b.md"), F.repeat(F.lit("o"), (10 + i % 7).cast("int"))))
    new = rows.where("id % 3 <> 1").select(*made("New", "a.PDF", said("c", i % 2), F.repeat(F.lit("n"), (5 + i % 11).cast("int"))))
    return D.merge_pages(old, new).select(F.substring("path", 2, 20).cast("long").alias("id"), "title", F.array_join("sources", "|").alias("sources"), "body")


@query(PARTS + "SELECT id, '[[new-a]] [[new-b|x]] [[keep]] ' || id AS content, CASE WHEN id % 2 = 0 THEN 'new-a|keep' ELSE 'NEW-A|keep' END AS related, '# I' || chr(10) || '- [[keep]] ' || id AS index FROM w")
def merge_rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, lists and index lines after pages were merged."""
    i, moved = F.col("id"), {"old-a": "new-a", "old-b": "new-b"}
    related = F.when(i % 2 == 0, F.array(F.lit("Old-A"), F.lit("new-a"), F.lit("keep"))).otherwise(F.array(F.lit("NEW-A"), F.lit("old-a"), F.lit("keep")))
    index = said("# I\n- [[old-a]] x\n* [[Old-B|y]]\n- [z](entities/old-a.md)\n- [[keep]] ", i)
    return parts(spark, sf_dir).select("id", D.rewrite_links(said("[[old-a]] [[ Old-B |x]] [[keep]] ", i), moved).alias("content"), F.array_join(D.remap_list(related, moved), "|").alias("related"), D.drop_index_lines(index, list(moved)).alias("index"))


@query(PARTS + """SELECT id, CASE WHEN size % 5 <> 2 AND id % 3 <> 0 THEN 'skip' WHEN size % 5 = 2 AND id % 3 = 0 THEN 'delete' ELSE 'keep' END AS decision,
    concat_ws('|', CASE WHEN size % 5 <> 2 THEN 's' || size % 5 || '.pdf' END, CASE WHEN id % 3 <> 0 THEN 'raw/t' || id % 3 || '.md' END) AS sources FROM w""")
def cascade_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of pages when a source goes: it's named by its path or, without a folder, by its name."""
    i = F.col("id")
    sources = F.array(said("s", F.col("size") % 5, ".pdf"), F.when(i % 3 == 0, "Raw/X/S2.pdf").otherwise(said("raw/t", i % 3, ".md")))
    pages = parts(spark, sf_dir).select(said("p", i).alias("path"), sources.alias("sources"))
    found = L.cascade_delete(pages, "raw/x/s2.pdf")
    return found.select(F.substring("path", 2, 20).cast("long").alias("id"), "decision", F.array_join("sources", "|").alias("sources"))


@query(PARTS + "SELECT CASE WHEN id % 6 = 2 THEN 'wiki/sources/report-' || id || '.md' ELSE 'wiki/p/' || id || '.md' END AS path FROM w WHERE id % 6 IN (0, 1, 2)")
def related_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that a source stands behind: its quoted name, its summary page, its place among the sources."""
    i = F.col("id")
    path = F.when(i % 6 == 2, said("wiki/sources/report-", i, ".md")).otherwise(said("wiki/p/", i, ".md"))
    content = F.when(i % 6 == 0, said('x "report.pdf" ', i)).otherwise(said("x report.pdf ", i))
    sources = F.when(i % 6 == 1, F.array(F.lit("raw/Report.PDF"))).otherwise(F.array(F.lit("other.pdf")))
    return L.related_pages(parts(spark, sf_dir).select(path.alias("path"), content.alias("content"), sources.alias("sources")), "raw/sources/report.pdf")


@query(PARTS + "SELECT id, CASE WHEN id % 2 = 0 THEN 'a new b' || id ELSE 'changed' END AS content, id % 2 = 0 AS applied FROM w WHERE id % 3 = 0")
def guarded_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, rows = F.col("id"), parts(spark, sf_dir)
    pages = rows.select(said(i).alias("path"), F.when(i % 2 == 0, said("a old b", i)).otherwise("changed").alias("content"))
    asked = rows.where("id % 3 = 0").select(said(i).alias("path"), F.lit("a ").alias("prefix"), F.lit("old").alias("selection"), said(" b", i).alias("suffix"), F.lit("new").alias("replacement"))
    return L.guarded_edits(pages, asked).select(F.col("path").cast("long").alias("id"), "content", "applied")


@query("SELECT 'n' || n_nationkey || '.md' AS name, CASE n_nationkey % 4 WHEN 0 THEN 'n' || n_nationkey || '.md' WHEN 1 THEN 'n' || n_nationkey || '-2026-01-02.md' WHEN 2 THEN 'n' || n_nationkey || '-2026-01-02-2.md' ELSE 'n' || n_nationkey || '-2026-01-02-3.md' END AS path FROM nation")
def destination_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first free file name of each nation: its own, with the date, with the date and a number."""
    rows, i = table(spark, sf_dir, "nation"), F.col("n_nationkey")
    tried = F.slice(F.array(said("n", i, ".md"), said("n", i, "-2026-01-02.md"), said("n", i, "-2026-01-02-2.md")), F.lit(1), (i % 4).cast("int"))
    return L.destination_names(rows.select(said("n", i, ".md").alias("name")), rows.select(F.explode(tried).alias("path")), "2026-01-02", 1)


@query(PARTS + "SELECT id, 'The ' || name AS title, CASE WHEN id % 3 = 0 THEN 'comparison' ELSE 'concept' END AS type FROM (SELECT id, CASE WHEN id % 3 = 0 THEN 'Comparison ' || id ELSE 'Zq ' || id END AS name FROM w WHERE id % 3 < 2)")
def page_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drafts that reviews ask for: the title without its prefix, the kind by its words, else a concept."""
    i = F.col("id")
    rows = parts(spark, sf_dir).where("id % 3 < 2").select("id", F.lit("suggestion").alias("type"), F.when(i % 3 == 0, said("Missing page: The Comparison ", i)).otherwise(said("The Zq ", i)).alias("title"))
    return L.page_drafts(rows).select("id", "title", "type")


@query("SELECT event_type AS kind, count(*) AS n FROM events GROUP BY 1")
def distinct_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many distinct events stand behind each type, by the count of distinct references."""
    refs = table(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), F.col("event_id").cast("string").alias("path"))
    return refs.groupBy("kind").agg(F.countDistinct("kind", "path").alias("n"))


@query("SELECT CASE WHEN p = 3 THEN 'Document' ELSE 'Page ' || p END AS page, string_agg('img-' || p_partkey || '.png', '|' ORDER BY p_partkey) AS paths FROM (SELECT p_partkey, p_size % 4 AS p FROM part) GROUP BY p")
def image_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extracted images by page, in the order of their numbers."""
    rows = table(spark, sf_dir, "part").select(F.when(F.col("p_size") % 4 < 3, F.col("p_size") % 4).cast("int").alias("page"), said("img-", F.col("p_partkey"), ".png").alias("path"))
    return L.image_groups(rows).select("page", F.array_join("paths", "|").alias("paths"))


@query("SELECT p_partkey::BIGINT AS src, p_partkey::BIGINT + 1 AS dst FROM part WHERE p_partkey % 3 <> 0")
def kept_insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insights whose key, in either order, wasn't dismissed."""
    rows = parts(spark, sf_dir)
    keys = rows.where("id % 3 = 0").select(F.concat_ws(":::", F.least((F.col("id") + 1).cast("string"), F.col("id").cast("string")), F.greatest((F.col("id") + 1).cast("string"), F.col("id").cast("string"))).alias("key"))
    return L.dismissed(rows.select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")), keys).select("src", "dst")


@query(PARTS + "SELECT 'wiki/media/my-paper-' || id || '/i.png' AS image, 'raw/My Paper ' || id || '.pdf' AS source FROM w WHERE id % 2 = 0")
def image_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, i = parts(spark, sf_dir), F.col("id")
    images = rows.select(said("wiki/media/my-paper-", i, "/i.png").alias("path"))
    return L.image_sources(images, rows.where("id % 2 = 0").select(said("raw/My Paper ", i, ".pdf").alias("path")))


@query(PARTS + "SELECT DISTINCT 'a' || id || '|b' AS key FROM w")
def whitelist_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whitelist of groups with those that it lacks."""
    rows, i = parts(spark, sf_dir), F.col("id")
    return L.whitelist_insert(rows.where("id % 2 = 0").select(said("a", i, "|b").alias("key")), rows.select(F.array(F.lit("B"), said("A", i)).alias("ids")))


@query("SELECT string_agg('- **T' || n_nationkey || '** (p' || n_nationkey || ')' || CASE WHEN n_nationkey % 2 = 0 THEN ': a b' ELSE '' END, chr(10) ORDER BY n_nationkey) AS answer FROM nation WHERE n_nationkey < 10")
def reference_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An answer from the first ten references, without a model."""
    i = F.col("n_nationkey")
    refs = table(spark, sf_dir, "nation").select(i.alias("pos"), said("T", i).alias("title"), said("p", i).alias("path"), F.when(i % 2 == 0, " a \n b ").alias("snippet"))
    return L.answer_from_references(refs)


@query(PARTS + "SELECT id, substr(repeat('s', 9000), 1, 8000 - least(8000, (id * 37 % 9000))::INT) AS system, repeat('u', least(8000, id * 37 % 9000)::INT) AS user FROM w")
def fitted_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """System and user text cut to a model's size."""
    system, user = L.fit_context(F.repeat(F.lit("s"), 9000), F.repeat(F.lit("u"), (F.col("id") * 37 % 9000).cast("int")), 10)
    return parts(spark, sf_dir).select("id", system.alias("system"), user.alias("user"))


@query(PARTS + "SELECT id, repeat('b', 10) || 'IMG' || id || repeat('a', 10) AS around FROM w")
def caption_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = said(F.repeat(F.lit("b"), 40), "IMG", F.col("id"), F.repeat(F.lit("a"), 40))
    return parts(spark, sf_dir).select("id", L.caption_context(text, said("IMG", F.col("id")), 10).alias("around"))


# ---- reviews, queues, imports


@query(PARTS + """SELECT id, 'page-exists' AS action FROM w WHERE id % 4 = 0 UNION ALL SELECT id, 'page-gone' FROM w WHERE id % 4 = 1""")
def review_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews that the corpus resolves: missing pages that are there, duplicates of which one is gone."""
    rows, i = parts(spark, sf_dir), F.col("id")
    kind = F.when(i % 4 < 1, "missing-page").when(i % 4 < 3, "duplicate").otherwise("missing-page")
    title = F.when(i % 4 == 0, said("Missing page: Name ", i)).otherwise(said("Nothing ", i))
    asked = F.when(i % 4 == 1, F.array(said("wiki/name-", i, ".md"), F.lit("wiki/gone.md"))).when(i % 4 == 2, F.array(said("wiki/name-", i, ".md"))).otherwise(F.array().cast("array<string>"))
    pages = rows.select(said("name-", i).alias("page_id"), said("Title ", i).alias("title"))
    return R.sweep(rows.select("id", kind.alias("type"), title.alias("title"), asked.alias("pages")), pages)


@query(PARTS + """SELECT id, CASE WHEN id % 3 = 0 THEN 'stored' WHEN id % 3 = 1 THEN 'new' || id % 2 ELSE 'new' || id % 2 END AS title, CASE WHEN id % 3 = 0 THEN 'old' WHEN id % 2 = 0 THEN 'fresh' WHEN id % 3 = 1 THEN 'old' END AS description, CASE WHEN id % 3 = 2 THEN false ELSE id % 5 = 0 END AS resolved FROM w""")
def review_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored reviews with incoming ones: the new description wins, what is resolved stays so."""
    rows, i = parts(spark, sf_dir), F.col("id")
    stored = rows.where("id % 3 < 2").select("id", F.lit("t").alias("type"), F.lit("stored").alias("title"), F.lit("old").alias("description"), (i % 5 == 0).alias("resolved"), i.alias("created_at"))
    new = rows.where("id % 3 > 0").select("id", F.lit("t").alias("type"), said("new", i % 2).alias("title"), F.when(i % 2 == 0, "fresh").alias("description"), F.lit(False).alias("resolved"), F.lit(0).cast("long").alias("created_at"))
    return R.update(stored, new).select("id", "title", "description", "resolved")


@query(PARTS + """SELECT id, CASE id % 5 WHEN 0 THEN 'Pending' WHEN 1 THEN 'Processing' WHEN 2 THEN 'Pending' WHEN 3 THEN 'Failed' ELSE 'Pending' END AS status, CASE WHEN id % 5 = 2 THEN 1 WHEN id % 5 = 3 THEN 99 ELSE 0 END AS retries, id % 5 = 1 AS needs_rerun FROM w""")
def queue_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A queue after new changes: pending, in work, failed with and without tries left, and new tasks."""
    rows, i = parts(spark, sf_dir), F.col("id")
    status = F.element_at(F.array(*map(F.lit, ("Pending", "Processing", "Failed", "Failed"))), (i % 5 + 1).cast("int"))
    retries = F.when(i % 5 == 2, 1).when(i % 5 == 3, 99).otherwise(0)
    old = rows.where("id % 5 < 4").select(said(i).alias("path"), F.lit("Modified").alias("kind"), status.alias("status"), retries.alias("retries"), F.lit(False).alias("needs_rerun"), F.lit(1).cast("long").alias("updated_at"))
    new = rows.select(said(i).alias("path"), F.lit("Modified").alias("kind"), F.lit(2).cast("long").alias("updated_at"))
    return C.upsert(old, new).select(F.col("path").cast("long").alias("id"), "status", "retries", "needs_rerun")


@query(PARTS + "SELECT id, CASE id % 5 WHEN 1 THEN 'Pending' WHEN 2 THEN 'Failed' ELSE 'Processing' END AS status, CASE WHEN id % 5 = 2 THEN 1 ELSE 0 END AS retries FROM w WHERE id % 5 > 0")
def queue_process(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A queue after work: done, due to run again, failed, of an older version, and without a result."""
    rows, i = parts(spark, sf_dir), F.col("id")
    queue = rows.select(said(i).alias("path"), F.lit("Modified").alias("kind"), F.lit("Processing").alias("status"), F.lit(0).alias("retries"), (i % 5 == 1).alias("needs_rerun"), F.lit(7).cast("long").alias("updated_at"))
    results = rows.where("id % 5 < 4").select(said(i).alias("path"), (i % 5 != 2).alias("ok"), F.when(i % 5 == 3, 6).otherwise(7).cast("long").alias("version"))
    return C.process(queue, results).select(F.col("path").cast("long").alias("id"), "status", "retries")


@query("""SELECT doc_id::BIGINT AS id, 'raw/sources/d' || doc_id || CASE doc_id % 4 WHEN 0 THEN '.md' WHEN 2 THEN '.txt' ELSE '.PDF' END AS path, md5(coalesce(text, '')) AS md5 FROM documents WHERE doc_id % 4 <> 1 AND doc_id % 8 <> 0 AND doc_id % 12 <> 11""")
def import_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New and changed files of a listing: of kinds that are taken in, not hidden, not known."""
    from weft.sources.readers import scheduled_import

    i, docs = F.col("doc_id"), table(spark, sf_dir, "documents")
    ending = F.element_at(F.array(*map(F.lit, (".md", ".exe", ".txt", ".PDF"))), (i % 4 + 1).cast("int"))
    path = said("raw/sources/", F.when(i % 12 == 11, ".").otherwise(""), "d", i, ending)
    rows = docs.select(path.alias("path"), F.lit(10).cast("long").alias("size"), F.coalesce("text", F.lit("")).alias("content"))
    known = docs.where("doc_id % 8 = 0").select(path.alias("path"), F.md5(F.coalesce("text", F.lit(""))).alias("md5"))
    found = scheduled_import(rows, known)
    return found.select(F.regexp_extract("path", r"d(\d+)\.", 1).cast("long").alias("id"), "path", "md5")


@query("SELECT doc_id::BIGINT AS id, doc_id % 2 = 0 AND doc_id % 3 <> 0 AND doc_id % 5 IN (1, 2, 3) AS hit FROM documents")
def cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources whose cached hash and outputs are still right."""
    from weft.sources.readers import cache_probe

    i, docs = F.col("doc_id"), table(spark, sf_dir, "documents")
    content = F.coalesce("text", F.lit(""))
    cache = docs.where("doc_id % 2 = 0").select(said(i).alias("path"), F.when(i % 3 == 0, "x").otherwise(F.sha2(content, 256)).alias("hash"), F.array(F.lit("o1"), said("o", i % 5)).alias("outputs"))
    there = spark.createDataFrame([("o1",), ("o2",), ("o3",)], "path string")
    return cache_probe(docs.select(said(i).alias("path"), content.alias("content")), cache, there).select(F.col("path").cast("long").alias("id"), "hit")


@query("SELECT doc_id::BIGINT AS id, CASE WHEN n_chars <= 33554432 THEN md5(coalesce(text, '')) END AS hash FROM documents")
def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("id"), C.content_hash(F.col("n_chars"), F.coalesce("text", F.lit(""))).alias("hash"))


@query("SELECT vec_id::BIGINT AS id, round(list_cosine_similarity(embedding::DOUBLE[], list_reverse(embedding::DOUBLE[])), 6) AS similarity FROM embeddings")
def cosine_measure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cosine of every vector and its reverse."""
    v = F.col("embedding").cast("array<double>")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("id"), F.round(M.cosine(v, F.reverse(v)), 6).alias("similarity"))


@query("SELECT page_id::BIGINT AS id, CASE WHEN length(html) > 500 THEN substr(html, 1, 500) || chr(10) || chr(10) || '[Content truncated]' ELSE html END AS text FROM pages")
def truncated_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(F.col("page_id").cast("long").alias("id"), html.truncated(F.col("html"), 500).alias("text"))


# ---- unions, orders, resolution


@query("""WITH a AS (SELECT 0 AS service, c_custkey AS pos, 'u' || c_custkey % 30 AS url FROM customer WHERE c_custkey <= 20 UNION ALL SELECT 1, c_custkey, 'u' || c_custkey FROM customer WHERE c_custkey <= 60),
f AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY service, pos) AS r FROM a QUALIFY r = 1) SELECT service, pos::BIGINT AS pos, url FROM f ORDER BY service, pos LIMIT 25""")
def provider_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of two services, each address once, the first twenty-five."""
    rows, i = table(spark, sf_dir, "customer"), F.col("c_custkey")
    one = rows.where("c_custkey <= 20").select(i.cast("long").alias("pos"), said("u", i % 30).alias("url"))
    two = rows.where("c_custkey <= 60").select(i.cast("long").alias("pos"), said("u", i).alias("url"))
    return rules.provider_union([one, two], 25).select("service", "pos", "url")


@query("SELECT 'p' || o_custkey AS path, min(o_orderkey)::BIGINT AS pos FROM orders WHERE o_custkey % 2 = 0 GROUP BY 1")
def allowed_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first block of each allowed path."""
    blocks = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("pos"), said("p", F.col("o_custkey")).alias("path"))
    allowed = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(said("p", F.col("c_custkey")).alias("path"))
    return rules.allowed_blocks(blocks, allowed).select("path", "pos")


@query(PARTS + "SELECT id, CASE WHEN id % 3 = 0 THEN 'raw/a/F' || id || '.md' WHEN id % 3 = 1 THEN 'raw/a/F' || id || '.md' END AS path FROM w")
def resolved_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that references lead to, by path or else by name."""
    rows, i = parts(spark, sf_dir), F.col("id")
    known = rows.where("id % 3 < 2").select(F.explode(F.array(said("raw/a/F", i, ".md"), said("raw/b/F", i, ".md"))).alias("path"))
    links = rows.select(F.when(i % 3 == 0, said("RAW\\a//f", i, ".md")).when(i % 3 == 1, said("elsewhere/f", i, ".md")).otherwise(said("none", i, ".md")).alias("link"))
    return rules.resolve_paths(links, known).select(F.regexp_extract("link", r"(\d+)\.md$", 1).cast("long").alias("id"), "path")


@query("SELECT conv_id, max(turn)::BIGINT AS updated_at FROM conversations GROUP BY 1")
def newest_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations by their last turn, the newest first."""
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max("turn").cast("long").alias("updated_at"))
    return rules.newest_first(rows, key="conv_id").select("conv_id", "updated_at")
