"""Queries of the rules for texts of pages, on the tables' own texts, with SQL that states what comes out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions import measures as M
from weft.functions import page_rules as R
from weft.plans.common import BOTH_SQL, edges
from weft.session import table

QUERIES: dict = {}


def query(sql: str):
    """Registers a query under its name, with its SQL."""
    return lambda fn: QUERIES.setdefault(fn.__name__, (fn, sql))


@query(r"""SELECT doc_id, md5(replace(replace(replace(replace(text, '$', ''), ' de ', ' ∧ '), ' the ', ' x ∈ y '), ' la ', ' ' || chr(10) || 'a \le b' || chr(10) || ' ')) AS plain FROM documents""")
def formulas_in_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts whose short words are formulas: alone, within others, and displayed."""
    text = F.replace("text", F.lit("$"), F.lit(""))
    for word, formula in ((" de ", r" $\wedge$ "), (" the ", r" $x \in y$ "), (" la ", r" $$a \le b$$ ")):
        text = F.replace(text, F.lit(word), F.lit(formula))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(R.formulas_as_text(text)).alias("plain"))


_INTENTS = " ".join(f"WHEN {' OR '.join(f'contains(t, {word!r})' for word in words)} THEN '{name}'" for name, words in R.INTENTS.items())
_CHAT = " OR ".join(f"contains(t, {word!r})" for word in R.CHAT)
_GREETINGS = "|".join(R.GREETINGS).replace("'", "''")


@query(
    rf"""WITH m AS (SELECT conv_id, turn, k, lower(s) AS t, s FROM (SELECT conv_id, turn, 0 AS k, text AS s FROM conversations UNION ALL SELECT conv_id, turn, 1, regexp_extract(text, '^[^\n .,]*') || '!! ' FROM conversations))
SELECT conv_id, turn, k, CASE {_INTENTS} WHEN ({_CHAT}) AND strlen(regexp_replace(s, '^\s+|\s+$', '', 'g')) < 32 THEN 'chat' ELSE 'ambiguous' END AS intent,
coalesce(length(regexp_replace(t, '[\s!.?,;:]+$', '')) <= 20 AND regexp_full_match(regexp_replace(t, '[\s!.?,;:]+$', ''), '{_GREETINGS}'), false) AS greeting FROM m"""
)
def message_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What messages ask for, and whether they only greet: whole ones, and their first words."""
    message = F.array(F.col("text"), F.concat(F.regexp_extract("text", r"^[^\n .,]*", 0), F.lit("!! ")))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(message).alias("k", "s"))
    return rows.select("conv_id", "turn", "k", R.intent(F.col("s")).alias("intent"), R.greeting(F.col("s")).alias("greeting"))


@query(r"""WITH s AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href="/([A-Za-z]+)"', 1)) AS name FROM pages)
SELECT page_id, name, '/p/raw/' || name || ' 1.png' AS own, '/p/wiki/media/' || name AS media, '../../../' || name AS above, 'https://x.org/' || name AS web, '/p/' || name AS whole FROM s""")
def image_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses made from the links of pages: from the page's folder, of media, above the project, in the web, and whole paths."""
    found = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="/([A-Za-z]+)"'), F.lit(1))).alias("name")).distinct()
    to = lambda before, folder, after="": R.image_address(F.concat(F.lit(before), F.col("name"), F.lit(after)), F.lit("/p/"), F.lit(folder))
    return found.select("page_id", "name", to("../", "raw/sources/", "%201.png").alias("own"), to("./../media/", "wiki/a").alias("media"), to("../../../", "wiki/a").alias("above"), to("https://x.org/", "wiki").alias("web"), to("/p/a/../", "wiki").alias("whole"))


_DAY = "strftime(DATE '2024-01-01' + (doc_id % 365)::INT, '%Y-%m-%d')"


@query(f"""SELECT doc_id, md5('---' || chr(10) || 'lang: ' || coalesce(lang, '') || chr(10) || 'created: ' || {_DAY} || chr(10) || 'updated: ' || {_DAY} || chr(10) || '---' || chr(10) || text) AS page,
md5('# Log' || chr(10) || '## [' || {_DAY} || '] ' || text || chr(10) || '## [2001-01-01]') AS log FROM documents""")
def page_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of texts with the dates written in, replaced or added, and logs whose first heading is dated."""
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 365).cast("int")), "yyyy-MM-dd")
    dates = F.when(F.col("doc_id") % 3 == 0, "created: then\nupdated: YYYY\n").when(F.col("doc_id") % 3 == 1, "created: x\n").otherwise("")
    page = F.concat(F.lit("---\nlang: "), F.coalesce("lang", F.lit("")), F.lit("\n"), dates, F.lit("---\n"), "text")
    log = F.concat(F.lit("# Log\n## ["), F.when(F.col("doc_id") % 2 == 0, "YYYY-MM-DD").otherwise("1999-12-31"), F.lit("] "), "text", F.lit("\n## [2001-01-01]"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(R.stamped(page, day)).alias("page"), F.md5(R.stamped_log(log, day)).alias("log"))


@query("""WITH d AS (SELECT doc_id, text, coalesce(lang, 'xx') || '.md' AS own FROM documents)
SELECT doc_id, own, md5('---' || chr(10) || 'title: t' || chr(10) || 'sources: ["' || own || '", "crawl/' || doc_id || '.md"]' || chr(10) || '---' || chr(10) || text) AS page FROM d""")
def source_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of texts whose list of sources names the own one twice, another one in two ways, and some that aren't allowed."""
    own = F.concat(F.coalesce("lang", F.lit("xx")), F.lit(".md"))
    head = F.concat(F.lit("---\ntitle: t\nsources:\n  - raw/sources/"), own, F.lit("\n  - "), F.upper(own), F.lit("\n  - ../up.md\n  - wiki/index.md\n  - crawl/"), "doc_id", F.lit(".md\n  - /p/raw/sources/x.md\n  - raw/sources/CRAWL/"), "doc_id", F.lit(".md\n---\n"), "text")
    return table(spark, sf_dir, "documents").select("doc_id", own.alias("own"), F.md5(R.page_with_sources(head, own)).alias("page"))


@query(r"""SELECT conv_id, turn, (length(to_json(text)) - 2 + length(regexp_replace(text, '[^\x{10000}-\x{10FFFF}]', '', 'g')))::INT AS units, 1 AS n, md5(text) AS said FROM conversations""")
def reasoning_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages as the reasoning of a stream's lines: units as they're written, and texts as they're read."""
    line = F.concat(F.lit("data: "), F.to_json(F.struct(F.array(F.struct(F.struct(F.col("text").alias("reasoning_content"), F.col("role").alias("content")).alias("delta"))).alias("choices"))))
    found = R.reasoning_texts(line)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", R.reasoning_units(line).alias("units"), F.size(found).alias("n"), F.md5(F.get(found, F.lit(0))).alias("said"))


@query("""SELECT conv_id, turn, md5('{"affectedPages":[' || to_json(role) || '],"createdAt":' || conv_id || '.0,"description":' || to_json(text) || ',"options":[{"label":' || to_json(role) || '}],"resolved":' || (turn % 2 = 0) || ',"title":' || to_json(text) || ',"type":' || to_json(role) || '}') AS item FROM conversations""")
def review_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews made of messages, with fields that aren't known and values of other types, which go."""
    options = F.array(F.struct(F.col("role").alias("label"), F.lit(1).alias("action"), F.lit("x").alias("secret")), F.struct(F.lit(None).cast("string").alias("label"), F.lit(2).alias("action"), F.lit("y").alias("secret")))
    item = F.struct(F.col("text").alias("title"), F.col("role").alias("type"), F.col("text").alias("description"), F.lit("s").alias("token"), F.array("role").alias("affectedPages"), F.lit(5).alias("sourcePath"), options.alias("options"), (F.col("turn") % 2 == 0).alias("resolved"), F.col("conv_id").alias("createdAt"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.to_json(item).alias("json"))
    return rows.select("conv_id", "turn", F.md5(R.review_fields(F.col("json"))["item"]).alias("item"))


@query(r"""WITH s AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(split_part(coalesce(text, ''), chr(10), 1)), '^\s+|\s+$', '', 'g'), '\s+', '-', 'g'), '[^\p{L}\p{N}-]', '', 'g'), '-+', '-', 'g') AS s FROM documents),
t AS (SELECT doc_id, left(regexp_replace(s, '^-|-$', '', 'g'), 50) AS s FROM s)
SELECT doc_id, CASE WHEN s = '' THEN 'query' ELSE s END || strftime(TIMESTAMP '2024-01-01' + to_seconds(doc_id), '-%Y-%m-%d-%H%M%S.md') AS name FROM t""")
def answer_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of files for answers titled by the first lines of texts."""
    saved = F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01 00:00:00").cast("timestamp")) + F.col("doc_id"))
    return table(spark, sf_dir, "documents").select("doc_id", R.answer_file(F.get(F.split("text", "\n"), F.lit(0)), saved).alias("name"))


@query("""WITH s AS (SELECT doc_id, n_chars, doc_id * 997 AS size, CASE WHEN doc_id = 0 THEN 204800 ELSE doc_id * 997 END AS c FROM documents)
SELECT doc_id, least(greatest(c - c * 15 // 100 - least(c // 4, greatest(12000, n_chars)) - greatest(12000, c * 8 // 100), 8000), least(300000, greatest(8000, c * 6 // 10)))::BIGINT AS budget,
CASE WHEN c >= 512000 THEN 32768 WHEN c >= 256000 THEN 24576 WHEN c >= 128000 THEN 16384 ELSE 8192 END AS generation, CASE WHEN c >= 128000 THEN 8192 ELSE 4096 END::BIGINT AS review FROM s""")
def ingest_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Budgets of passes over sources beside contexts as long as the documents, in models of many sizes."""
    rows = table(spark, sf_dir, "documents").withColumn("size", F.col("doc_id") * 997)
    return rows.select("doc_id", M.ingest_budget(F.col("size"), F.col("n_chars")).alias("budget"), M.generation_tokens(F.col("size")).alias("generation"), M.review_tokens(F.col("size")).cast("long").alias("review"))


_SCALE = "CASE WHEN n <= 150 THEN 1.0 ELSE greatest(0.35, sqrt(150.0 / n)) END"


@query(f"""WITH {BOTH_SQL}, d AS (SELECT p_partkey::BIGINT AS id, count(src) AS links FROM part LEFT JOIN nbr ON src = p_partkey GROUP BY 1), t AS (SELECT max(links) AS most, count(*) AS n FROM d)
SELECT id, links, round(CASE WHEN most = 0 THEN 8.0 ELSE (8.0 + sqrt(links / most) * 20.0) * {_SCALE} END, 9)::DOUBLE AS size, CASE WHEN n > 2500 THEN 0.16 WHEN n > 1200 THEN 0.1 WHEN n > 700 THEN 0.05 ELSE 0.0 END::DOUBLE AS weak,
CASE WHEN n > 2500 THEN 18 WHEN n > 1200 THEN 14 WHEN n > 600 THEN 10 ELSE 6 END AS label_size, CASE WHEN n > 2500 THEN 0.08 WHEN n > 1200 THEN 0.14 WHEN n > 600 THEN 0.24 ELSE 0.4 END::DOUBLE AS label_density FROM d, t""")
def graph_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of nodes and thresholds for the graph of parts."""
    e = edges(spark, sf_dir)
    ends = e.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("links"))
    d = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("id")).join(ends, "id", "left").withColumn("links", F.coalesce("links", F.lit(0).cast("long")))
    rows = d.crossJoin(F.broadcast(d.agg(F.max("links").alias("most"), F.count("*").alias("n"))))  # one row of totals
    n = F.col("n")
    return rows.select("id", "links", F.round(M.node_size(F.col("links"), F.col("most"), n), 9).alias("size"), M.weak_edge(n).alias("weak"), M.label_size(n).alias("label_size"), M.label_density(n).alias("label_density"))
