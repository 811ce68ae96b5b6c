"""Queries of parsers, chunkers and language rules, and the event-time extensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions import chunker, languages, parse
from weft.functions.html import readable
from weft.functions.rowwise import rowwise
from weft.session import table
from weft.streaming import streams


def language_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by the language that the rules give."""
    return table(spark, sf_dir, "documents").select("doc_id", languages.detect(F.col("text")).alias("language"))


def _rule(letters: str, words: str, instead: str) -> str:
    parts = [f"regexp_matches(l, '[{letters}]')"] if letters else []
    if words:
        spoken = f"regexp_matches(l, '\\b({'|'.join(words.split())})\\b')"
        parts.append(f"({spoken} OR regexp_matches(l, '[{instead}]'))" if instead else spoken)
    return " AND ".join(parts)


#: The tables hold no other scripts than Latin, so their rules aren't in the SQL.
LANGUAGE_SQL = "WITH t AS (SELECT doc_id, lower(text) AS l FROM documents) SELECT doc_id, CASE " + " ".join(f"WHEN {_rule(a, b, c)} THEN '{name}'" for name, a, b, c in languages.LATIN) + " ELSE 'English' END AS language FROM t"


def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of all documents."""
    found = chunker.chunk_pages(table(spark, sf_dir, "documents"), "doc_id", "text")
    return found.select("chunk_id", "index", "char_start", "char_end", "oversized", F.md5("text").alias("hash"))


def semantic_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long pieces of all documents."""
    cut = rowwise(lambda t: [{k: c[k] for k in ("index", "char_start", "char_end")} for c in chunker.semantic_chunks(t, 2000, 200)], "array<struct<index: int, char_start: int, char_end: int>>")
    return table(spark, sf_dir, "documents").select("doc_id", F.inline(cut(F.col("text"))))


def html_readable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The article of every page as Markdown."""
    return table(spark, sf_dir, "pages").select("page_id", readable(F.col("html")).alias("markdown"))


def parse_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FILE blocks around the passages of the benchmark, read back."""
    made = F.concat(F.lit("--- file: wiki/p"), "item_id", F.lit(".md ---\r\n"), F.replace("text", F.lit("\n"), F.lit("\r\n")), F.lit("\r\n---END FILE---\r\n"))
    items = table(spark, sf_dir, "benchmark").select("item_id", F.explode(parse.file_blocks_column(made)).alias("b"))
    return items.select("item_id", "b.path", F.md5("b.content").alias("hash"), F.coalesce("b.problem", F.lit("")).alias("problem"))


BLOCKS_SQL = "SELECT item_id, 'wiki/p' || item_id || '.md' AS path, md5(text) AS hash, '' AS problem FROM benchmark"


def frontmatter_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with frontmatter around documents, read back."""
    page = F.concat(F.lit('---\ntitle: "Doc '), "doc_id", F.lit('"\ntype: Source\nsources: ['), "source", F.lit(', "x, y"]\ntags:\n  - '), "lang", F.lit("\n---\n"), F.col("text"))
    rows = table(spark, sf_dir, "documents").select("doc_id", parse.frontmatter_fields(page).alias("p"))
    one = lambda name: F.array_join(F.col("p.fields")[name], "|").alias(name)
    return rows.select("doc_id", one("title"), one("type"), one("sources"), one("tags"), F.md5("p.body").alias("hash"))


FRONT_SQL = "SELECT doc_id, 'Doc ' || doc_id AS title, 'Source' AS type, source || '|x, y' AS sources, lang AS tags, md5(text) AS hash FROM documents"


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: events by hour and type."""
    return streams.event_windows(table(spark, sf_dir, "events")).select(F.unix_seconds("start").alias("start"), "event_type", "n", "total")


WINDOW_SQL = "SELECT epoch(date_trunc('hour', ts))::BIGINT AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2"


def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: sessions of users with pauses of thirty minutes."""
    return streams.sessions(table(spark, sf_dir, "events")).select("user_id", F.unix_micros("start").alias("start"), "n")


SESSION_SQL = """WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, epoch_us(min(ts)) AS start, count(*) AS n FROM s GROUP BY user_id, s"""


def star_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: orders by status and priority with subtotals."""
    o = table(spark, sf_dir, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return o.select(F.coalesce("o_orderstatus", F.lit("all")).alias("status"), F.coalesce("o_orderpriority", F.lit("all")).alias("priority"), "n", "total")


ROLLUP_SQL = "SELECT coalesce(o_orderstatus, 'all') AS status, coalesce(o_orderpriority, 'all') AS priority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)"

QUERIES = {
    "language_detect": (language_detect, LANGUAGE_SQL),
    "chunk_documents": (chunk_documents, None),
    "semantic_chunks": (semantic_chunks, None),
    "html_readable": (html_readable, None),
    "parse_blocks": (parse_blocks, BLOCKS_SQL),
    "frontmatter_parse": (frontmatter_parse, FRONT_SQL),
    "event_windows": (event_windows, WINDOW_SQL),
    "event_sessions": (event_sessions, SESSION_SQL),
    "star_rollup": (star_rollup, ROLLUP_SQL),
}
