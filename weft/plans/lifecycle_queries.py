"""Queries of lifecycle and assembly operators on stand-in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions import files
from weft.functions import text as T
from weft.operators import changes as C
from weft.operators import lifecycle as L
from weft.operators import pages as P
from weft.plans.common import EDGES_SQL, edges
from weft.session import table


def knowledge_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three neighbours of parts on both sides, and how many there are."""
    pages = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))
    found = L.knowledge_context(pages, edges(spark, sf_dir).select("src", "dst"), 3)
    join = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return found.select("id", join("outgoing").alias("outgoing"), join("backlinks").alias("backlinks"), F.col("link_count").cast("long").alias("link_count"))


CONTEXT_SQL = f"""WITH {EDGES_SQL}, o AS (SELECT src AS id, list(dst ORDER BY dst) AS l FROM edges GROUP BY 1), b AS (SELECT dst AS id, list(src ORDER BY src) AS l FROM edges GROUP BY 1)
SELECT p_partkey AS id, coalesce(array_to_string(o.l[1:3], ','), '') AS outgoing, coalesce(array_to_string(b.l[1:3], ','), '') AS backlinks, coalesce(len(o.l), 0) + coalesce(len(b.l), 0) AS link_count FROM part LEFT JOIN o ON o.id = p_partkey LEFT JOIN b ON b.id = p_partkey"""


def reference_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of each type and user."""
    refs = table(spark, sf_dir, "events").select(F.col("event_id").alias("pos"), F.col("event_type").alias("kind"), F.col("user_id").alias("path"))
    return L.distinct_references(refs)


def change_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line quantities and numbers by part, with the ship flags as tools in the order of first sight."""
    edits = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), F.col("l_partkey").alias("path"), F.col("l_quantity").cast("long").alias("added"), F.col("l_linenumber").cast("long").alias("removed"), F.col("l_returnflag").alias("tool"))
    return L.change_totals(edits).select("path", "added", "removed", F.array_join("tools", ",").alias("tools"))


TOTALS_SQL = """WITH e AS (SELECT l_orderkey * 10 + l_linenumber AS pos, l_partkey AS path, l_quantity::BIGINT AS added, l_linenumber::BIGINT AS removed, l_returnflag AS tool FROM lineitem), t AS (SELECT path, string_agg(tool, ',' ORDER BY m) AS tools FROM (SELECT path, tool, min(pos) AS m FROM e GROUP BY 1, 2) GROUP BY 1)
SELECT path, sum(added)::BIGINT AS added, sum(removed)::BIGINT AS removed, tools FROM e JOIN t USING (path) GROUP BY path, tools"""


def needs_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files whose size differs from the one twenty numbers before: only these would be read."""
    now = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("n_chars").alias("size"), F.lit(0).alias("mtime"))
    old = table(spark, sf_dir, "documents").select((F.col("doc_id") + 20).cast("string").alias("path"), F.col("n_chars").alias("size"), F.lit(0).alias("mtime"))
    return C.needs_hash(old, now).select("path", "size")


HASH_SQL = """SELECT a.doc_id::VARCHAR AS path, a.n_chars AS size FROM documents a LEFT JOIN documents b ON a.doc_id = b.doc_id + 20 WHERE b.doc_id IS NULL OR a.n_chars <> b.n_chars"""


def unique_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names for customers by nation, with numbers where they clash."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("n"), "c_nationkey", F.lit(".md")).alias("name"))
    return P.unique_names(rows, "name", F.col("c_custkey")).select("c_custkey", "unique")


NAMES_SQL = """SELECT c_custkey, 'n' || c_nationkey || CASE WHEN r > 1 THEN '-' || r ELSE '' END || '.md' AS unique FROM (SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS r FROM customer)"""


def natural_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages by the natural order of their addresses, with the key that gives it."""
    return table(spark, sf_dir, "pages").select("page_id", files.natural_key(F.col("url")).alias("key")).orderBy("key", "page_id")


NATURAL_SQL = r"""SELECT page_id, array_to_string(list_transform(regexp_extract_all(lower(url), '\d+|\D+'), lambda x: CASE WHEN regexp_full_match(x, '\d+') THEN lpad(x, 18, '0') ELSE x END), '') AS key FROM pages"""


def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slugs of whole passages; a slug's own limit is 50 characters."""
    return table(spark, sf_dir, "benchmark").select("item_id", T.slug(F.col("text")).alias("slug"))


SLUG_SQL = r"""SELECT item_id, regexp_replace(substr(regexp_replace(regexp_replace(lower(trim(text)), '\s+', '-', 'g'), '[^\p{L}\p{N}-]', '', 'g'), 1, 50), '^-+|-+$', '', 'g') AS slug FROM benchmark"""

QUERIES = {
    "knowledge_context": (knowledge_context, CONTEXT_SQL),
    "reference_dedupe": (reference_dedupe, "SELECT min(event_id) AS pos, event_type AS kind, user_id AS path FROM events GROUP BY 2, 3"),
    "change_totals": (change_totals, TOTALS_SQL),
    "needs_hash": (needs_hash, HASH_SQL),
    "unique_names": (unique_names, NAMES_SQL),
    "natural_order": (natural_order, NATURAL_SQL),
    "slugs": (slugs, SLUG_SQL),
}
