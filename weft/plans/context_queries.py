"""Queries of contexts around pages, of gaps in the graph of parts, and of long sources read step by step."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions import text as T
from weft.operators import contexts as X
from weft.operators import graph as G
from weft.operators import long_sources
from weft.plans.common import EDGES_SQL, NODES_SQL, edges, nodes
from weft.session import checkpoint_dir, remove_at_end, table
from weft.sources.store import Store


def page_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as pages that link to parts bought with them and to a page that isn't there, with what stands around them and their last shipment as version."""
    linked = edges(spark, sf_dir).groupBy(F.col("src").alias("p_partkey")).agg(F.sort_array(F.collect_list("dst")).alias("to"))
    parts = table(spark, sf_dir, "part").join(linked, "p_partkey", "left")
    link = lambda x: F.concat(F.lit("[[ Part-"), x, F.lit(".md#facts|the part ]]"))
    body = F.array_join(F.transform(F.coalesce("to", F.array().cast("array<bigint>")), link), "\n")
    head = F.concat(F.lit("---\ntitle: The part "), "p_partkey", F.lit("\ntags:\n  - size "), "p_size", F.lit("\n  - "), F.concat(F.lit("kind "), F.col("p_size") % 5), F.lit("\n---\n"))
    pages = parts.select(F.concat(F.lit("wiki/parts/part-"), "p_partkey", F.lit(".md")).alias("path"), F.concat(head, body, F.lit("\n[[None "), F.col("p_partkey") % 7, F.lit("]] [[]] [[open")).alias("content"))
    history = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("wiki/parts/part-"), "l_partkey", F.lit(".md")).alias("path"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("timestamp"), F.col("l_suppkey").alias("author"), F.col("l_orderkey").alias("tool"))
    contexts = X.page_contexts(pages)
    found = X.enriched(contexts.select("path"), contexts, history)
    join = lambda c: F.array_join(c, ",").alias(c)
    return found.select("path", "title", join("tags"), join("outgoing"), join("backlinks"), join("neighbours"), "link_count", F.concat_ws("/", "latest_version.timestamp", F.col("latest_version.author").cast("string"), F.col("latest_version.tool").cast("string")).alias("version"))



_PATH = "'wiki/parts/part-' || {} || '.md'"
CONTEXT_SQL = f"""WITH {EDGES_SQL}, o AS (SELECT src AS id, 'Part-' || dst || '.md#facts' AS link FROM edges UNION ALL SELECT p_partkey, 'None ' || (p_partkey % 7) FROM part),
ol AS (SELECT id, list(link ORDER BY link) AS l FROM o GROUP BY 1), bl AS (SELECT dst AS id, list({_PATH.format('src')} ORDER BY {_PATH.format('src')}) AS l FROM edges GROUP BY 1),
nl AS (SELECT id, list(p ORDER BY p) AS l FROM (SELECT src AS id, {_PATH.format('dst')} AS p FROM edges UNION ALL SELECT dst, {_PATH.format('src')} FROM edges) GROUP BY 1),
h AS (SELECT l_partkey AS id, max(struct_pack(t := strftime(l_shipdate, '%Y-%m-%d'), a := l_suppkey, o := l_orderkey)) AS v FROM lineitem WHERE l_shipdate IS NOT NULL GROUP BY 1)
SELECT {_PATH.format('p_partkey')} AS path, 'The part ' || p_partkey AS title, 'size ' || p_size || ',kind ' || (p_size % 5) AS tags, array_to_string(ol.l[1:20], ',') AS outgoing, coalesce(array_to_string(bl.l[1:20], ','), '') AS backlinks,
coalesce(array_to_string(nl.l[1:20], ','), '') AS neighbours, len(ol.l) + coalesce(len(bl.l), 0) AS link_count, coalesce(h.v.t || '/' || h.v.a || '/' || h.v.o, '') AS version
FROM part JOIN ol ON ol.id = p_partkey LEFT JOIN bl ON bl.id = p_partkey LEFT JOIN nl ON nl.id = p_partkey LEFT JOIN h ON h.id = p_partkey"""


def knowledge_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eight gaps of the graph of parts."""
    e = edges(spark, sf_dir)
    found = G.knowledge_gaps(nodes(spark, sf_dir, e), e)
    return found.withColumn("measure", F.round("measure", 9))


_COMMUNITIES = """i AS (SELECT s.community, count(*) AS intra FROM edges JOIN nodes s ON src = s.id JOIN nodes t ON dst = t.id AND s.community = t.community GROUP BY 1),
c AS (SELECT community, size, label, row_number() OVER (ORDER BY size DESC, community) AS place, coalesce(intra, 0) / (size * (size - 1) / 2) AS cohesion
    FROM (SELECT community, count(*) AS size, arg_min(label, (-degree, label)) AS label FROM nodes GROUP BY 1) LEFT JOIN i USING (community) WHERE size > 1),
b AS (SELECT n.src AS id, count(DISTINCT t.community) AS n FROM nbr n JOIN nodes t ON n.dst = t.id GROUP BY 1 HAVING count(DISTINCT t.community) >= 3 ORDER BY 2 DESC, 1 LIMIT 3),
gaps AS (SELECT * EXCLUDE (part, place) FROM (
    SELECT 0 AS part, 0 AS place, 'isolated-node' AS kind, '' AS subject, count(*) || ' isolated page' || CASE WHEN count(*) > 1 THEN 's' ELSE '' END AS title, count(*) AS n_pages, max(degree)::DOUBLE AS measure FROM nodes WHERE degree <= 1 HAVING count(*) > 0
    UNION ALL SELECT 1, place, 'sparse-community', community::VARCHAR, 'Sparse cluster: ' || label, size, round(cohesion, 9)::DOUBLE FROM c WHERE size >= 3 AND cohesion < 0.15
    UNION ALL SELECT 2, row_number() OVER (ORDER BY n DESC, b.id), 'bridge-node', b.id::VARCHAR, 'Key bridge: ' || label, 1, n::DOUBLE FROM b JOIN nodes USING (id)) ORDER BY part, place LIMIT 8)"""
GAPS_SQL = f"WITH {NODES_SQL}, {_COMMUNITIES} SELECT kind, subject, title, n_pages, measure FROM gaps"


def gap_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page of these gaps."""
    e = edges(spark, sf_dir)
    of = nodes(spark, sf_dir, e)
    return G.gap_pages(of, G.knowledge_gaps(of, e))


GAP_PAGES_SQL = f"""WITH {NODES_SQL}, {_COMMUNITIES}, m AS (SELECT 'isolated-node' AS kind, '' AS subject, id FROM nodes WHERE degree <= 1 UNION ALL SELECT 'sparse-community', community::VARCHAR, id FROM nodes UNION ALL SELECT 'bridge-node', id::VARCHAR, id FROM nodes)
SELECT kind, subject, id FROM m SEMI JOIN gaps USING (kind, subject)"""


def scanned_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with links over their lines: closed and open ones, with aliases and without."""
    text = F.replace(F.replace(F.concat("text", F.lit(" ")), F.lit("\n"), F.lit("|a]] [[ ")), F.lit(". "), F.lit("]] [["))
    links = T.scanned_links(text)
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.size(links).cast("long").alias("n"), F.md5(F.array_join(links, "\n")).alias("links"))


#: What stands behind the first of each place where links open and close at once.
SCANNED_SQL = """WITH p AS (SELECT doc_id, string_split(replace(replace(text || ' ', chr(10), '|a]] [[ '), '. ', ']] [['), '[[') AS p FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, list_filter(list_transform(list_filter(p[2:], lambda x: contains(x, ']]')), lambda x: regexp_replace(string_split(string_split(x, ']]')[1], '|')[1], '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS l FROM p)
SELECT doc_id, len(l) AS n, md5(array_to_string(l, chr(10))) AS links FROM l"""


def _reader():
    """A stand-in for a model that tells how far it has read, made where workers get it by value; a chunk that doesn't follow the last one is a gap."""

    def call(digest: str, chunk: dict) -> str:
        at = int(digest or 0)
        said = chunk["char_end"] if chunk["char_start"] == at and len(chunk["text"]) == chunk["char_end"] - at else -1
        return f"## Chunk Analysis\n{chunk['char_end'] - at} characters\n\n## Updated Global Digest\n{said}"

    return call


def long_sources_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long documents read chunk by chunk: one round of two chunks, then another run that goes on from the store."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("page_id"), F.col("text").alias("content"), F.lit(20_000).alias("budget"))
    folder = f"{checkpoint_dir(spark)}/weft-store-{uuid.uuid4().hex}"
    remove_at_end(spark, folder)
    store = Store(spark, folder, long_sources.SCHEMAS)
    long_sources.analyse(docs, store, store.claim(), _reader(), steps=2, rounds=1)
    long_sources.analyse(docs, store, store.claim(), _reader())
    found = long_sources.plans(docs, store)
    digest = F.regexp_extract("analysis", r"## Final Global Digest\n(-?\d+)\n", 1)
    told = F.size(F.regexp_extract_all("analysis", F.lit(r"(?m)^## Chunk \d+/\d+"), F.lit(0)))
    whole = F.when(F.col("chunked"), (F.col("done") == F.col("total")) & (told == F.col("total"))).otherwise(True)
    return found.select("page_id", "chunked", whole.alias("whole"), F.when(F.col("chunked"), digest.cast("long")).otherwise(F.char_length("context")).alias("chars"))


READ_SQL = "SELECT doc_id::VARCHAR AS page_id, coalesce(length(text), 0) > 12000 AS chunked, true AS whole, length(text) AS chars FROM documents"

QUERIES = {
    "page_contexts": (page_contexts, CONTEXT_SQL),
    "knowledge_gaps": (knowledge_gaps, GAPS_SQL),
    "gap_pages": (gap_pages, GAP_PAGES_SQL),
    "scanned_links": (scanned_links, SCANNED_SQL),
    "long_sources_read": (long_sources_read, READ_SQL),
}
