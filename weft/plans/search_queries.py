"""Retrieval queries over documents, embeddings and links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.functions import measures as M
from weft.functions import text as T
from weft.operators import search as S
from weft.plans.common import EDGES_SQL, edges
from weft.session import table

QUERY = "thereand worthless tionhe"
TOKENS = ("thereand", "tionhe", "worthless")
QUERY_VECTOR = 7
K = 20


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages named doc-<id>.md; the title is the name in words."""
    docs = table(spark, sf_dir, "documents")
    name = F.concat(F.lit("doc-"), F.col("doc_id"), F.lit(".md"))
    return docs.select("doc_id", F.concat(F.lit("wiki/"), name).alias("path"), T.title(F.col("text"), name).alias("title"), F.col("text").alias("content"))


PAGES_SQL = "pages AS (SELECT doc_id, 'wiki/doc-' || doc_id || '.md' AS path, 'doc ' || doc_id AS title, text AS content FROM documents)"
HIT_SQL = " + ".join(f"(contains(lower(content), '{t}'))::INT" for t in TOKENS)
TITLE_HIT_SQL = " + ".join(f"(contains(lower(title || ' doc-' || doc_id || '.md'), '{t}'))::INT" for t in TOKENS)
SCORED_SQL = PAGES_SQL + f""", signals AS (
    SELECT *, least(((length(content) - length(replace(lower(content), '{QUERY}', ''))) // {len(QUERY)}), 10) AS occ, {HIT_SQL} AS ct, {TITLE_HIT_SQL} AS tt FROM pages
), scored AS (SELECT *, occ * 20.0::DOUBLE + tt * 5.0::DOUBLE + ct * 1.0::DOUBLE AS score FROM signals WHERE occ + tt + ct > 0)"""


def keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best pages of a keyword query."""
    hits = S.keyword_scores(pages(spark, sf_dir), QUERY).select("path", "title", "score").orderBy(F.col("score").desc(), "path").limit(K)
    return S.ranked(hits).select("path", "title", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


KEYWORD_SQL = f"""WITH {SCORED_SQL}, top AS (SELECT path, title, score, row_number() OVER (ORDER BY score DESC, path) AS rank FROM scored)
SELECT path, title, round(score, 6) AS score, rank FROM top WHERE rank <= {K}"""


def keyword_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The snippet of every page that holds the first token."""
    docs = table(spark, sf_dir, "documents").where(F.contains(F.lower("text"), F.lit(TOKENS[2])))
    return docs.select("doc_id", T.snippet_around(F.col("text"), F.lit(TOKENS[2])).alias("snippet"))


SNIPPET_SQL = f"""WITH t AS (SELECT doc_id, text, instr(lower(text), '{TOKENS[2]}') AS p FROM documents WHERE contains(lower(text), '{TOKENS[2]}')),
s AS (SELECT doc_id, text, greatest(p - 80, 1) AS a, least(p - 1 + {len(TOKENS[2])} + 80, length(text)) AS b FROM t)
SELECT doc_id, (CASE WHEN a > 1 THEN '...' ELSE '' END) || replace(substring(text, a, b - a + 1), chr(10), ' ') || (CASE WHEN b < length(text) THEN '...' ELSE '' END) AS snippet FROM s"""


def tokenize_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pages hold each token of the query tokenizer."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.explode(T.tokenize(F.col("text"))).alias("token"))
    return docs.groupBy("token").agg(F.count("*").alias("pages"))


_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS_EN)
TERMS_SQL = rf"""WITH t AS (SELECT doc_id, unnest(string_split_regex(lower(text), '[\s!-/:-@\[-`{{-~，。！？、；：“”‘’（）·～…]+')) AS token FROM documents)
SELECT token, count(DISTINCT doc_id) AS pages FROM t WHERE length(token) > 1 AND token NOT IN ({_STOP}) GROUP BY 1"""


def query_vector(spark: SparkSession, sf_dir: str):
    """The query's vector as a literal: one row of the table."""
    row = table(spark, sf_dir, "embeddings").where(F.col("vec_id") == QUERY_VECTOR).select("embedding").first()
    return F.lit([float(x) for x in row[0]]).cast("array<double>")


def chunks(spark: SparkSession, sf_dir: str, page: str = "vec_id % 100") -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.expr(page).cast("long").alias("page_id"), F.col("vec_id").alias("chunk_index"), F.col("label").cast("string").alias("chunk_text"), F.lit("").alias("heading_path"), F.col("embedding").alias("vector"))


DISTANCE_SQL = f"""q AS (SELECT embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id = {QUERY_VECTOR}),
near AS (SELECT vec_id, label, 1 / (1 + list_sum(list_transform(list_zip(embedding::DOUBLE[], qv), lambda x: (x[1] - x[2]) * (x[1] - x[2])))) AS score FROM embeddings, q)"""


def vector_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest chunks of a query vector, exactly."""
    hits = S.vector_hits(chunks(spark, sf_dir, "vec_id"), query_vector(spark, sf_dir), K)
    return hits.select(F.col("chunk_index").alias("vec_id"), F.round("score", 6).alias("score"))


KNN_SQL = f"WITH {DISTANCE_SQL} SELECT vec_id, round(score, 6) AS score FROM near ORDER BY near.score DESC, vec_id LIMIT {K}"


def vector_page_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blended scores of the pages of the 60 nearest chunks."""
    blended = S.page_blend(S.vector_hits(chunks(spark, sf_dir), query_vector(spark, sf_dir), S.over_fetch(K)))
    return blended.select("page_id", F.round("score", 6).alias("score"), "chunks", F.col("chunk_text").alias("best_label"))


BLEND_SQL = f"""WITH {DISTANCE_SQL}, hits AS (SELECT vec_id % 100 AS page_id, vec_id, label, score FROM near ORDER BY score DESC, page_id, vec_id LIMIT {S.over_fetch(K)})
SELECT page_id, round(max(score) + least(0.3 * (sum(score) - max(score)), greatest(0, 1 - max(score))), 6) AS score, count(*) AS chunks, CAST(arg_max(label, score) AS VARCHAR) AS best_label FROM hits GROUP BY 1"""


def _ranks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    keyword = S.keyword_scores(pages(spark, sf_dir), QUERY).select(F.regexp_extract("path", r"doc-(\d+)", 1).cast("long").alias("page_id"), "score", "path")
    keyword = S.ranked(keyword.orderBy(F.col("score").desc(), "path").limit(S.SCAN_CAP))
    vector = S.ranked(S.vector_hits(chunks(spark, sf_dir, "vec_id"), query_vector(spark, sf_dir), S.over_fetch(K)), key="page_id")
    return keyword, vector


RANKS_SQL = f"""{SCORED_SQL}, {DISTANCE_SQL},
kw AS (SELECT doc_id AS page_id, row_number() OVER (ORDER BY score DESC, path) AS kr FROM scored QUALIFY kr <= {S.SCAN_CAP}),
vec AS (SELECT vec_id AS page_id, row_number() OVER (ORDER BY score DESC, vec_id) AS vr FROM near QUALIFY vr <= {S.over_fetch(K)}),
fused AS (SELECT coalesce(kw.page_id, vec.page_id) AS page_id, coalesce(1 / (60 + kr), 0)::DOUBLE + coalesce(1 / (60 + vr), 0)::DOUBLE AS score FROM kw FULL JOIN vec ON kw.page_id = vec.page_id)"""


def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword and vector ranks of all hits, fused."""
    return S.fuse(*_ranks(spark, sf_dir)).select("page_id", F.round("score", 9).alias("score"))


RRF_SQL = f"WITH {RANKS_SQL} SELECT page_id, round(score, 9) AS score FROM fused"


def hybrid_graph_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid search with graph neighbours: documents linked as the parts of their numbers are."""
    keyword, vector = _ranks(spark, sf_dir)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), F.concat(F.lit("doc "), "doc_id").alias("title"))
    ranked = S.fuse(keyword, vector).join(docs.select("page_id"), "page_id", "left_semi").orderBy(F.round("score", 12).desc(), "page_id").limit(S.SCAN_CAP)
    ranked = ranked.select("page_id", "score", F.row_number().over(Window.orderBy(F.round("score", 12).desc(), "page_id")).alias("rank"))
    ids = docs.select("page_id")
    links = edges(spark, sf_dir).join(ids.withColumnRenamed("page_id", "src"), "src", "left_semi").join(ids.withColumnRenamed("page_id", "dst"), "dst", "left_semi")
    out = S.blend_graph(ranked, links, docs, K, S.over_fetch(K))
    return out.select("page_id", F.round("score", 9).alias("score"), F.col("section").cast("long").alias("section"), F.col("place").cast("long").alias("place"), F.array_join("related_to", ", ").alias("related_to"))


QUOTA = M.graph_quota(K, S.over_fetch(K))
GRAPH_SQL = f"""WITH {RANKS_SQL}, {EDGES_SQL},
ranked AS (SELECT page_id, score, row_number() OVER (ORDER BY round(score, 12) DESC, page_id) AS rank FROM fused WHERE page_id IN (SELECT doc_id FROM documents)),
links AS (SELECT src, dst FROM edges WHERE src IN (SELECT doc_id FROM documents) AND dst IN (SELECT doc_id FROM documents)),
nbr AS (SELECT src, dst FROM links UNION SELECT dst, src FROM links),
seeds AS (SELECT * FROM ranked WHERE rank <= {min(K, M.GRAPH_SEEDS)}),
cand AS (SELECT n.dst AS page_id, sum(1.0::DOUBLE / s.rank) AS gs, string_agg(DISTINCT 'doc ' || s.page_id, ', ' ORDER BY 'doc ' || s.page_id) AS related_to FROM nbr n JOIN seeds s ON n.src = s.page_id WHERE n.dst NOT IN (SELECT page_id FROM seeds) GROUP BY 1),
best AS (SELECT *, row_number() OVER (ORDER BY gs DESC, page_id) AS gr FROM cand QUALIFY gr <= {QUOTA}),
base AS (SELECT page_id, score, row_number() OVER (ORDER BY rank) AS place FROM ranked WHERE page_id NOT IN (SELECT page_id FROM best))
SELECT page_id, round(score, 9) AS score, 0::BIGINT AS section, place, NULL::VARCHAR AS related_to FROM base WHERE place <= {K} - (SELECT count(*) FROM best)
UNION ALL SELECT b.page_id, round(coalesce(r.score, b.gs / 61), 9), 1::BIGINT, b.gr, b.related_to FROM best b LEFT JOIN ranked r ON b.page_id = r.page_id"""


def source_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten documents, in the order of the scan, that hold the query or one of its terms."""
    docs = table(spark, sf_dir, "documents")
    hit = F.contains(F.lower("text"), F.lit(QUERY))
    for t in TOKENS:
        hit = hit | F.contains(F.lower("text"), F.lit(t))
    return docs.where(hit).select("doc_id", "source").orderBy("doc_id").limit(10)


SOURCE_SQL = "SELECT doc_id, source FROM documents WHERE " + " OR ".join(f"contains(lower(text), '{t}')" for t in (QUERY, *TOKENS)) + " ORDER BY doc_id LIMIT 10"


def graph_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quota of the graph for window sizes and vector hits, as columns."""
    rows = table(spark, sf_dir, "part").select(F.col("p_size").alias("lim"), (F.col("p_partkey") % 60).alias("hits")).distinct()
    share = F.lit(M.GRAPH_SHARE_MOST) - (M.GRAPH_SHARE_MOST - M.GRAPH_SHARE_LEAST) * (F.least("hits", F.col("lim")) / F.col("lim"))
    quota = F.when(F.col("lim") < 2, 0).otherwise(F.least(F.greatest(F.ceil(F.col("lim") * share), F.lit(1)), F.col("lim") - 1))
    return rows.select(F.col("lim").cast("long").alias("lim"), F.col("hits").cast("long").alias("hits"), quota.cast("long").alias("quota"))


QUOTA_SQL = """SELECT DISTINCT p_size::BIGINT AS lim, p_partkey % 60 AS hits, CASE WHEN p_size < 2 THEN 0 ELSE least(greatest(ceil(p_size * (0.3::DOUBLE - (0.3::DOUBLE - 0.15::DOUBLE) * (least(p_partkey % 60, p_size)::DOUBLE / p_size))), 1), p_size - 1) END::BIGINT AS quota FROM part"""

QUERIES = {
    "keyword_search": (keyword_search, KEYWORD_SQL),
    "keyword_snippet": (keyword_snippet, SNIPPET_SQL),
    "tokenize_terms": (tokenize_terms, TERMS_SQL),
    "vector_knn": (vector_knn, KNN_SQL),
    "vector_page_blend": (vector_page_blend, BLEND_SQL),
    "hybrid_rrf": (hybrid_rrf, RRF_SQL),
    "hybrid_graph_search": (hybrid_graph_search, GRAPH_SQL),
    "source_search": (source_search, SOURCE_SQL),
    "graph_quota": (graph_quota, QUOTA_SQL),
}
