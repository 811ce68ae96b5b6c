"""Queries of duplicate detection, linting, change capture, reviews, histories and lifecycle, on stand-in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions import measures as M
from weft.functions import text as T
from weft.operators import changes as C
from weft.operators import dedup as D
from weft.operators import lint as L
from weft.operators import reviews as R
from weft.session import table

TAU = 0.35
PAIRS_SQL = f"""v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings),
n AS (SELECT id, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS u FROM v),
pairs AS (SELECT x.id AS a, y.id AS b, list_dot_product(x.u, y.u) AS similarity FROM n x JOIN n y ON x.id < y.id WHERE list_dot_product(x.u, y.u) >= {TAU})"""
ENDS_SQL = PAIRS_SQL + f""", ends AS (SELECT a, b, similarity FROM pairs UNION ALL SELECT b, a, similarity FROM pairs),
top AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(similarity, 12) DESC, b) AS r FROM ends QUALIFY r <= 8),
best AS (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b, round(similarity, 6) AS similarity FROM top)"""


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


def cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.cosine_pairs(_vectors(spark, sf_dir), TAU).select("a", "b", F.round("similarity", 6).alias("similarity"))


def knn_topk_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.cosine_pairs(_vectors(spark, sf_dir), TAU, D.TOP_K).select("a", "b", F.round("similarity", 6).alias("similarity"))


def dedup_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.near_duplicates(_vectors(spark, sf_dir), TAU)


CLUSTER_SQL = f"""WITH RECURSIVE {ENDS_SQL}, nbr AS (SELECT a, b FROM best UNION SELECT b, a FROM best), reach(id, r) AS (SELECT a, a FROM nbr UNION SELECT reach.id, nbr.b FROM reach JOIN nbr ON reach.r = nbr.a)
SELECT id, min(r) AS cluster FROM reach GROUP BY 1"""


def whitelist_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Close pairs that aren't whitelisted: pairs with an even smaller id are."""
    pairs = D.cosine_pairs(_vectors(spark, sf_dir), TAU).select("a", "b", F.array("b", "a").alias("ids"))
    allowed = pairs.where("a % 2 = 0").select(D.group_key(F.col("ids")).alias("key"))
    return D.drop_whitelisted(pairs, allowed).select("a", "b")


def embedding_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents have a vector."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    return D.coverage(docs.join(_vectors(spark, sf_dir), "id", "left")).select("pages", "embedded", F.round("coverage", 9).alias("coverage"), "enough")


COVERAGE_SQL = """SELECT count(*) AS pages, count(vec_id) AS embedded, round(count(vec_id) / count(*), 9)::DOUBLE AS coverage, count(vec_id) / count(*) >= 0.8 AND count(vec_id) >= 2 AS enough FROM documents LEFT JOIN embeddings ON doc_id = vec_id"""


def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents with one content hash."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))
    return docs.groupBy("hash").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first")).where("copies > 1")


def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without an order."""
    pages = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    return L.orphans(pages, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("dst")))


def broken_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines whose part, moved on by 50, doesn't exist."""
    links = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src"), (F.col("l_partkey") + 50).alias("dst"))
    return L.broken_links(links, table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))).groupBy("dst").agg(F.count("*").alias("links"))


def related_by_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The related benchmark passage of each passage."""
    items = table(spark, sf_dir, "benchmark")
    tokens = items.select(F.col("item_id").alias("id"), F.explode(T.suggestion_tokens(F.col("text"))).alias("token"))
    found = L.related(tokens, None, items.count(), best_only=False)
    return found.select("id", "other", F.round("score", 6).alias("score"))


RELATED_SQL = r"""WITH t AS (SELECT DISTINCT item_id AS id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS token FROM benchmark), tk AS (SELECT * FROM t WHERE length(token) >= 2),
sz AS (SELECT id, count(*) AS size FROM tk GROUP BY 1), rare AS (SELECT token FROM tk GROUP BY 1 HAVING count(*) <= greatest(20, ceil(0.25 * (SELECT count(*) FROM benchmark)))),
u AS (SELECT * FROM tk WHERE token IN (SELECT token FROM rare)), p AS (SELECT x.id, y.id AS other, count(*)::DOUBLE AS overlap FROM u x JOIN u y ON x.token = y.token AND x.id <> y.id GROUP BY 1, 2),
top AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY overlap DESC, other) AS r FROM p QUALIFY r <= 64)
SELECT id, other, round(overlap / sqrt(a.size * b.size), 6) AS score FROM top JOIN sz a USING (id) JOIN sz b ON b.id = other WHERE overlap / sqrt(a.size * b.size) >= 0.08"""


def fuzzy_name_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names with a letter left out, and the part that each is most like."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    broken = parts.select(F.concat(F.substring("name", 1, 2), F.col("name").substr(F.lit(4), F.char_length("name"))).alias("target"))
    return L.suggest_targets(broken, parts, ["name"]).select("target", "id", F.round("similarity", 6).alias("similarity"))


FUZZY_SQL = """WITH p AS (SELECT p_partkey AS id, p_name AS name, lower(trim(p_name)) AS k FROM part), b AS (SELECT DISTINCT substr(name, 1, 2) || substr(name, 4) AS target, lower(trim(substr(name, 1, 2) || substr(name, 4))) AS tk FROM p),
g AS (SELECT DISTINCT target, substr(tk, i, 2) AS g FROM (SELECT target, tk, unnest(range(1, length(tk))) AS i FROM b)), x AS (SELECT DISTINCT id, substr(k, i, 2) AS g FROM (SELECT id, k, unnest(range(1, length(k))) AS i FROM p)),
c AS (SELECT target, id, count(*) AS n FROM g JOIN x USING (g) GROUP BY 1, 2), top AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY n DESC, id) AS r FROM c QUALIFY r <= 64),
s AS (SELECT top.target, top.id, r, CASE WHEN tk = k THEN 1 WHEN contains(k, tk) OR contains(tk, k) THEN 0.82 WHEN length(tk) < 5 OR length(k) < 5 THEN 0 ELSE 1 - levenshtein(tk, k) / greatest(length(tk), length(k)) END::DOUBLE AS similarity FROM top JOIN b USING (target) JOIN p ON p.id = top.id),
f AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY similarity DESC, r) AS f FROM s QUALIFY f = 1) SELECT target, id, round(similarity, 6) AS similarity FROM f WHERE similarity >= 0.74"""


# ---- changes


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two listings of customers as files: the orders of two halves of the time, their number as size, their total as hash."""
    o = table(spark, sf_dir, "orders").withColumn("path", F.concat(F.lit("raw/sources/c"), "o_custkey"))
    half = F.col("o_orderkey") % 2 == 0
    shot = lambda rows: rows.groupBy("path").agg(F.count("*").alias("size"), F.md5(F.max("o_orderpriority")).alias("hash"))
    return shot(o.where(half)), shot(o.where(~half))


SHOTS_SQL = """o AS (SELECT 'raw/sources/c' || o_custkey AS path, * FROM orders), old AS (SELECT path, count(*) AS size, md5(max(o_orderpriority)) AS hash FROM o WHERE o_orderkey % 2 = 0 GROUP BY 1), new AS (SELECT path, count(*) AS size, md5(max(o_orderpriority)) AS hash FROM o WHERE o_orderkey % 2 <> 0 GROUP BY 1)"""


def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.diff(*_snapshots(spark, sf_dir))


DIFF_SQL = f"""WITH {SHOTS_SQL} SELECT coalesce(old.path, new.path) AS path, CASE WHEN old.path IS NULL THEN 'Created' WHEN new.path IS NULL THEN 'Deleted' ELSE 'Modified' END AS kind FROM old FULL JOIN new ON old.path = new.path WHERE old.path IS NULL OR new.path IS NULL OR old.size IS DISTINCT FROM new.size OR old.hash IS DISTINCT FROM new.hash"""


def move_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that stand once among the deleted (even ids) and once among the created (odd ids) documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("raw/"), "doc_id").alias("path"), F.md5("text").alias("hash"), F.col("n_chars").alias("size"))
    return C.moves(docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1"))


MOVES_SQL = """WITH d AS (SELECT doc_id, 'raw/' || doc_id AS path, md5(text) AS hash FROM documents WHERE n_chars >= 32), x AS (SELECT hash, min(path) AS from_path FROM d WHERE doc_id % 2 = 0 GROUP BY 1 HAVING count(*) = 1), y AS (SELECT hash, min(path) AS to_path FROM d WHERE doc_id % 2 = 1 GROUP BY 1 HAVING count(*) = 1) SELECT from_path, to_path FROM x JOIN y USING (hash)"""


def _kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "signup", "Created").when(F.col("event_type") == "error", "Deleted").otherwise("Modified")
    return e.select(F.col("user_id").alias("path"), "event_id", kind.alias("kind"))


def change_kind_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events folded into one change."""
    return C.fold_changes(_kinds(spark, sf_dir), "path", "event_id").select("path", "kind", F.col("n").cast("long").alias("n"))


FOLD_SQL = """WITH k AS (SELECT user_id AS path, event_id, CASE event_type WHEN 'signup' THEN 'Created' WHEN 'error' THEN 'Deleted' ELSE 'Modified' END AS kind FROM events)
SELECT path, list_reduce(list(kind ORDER BY event_id), lambda s, k: CASE WHEN k = 'Modified' THEN 'Modified' WHEN s = 'Deleted' AND k = 'Created' THEN 'Modified' WHEN s = 'Created' AND k = 'Deleted' THEN 'Modified' ELSE k END) AS kind, count(*) AS n FROM k GROUP BY 1"""


def prefix_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages at or below deleted directories of their addresses."""
    p = table(spark, sf_dir, "pages").select(F.regexp_replace(F.regexp_replace("url", r"^https?://", ""), r"[?#].*$", "").alias("path"))
    gone = p.where(F.size(F.split("path", "/")) >= 3).select(F.regexp_extract("path", "^([^/]+/[^/]+)", 1).alias("path")).where("length(path) % 3 = 0")
    return C.expand_deleted(gone, p)


PREFIX_SQL = r"""WITH p AS (SELECT DISTINCT regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') AS path FROM pages), g AS (SELECT DISTINCT regexp_extract(path, '^([^/]+/[^/]+)', 1) AS gone FROM p WHERE len(string_split(path, '/')) >= 3 AND length(regexp_extract(path, '^([^/]+/[^/]+)', 1)) % 3 = 0)
SELECT DISTINCT path FROM p JOIN g ON path = gone OR starts_with(path, gone || '/')"""


def queue_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.create_map(*[F.lit(x) for pair in (("click", "Pending"), ("view", "Processing"), ("purchase", "Done"), ("signup", "Superseded"), ("error", "Failed")) for x in pair])
    return C.status_counts(table(spark, sf_dir, "events").select(names[F.col("event_type")].alias("status")))


QUEUE_SQL = """SELECT count(*) FILTER (event_type = 'click') AS pending, count(*) FILTER (event_type = 'view') AS processing, count(*) FILTER (event_type = 'purchase') AS done, count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (event_type = 'signup') AS superseded, count(*) AS total FROM events"""


def history_last_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 30 events of each user without repeats of the event before."""
    return C.history(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id", "event_type")


HISTORY_SQL = """WITH l AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events), k AS (SELECT * FROM l WHERE b IS NULL OR b <> event_type)
SELECT user_id, event_id, event_type FROM k QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 30"""


def chat_last_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last twelve turns of each conversation."""
    return C.last_n(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn", 12)


def context_budget_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns, the newest first, until 800 characters are spent."""
    cut = C.budget_prefix(table(spark, sf_dir, "conversations"), "conv_id", F.col("turn").desc(), "text", 800)
    return cut.select("conv_id", "turn", F.md5("text").alias("hash"), F.char_length("text").cast("long").alias("chars"))


BUDGET_SQL = """WITH u AS (SELECT conv_id, turn, text, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM conversations), c AS (SELECT conv_id, turn, substr(text, 1, (800 - used)::BIGINT) AS t FROM u WHERE used < 800)
SELECT conv_id, turn, md5(t) AS hash, length(t) AS chars FROM c"""


# ---- reviews


def _reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    title = F.concat(F.lit("Missing page: User "), F.col("user_id") % 40)
    kind = F.when(F.col("event_type") == "error", "duplicate").otherwise("missing-page")
    described = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("seen "), "event_id")).otherwise("")
    option = F.struct(F.concat(F.lit("do "), "event_id").alias("label"), F.col("event_type").alias("action"))
    return R.with_ids(e.select(F.col("event_id").alias("pos"), kind.alias("type"), title.alias("title"), described.alias("description"), (F.col("event_type") == "purchase").alias("resolved"), F.col("event_id").alias("created_at"), F.array(F.concat(F.lit("p"), F.col("event_id") % 4)).alias("pages"), F.array(F.col("event_type")).alias("queries"), F.array(option).alias("options")))


def review_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as reviews, merged by type and title."""
    m = R.merge(_reviews(spark, sf_dir))
    return m.select("type", F.col("title"), "resolved", "created_at", "description", F.array_join("pages", ",").alias("pages"), F.array_join("queries", ",").alias("queries"), F.array_join(F.transform("options", lambda o: F.concat_ws("=", o.action, o.label)), ",").alias("options"))


REVIEWS_SQL = """e AS (SELECT event_id AS pos, CASE WHEN event_type = 'error' THEN 'duplicate' ELSE 'missing-page' END AS type, 'Missing page: User ' || (user_id % 40) AS title, CASE WHEN event_id % 3 = 0 THEN 'seen ' || event_id END AS d, event_type, 'p' || (event_id % 4) AS page FROM events)"""
MERGE_SQL = f"""WITH {REVIEWS_SQL}, p AS (SELECT type, title, string_agg(page, ',' ORDER BY m) AS pages FROM (SELECT type, title, page, min(pos) AS m FROM e GROUP BY 1, 2, 3) GROUP BY 1, 2),
q AS (SELECT type, title, string_agg(event_type, ',' ORDER BY m) AS queries, string_agg(event_type || '=do ' || m, ',' ORDER BY m) AS options FROM (SELECT type, title, event_type, min(pos) AS m FROM e GROUP BY 1, 2, 3) GROUP BY 1, 2),
g AS (SELECT type, title, bool_or(event_type = 'purchase') AS resolved, min(pos) AS created_at, arg_min(d, pos) FILTER (d IS NOT NULL) AS description FROM e GROUP BY 1, 2)
SELECT * FROM g JOIN p USING (type, title) JOIN q USING (type, title)"""


def review_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten newest open duplicates, merged first."""
    found = R.select(R.merge(_reviews(spark, sf_dir)), resolved=False, kind="duplicate", limit=10)
    return found.select("title", "created_at")


REVIEW_FILTER_SQL = f"""WITH {REVIEWS_SQL} SELECT title, min(pos) AS created_at FROM e WHERE type = 'duplicate' GROUP BY title HAVING NOT bool_or(event_type = 'purchase') ORDER BY 2 DESC LIMIT 10"""


def resolve_all_quantifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of which a part is missing, if every seventh one is."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("p"))
    there = table(spark, sf_dir, "part").where("p_partkey % 7 <> 0").select(F.col("p_partkey").alias("p"), F.lit(True).alias("hit"))
    every = lines.join(there, "p", "left").groupBy("id").agg(F.bool_and(F.coalesce("hit", F.lit(False))).alias("every"))
    return every.where(~F.col("every")).select("id")


def resolve_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of the customers' numbers, moved on by 75, exist, in the order asked."""
    asked = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("pos"), (F.col("c_custkey") + 75).alias("id"))
    return R.resolve_many(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), asked)


# ---- lists, paths, fields


def rebuild_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index: the names of each type of parts, in order without regard to case."""
    from weft.operators.pages import index_sections

    parts = table(spark, sf_dir, "part").select(F.col("p_type").alias("type"), F.col("p_name").alias("title"), F.col("p_partkey").cast("string").alias("target"))
    return index_sections(parts).select("type", "entries", F.md5("section").alias("hash"))


INDEX_SQL = """SELECT p_type AS type, count(*) AS entries, md5('## ' || p_type || chr(10) || string_agg('- [[' || p_partkey || '|' || p_name || ']]', chr(10) ORDER BY lower(p_name), p_partkey::VARCHAR)) AS hash FROM part GROUP BY 1"""


def source_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents after source src3 went: what is left of their sources, and their fate."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.array(F.upper("source"), F.lit("extra"))).otherwise(F.array("source")).alias("sources"))
    rows = docs.withColumn("d", D.delete_decision(F.col("sources"), F.lit("src3")))
    return rows.select("doc_id", "d.decision", F.array_join("d.left", ",").alias("left"))


REMAP_SQL = """WITH s AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN [upper(source), 'extra'] ELSE [source] END AS sources FROM documents), l AS (SELECT *, list_filter(sources, lambda x: lower(x) <> 'src3') AS kept FROM s)
SELECT doc_id, CASE WHEN len(kept) = len(sources) THEN 'skip' WHEN len(kept) = 0 THEN 'delete' ELSE 'keep' END AS decision, array_to_string(kept, ',') AS left FROM l"""


def array_union_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources and languages of documents united without regard to case."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.array_join(D.union_ci(F.array("lang", F.upper("lang"), "source"), F.array(F.upper("source"), F.lit("EN"))), ",").alias("united"))


UNION_SQL = """SELECT doc_id, lang || ',' || source || CASE WHEN lang = 'en' THEN '' ELSE ',EN' END AS united FROM documents"""


def type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("type")).agg(F.count("*").alias("n"))


def category_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files named after pages by the category of their extension."""
    from weft.functions.files import category

    ending = F.element_at(F.array(*map(F.lit, CATEGORY_ENDINGS)), (F.col("page_id") % len(CATEGORY_ENDINGS) + 1).cast("int"))
    path = F.concat(F.lit("raw/sources/p.q/"), F.when(ending.startswith("."), F.concat(F.lit("P"), F.col("page_id").cast("string"))).otherwise(""), ending)
    return table(spark, sf_dir, "pages").select(category(path).alias("category")).groupBy("category").agg(F.count("*").alias("n"))


CATEGORY_ENDINGS = (".md", ".mdx", ".markdown", ".txt", ".RTF", ".py", ".kt", ".svg", ".xml", ".toml", "Dockerfile", "readme", ".png", ".heic", ".mkv", ".m4a", ".wma", ".mmd", ".pdf", ".xlsx", ".key", ".org", ".jsonl", ".yaml")
#: The categories of the endings above, in their order, written out by hand.
CATEGORY_SQL = """SELECT ['markdown', 'markdown', 'unknown', 'text', 'text', 'code', 'code', 'code', 'code', 'code', 'code', 'unknown', 'image', 'image', 'video', 'audio', 'audio', 'code', 'pdf',
    'document', 'document', 'document', 'data', 'data'][page_id % 24 + 1] AS category, count(*) AS n FROM pages GROUP BY 1"""


def watch_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which pages, as paths, a watcher with excluded folders and globs would see."""
    path = F.regexp_replace(F.regexp_replace("url", r"^https?://", "raw/sources/"), r"[?#].*$", "")
    p = table(spark, sf_dir, "pages").select("page_id", path.alias("path"))
    return p.where(T.watched(F.col("path"), folders=["fr", "raw/sources/skip"], globs=["*9", "*a*1*"])).select("page_id")


WATCH_SQL = r"""WITH p AS (SELECT page_id, regexp_replace(regexp_replace(url, '^https?://', 'raw/sources/'), '[?#].*$', '') AS path FROM pages)
SELECT page_id FROM p WHERE NOT regexp_matches(path, '(^|/)\.[^/]') AND NOT contains('/' || path, '/fr/') AND NOT starts_with(path, 'raw/sources/skip/') AND path <> 'raw/sources/skip' AND NOT (path ILIKE '%9') AND NOT (path ILIKE '%a%1%') AND NOT regexp_extract(path, '[^/]*$') ILIKE '%9' AND NOT regexp_extract(path, '[^/]*$') ILIKE '%a%1%'"""


def glob_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").where(T.glob(F.col("url"), "HTTP://*.example.com/??/*")).select("page_id")


def json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field of the events' properties."""
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


def html_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1).alias("title"))


def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = F.explode(F.regexp_extract_all("html", F.lit('(?i)<a\\s[^>]*href="([^"]*)"'), F.lit(1)))
    return table(spark, sf_dir, "pages").select("page_id", links.alias("href")).groupBy("page_id", "href").agg(F.count("*").alias("n"))


def html_fallback_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of pages without scripts, styles, navigation and advertisements: its trimmed lines."""
    from weft.functions.html import fallback_text

    return table(spark, sf_dir, "pages").select("page_id", F.md5(fallback_text(F.col("html"))).alias("hash"))


FALLBACK_SQL = r"""WITH a AS (SELECT page_id, regexp_replace(html, '(?is)<(script|style|nav|header|footer|aside|noscript)\b[^>]*>.*?</(script|style|nav|header|footer|aside|noscript)>|<!--.*?-->|<div[^>]*class="[^"]*\b(ad|ads|advert|advertisement)\b[^"]*"[^>]*>.*?</div>', '', 'g') AS h FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(h, '(?i)</(p|div|h[1-6]|li|tr|article|section|title)>|<br[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g') AS t FROM a),
c AS (SELECT page_id, replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&') AS t FROM b),
l AS (SELECT page_id, list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> '') AS ls FROM c)
SELECT page_id, md5(array_to_string(ls, chr(10))) AS hash FROM l"""


def relevance_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context budgets as columns, for sizes of orders."""
    size = F.floor("o_totalprice").cast("long")
    pages = F.floor(size * 0.5)
    o = table(spark, sf_dir, "orders").where("o_totalprice >= 1")
    return o.select("o_orderkey", pages.cast("long").alias("pages"), F.floor(size * 0.05).cast("long").alias("idx"), F.floor(size * 0.15).cast("long").alias("response"), F.least(pages, F.greatest(F.lit(5000), F.floor(pages * 0.3))).cast("long").alias("page"))


CONTEXT_SQL = """WITH s AS (SELECT o_orderkey, floor(o_totalprice)::BIGINT AS size FROM orders WHERE o_totalprice >= 1), p AS (SELECT *, floor(size * 0.5::DOUBLE) AS pg FROM s)
SELECT o_orderkey, pg::BIGINT AS pages, floor(size * 0.05::DOUBLE)::BIGINT AS idx, floor(size * 0.15::DOUBLE)::BIGINT AS response, least(pg, greatest(5000, floor(pg * 0.3::DOUBLE)))::BIGINT AS page FROM p"""


def review_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that whole passages give as review titles; no SQL for the hash, so tests hold it against plain code."""
    docs = table(spark, sf_dir, "benchmark")
    return docs.select("item_id", M.review_id(F.lit("missing-page"), F.col("text")).alias("review_id"))


def packed_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as clusters of their lines, in batches of at most 80 lines; keys of orders are the order."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("id"), F.col("l_orderkey").alias("cluster"))
    return D.pack_clusters(lines, 80).groupBy("cluster", "batch").agg(F.count("*").alias("members"))


PACKED_SQL = """WITH RECURSIVE c AS (SELECT l_orderkey AS cluster, count(*) AS n FROM lineitem GROUP BY 1), l AS (SELECT *, (sum(n) OVER (ORDER BY cluster))::BIGINT AS e FROM c), p AS (SELECT *, e - n AS s FROM l),
b(start, batch) AS (SELECT 0::BIGINT, 0 UNION ALL SELECT CASE WHEN p.s = b.start THEN p.e ELSE p.s END, batch + 1 FROM b JOIN p ON p.s <= b.start + 80 AND b.start + 80 < p.e)
SELECT p.cluster, b.batch, p.n AS members FROM p ASOF JOIN b ON p.s >= b.start"""


def workspace_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two states of a workspace, the orders of customers in two halves of the time as files: the first 50 changes by path."""
    shot = lambda df: df.select("path", F.col("size").alias("len"), F.lit(None).cast("timestamp").alias("modified"), F.col("hash").alias("signature"))
    return C.workspace_changes(*map(shot, _snapshots(spark, sf_dir)))


WORKSPACE_SQL = f"""WITH {SHOTS_SQL} SELECT new.path, new.size AS bytes, old.path IS NOT NULL AS existed_before FROM new LEFT JOIN old USING (path) WHERE old.path IS NULL OR old.size <> new.size OR old.hash <> new.hash ORDER BY new.path LIMIT 50"""


QUERIES = {
    "packed_clusters": (packed_clusters, PACKED_SQL),
    "workspace_difference": (workspace_difference, WORKSPACE_SQL),
    "cosine_pairs": (cosine_pairs, f"WITH {PAIRS_SQL} SELECT a, b, round(similarity, 6) AS similarity FROM pairs"),
    "knn_topk_pairs": (knn_topk_pairs, f"WITH {ENDS_SQL} SELECT a, b, similarity FROM best"),
    "dedup_clusters": (dedup_clusters, CLUSTER_SQL),
    "whitelist_antijoin": (whitelist_antijoin, f"WITH {PAIRS_SQL} SELECT a, b FROM pairs WHERE a % 2 <> 0"),
    "embedding_coverage": (embedding_coverage, COVERAGE_SQL),
    "exact_duplicates": (exact_duplicates, "SELECT sha256(text) AS hash, count(*) AS copies, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1"),
    "orphans": (orphans, "SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)"),
    "broken_links": (broken_links, "SELECT l_partkey + 50 AS dst, count(*) AS links FROM lineitem WHERE l_partkey + 50 NOT IN (SELECT p_partkey FROM part) GROUP BY 1"),
    "related_by_tokens": (related_by_tokens, RELATED_SQL),
    "fuzzy_name_match": (fuzzy_name_match, FUZZY_SQL),
    "snapshot_diff": (snapshot_diff, DIFF_SQL),
    "move_detection": (move_detection, MOVES_SQL),
    "change_kind_fold": (change_kind_fold, FOLD_SQL),
    "prefix_delete": (prefix_delete, PREFIX_SQL),
    "queue_summary": (queue_summary, QUEUE_SQL),
    "history_last_n": (history_last_n, HISTORY_SQL),
    "chat_last_n": (chat_last_n, "SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 12"),
    "context_budget_prefix": (context_budget_prefix, BUDGET_SQL),
    "context_budget": (relevance_budget, CONTEXT_SQL),
    "review_merge": (review_merge, MERGE_SQL),
    "review_filter": (review_filter, REVIEW_FILTER_SQL),
    "review_ids": (review_ids, None),
    "resolve_all_quantifier": (resolve_all_quantifier, "SELECT l_orderkey AS id FROM lineitem GROUP BY 1 HAVING NOT bool_and(l_partkey % 7 <> 0 AND l_partkey IN (SELECT p_partkey FROM part))"),
    "resolve_many": (resolve_many, "SELECT c_custkey AS pos, c_custkey + 75 AS id, c_custkey + 75 IN (SELECT c_custkey FROM customer) AS found FROM customer"),
    "rebuild_index": (rebuild_index, INDEX_SQL),
    "source_remap": (source_remap, REMAP_SQL),
    "array_union_ci": (array_union_ci, UNION_SQL),
    "type_counts": (type_counts, "SELECT lang AS type, count(*) AS n FROM documents GROUP BY 1"),
    "category_map": (category_map, CATEGORY_SQL),
    "watch_filter": (watch_filter, WATCH_SQL),
    "glob_filter": (glob_filter, "SELECT page_id FROM pages WHERE url ILIKE 'http://%.example.com/__/%'"),
    "json_extract": (json_extract, "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events"),
    "html_title": (html_title, "SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title FROM pages"),
    "html_links": (html_links, """SELECT page_id, href, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?i)<a\\s[^>]*href="([^"]*)"', 1)) AS href FROM pages) GROUP BY 1, 2"""),
    "html_fallback_text": (html_fallback_text, FALLBACK_SQL),
}
