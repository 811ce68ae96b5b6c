"""The registered queries of the operators: whole tables, production parameters, full results."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import caps, divergence, language, licenses, line_dedup, packing, patterns, pieces, pii, quality, simhash, token_files, vptree
from weft.session import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vptree.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_dedup(table(spark, sf_dir, "documents"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), with_ids=False)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths are tokens of the piece model."""
    counted = pieces.count(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return packing.pack(counted, length=F.col("n_pieces"), unit="piece_bpe_32k tokens")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(table(spark, sf_dir, "documents"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    manifest = token_files.write(docs, public_tokenizers.path("byte_bpe_50k.json"), token_files.output_folder(docs))
    return token_files.read(manifest)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_repeated", "n_similar", F.char_length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's path is its source, as a directory, and its id; without a source it has none."""
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"))
    return licenses.scan(table(spark, sf_dir, "documents"), path)


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    found = language.identify(docs, remainder != 1)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


def op11_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.mine(patterns.click_events(table(spark, sf_dir, "clicks")))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return caps.near_dedup(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Query]:
    found = (op1_vptree, op2_quality, op3_simhash, op4_sentencepiece, op5_packing, op6_pii, op7_token_files, op8_line_dedup, op9_licenses, op10_language, op11_patterns, op12_divergence, op13_caps)
    return {f.__name__: f for f in found}


#: Brute force over all pairs; products are summed component by component, as the operator does.
OP1_SQL = """
WITH v AS (
    SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.e, c.e) AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), ranked AS (
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""


_BLANKS = "[\\x20\\x09-\\x0D]"

_STOP = ", ".join(f"'{w}'" for w in dict.fromkeys(quality.STOP_WORDS))
_VERDICT = " AND ".join(part for name, least, most in quality.RULES for part in ([f"{name} >= {least}"] if least is not None else []) + ([f"{name} <= {most}"] if most is not None else []))
OP2_SQL = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (
    SELECT doc_id, text, list_filter(string_split_regex(text, '{_BLANKS}+'), lambda x: x <> '') AS words,
        list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS lines FROM t
), places AS (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3
), rep AS (SELECT doc_id, i FROM places QUALIFY count(*) OVER (PARTITION BY doc_id, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) > 1
), cover AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM rep) GROUP BY 1
), c AS (
    SELECT w.doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
        length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
        len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(cover.n, 0) AS n_repeat_words, len(lines) AS n_lines,
        len(list_filter(words, lambda x: lower(rtrim(x, '.,;:!?')) IN ({_STOP}))) AS n_stop,
        len(list_filter(lines, lambda l: regexp_matches(l, '(\\.\\.\\.|…){_BLANKS}*$'))) AS n_ellipsis,
        len(list_filter(lines, lambda l: regexp_matches(l, '^{_BLANKS}*[-*•]'))) AS n_bullet
    FROM w LEFT JOIN cover ON w.doc_id = cover.doc_id
), r AS (
    SELECT *, word_chars / greatest(n_words, 1) AS mean_word_chars, n_symbols / greatest(n_words, 1) AS symbol_ratio, n_stop / greatest(n_words, 1) AS stop_ratio,
        n_dup_lines / greatest(n_lines, 1) AS dup_line_ratio, n_repeat_words / greatest(n_words, 1) AS repeat_word_ratio,
        n_ellipsis / greatest(n_lines, 1) AS ellipsis_line_ratio, n_bullet / greatest(n_lines, 1) AS bullet_line_ratio,
        n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {_VERDICT} AS kept,
    mean_word_chars, symbol_ratio, stop_ratio, dup_line_ratio, repeat_word_ratio, ellipsis_line_ratio, bullet_line_ratio FROM r
"""


def _crc32(text: str) -> str:
    """The CRC-32 of a text of digits, byte by byte; ``crc`` holds the table."""
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda d: ascii(d)::BIGINT)), lambda c, b: xor(c >> 8, crc.list[(xor(c, b) & 255) + 1])), 4294967295)"


_STEP = "xor(({0}) >> 1, 3988292384 * (({0}) & 1))"
_TABLE = "i"
for _ in range(8):
    _TABLE = f"list_reduce([{_TABLE}, 0], lambda x, y: {_STEP.format('x')})"
_WINDOW = "e.t > p.t AND e.t - p.t <= 600000000"


def _longer(n: int) -> str:
    """Patterns of n types by end, each with its latest start; times are in slots of the gap's length so that only near events meet."""
    near = " UNION ALL ".join(f"SELECT p.client, list_append(p.types, e.type) AS types, e.t, max(p.start) AS start FROM l{n - 1} p JOIN ev e ON e.client = p.client AND e.slot = p.t // 600000000 + {k} AND {_WINDOW} GROUP BY ALL" for k in (0, 1))
    return f"l{n} AS MATERIALIZED (SELECT client, types, t, max(start) AS start FROM ({near}) WHERE t - start <= 1200000000 GROUP BY ALL)"


#: Patterns grow event by event, an occurrence being known by its end and its latest start.
OP11_SQL = f"""
WITH crc AS (SELECT list(v ORDER BY i) AS list FROM (SELECT i, {_TABLE} AS v FROM (SELECT unnest(range(256))::BIGINT AS i))),
c AS (SELECT client_id AS client, epoch_us(ts) AS t, kind AS type, {_crc32("click_id::VARCHAR")} % 5 = 0 AS more FROM clicks, crc WHERE client_id IS NOT NULL AND ts IS NOT NULL AND kind IS NOT NULL),
ev AS MATERIALIZED (SELECT DISTINCT *, t // 600000000 AS slot FROM (SELECT client, t, type FROM c UNION ALL SELECT client, t - 1000000, 'open' FROM c WHERE more UNION ALL SELECT client, t + 1000000, 'shut' FROM c WHERE more)),
l1 AS (SELECT client, [type] AS types, t, t AS start FROM ev), {_longer(2)}, {_longer(3)}, {_longer(4)},
held AS (SELECT DISTINCT client, types FROM (SELECT client, types FROM l1 UNION ALL SELECT client, types FROM l2 UNION ALL SELECT client, types FROM l3 UNION ALL SELECT client, types FROM l4)),
sums AS (SELECT client, {_crc32("client::VARCHAR")} AS v FROM (SELECT DISTINCT client FROM ev), crc),
kept AS (SELECT types, count(*) AS support, sum(v)::BIGINT AS clients_crc FROM held JOIN sums USING (client) GROUP BY 1 HAVING count(*) >= 2 AND count(*) * 100 >= 10 * (SELECT count(*) FROM sums)),
parts AS (SELECT DISTINCT types, support, list_filter(types, lambda x, i: (mask >> (i - 1)) & 1 = 1) AS part FROM (SELECT types, support, unnest(range(1, (1 << len(types)) - 1)) AS mask FROM kept)),
wider AS (SELECT k.types, count(*) AS n FROM kept k JOIN parts p ON p.part = k.types AND p.support = k.support GROUP BY 1)
SELECT array_to_string(types, '>') AS pattern, len(types)::INTEGER AS length, support, clients_crc, coalesce(n, 0) AS n_wider, n IS NULL AS closed FROM kept LEFT JOIN wider USING (types)
"""

_F = "((p - q) * (p - q) // q)"
OP12_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
t AS (SELECT id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY 1, 2 HAVING count(DISTINCT id) >= 3),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY 1), g AS (SELECT DISTINCT lang, source FROM d),
n AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
gn AS (SELECT lang, source, sum(n)::BIGINT AS total FROM n GROUP BY ALL), l0 AS (SELECT lang, term, sum(n)::BIGINT AS c FROM n GROUP BY ALL), ln AS (SELECT lang, term, c, (sum(c) OVER (PARTITION BY lang))::BIGINT AS total FROM l0),
s AS (SELECT g.lang, g.source, k.term, coalesce(n.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(n.n, 0) + 1) // (coalesce(gn.total, 0) + v.v) AS p
    FROM g JOIN kept k USING (lang) JOIN v USING (lang) LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = k.term LEFT JOIN gn ON gn.lang = g.lang AND gn.source = g.source),
pv AS (SELECT a.lang, a.source, a.item, coalesce(sum(f), 0)::BIGINT AS value FROM (SELECT a.lang, a.source, b.source AS item FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source) a
    LEFT JOIN (SELECT a.lang, a.source, b.source AS item, (a.p - b.p) * (a.p - b.p) // b.p AS f FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source) x USING (lang, source, item) GROUP BY ALL),
tv AS (SELECT lang, source, term AS item, {_F}::BIGINT AS value FROM (SELECT s.*, 1 + 1000000000::HUGEINT * (ln.c + 1) // (ln.total + v.v) AS q FROM s JOIN ln USING (lang, term) JOIN v USING (lang)) WHERE n > 0 AND p > q),
r AS (SELECT *, 'pair' AS part FROM pv UNION ALL SELECT *, 'term' AS part FROM tv),
o AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM r)
SELECT lang, source, part, item, value, rank FROM o WHERE part = 'pair' OR rank <= 200
"""

OP13_SQL = """
WITH RECURSIVE v AS (
    SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93),
reach(id, r) AS (SELECT a, a FROM l UNION SELECT reach.id, l.b FROM reach JOIN l ON reach.r = l.a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY 1), c AS (SELECT id AS vec_id, min(r) AS component_id FROM reach GROUP BY 1)
SELECT vec_id, coalesce(n_links, 0) AS n_links, coalesce(component_id, vec_id) AS component_id, coalesce(component_id, vec_id) = vec_id AS kept FROM embeddings LEFT JOIN n USING (vec_id) LEFT JOIN c USING (vec_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_vptree": OP1_SQL, "op2_quality": OP2_SQL, "op11_patterns": OP11_SQL, "op12_divergence": OP12_SQL, "op13_caps": OP13_SQL}
