"""Source divergence audit: how far the term shares of each source of a language are from those of its other sources.

Texts are cut into terms and counted inside the tasks that read them; only (lang, source, term) sums are shuffled, to
hash shards of (lang, term). In each shard DuckDB sums the counts and keeps the terms with enough documents of
their language. Spark adds up the groups' totals; then DuckDB works the shares out shard by shard, giving the best
terms of each group and the part of each pair of groups that depends on the terms both hold. The rest of a pair's sum
needs no term: a term that one of the two lacks counts there with that group's least share, so a histogram of the
other group's shares is enough. Spark merges partial sums and rankings. All sums are whole numbers.

A hot language is spread over the shards by its terms, a hot source has one row for each term. A shard holds the sums of its terms only.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.llm.arrow import pieces
from weft.session import materialize

SCALE = 1_000_000_000
#: Sums that a task holds before it passes them on.
HELD = 200_000
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x61 and b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
COUNTED = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def terms(text: bytes | None) -> list[bytes]:
    """The runs of letters and of characters beyond ASCII of a text in UTF-8, with A-Z in lower case."""
    return (text or b"").translate(_FOLD).split(b" ") if text else []


def count_terms(docs: DataFrame) -> DataFrame:
    """``(lang, source, term, n, docs)``: occurrences and texts of each term, added up as far as a task's memory bound goes. A
    group's row with an empty term counts its texts, so that groups without a term are there."""

    def emit(held: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, seen) in held.items():
            words = list(n)
            yield pa.record_batch([pa.array([lang] * len(words), pa.string()), pa.array([source] * len(words), pa.string()), pa.array(words, pa.binary()).cast(pa.string()), pa.array(n.values(), pa.int64()), pa.array([seen[w] for w in words], pa.int64())], schema=COUNTED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = defaultdict(lambda: (Counter(), Counter()))
        for batch, texts in pieces(batches, "text"):
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts, strict=True):
                n, seen = held[lang, source]
                found = terms(text)
                found.append(b"")
                n.update(found)
                seen.update(set(found))
            if sum(len(n) for n, _ in held.values()) > HELD:
                yield from emit(held)
                held.clear()
        yield from emit(held)

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return docs.select(text("lang"), text("source"), text("text")).mapInArrow(run, "lang string, source string, term string, n long, docs long")


#: Sums of one shard; terms in at least {least} documents of their language. ``lead`` marks one row of each term.
_KEPT = """
WITH c AS (SELECT lang, source, term, sum(n)::BIGINT AS n, sum(docs) AS docs FROM part GROUP BY ALL),
t AS (SELECT *, sum(docs) OVER w AS all_docs, (sum(n) OVER w)::BIGINT AS total, row_number() OVER (PARTITION BY lang, term ORDER BY source) AS nth FROM c WINDOW w AS (PARTITION BY lang, term))
SELECT lang, source, term, n, total, nth = 1 AS lead FROM t WHERE all_docs >= {least}
"""
#: p and q: shares of group and language; ``base``: the share of a term that a group lacks.
_SHARES = f"""
CREATE TEMP TABLE s AS SELECT lang, source, term, 1 + ({SCALE}::HUGEINT * (n + 1)) // (group_n + terms) AS p, 1 + {SCALE}::HUGEINT // (group_n + terms) AS base,
    1 + ({SCALE}::HUGEINT * (total + 1)) // (lang_n + terms) AS q FROM part
"""
_TERMS = """
SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // q)::DECIMAL(38, 0) AS value FROM s WHERE p > q
QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, term COLLATE "binary") <= {most}
"""
_PAIRS = """
SELECT a.lang AS lang, a.source AS source, 'pair' AS part, b.source AS item,
    sum((a.p - b.p) * (a.p - b.p) // b.p - (a.p - b.base) * (a.p - b.base) // b.base - (a.base - b.p) * (a.base - b.p) // b.p + (a.base - b.base) * (a.base - b.base) // b.base)::DECIMAL(38, 0) AS value
FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
"""
_SHARE_ROWS = "SELECT lang, source, 'share' AS part, p::VARCHAR AS item, count(*)::DECIMAL(38, 0) AS value FROM s GROUP BY ALL"


def _shards(rows: DataFrame, statements: list[str], schema: str) -> DataFrame:
    """The rows of SQL over each shard of (lang, term): statements with a result give rows, ``part`` is the shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        first = next(batches, None)
        if first is None:
            return
        with duckdb.connect(config={"threads": 1, "memory_limit": "900MB"}) as db:
            db.execute("SET arrow_large_buffer_size = false")
            part = pa.RecordBatchReader.from_batches(first.schema, (b for group in ([first], batches) for b in group))
            db.register("part", part)
            for sql in statements:
                if sql.lstrip().startswith("CREATE"):
                    db.execute(sql)
                else:
                    yield from db.sql(sql).to_arrow_reader(50_000)

    return rows.repartition("lang", "term").mapInArrow(run, schema)


def kept_terms(docs: DataFrame, least_docs: int = 3) -> tuple[DataFrame, DataFrame]:
    """``(lang, source, term, n, total, lead)`` of the terms in at least ``least_docs`` documents of their language, and the ``(lang, source)`` groups that occur."""
    counted = count_terms(docs)
    counted = materialize(counted, "terms")
    groups = counted.where("term = ''").select("lang", "source").distinct()
    kept = _shards(counted.where("term <> ''"), [_KEPT.format(least=int(least_docs))], "lang string, source string, term string, n long, total long, lead boolean")
    return materialize(kept, "kept"), materialize(groups, "groups")


def _distance(p: str, q: str) -> str:
    return f"((CAST({p} AS DECIMAL(20, 0)) - {q}) * (CAST({p} AS DECIMAL(20, 0)) - {q})) div {q}"


def audit(docs: DataFrame, least_docs: int = 3, most_terms: int = 200) -> DataFrame:
    """``(lang, source, part, item, value, rank)`` for every group (lang, source) of ``docs`` (text, lang, source).

    With count c of a term, N the sum over the V kept terms of the language, a group's (and a language's) share is
    1 + floor(10^9 (c + 1) / (N + V)), and the distance of p from q is floor((p - q)^2 / q). Part ``pair``: every other source of the
    language, by the sum of distances over all kept terms (0 without one). Part ``term``: terms of the group with a share over the
    language's, by distance, the first ``most_terms``. Ranks go from 1 by value, descending, then by item in UTF-8 order.

    Nulls in the three columns count as ''; every row is a document, repeated ones too; a language with one source has no
    pairs; an empty table gives no rows. Extra columns are ignored.
    """
    kept, groups = kept_terms(docs, least_docs)
    langs = kept.groupBy("lang").agg(F.sum("n").alias("lang_n"), F.count_if("lead").alias("terms"))
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("group_n"), F.count("*").alias("own"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    totals = materialize(groups.join(sums, ["lang", "source"], "left").join(langs, "lang", "left").select("lang", "source", zero("group_n"), zero("own"), zero("lang_n"), zero("terms")), "totals")

    rows = kept.select("lang", "source", "term", "n", "total").join(totals.drop("own"), ["lang", "source"])
    merged = "lang string, source string, part string, item string, value decimal(38,0)"
    found = materialize(_shards(rows, [_SHARES, _TERMS.format(most=int(most_terms)), _PAIRS, _SHARE_ROWS], merged), "shards")

    best = found.where("part = 'term'").select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"))

    side = totals.where("terms > 0").select("lang", "source", "own", "terms", F.expr(f"1 + {SCALE} div (group_n + terms)").alias("base"))
    shares = found.where("part = 'share'").groupBy("lang", "source", F.col("item").cast("long").alias("p")).agg(F.sum("value").alias("k"))
    other = side.select("lang", F.col("source").alias("other"), F.col("base").alias("other_base"))
    against = shares.join(other, "lang").where("source <> other")
    times = "CAST(k AS DECIMAL(18, 0)) * CAST({} AS DECIMAL(20, 0))"
    lacking = against.groupBy("lang", "source", "other").agg(F.sum(F.expr(times.format(_distance("p", "other_base")))).alias("mine"), F.sum(F.expr(times.format(_distance("other_base", "p")))).alias("theirs"))
    parts = lacking.select("lang", "source", F.col("other").alias("item"), F.col("mine").cast("decimal(38,0)").alias("value"))
    parts = parts.unionByName(lacking.select("lang", F.col("other").alias("source"), F.col("source").alias("item"), F.col("theirs").cast("decimal(38,0)").alias("value")))
    parts = parts.unionByName(found.where("part = 'pair'").select("lang", "source", "item", "value"))

    pair = totals.select("lang", "source", "terms", "own", F.expr(f"1 + {SCALE} div greatest(group_n + terms, 1)").alias("p"))
    pair = pair.join(pair.select("lang", F.col("source").alias("item"), F.col("own").alias("item_own"), F.col("p").alias("q")), "lang").where("source <> item")
    neither = pair.select("lang", "source", "item", F.expr(f"CAST((terms - own - item_own) AS DECIMAL(18, 0)) * CAST({_distance('p', 'q')} AS DECIMAL(20, 0))").cast("decimal(38,0)").alias("value"))
    pairs = parts.unionByName(neither).groupBy("lang", "source", "item").agg(F.sum("value").cast("long").alias("value")).withColumn("part", F.lit("pair"))

    order = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")
    ranked = best.unionByName(pairs.select(*best.columns)).withColumn("rank", F.row_number().over(order))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= most_terms)).select("lang", "source", "part", "item", "value", "rank")
