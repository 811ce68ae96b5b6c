"""Relations that several queries share: links between parts, and SQL for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.operators.graph import PAIRS_A_ROW
from weft.session import dealt, spread, table

SUPPORT = 2
TYPES = ("entity", "concept", "source", "query", "synthesis")

#: Parts that stand together in two orders and more, each pair once; an order has a few lines, so the join is linear in orders.
EDGES_SQL = """edges AS (
    SELECT a.l_partkey AS src, b.l_partkey AS dst, count(*) AS weight
    FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey
    GROUP BY 1, 2 HAVING count(*) >= 2
)"""
BOTH_SQL = EDGES_SQL + ", nbr AS (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges)"
TYPE_SQL = "CASE p_size % 5 WHEN 0 THEN 'entity' WHEN 1 THEN 'concept' WHEN 2 THEN 'source' WHEN 3 THEN 'query' ELSE 'synthesis' END"
NODES_SQL = BOTH_SQL + f""", deg AS (SELECT src AS id, count(*) AS degree FROM nbr GROUP BY 1),
nodes AS (SELECT p_partkey AS id, p_name AS label, {TYPE_SQL} AS type, p_size // 5 AS community, coalesce(degree, 0) AS degree FROM part LEFT JOIN deg ON p_partkey = id)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of ``EDGES_SQL``; orders and pairs are dealt by the number of lines."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    n = lines.count()
    lines = dealt(lines, n, "l_orderkey")
    a, b = lines.withColumnRenamed("l_partkey", "src"), lines.withColumnRenamed("l_partkey", "dst")
    pairs = a.join(b, "l_orderkey").where("src < dst").select("src", "dst")
    return dealt(pairs, PAIRS_A_ROW * n, "src", "dst").groupBy("src", "dst").agg(F.count("*").alias("weight")).where(F.col("weight") >= SUPPORT)


def part_type():
    out = F.lit(TYPES[4])
    for i in range(4):
        out = F.when(F.col("p_size") % 5 == i, TYPES[i]).otherwise(out)
    return out


def nodes(spark: SparkSession, sf_dir: str, e: DataFrame) -> DataFrame:
    from weft.operators.graph import degrees

    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("label"), part_type().alias("type"), F.floor(F.col("p_size") / 5).cast("int").alias("community"))
    return spread(parts).join(degrees(e), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0).cast("long")))
