"""Queries over the graph of parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions import measures as M
from weft.operators import graph as G
from weft.operators.components import connected_components
from weft.plans.common import BOTH_SQL, EDGES_SQL, NODES_SQL, edges, nodes
from weft.session import spread, table


def link_graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Undirected links, each once."""
    return edges(spark, sf_dir)


def node_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.degrees(edges(spark, sf_dir))


def graph_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links that are left without two types, isolated nodes and degrees over 12."""
    e = edges(spark, sf_dir)
    return G.filter_graph(nodes(spark, sf_dir, e), e, hidden_types=["query", "synthesis"], structural=True, isolated=True, most=12)[1]


FILTER_SQL = f"""WITH {NODES_SQL}, kept AS (SELECT id FROM nodes WHERE type NOT IN ('query', 'synthesis') AND degree BETWEEN 1 AND 12)
SELECT src, dst, weight FROM edges WHERE src IN (SELECT id FROM kept) AND dst IN (SELECT id FROM kept)"""


def graph_text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    return G.text_search(nodes(spark, sf_dir, e), e, "A 1", ["label", "id", "type"])[0].select("id", "label")


TEXT_SQL = f"""WITH {NODES_SQL}, h AS (SELECT id, label, lower(label || ' ' || id || ' ' || type) AS hay FROM nodes) SELECT id, label FROM h WHERE contains(hay, 'a') AND contains(hay, '1')"""


def graph_api(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    kept, inside = G.api_graph(nodes(spark, sf_dir, e), e, "1", "concept", 200)
    return kept.select("id", "type", "degree").join(G.degrees(inside).withColumnRenamed("degree", "shown"), "id", "left").withColumn("shown", F.coalesce("shown", F.lit(0).cast("long")))


API_SQL = f"""WITH {NODES_SQL}, kept AS (SELECT id, type, degree FROM nodes WHERE (contains(id::VARCHAR, '1') OR contains(lower(label), '1')) AND type = 'concept' ORDER BY id LIMIT 200),
ins AS (SELECT src, dst FROM edges WHERE src IN (SELECT id FROM kept) AND dst IN (SELECT id FROM kept)),
sh AS (SELECT id, count(*) AS shown FROM (SELECT src AS id FROM ins UNION ALL SELECT dst FROM ins) GROUP BY 1)
SELECT id, type, degree, coalesce(shown, 0) AS shown FROM kept LEFT JOIN sh USING (id)"""


def adamic_adar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adamic-Adar of linked parts."""
    e = edges(spark, sf_dir)
    found = G.common_neighbors(e, e.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    return found.select("a", "b", F.round("adamic_adar", 6).alias("adamic_adar"))


AA_SQL = f"""WITH {BOTH_SQL}, w AS (SELECT src AS c, 1 / ln(greatest(count(*), 2)) AS w FROM nbr GROUP BY 1)
SELECT e.src AS a, e.dst AS b, round(sum(w.w), 6) AS adamic_adar FROM edges e JOIN nbr x ON x.src = e.src JOIN nbr y ON y.src = e.dst AND y.dst = x.dst JOIN w ON w.c = x.dst GROUP BY 1, 2"""


def common_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of parts with three common neighbours and more."""
    return G.common_neighbors(edges(spark, sf_dir)).where("common >= 3").select("a", "b", "common")


COMMON_SQL = f"""WITH {BOTH_SQL} SELECT x.src AS a, y.src AS b, count(*) AS common FROM nbr x JOIN nbr y ON x.dst = y.dst AND x.src < y.src GROUP BY 1, 2 HAVING count(*) >= 3"""


def type_affinity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links by the types they connect, with the affinity of these."""
    e = edges(spark, sf_dir)
    n = spread(nodes(spark, sf_dir, e).select("id", "type"))
    rows = e.join(n.select(F.col("id").alias("src"), F.col("type").alias("ta")), "src").join(n.select(F.col("id").alias("dst"), F.col("type").alias("tb")), "dst")
    return rows.groupBy("ta", "tb").agg(F.count("*").alias("links")).select("ta", "tb", "links", G.affinity(F.col("ta"), F.col("tb")).alias("affinity"))


_AFFINITY_ROWS = ", ".join(f"('{a}', '{b}', {v}::DOUBLE)" for a, row in M.TYPE_AFFINITY.items() for b, v in row.items())
AFFINITY_SQL = f"""WITH {NODES_SQL}, aff(ta, tb, v) AS (VALUES {_AFFINITY_ROWS}), l AS (SELECT s.type AS ta, t.type AS tb, count(*) AS links FROM edges JOIN nodes s ON src = s.id JOIN nodes t ON dst = t.id GROUP BY 1, 2)
SELECT ta, tb, links, coalesce(v, 0.5::DOUBLE) AS affinity FROM l LEFT JOIN aff USING (ta, tb)"""


def relevance_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relevance of linked parts; a part's source is its brand."""
    e = edges(spark, sf_dir)
    brands = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array("p_brand").alias("sources"))
    n = nodes(spark, sf_dir, e).select("id", "type").join(spread(brands), "id")
    return G.relevance(e.select(F.col("src").alias("a"), F.col("dst").alias("b")), e, n).select("a", "b", F.round("relevance", 6).alias("relevance"))


RELEVANCE_SQL = f"""WITH {NODES_SQL}, aff(ta, tb, v) AS (VALUES {_AFFINITY_ROWS}), w AS (SELECT src AS c, 1 / ln(greatest(count(*), 2)) AS w FROM nbr GROUP BY 1),
aa AS (SELECT e.src, e.dst, sum(w.w) AS aa FROM edges e JOIN nbr x ON x.src = e.src JOIN nbr y ON y.src = e.dst AND y.dst = x.dst JOIN w ON w.c = x.dst GROUP BY 1, 2)
SELECT e.src AS a, e.dst AS b, round(3 + (CASE WHEN ps.p_brand = pt.p_brand THEN 4 ELSE 0 END) + coalesce(aa, 0) * 1.5 + coalesce(v, 0.5), 6)::DOUBLE AS relevance
FROM edges e JOIN nodes s ON e.src = s.id JOIN nodes t ON e.dst = t.id JOIN part ps ON ps.p_partkey = e.src JOIN part pt ON pt.p_partkey = e.dst
LEFT JOIN aff ON aff.ta = s.type AND aff.tb = t.type LEFT JOIN aa ON aa.src = e.src AND aa.dst = e.dst"""


def community_cohesion(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    found = G.communities(nodes(spark, sf_dir, e), e)
    return found.select(F.col("community").cast("long").alias("community"), F.col("number").cast("long").alias("number"), "size", "intra", F.round("cohesion", 9).alias("cohesion"), "top_labels")


COHESION_SQL = f"""WITH {NODES_SQL}, i AS (SELECT s.community, count(*) AS intra FROM edges JOIN nodes s ON src = s.id JOIN nodes t ON dst = t.id AND s.community = t.community GROUP BY 1),
sz AS (SELECT community, count(*) AS size FROM nodes GROUP BY 1),
r AS (SELECT community, label, row_number() OVER (PARTITION BY community ORDER BY degree DESC, label) AS r FROM nodes QUALIFY r <= 5),
tl AS (SELECT community, string_agg(label, ', ' ORDER BY r) AS top_labels FROM r GROUP BY 1)
SELECT community::BIGINT AS community, row_number() OVER (ORDER BY size DESC, community) - 1 AS number, size, coalesce(intra, 0) AS intra,
round(coalesce(intra, 0) / (CASE WHEN size > 1 THEN size * (size - 1) / 2 ELSE 1 END), 9)::DOUBLE AS cohesion, top_labels FROM sz LEFT JOIN i USING (community) JOIN tl USING (community)"""


def bridge_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    return G.bridges(nodes(spark, sf_dir, e), e)


BRIDGE_SQL = f"""WITH {NODES_SQL} SELECT n.src AS id, count(DISTINCT t.community) AS n_communities FROM nbr n JOIN nodes t ON n.dst = t.id GROUP BY 1 HAVING count(DISTINCT t.community) >= 3 ORDER BY 2 DESC, 1 LIMIT 3"""


def isolated_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with at most one link."""
    e = edges(spark, sf_dir)
    return nodes(spark, sf_dir, e).where("degree <= 1").select("id", "degree")


def surprising_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All links of a surprise of three and more."""
    e = edges(spark, sf_dir)
    return G.surprising(nodes(spark, sf_dir, e), e.withColumn("weight", F.col("weight") / 2.0)).select("src", "dst", F.col("score").cast("long").alias("score"), "reasons")


_FAR = " OR ".join(f"(ts = '{a}' AND tt = '{b}')" for a, b in M.DISTANT_TYPES)
SURPRISE_SQL = f"""WITH {NODES_SQL}, m AS (SELECT greatest(max(degree), 1) AS most FROM nodes),
r AS (SELECT src, dst, weight / 2.0 AS weight, s.type AS ts, t.type AS tt, s.community AS cs, t.community AS ct, s.degree AS ds, t.degree AS dt, most FROM edges JOIN nodes s ON src = s.id JOIN nodes t ON dst = t.id, m),
p AS (SELECT *, CASE WHEN cs <> ct THEN 3 ELSE 0 END AS a, CASE WHEN ts = tt THEN 0 WHEN {_FAR} THEN 2 ELSE 1 END AS b, CASE WHEN least(ds, dt) <= 2 AND greatest(ds, dt) >= most * 0.5 THEN 2 ELSE 0 END AS c, CASE WHEN weight > 0 AND weight < 2 THEN 1 ELSE 0 END AS d FROM r)
SELECT src, dst, (a + b + c + d)::BIGINT AS score, concat_ws('; ', CASE WHEN a > 0 THEN 'crosses community boundary' END, CASE WHEN b = 2 THEN 'connects ' || ts || ' to ' || tt WHEN b = 1 THEN 'different types' END, CASE WHEN c > 0 THEN 'peripheral node links to hub' END, CASE WHEN d > 0 THEN 'weak but present connection' END) AS reasons FROM p WHERE a + b + c + d >= 3"""


def connected_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all links."""
    return connected_components(edges(spark, sf_dir).select(F.col("src").alias("u"), F.col("dst").alias("v"))).select(F.col("node").alias("id"), "component")


#: One row for each part, lowered until nothing changes.
COMPONENT_SQL = f"""WITH RECURSIVE {EDGES_SQL}, nbr AS (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges), least(id, component) USING KEY (id) AS (
    SELECT src, src FROM nbr GROUP BY 1
    UNION
    SELECT nbr.dst, min(least.component) FROM least JOIN nbr ON nbr.src = least.id JOIN recurring.least AS r ON r.id = nbr.dst WHERE least.component < r.component GROUP BY 1
) SELECT id, component FROM least"""


def louvain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Communities of all links by modularity, with the modularity that they reach."""
    return G.louvain(edges(spark, sf_dir)).select("id", "community", F.round("modularity", 9).alias("modularity"))


def backlinks_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outgoing, backward and missing links of parts: every third part is taken for missing."""
    e = edges(spark, sf_dir)
    links = e.select("src", F.col("dst").alias("raw"))
    there = table(spark, sf_dir, "part").where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("dst"))
    resolved = links.join(spread(there), links.raw == there.dst).select("src", "dst", "raw")
    out, back, missing = G.page_links(there, resolved, links)
    return out.withColumn("kind", F.lit("out")).unionByName(back.withColumn("kind", F.lit("back"))).unionByName(missing.withColumn("kind", F.lit("missing")))


BACK_SQL = f"""WITH {EDGES_SQL} SELECT src AS page, dst AS other, 'out' AS kind FROM edges WHERE dst % 3 <> 0 UNION ALL SELECT dst, src, 'back' FROM edges WHERE dst % 3 <> 0 UNION ALL SELECT src, dst, 'missing' FROM edges WHERE dst % 3 = 0"""


def graph_keyword_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    return G.graph_hits(nodes(spark, sf_dir, e), e, F.contains(F.lower("label"), F.lit("7")), 10)


HITS_SQL = f"""WITH {NODES_SQL}, un AS (SELECT DISTINCT src, dst FROM nbr), l AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) AS r FROM un QUALIFY r <= 20),
m AS (SELECT id FROM nodes WHERE contains(lower(label), '7')), near AS (SELECT DISTINCT src AS id FROM l WHERE dst IN (SELECT id FROM m))
SELECT id, (CASE WHEN id IN (SELECT id FROM m) THEN 10000 ELSE 5000 END) + degree AS score FROM nodes WHERE id IN (SELECT id FROM m) OR id IN (SELECT id FROM near) ORDER BY 2 DESC, 1 LIMIT 10"""


def source_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold passages in common sources: suppliers that share three parts and more."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("id"), F.col("l_orderkey").alias("source"))
    return G.shared_sources(lines, lines.count(), once=True).where("shared >= 3")


OVERLAP_SQL = """WITH l AS (SELECT DISTINCT l_suppkey AS id, l_orderkey AS source FROM lineitem) SELECT x.id AS a, y.id AS b, count(*) AS shared FROM l x JOIN l y USING (source) WHERE x.id < y.id GROUP BY 1, 2 HAVING count(*) >= 3"""

QUERIES = {
    "link_graph_edges": (link_graph_edges, f"WITH {EDGES_SQL} SELECT src, dst, weight FROM edges"),
    "node_degree": (node_degree, f"WITH {BOTH_SQL} SELECT src AS id, count(*) AS degree FROM nbr GROUP BY 1"),
    "graph_filter": (graph_filter, FILTER_SQL),
    "graph_text_search": (graph_text_search, TEXT_SQL),
    "graph_api": (graph_api, API_SQL),
    "adamic_adar": (adamic_adar, AA_SQL),
    "common_neighbors": (common_neighbors, COMMON_SQL),
    "type_affinity": (type_affinity, AFFINITY_SQL),
    "relevance_score": (relevance_score, RELEVANCE_SQL),
    "community_cohesion": (community_cohesion, COHESION_SQL),
    "bridge_nodes": (bridge_nodes, BRIDGE_SQL),
    "isolated_nodes": (isolated_nodes, f"WITH {NODES_SQL} SELECT id, degree FROM nodes WHERE degree <= 1"),
    "surprising_links": (surprising_links, SURPRISE_SQL),
    "connected_components": (connected_parts, COMPONENT_SQL),
    "louvain": (louvain, None),
    "backlinks_missing": (backlinks_missing, BACK_SQL),
    "graph_keyword_hits": (graph_keyword_hits, HITS_SQL),
    "source_overlap": (source_overlap, OVERLAP_SQL),
}
