"""Steps whose tasks must stay the same size when tables grow."""

import random
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from weft import session
from weft.functions import html, languages
from weft.functions import text as T
from weft.operators import dedup as D
from weft.operators import graph as G
from weft.operators import lifecycle
from weft.operators import lint as L
from weft.plans import common, graph_queries, lifecycle_queries


def test_edges_are_dealt_by_the_number_of_lines(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "ROWS_A_TASK", 100)
    rng = random.Random(1)
    lines = [(rng.randrange(400), rng.randrange(12)) for _ in range(1500)] + [(None, 3), (5, None)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    e = common.edges(spark, str(tmp_path))
    assert e.rdd.getNumPartitions() >= 45
    want = {}
    for o, p in lines:
        for q, r in lines:
            if o is not None and o == q and None not in (p, r) and p < r:
                want[p, r] = want.get((p, r), 0) + 1
    assert {(r.src, r.dst): r.weight for r in e.collect()} == {k: v for k, v in want.items() if v >= common.SUPPORT}


@pytest.mark.parametrize("name", ["type_affinity", "community_cohesion", "graph_filter", "relevance_score", "bridge_nodes", "backlinks_missing"])
def test_parts_are_joined_by_key_and_not_sent_whole(spark, name):
    least = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10000b")  # over the parts of sf0.001, under its lines, as at size
    try:
        plan = graph_queries.QUERIES[name][0](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", least)
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def _readings_of_lines(rows) -> int:
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    return sum("Relation [" in line and "l_orderkey" in line for line in plan.splitlines())


@pytest.mark.parametrize("name, uses", [("isolated_nodes", 1), ("node_degree", 1)])
def test_links_are_worked_out_once_for_both_directions(spark, name, uses):
    rows = graph_queries.QUERIES[name][0](spark, "/root/testdata/sf0.001")
    assert 0 < _readings_of_lines(rows) <= 2 * uses  # a use of the links joins the lines with themselves


def test_knowledge_context_works_links_out_once(spark):
    assert 0 < _readings_of_lines(lifecycle_queries.knowledge_context(spark, "/root/testdata/sf0.001")) <= 2


def test_knowledge_context_of_repeated_links_loops_and_nulls(spark):
    links = spark.createDataFrame([(1, 3), (1, 2), (1, 2), (2, 2), (4, None), (None, 4)], "src long, dst long")
    found = lifecycle.knowledge_context(spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 9)], "id long"), links, 1).collect()
    assert {tuple(map(str, r)) for r in found} == {("1", "[2]", "[]", "2"), ("2", "[2]", "[1]", "3"), ("3", "[]", "[1]", "1"), ("4", "[]", "[]", "0"), ("9", "[]", "[]", "0")}


def test_degrees_of_repeated_edges_loops_and_nulls(spark):
    edges = spark.createDataFrame([(1, 2), (1, 2), (3, 3), (None, 4), (5, None)], "src long, dst long")
    assert {(r.id, r.degree) for r in G.degrees(edges).collect()} == {(1, 2), (2, 2), (3, 2), (4, 1), (5, 1), (None, 2)}


def test_louvain_rounds_join_links_once_and_tell_what_they_started_from(spark, monkeypatch):
    links = [(i, (i * 7 + 3) % 20, float(1 + i % 3)) for i in range(20)] + [(i, i + 1, 1.0) for i in range(19)]
    edges = spark.createDataFrame(links, "src long, dst long, weight double")
    graph = edges.selectExpr("src as u", "dst as v", "weight as w").unionByName(edges.selectExpr("dst as u", "src as v", "weight as w")).where("u <> v").groupBy("u", "v").agg(F.sum("w").alias("w"))
    total = graph.agg(F.sum("w")).first()[0]
    state = graph.groupBy(F.col("u").alias("id")).agg(F.sum("w").alias("k")).withColumn("c", F.col("id") % 4)
    monkeypatch.setattr(G, "materialize", lambda df, label="t": spark.createDataFrame(df.collect(), df.schema))
    moved = G._moved(graph, state, total, 0)
    want = G.modularity(edges, state.select("id", F.col("c").alias("community"))).first()[0]
    assert abs(G._modularity_before(moved, total) - want) < 1e-9 and moved.where("was <> id % 4").count() == 0
    monkeypatch.setattr(G, "materialize", lambda df, label="t": df)
    held = {n: spark.createDataFrame(d.collect(), d.schema) for n, d in (("graph", graph), ("state", state))}
    least = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as at size
    try:
        plan = G._moved(held["graph"], held["state"], total, 0)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", least)
    assert plan.count("SortMergeJoin") <= 5  # the links meet the state once, and its sums come with it


def test_shared_sources_are_dealt_by_the_number_of_rows(spark, monkeypatch):
    monkeypatch.setattr(session, "ROWS_A_TASK", 100)
    rng = random.Random(2)
    held = [(rng.randrange(10), rng.randrange(300)) for _ in range(1000)]
    rows = spark.createDataFrame(held, "id long, source long")
    for once in (False, True):
        found = G.shared_sources(rows, once=once)
        assert found.rdd.getNumPartitions() >= 30
        want = {}
        for a, s in set(held):
            for b, t in set(held) if once else held:
                if s == t and a < b:
                    want[a, b] = want.get((a, b), 0) + 1
        assert {(r.a, r.b): r.shared for r in found.collect()} == want


def _greedy(sizes: list[int], most: int) -> list[int]:
    out, batch, held = [], -1, most
    for n in sizes:
        batch, held = (batch, held + n) if held + n <= most else (batch + 1, n)
        out.append(batch)
    return out


def test_packing_takes_the_same_few_jobs_whatever_the_number_of_batches(spark, monkeypatch):
    monkeypatch.setattr(D, "RANGE_CLUSTERS", 20)
    rng = random.Random(3)
    jobs = []
    for n in (40, 400):
        sizes = [rng.choice((1, 2, 3, 7, 30)) for _ in range(n)]
        members = spark.createDataFrame([(i, float(c)) for c, k in enumerate(sizes) for i in range(k)] + [(0, float("nan")), (1, None)], "id int, cluster double")
        spark.sparkContext.setJobGroup(f"pack{n}", "")
        got = {r.cluster: r.batch for r in D.pack_clusters(members, 10).where("not isnan(cluster)").collect()}
        assert [got[float(c)] for c in range(n)] == _greedy(sizes, 10)
        assert D.pack_clusters(members, 10).where("isnan(cluster)").first().batch == _greedy(sizes + [1], 10)[-1]
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"pack{n}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < jobs[0] and jobs[1] <= jobs[0] + 8  # no rounds that grow with the number of batches


def _suggested_page_by_page(broken, pages, names):
    """The rule of suggest_targets on every page, without texts."""
    asks = broken.select("target").distinct().select("target", F.explode(T.bigrams(F.col("target"))).alias("g"))
    index = pages.select("id", F.explode(F.flatten(F.array(*[T.bigrams(F.col(n)) for n in names]))).alias("g"))
    order = lambda *c: F.row_number().over(Window.partitionBy("target").orderBy(*c))
    top = asks.join(index, "g").groupBy("target", "id").count().withColumn("r", order(F.desc("count"), "id")).where(f"r <= {L.CANDIDATES}")
    like = F.greatest(*[T.string_similarity(F.col("target"), F.col(n)) for n in names], F.lit(0.0))
    return top.join(pages, "id").withColumn("s", like).withColumn("f", order(F.desc("s"), "r")).where(f"f = 1 and s >= {L.BROKEN_LEAST}").select("target", "id", "s")


def test_suggestions_pair_texts_and_not_their_pages(spark):
    rng = random.Random(4)
    words = ("blue ring", "blue rung", "old plate", "plate", "hot bolt", "hot bolts", "", "colt hob")
    pages = [(i, rng.choice(words), rng.choice(("tool box", "box tool", None))) for i in range(400)]  # some texts have under, some over 64 pages
    pages += [(i, "blue ringlet", "seldom") for i in range(400, 403)]
    pages = spark.createDataFrame(pages, "id long, text string, ids string")
    broken = spark.createDataFrame([(t,) for t in ("bue ring", "hot blt", "old plat", "late", "tool bx", "ringlet", "nothing", "")], "target string")
    for names in (["text"], ["text", "ids"]):
        found = L.suggest_targets(broken, pages, names)
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, _suggested_page_by_page(broken, pages, names).collect()))
    joins = [p for p in L.suggest_targets(broken, pages, ["text"]).inputFiles() if "texts" in p]
    assert joins and spark.read.parquet(*joins).count() == 9  # what meets the targets: a row for each text


def test_language_reads_a_text_a_fixed_few_times(spark):
    plan = spark.createDataFrame([("",)], "whole string").select(languages.detect(F.col("whole")))._jdf.queryExecution().analyzed().toString()
    assert plan.split("LogicalRDD")[0].split("LocalRelation")[0].count("whole#") <= 2
    texts = ["the book", "und_ der", "x und y", "não", "é", "é e", "on på en", "漢か", "привет", "پب", "ñ", "", None]
    want = ["English", "German", "German", "Portuguese", "English", "English", "Swedish", "Japanese", "Russian", "Persian", "Spanish", "English", "English"]  # as before the rules shared one reading
    found = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", languages.detect(F.col("t"))).collect()
    assert [dict(map(tuple, found))[i] for i in range(len(texts))] == want


def test_pages_are_python_objects_a_few_at_a_time():
    page = "<p>" + "word, and more of it. " * 1000 + "</p>"
    pages = pa.array([page] * 800 + [None])
    tracemalloc.start()
    found = html.markdowns(pages)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == 801 and found[800].as_py() == "" and found[0].as_py() == found[799].as_py() == html.markdown(html.article(page))
    assert peak < pages.nbytes / 2  # all pages, or all results, as Python objects are more than all of it
