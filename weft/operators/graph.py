"""The link graph: resolution, weights, neighbourhoods, communities and insights.

Graphs are two DataFrames: nodes (id, label, type, ...) and edges (src, dst, ...). Pairs are found through shared
keys, never by comparing all nodes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.functions import measures as M
from weft.session import dealt, materialize, spread

STRUCTURAL = ("index", "log", "overview")

#: Pairs that a row is taken to give when tasks are dealt, a fixed value; where rows give more, tasks are larger in proportion.
PAIRS_A_ROW = 3


def resolve_targets(links: DataFrame, ids: DataFrame) -> DataFrame:
    """Links (src, raw) to page ids (id, ordinal): the exact id, else the first page whose id equals the target in lower
    case, with or without hyphens for blanks."""
    hyphen = lambda c: F.regexp_replace(F.lower(c), r"\s+", "-")
    keys = ids.select("id", "ordinal", F.explode(F.array_distinct(F.array(F.lower("id"), hyphen(F.col("id"))))).alias("key"))
    first = keys.groupBy("key").agg(F.min_by("id", "ordinal").alias("near"), F.min("ordinal").alias("at"))
    raw = links.withColumn("low", F.lower("raw")).withColumn("hyphened", hyphen(F.col("raw")))
    exact = raw.join(ids.select(F.col("id").alias("exact")), F.col("raw") == F.col("exact"), "left")
    by_low = exact.join(first.select(F.col("key").alias("low"), F.col("near").alias("n1"), F.col("at").alias("a1")), "low", "left")
    by_all = by_low.join(first.select(F.col("key").alias("hyphened"), F.col("near").alias("n2"), F.col("at").alias("a2")), "hyphened", "left")
    near = F.when(F.col("a1").isNull() | (F.col("a2") < F.col("a1")), F.col("n2")).otherwise(F.col("n1"))
    return by_all.withColumn("dst", F.coalesce("exact", near)).where("dst is not null and dst <> src").select("src", "dst", "raw")


def undirected(edges: DataFrame, order: Column | None = None) -> DataFrame:
    """Each pair once, as it stood first by ``order`` (any order of src, dst by default)."""
    key = [F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")]
    first = F.min_by(F.struct("src", "dst"), order if order is not None else F.struct("src", "dst"))
    return edges.select("*", *key).groupBy("a", "b").agg(first.alias("e")).select("e.src", "e.dst")


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree): every row of the edges counts for both ends, in one pass over the edges."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def induced(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The edges between the nodes (id)."""
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def filter_graph(nodes: DataFrame, edges: DataFrame, hidden_types: list[str] = (), hidden_ids: list[str] = (), structural: bool = False, isolated: bool = False, least: int | None = None, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, type, degree) and induced edges after dropping types, ids, structural pages, isolated nodes and degrees out of bounds."""
    keep = F.lit(True)
    if hidden_types:
        keep = keep & ~F.col("type").isin(*hidden_types)
    if hidden_ids:
        keep = keep & ~F.col("id").isin(*hidden_ids)
    if structural:
        keep = keep & ~F.col("id").cast("string").isin(*STRUCTURAL)
    if isolated:
        keep = keep & (F.col("degree") > 0)
    if least is not None:
        keep = keep & (F.col("degree") >= least)
    if most is not None:
        keep = keep & (F.col("degree") <= most)
    kept = nodes.where(keep)
    return kept, induced(spread(kept), edges)


def text_search(nodes: DataFrame, edges: DataFrame, query: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Nodes whose columns together hold all blank-separated tokens of the query, and the edges between them."""
    hay = F.lower(F.concat_ws(" ", *columns))
    keep = F.lit(True)
    for token in query.lower().split():
        keep = keep & F.contains(hay, F.lit(token))
    kept = nodes.where(keep)
    return kept, induced(spread(kept), edges)


def api_graph(nodes: DataFrame, edges: DataFrame, q: str = "", node_type: str | None = None, limit: int = 200) -> tuple[DataFrame, DataFrame]:
    """Nodes whose id or label holds q, of one type, the first ``limit`` (at most 1000) by id, and the edges between them."""
    kept = nodes.where(F.contains(F.lower(F.col("id").cast("string")), F.lit(q.lower())) | F.contains(F.lower("label"), F.lit(q.lower())))
    kept = kept.where(F.col("type") == node_type) if node_type else kept
    kept = kept.orderBy("id").limit(min(max(limit, 1), 1000))
    return kept, induced(kept, edges)


def common_neighbors(edges: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """(a, b, common, adamic_adar) for node pairs a < b with a common neighbour, or for the pairs (a, b) given.

    With pairs, each is joined with the neighbours of a and looked up at b: the rows made are the pairs' degrees, not all wedges.
    """
    nbr = both_ways(edges).distinct()
    weight = nbr.groupBy("src").agg((1.0 / F.log(F.greatest(F.count("*"), F.lit(2)).cast("double"))).alias("w"))
    weighed = nbr.join(weight.withColumnRenamed("src", "dst"), "dst")
    left = weighed.select(F.col("src").alias("a"), F.col("dst").alias("c"), "w")
    right = nbr.select(F.col("src").alias("b"), F.col("dst").alias("c"))
    if pairs is not None:
        wedges = pairs.select("a", "b").join(left, "a").join(right, ["b", "c"])
    else:
        wedges = left.join(right, "c").where("a < b")
    return wedges.groupBy("a", "b").agg(F.count("*").alias("common"), F.sum("w").alias("adamic_adar"))


def shared_sources(sources: DataFrame, n_rows: int | None = None, once: bool = False) -> DataFrame:
    """(a, b, shared) for pages a < b of (id, source): sources that both name; a's are a set, b's count as often as they stand, or ``once``.

    Sources and pairs are dealt by the number of rows, which is counted if it isn't given."""
    n = sources.count() if n_rows is None else n_rows
    rows = dealt(sources.select("id", "source"), n, "source")
    left = rows.distinct()
    right = left if once else rows
    pairs = left.withColumnRenamed("id", "a").join(right.withColumnRenamed("id", "b"), "source").where("a < b").select("a", "b")
    return dealt(pairs, PAIRS_A_ROW * n, "a", "b").groupBy("a", "b").agg(F.count("*").alias("shared"))


def affinity(a: Column, b: Column) -> Column:
    """Affinity of two page types, as one expression over the fixed table."""
    out = None
    for t, row in M.TYPE_AFFINITY.items():
        for u, v in row.items():
            hit = (a == t) & (b == u)
            out = F.when(hit, v) if out is None else out.when(hit, v)
    return out.otherwise(M.AFFINITY_DEFAULT)


def relevance(pairs: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b, relevance) of the pairs: 3 for each direct link, 4 for each shared source, 1.5 times Adamic-Adar, and type affinity.

    ``nodes``: (id, type, sources)."""
    directed = edges.select("src", "dst").distinct()
    direct = both = pairs.select("a", "b")
    forward = both.join(directed, (F.col("a") == F.col("src")) & (F.col("b") == F.col("dst"))).select("a", "b")
    backward = both.join(directed, (F.col("b") == F.col("src")) & (F.col("a") == F.col("dst"))).select("a", "b")
    direct = forward.unionByName(backward).groupBy("a", "b").agg(F.count("*").alias("direct"))
    adamic = common_neighbors(edges, pairs).select("a", "b", "adamic_adar")
    na, nb = nodes.select(F.col("id").alias("a"), F.col("type").alias("ta"), F.col("sources").alias("sa")), nodes.select(F.col("id").alias("b"), F.col("type").alias("tb"), F.col("sources").alias("sb"))
    rows = both.join(spread(na), "a").join(spread(nb), "b").join(direct, ["a", "b"], "left").join(adamic, ["a", "b"], "left")
    shared = F.size(F.filter("sb", lambda s: F.array_contains("sa", s)))
    total = F.coalesce("direct", F.lit(0)) * M.DIRECT_LINK + F.greatest(shared, F.lit(0)) * M.SOURCE_OVERLAP + F.coalesce("adamic_adar", F.lit(0.0)) * M.COMMON_NEIGHBOR + affinity(F.col("ta"), F.col("tb")) * M.AFFINITY
    return rows.select("a", "b", total.alias("relevance"))


def communities(nodes: DataFrame, edges: DataFrame, top: int = 5) -> DataFrame:
    """Size, edges inside, cohesion and the ``top`` labels by degree of each community of nodes (id, label, community, degree).

    Communities are numbered by size, the largest 0 (ties: the smaller old number first)."""
    at = spread(nodes.select("id", "community"))
    inside = edges.join(at.select(F.col("id").alias("src"), F.col("community").alias("cs")), "src").join(at.select(F.col("id").alias("dst"), F.col("community").alias("cd")), "dst")
    inside = inside.where("cs = cd").groupBy(F.col("cs").alias("community")).agg(F.count("*").alias("intra"))
    best = nodes.withColumn("r", F.row_number().over(Window.partitionBy("community").orderBy(F.col("degree").desc(), "label"))).where(F.col("r") <= top)
    labels = best.groupBy("community").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "label"))), lambda x: x.label), ", ").alias("top_labels"))
    sized = nodes.groupBy("community").agg(F.count("*").alias("size"))
    rows = sized.join(inside, "community", "left").join(labels, "community").withColumn("intra", F.coalesce("intra", F.lit(0)))
    possible = F.when(F.col("size") > 1, F.col("size") * (F.col("size") - 1) / 2).otherwise(1.0)
    number = F.row_number().over(Window.orderBy(F.col("size").desc(), "community")) - 1
    return rows.select("community", number.alias("number"), "size", "intra", (F.col("intra") / possible).alias("cohesion"), "top_labels")


def bridges(nodes: DataFrame, edges: DataFrame, least: int = 3, limit: int = 3, among: DataFrame | None = None) -> DataFrame:
    """Nodes with neighbours in ``least`` communities or more, the first ``limit``; neighbours are looked for ``among`` other nodes if given."""
    at = spread((nodes if among is None else among).select(F.col("id").alias("dst"), F.col("community").alias("c")))
    found = both_ways(edges).join(at, "dst").groupBy(F.col("src").alias("id")).agg(F.countDistinct("c").alias("n_communities"))
    found = found if among is None else found.join(nodes.select("id"), "id", "left_semi")
    return found.where(F.col("n_communities") >= least).orderBy(F.col("n_communities").desc(), "id").limit(limit)


#: Cohesion below which a community of three and more is sparse, a fixed value.
SPARSE = 0.15


def knowledge_gaps(nodes: DataFrame, edges: DataFrame, limit: int = 8) -> DataFrame:
    """``kind, subject, title, n_pages, measure`` of the first ``limit`` gaps of nodes (id, label, type, community, degree): the isolated pages as
    one, the sparse communities by size, and the bridges between communities.

    ``subject`` is the community's old number or the bridge; ``measure`` the most links of an isolated page, the cohesion, or the bridge's communities.
    ``gap_pages`` gives the pages. Overview, index and log are never isolated or bridges."""
    alone = _isolated(nodes).agg(F.count("*").alias("n"), F.max("degree").alias("most")).where("n > 0")
    title = F.concat(F.col("n").cast("string"), F.when(F.col("n") > 1, " isolated pages").otherwise(" isolated page"))
    rows = alone.select(F.lit(0).alias("part"), F.lit(0).cast("long").alias("at"), F.lit("isolated-node").alias("kind"), F.lit("").alias("subject"), title.alias("title"), F.col("n").alias("n_pages"), F.col("most").cast("double").alias("measure"))
    thin = communities(nodes, edges, 1).where((F.col("cohesion") < SPARSE) & (F.col("size") >= 3))
    rows = rows.unionByName(thin.select(F.lit(1).alias("part"), F.col("number").cast("long").alias("at"), F.lit("sparse-community").alias("kind"), F.col("community").cast("string").alias("subject"), F.concat(F.lit("Sparse cluster: "), "top_labels").alias("title"), F.col("size").alias("n_pages"), F.col("cohesion").alias("measure")))
    over = bridges(nodes.where(~F.col("id").cast("string").isin(*STRUCTURAL)), edges, among=nodes).join(nodes.select("id", "label"), "id")
    at = F.row_number().over(Window.orderBy(F.col("n_communities").desc(), "id")).cast("long")  # of three rows
    rows = rows.unionByName(over.select(F.lit(2).alias("part"), at.alias("at"), F.lit("bridge-node").alias("kind"), F.col("id").cast("string").alias("subject"), F.concat(F.lit("Key bridge: "), "label").alias("title"), F.lit(1).cast("long").alias("n_pages"), F.col("n_communities").cast("double").alias("measure")))
    return rows.orderBy("part", "at").limit(limit).drop("part", "at")


def _isolated(nodes: DataFrame) -> DataFrame:
    return nodes.where((F.col("degree") <= 1) & (F.col("type") != "overview") & ~F.col("id").cast("string").isin("index", "log"))


def gap_pages(nodes: DataFrame, gaps: DataFrame) -> DataFrame:
    """``kind, subject, id``: every page of the gaps that ``knowledge_gaps`` lists."""
    listed = F.broadcast(gaps.select("kind", "subject"))  # at most its limit
    kinds = ((_isolated(nodes), "isolated-node", F.lit("")), (nodes, "sparse-community", F.col("community").cast("string")), (nodes, "bridge-node", F.col("id").cast("string")))
    rows = [of.select(F.lit(kind).alias("kind"), subject.alias("subject"), "id") for of, kind, subject in kinds]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).join(listed, ["kind", "subject"], "left_semi")


def surprising(nodes: DataFrame, edges: DataFrame, least: int = 3) -> DataFrame:
    """Edges (src, dst, weight) by surprise: another community 3, a distant type 2 or another type 1, a peripheral node at a
    hub 2, a weight between 0 and 2 one; those with ``least`` and more. nodes: (id, type, community, degree)."""
    ids = nodes.where(~F.col("id").cast("string").isin(*STRUCTURAL))
    s = ids.select(F.col("id").alias("src"), F.col("type").alias("ts"), F.col("community").alias("cs"), F.col("degree").alias("ds"))
    t = ids.select(F.col("id").alias("dst"), F.col("type").alias("tt"), F.col("community").alias("ct"), F.col("degree").alias("dt"))
    most = nodes.agg(F.greatest(F.max("degree"), F.lit(1)).alias("most"))
    rows = edges.join(s, "src").join(t, "dst").join(F.broadcast(most))
    far = F.lit(False)
    for a, b in M.DISTANT_TYPES:
        far = far | ((F.col("ts") == a) & (F.col("tt") == b))
    crossing = F.when(F.col("cs") != F.col("ct"), 3).otherwise(0)
    typed = F.when(F.col("ts") == F.col("tt"), 0).when(far, 2).otherwise(1)
    rim = F.when((F.least("ds", "dt") <= 2) & (F.greatest("ds", "dt") >= F.col("most") * 0.5), 2).otherwise(0)
    weak = F.when((F.col("weight") < 2) & (F.col("weight") > 0), 1).otherwise(0)
    reasons = F.concat_ws("; ", F.when(crossing > 0, "crosses community boundary"), F.when(typed == 2, F.concat(F.lit("connects "), "ts", F.lit(" to "), "tt")).when(typed == 1, "different types"), F.when(rim > 0, "peripheral node links to hub"), F.when(weak > 0, "weak but present connection"))
    return rows.select("src", "dst", (crossing + typed + rim + weak).alias("score"), reasons.alias("reasons")).where(F.col("score") >= least)


def page_links(pages: DataFrame, resolved: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Outgoing links, backlinks and missing targets of each page: (page, other) three times.

    ``links``: (src, raw) as written, ``resolved``: (src, dst, raw)."""
    out = resolved.select(F.col("src").alias("page"), F.col("dst").alias("other")).distinct()
    back = resolved.select(F.col("dst").alias("page"), F.col("src").alias("other")).distinct()
    missing = links.join(resolved.select("src", "raw"), ["src", "raw"], "left_anti").select(F.col("src").alias("page"), F.col("raw").alias("other")).distinct()
    return out, back, missing


def graph_hits(nodes: DataFrame, edges: DataFrame, matched: Column, limit: int = 10, neighbours: int = 20) -> DataFrame:
    """Matched nodes score 10000 + degree, nodes with a matched node among their first ``neighbours`` neighbours 5000 + degree."""
    marked = nodes.withColumn("matched", matched)
    listed = both_ways(edges).distinct().withColumn("r", F.row_number().over(Window.partitionBy("src").orderBy("dst"))).where(F.col("r") <= neighbours)
    near = listed.join(marked.where("matched").select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("id")).distinct().withColumn("near", F.lit(True))
    rows = marked.join(near, "id", "left").where("matched or near")
    score = F.when(F.col("matched"), 10_000).otherwise(5_000) + F.coalesce("degree", F.lit(0))
    return rows.select("id", score.alias("score")).orderBy(F.col("score").desc(), "id").limit(min(max(limit, 1), 10))


LEAST_GAIN = 1e-5


def _moved(graph: DataFrame, state: DataFrame, total: float, turn: int) -> DataFrame:
    """A state (id, k, c) after the nodes of one parity have moved where they gain most, with the community ``was`` that a node had and
    the weight ``inside`` of its links in it. The links are joined once: sums of communities come with the nodes at their ends."""
    sums = state.groupBy("c").agg(F.sum("k").alias("tot"))
    at = state.select("id", "k", "c").join(sums, "c").select("id", "k", "c", "tot")
    far = at.select(F.col("id").alias("v"), F.col("c").alias("cand"), F.col("tot").alias("sum"))
    near = graph.join(far, "v").select(F.col("u").alias("id"), "cand", F.when(F.col("u") != F.col("v"), F.col("w")).otherwise(0.0).alias("win"), "w", "sum")
    own = at.select("id", F.col("c").alias("cand"), F.lit(0.0).alias("win"), F.lit(0.0).alias("w"), F.col("tot").alias("sum"))
    options = near.unionByName(own).groupBy("id", "cand").agg(F.sum("win").alias("win"), F.sum("w").alias("w"), F.max("sum").alias("sum")).join(at.select("id", "k", "c"), "id")
    stays = F.col("cand") == F.col("c")
    gain = F.round(F.col("win") - F.col("k") * (F.col("sum") - F.when(stays, F.col("k")).otherwise(0.0)) / total, 12)
    best = F.max_by("cand", F.struct(gain.alias("gain"), stays.cast("int").alias("stays"), -F.xxhash64("cand"))).alias("to")
    found = options.groupBy("id").agg(F.max("k").alias("k"), F.max("c").alias("was"), F.sum(F.when(stays, F.col("w"))).alias("inside"), best)
    moves = F.pmod(F.xxhash64("id", F.lit(turn // 2)), F.lit(2)) == turn % 2
    return materialize(found.select("id", "k", F.when(moves, F.col("to")).otherwise(F.col("was")).alias("c"), "was", "inside"), "state")


def _modularity_before(moved: DataFrame, total: float) -> float:
    """Modularity of the state that ``_moved`` was given, from its result alone."""
    sums = moved.groupBy("was").agg(F.sum("k").alias("all"), F.sum("inside").alias("inside"))
    return sums.agg(F.sum(F.col("inside") / total - (F.col("all") / total) ** 2)).first()[0] or 0.0


def louvain(edges: DataFrame, least_gain: float = LEAST_GAIN) -> DataFrame:
    """(id, community, modularity) by local moving and coarsening of a weighted graph (src, dst, weight), to convergence.

    In a round every node looks at the communities of its neighbours and moves to the one with the largest gain of
    modularity; nodes of one parity of a hash move at a time, so that pairs don't swap for ever. Ties go to the community of
    the smaller hash. A level goes on while a pair of rounds raises the modularity by more than ``least_gain``; a pair that doesn't is
    undone. Each level then joins a community into one node, and levels end when one has nothing to gain, so there are at most 1 / ``least_gain`` rounds,
    and in practice few. ``modularity`` is that of the whole assignment. State is written after each round; nothing but totals
    reaches the driver. A graph without weights gives no rows; loops and nulls are passed over.
    """
    pairs = edges.where("src <> dst and weight > 0").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), F.col("weight").cast("double").alias("w"))
    graph = pairs.groupBy("a", "b").agg(F.sum("w").alias("w"))
    graph = materialize(graph.select(F.col("a").alias("u"), F.col("b").alias("v"), "w").unionByName(graph.select(F.col("b").alias("u"), F.col("a").alias("v"), "w")), "graph")
    total = graph.agg(F.sum("w")).first()[0]
    if not total:
        kind = edges.schema["src"].dataType
        return edges.sparkSession.createDataFrame([], "id long, community long, modularity double").select(F.col("id").cast(kind), F.col("community").cast(kind), "modularity")
    mapping, reached = None, None
    while True:
        state = materialize(graph.groupBy(F.col("u").alias("id")).agg(F.sum("w").alias("k")).withColumn("c", F.col("id")), "state")
        first, turn = _moved(graph, state, total, 0), 0
        start = q = _modularity_before(first, total)
        while True:
            new = _moved(graph, first, total, turn + 1)
            first = _moved(graph, new, total, turn + 2)  # the next pair's, which tells what this pair has reached
            now = _modularity_before(first, total)
            if now <= q + least_gain:
                break
            state, q, turn = new, now, turn + 2
        reached = start if reached is None else reached
        if mapping is not None and q <= reached + least_gain:
            break
        reached, joined = q, state.select("id", "c")
        mapping = materialize(joined if mapping is None else mapping.withColumnRenamed("c", "mid").join(joined.withColumnRenamed("id", "mid"), "mid").select("id", "c"), "mapping")
        x, y = joined.select(F.col("id").alias("u"), F.col("c").alias("cu")), joined.select(F.col("id").alias("v"), F.col("c").alias("cv"))
        graph = materialize(graph.join(x, "u").join(y, "v").groupBy(F.col("cu").alias("u"), F.col("cv").alias("v")).agg(F.sum("w").alias("w")), "graph")
    return mapping.select("id", F.col("c").alias("community"), F.lit(reached).alias("modularity"))


def modularity(edges: DataFrame, assigned: DataFrame) -> DataFrame:
    """One row: the modularity of an assignment (id, community) of a weighted graph (src, dst, weight)."""
    at = assigned.select("id", "community")
    rows = edges.where("src <> dst").join(at.select(F.col("id").alias("src"), F.col("community").alias("cs")), "src").join(at.select(F.col("id").alias("dst"), F.col("community").alias("cd")), "dst")
    total = rows.agg(F.sum("weight").alias("m"), F.sum(F.when(F.col("cs") == F.col("cd"), F.col("weight")).otherwise(0)).alias("inside"))
    ends = rows.select(F.col("cs").alias("c"), "weight").unionByName(rows.select(F.col("cd").alias("c"), "weight")).groupBy("c").agg(F.sum("weight").alias("d"))
    squares = ends.agg(F.sum(F.col("d") * F.col("d")).alias("s"))
    return total.join(F.broadcast(squares)).select((F.col("inside") / F.col("m") - F.col("s") / (4 * F.col("m") * F.col("m"))).alias("modularity"))
