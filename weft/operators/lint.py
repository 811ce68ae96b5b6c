"""Structural linting: orphans, pages without links, broken links, and suggestions for each."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.functions import text as T
from weft.session import dealt, materialize

BROKEN_LEAST, RELATED_LEAST, FOLDER_BONUS, SINGLE_WEIGHT, CANDIDATES = 0.74, 0.08, 0.08, 0.35, 64


def orphans(pages: DataFrame, links: DataFrame) -> DataFrame:
    """Pages (id) that no link (src, dst) leads to."""
    return pages.join(links.select(F.col("dst").alias("id")), "id", "left_anti")


def broken_links(links: DataFrame, pages: DataFrame) -> DataFrame:
    """Links (src, dst) to no page (id)."""
    return links.join(pages.select(F.col("id").alias("dst")), "dst", "left_anti")


def related(tokens: DataFrame, folders: DataFrame | None = None, n_pages: int | None = None, best_only: bool = True) -> DataFrame:
    """(id, other, score): for each page of (id, token) the related ones by shared tokens.

    Tokens on more than max(20, a quarter of the pages) are left out; each page's 64 best by weight (ties: the smaller id)
    are scored: weight over the root of both token counts, plus a bonus for one top folder (``folders``: id, folder).
    A token of one character weighs 0.35. The token limit bounds what a token joins, and is the feature itself.
    """
    t = tokens.select("id", "token").distinct()
    sizes = t.groupBy("id").agg(F.count("*").alias("size"))
    n_pages = n_pages if n_pages is not None else sizes.count()
    rare = t.groupBy("token").agg(F.count("*").alias("df")).where(F.col("df") <= max(20, -(-n_pages // 4)))
    used = t.join(rare.select("token"), "token", "left_semi").withColumn("w", F.when(F.char_length("token") > 1, 1.0).otherwise(SINGLE_WEIGHT))
    pairs = used.join(used.select("token", F.col("id").alias("other")), "token").where("id <> other")
    summed = pairs.groupBy("id", "other").agg(F.sum("w").alias("overlap"))
    top = summed.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(F.col("overlap").desc(), "other"))).where(F.col("r") <= CANDIDATES)
    rows = top.join(sizes, "id").join(sizes.select(F.col("id").alias("other"), F.col("size").alias("other_size")), "other")
    score = F.col("overlap") / F.sqrt(F.col("size") * F.col("other_size"))
    if folders is not None:
        rows = rows.join(folders.select("id", "folder"), "id").join(folders.select(F.col("id").alias("other"), F.col("folder").alias("other_folder")), "other")
        score = score + F.when(F.col("folder") == F.col("other_folder"), FOLDER_BONUS).otherwise(0.0)
    rows = rows.select("id", "other", "r", score.alias("score")).where(F.col("score") >= RELATED_LEAST)
    if not best_only:
        return rows.select("id", "other", "score")
    first = F.row_number().over(Window.partitionBy("id").orderBy(F.col("score").desc(), "r"))
    return rows.withColumn("f", first).where("f = 1").select("id", "other", "score")


def suggest_targets(broken: DataFrame, pages: DataFrame, names: list[str]) -> DataFrame:
    """(target, id, similarity): for each broken target the page (id and ``names``) most like it, of at least 0.74.

    Pages meet a target on shared character pairs; its 64 best by their number (ties: the smaller id) are compared. Pages of the same names are one
    text until the end: it stands for its first 64 pages, as no more of them can be among a target's."""
    within = F.row_number().over(Window.partitionBy(*names).orderBy("id"))
    firsts = dealt(pages.select("id", *names), pages.count(), "id").withColumn("_r", within).where(F.col("_r") <= CANDIDATES)
    texts = firsts.groupBy(*names).agg(F.sort_array(F.collect_list("id")).alias("_ids"))
    texts = materialize(texts.withColumn("_text", F.get("_ids", F.lit(0))), "texts")
    targets = broken.select("target").distinct()
    asks = targets.select("target", F.explode(T.bigrams(F.col("target"))).alias("g"))
    index = texts.select("_text", F.explode(F.flatten(F.array(*[T.bigrams(F.col(n)) for n in names]))).alias("g"))
    counted = asks.join(index, "g").groupBy("target", "_text").agg(F.count("*").alias("n"))
    rank = lambda c: F.row_number().over(Window.partitionBy("target").orderBy(F.col("n").desc(), c))
    top = counted.withColumn("r", rank("_text")).where(F.col("r") <= CANDIDATES).drop("r")
    like = F.greatest(*[T.string_similarity(F.col("target"), F.col(n)) for n in names]) if len(names) > 1 else T.string_similarity(F.col("target"), F.col(names[0]))
    rows = top.join(texts, "_text").withColumn("similarity", like).select("target", "n", "similarity", F.explode("_ids").alias("id"))
    rows = rows.withColumn("r", rank("id")).where(F.col("r") <= CANDIDATES)
    first = F.row_number().over(Window.partitionBy("target").orderBy(F.col("similarity").desc(), "r"))
    return rows.withColumn("f", first).where((F.col("f") == 1) & (F.col("similarity") >= BROKEN_LEAST)).select("target", "id", "similarity")


def lint(pages: DataFrame) -> DataFrame:
    """Findings (type, severity, page, target, suggestion) over pages (id, slug, short_name, title, tokens, outlinks).

    id is the page's place in the scan; of pages with one slug or file name the last one is the link's target."""
    keys = pages.select("id", F.explode(F.array(T.target_key(F.col("slug")), T.target_key(F.regexp_replace(T.file_name(F.col("short_name")), r"(?i)\.md$", "")))).alias("key"))
    targets = keys.groupBy("key").agg(F.max("id").alias("dst"))
    links = pages.select(F.col("id").alias("src"), F.explode("outlinks").alias("link"))
    links = links.select("src", "link", T.target_key(F.col("link")).alias("k1"), T.target_key(F.regexp_replace(T.file_name(F.col("link")), r"(?i)\.md$", "")).alias("k2"))
    t1, t2 = targets.select(F.col("key").alias("k1"), F.col("dst").alias("d1")), targets.select(F.col("key").alias("k2"), F.col("dst").alias("d2"))
    resolved = links.join(t1, "k1", "left").join(t2, "k2", "left").withColumn("dst", F.coalesce("d1", "d2"))
    tokens = pages.select("id", F.explode("tokens").alias("token"))
    folders = pages.select("id", F.split("short_name", "/").getItem(0).alias("folder"))
    n = pages.count()
    scored = related(tokens, folders, n, best_only=False)
    best = lambda rows: rows.groupBy("id").agg(F.max_by("other", F.struct(F.col("score"), -F.col("other"))).alias("other"))
    names = pages.select("id", "short_name")
    other = names.select(F.col("id").alias("other"), F.col("short_name").alias("suggestion"))
    lonely = names.join(resolved.where("dst is not null").select(F.col("dst").alias("id")), "id", "left_anti").join(best(scored), "id", "left").join(other, "other", "left")
    none = F.lit(None).cast("string")
    a = lonely.select(F.lit("orphan").alias("type"), F.lit("info").alias("severity"), F.col("short_name").alias("page"), none.alias("target"), "suggestion")
    dry = pages.where(F.size("outlinks") == 0).select("id", "short_name").join(best(scored), "id", "left").join(other, "other", "left")
    b = dry.select(F.lit("no-outlinks").alias("type"), F.lit("info").alias("severity"), F.col("short_name").alias("page"), none.alias("target"), "suggestion")
    bad = resolved.where("dst is null").select("src", F.col("link").alias("target"))
    like = suggest_targets(bad, pages.select("id", "slug", "short_name", "title"), ["slug", "short_name", "title"]).join(names, "id").select("target", F.col("short_name").alias("suggestion"))
    c = bad.join(like, "target", "left").join(names.select(F.col("id").alias("src"), F.col("short_name").alias("page")), "src")
    return a.unionByName(b).unionByName(c.select(F.lit("broken-link").alias("type"), F.lit("warning").alias("severity"), "page", "target", "suggestion"))
