"""What references carry of the pages around them: tags, links, backlinks, neighbours and the latest version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.functions import text as T
from weft.session import materialize

#: Items of each list, a fixed value.
MOST = 20


def first_of(pairs: DataFrame, key: str, value: str, most: int, name: str) -> DataFrame:
    """``key``, ``name`` (its first ``most`` distinct values in order) and ``n_<name>`` (how many there are).

    Tasks pass on ``most`` values of a key before the shuffle, so a key that holds most of the rows is no more than others."""
    once = pairs.select(key, value).where(F.col(key).isNotNull() & F.col(value).isNotNull()).distinct()
    ranked = once.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy(value))).where(F.col("r") <= most)
    firsts = ranked.groupBy(key).agg(F.sort_array(F.collect_list(value)).alias(name))
    return once.groupBy(key).agg(F.count("*").alias(f"n_{name}")).join(firsts, key)


def described(pages: DataFrame) -> DataFrame:
    """``path, title, tags, links`` of pages (path, content), written out once; links are as written."""
    file = F.element_at(F.split("path", "/"), -1)
    rows = pages.where("path is not null").select("path", T.title(F.col("content"), file).alias("title"), T.list_field(F.col("content"), "tags").alias("tags"), T.scanned_links(F.col("content")).alias("links"))
    return materialize(rows, "described")


def names(pages: DataFrame) -> DataFrame:
    """``(name, path)``: the page that a link's address means, by file name, title, path, and path below wiki/; the last path has a name of several."""
    file = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.md$", "")
    every = F.array_distinct(F.transform(F.array(file, "title", "path", F.regexp_replace("path", "^wiki/", "")), T.link_address))
    return pages.select("path", F.explode(every).alias("name")).where("name <> ''").groupBy("name").agg(F.max("path").alias("path"))


def page_contexts(pages: DataFrame, most: int = MOST) -> DataFrame:
    """``path, title, tags, outgoing, backlinks, neighbours, link_count`` of pages (path, content), paths being unique.

    Outgoing links are as written, whether they lead somewhere or not; backlinks and neighbours are paths of other pages. Each list is in order and cut to ``most``,
    ``link_count`` counts outgoing links and backlinks before the cut. Pages without a path are left out; null texts have no links."""
    rows = described(pages)
    links = rows.select("path", F.explode("links").alias("link"))
    leads = links.select("path", T.link_address(F.col("link")).alias("name")).distinct().join(names(rows).withColumnRenamed("path", "other"), "name").where("path <> other").select("path", "other").distinct()
    leads = materialize(leads, "leads")
    outgoing = first_of(links, "path", "link", most, "outgoing")
    backlinks = first_of(leads.select(F.col("other").alias("path"), F.col("path").alias("other")), "path", "other", most, "backlinks")
    neighbours = first_of(leads.unionByName(leads.select(F.col("other").alias("path"), F.col("path").alias("other"))), "path", "other", most, "neighbours")
    found = rows.drop("links").join(outgoing, "path", "left").join(backlinks, "path", "left").join(neighbours.drop("n_neighbours"), "path", "left")
    listed = lambda c: F.coalesce(c, F.array().cast("array<string>")).alias(c)
    total = F.coalesce("n_outgoing", F.lit(0)) + F.coalesce("n_backlinks", F.lit(0))
    tags = F.slice(F.coalesce("tags", F.array().cast("array<string>")), 1, most).alias("tags")
    return found.select("path", "title", tags, listed("outgoing"), listed("backlinks"), listed("neighbours"), total.cast("long").alias("link_count"))


def matching(contexts: DataFrame, pages: DataFrame, words: list[str]) -> DataFrame:
    """The contexts of pages that hold one of the words in title, path or text, whatever its case."""
    hit = F.lit(False)
    for word in words:
        hit = hit | F.contains(F.lower(F.concat_ws(" ", "title", "path", "content")), F.lit(word.lower()))
    return contexts.join(pages.select("path", "content"), "path").where(hit).drop("content")


def latest_versions(history: DataFrame) -> DataFrame:
    """``path`` and ``latest_version`` (timestamp, author, tool) of a history of writes; ties go to the greater author and tool."""
    version = F.struct("timestamp", "author", "tool")
    return history.where("timestamp is not null").groupBy("path").agg(F.max(version).alias("latest_version"))


def enriched(results: DataFrame, contexts: DataFrame, history: DataFrame, related: Column | None = None) -> DataFrame:
    """Ranked results (path, ...) with ``related_to``, the fields of their context and ``latest_version``; a result without a page keeps its row, with nulls.

    ``kind`` is graph for a result that was found by pages it's related to, else wiki."""
    related = F.coalesce(related if related is not None else F.array().cast("array<string>"), F.array().cast("array<string>"))
    rows = results.withColumn("related_to", related).withColumn("kind", F.when(F.size("related_to") > 0, "graph").otherwise("wiki"))
    return rows.join(contexts.drop(*[c for c in results.columns if c != "path"]), "path", "left").join(latest_versions(history), "path", "left")
