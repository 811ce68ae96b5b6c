"""Lifecycle and assembly rules: destination names, page drafts, guarded edits, context and answers, reference lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.functions import text as T
from weft.functions.files import natural_key
from weft.operators.dedup import except_ci


def destination_names(wanted: DataFrame, taken: DataFrame, date: str, epoch: int) -> DataFrame:
    """(name, path): the first free one of name, name-date, name-date-2 to -99, name-epoch; ``taken`` has path."""
    stem, ext = F.regexp_extract("name", r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract("name", r"^(.*?)(\.[^.]*)?$", 2)
    nth = F.transform(F.sequence(F.lit(2), F.lit(99)), lambda i: F.concat(stem, F.lit(f"-{date}-"), i.cast("string"), ext))
    tries = F.concat(F.array("name", F.concat(stem, F.lit(f"-{date}"), ext)), nth, F.array(F.concat(stem, F.lit(f"-{epoch}"), ext)))
    options = wanted.select("name", F.posexplode(tries).alias("ordinal", "path"))
    free = options.join(taken.select("path").distinct(), "path", "left_anti")
    return free.groupBy("name").agg(F.min_by("path", "ordinal").alias("path"))


def page_drafts(reviews: DataFrame) -> DataFrame:
    """(id, title, type, path) of pages that reviews (id, type, title) ask for: the title without its prefix, the kind by words in it."""
    title = F.trim(F.regexp_replace(F.trim("title"), T.REVIEW_PREFIX, ""))
    low = F.lower("title")
    kind = F.when(low.rlike("comparison|compare|比较"), "comparison").when(low.rlike("synthesis|综合"), "synthesis").when(low.rlike("person|people|organi[sz]ation|company|tool|product|entity|人物|组织|公司"), "entity").when(F.col("type") == "contradiction", "query").otherwise("concept")
    folder = F.create_map(*[F.lit(x) for p in (("comparison", "comparisons"), ("synthesis", "synthesis"), ("entity", "entities"), ("query", "queries"), ("concept", "concepts")) for x in p])
    rows = reviews.select("id", title.alias("title"), kind.alias("type")).where((F.char_length("title") >= 1) & (F.char_length("title") <= 200))
    return rows.withColumn("path", F.concat(F.lit("wiki/"), folder[F.col("type")], F.lit("/"), T.slug(F.col("title"), 120), F.lit(".md")))


def guarded_edits(pages: DataFrame, edits: DataFrame) -> DataFrame:
    """(path, content, applied): an edit (path, prefix, selection, suffix, replacement) counts only if the page still is prefix, selection and suffix."""
    rows = pages.select("path", "content").join(edits, "path")
    same = F.col("content") == F.concat("prefix", "selection", "suffix")
    return rows.select("path", F.when(same, F.concat("prefix", "replacement", "suffix")).otherwise(F.col("content")).alias("content"), same.alias("applied"))


def cascade_delete(pages: DataFrame, source: str) -> DataFrame:
    """(path, decision, sources) of pages (path, sources) when a source goes, by its identity or, where a reference has no folder, by name."""
    name = source.rsplit("/", 1)[-1].lower()
    hit = lambda s: (F.lower(s) == source.lower()) | (~F.contains(s, F.lit("/")) & (F.lower(s) == name))
    left = F.filter("sources", lambda s: ~hit(s))
    decision = F.when(F.size(left) == F.size("sources"), "skip").when(F.size(left) == 0, "delete").otherwise("keep")
    return pages.select("path", decision.alias("decision"), left.alias("sources"))


def related_pages(pages: DataFrame, source: str) -> DataFrame:
    """Paths of pages (path, content, sources) that a source stands behind: its quoted name, its summary page, or its place among the sources."""
    name = source.rsplit("/", 1)[-1]
    stem = name.rsplit(".", 1)[0]
    quoted = F.contains("content", F.lit(f'"{name}"')) | F.contains("content", F.lit(f"'{name}'"))
    summary = F.col("path").rlike(r"^wiki/sources/[^/]*$") & T.file_name(F.col("path")).startswith(stem)
    named = F.exists("sources", lambda s: F.lower(T.file_name(s)) == name.lower())
    return pages.where((quoted | summary | named) & ~T.file_stem(F.col("path")).isin("index", "log", "overview")).select("path")


def distinct_references(refs: DataFrame, order: str = "pos") -> DataFrame:
    """References (pos, kind, path, ...) by kind and path, the first of each."""
    return refs.withColumn("_r", F.row_number().over(Window.partitionBy("kind", "path").orderBy(order))).where("_r = 1").drop("_r")


def distinct_evidence(refs: DataFrame) -> DataFrame:
    return refs.agg(F.countDistinct("kind", "path").alias("evidence"))


def change_totals(edits: DataFrame) -> DataFrame:
    """(path, added, removed, tools) of edits (pos, path, added, removed, tool), in the order of first sight."""
    tools = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("pos", "tool"))), lambda x: x.tool))
    return edits.groupBy("path").agg(F.min("pos").alias("first"), F.sum("added").alias("added"), F.sum("removed").alias("removed"), tools.alias("tools")).orderBy("first").drop("first")


def image_groups(images: DataFrame) -> DataFrame:
    """(page, paths) of extracted images (page, path), pages by number, those without one last; paths in natural order."""
    grouped = images.groupBy("page").agg(F.transform(F.sort_array(F.collect_list(F.struct(natural_key(F.col("path")).alias("k"), "path"))), lambda x: x.path).alias("paths"))
    return grouped.orderBy(F.col("page").asc_nulls_last()).select(F.coalesce(F.concat(F.lit("Page "), F.col("page").cast("string")), F.lit("Document")).alias("page"), "paths")


def distinct_images(results: DataFrame, query: str) -> DataFrame:
    """(url, alt, path) of the images of ranked results (rank, path, images), each once with its first result, captions that match first."""
    rows = results.select("rank", "path", F.posexplode("images").alias("i", "image")).select("rank", "path", "i", "image.url", "image.alt")
    first = rows.groupBy("url").agg(F.min_by(F.struct("alt", "path", "rank", "i"), F.struct("rank", "i")).alias("r")).select("url", "r.*")
    return first.orderBy(F.contains(F.lower("alt"), F.lit(query.lower())).desc(), "rank", "i").select("url", "alt", "path")


def knowledge_context(pages: DataFrame, links: DataFrame, most: int = 20) -> DataFrame:
    """(id, outgoing, backlinks, link_count) of pages (id) with links (src, dst): sorted, distinct, cut to ``most``; the count is before the cut."""
    ways = F.array(F.struct(F.col("src").alias("id"), F.col("dst").alias("to"), F.lit(None).cast(links.schema["src"].dataType).alias("by")), F.struct(F.col("dst").alias("id"), F.lit(None).cast(links.schema["dst"].dataType).alias("to"), F.col("src").alias("by")))
    lists = links.select(F.inline(ways)).groupBy("id").agg(F.sort_array(F.collect_set("to")).alias("outgoing"), F.sort_array(F.collect_set("by")).alias("backlinks"))  # links are worked out once
    kind = pages.schema["id"].dataType.simpleString()
    none = F.array().cast(f"array<{kind}>")
    rows = pages.select("id").join(lists, "id", "left").select("id", F.coalesce("outgoing", none).alias("outgoing"), F.coalesce("backlinks", none).alias("backlinks"))
    return rows.select("id", F.slice("outgoing", 1, most).alias("outgoing"), F.slice("backlinks", 1, most).alias("backlinks"), (F.size("outgoing") + F.size("backlinks")).alias("link_count"))


def answer_from_references(refs: DataFrame, most: int = 10) -> DataFrame:
    """One row: the titles, paths and snippets of the first references (pos, title, path, snippet) as a list, without a model."""
    line = F.concat(F.lit("- **"), "title", F.lit("** ("), "path", F.lit(")"), F.when(F.coalesce("snippet", F.lit("")) != "", F.concat(F.lit(": "), T.collapse(F.col("snippet")))).otherwise(""))
    top = refs.orderBy("pos").limit(most).select("pos", line.alias("line"))
    return top.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x.line), "\n").alias("answer"))


def fit_context(system: Column, user: Column, model_chars: int) -> tuple[Column, Column]:
    """System and user text cut to a model's size, bounded to 8 000 and 400 000 characters: the user's text keeps its place first."""
    size = min(max(model_chars, 8_000), 400_000)
    kept = F.substring(user, F.lit(1), F.lit(size))
    return F.substring(system, F.lit(1), F.greatest(F.lit(0), F.lit(size) - F.char_length(kept))), kept


def dismissed(insights: DataFrame, keys: DataFrame) -> DataFrame:
    """Insights (src, dst) whose stable key isn't among the dismissed ones (key)."""
    key = F.concat_ws(":::", F.least(F.col("src").cast("string"), F.col("dst").cast("string")), F.greatest(F.col("src").cast("string"), F.col("dst").cast("string")))
    return insights.withColumn("key", key).join(keys.select("key").distinct(), "key", "left_anti")


def image_sources(images: DataFrame, sources: DataFrame) -> DataFrame:
    """(image, source): extracted images (path: .../media/<slug>/file) back to sources (path) by the slug of their names."""
    owner = F.element_at(F.split("path", "/"), -2)
    slugs = sources.select(F.explode(F.array_distinct(F.array(F.lower(T.file_stem(F.col("path"))), T.slug(T.file_stem(F.col("path")), 120), T.slug(T.file_name(F.col("path")), 120)))).alias("slug"), F.col("path").alias("source"))
    first = slugs.groupBy("slug").agg(F.min("source").alias("source"))
    return images.select(F.col("path").alias("image"), F.lower(owner).alias("slug")).join(first, "slug").select("image", "source")


def caption_context(text: Column, needle: Column, around: int = 150) -> Column:
    """The characters on both sides of an image's place in a text."""
    at = F.position(needle, text)
    start = F.greatest(at - around, F.lit(1))
    return F.when(at > 0, F.substring(text, start, at - start + F.char_length(needle) + around))


def whitelist_insert(whitelist: DataFrame, groups: DataFrame) -> DataFrame:
    """The whitelist (key) with the canonical keys of groups (ids) that it lacks."""
    from weft.operators.dedup import group_key

    new = groups.select(group_key(F.col("ids")).alias("key")).distinct().join(whitelist.select("key"), "key", "left_anti")
    return whitelist.select("key").unionByName(new)


def without_source(sources: Column, gone: str) -> Column:
    return except_ci(sources, F.lit(gone))
