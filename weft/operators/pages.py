"""Derived pages and lifecycle rules: index, unique names, recent sections, source moves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def index_sections(pages: DataFrame) -> DataFrame:
    """(type, entries, section): a section of the index for each type of pages (type, title, target), titles in order."""
    line = F.concat(F.lit("- [["), "target", F.lit("|"), "title", F.lit("]]"))
    rows = pages.select("type", F.struct(F.lower("title").alias("k"), F.col("target"), line.alias("line")).alias("e"))
    grouped = rows.groupBy("type").agg(F.count("*").alias("entries"), F.array_sort(F.collect_list("e")).alias("e"))
    return grouped.select("type", "entries", F.concat(F.lit("## "), "type", F.lit("\n"), F.array_join(F.transform("e", lambda x: x.line), "\n")).alias("section"))


def unique_names(rows: DataFrame, name: str, order: Column) -> DataFrame:
    """Rows with ``unique``: the name, and -2, -3 and so on behind it for the later ones of one name."""
    n = F.row_number().over(Window.partitionBy(name).orderBy(order))
    stem, ext = F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 2)
    return rows.withColumn("_n", n).withColumn("unique", F.when(F.col("_n") == 1, F.col(name)).otherwise(F.concat(stem, F.lit("-"), F.col("_n").cast("string"), ext))).drop("_n")


def recent(old: DataFrame, new: DataFrame, key: str, order: str, n: int = 200) -> DataFrame:
    """New entries before old ones, each key once as it stands first, the first n. ``order``: smaller is earlier."""
    rows = new.withColumn("_s", F.lit(0)).unionByName(old.withColumn("_s", F.lit(1)))
    first = rows.groupBy(key).agg(F.min_by(F.struct(*[c for c in rows.columns if c != key]), F.struct("_s", F.col(order))).alias("r"))
    return first.select(key, "r.*").orderBy("_s", order).limit(n).drop("_s")


def move_source(pages: DataFrame, old: str, new: str, known: DataFrame) -> DataFrame:
    """Pages (sources) after a source moved: its identity is replaced, and its bare name where only one known source (path) has it."""
    name = old.rsplit("/", 1)[-1].lower()
    alone = known.where(F.lower(F.element_at(F.split("path", "/"), -1)) == name).agg(F.count("*").alias("same"))
    hit = lambda s: (F.lower(s) == old.lower()) | ((F.lower(s) == name) & ~F.contains(s, F.lit("/")) & (F.col("same") == 1))
    return pages.join(F.broadcast(alone)).withColumn("sources", F.array_distinct(F.transform("sources", lambda s: F.when(hit(s), F.lit(new)).otherwise(s)))).drop("same")


def clean_answer(text: Column) -> Column:
    """An answer without thinking blocks and comments."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"(?is)<think(ing)?>.*?</think(ing)?>", ""), r"(?s)<!--.*?-->", ""))


def answer_title(text: Column) -> Column:
    """The first visible line of an answer without heading marks, up to 60 characters."""
    lines = F.filter(F.transform(F.split(clean_answer(text), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.substring(F.regexp_replace(F.get(lines, F.lit(0)), r"^#+\s*", ""), 1, 60)
