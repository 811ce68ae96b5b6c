"""Reviews: merging by content, filtering, and resolution against the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.functions import measures as M
from weft.functions import text as T


def with_ids(reviews: DataFrame) -> DataFrame:
    """Reviews with the id that their type and normalised title give."""
    return reviews.withColumn("id", M.review_id(F.col("type"), F.col("title")))


def merge(reviews: DataFrame, order: str = "pos", last_option: bool = False) -> DataFrame:
    """One review for each id: resolved if any is, created first, the first description that isn't empty, lists united, and
    for each action the first option (or the last one)."""
    first = F.min_by("description", F.when(F.coalesce("description", F.lit("")) != "", F.col(order)))
    pick = F.max_by if last_option else F.min_by
    options = reviews.select("id", order, F.posexplode("options").alias("k", "o")).groupBy("id", F.col("o.action").alias("action")).agg(pick("o", F.struct(F.col(order), F.col("k"))).alias("o"), F.min(F.struct(F.col(order), F.col("k"))).alias("at"))
    options = options.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "o"))), lambda x: x.o).alias("options"))
    united = lambda c: F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), F.col(c).alias("v")))), lambda x: x.v)))
    out = reviews.groupBy("id").agg(F.min_by("type", order).alias("type"), F.min_by("title", order).alias("title"), F.bool_or("resolved").alias("resolved"), F.min("created_at").alias("created_at"), first.alias("description"), united("pages").alias("pages"), united("queries").alias("queries"))
    return out.join(options, "id", "left")


def update(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Stored reviews (id, type, title, description, resolved, created_at) with new ones: the incoming description wins, what is resolved stays so."""
    n = incoming.select("id", *[F.col(c).alias(f"n_{c}") for c in ("type", "title", "description", "resolved", "created_at")])
    rows = stored.join(n, "id", "full_outer")
    new = F.when(F.coalesce("n_description", F.lit("")) != "", F.col("n_description"))
    return rows.select("id", F.coalesce("type", "n_type").alias("type"), F.coalesce("n_title", "title").alias("title"), F.coalesce(new, "description").alias("description"), F.coalesce("resolved", "n_resolved").alias("resolved"), F.coalesce("created_at", "n_created_at").alias("created_at"))


def select(merged: DataFrame, resolved: bool | None = None, kind: str | None = None, limit: int = 200) -> DataFrame:
    """Merged reviews by status and type, the newest ``limit`` (at most 1000)."""
    rows = merged if resolved is None else merged.where(F.col("resolved") == resolved)
    rows = rows if kind is None else rows.where(F.col("type") == kind)
    return rows.orderBy(F.col("created_at").desc(), "id").limit(min(max(limit, 1), 1000))


def sweep(reviews: DataFrame, pages: DataFrame) -> DataFrame:
    """(id, action) of reviews that the corpus resolves: a missing page that is there by id, hyphened id or title, and a duplicate
    of which a page is gone. Other types are never resolved by rule. reviews: (id, type, title, pages)."""
    names = pages.select(F.explode(F.array(F.lower("page_id"), F.regexp_replace(F.lower("page_id"), "-", " "), F.lower(F.trim("title")))).alias("key")).distinct()
    leaf = lambda c: F.regexp_replace(F.lower(T.file_name(c)), r"\.md$", "")
    asked = reviews.where("type = 'missing-page'")
    own = F.array(T.review_title_key(F.col("title")), F.regexp_replace(T.review_title_key(F.col("title")), r"\s+", "-"))
    wanted = asked.select("id", F.explode(F.concat(own, F.transform(F.coalesce("pages", F.array().cast("array<string>")), leaf))).alias("key"))
    found = wanted.join(names, "key", "left_semi").select("id").distinct().withColumn("action", F.lit("page-exists"))
    twice = reviews.where("type = 'duplicate' and size(pages) > 0").select("id", F.explode("pages").alias("p")).withColumn("key", leaf(F.col("p")))
    there = twice.join(names.withColumn("hit", F.lit(True)), "key", "left").groupBy("id").agg(F.bool_and(F.coalesce("hit", F.lit(False))).alias("every"))
    return found.unionByName(there.where(~F.col("every")).select("id", F.lit("page-gone").alias("action")))


def resolve_many(reviews: DataFrame, ids: DataFrame) -> DataFrame:
    """(pos, id, found) of requested ids (pos, id), in their order."""
    return ids.join(reviews.select("id", F.lit(True).alias("found")).distinct(), "id", "left").select("pos", "id", F.coalesce("found", F.lit(False)).alias("found")).orderBy("pos")
