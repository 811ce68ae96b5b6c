"""Small rules of the corpus: ordered tokens, similarity texts, summaries, routing and language guards, lint fixes, unions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.functions import languages
from weft.functions import text as T

# What separates the tokens of the ordered tokenizer.
SEPARATORS = r"""[\s,，。！？、；：""''（）()\-_/\\·~～…]+"""
HAN = r"[一-鿿㐀-䶿]"
FAMILY = ("Chinese", "Traditional Chinese", "Japanese", "Korean")
OWN_SCRIPT = ("Arabic", "Persian", "Hindi", "Thai", "Hebrew")
ARABIC_SCRIPT = ("Arabic", "Persian")


def _units(text: Column) -> Column:
    """UTF-16 code units: characters of four bytes count twice."""
    return F.char_length(text) + F.char_length(F.regexp_replace(text, r"[^\x{10000}-\x{10FFFF}]", ""))


def ordered_tokens(text: Column) -> Column:
    """Distinct tokens in the order of first sight: no single units, no stop words; a run with Han characters of three units and
    more gives its pairs, its characters that aren't stop words, and itself."""
    stop = F.array(*map(F.lit, sorted(T.STOP_WORDS)))
    raw = F.filter(F.split(F.lower(text), SEPARATORS), lambda t: (_units(t) > 1) & ~F.array_contains(stop, t))

    def expanded(t: Column) -> Column:
        chars = F.split(t, "")
        pairs = F.transform(F.slice(chars, F.lit(1), F.size(chars) - 1), lambda c, i: F.concat(c, F.get(chars, i + 1)))
        return F.when(t.rlike(HAN) & (_units(t) > 2), F.concat(pairs, F.filter(chars, lambda c: ~F.array_contains(stop, c)), F.array(t))).otherwise(F.array(t))

    return F.array_distinct(F.flatten(F.transform(raw, expanded)))


def similarity_text(page_id: Column, title: Column, tags: Column, body: Column, most: int = 1500) -> Column:
    """What a page is compared by: the leaf of its id, title, tags and the body's start, those that are there, by lines."""
    parts = F.array(F.element_at(F.split(page_id, "/"), -1), title, F.array_join(tags, " "), F.substring(body, 1, most))
    return F.array_join(F.filter(parts, lambda x: F.trim(x) != ""), "\n")


def shortened(text: Column, most: int) -> Column:
    return F.when(F.char_length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most - 1), F.lit("…")))


def entity_summary(path: Column, content: Column, most: int = 200) -> Column:
    """slug, type, title, description and tags of a page with frontmatter, null without: the description is that of the
    frontmatter, else the first line of the body that is no heading and no table."""
    slug = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.md$", "")
    own = lambda name, other: F.when(T.scalar_field(content, name) != "", T.scalar_field(content, name)).otherwise(other)
    lines = F.transform(F.split(T.strip_frontmatter(content), "\n"), lambda x: F.trim(x, F.lit(" \t\r")))
    first = F.get(F.filter(lines, lambda x: (x != "") & ~x.startswith("#") & ~x.startswith("|")), F.lit(0))
    found = F.struct(slug.alias("slug"), own("type", F.lit("unknown")).alias("type"), own("title", slug).alias("title"), shortened(own("description", first), most).alias("description"), T.list_field(content, "tags").alias("tags"))
    return F.when(T.frontmatter(content) != "", found)


def routing_issue(path: Column, kind: Column, folders: dict[str, str]) -> Column:
    """What is wrong with a page's place: a type that belongs elsewhere, or a folder that belongs to another type; null if nothing is."""
    here = F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise("")
    by_type = F.create_map(*[F.lit(x) for pair in folders.items() for x in pair])
    by_folder = F.create_map(*[F.lit(x) for kind_, folder in {f: k for k, f in reversed(folders.items())}.items() for x in (kind_, folder)])
    wanted, holds = by_type[kind], by_folder[here]
    misplaced = F.concat(F.lit('Page type "'), kind, F.lit('" must be under "'), wanted, F.lit('/". Current directory: "'), here, F.lit('".'))
    mistyped = F.concat(F.lit('Pages under "'), here, F.lit('/" must use type "'), holds, F.lit('", but found "'), kind, F.lit('".'))
    return F.when(F.trim(F.coalesce(kind, F.lit(""))) == "", None).when(wanted != here, misplaced).when(holds != kind, mistyped)


def in_target_language(content: Column, target: str, sample: int = 1500, least: int = 20) -> Column:
    """Whether a page's prose is of the target's family: without frontmatter, code and formulas, by its first characters;
    too short a page passes. Han, kana and hangul are one family, Latin scripts another, others stand alone."""
    end = F.locate("\n---\n", content, 4)
    body = F.when(end > 0, F.substring(content, end + 5, F.char_length(content))).otherwise(content)
    for pattern in (r"(?s)```.*?```", r"(?s)\$\$.*?\$\$", r"\$[^$\n]*\$"):
        body = F.regexp_replace(body, pattern, "")
    start = F.substring(body, 1, sample)
    found = languages.detect(start)
    if target in FAMILY:
        same = found.isin(*FAMILY)
    elif target in OWN_SCRIPT:
        same = found == target
    else:
        same = ~found.isin(*FAMILY, *OWN_SCRIPT)
    return (F.char_length(F.trim(start, F.lit(" \t\r\n"))) < least) | same


# ---- lint fixes

LINK = re.compile(r"\[\[([^\]|]+?)(\|[^\]]+?)?\]\]")


def link_target(target: str) -> str:
    """A link's target without wiki/ before and .md behind it."""
    path = re.sub("/{2,}", "/", target.replace("\\", "/"))
    return re.sub(r"\.md$", "", re.sub("^wiki/", "", path, flags=re.I), flags=re.I).strip()


def add_related(content: str, target: str) -> str:
    """The page with a link to the target in its list of related pages, which is made if need be; unchanged if it links there."""
    name = link_target(target)
    if any(link_target(m[1]).lower() == name.lower() for m in LINK.finditer(content)):
        return content
    heading = re.search(r"^##\s+Related\s*$", content, re.I | re.M)
    if heading:
        return f"{content[: heading.end()]}\n- [[{name}]]{content[heading.end() :]}"
    return f"{content.rstrip()}\n\n## Related\n- [[{name}]]\n"


def retarget(content: str, broken: str, better: str) -> str:
    """The page with its links to a broken target led to a better one; aliases stay."""
    old, new = link_target(broken).lower(), link_target(better)
    return LINK.sub(lambda m: f"[[{new}{m[2] or ''}]]" if link_target(m[1]).lower() == old else m[0], content)


def stub_path(broken: str) -> str:
    """Where a page for a broken target is to be made: the slugs of its folders and name, below queries/ without a folder."""
    from weft.functions.parse import query_slug

    parts = [query_slug(p) for p in link_target(broken).split("/") if p.strip()]
    return ("/".join(parts) if len(parts) > 1 else f"queries/{parts[0] if parts else 'missing-page'}") + ".md"


# ---- relations


def provider_union(results: list[DataFrame], most: int = 20) -> DataFrame:
    """Results (pos, url, ...) of several search services: each url once, in the order of services and places, the first ``most``."""
    every = results[0].withColumn("service", F.lit(0))
    for number, more in enumerate(results[1:], 1):
        every = every.unionByName(more.withColumn("service", F.lit(number)))
    first = every.withColumn("_r", F.row_number().over(Window.partitionBy("url").orderBy("service", "pos"))).where("_r = 1").drop("_r")
    return first.orderBy("service", "pos").limit(most)


def allowed_blocks(blocks: DataFrame, allowed: DataFrame) -> DataFrame:
    """Repaired blocks (pos, path, ...) of allowed paths (path), the first of each path."""
    kept = blocks.join(allowed.select("path").distinct(), "path", "left_semi")
    return kept.withColumn("_r", F.row_number().over(Window.partitionBy("path").orderBy("pos"))).where("_r = 1").drop("_r")


def newest_first(sessions: DataFrame, changed: str = "updated_at", key: str = "id") -> DataFrame:
    """Conversations by their last change, the newest first; ties by id, the greatest first."""
    return sessions.orderBy(F.col(changed).desc(), F.col(key).desc())


def resolve_paths(links: DataFrame, files: DataFrame) -> DataFrame:
    """(link, path) of links (link): the file of that path, else the first one by path of that name; nothing found is null."""
    key = lambda c: F.lower(T.normalize_path(c))
    known = files.select("path", key(F.col("path")).alias("whole"), F.lower(T.file_name(F.col("path"))).alias("name"))
    by_path = known.groupBy("whole").agg(F.min("path").alias("p"))
    by_name = known.groupBy("name").agg(F.min("path").alias("n"))
    asked = links.withColumns({"whole": key(F.col("link")), "name": F.lower(T.file_name(F.col("link")))})
    return asked.join(by_path, "whole", "left").join(by_name, "name", "left").select("link", F.coalesce("p", "n").alias("path"))
