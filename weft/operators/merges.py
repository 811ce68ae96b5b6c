"""Carrying out merges of duplicate pages as one transaction: backup, merged pages, rewritten references, deletes and index lines.

Groups (page, canonical) may be many: redirects are joined to the pages that name them, so the work follows the
links, not pages times groups. All steps are staged under the merge's key, and one log entry makes them count; a run that was
killed takes up the steps that it had finished, and a merge that was committed isn't done again.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.functions import parse
from weft.functions import text as T
from weft.functions.rowwise import rowwise_pair
from weft.session import materialize
from weft.sources.store import Store

SCHEMAS = {"pages": "path string, content string", "backup": "key string, path string, content string, added boolean", "merges": "key string, page string, canonical string"}
INDEX = "wiki/index.md"
UNITED = ("sources", "tags", "related")
LINK = re.compile(r"\[\[([^\]|]+)(\|[^\]]*)?\]\]")
STEPS = ("backup", "canonical", "rewrites", "deletes", "index")


def _rewritten(content: str, moves: dict[str, str]) -> str:
    """A page whose links and ``related`` list lead to the canonical pages; aliases stay, a list names each page once."""
    out = LINK.sub(lambda m: f"[[{moves[m[1].strip().lower()]}{m[2] or ''}]]" if m[1].strip().lower() in moves else m[0], content)
    fields, _ = parse.frontmatter(out)
    items = fields.get("related")
    items = [items] if isinstance(items, str) else items
    if items and any(x.lower() in moves for x in items):
        seen: dict[str, str] = {}
        for x in items:
            x = moves.get(x.lower(), x)
            seen.setdefault(x.lower(), x)
        out = parse.set_list(out, "related", list(seen.values()))
    return out


def _united(merged: str, members: list[str], today: str) -> str:
    """A merged page with the lists of all members united, first spellings first, and the day of its update."""
    for name in UNITED:
        seen: dict[str, str] = {}
        for text in (merged, *members):
            items = parse.frontmatter(text)[0].get(name, [])
            for x in [items] if isinstance(items, str) else items:
                seen.setdefault(x.lower(), x)
        if seen:
            merged = parse.set_list(merged, name, list(seen.values()))
    found = parse.FRONT.match(merged)
    if not found:
        return f"---\nupdated: {today}\n---\n{merged}"
    block = re.sub(r"(?m)^updated:.*$", f"updated: {today}", found[1]) if re.search(r"(?m)^updated:", found[1]) else f"{found[1]}\nupdated: {today}"
    return f"---\n{block}\n---\n{merged[found.end() :]}"


def checked(pages: DataFrame, groups: DataFrame) -> DataFrame:
    """``(page, canonical, path)`` of groups (page, canonical), or an error: each group needs two pages, its canonical one among them, all of them there;
    a page is in one group and has one path. The last path in order counts for an id that stands for several."""
    ids = pages.select(T.file_stem(F.col("path")).alias("page"), "path").where("path like '%.md'").groupBy("page").agg(F.max("path").alias("path"))
    named = groups.select("page", "canonical").distinct()
    bad = named.groupBy("canonical").agg(F.count("*").alias("n"), F.count_if(F.col("page") == F.col("canonical")).alias("own")).where("n < 2 or own <> 1").limit(5).collect()
    twice = named.groupBy("page").count().where("count > 1").limit(5).collect()
    missing = named.join(ids, "page", "left_anti").limit(5).collect()
    if bad or twice or missing:
        raise ValueError(f"groups without two pages or their canonical one: {[r.canonical for r in bad]}; pages in several groups: {[r.page for r in twice]}; pages that aren't there: {[r.page for r in missing]}")
    return named.join(ids, "page")


def plan(pages: DataFrame, groups: DataFrame, merge: Callable[[str, list[str]], str], today: str, key: str) -> dict[str, DataFrame]:
    """What each step writes, computed from the pages before any write: ``backup`` (key, path, content, added), ``canonical``, ``rewrites`` and ``index`` (path, content), ``deletes`` (path).

    ``merge(canonical, contents)`` is an injected function from a group's whole pages, the canonical one first, to the merged page. A group is merged in one call,
    so its pages are in one task; a group is what a user confirmed."""
    members = materialize(checked(pages, groups), "members")  # a row for each page of the groups, asked for by every step
    texts = members.join(pages, "path").select("canonical", "page", "path", "content")

    def merged(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for canonical, path, contents in zip(part.canonical, part.path, part.contents, strict=True):
                contents = [c["content"] or "" for c in contents]
                rows.append((path, _united(merge(canonical, contents), contents, today)))
            yield pd.DataFrame(rows, columns=["path", "content"])

    gathered = texts.groupBy("canonical").agg(F.max_by("path", F.col("page") == F.col("canonical")).alias("path"), F.array_sort(F.collect_list(F.struct((F.col("page") != F.col("canonical")).alias("later"), "page", "content"))).alias("contents"))
    canonical = gathered.mapInPandas(merged, SCHEMAS["pages"])

    moves = members.where("page <> canonical").select(F.lower("page").alias("from"), "canonical")
    others = pages.join(members.select("path"), "path", "left_anti").where(F.col("path") != INDEX)
    related = F.regexp_extract_all("content", F.lit(r"(?m)[\"'\-\[,:]\s*([^\"'\[\],:\n]+?)\s*[\"']?\s*(?=[,\]\n])"), 1)
    named = F.array_union(F.regexp_extract_all("content", F.lit(r"\[\[([^\]|]+)(\|[^\]]*)?\]\]"), 1), F.when(F.col("content").rlike(r"(?m)^related:"), related).otherwise(F.array().cast("array<string>")))
    hits = others.select("path", F.explode(F.array_distinct(F.transform(named, lambda x: F.lower(F.trim(x))))).alias("from")).join(moves, "from")
    moved = hits.groupBy("path").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("from", "canonical")))).alias("moves"))

    def rewrite(content: str, said: str) -> str:
        import json

        return _rewritten(content, json.loads(said))

    rewrites = others.join(moved, "path").select("path", F.col("content").alias("old"), rowwise_pair(rewrite, "string")(F.col("content"), F.col("moves")).alias("content")).where("old <> content").select("path", "content")

    # index lines that name a merged page by [[id]], [[id|..]] or (..id.md)
    index = pages.where(F.col("path") == INDEX)
    lines = index.select("path", F.posexplode(F.split("content", "\n")).alias("n", "line"))
    refs = F.array_union(F.regexp_extract_all("line", F.lit(r"\[\[([^\]|]+)(\|[^\]]*)?\]\]"), 1), F.regexp_extract_all("line", F.lit(r"\((?:\./)?(?:[^)\s]*/)?([^)\s/]+)\.md\)"), 1))
    item = F.col("line").rlike(r"^\s*[-*]\s")
    dead = lines.where(item).select("n", F.explode(F.transform(refs, lambda x: F.lower(F.trim(x)))).alias("from")).join(moves, "from", "left_semi").select("n").distinct()
    new_index = lines.join(dead, "n", "left_anti").groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x.line), "\n").alias("content"))
    new_index = new_index.join(index.select("path", F.col("content").alias("old")), "path").where("old <> content").select("path", "content")

    deletes = members.where("page <> canonical").select("path")
    touched = members.select("path").unionByName(rewrites.select("path")).unionByName(new_index.select("path")).distinct()
    backup = pages.join(touched, "path").select(F.lit(key).alias("key"), "path", "content", F.lit(False).alias("added"))
    return {"backup": backup, "canonical": canonical, "rewrites": rewrites, "deletes": deletes, "index": new_index}


def execute(store: Store, run: int, groups: DataFrame, merge: Callable[[str, list[str]], str], key: str, today: str, after: Callable[[str], None] = lambda step: None) -> int:
    """Merge groups (page, canonical) of the store's pages under a key; the number of the log entry.

    Each step is staged in turn, ``after(step)`` is called behind each (tests kill the run there). Pages are first pinned to the entry that the merge began from, so that a repeated run
    computes the same; if the pages have changed meanwhile, the merge begins anew from the present ones. Nothing counts before the one entry at the end."""
    if store.finished(key):
        return store.latest()[0]
    base, entry = store.latest()
    # the state that the steps are computed from names their folders: other pages, other folders
    label = f"{key}-{abs(hash_of(entry['tables'].get('pages', [])))}"
    pages = store.read("pages", base)
    groups = materialize(groups.select("page", "canonical"), "groups")  # worked out once, however it was made
    steps = plan(pages, groups, merge, today, key)
    after("plan")
    staged = {}
    for step in STEPS:
        rows = steps[step]
        name = "backup" if step == "backup" else "pages"
        rows = rows if step != "deletes" else rows.withColumn("content", F.lit(None).cast("string"))
        staged[step] = store.stage(rows, name, f"{label}-{step}")
        after(step)
    new = store.staged("pages", staged["canonical"]).unionByName(store.staged("pages", staged["rewrites"])).unionByName(store.staged("pages", staged["index"]))
    gone = store.staged("pages", staged["deletes"]).select("path").unionByName(new.select("path"))
    whole = store.stage(pages.join(gone, "path", "left_anti").unionByName(new), "pages", f"{label}-whole")
    after("pages")
    done = store.stage(groups.select(F.lit(key).alias("key"), "page", "canonical"), "merges", f"{label}-merges")
    number = store.commit(run, {"pages": whole}, {"backup": staged["backup"], "merges": done}, key, base)
    after("commit")
    store.discard([f for s, f in staged.items() if s != "backup"])
    after("clean")
    return number


def hash_of(folders: list[str]) -> int:
    import zlib

    return zlib.crc32("|".join(folders).encode())


def roll_back(store: Store, run: int, key: str) -> int:
    """Put back the pages that a merge touched, as they were before it; other pages keep what came later. A second call changes nothing."""
    if not store.finished(key):
        raise ValueError(f"no merge {key}")
    base = store.latest()[0]
    old = store.read("backup", base).where(F.col("key") == key).select("path", "content")
    pages = store.read("pages", base)
    return store.commit(run, {"pages": store.stage(pages.join(old.select("path"), "path", "left_anti").unionByName(old), "pages")}, key=f"{key}/rolled-back", base=base)
