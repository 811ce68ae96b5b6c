"""Column builders for page text: tokens, titles, links, snippets, slugs and similarity."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The stop words and the separators of query text that results depend on.
STOP_WORDS_ZH = ["的", "是", "了", "什么", "在", "有", "和", "与", "对", "从"]
STOP_WORDS_EN = [
    "the", "is", "a", "an", "what", "how", "are", "was", "were", "do", "does", "did", "be", "been", "being", "have",
    "has", "had", "it", "its", "in", "on", "at", "to", "for", "of", "with", "by", "this", "that", "these", "those",
]
CJK_MARKS = "，。！？、；：“”‘’（）·～…"
STOP_WORDS = STOP_WORDS_ZH + STOP_WORDS_EN
ASCII_MARKS = r"!-/:-@\[-`{-~"
SEPARATORS = rf"[\s{ASCII_MARKS}{CJK_MARKS}]+"
CJK = "[㐀-鿿]"

# Search weights.
FILENAME_EXACT = 200.0
PHRASE_IN_TITLE = 50.0
PHRASE_IN_CONTENT = 20.0
PHRASE_CAP = 10
TITLE_TOKEN = 5.0
CONTENT_TOKEN = 1.0
SNIPPET_CONTEXT = 80


def tokenize_query(query: str) -> list[str]:
    """The sorted tokens of a query; empty if nothing but separators and stop words is left."""
    out: set[str] = set()
    for token in re.split(SEPARATORS, query.lower()):
        if len(token) < 2 or token in STOP_WORDS:
            continue
        out.add(token)
        if len(token) > 2 and re.search(CJK, token):
            out.update(token[i : i + 2] for i in range(len(token) - 1))
            out.update(c for c in token if c not in STOP_WORDS)
    return sorted(out)


def query_terms(query: str) -> list[str]:
    """Tokens to search by: the whole lower-cased query where no token is left."""
    return tokenize_query(query) or ([query.strip().lower()] if query.strip() else [])


def tokenize(text: Column) -> Column:
    """``tokenize_query`` for a column: a sorted array of distinct tokens."""
    stop = F.array(*map(F.lit, STOP_WORDS))
    raw = F.filter(F.split(F.lower(text), SEPARATORS), lambda t: (F.char_length(t) > 1) & ~F.array_contains(stop, t))
    pairs = lambda t: F.transform(F.sequence(F.lit(1), F.char_length(t) - 1), lambda i: F.substring(t, i, 2))
    singles = lambda t: F.filter(F.split(t, ""), lambda c: (c != "") & ~F.array_contains(stop, c))
    wide = lambda t: F.when((F.char_length(t) > 2) & t.rlike(CJK), F.concat(pairs(t), singles(t), F.array(t))).otherwise(F.array(t))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(raw, wide))))


def trim_punctuation(text: Column) -> Column:
    """Text without separators at both ends."""
    return F.regexp_replace(F.regexp_replace(text, f"^{SEPARATORS}", ""), f"{SEPARATORS}$", "")


def count_occurrences(text: Column, needle: str) -> Column:
    """How often a needle stands in a text without overlap; 0 for an empty needle."""
    if not needle:
        return F.lit(0)
    return ((F.char_length(text) - F.char_length(F.replace(text, F.lit(needle), F.lit("")))) / F.lit(len(needle))).cast("int")


def tokens_contained(text: Column, tokens: list[str]) -> Column:
    """How many of the tokens stand in the lower-cased text."""
    lower = F.lower(text)
    return sum((F.contains(lower, F.lit(t)).cast("int") for t in tokens), F.lit(0))


def keyword_signals(title: Column, file_name: Column, content: Column, query: str) -> dict[str, Column]:
    """The five signals of a page for a query, its score, whether it's a hit, and whether its title matches."""
    tokens, phrase = query_terms(query), re.sub(f"^{SEPARATORS}|{SEPARATORS}$", "", query.strip().lower())
    titled = F.concat_ws(" ", title, file_name)
    stem = F.lower(F.regexp_replace(file_name, r"(\.md)+$", ""))
    exact = (stem == phrase) if phrase else F.lit(False)
    in_title = F.contains(F.lower(titled), F.lit(phrase)) if phrase else F.lit(False)
    times = F.least(count_occurrences(F.lower(content), phrase), F.lit(PHRASE_CAP))
    title_tokens, content_tokens = tokens_contained(titled, tokens), tokens_contained(content, tokens)
    score = F.when(exact, FILENAME_EXACT).otherwise(0.0) + F.when(in_title, PHRASE_IN_TITLE).otherwise(0.0) + times * PHRASE_IN_CONTENT + title_tokens * TITLE_TOKEN + content_tokens * CONTENT_TOKEN
    hit = exact | in_title | (times > 0) | (title_tokens > 0) | (content_tokens > 0)
    return {"score": score, "hit": hit, "title_match": (title_tokens > 0) | in_title, "occurrences": times, "title_tokens": title_tokens, "content_tokens": content_tokens}


def snippet(content: Column, query: str, context: int = SNIPPET_CONTEXT) -> Column:
    """The text around the phrase if it stands in the content, else around the first token that does, else its start."""
    tokens, phrase = query_terms(query), re.sub(f"^{SEPARATORS}|{SEPARATORS}$", "", query.strip().lower())
    lower = F.lower(content)
    anchor = F.coalesce(*[F.when(F.contains(lower, F.lit(t)), F.lit(t)) for t in ([phrase] if phrase else []) + tokens], F.lit(query.lower()))
    return snippet_around(content, anchor, context)


def snippet_around(content: Column, anchor: Column, context: int = SNIPPET_CONTEXT) -> Column:
    at = F.greatest(F.position(F.lower(anchor), F.lower(content)), F.lit(1))
    start = F.greatest(at - context, F.lit(1))
    end = F.least(at - 1 + F.char_length(anchor) + context, F.char_length(content))
    body = F.replace(F.substring(content, start, end - start + 1), F.lit("\n"), F.lit(" "))
    return F.concat(F.when(start > 1, "...").otherwise(""), body, F.when(end < F.char_length(content), "...").otherwise(""))


def vector_snippet(chunk: Column, heading: Column, context: int = SNIPPET_CONTEXT) -> Column:
    """Up to 160 characters of a chunk, behind its heading path."""
    text = F.replace(F.trim(chunk), F.lit("\n"), F.lit(" "))
    text = F.when(F.char_length(text) > 2 * context, F.concat(F.substring(text, 1, 2 * context), F.lit("..."))).otherwise(text)
    named = F.when(F.trim(F.coalesce(heading, F.lit(""))) == "", text).otherwise(F.concat_ws(": ", F.trim(heading), text))
    return F.when(text == "", "").otherwise(named)


# ---- pages

FRONTMATTER = r"(?s)\A---[ \t]*\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|\z)"
WIKILINK = r"\[\[([^\]|]+?)(?:\|[^\]]+?)?\]\]"


def frontmatter(content: Column) -> Column:
    """The text between the opening fences, or an empty one."""
    return F.regexp_extract(content, FRONTMATTER, 1)


def strip_frontmatter(content: Column) -> Column:
    return F.regexp_replace(content, FRONTMATTER, "")


def scalar_field(content: Column, name: str) -> Column:
    """A scalar of the frontmatter without its quotes; empty where it's missing."""
    return F.trim(F.regexp_extract(frontmatter(content), rf"(?m)^{name}:[ \t]*[\"']?(.+?)[\"']?[ \t]*$", 1))


def list_field(content: Column, name: str) -> Column:
    """A list of the frontmatter, in block or inline form."""
    block = F.regexp_extract(frontmatter(content), rf"(?m)^{name}:[ \t]*\n((?:[ \t]+-[ \t]+.+\n?)*)", 1)
    inline = F.regexp_extract(frontmatter(content), rf"(?m)^{name}:[ \t]*\[([^\]]*)\]", 1)
    clean = lambda x: F.regexp_replace(F.trim(F.regexp_replace(x, r"^\s+-\s+", "")), "^[\"']|[\"']$", "")
    found = F.when(block != "", F.split(block, "\n")).otherwise(F.split(inline, ","))
    return F.filter(F.transform(found, clean), lambda x: x != "")


def title(content: Column, file_name: Column, underscores: bool = False) -> Column:
    """The frontmatter's title, else the first heading, else the file name in words."""
    heading = F.trim(F.regexp_extract(content, r"(?m)^#[ \t]+(.+)$", 1))
    named = F.regexp_replace(F.regexp_replace(file_name, r"\.md$", ""), "[-_]" if underscores else "-", " ")
    own = scalar_field(content, "title")
    return F.when(own != "", own).when(heading != "", heading).otherwise(named)


def page_type(content: Column) -> Column:
    own = F.lower(scalar_field(content, "type"))
    return F.when(own != "", own).otherwise("other")


def wikilinks(content: Column) -> Column:
    """Targets of [[target]] and [[target|alias]], trimmed, in order, repeats included."""
    return F.filter(F.transform(F.regexp_extract_all(content, F.lit(WIKILINK), F.lit(1)), lambda x: F.trim(x)), lambda x: x != "")


def scanned_links(content: Column) -> Column:
    """Targets by the scanner's rule: from [[ to the first ]], up to a pipe, trimmed, in order, repeats included."""
    closed = F.left(content, F.char_length(content) - F.char_length(F.substring_index(content, "]]", -1)))  # so that each [[ finds its end
    found = F.regexp_extract_all(closed, F.lit(r"(?s)\[\[(.*?)\]\]"), F.lit(1))
    return F.filter(F.transform(found, lambda x: F.regexp_replace(F.split(x, r"\|").getItem(0), r"(?U)^\s+|\s+$", "")), lambda x: x != "")


def link_address(text: Column) -> Column:
    """How links and names of pages meet in contexts: no fragment, no .md at the end, / as separator, lower case, hyphens for spaces."""
    cut = F.regexp_replace(F.regexp_replace(F.split(text, "#").getItem(0), r"(?U)^\s+|\s+$", ""), r"(\.md)+$", "")
    return F.replace(F.lower(F.replace(cut, F.lit("\\"), F.lit("/"))), F.lit(" "), F.lit("-"))


def image_refs(content: Column) -> Column:
    """URLs of ![alt](url), distinct, in order."""
    return F.array_distinct(F.regexp_extract_all(content, F.lit(r"!\[[^\]]*\]\(([^)\s]+)\)"), F.lit(1)))


def alias_key(text: Column) -> Column:
    """How links and aliases are compared in retrieval: no fragment, no .md, blanks as hyphens, lower case."""
    cut = F.regexp_replace(F.split(text, "#").getItem(0), r"\.md$", "")
    return F.lower(F.regexp_replace(F.trim(cut), r"\s+", "-"))


def target_key(text: Column) -> Column:
    """How link targets are compared in linting."""
    path = F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("/")), r"(?i)^wiki/", "")
    return F.lower(F.trim(F.regexp_replace(path, r"(?i)\.md$", "")))


def reference_key(text: Column) -> Column:
    """The leaf of a reference without .md, blanks, hyphens and underscores."""
    return F.regexp_replace(F.lower(F.regexp_replace(file_name(text), r"(?i)\.md$", "")), r"[\s\-_]+", "")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), -1)


def file_stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"\.[^.]+$", "")


def normalize_path(path: Column) -> Column:
    """Forward slashes, none twice, none at the end."""
    return F.regexp_replace(F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "/{2,}", "/"), "(?<=.)/$", "")


def string_similarity(a: Column, b: Column) -> Column:
    """1 for equal targets, 0.96 for equal leaves, 0.82 for containment, else one minus the relative edit distance of the
    leaves, 0 where one of them is under five characters."""
    left, right = target_key(a), target_key(b)
    la, lb = file_name(left), file_name(right)
    edit = 1 - F.levenshtein(la, lb) / F.greatest(F.char_length(la), F.char_length(lb))
    return (
        F.when((left == "") | (right == ""), 0.0)
        .when(left == right, 1.0)
        .when(la == lb, 0.96)
        .when(F.contains(right, left) | F.contains(left, right), 0.82)
        .when((F.char_length(la) < 5) | (F.char_length(lb) < 5), 0.0)
        .otherwise(edit)
    )


def bigrams(text: Column) -> Column:
    """Distinct pairs of neighbouring characters of a link target."""
    key = target_key(text)
    pairs = F.transform(F.sequence(F.lit(1), F.char_length(key) - 1), lambda i: F.substring(key, i, 2))
    return F.array_distinct(F.when(F.char_length(key) >= 2, pairs).when(key != "", F.array(key)).otherwise(F.array().cast("array<string>")))


def suggestion_tokens(text: Column, least: int = 2) -> Column:
    """Distinct lower-case runs of letters and digits, and single CJK characters."""
    runs = F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda t: F.char_length(t) >= least)
    return F.array_distinct(F.concat(runs, F.regexp_extract_all(text, F.lit(CJK), F.lit(0))))


REVIEW_PREFIX = r"(?i)^(missing[\s-]?page|duplicate[\s-]?page|possible[\s-]?duplicate|缺失页面|缺少页面|重复页面|疑似重复)[:：]\s*"


def review_title_key(text: Column) -> Column:
    """A review's title without its known prefix, blanks collapsed, in lower case."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), REVIEW_PREFIX, ""), r"\s+", " ")))


def slug(text: Column, length: int = 50) -> Column:
    """Lower-case letters, digits and hyphens, at most so many."""
    words = F.regexp_replace(F.lower(F.trim(text)), r"\s+", "-")
    return F.regexp_replace(F.substring(F.regexp_replace(words, r"[^\p{L}\p{N}-]", ""), 1, length), "^-+|-+$", "")


def folder_context(path: Column) -> Column:
    """The directories of a path as 'a > b'."""
    parts = F.split(path, "/")
    return F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), " > ")


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def xml_escape(text: Column) -> Column:
    for raw, out in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(raw), F.lit(out))
    return text


# ---- predicates


def glob_regex(pattern: str) -> str:
    """A glob with * and ? as a regular expression over the whole string, without regard to case."""
    return "(?is)^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "$"


def glob(text: Column, pattern: str) -> Column:
    return text.rlike(glob_regex(pattern))


RESERVED = "con|prn|aux|nul|com[1-9]|lpt[1-9]"


def safe_wiki_path(path: Column) -> Column:
    """Whether a generated path may be written: below wiki/, no way up, no control characters, no reserved names,
    no name that ends with a blank or a dot."""
    bad = rf"[\x00-\x1f\\:*?\"<>|]|(^|/)\.\.?(/|$)|//|(?i)(^|/)({RESERVED})(\.[^/]*)?(/|$)|[ .](/|$)"
    return path.startswith("wiki/") & ~path.rlike(bad) & ~path.endswith("/")


def valid_page_id(page_id: Column) -> Column:
    return page_id.isNotNull() & (F.char_length(page_id) >= 1) & (F.char_length(page_id) <= 256) & ~page_id.rlike(r"[\"'`/\\\p{Cntrl}​-‏ -‮⁠-⁯﻿]")


SENSITIVE_EXTENSIONS = ("json", "yaml", "yml", "toml", "env", "ini", "conf", "cfg")
SENSITIVE_FOLDERS = (".git", ".ssh", ".aws", ".config", "config", "configs", "secrets", "credentials")


def sensitive_config(path: Column) -> Column:
    """A configuration file below a folder that holds configuration."""
    parts = F.split(F.lower(path), "/")
    folders = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)).isin(*SENSITIVE_EXTENSIONS) & F.arrays_overlap(folders, F.array(*map(F.lit, SENSITIVE_FOLDERS)))


def hidden(path: Column) -> Column:
    return path.rlike(r"(^|/)\.[^/]")


def watched(path: Column, folders: list[str] = (), globs: list[str] = (), include: list[str] = (), exclude: list[str] = (), below: str | None = "raw/sources/") -> Column:
    """Whether a changed path matters: outside the excluded folders (a name anywhere, or a path from the top), not
    matched by a glob on path or name, and of a wanted extension below ``below`` (anywhere if that's None)."""
    keep = ~hidden(path)
    for folder in folders:
        folder = folder.strip("/")
        inside = F.contains(F.concat(F.lit("/"), path), F.lit(f"/{folder}/")) if "/" not in folder else path.startswith(f"{folder}/") | (path == folder)
        keep = keep & ~inside
    for pattern in globs:
        keep = keep & ~glob(path, pattern) & ~glob(file_name(path), pattern)
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    wanted = (ext.isin(*include) if include else F.lit(True)) & (~ext.isin(*exclude) if exclude else F.lit(True))
    return keep & ((~path.startswith(below) | wanted) if below else wanted)
