"""Web pages: readable article, Markdown, and a plain fallback."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

MOST_CHARS = 1_000_000
NOTICE = "\n\n[Content truncated]"
DROPPED = "script|style|nav|header|footer|aside|noscript"


def fallback_text(html: Column) -> Column:
    """Trimmed lines of a page's text without scripts, styles, navigation and advertisements; JVM only."""
    bare = F.regexp_replace(html, rf'(?is)<({DROPPED})\b[^>]*>.*?</({DROPPED})>|<!--.*?-->|<div[^>]*class="[^"]*\b(ad|ads|advert|advertisement)\b[^"]*"[^>]*>.*?</div>', "")
    broken = F.regexp_replace(bare, r"(?i)</(p|div|h[1-6]|li|tr|article|section|title)>|<br[^>]*>", "\n")
    text = F.regexp_replace(broken, "<[^>]*>", "")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(x, F.lit(" \t\r")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def truncated(text: Column, most: int = MOST_CHARS) -> Column:
    return F.when(F.char_length(text) > most, F.concat(F.substring(text, 1, most), F.lit(NOTICE))).otherwise(text)


class Node:
    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None) -> None:
        self.tag, self.attrs, self.parent, self.children, self.score = tag, attrs, parent, [], 0.0

    def text(self) -> str:
        return "".join(c if isinstance(c, str) else c.text() for c in self.children)

    def walk(self) -> Iterator[Node]:
        yield self
        for c in self.children:
            if isinstance(c, Node):
                yield from c.walk()


VOID = {"br", "img", "hr", "meta", "link", "input", "source", "wbr", "col", "area", "base", "embed", "track"}
CLOSES = {"p": {"p", "div", "ul", "ol", "table", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "blockquote", "section", "article"}, "li": {"li"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}}
MOST_DEPTH = 200


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", {}, None)
        self.depth = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        while self.at.parent is not None and tag in CLOSES.get(self.at.tag, ()):
            self.at, self.depth = self.at.parent, self.depth - 1
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID and self.depth < MOST_DEPTH:
            self.at, self.depth = node, self.depth + 1

    def handle_endtag(self, tag: str) -> None:
        up, steps = self.at, 0
        while up.parent is not None and up.tag != tag:
            up, steps = up.parent, steps + 1
        if up.parent is not None:
            self.at, self.depth = up.parent, self.depth - steps - 1

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def parse(html: str) -> Node:
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    return tree.root


UNLIKELY = re.compile(r"\b(ad|ads|advert|banner|breadcrumb|combx|comment|community|cookie|disqus|footer|header|menu|nav|pager|pagination|popup|related|remark|rss|share|shoutbox|sidebar|skyscraper|social|sponsor)\b", re.I)
LIKELY = re.compile(r"\b(article|body|column|content|main|shadow)\b", re.I)
SKIPPED = {"script", "style", "noscript", "nav", "header", "footer", "aside", "template", "iframe", "form", "button"}


COMMAS = re.compile("[,،﹐︐︑⹁⸴⸲，]")


class _Measure:
    """Length without outer blanks, commas, and length of links of a node's text, added up from its children's once."""

    __slots__ = ("n", "lead", "trail", "commas", "linked")

    def __init__(self) -> None:
        self.n = self.lead = self.trail = self.commas = 0
        self.linked = 0.0

    def add(self, n: int, lead: int, trail: int, commas: int, linked: float) -> None:
        if lead == n:  # blank
            self.lead += n if self.lead == self.n else 0
            self.trail += n
        else:
            self.lead += lead if self.lead == self.n else 0
            self.trail = trail
        self.n, self.commas, self.linked = self.n + n, self.commas + commas, self.linked + linked

    @property
    def stripped(self) -> int:
        return 0 if self.lead == self.n else self.n - self.lead - self.trail

    @property
    def links_share(self) -> float:
        return min(1.0, self.linked / self.stripped) if self.stripped else 0.0


def _measured(root: Node) -> dict[int, _Measure]:
    """The measure of each node, by identity."""
    found: dict[int, _Measure] = {}
    for node in reversed(list(root.walk())):  # children come before their parents
        out = found[id(node)] = _Measure()
        for c in node.children:
            if isinstance(c, str):
                out.add(len(c), len(c) - len(c.lstrip()), len(c) - len(c.rstrip()), len(COMMAS.findall(c)), 0.0)
            else:
                m = found[id(c)]
                out.add(m.n, m.lead, m.trail, m.commas, m.linked)
        if node.tag == "a":
            out.linked += out.stripped * (0.3 if node.attrs.get("href", "").startswith("#") else 1.0)
    return found


def _prune(node: Node) -> None:
    kept = []
    for c in node.children:
        if isinstance(c, Node):
            name = f"{c.attrs.get('class', '')} {c.attrs.get('id', '')}"
            if c.tag in SKIPPED or (c.tag not in ("body", "article", "html", "main") and UNLIKELY.search(name) and not LIKELY.search(name)):
                continue
            _prune(c)
        kept.append(c)
    node.children = kept


def article(html: str) -> Node:
    """The node that holds the main text: paragraphs give points for length and commas to what is around them, less for links."""
    root = parse(html)
    _prune(root)
    measures = _measured(root)
    for p in [n for n in root.walk() if n.tag in ("p", "td", "pre", "section", "h2", "h3", "h4", "h5", "h6")]:
        length = measures[id(p)].stripped
        if length < 25:
            continue
        points = 2 + measures[id(p)].commas + min(length // 100, 3)
        up, level = p.parent, 0
        while up is not None and up.parent is not None and level < 5:
            up.score += points / (1 if level == 0 else 2 if level == 1 else 3 * level)
            up, level = up.parent, level + 1
    best = max((n for n in root.walk() if n.score > 0), key=lambda n: n.score * (1 - measures[id(n)].links_share), default=None)
    return best or next((n for n in root.walk() if n.tag == "body"), root)


def markdown(node: Node) -> str:
    """A node as Markdown: headings, emphasis, links, images, lists, quotes, code, tables and rules. A table in a table's cell
    gives the text of its cells, once."""
    cells = 0

    def inner(n: Node) -> str:
        return "".join(re.sub(r"\s+", " ", c) if isinstance(c, str) else block(c) for c in n.children)

    def own_rows(n: Node) -> list[Node]:
        """The rows of a table, not those of tables in its cells."""
        parts = [c for c in n.children if isinstance(c, Node)]
        return [r for c in parts for r in ([c] if c.tag == "tr" else [x for x in c.children if isinstance(x, Node) and x.tag == "tr"] if c.tag in ("thead", "tbody", "tfoot") else [])]

    def rows(n: Node) -> list[list[str]]:
        nonlocal cells
        cells += 1
        found = [[re.sub(r"\s*\n\s*", " ", inner(c).strip()) for c in r.children if isinstance(c, Node) and c.tag in ("td", "th")] for r in own_rows(n)]
        cells -= 1
        return found

    def block(n: Node) -> str:
        if n.tag in SKIPPED:
            return ""
        if re.fullmatch("h[1-6]", n.tag):
            return f"\n\n{'#' * int(n.tag[1])} {inner(n).strip()}\n\n"
        mark = {"strong": "**", "b": "**", "em": "_", "i": "_"}.get(n.tag)
        if mark or (n.tag == "a" and n.attrs.get("href")):
            whole = inner(n)  # once: nested tags would double the work at each level
            held = whole.strip()
            if not held:
                return whole
            return f"{mark}{held}{mark}" if mark else f"[{held}]({n.attrs['href']})"
        if n.tag == "br":
            return "  \n"
        if n.tag == "hr":
            return "\n\n---\n\n"
        if n.tag == "img":
            small = any(v.isdigit() and int(v) < 30 for v in (n.attrs.get("width", ""), n.attrs.get("height", "")))
            return "" if small or not n.attrs.get("src") else f"![{n.attrs.get('alt', '')}]({n.attrs['src']})"
        if n.tag == "pre":
            return f"\n\n```\n{n.text().strip(chr(10))}\n```\n\n"
        if n.tag == "code":
            return f"`{n.text()}`"
        if n.tag == "blockquote":
            return "\n\n" + "\n".join("> " + x for x in inner(n).strip().split("\n")) + "\n\n"
        if n.tag in ("ul", "ol"):
            items = [c for c in n.children if isinstance(c, Node) and c.tag == "li"]
            return "\n\n" + "\n".join((f"{i}. " if n.tag == "ol" else "- ") + inner(c).strip().replace("\n", "\n  ") for i, c in enumerate(items, 1)) + "\n\n"
        if n.tag == "table":
            table = rows(n)
            if cells:
                return "\n" + " ".join(filter(None, (c for r in table for c in r))) + "\n"
            table = [[c.replace("|", "\\|") for c in r] for r in table]
            width = max(map(len, table), default=0)
            lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in table if r]
            return "\n\n" + "\n".join([*lines[:1], "|" + " --- |" * width, *lines[1:]]) + "\n\n" if lines else ""
        if n.tag in ("p", "div", "section", "article", "main", "figure", "li", "tr", "title"):
            return f"\n\n{inner(n).strip()}\n\n"
        return inner(n)

    return re.sub(r"\n{3,}", "\n\n", block(node)).strip()


#: Pages that are Python objects at a time, a fixed value.
SLICE = 32


def markdowns(pages: pa.Array) -> pa.Array:
    """The articles of pages as Markdown; only a few pages and results at a time are Python objects, the others stay Arrow's."""
    parts = [pa.array([markdown(article(h.as_py() or "")) for h in pages.slice(at, SLICE)], pa.string()) for at in range(0, len(pages), SLICE)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


def readable(html: Column) -> Column:
    """The article of each page as Markdown; null pages give an empty one."""
    return F.arrow_udf(markdowns, "string")(html)
