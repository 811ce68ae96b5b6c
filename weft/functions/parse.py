"""Parsers of semi-structured text: frontmatter, marked blocks, balanced JSON, and sanitising; row by row."""

from __future__ import annotations

import json
import re
import unicodedata

from weft.functions.rowwise import rowwise, rowwise_struct

try:
    import yaml
except ImportError:  # optional
    yaml = None

FRONT = re.compile(r"\A---[ \t]*\n(.*?)\n---[ \t]*(?:\n|\Z)", re.S)
LINK_LIST = re.compile(r"^(\s*[\w-]+:\s*)((?:\[\[[^\]]+\]\]\s*,?\s*)+)$", re.M)
FENCED = re.compile(r"\A\s*```(?:ya?ml|markdown|md)?[ \t]*\n(.*?)\n```[ \t]*\Z", re.S)


def _plain(value) -> str | list[str]:
    if isinstance(value, list):
        return [v if isinstance(v, str) else _text(v) for v in value]
    return _text(value)


def _text(value) -> str:
    if value is None:
        return ""
    if isinstance(value, bool):
        return "true" if value else "false"
    return json.dumps(value, ensure_ascii=False, default=str) if isinstance(value, (dict, list)) else str(value)


def _simple(block: str) -> dict:
    """Keys with scalars, inline lists and dashed lists."""
    out: dict = {}
    key = None
    for line in block.split("\n"):
        item = re.match(r"\s+-\s+(.*)$", line) or (re.match(r"-\s+(.*)$", line) if key else None)
        pair = re.match(r"([\w-]+):\s*(.*)$", line)
        if item and key is not None:
            out[key] = [*(out[key] if isinstance(out[key], list) else []), item[1].strip().strip("\"'")]
        elif pair:
            key, value = pair[1], pair[2].strip()
            out[key] = split_inline(value[1:-1]) if value.startswith("[") and value.endswith("]") and not value.startswith("[[") else value.strip("\"'")
    return out


def split_inline(text: str) -> list[str]:
    """Items of an inline list; commas in quotes don't part them, a backslash takes the next character as it is."""
    out, now, quote, i = [], "", "", 0
    while i < len(text):
        c = text[i]
        if quote:
            if c == "\\" and i + 1 < len(text):
                now, i = now + text[i + 1], i + 1
            elif c == quote:
                quote = ""
            else:
                now += c
        elif c in "\"'" and not now.strip():
            quote, now = c, ""
        elif c == ",":
            out, now = [*out, now.strip()], ""
        else:
            now += c
        i += 1
    return [x for x in [*out, now.strip()] if x]


def frontmatter(text: str | None) -> tuple[dict[str, str | list[str]], str]:
    """(fields, body) of a page. The block stands at the top, or opens within the first six lines; lists of bare links and
    a surrounding code fence are mended. Broken blocks give no fields."""
    text = (text or "").replace("\r\n", "\n")
    fenced = FENCED.match(text)
    if fenced and fenced[1].lstrip().startswith("---"):
        text = fenced[1].lstrip()
    at = 0
    found = FRONT.match(text)
    if not found:
        for line in text.split("\n")[:6]:
            found = FRONT.match(text[at:])
            if found:
                break
            at += len(line) + 1
    if not found:
        return {}, text
    mended = LINK_LIST.sub(lambda m: m[1] + "[" + ", ".join(f'"[[{x}]]"' for x in re.findall(r"\[\[([^\]]+)\]\]", m[2])) + "]", found[1])
    fields = None
    for block in (found[1], mended):
        try:
            fields = yaml.load(block, Loader=yaml.BaseLoader) if yaml else _simple(block)
        except Exception:  # noqa: BLE001 - any malformed block
            continue
        if isinstance(fields, dict) and not any(isinstance(v, list) and any(isinstance(x, list) for x in v) for v in fields.values()):
            break
    if not isinstance(fields, dict):
        fields = _simple(mended)
    return {str(k): _plain(v) for k, v in fields.items()}, text[at + found.end() :]


def _as_lists(text: str) -> tuple[dict[str, list[str]], str]:
    fields, body = frontmatter(text)
    return {k: v if isinstance(v, list) else [v] for k, v in fields.items()}, body


#: fields (scalars as lists of one) and body of each page.
frontmatter_fields = rowwise_struct(_as_lists, "fields map<string, array<string>>, body string", ("fields", "body"))


def set_list(text: str, name: str, items: list[str]) -> str:
    """A page with a list of its frontmatter written in inline form, in place or at the block's end."""
    line = f"{name}: [" + ", ".join(json.dumps(x, ensure_ascii=False) for x in items) + "]"
    found = FRONT.match(text)
    if not found:
        return f"---\n{line}\n---\n{text}"
    block = found[1]
    old = re.compile(rf"^{re.escape(name)}:.*(?:\n[ \t]+-[ \t].*|\n-[ \t].*)*", re.M)
    block = old.sub(lambda _: line, block, count=1) if old.search(block) else f"{block}\n{line}"
    return f"---\n{block}\n---\n{text[found.end():]}"


def sanitize(text: str) -> str:
    """A generated page without an outer fence or a ``frontmatter:`` line, and with the opening fence of its block."""
    text = text.replace("\r\n", "\n").strip("\n")
    fenced = re.match(r"\A```\w*[ \t]*\n(.*)\n```[ \t]*\Z", text, re.S)
    text = fenced[1] if fenced else text
    text = re.sub(r"\A(?:frontmatter|yaml):[ \t]*\n(?=---)", "", text, flags=re.I)
    if not text.startswith("---") and re.match(r"\A(?:[\w-]+:.*\n|[ \t]+-.*\n)+---[ \t]*(?:\n|\Z)", text):
        text = "---\n" + text
    return text + "\n"


# ---- blocks

OPEN = re.compile(r"^\s*-{3}\s*FILE:\s*(.*?)\s*-{3}\s*$", re.I)
CLOSE = re.compile(r"^\s*-{3}\s*END\s+FILE\s*-{3}\s*$", re.I)
FENCE = re.compile(r"^\s{0,3}(`{3,}|~{3,})")


def _safe(path: str) -> bool:
    parts = path.split("/")
    reserved = re.compile(r"^(con|prn|aux|nul|com[1-9]|lpt[1-9])(\..*)?$", re.I)
    return path.startswith("wiki/") and not re.search(r'[\x00-\x1f\\:*?"<>|]', path) and all(p and p not in (".", "..") and not p.endswith((" ", ".")) and not reserved.match(p) for p in parts)


def file_blocks(text: str | None) -> list[dict]:
    """path, content and problem of each FILE block: markers in any case and with blanks, closers in code don't count; a block
    without a closer is ``truncated``, a path outside the wiki ``unsafe``, none ``empty-path``."""
    out, now, path, fence = [], None, "", ""
    for line in (text or "").replace("\r\n", "\n").split("\n"):
        if now is None:
            opened = OPEN.match(line)
            if opened:
                now, path, fence = [], opened[1].strip(), ""
            continue
        mark = FENCE.match(line)
        if mark:
            fence = ("" if mark[1][0] == fence[0] and len(mark[1]) >= len(fence) else fence) if fence else mark[1]
        if not fence and CLOSE.match(line):
            problem = None if _safe(path) else "unsafe" if path else "empty-path"
            out.append({"path": path, "content": "\n".join(now), "problem": problem})
            now = None
        else:
            now.append(line)
    if now is not None:
        out.append({"path": path, "content": "\n".join(now), "problem": "truncated"})
    return out


REVIEW = re.compile(r"---REVIEW:\s*(\w[\w-]*)\s*\|\s*(.+?)\s*---\n(.*?)---END REVIEW---", re.S)
REVIEW_TYPES = ("contradiction", "duplicate", "missing-page", "suggestion")


def review_blocks(text: str | None) -> list[dict]:
    """type, title, description, options, pages and queries of each REVIEW block; unknown types are to be confirmed."""
    out = []
    for kind, title, body in REVIEW.findall((text or "").replace("\r\n", "\n")):
        line = {k: m[1] if (m := re.search(rf"^{k}:\s*(.+)$", body, re.M)) else None for k in ("OPTIONS", "PAGES", "SEARCH")}
        rest = re.sub(r"^(OPTIONS|PAGES|SEARCH):.*$", "", body, flags=re.M).strip()
        split = lambda s, by: [x.strip() for x in s.split(by) if x.strip()] if s else []
        out.append({"type": kind.lower() if kind.lower() in REVIEW_TYPES else "confirm", "title": title.strip(), "description": rest, "options": split(line["OPTIONS"], "|") or ["Approve", "Skip"], "pages": split(line["PAGES"], ","), "queries": split(line["SEARCH"], "|")})
    return out


LINT = re.compile(r"---LINT:\s*([\w-]+)\s*\|\s*(\w+)\s*\|\s*(.+?)\s*---\n(.*?)---END LINT---", re.S)


def lint_blocks(text: str | None) -> list[dict]:
    """type, severity, title, detail and pages of each LINT block."""
    out = []
    for kind, severity, title, body in LINT.findall((text or "").replace("\r\n", "\n")):
        pages = re.search(r"^PAGES:\s*(.+)$", body, re.M)
        out.append({"type": kind, "severity": severity, "title": title, "detail": re.sub(r"^PAGES:.*$", "", body, flags=re.M).strip(), "pages": [p.strip() for p in pages[1].split(",")] if pages else []})
    return out


def marked_section(text: str, name: str) -> str:
    """The text between <name> and </name> marks, or an empty one."""
    found = re.search(rf"<{re.escape(name)}>\s*(.*?)\s*</{re.escape(name)}>", text or "", re.S | re.I)
    return found[1] if found else ""


def heading_section(text: str, name: str) -> str:
    """The text under a second-level heading up to the next one, or an empty one; the heading's case doesn't count."""
    found = re.search(rf"(?:\A|\n)##\s+{re.escape(name)}\s*\n(.*?)(?=\n##\s|\Z)", text or "", re.S | re.I)
    return found[1].strip() if found else ""


file_blocks_column = rowwise(file_blocks, "array<struct<path: string, content: string, problem: string>>")
review_blocks_column = rowwise(review_blocks, "array<struct<type: string, title: string, description: string, options: array<string>, pages: array<string>, queries: array<string>>>")
lint_blocks_column = rowwise(lint_blocks, "array<struct<type: string, severity: string, title: string, detail: string, pages: array<string>>>")


# ---- JSON

def first_json(text: str | None) -> str | None:
    """The first balanced object of a text, whatever surrounds it; braces in strings don't count."""
    text = text or ""
    start = text.find("{")
    while start >= 0:
        depth, quoted, i = 0, False, start
        while i < len(text):
            c = text[i]
            if quoted:
                i += c == "\\"
                quoted = not (c == '"')
            elif c == '"':
                quoted = True
            elif c in "{}":
                depth += 1 if c == "{" else -1
                if not depth:
                    return text[start : i + 1]
            i += 1
        start = text.find("{", start + 1)
    return None


first_json_column = rowwise(first_json, "string")


def detected_groups(text: str | None) -> list[dict]:
    """Groups of a duplicate detector's answer: slugs (two and more), reason and confidence (low by default)."""
    raw = first_json(text)
    try:
        groups = json.loads(raw).get("groups", []) if raw else []
    except (ValueError, AttributeError):
        return []
    out = []
    for g in groups if isinstance(groups, list) else []:
        slugs = [s for s in g.get("slugs", []) if isinstance(s, str) and s.strip()] if isinstance(g, dict) and isinstance(g.get("slugs"), list) else []
        if len(dict.fromkeys(slugs)) >= 2:
            confidence = g.get("confidence")
            out.append({"slugs": list(dict.fromkeys(slugs)), "reason": str(g.get("reason") or ""), "confidence": confidence if confidence in ("high", "medium", "low") else "low"})
    return out


def web_results(answer: dict, source: str) -> list[dict]:
    """Results of a search service, whatever its shape: title, url, snippet, source."""
    at = answer
    for path in (("data", "webPages", "value"), ("webPages", "value"), ("web", "results"), ("data", "web"), ("organic_results",), ("organic",), ("results",), ("data",)):
        found = at
        for k in path:
            found = found.get(k) if isinstance(found, dict) else None
        if isinstance(found, list):
            rows = found
            break
    else:
        rows = []
    pick = lambda r, *names: next((str(r[n]).strip() for n in names if r.get(n)), "")
    out = [{"title": pick(r, "title", "name"), "url": pick(r, "url", "link"), "snippet": pick(r, "snippet", "content", "description", "summary", "markdown"), "source": source} for r in rows if isinstance(r, dict)]
    return [r | {"title": r["title"] or r["url"]} for r in out if r["url"]]


def embedding_response(answer: dict, n: int) -> list[list[float]]:
    """Vectors of an embedding service in the order of their texts; anything amiss is an error."""
    rows = answer.get("data")
    if not isinstance(rows, list) or len(rows) != n:
        raise ValueError("wrong number of vectors")
    out: list[list[float] | None] = [None] * n
    for at, row in enumerate(rows):
        i, v = row.get("index", at), row.get("embedding")
        if not isinstance(i, int) or not 0 <= i < n or out[i] is not None:
            raise ValueError("bad or repeated index")
        if not v or any(not isinstance(x, (int, float)) or x != x or abs(x) == float("inf") for x in v):
            raise ValueError("empty vector or value that isn't finite")
        out[i] = [float(x) for x in v]
    if len({len(v) for v in out}) > 1:
        raise ValueError("vectors of different lengths")
    return out


# ---- names and diffs

def query_slug(text: str, most: int = 50) -> str:
    """A file name for a query: NFKC, letters, digits and hyphens."""
    words = re.sub(r"\s+", "-", unicodedata.normalize("NFKC", text).strip().lower())
    kept = "".join(c for c in words if c == "-" or unicodedata.category(c)[0] in "LN")
    return re.sub(r"-+", "-", kept)[:most].strip("-") or "query"


query_slug_column = rowwise(query_slug, "string")


def word_diff(a: str, b: str, most_cells: int = 250_000) -> list[tuple[str, str]]:
    """(=, -, +) runs between the words of two texts by their longest common subsequence; beyond the limit all goes and comes."""
    x, y = re.findall(r"\s+|\S+", a), re.findall(r"\s+|\S+", b)
    if len(x) * len(y) > most_cells:
        return [(k, v) for k, v in (("-", a), ("+", b)) if v]
    size = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x) - 1, -1, -1):
        for j in range(len(y) - 1, -1, -1):
            size[i][j] = size[i + 1][j + 1] + 1 if x[i] == y[j] else max(size[i + 1][j], size[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(x) or j < len(y):
        if i < len(x) and j < len(y) and x[i] == y[j]:
            kind, word, i, j = "=", x[i], i + 1, j + 1
        elif j == len(y) or (i < len(x) and size[i + 1][j] >= size[i][j + 1]):
            kind, word, i = "-", x[i], i + 1
        else:
            kind, word, j = "+", y[j], j + 1
        if out and out[-1][0] == kind:
            out[-1] = (kind, out[-1][1] + word)
        else:
            out.append((kind, word))
    return out


def locate_selection(text: str, selection: str) -> tuple[int, int] | None:
    """Where a selection stands, if it stands once: as it is, else with any white space between its words."""
    if text.count(selection) == 1:
        at = text.index(selection)
        return at, at + len(selection)
    found = list(re.finditer(r"\s+".join(map(re.escape, selection.split())), text)) if selection.split() else []
    return found[0].span() if len(found) == 1 else None


def enrich_links(text: str, links: list[tuple[str, str]]) -> str:
    """The first place of each term that isn't linked yet becomes a link, one for each target; frontmatter stays."""
    front = FRONT.match(text)
    head, body = (text[: front.end()], text[front.end() :]) if front else ("", text)
    seen: set[str] = set()
    for term, target in links:
        if target.lower() in seen or re.search(rf"\[\[{re.escape(target)}(\||\]\])", body, re.I):
            continue
        linked = [m.span() for m in re.finditer(r"\[\[[^\]]*\]\]|\[[^\]]*\]\([^)]*\)|`[^`]*`", body)]
        for m in re.finditer(re.escape(term), body):
            if not any(a < m.end() and m.start() < b for a, b in linked):
                new = f"[[{target}]]" if term == target else f"[[{target}|{term}]]"
                body = body[: m.start()] + new + body[m.end() :]
                seen.add(target.lower())
                break
    return head + body


def strip_dead_links(text: str, gone: list[str]) -> str:
    """Links to deleted pages become their alias or target text."""
    keys = {re.sub(r"[\s\-_]+", "", g.rsplit("/", 1)[-1].removesuffix(".md").lower()) for g in gone}

    def swap(m: re.Match) -> str:
        key = re.sub(r"[\s\-_]+", "", m[1].rsplit("/", 1)[-1].removesuffix(".md").lower())
        return (m[2] or m[1]) if key in keys else m[0]

    return re.sub(r"\[\[([^\]|]+)(?:\|([^\]]+))?\]\]", swap, text)


def to_commonmark(text: str) -> str:
    """[[target|alias]] as links and ![[file]] as images, but not in code."""
    parts = re.split(r"(```.*?```|`[^`\n]*`)", text, flags=re.S)
    for i in range(0, len(parts), 2):
        parts[i] = re.sub(r"!\[\[([^\]|]+)(?:\|([^\]]+))?\]\]", lambda m: f"![{m[2] or m[1]}]({m[1].replace(' ', '%20')})", parts[i])
        parts[i] = re.sub(r"\[\[([^\]|]+)(?:\|([^\]]+))?\]\]", lambda m: f"[{m[2] or m[1]}]({m[1].replace(' ', '%20')}.md)", parts[i])
    return "".join(parts)
