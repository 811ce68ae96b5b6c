"""Rules for texts of pages and answers: formulas as text, greetings and intents, addresses of images, dates of pages, lists of sources,
reasoning in answers' lines, fields of reviews, and names of saved answers. All are column expressions.

Nulls give null, unless a rule says otherwise.
"""

from __future__ import annotations

import json
import math
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from weft.functions import text as T
from weft.functions.measures import review_id
from weft.functions.rowwise import rowwise

# Commands of formulas and the characters that stand for them.
SYMBOLS = {
    "rightarrow": "→", "Rightarrow": "⇒", "longrightarrow": "⟶", "leftarrow": "←", "Leftarrow": "⇐", "longleftarrow": "⟵", "leftrightarrow": "↔", "Leftrightarrow": "⇔",
    "uparrow": "↑", "Uparrow": "⇑", "downarrow": "↓", "Downarrow": "⇓", "mapsto": "↦", "hookrightarrow": "↪", "hookleftarrow": "↩", "nearrow": "↗", "nwarrow": "↖", "searrow": "↘", "swarrow": "↙",
    "times": "×", "div": "÷", "pm": "±", "mp": "∓", "cdot": "·", "ast": "∗", "star": "⋆", "circ": "∘", "bullet": "•", "oplus": "⊕", "otimes": "⊗",
    "leq": "≤", "le": "≤", "geq": "≥", "ge": "≥", "neq": "≠", "ne": "≠", "approx": "≈", "sim": "∼", "simeq": "≃", "equiv": "≡", "cong": "≅", "propto": "∝", "ll": "≪", "gg": "≫", "prec": "≺", "succ": "≻",
    "subset": "⊂", "supset": "⊃", "subseteq": "⊆", "supseteq": "⊇", "in": "∈", "notin": "∉", "ni": "∋", "cap": "∩", "cup": "∪", "vee": "∨", "wedge": "∧", "neg": "¬", "lnot": "¬",
    "alpha": "α", "beta": "β", "gamma": "γ", "delta": "δ", "epsilon": "ε", "varepsilon": "ε", "zeta": "ζ", "eta": "η", "theta": "θ", "vartheta": "ϑ", "iota": "ι", "kappa": "κ", "lambda": "λ", "mu": "μ", "nu": "ν",
    "xi": "ξ", "pi": "π", "varpi": "ϖ", "rho": "ρ", "varrho": "ϱ", "sigma": "σ", "varsigma": "ς", "tau": "τ", "upsilon": "υ", "phi": "φ", "varphi": "ϕ", "chi": "χ", "psi": "ψ", "omega": "ω",
    "Gamma": "Γ", "Delta": "Δ", "Theta": "Θ", "Lambda": "Λ", "Xi": "Ξ", "Pi": "Π", "Sigma": "Σ", "Upsilon": "Υ", "Phi": "Φ", "Psi": "Ψ", "Omega": "Ω",
    "infty": "∞", "partial": "∂", "nabla": "∇", "forall": "∀", "exists": "∃", "emptyset": "∅", "varnothing": "∅", "wp": "℘", "Re": "ℜ", "Im": "ℑ", "aleph": "ℵ", "hbar": "ℏ", "ell": "ℓ",
    "sharp": "♯", "flat": "♭", "natural": "♮", "clubsuit": "♣", "diamondsuit": "♢", "heartsuit": "♡", "spadesuit": "♠",
    "sum": "∑", "prod": "∏", "coprod": "∐", "int": "∫", "oint": "∮", "bigcup": "⋃", "bigcap": "⋂", "bigoplus": "⨁", "bigotimes": "⨂", "ldots": "…", "cdots": "⋯", "vdots": "⋮", "ddots": "⋱",
    "quad": "  ", "qquad": "    ", "text": "", "mathrm": "", "mathbf": "", "mathit": "", "textbf": "", "textit": "", "textrm": "",
    "langle": "⟨", "rangle": "⟩", "lfloor": "⌊", "rfloor": "⌋", "lceil": "⌈", "rceil": "⌉", "lvert": "|", "rvert": "|", "hat": "^", "tilde": "~", "bar": "‾", "vec": "→", "dot": "·", "ddot": "¨",
    "log": "log", "ln": "ln", "exp": "exp", "sin": "sin", "cos": "cos", "tan": "tan", "min": "min", "max": "max", "sup": "sup", "inf": "inf", "lim": "lim", "sqrt": "√", "frac": "/",
}

# What counts as a greeting, behind lower case and without closing signs.
GREETINGS = (
    r"(hi|hello|hey|yo|sup|howdy|hiya|heya|hullo)( there| y'all| you| folks| everyone)?",
    r"good (morning|afternoon|evening|day|night)",
    r"(what'?s up|wassup|whaddup)",
    r"greetings",
    r"(你好|您好|大家好|嗨|哈喽|哈啰|哈囉|哈罗|喂)[啊呀吖呢么呗哦哈]?",
    r"(早|早啊|早安|早上好|中午好|下午好|晚上好|晚安)[啊呀吖呢么呗哦哈]?",
    r"(在吗|在嗎|在不在|有人吗|有人嗎|有人在吗|有人在嗎)",
    r"(こんにちは|こんばんは|おはよう|おはようございます|やあ|どうも|はじめまして)",
    r"(안녕|안녕하세요|안녕하십니까)",
    r"(hola|bonjour|salut|coucou|hallo|servus|hej|hejsan|ciao|saluton|ola|olá|privet|привет)",
)
CLOSING = r"(?U)[\s!！。.?？~,，、;；:：]+$"

# Words that tell what a message asks for, the first kind that has one holds.
INTENTS = {
    "write": ("write to wiki", "create page", "写入", "创建页面"),
    "graph": ("graph", "relationship", "知识图谱", "关系图"),
    "raw_source": ("raw source", "source file", "原始资料", "原始文件", "源文件"),
    "external": ("web search", "search the web", "internet", "online", "latest", "today", "新闻", "联网", "网上", "最新"),
}
CHAT = ("hi", "hello", "thanks", "谢谢", "你好", "好的", "ok")
OUTSIDE = r"(?i)^(https?:|data:|blob:|file:|tauri:)"
REASONING = r'"reasoning(?:_content)?"\s*:\s*"([^"]*)"'
RAW_FOLDER = "raw/sources/"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """What ``use`` makes of a value that is worked out once, however often it's used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def replaced(text: Column, pattern: str, make: Callable[[Column], Column]) -> Column:
    """A text whose matches give what ``make`` makes of their first group."""

    def joined(t: Column) -> Column:
        found = F.regexp_extract_all(t, F.lit(pattern), F.lit(1))
        after = lambda pieces: F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0)))
        return bound(F.split(t, pattern, -1), lambda pieces: F.concat(F.get(pieces, F.lit(0)), F.array_join(F.zip_with(found, after(pieces), lambda f, p: F.concat(make(f), p)), "")))

    return bound(text, joined)


def formulas_as_text(text: Column) -> Column:
    """Commands between dollars as their characters, unknown ones as they are; dollars go, displayed formulas get lines of their own."""
    table = F.create_map(*[F.lit(x) for pair in SYMBOLS.items() for x in pair])
    symbol = lambda name: F.coalesce(F.element_at(table, name), F.concat(F.lit("\\"), name))
    alone = replaced(text, r"\$\\([a-zA-Z]+)\$", symbol)
    shown = F.regexp_replace(alone, r"\$\$([^$]+)\$\$", "\n$1\n")
    return replaced(shown, r"\$([^$]+)\$", lambda inner: replaced(inner, r"\\([a-zA-Z]+)", symbol))


def _units(text: Column) -> Column:
    """UTF-16 units: characters of four bytes count twice."""
    return F.char_length(text) + F.char_length(F.regexp_replace(text, r"[^\x{10000}-\x{10FFFF}]", ""))


def greeting(text: Column, most: int = 20) -> Column:
    """Whether a message is no more than a greeting of at most ``most`` units; null isn't one."""
    bare = F.lower(F.regexp_replace(F.regexp_replace(text, r"(?U)^\s+", ""), CLOSING, ""))
    return F.coalesce((_units(bare) <= most) & bare.rlike("^(?:" + "|".join(GREETINGS) + r")\z"), F.lit(False))


def intent(message: Column) -> Column:
    """What a message asks for: ``write``, ``graph``, ``raw_source``, ``external``, ``chat`` (under 32 bytes), else ``ambiguous``."""
    lower = F.lower(message)
    has = lambda words: F.coalesce(lower.rlike("|".join(words)), F.lit(False))
    out = F.when(has(CHAT) & (F.octet_length(F.regexp_replace(message, r"(?U)^\s+|\s+$", "")) < 32), "chat").otherwise("ambiguous")
    for name, words in reversed(INTENTS.items()):
        out = F.when(has(words), name).otherwise(out)
    return out


# ---- addresses of images


def collapsed(path: Column) -> Column:
    """A path without empty parts, ``.`` and ``..``; what would lead above the root stays at it, and stays as ``..`` in relative paths."""
    top = path.startswith("/")

    def step(done: Column, part: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        up = F.when(last.isNotNull() & (last != ".."), F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).when(~top, F.concat(done, F.array(F.lit("..")))).otherwise(done)
        return F.when((part == "") | (part == "."), done).when(part == "..", up).otherwise(F.concat(done, F.array(part)))

    return F.concat(F.when(top, "/").otherwise(""), F.array_join(F.aggregate(F.split(path, "/"), F.lit([]).cast("array<string>"), step), "/"))


def image_address(src: Column, project: Column, folder: Column | None = None) -> Column:
    """The file that an image's address means: web and data addresses as they are; others from the page's folder, or from ``wiki/`` where
    that isn't known or the address starts with ``media/`` or ``../media/``. What leads outside the project stays as it was written."""
    slashes = lambda c: F.replace(c, F.lit("\\"), F.lit("/"))
    decoded = lambda c: F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)
    absolute = lambda c: c.rlike(r"^(/|[a-zA-Z]:|\\\\)")
    root = F.regexp_replace(slashes(project), "/+$", "")
    bare = decoded(F.regexp_replace(src, r"^\./", ""))
    media = bare.rlike(r"^(\.\./)?media/")
    below_wiki = F.concat(slashes(project), F.lit("/wiki/"), F.when(media, F.regexp_replace(bare, r"^\.\./", "")).otherwise(bare))
    found = collapsed(below_wiki)
    if folder is not None:
        place = slashes(folder)
        base = F.regexp_replace(F.when(absolute(place), place).otherwise(F.concat(slashes(project), F.lit("/"), place)), "/+$", "")
        found = F.when((F.coalesce(folder, F.lit("")) != "") & ~media, collapsed(F.concat(base, F.lit("/"), bare))).otherwise(found)
    found = F.when(absolute(src), collapsed(slashes(decoded(src)))).otherwise(found)
    same = lambda c: F.when(c.rlike("^[a-zA-Z]:"), F.lower(c)).otherwise(c)
    inside = (same(found) == same(root)) | same(found).startswith(F.concat(same(root), F.lit("/")))
    return F.when((src == "") | src.rlike(OUTSIDE) | project.isNull(), src).otherwise(F.when(F.coalesce(inside, F.lit(False)), found).otherwise(src))


# ---- dates and sources of pages

BLOCK = r"(?s)\A(---\s*\r?\n)(.*?)(\r?\n---\s*(?:\r?\n|\z))"


def stamped(content: Column, date: Column) -> Column:
    """A page whose frontmatter says ``date`` as created and updated, in place or at its end; pages without frontmatter stay."""
    head, block, end = (F.regexp_extract(content, BLOCK, k) for k in (1, 2, 3))
    for key in ("created", "updated"):
        line = rf"(?is)\A(?<k>(?:|.*?\n){key}\s*:\s*)[^\n\r]*"
        block = F.when(block.rlike(line), F.regexp_replace(block, F.lit(line), F.concat(F.lit("${k}"), date))).otherwise(F.concat(F.regexp_replace(block, r"\s+\z", ""), F.lit(f"\n{key}: "), date))
    return F.when(content.rlike(BLOCK), F.concat(head, block, end, F.regexp_replace(content, BLOCK, ""))).otherwise(content)


def stamped_log(content: Column, date: Column) -> Column:
    """A log whose placeholders are the date, and whose first dated heading says it."""
    filled = F.regexp_replace(content, F.lit(r"\bYYYY-MM-DD\b"), date)
    return F.regexp_replace(filled, F.lit(r"(?s)\A(?<k>(?:|.*?\n)\s*##\s*\[?)\d{4}-\d{2}-\d{2}"), F.concat(F.lit("${k}"), date))


def canonical_sources(sources: Column, own: Column) -> Column:
    """Sources of a page as they're stored: below the folder of raw sources, those outside the project or of its own pages left out, the
    page's own source under its full name and always there, each once whatever its case."""
    slashes = lambda c: F.replace(c, F.lit("\\"), F.lit("/"))
    place = lambda c: F.instr(F.lower(c), f"/{RAW_FOLDER}")
    short = lambda c: F.when(F.lower(c).startswith(RAW_FOLDER), F.substring(c, len(RAW_FOLDER) + 1, 1 << 30)).when(place(c) > 0, F.substring(c, place(c) + len(RAW_FOLDER) + 1, F.lit(1 << 30))).otherwise(c)
    key = F.lower(slashes(own))

    def valid(source: Column) -> Column:
        path = F.regexp_replace(slashes(source), r"^(\./)+", "")
        inside = (path != "") & ~path.rlike(r"(?i)^(/|[a-z]:/)") & ~path.rlike(r"(^|/)\.\.(/|$)")
        return inside & ((F.lower(short(path)) == key) | ~F.lower(path).rlike(r"^(wiki/(index|overview|log)\.md|\.llm-wiki(/.*)?)$"))

    def named(source: Column) -> Column:
        path = short(slashes(source))
        return F.when((F.lower(path) == key) | (~F.contains(path, F.lit("/")) & (F.lower(path) == F.lower(F.element_at(F.split(slashes(own), "/"), -1)))), own).otherwise(path)

    lower = lambda c: F.lower(slashes(c))
    whole = lambda found: F.when(F.exists(found, lambda s: lower(s) == key), found).otherwise(F.concat(found, F.array(own)))
    once = lambda found: bound(F.transform(found, lower), lambda keys: F.filter(found, lambda s, i: F.array_position(keys, lower(s)) == i + 1))
    found = F.transform(F.filter(F.coalesce(sources, F.array().cast("array<string>")), valid), named)
    return bound(bound(found, whole), once)


# ---- answers and reviews


def reasoning_units(line: Column) -> Column:
    """Units of the reasoning fields that a line of a stream shows, escapes as they're written."""
    closed = F.regexp_replace(line, r"\\[^\n]", "\x01\x01")  # an escaped quote ends nothing
    return F.aggregate(F.regexp_extract_all(closed, F.lit(REASONING), F.lit(1)), F.lit(0), lambda n, x: n + _units(x))


def reasoning_texts(line: Column) -> Column:
    """Reasoning texts of a stream's line, whichever of the known forms it has; none of other lines."""
    data = F.trim(F.regexp_extract(F.trim(line), r"(?s)^data: (.*)$", 1))
    choice = "struct<delta:struct<reasoning_content:string,reasoning:string>>"
    part = "struct<text:string,thought:boolean>"
    told = F.from_json(data, f"struct<choices:array<{choice}>,delta:struct<type:string,text:string,thinking:string>,candidates:array<struct<content:struct<parts:array<{part}>>>>>")
    none = F.array().cast("array<string>")
    chosen = F.flatten(F.transform(told["choices"], lambda c: F.array(c["delta"]["reasoning_content"], c["delta"]["reasoning"])))
    delta = F.when(told["delta"]["type"] == "thinking_delta", F.array(told["delta"]["thinking"], told["delta"]["text"]))
    thoughts = F.flatten(F.transform(told["candidates"], lambda c: F.transform(F.filter(F.coalesce(c["content"]["parts"], F.array().cast(f"array<{part}>")), lambda p: p["thought"]), lambda p: p["text"])))
    return F.filter(F.concat(F.coalesce(chosen, none), F.coalesce(delta, none), F.coalesce(thoughts, none)), lambda x: x.isNotNull())


def _review(text: str) -> str | None:
    try:
        item = json.loads(text)
    except ValueError:
        return None
    if not isinstance(item, dict):
        return None
    strings = lambda value, names: {k: value[k] for k in names if isinstance(value.get(k), str)}
    out = strings(item, ("id", "type", "title", "description", "sourcePath", "resolvedAction"))
    out |= {k: [x for x in item[k] if isinstance(x, str)] for k in ("affectedPages", "searchQueries") if isinstance(item.get(k), list)}
    if isinstance(item.get("options"), list):
        kept = [strings(o, ("label", "action")) for o in item["options"] if isinstance(o, dict)]
        out["options"] = [o for o in kept if o]
    out |= {"resolved": item["resolved"]} if isinstance(item.get("resolved"), bool) else {}
    made = item.get("createdAt")
    if isinstance(made, (int, float)) and not isinstance(made, bool) and math.isfinite(made):
        out["createdAt"] = float(made)
    return json.dumps(out, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


#: A review (a JSON object) with its known fields alone, each of its own type, as JSON in the order of their names; null for other texts.
reviewed = rowwise(_review, "string")


def review_fields(text: Column) -> Column:
    """(id, item) of a review: the stable id of its type and title where it has both, else its own; and its known fields."""
    item = reviewed(text)
    kind, title, own = (F.get_json_object(item, f"$.{k}") for k in ("type", "title", "id"))
    return F.struct(F.when(kind.isNotNull() & title.isNotNull(), review_id(kind, title)).otherwise(own).alias("id"), item.alias("item"))


# ---- names


compatible = rowwise(lambda text: unicodedata.normalize("NFKC", text), "string")


def answer_file(title: Column, saved_at: Column) -> Column:
    """The name of a saved answer's file: slug of 50 characters, and date and time of its moment in the session's zone (UTC by default)."""
    words = F.regexp_replace(F.regexp_replace(compatible(title), r"(?U)^\s+|\s+$", ""), r"(?U)\s+", "-")
    slug = F.regexp_replace(F.regexp_replace(F.regexp_replace(words, r"[^\p{L}\p{N}-]", ""), "-+", "-"), "^-|-$", "")
    short = F.substring(F.lower(slug), 1, 50)
    return F.concat(F.when(short == "", "query").otherwise(short), F.date_format(saved_at, "-yyyy-MM-dd-HHmmss'.md'"))


def page_with_sources(content: Column, own: Column) -> Column:
    """A page with the list of its sources in canonical form, in inline style; pages without frontmatter stay."""
    items = F.transform(canonical_sources(T.list_field(content, "sources"), own), lambda s: F.concat(F.lit('"'), F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"')))
    line = F.concat(F.lit("sources: ["), F.array_join(items, ", "), F.lit("]"))
    old = r"(?m)\A(?<k>---\n(?s:.*?))^sources:.*(?:\n[ \t]+-[ \t].*|\n-[ \t].*)*"
    quoted = F.regexp_replace(line, r"([\\$])", r"\\$1")
    head = r"(?s)\A(?<k>---\n.*?)\n---"
    fresh = F.regexp_replace(content, F.lit(head), F.concat(F.lit("${k}\n"), quoted, F.lit("\n---")))
    return F.when(~content.startswith("---\n"), content).when(F.regexp_extract(content, head, 1).rlike("(?m)^sources:"), F.regexp_replace(content, F.lit(old), F.concat(F.lit("${k}"), quoted))).otherwise(fresh)
