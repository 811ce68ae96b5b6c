"""File names: categories by extension."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The category of each extension, or of a whole name without a dot.
EXTENSIONS = {
    "md": "markdown", "mdx": "markdown",
    "txt": "text", "rtf": "text", "log": "text",
    "js": "code", "jsx": "code", "ts": "code", "tsx": "code", "py": "code", "rs": "code", "go": "code", "java": "code", "c": "code", "cpp": "code", "h": "code", "hpp": "code",
    "rb": "code", "php": "code", "swift": "code", "kt": "code", "scala": "code", "sh": "code", "bash": "code", "zsh": "code", "sql": "code", "r": "code", "lua": "code",
    "css": "code", "scss": "code", "less": "code", "html": "code", "htm": "code", "xml": "code", "svg": "code", "vue": "code", "svelte": "code",
    "toml": "code", "ini": "code", "cfg": "code", "conf": "code", "dockerfile": "code", "makefile": "code",
    "png": "image", "jpg": "image", "jpeg": "image", "gif": "image", "webp": "image", "bmp": "image", "ico": "image", "tiff": "image", "tif": "image", "avif": "image", "heic": "image", "heif": "image",
    "mp4": "video", "webm": "video", "mov": "video", "avi": "video", "mkv": "video", "flv": "video", "wmv": "video", "m4v": "video",
    "mp3": "audio", "wav": "audio", "ogg": "audio", "flac": "audio", "aac": "audio", "m4a": "audio", "wma": "audio",
    "mmd": "code", "mermaid": "code",
    "pdf": "pdf",
    "doc": "document", "docx": "document", "xls": "document", "xlsx": "document", "ppt": "document", "pptx": "document", "odt": "document", "ods": "document", "odp": "document",
    "pages": "document", "numbers": "document", "key": "document", "epub": "document", "mobi": "document", "org": "document",
    "json": "data", "jsonl": "data", "csv": "data", "tsv": "data", "yaml": "data", "yml": "data", "ndjson": "data",
}
# The language of a source file's extension, where it isn't the extension itself.
LANGUAGES = {
    "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "py": "python", "rs": "rust", "rb": "ruby",
    "htm": "html", "yml": "yaml", "mmd": "mermaid", "sh": "bash",
}
READABLE = ("markdown", "text", "code", "data")
# The extensions of sources that are taken in.
INGESTABLE = (
    "md", "mdx", "txt", "pdf", "doc", "docx", "pptx", "xlsx", "odt", "odp", "ods", "xls", "csv", "json", "html", "htm", "rtf", "xml", "yaml", "yml", "epub", "mobi", "org",
)


def _looked_up(table: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key]


def extension(path: Column) -> Column:
    """The lower-case extension of a path's last part, empty without a dot; either slash parts a path."""
    name = F.element_at(F.split(path, r"[\\/]"), -1)
    return F.when(F.instr(name, ".") > 0, F.lower(F.substring_index(name, ".", -1))).otherwise("")


def category(path: Column) -> Column:
    """The category of a path by its extension, or by its whole name where that has no dot, else ``unknown``."""
    name = F.lower(F.element_at(F.split(path, r"[\\/]"), -1))
    return F.coalesce(_looked_up(EXTENSIONS, F.when(F.instr(name, ".") > 0, extension(path)).otherwise(name)), F.lit("unknown"))


def code_language(path: Column) -> Column:
    """The language of a source file, by default its extension."""
    ending = F.lower(F.substring_index(path, ".", -1))
    return F.coalesce(_looked_up(LANGUAGES, ending), ending)


def readable_as_text(path: Column) -> Column:
    return category(path).isin(*READABLE)


def ingestable(path: Column) -> Column:
    """A source of a kind that is taken in, not hidden and not in a derived cache."""
    parts = F.split(path, r"[\\/]")
    return extension(path).isin(*INGESTABLE) & ~F.array_contains(parts, ".cache") & ~F.element_at(parts, -1).startswith(".")


def natural_key(text: Column) -> Column:
    """A key whose order is natural: digits by value (up to 18), letters without case."""
    return F.array_join(F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"\d+|\D+"), F.lit(0)), lambda x: F.when(x.rlike(r"^\d+$"), F.lpad(x, 18, "0")).otherwise(x)), "")
