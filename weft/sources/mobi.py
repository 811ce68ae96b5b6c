"""The text of MOBI and PalmDOC books with the standard library: a table of records, text records behind a header, and its metadata.

Text is stored plainly or with PalmDOC compression; the Huffman kind and protected books are errors. A book may say that it's small and
unpack to more, so what is unpacked is counted, and stops at ``MOST_TEXT`` bytes.
"""

from __future__ import annotations

import struct

MOST_TEXT = 32 * 1024 * 1024
PLAIN, PALMDOC, HUFFMAN = 1, 2, 17480
AUTHOR, PUBLISHER, TITLE = 100, 101, 503


def unpack(data: bytes, most: int) -> bytes:
    """One PalmDOC record: literals, runs of literals, a space with a letter, and copies from what was unpacked, at most ``most`` bytes."""
    out, i = bytearray(), 0
    while i < len(data):
        b = data[i]
        i += 1
        if 1 <= b <= 8:
            out += data[i : i + b]
            i += b
        elif b < 0x80:
            out.append(b)
        elif b >= 0xC0:
            out += bytes((0x20, b ^ 0x80))
        else:
            if i >= len(data):
                raise ValueError("cut off in a copy")
            pair = (b << 8 | data[i]) & 0x3FFF
            i += 1
            back, n = pair >> 3, (pair & 7) + 3
            if not 0 < back <= len(out):
                raise ValueError("a copy from before the start")
            for _ in range(n):  # a copy may reach into itself
                out.append(out[-back])
        if len(out) > most:
            raise ValueError(f"more than {MOST_TEXT} bytes of text")
    return bytes(out)


def _records(data: bytes) -> list[bytes]:
    n = struct.unpack_from(">H", data, 76)[0]
    starts = [struct.unpack_from(">I", data, 78 + 8 * k)[0] for k in range(n)]
    if not starts or starts != sorted(starts) or starts[-1] > len(data) or starts[0] < 78 + 8 * n:
        raise ValueError("broken table of records")
    return [data[a:b] for a, b in zip(starts, [*starts[1:], len(data)], strict=True)]


def _without_trailer(record: bytes, flags: int) -> bytes:
    """A text record without the entries that stand behind its text: one for each flag, each with its size at its end."""
    for _ in range((flags >> 1).bit_count()):
        size = 0
        for b in record[-4:]:
            size = 0 if b & 0x80 else size
            size = size << 7 | b & 0x7F
        if not 0 < size <= len(record):
            raise ValueError("broken entry behind a text record")
        record = record[:-size]
    if flags & 1 and record:
        record = record[: -((record[-1] & 3) + 1)]
    return record


def _metadata(head: bytes, length: int) -> dict[int, bytes]:
    """The first value of each kind of the header's extension."""
    at, found = 16 + length, {}
    if struct.unpack_from(">I", head, 128)[0] & 0x40 and head[at : at + 4] == b"EXTH":
        n = struct.unpack_from(">I", head, at + 8)[0]
        at += 12
        while n > 0 and at + 8 <= len(head):
            kind, size = struct.unpack_from(">II", head, at)
            if size < 8:
                break
            found.setdefault(kind, head[at + 8 : at + size])
            at, n = at + size, n - 1
    return found


def mobi(data: bytes) -> str:
    """A book as Markdown: its title, author and publisher, and its text."""
    from weft.functions.html import markdown, parse

    if len(data) < 80 or data[60:68] not in (b"BOOKMOBI", b"TEXtREAd"):
        raise ValueError("not a MOBI file")
    records = _records(data)
    head = records[0]
    kind, _, declared, count, _, locked = struct.unpack_from(">HHIHHH", head)
    if locked:
        raise ValueError("protected book")
    if kind not in (PLAIN, PALMDOC):
        raise ValueError("Huffman compression is not supported" if kind == HUFFMAN else f"unknown compression {kind}")
    if declared > MOST_TEXT:
        raise ValueError(f"more than {MOST_TEXT} bytes of text")
    coding, flags, meta, title = "cp1252", 0, {}, data[:32].split(b"\0")[0]
    if head[16:20] == b"MOBI":
        length, _, code = struct.unpack_from(">III", head, 20)
        coding = "utf-8" if code == 65001 else "cp1252"
        meta = _metadata(head, length) if len(head) >= 132 else {}
        if len(head) >= 92:
            at, n = struct.unpack_from(">II", head, 84)
            title = head[at : at + n] or title
        if length >= 228 and len(head) >= 244:
            flags = struct.unpack_from(">H", head, 242)[0]
    text = bytearray()
    for record in records[1 : count + 1]:
        body = _without_trailer(record, flags)
        text += unpack(body, MOST_TEXT - len(text)) if kind == PALMDOC else body
    said = lambda b: " ".join(b.decode(coding, "replace").split())
    raw = bytes(text).replace(b"\0", b"").decode(coding, "replace")
    body = markdown(parse(raw)) if "<" in raw else raw.strip()
    if not body:
        raise ValueError("no text in the book")
    lines = [("# {}", meta.get(TITLE, title)), ("**Author:** {}", meta.get(AUTHOR, b"")), ("**Publisher:** {}", meta.get(PUBLISHER, b""))]
    return "\n\n".join([*(form.format(said(b)) for form, b in lines if said(b)), body])
