"""Generated books read as their source."""

import random
import struct

import pytest

from weft.sources import mobi as M
from weft.sources import readers as R


def packed(data):
    """PalmDOC compression: the longest copy from the last 2 047 bytes, spaces with letters, runs of other bytes."""
    out, i = bytearray(), 0
    while i < len(data):
        at, n = -1, 0
        for size in range(10, 2, -1):
            found = data.rfind(data[i : i + size], max(0, i - 2047), i + size - 1) if i + size <= len(data) else -1
            if found >= 0 and found < i:
                at, n = found, size
                break
        if n:
            out += struct.pack(">H", 0x8000 | (i - at) << 3 | n - 3)
            i += n
        elif data[i] == 0x20 and i + 1 < len(data) and 0x40 <= data[i + 1] < 0x80:
            out.append(data[i + 1] | 0x80)
            i += 2
        elif data[i] == 0 or 9 <= data[i] < 0x80:
            out.append(data[i])
            i += 1
        else:
            out += bytes((1, data[i]))
            i += 1
    return bytes(out)


def book(text, kind=M.PALMDOC, coding=65001, locked=0, flags=0, meta=((100, b"Ann  Author"), (503, "Großer Titel".encode()), (101, b"House")), declared=None, mobi=True):
    parts = [text[i : i + 4096] for i in range(0, len(text), 4096)]
    records = [packed(p) if kind == M.PALMDOC else p for p in parts]
    if flags & 1:
        records = [r + b"\0" for r in records]
    for _ in range((flags >> 1).bit_count()):
        records = [r + b"junk" + bytes([0x85]) for r in records]  # an entry of five bytes, its size last
    head = struct.pack(">HHIHHHH", kind, 0, len(text) if declared is None else declared, len(parts), 4096, locked, 0)
    if mobi:
        exth = b"".join(struct.pack(">II", k, 8 + len(v)) + v for k, v in meta)
        exth = b"EXTH" + struct.pack(">II", 12 + len(exth), len(meta)) + exth
        name = b"Full name"
        fixed = bytearray(232)
        fixed[:16] = b"MOBI" + struct.pack(">III", 232, 2, coding)
        fixed[84 - 16 : 92 - 16] = struct.pack(">II", 16 + 232 + len(exth), len(name))
        fixed[128 - 16 : 132 - 16] = struct.pack(">I", 0x40)
        fixed[242 - 16 : 244 - 16] = struct.pack(">H", flags)
        head += bytes(fixed) + exth + name
    records = [head, *records, b"end"]
    at = 78 + 8 * len(records) + 2
    table = b""
    for n, r in enumerate(records):
        table += struct.pack(">II", at, n)
        at += len(r)
    top = b"Palm name".ljust(32, b"\0") + bytes(28) + (b"BOOKMOBI" if mobi else b"TEXtREAd") + bytes(8) + struct.pack(">H", len(records))
    return top + table + b"\0\0" + b"".join(records)


BODY = "<html><body><h1>Ch</h1>" + "".join(f"<p>Absatz {i}, über {i % 7} Äpfel, and the same words again and again.</p>" for i in range(400)) + "</body></html>"


def test_books_read_as_their_source():
    from weft.functions.html import markdown, parse

    want = markdown(parse(BODY))
    head = "# Großer Titel\n\n**Author:** Ann Author\n\n**Publisher:** House\n\n"
    for kind in (M.PLAIN, M.PALMDOC):
        for flags in (0, 1, 2, 3, 7):
            assert M.mobi(book(BODY.encode(), kind, flags=flags)) == head + want
    assert M.mobi(book(BODY.encode("cp1252"), coding=1252, meta=())) == "# Full name\n\n" + want
    assert M.mobi(book(b"plain text", mobi=False)) == "# Palm name\n\nplain text"


def test_unpacking_is_the_inverse_of_packing():
    rng = random.Random(3)
    for _ in range(60):
        data = bytes(rng.choice(b"ab \x00\x05\xff zq") for _ in range(rng.randint(0, 300)))
        assert M.unpack(packed(data), 1000) == data
    assert M.unpack(b"a" + struct.pack(">H", 0x8000 | 1 << 3 | 7), 99) == b"a" * 11  # a copy that reaches into itself


def test_protected_broken_and_swelling_books(spark, monkeypatch):
    swelling = b"a" + struct.pack(">H", 0x8000 | 1 << 3 | 7) * 2000
    with pytest.raises(ValueError, match="more than"):
        M.unpack(swelling, 5000)
    cases = {"a": (book(b"<p>x</p>", locked=2), "protected"), "b": (book(b"x", kind=M.HUFFMAN), "Huffman"), "c": (book(b"x", declared=M.MOST_TEXT + 1), "more than"), "d": (b"x" * 200, "not a MOBI"), "e": (book(b"<p> </p>"), "no text"), "f": (book(b"x")[:90], "table|error|unpack")}
    rows = [(f"{k}.mobi", v) for k, (v, _) in cases.items()] + [("g.mobi", book(b"<p>fine</p>"))]
    got = {r.path[0]: (r.text, r.error) for r in R.extract(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert got["g"] == ("# Großer Titel\n\n**Author:** Ann Author\n\n**Publisher:** House\n\nfine", None)
    import re

    assert all(got[k][0] is None and re.search(want, got[k][1]) for k, (_, want) in cases.items()), got
    with pytest.raises(ValueError, match="before the start"):
        M.unpack(b"\x80\x10", 99)
