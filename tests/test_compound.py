"""Generated DOC and XLS files read as their source; broken ones end with an error."""

import io
import struct
import zipfile

import pytest

from weft.sources import compound as C
from weft.sources import readers as R

FREE, END, FAT = 0xFFFFFFFF, 0xFFFFFFFE, 0xFFFFFFFD


def compound(streams, inner=(), loop=False):
    """A file of 512-byte sectors: streams of 4 096 bytes and more in sectors, smaller ones in the mini stream."""
    sectors, table, mini, mini_table = [], [], b"", []

    def put(data):
        if not data:
            return END
        start = len(sectors)
        parts = [data[i : i + 512].ljust(512, b"\0") for i in range(0, len(data), 512)]
        sectors.extend(parts)
        table.extend([*range(start + 1, start + len(parts)), END])
        return start

    def entry(name, kind, left, right, child, start, size):
        raw = name.encode("utf-16-le") + b"\0\0"
        return raw.ljust(64, b"\0") + struct.pack("<HBBIII", len(raw), kind, 1, left, right, child) + bytes(36) + struct.pack("<IQ", start, size)

    entries = []
    for n, (name, data) in enumerate([*streams.items(), *inner]):
        if len(data) >= 4096:
            start = put(data)
        else:
            start, parts = len(mini) // 64, (len(data) + 63) // 64
            mini += data.ljust(64 * parts, b"\0")
            mini_table += [*range(start + 1, start + parts), END] if parts else []
        right = n + 2 if n + 1 < len(streams) else FREE
        entries.append(entry(name, 2, FREE, right, FREE, start, len(data)))
    at_mini, mini_size = put(mini), len(mini)
    mini_start = put(struct.pack(f"<{len(mini_table)}I", *mini_table).ljust(512, b"\xff"))
    listing = entry("Root Entry", 5, FREE, FREE, 1 if streams else FREE, at_mini, mini_size) + b"".join(entries)
    at_listing = put(listing.ljust((len(listing) + 511) // 512 * 512, b"\0"))
    count = 1
    while count * 128 < len(table) + count:
        count += 1
    first = len(sectors)
    if loop:
        table[0] = 0
    table += [FAT] * count
    raw = struct.pack(f"<{len(table)}I", *table).ljust(512 * count, b"\xff")
    body = b"".join(sectors) + raw
    head = C.MAGIC + bytes(16) + struct.pack("<5H", 62, 3, 0xFFFE, 9, 6) + bytes(6) + struct.pack("<9I", 0, count, at_listing, 0, 4096, mini_start, 1, END, 0)
    return head + struct.pack("<109I", *[*range(first, first + count), *[FREE] * (109 - count)]) + body


def word(paragraphs, cut=None, flags=0x200, version=0xC1, notes=""):
    """A document of (text with its mark, style, changes); the text up to ``cut`` in one byte a character, the rest in two."""
    text = "".join(p for p, _, _ in paragraphs)
    whole, cut = text + notes, len(text + notes) if cut is None else cut
    low, high = whole[:cut].encode("cp1252"), whole[cut:].encode("utf-16-le", "surrogatepass")
    start = 2048
    second = start + len(low) + len(low) % 2
    place = lambda k: start + k if k < cut or k == cut == len(whole) else second + 2 * (k - cut)
    pages, at = [], 0
    for lo in range(0, len(paragraphs), 5):
        some = paragraphs[lo : lo + 5]
        page, starts, offset, offsets = bytearray(512), [], 510, []
        for t, style, changes in some:
            starts.append(place(at))
            at += len(t)
            body = struct.pack("<H", style) + changes
            body = bytes([(len(body) + 1) // 2]) + body if len(body) % 2 else bytes([0, len(body) // 2]) + body
            offset -= len(body) + len(body) % 2
            page[offset : offset + len(body)] = body
            offsets.append(offset // 2)
        starts.append(place(at))
        struct.pack_into(f"<{len(starts)}I", page, 0, *starts)
        for k, o in enumerate(offsets):
            page[4 * len(starts) + 13 * k] = o
        page[511] = len(some)
        pages.append((starts[0], starts[-1], bytes(page)))
    used = 2048 + len(low) + len(low) % 2 + len(high)
    base = (used + 511) // 512
    fib = bytearray(2048)
    struct.pack_into("<HH", fib, 0, 0xA5EC, version)
    struct.pack_into("<H", fib, 10, flags)
    struct.pack_into("<H", fib, 32, 14)
    struct.pack_into("<H", fib, 62, 22)
    struct.pack_into("<2i", fib, 64 + 12, len(text), len(notes))
    struct.pack_into("<H", fib, 152, 93)
    pieces = [p for p in ((0, cut, 0x40000000 | start * 2), (cut, len(whole), second)) if p[0] < p[1]]
    plan = struct.pack(f"<{len(pieces) + 1}I", *[p[0] for p in pieces], len(whole)) + b"".join(struct.pack("<HIH", 0, p[2], 0) for p in pieces)
    clx = b"\x01" + struct.pack("<H", 3) + b"abc" + b"\x02" + struct.pack("<I", len(plan)) + plan
    bins = struct.pack(f"<{len(pages) + 1}I", *[p[0] for p in pages], pages[-1][1]) + struct.pack(f"<{len(pages)}I", *range(base, base + len(pages)))
    struct.pack_into("<II", fib, 154 + 8 * 33, 0, len(clx))
    struct.pack_into("<II", fib, 154 + 8 * 13, len(clx), len(bins))
    stream = (bytes(fib) + low + b"\0" * (len(low) % 2) + high).ljust(base * 512, b"\0") + b"".join(p for _, _, p in pages)
    return {"WordDocument": stream, "1Table": clx + bins}


CELL = struct.pack("<HB", C.IN_TABLE, 1)
END_OF_ROW = CELL + struct.pack("<HB", C.ROW_END, 1) + struct.pack("<HHB", 0xD608, 2, 9)
PARAGRAPHS = [
    ("Über uns\r", 1, b""),
    ("Plain text with a soft\x0bbreak and non\x1ebreaking.\r", 0, b""),
    ('See \x13 HYPERLINK "http://x.y" \x13 NESTED \x14no\x15\x14the site\x15.\r', 0, struct.pack("<HH", 0x4600, 3)),
    ("Name\x07", 0, CELL),
    ("Price|unit\x07", 0, CELL),
    ("\x07", 0, END_OF_ROW),
    ("two\r", 0, CELL),
    ("lines\x07", 0, CELL),
    ("\x07", 0, CELL),
    ("\x07", 0, END_OF_ROW),
    ("\r", 0, b""),
    ("Details\r", 3, b""),
    ("Last 文字 and 😀 here\r", 0, b""),
]
MARKDOWN = "# Über uns\n\nPlain text with a soft\nbreak and non-breaking.\n\nSee the site.\n\n| Name | Price\\|unit |\n| --- | --- |\n| two lines |  |\n\n### Details\n\nLast 文字 and 😀 here"


def units(paragraphs):
    """Paragraphs as strings of UTF-16 units, which places in the file count."""
    return [(C._units(t.encode("utf-16-le")), s, c) for t, s, c in paragraphs]


def test_doc():
    paragraphs = units(PARAGRAPHS)
    for cut in (0, 9, 60, 150):
        assert C.doc(compound(word(paragraphs, cut))) == MARKDOWN
    assert C.doc(compound(word(paragraphs, 5, notes="A note.\r"))) == MARKDOWN + "\n\nA note."
    many = units([(f"Heading {i}\r", 2, b"") if i % 7 == 0 else (f"Paragraph {i} " + "word " * 20 + "\r", 0, b"") for i in range(400)])
    got = C.doc(compound(word(many, 3000))).split("\n\n")
    assert len(got) == 400 and got[0] == "## Heading 0" and got[398] == "Paragraph 398 " + ("word " * 20).strip() and got[399] == "## Heading 399"


def test_broken_doc():
    good = word([("text\r", 0, b"")])
    assert C.doc(compound(good)) == "text"
    assert C.doc(compound(word([("\r", 0, b"")]))) == ""
    for made, error in (
        (compound(word([("x\r", 0, b"")], flags=0x300)), "protected"),
        (compound(word([("x\r", 0, b"")], version=0x65)), "before Word 97"),
        (compound({"Other": b"x" * 5000}), "no Word document"),
        (compound({**good, "WordDocument": good["WordDocument"].ljust(6000, b"\0")}, loop=True), "loop"),
        (compound({**good, "1Table": b"\0" * 90}), "no table of pieces"),
        (b"PK", "not a compound file"),
    ):
        with pytest.raises(ValueError, match=error):
            C.doc(made)
    whole = compound(good)
    for n in range(0, len(whole), 97):  # cut anywhere: an error or a text, and an end
        try:
            C.doc(whole[:n])
        except (ValueError, struct.error, KeyError, IndexError):
            continue


def record(code, body=b""):
    return struct.pack("<HH", code, len(body)) + body


def text16(s, wide=None, runs=0, more=b""):
    wide = any(ord(c) > 255 for c in s) if wide is None else wide
    flags = wide | (8 if runs else 0) | (4 if more else 0)
    head = struct.pack("<B", flags) + (struct.pack("<H", runs) if runs else b"") + (struct.pack("<I", len(more)) if more else b"")
    return head + s.encode("utf-16-le" if wide else "latin-1") + bytes(4 * runs) + more


def long_text(s, **k):
    return struct.pack("<H", len(s.encode("utf-16-le")) // 2) + text16(s, **k)


def workbook(sheets, strings=(), parts=None, protected=False, version=0x0600):
    bof = lambda kind: record(C.BOF, struct.pack("<HH", version, kind) + bytes(12))
    sst = parts or record(C.STRINGS, struct.pack("<II", len(strings), len(strings)) + b"".join(strings))
    head = bof(5) + (record(C.PROTECTED, bytes(6)) if protected else b"")
    size = len(head) + len(sst) + 4 + sum(4 + 7 + len(text16(n)) for n, _ in sheets)
    bounds, bodies = b"", b""
    for name, body in sheets:
        bounds += record(C.SHEET, struct.pack("<IBBB", size + len(bodies), 0, 0, len(name)) + text16(name))
        bodies += bof(16) + body + record(C.EOF)
    return {"Workbook": head + bounds + sst + record(C.EOF) + bodies}


def cell(code, row, column, rest):
    return record(code, struct.pack("<HHH", row, column, 0) + rest)


def test_xls():
    strings = [long_text("Item"), long_text("Größe|x", runs=2), long_text("数量", more=b"phonetic"), long_text("")]
    chart = record(C.BOF, struct.pack("<HH", 0x0600, 0x20) + bytes(12)) + cell(C.NUMBER, 0, 0, struct.pack("<d", 99)) + record(C.EOF)
    small = lambda x, hundredths=0: struct.pack("<i", (x << 2) | 2 | hundredths)
    first = b"".join([
        *[cell(C.SHARED, 0, c, struct.pack("<I", c)) for c in range(4)],
        cell(C.NUMBER, 1, 0, struct.pack("<d", 3.0)), cell(C.NUMBER, 1, 1, struct.pack("<d", -2.456)), cell(C.SMALL, 1, 3, small(-7)),
        chart,
        record(C.SMALLS, struct.pack("<HH", 3, 1) + b"".join(b"\0\0" + v for v in (small(12345, 1), small(5), struct.pack("<d", 1.5)[4:])) + struct.pack("<H", 3)),
        cell(C.TRUTH, 4, 0, b"\x01\x00"), cell(C.TRUTH, 4, 1, b"\x2a\x01"), cell(C.LABEL, 4, 2, long_text("old")), cell(C.RICH, 4, 3, long_text("rich") + bytes(6)),
        cell(C.FORMULA, 5, 0, struct.pack("<d", 42.0) + bytes(8)), cell(C.FORMULA, 5, 1, b"\0\0\0\0\0\0\xff\xff" + bytes(8)), record(0x04BC, b"shared formula"), record(C.RESULT, long_text("text\nof it")),
        cell(C.FORMULA, 5, 2, b"\x01\0\0\0\0\0\xff\xff" + bytes(8)), cell(C.FORMULA, 5, 3, b"\x02\0\x07\0\0\0\xff\xff" + bytes(8)),
    ])
    table = "| Item | Größe\\|x | 数量 |  |\n| --- | --- | --- | --- |\n| 3 | -2.46 |  | -7 |\n|  | 123.45 | 5 | 1.50 |\n| true | ERR:NA | old | rich |\n| 42 | text of it | false | ERR:Div0 |"
    assert C.xls(compound(workbook([("One", first)], strings))) == table
    two = cell(C.NUMBER, 0, 0, struct.pack("<d", 1e20))
    assert C.xls(compound(workbook([("One", first), ("Leer", b""), ("Zwei ü", two)], strings))) == f"## One\n\n{table}\n\n## Zwei ü\n\n| 100000000000000000000.00 |\n| --- |"
    assert C.xls(compound(workbook([("One", b"")]))) == ""
    large = b"".join(cell(C.SHARED, r, c, struct.pack("<I", 0)) for r in range(2000) for c in range(3))
    assert C.xls(compound(workbook([("Big", large)], strings))).count("| Item | Item | Item |") == 2000


def test_strings_across_records():
    """A string that goes on in the next record may change its width there; a seam may also lie between strings and in what follows one."""
    body = struct.pack("<II", 3, 3) + long_text("plain") + struct.pack("<H", 8) + b"\0abcd"
    parts = record(C.STRINGS, body) + record(C.CONTINUE, b"\x01" + "文字xy".encode("utf-16-le") + struct.pack("<HBH", 3, 8, 2) + b"end" + bytes(3)) + record(C.CONTINUE, bytes(5))
    cells = b"".join(cell(C.SHARED, 0, c, struct.pack("<I", c)) for c in range(3))
    assert C.xls(compound(workbook([("s", cells)], parts=parts))).startswith("| plain | abcd文字xy | end |\n")


def test_broken_xls():
    for made, error in (
        (compound(workbook([("s", b"")], protected=True)), "protected"),
        (compound(workbook([("s", b"")], version=0x0500)), "before Excel 97"),
        (compound({"Book": b"x"}), "before Excel 97"),
        (compound({"Other": b"x"}, inner=[("Workbook", b"x")]), "no workbook"),
        (compound(workbook([("s", b"")], parts=record(C.STRINGS, struct.pack("<IIH", 1, 1, 900) + b"\0cut"))), "cut off"),
    ):
        with pytest.raises(ValueError, match=error):
            C.xls(made)
    # cells that name one long string again and again, and rows that are far apart in width, are counted before they are built
    long = [long_text("x" * 8000)]
    many = b"".join(cell(C.SHARED, r, 0, struct.pack("<I", 0)) for r in range(9000))
    with pytest.raises(ValueError, match="too much"):
        C.xls(compound(workbook([("s", many)], long)))
    with pytest.raises(ValueError, match="too much"):
        C.xls(compound(workbook([("s", b"".join(cell(C.NUMBER, r, 65000, struct.pack("<d", 1)) for r in range(2000)))])))


def test_rows(spark):
    rows = [("a.doc", compound(word([("Text\r", 1, b"")]))), ("b.xls", compound(workbook([("s", cell(C.NUMBER, 0, 0, struct.pack("<d", 2)))]))), ("c.xls", b"no"), ("d.doc", None), ("e.ppt", b"x")]
    got = {r.path: (r.text, r.error) for r in R.extract(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert got == {"a.doc": ("# Text", None), "b.xls": ("| 2 |\n| --- |", None), "c.xls": (None, "ValueError: not a compound file"), "d.doc": (None, "ValueError: not a compound file"), "e.ppt": (None, "ppt is not supported")}


def test_cells_of_xlsx():
    """Truth values and errors read as in the older format."""
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="One"/></sheets></workbook>')
        cells = '<c r="A1" t="b"><v>1</v></c><c r="B1" t="b"><v>0</v></c><c r="C1" t="e"><v>#DIV/0!</v></c><c r="D1" t="e"><v>#N/A</v></c><c r="E1" t="b"/>'
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData><row>{cells}</row></sheetData></worksheet>")
    assert R.xlsx(out.getvalue()).startswith("| true | false | ERR:Div0 | ERR:NA |  |")
