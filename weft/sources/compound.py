"""Text of the older binary office files, DOC and XLS, with the standard library and numpy.

Both are compound files: sectors chained by an allocation table, small streams in sectors of a mini stream, names in a directory tree.
A chain of more sectors than the file has is a loop and an error; so are protected files and versions before Word 97 and Excel 97. What
cells refer to more than once is counted each time, and text over ``MOST_TEXT`` characters is an error.
"""

from __future__ import annotations

import bisect
import re
import struct
from collections.abc import Iterator

import numpy as np

MAGIC = bytes.fromhex("d0cf11e0a1b11ae1")
MOST_TEXT = 64 * 1024 * 1024
LAST = 0xFFFFFFFA
NONE = 0xFFFFFFFF


class Compound:
    """The streams of the root storage, by name. Those of storages inside (embedded objects) aren't among them."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC or len(data) < 512:
            raise ValueError("not a compound file")
        self.data = data
        version, _, shift, mini_shift = struct.unpack_from("<4H", data, 26)
        if shift not in (9, 12) or mini_shift != 6:
            raise ValueError("unknown sizes of sectors")
        self.size, self.mini_size = 1 << shift, 1 << mini_shift
        self.most = (len(data) + self.size - 1) // self.size
        directory = struct.unpack_from("<I", data, 48)[0]
        self.cutoff, mini_table, _, difat = struct.unpack_from("<4I", data, 56)
        parts, seen = list(struct.unpack_from("<109I", data, 76)), 0
        while difat < LAST:
            more = struct.unpack(f"<{self.size // 4}I", self._sector(difat))
            parts, difat, seen = parts + list(more[:-1]), more[-1], seen + 1
            if seen > self.most:
                raise ValueError("a chain of sectors runs in a loop")
        table = b"".join(self._sector(n) for n in parts[: self.most + 109] if n < LAST)
        self.table = np.frombuffer(table, "<u4")
        entries = self._chain(directory)
        self.mini_table = np.frombuffer(self._chain(mini_table), "<u4")
        self.root = self._entry(entries, 0)
        self.mini = self._chain(self.root[4])[: self.root[5]]
        self.streams: dict[str, tuple[int, int]] = {}
        todo, done = [self.root[3]], set()
        while todo:
            number = todo.pop()
            if number >= len(entries) // 128 or number in done:
                continue
            done.add(number)
            name, kind, sides, _, start, length = self._entry(entries, number)
            todo += sides
            if kind == 2:
                self.streams[name] = (start, length if version > 3 else length & 0xFFFFFFFF)

    def _sector(self, number: int) -> bytes:
        at = (number + 1) * self.size
        if at >= len(self.data):
            raise ValueError("a sector outside the file")
        return self.data[at : at + self.size].ljust(self.size, b"\0")

    @staticmethod
    def _entry(entries: bytes, number: int) -> tuple[str, int, tuple[int, int], int, int, int]:
        at = 128 * number
        if len(entries) < at + 128:
            raise ValueError("no directory")
        length, kind, _, left, right, child = struct.unpack_from("<HBBIII", entries, at + 64)
        start, size = struct.unpack_from("<IQ", entries, at + 116)
        return entries[at : at + max(0, min(length, 64) - 2)].decode("utf-16-le", "replace"), kind, (left, right), child, start, size

    def _chain(self, number: int) -> bytes:
        out = []
        while number < LAST:
            out.append(self._sector(number))
            if len(out) > self.most or number >= len(self.table):
                raise ValueError("a chain of sectors runs in a loop" if len(out) > self.most else "a sector outside the table")
            number = int(self.table[number])
        return b"".join(out)

    def stream(self, name: str) -> bytes:
        start, size = self.streams[name]
        if size >= self.cutoff:
            return self._chain(start)[:size]
        out, most = [], len(self.mini) // self.mini_size + 1
        while start < LAST and len(out) * self.mini_size < size:
            out.append(self.mini[start * self.mini_size : (start + 1) * self.mini_size])
            if len(out) > most or start >= len(self.mini_table):
                raise ValueError("a chain of sectors runs in a loop")
            start = int(self.mini_table[start])
        return b"".join(out)[:size]


# ---- DOC

IN_TABLE, ROW_END = 0x2416, 0x2417
MARKS = re.compile("([\x07\x0c\x0d\x13\x14\x15])")
#: Characters of Word that stand for something else; pictures and notes' places go.
SIGNS = str.maketrans({"\x0b": "\n", "\x1e": "-", "\x1f": None, "\x01": None, "\x02": None, "\x05": None, "\x08": None, "\x00": None})


def _units(raw: bytes) -> str:
    """UTF-16 as a string of its units, so that places stay; ``_joined`` puts pairs together."""
    return np.frombuffer(raw[: len(raw) // 2 * 2], "<u2").astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


def _joined(text: str) -> str:
    return text.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")


def _flags(changes: bytes) -> dict[int, int]:
    """Paragraph changes of one byte, by their code; the code's upper bits tell how long its operand is."""
    found, at = {}, 0
    while at + 2 < len(changes):
        code = struct.unpack_from("<H", changes, at)[0]
        at += 2
        kind = code >> 13
        if kind < 2:
            found[code] = changes[at]
        size = (1, 1, 2, 4, 2, 2, 0, 3)[kind]
        if kind == 6:
            size = (struct.unpack_from("<H", changes, at)[0] + 1 if at + 2 <= len(changes) else NONE) if code == 0xD608 else changes[at] + 1
        at += size
    return found


class _Styles:
    """Style number, and whether a paragraph ends a row, by the place of its mark in the file."""

    def __init__(self, word: bytes, bins: bytes):
        runs = []
        count = max(0, (len(bins) - 4) // 8)
        for (number,) in struct.iter_unpack("<I", bins[4 * (count + 1) : 4 * (count + 1) + 4 * count]):
            page = word[(number & 0x3FFFFF) * 512 :][:512]
            if len(page) < 512:
                continue
            n = min(page[511], (511 - 4) // 17)
            starts = struct.unpack_from(f"<{n + 1}I", page)
            for k in range(n):
                at = 2 * page[4 * (n + 1) + 13 * k]
                style, flags = 0, {}
                if at:
                    half = page[at]
                    body = page[at + 1 : at + 2 * half] if half else page[at + 2 : at + 2 + 2 * page[min(at + 1, 511)]]
                    if len(body) >= 2:
                        style, flags = struct.unpack_from("<H", body)[0], _flags(body[2:])
                runs.append((starts[k], starts[k + 1], style, bool(flags.get(ROW_END)), bool(flags.get(IN_TABLE))))
        self.runs = sorted(runs)
        self.starts = [r[0] for r in self.runs]

    def at(self, place: int) -> tuple[int, bool, bool]:
        k = bisect.bisect_right(self.starts, place) - 1
        return self.runs[k][2:] if k >= 0 and place < self.runs[k][1] else (0, False, False)


def _pieces(word: bytes, table: bytes) -> Iterator[tuple[int, str, int, int]]:
    """(first place in the text, units, place in the file, bytes a unit) of the pieces, in the text's order."""
    at = 0
    while at < len(table) and table[at] == 1:
        at += 3 + struct.unpack_from("<H", table, at + 1)[0]
    if at + 5 > len(table) or table[at] != 2:
        raise ValueError("no table of pieces")
    plan = table[at + 5 :][: struct.unpack_from("<I", table, at + 1)[0]]
    n = (len(plan) - 4) // 12
    ends, total = struct.unpack_from(f"<{n + 1}I", plan), 0
    for k in range(n):
        length, place = ends[k + 1] - ends[k], struct.unpack_from("<I", plan, 4 * (n + 1) + 8 * k + 2)[0]
        total += max(0, length)
        if length < 0 or total > MOST_TEXT:
            raise ValueError("a broken table of pieces" if length < 0 else "too much text")
        size, start = (1, (place & 0x3FFFFFFF) // 2) if place & 0x40000000 else (2, place & 0x3FFFFFFF)
        raw = word[start : start + length * size]
        yield ends[k], raw.decode("cp1252", "replace") if size == 1 else _units(raw), start, size


def doc(data: bytes) -> str:
    """A Word document as Markdown: headings by their built-in styles, tables as pipe tables, the results of fields; footnotes and
    endnotes follow the text, headers and comments are left out."""
    from weft.sources.readers import pipe_table

    file = Compound(data)
    if "WordDocument" not in file.streams:
        raise ValueError("no Word document")
    word = file.stream("WordDocument")
    mark, version, flags = *struct.unpack_from("<HH", word), struct.unpack_from("<H", word, 10)[0]
    if mark != 0xA5EC or version < 0xC1:
        raise ValueError("a version before Word 97")
    if flags & 0x100:
        raise ValueError("protected document")
    table = file.stream("1Table" if flags & 0x200 else "0Table")
    longs = 34 + 2 * struct.unpack_from("<H", word, 32)[0]
    counts = struct.unpack_from("<11i", word, longs + 2)[3:]
    pairs = longs + 2 + 4 * struct.unpack_from("<H", word, longs)[0] + 2
    part = lambda k: table[(p := struct.unpack_from("<II", word, pairs + 8 * k))[0] :][: p[1]]
    styles, main = _Styles(word, part(13)), counts[0]
    notes = range(main, main + counts[1]), range(main + sum(counts[1:5]), main + sum(counts[1:6]))

    blocks: list[str] = []
    rows: list[list[str]] = []
    cells: list[str] = []
    held: list[str] = []
    line: list[str] = []
    hidden: list[bool] = []

    def table_ends() -> None:
        if cells:
            rows.append(cells.copy())
        if rows:
            blocks.append(pipe_table(rows))
        rows.clear()
        cells.clear()

    def paragraph(sign: str, style: int, ends_row: bool, inside: bool) -> None:
        text = _joined("".join(line)).translate(SIGNS).strip()
        line.clear()
        if sign == "\x07":
            if ends_row:
                rows.append(cells.copy())
                cells.clear()
            else:
                cells.append("\n".join([*held, text]).strip())
            held.clear()
            return
        if inside and sign == "\x0d":
            held.append(text)
            return
        table_ends()
        if text:
            blocks.append("#" * min(style, 6) + " " + text.replace("\n", " ") if 1 <= style <= 9 else text)

    for first, text, start, size in _pieces(word, part(33)):
        at = 0
        for bit in MARKS.split(text):
            place, at = first + at, at + len(bit)
            if not (place < main or any(place in r for r in notes)):
                continue
            if bit == "\x13":
                hidden.append(True)
            elif bit == "\x14":
                hidden[-1:] = [False] * bool(hidden)
            elif bit == "\x15":
                hidden[-1:] = []
            elif len(bit) == 1 and bit in "\x07\x0c\x0d":
                if not any(hidden):
                    paragraph(bit, *styles.at(start + (place - first) * size))
            elif not any(hidden):
                keep = bit if place >= main or place + len(bit) <= main else bit[: main - place]
                line.append(keep)
    paragraph("\x0c", 0, False, False)
    return "\n\n".join(b for b in blocks if b)


# ---- XLS

#: The codes of errors in cells, and their names.
ERRORS = {0x00: "Null", 0x07: "Div0", 0x0F: "Value", 0x17: "Ref", 0x1D: "Name", 0x24: "Num", 0x2A: "NA", 0x2B: "GettingData"}
BOF, EOF, CONTINUE, PROTECTED, SHEET, STRINGS = 0x0809, 0x000A, 0x003C, 0x002F, 0x0085, 0x00FC
SHARED, LABEL, RICH, NUMBER, SMALL, SMALLS, TRUTH, FORMULA, RESULT = 0x00FD, 0x0204, 0x00D6, 0x0203, 0x027E, 0x00BD, 0x0205, 0x0006, 0x0207


def _records(data: bytes, at: int = 0) -> Iterator[tuple[int, list[bytes]]]:
    """(code, body and its continuations) of records from a place on."""
    held: tuple[int, list[bytes]] | None = None
    while at + 4 <= len(data):
        code, size = struct.unpack_from("<HH", data, at)
        body = data[at + 4 : at + 4 + size]
        at += 4 + size
        if code == CONTINUE and held:
            held[1].append(body)
            continue
        if held:
            yield held
        held = (code, [body])
    if held:
        yield held


class _Parts:
    """Reads on over continuations; characters behind a seam start with a new byte that tells their width."""

    def __init__(self, parts: list[bytes]):
        self.parts, self.part, self.at = parts, 0, 0

    def left(self) -> bool:
        while self.part < len(self.parts) and self.at >= len(self.parts[self.part]):
            self.part, self.at = self.part + 1, 0
        return self.part < len(self.parts)

    def take(self, n: int) -> bytes:
        out = b""
        while n > len(out):
            if not self.left():
                raise ValueError("a string is cut off")
            got = self.parts[self.part][self.at : self.at + n - len(out)]
            self.at += len(got)
            out += got
        return out

    def string(self, n: int) -> str:
        wide = self.take(1)[0]
        runs = struct.unpack("<H", self.take(2))[0] if wide & 8 else 0
        more = struct.unpack("<I", self.take(4))[0] if wide & 4 else 0
        out, part = [], self.part
        while n:
            if not self.left():
                raise ValueError("a string is cut off")
            if self.part != part:
                wide, part = self.take(1)[0], self.part
            size = 1 + (wide & 1)
            fit = min(n, (len(self.parts[self.part]) - self.at) // size)
            if not fit:
                raise ValueError("a character is cut in two")
            out.append(self.take(fit * size).decode("utf-16-le", "surrogatepass") if size == 2 else self.take(fit).decode("latin-1"))
            n -= fit
        for skip in (4 * runs, more):
            while skip:
                if not self.left():
                    raise ValueError("a string is cut off")
                skip -= len(self.take(min(skip, len(self.parts[self.part]) - self.at)))
        return _joined("".join(out))


def _small(raw: bytes) -> float:
    """A number of 30 bits: a whole one or the head of a double, maybe in hundredths."""
    n = struct.unpack("<i", raw)[0]
    x = float(n >> 2) if n & 2 else struct.unpack("<d", b"\0\0\0\0" + struct.pack("<I", n & 0xFFFFFFFC))[0]
    return x / 100 if n & 1 else x


def _cells(data: bytes, at: int, shared: list[str]) -> Iterator[tuple[int, int, str]]:
    """(row, column, text) of a sheet's cells in the file's order. Charts inside it have records of their own and are passed over."""
    from weft.sources.readers import cell_text

    depth, waits = 0, None
    truth = lambda value, error: ("ERR:" + ERRORS.get(value, str(value))) if error else str(bool(value)).lower()
    number = lambda x: cell_text(repr(x)) if x == x and abs(x) != float("inf") else str(x)
    for code, parts in _records(data, at):
        body = parts[0]
        depth += (code == BOF) - (code == EOF)
        if depth <= 0:
            return
        if depth > 1:
            continue
        if code == RESULT and waits:
            reader = _Parts(parts)
            yield *waits, reader.string(struct.unpack("<H", reader.take(2))[0])
            waits = None
            continue
        if code not in (SHARED, LABEL, RICH, NUMBER, SMALL, SMALLS, TRUTH, FORMULA) or len(body) < 8:
            continue
        row, column = struct.unpack_from("<HH", body)
        if code == SHARED:
            (k,) = struct.unpack_from("<I", body, 6)
            yield row, column, shared[k] if k < len(shared) else ""
        elif code in (LABEL, RICH):
            reader = _Parts(parts)
            reader.take(6)
            yield row, column, reader.string(struct.unpack("<H", reader.take(2))[0])
        elif code == NUMBER:
            yield row, column, number(struct.unpack_from("<d", body, 6)[0])
        elif code == SMALL:
            yield row, column, number(_small(body[6:10]))
        elif code == SMALLS:
            for k in range((len(body) - 6) // 6):
                yield row, column + k, number(_small(body[6 + 6 * k : 10 + 6 * k]))
        elif code == TRUTH:
            yield row, column, truth(body[6], body[7])
        elif body[12:14] != b"\xff\xff":
            yield row, column, number(struct.unpack_from("<d", body, 6)[0])
        elif body[6] in (1, 2):
            yield row, column, truth(body[8], body[6] == 2)
        else:
            waits = (row, column) if body[6] == 0 else None


def xls(data: bytes) -> str:
    """A workbook as pipe tables, under headings where it has several sheets: whole numbers as such, others with two decimals (dates are
    the numbers that the file holds), the last results of formulas, errors as ``ERR:`` and a name."""
    from weft.sources.readers import pipe_table

    file = Compound(data)
    if "Workbook" not in file.streams:
        raise ValueError("a version before Excel 97" if "Book" in file.streams else "no workbook")
    book = file.stream("Workbook")
    sheets, shared, said = [], [], 0
    for code, parts in _records(book):
        if code == PROTECTED:
            raise ValueError("protected workbook")
        if code == BOF and parts[0][:2] != b"\x00\x06":
            raise ValueError("a version before Excel 97")
        if code == SHEET and len(parts[0]) > 8 and parts[0][5] == 0:
            reader = _Parts([parts[0][7:]])
            sheets.append((struct.unpack_from("<I", parts[0])[0], reader.string(parts[0][6])))
        elif code == STRINGS:
            reader = _Parts(parts)
            unique = struct.unpack("<II", reader.take(8))[1]
            while len(shared) < unique and reader.left():
                shared.append(reader.string(struct.unpack("<H", reader.take(2))[0]))
        elif code == EOF:
            break
    out = []
    for at, name in sheets:
        rows: dict[int, dict[int, str]] = {}
        for row, column, text in _cells(book, at, shared):
            said += len(text)
            if said > MOST_TEXT:
                raise ValueError("too much text")
            if text:
                rows.setdefault(row, {})[column] = text
        width = max((max(cells) for cells in rows.values()), default=-1) + 1
        said += 3 * width * len(rows)
        if said > MOST_TEXT:
            raise ValueError("too much text")
        table = pipe_table([[cells.get(c, "") for c in range(width)] for _, cells in sorted(rows.items())])
        if table:
            out.append((f"## {name}\n\n" if len(sheets) > 1 else "") + table)
    return "\n\n".join(out)
