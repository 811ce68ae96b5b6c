"""Images of PDF pages: image objects, their size on the page by the matrices in force, and their content as PNG or as it is stored.

A page-sized image is passed over where the page has text of its own (a scan with a text layer); on other pages it's the page's only
content and stays. JPEG and JPEG 2000 stay as they're stored, fax and JBIG2 data too, under a type that says so; plain samples become PNG.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from typing import Any, NamedTuple

import numpy as np

from weft.sources.pdf import MOST_DEPTH, MOST_FORMS, File, Name, Reference, Word, inline_end, page_text, value

Matrix = tuple[float, float, float, float, float, float]
ONE: Matrix = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
MOST_PIXELS = 64 * 1024 * 1024
#: Filters whose data is an image by itself, and its type.
STORED = {"DCTDecode": "image/jpeg", "DCT": "image/jpeg", "JPXDecode": "image/jp2", "CCITTFaxDecode": "image/g3fax", "CCF": "image/g3fax", "JBIG2Decode": "image/x-jbig2"}
LETTER = [0.0, 0.0, 612.0, 792.0]


class Image(NamedTuple):
    page: int
    mime: str
    width: int
    height: int
    content: bytes


def _times(a: Matrix, b: Matrix) -> Matrix:
    return (a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5])


def _matrix(items: Any) -> Matrix:
    return tuple(items) if isinstance(items, list) and len(items) == 6 and all(isinstance(x, float) for x in items) else ONE


def placed(file: File, data: bytes, resources: dict, matrix: Matrix = ONE, inside: tuple[int, ...] = (), forms: list[int] | None = None) -> Iterator[tuple[Reference, float, float]]:
    """(image, width, height of the box around it on the page) of the images that a content stream shows, those of its forms too."""
    at, held, kept, forms = 0, [], [], [0] if forms is None else forms
    while True:
        item, at = value(data, at)
        if not isinstance(item, Word):
            held.append(item)
            continue
        if item == b"":
            return
        if item == b"ID":
            at = inline_end(data, at)
        elif item == b"q":
            kept.append(matrix)
        elif item == b"Q" and kept:
            matrix = kept.pop()
        elif item == b"cm":
            matrix = _times(_matrix(held[-6:]), matrix)
        elif item == b"Do" and held and isinstance(held[-1], Name):
            ref = (file.get(resources.get("XObject")) or {}).get(held[-1])
            found = file.get(ref)
            if isinstance(ref, Reference) and isinstance(found, dict):
                if found.get("Subtype") == "Image":
                    yield ref, abs(matrix[0]) + abs(matrix[2]), abs(matrix[1]) + abs(matrix[3])
                elif found.get("Subtype") == "Form" and int(ref) not in inside and len(inside) < MOST_DEPTH:
                    forms[0] += 1
                    if forms[0] > MOST_FORMS:
                        raise ValueError("too many forms on a page")
                    yield from placed(file, file.stream(int(ref)), file.get(found.get("Resources")) or resources, _times(_matrix(file.get(found.get("Matrix"))), matrix), (*inside, int(ref)), forms)
        held = []


def _unpredict(data: bytes, parms: dict, file: File) -> bytes:
    """Samples behind a predictor: PNG's rows with a filter each, or differences of neighbours."""
    number = lambda key, default: int(x) if isinstance(x := file.get(parms.get(key)), float) else default
    kind, colors, bits, columns = number("Predictor", 1), number("Colors", 1), number("BitsPerComponent", 8), number("Columns", 1)
    step, size = max(1, colors * bits // 8), (colors * bits * columns + 7) // 8
    if kind < 2:
        return data
    if kind == 2:
        if bits != 8:
            raise ValueError("differences of other than 8 bits")
        rows = np.frombuffer(data[: len(data) // size * size], np.uint8).reshape(-1, columns, colors)
        return np.add.accumulate(rows, axis=1, dtype=np.uint8).tobytes()
    out, above = bytearray(), bytearray(size)
    for at in range(0, len(data), size + 1):
        row, how = bytearray(data[at + 1 : at + 1 + size].ljust(size, b"\0")), data[at]
        if how == 2:
            row = bytearray((np.frombuffer(row, np.uint8) + np.frombuffer(above, np.uint8)).tobytes())
        elif how == 1:
            for c in range(step):
                row[c::step] = np.add.accumulate(np.frombuffer(row[c::step], np.uint8), dtype=np.uint8).tobytes()
        elif how in (3, 4):
            for i in range(size):
                left, up, corner = row[i - step] if i >= step else 0, above[i], above[i - step] if i >= step else 0
                if how == 3:
                    guess = (left + up) // 2
                else:
                    p = left + up - corner
                    guess = min((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner))[2]
                row[i] = (row[i] + guess) & 255
        out += row
        above = row
    return bytes(out)


def png(pixels: np.ndarray) -> bytes:
    """Rows of grey (height, width) or colour (height, width, 3) bytes as a PNG file, the same bytes for the same pixels."""
    height, width = pixels.shape[:2]
    rows = np.concatenate([np.zeros((height, 1), np.uint8), pixels.reshape(height, -1)], axis=1).tobytes()
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2 if pixels.ndim == 3 else 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def _space(file: File, space: Any) -> tuple[int, np.ndarray | None]:
    """Components of a colour space, and the colours that an indexed one names."""
    space = file.get(space)
    name = file.get(space[0]) if isinstance(space, list) and space else space
    if name in ("DeviceRGB", "CalRGB", "RGB", "Lab"):
        return 3, None
    if name in ("DeviceCMYK", "CMYK"):
        return 4, None
    if name == "ICCBased" and len(space) > 1:
        n = file.get((file.get(space[1]) or {}).get("N"))
        return int(n) if n in (1.0, 3.0, 4.0) else 3, None
    if name in ("Indexed", "I") and len(space) > 3:
        base, table = _space(file, space[1])[0], file.get(space[3])
        raw = table if isinstance(table, bytes) else file.stream(int(space[3])) if isinstance(space[3], Reference) else b""
        return 1, _colours(np.frombuffer(raw[: len(raw) // base * base], np.uint8).reshape(-1, base))
    if name in ("Separation", "DeviceN") and len(space) > 1:
        names = file.get(space[1])
        return len(names) if isinstance(names, list) else 1, None
    return 1, None


def _colours(samples: np.ndarray) -> np.ndarray:
    """Grey or RGB bytes of samples of one, three or four components; of others the first as ink on white."""
    n = samples.shape[-1]
    if n == 4:
        paper = 255 - samples.astype(np.uint16)
        return (paper[..., :3] * paper[..., 3:] // 255).astype(np.uint8)
    return samples if n == 3 else samples[..., 0] if n == 1 else 255 - samples[..., 0]


def content(file: File, ref: Reference) -> tuple[str, bytes]:
    """Type and bytes of an image object."""
    head = file.get(ref)
    filters, parms = file.get(head.get("Filter")), file.get(head.get("DecodeParms", head.get("DP")))
    filters = [file.get(f) for f in (filters if isinstance(filters, list) else [filters] * (filters is not None))]
    parms = [file.get(p) for p in (parms if isinstance(parms, list) else [parms])]
    if filters and filters[-1] in STORED:
        return STORED[filters[-1]], file.decoded(file.streams.get(int(ref), b""), filters[:-1])
    width, height = (int(file.get(head[k])) for k in ("Width", "Height"))
    mask = file.get(head.get("ImageMask")) == b"true"
    bits = 1 if mask else int(file.get(head.get("BitsPerComponent", 8.0)))
    count, table = (1, None) if mask else _space(file, head.get("ColorSpace"))
    if width * height * count > MOST_PIXELS or bits not in (1, 2, 4, 8, 16):
        raise ValueError("an image is too large" if bits in (1, 2, 4, 8, 16) else f"{bits} bits a sample")
    data = file.decoded(file.streams.get(int(ref), b""), filters)
    last = parms[-1] if parms and isinstance(parms[-1], dict) else None
    data = _unpredict(data, last, file) if last else data
    size = (width * count * bits + 7) // 8
    rows = np.frombuffer(data[: size * height].ljust(size * height, b"\0"), np.uint8).reshape(height, size)
    if bits == 16:
        rows = rows[:, ::2]
    elif bits < 8:
        each = 8 // bits
        rows = (rows[:, :, None] >> (np.arange(each - 1, -1, -1, dtype=np.uint8) * bits) & ((1 << bits) - 1)).reshape(height, -1)
    samples = rows[:, : width * count].reshape(height, width, count)
    decode = file.get(head.get("Decode"))
    turned = isinstance(decode, list) and len(decode) >= 2 and isinstance(decode[0], float) and isinstance(decode[1], float) and decode[0] > decode[1]
    if table is not None:
        table = table if len(table) else np.zeros((1, 3), np.uint8)
        return "image/png", png(table[np.minimum(samples[..., 0], len(table) - 1)])
    if bits < 8:
        samples = (samples * (255 // ((1 << bits) - 1))).astype(np.uint8)
    return "image/png", png(np.ascontiguousarray(_colours(255 - samples if turned else samples)))


def _letters(file: File, page: dict) -> int:
    """Characters of a page that aren't spaces; none where its text can't be read, so that its images stay."""
    try:
        return sum(not c.isspace() for c in page_text(file, page))
    except (ValueError, KeyError, TypeError, zlib.error):
        return 0


def pdf_images(data: bytes, least: int = 100, most: int = 500, coverage: float = 0.9, text_chars: int = 80) -> Iterator[Image]:
    """The first ``most`` images of at least ``least`` pixels each way, by page and place in its content. An image that covers
    ``coverage`` of the page's width and height goes where the page holds ``text_chars`` characters that aren't spaces; so do images
    that can't be read."""
    file, count, known = File(data), 0, {}
    for number, page in enumerate(file.pages(), 1):
        box = [float(x) if isinstance(x := file.get(v), float) else 0.0 for v in (file.get(page.get("MediaBox")) or LETTER)]
        wide, high = (abs(box[2] - box[0]), abs(box[3] - box[1])) if len(box) == 4 else (612.0, 792.0)
        body, full = file.contents(page), None
        for ref, width, height in placed(file, body, page["Resources"]):
            head = file.get(ref)
            across, down = (int(x) if isinstance(x := file.get(head.get(k)), float) else 0 for k in ("Width", "Height"))
            if across < least or down < least:
                continue
            if wide > 0 and high > 0 and width >= coverage * wide and height >= coverage * high:
                full = _letters(file, page) >= text_chars if full is None else full
                if full:
                    continue
            if int(ref) not in known:
                try:
                    known[int(ref)] = content(file, ref)
                except (ValueError, KeyError, TypeError, zlib.error):
                    known[int(ref)] = None
            found = known[int(ref)]
            if len(known) > 4:  # an image that is shown again soon isn't read again
                known.pop(next(iter(known)))
            if found:
                yield Image(number, found[0], across, down, found[1])
                count += 1
                if count == most:
                    return
