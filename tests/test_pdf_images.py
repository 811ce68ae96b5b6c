"""Images of generated PDF files: which ones are taken, and their pixels."""

import hashlib
import struct
import zlib

import numpy as np
import pytest

from weft.sources import pdf_images as P
from weft.sources import readers as R
from weft.sources.pdf import File

RNG = np.random.default_rng(3)


def stream(data, head=b""):
    return b"<< /Length %d %s >>\nstream\n%s\nendstream" % (len(data), head, data)


def image(data, width=120, height=110, space=b"/DeviceGray", bits=8, rest=b"/Filter /FlateDecode", packed=True):
    return stream(zlib.compress(data) if packed else data, b"/Type /XObject /Subtype /Image /Width %d /Height %d /ColorSpace %s /BitsPerComponent %d %s" % (width, height, space, bits, rest))


def file(content, *objects, box=b"[0 0 600 800]"):
    """A page whose names /I5, /I6, ... are the objects given."""
    names = b" ".join(b"/I%d %d 0 R" % (n, n) for n in range(5, 5 + len(objects)))
    parts = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Kids [3 0 R] /MediaBox %s >>" % box, b"<< /Type /Page /Contents 4 0 R /Resources << /XObject << %s >> >> >>" % names, stream(content), *objects]
    return b"%PDF-1.5\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (n, o) for n, o in enumerate(parts, 1)) + b"trailer << /Root 1 0 R >>"


def unpng(data):
    """Width, height and pixels of a PNG file without filters."""
    assert data[:8] == b"\x89PNG\r\n\x1a\n"
    at, body, width, height, colour = 8, b"", 0, 0, 0
    while at < len(data):
        size, name = struct.unpack_from(">I4s", data, at)
        part = data[at + 8 : at + 8 + size]
        assert zlib.crc32(name + part) == struct.unpack_from(">I", data, at + 8 + size)[0]
        if name == b"IHDR":
            width, height, _, colour = struct.unpack_from(">IIBB", part)
        body += part if name == b"IDAT" else b""
        at += 12 + size
    rows = np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, -1)
    assert not rows[:, 0].any()
    return rows[:, 1:].reshape((height, width, 3) if colour == 2 else (height, width))


GREY = RNG.integers(0, 256, (110, 120), np.uint8)


def test_scans():
    """A page-sized image goes where the page has text of its own, whatever the way its size is told."""
    text = b"BT (%s) Tj ET " % (b"x " * 80)
    short = b"BT (%s) Tj ET " % (b"x " * 79)
    one = image(GREY.tobytes())
    taken = lambda content, **k: [(i.page, i.width, i.height) for i in P.pdf_images(file(content, one, **k))]
    full, part = b"q 600 0 0 800 0 0 cm /I5 Do Q ", b"q 539 0 0 800 0 0 cm /I5 Do Q "
    assert taken(text + full) == [] and taken(text + part) == [(1, 120, 110)]
    assert taken(short + full) == [(1, 120, 110)] and taken(full) == [(1, 120, 110)]
    assert taken(text + b"q 540 0 0 720 0 0 cm /I5 Do Q") == []  # nine tenths both ways
    assert taken(text + b"q 2 0 0 2 0 0 cm q 300 0 0 400 0 0 cm /I5 Do Q /I5 Do Q ") == [(1, 120, 110)]  # matrices multiply, Q takes them back
    assert taken(text + b"q 0 800 -600 0 600 0 cm /I5 Do Q") == []  # turned by a right angle
    assert taken(text + full, box=b"[0 0 1000 800]") == [(1, 120, 110)]
    assert taken(text + full + part) == [(1, 120, 110)]
    form = stream(b"300 0 0 400 0 0 cm /I5 Do", b"/Subtype /Form /Matrix [2 0 0 2 0 0]")
    assert list(P.pdf_images(file(text + b"/I6 Do", one, form))) == [] and len(list(P.pdf_images(file(text + b".5 0 0 .5 0 0 cm /I6 Do", one, form)))) == 1
    loop = stream(b"/I6 Do /I5 Do", b"/Subtype /Form")
    assert len(list(P.pdf_images(file(b"/I6 Do", one, loop)))) == 1


def test_bounds():
    small, wide = image(bytes(99 * 120), 99, 120), image(bytes(100 * 100), 100, 100)
    assert [i.width for i in P.pdf_images(file(b"/I5 Do /I6 Do", small, wide))] == [100]
    assert len(list(P.pdf_images(file(b"/I5 Do " * 30, wide), most=7))) == 7
    unread = image(b"no", rest=b"/Filter /LZWDecode", packed=False)
    huge = image(b"", 100_000, 100_000)
    assert [i.page for i in P.pdf_images(file(b"/I5 Do /I6 Do /I7 Do", unread, huge, wide))] == [1]
    with pytest.raises(ValueError, match="not a PDF"):
        list(P.pdf_images(b"x"))


def pixels(obj, *others):
    made = file(b"", obj, *others)
    loaded = File(made)
    return P.content(loaded, P.Reference(5))


def test_pixels():
    colour = RNG.integers(0, 256, (110, 120, 3), np.uint8)
    assert (unpng(pixels(image(GREY.tobytes()))[1]) == GREY).all()
    assert (unpng(pixels(image(GREY.tobytes(), rest=b"/Filter /FlateDecode /Decode [1 0]"))[1]) == 255 - GREY).all()
    assert (unpng(pixels(image(colour.tobytes(), space=b"/DeviceRGB"))[1]) == colour).all()
    assert (unpng(pixels(image(colour.tobytes(), space=b"[/ICCBased 6 0 R]"), b"<< /N 3 >>")[1]) == colour).all()
    assert (unpng(pixels(image(colour.tobytes().hex().encode() + b">", space=b"/DeviceRGB", rest=b"/Filter [/AHx]", packed=False))[1]) == colour).all()
    assert (unpng(pixels(image((GREY.astype(np.uint16) * 256).astype(">u2").tobytes(), bits=16))[1]) == GREY).all()
    bits = RNG.integers(0, 2, (110, 117), np.uint8)
    assert (unpng(pixels(image(np.packbits(bits, axis=1).tobytes(), 117, bits=1))[1]) == bits * 255).all()
    table = RNG.integers(0, 256, (16, 3), np.uint8)
    index = RNG.integers(0, 16, (110, 120), np.uint8)
    named = image((index[:, ::2] << 4 | index[:, 1::2]).tobytes(), bits=4, space=b"[/Indexed /DeviceRGB 15 <%s>]" % table.tobytes().hex().encode())
    assert (unpng(pixels(named)[1]) == table[index]).all()
    ink = np.zeros((110, 120, 4), np.uint8)
    ink[..., 1] = 255
    assert (unpng(pixels(image(ink.tobytes(), space=b"/DeviceCMYK"))[1]) == [255, 0, 255]).all()
    assert pixels(image(b"\xff\xd8jpeg", rest=b"/Filter /DCTDecode", packed=False)) == ("image/jpeg", b"\xff\xd8jpeg")
    assert pixels(image(b"jp2", rest=b"/Filter [/FlateDecode /JPXDecode]")) == ("image/jp2", b"jp2")


def filtered(rows, how, step):
    """Rows with a PNG filter each, byte by byte as the format says."""
    out, above = b"", [0] * len(rows[0])
    for k, row in enumerate(rows):
        kind = how[k % len(how)]
        line = []
        for i, x in enumerate(row):
            a, b, c = (row[i - step] if i >= step else 0), above[i], (above[i - step] if i >= step else 0)
            p = a + b - c
            paeth = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            line.append((x - (0, a, b, (a + b) // 2, paeth)[kind]) & 255)
        out, above = out + bytes([kind, *line]), row
    return out


def test_predictors():
    colour = RNG.integers(0, 256, (110, 120, 3), np.uint8)
    rows = [r.tolist() for r in colour.reshape(110, -1)]
    rest = b"/Filter /FlateDecode /DecodeParms << /Predictor %d /Colors 3 /Columns 120 >>"
    assert (unpng(pixels(image(filtered(rows, (0, 1, 2, 3, 4), 3), space=b"/DeviceRGB", rest=rest % 15))[1]) == colour).all()
    steps = np.diff(colour.astype(np.int16), axis=1, prepend=0).astype(np.uint8)
    assert (unpng(pixels(image(steps.tobytes(), space=b"/DeviceRGB", rest=rest % 2))[1]) == colour).all()


def test_rows(spark):
    jpeg = image(b"\xff\xd8jpeg", 300, 200, rest=b"/Filter /DCTDecode", packed=False)
    rows = [("a.pdf", file(b"/I5 Do /I6 Do", image(GREY.tobytes()), jpeg)), ("b.pdf", b"%PDF-1.4 trailer << /Encrypt 1 0 R >>"), ("c.pdf", file(b""))]
    got = R.images(spark.createDataFrame(rows, "path string, content binary")).collect()
    assert [(r.path, r["index"], r.mime, r.width, r.height, r.page) for r in got] == [("a.pdf", 0, "image/png", 120, 110, 1), ("a.pdf", 1, "image/jpeg", 300, 200, 1)]
    assert got[0].sha256 == hashlib.sha256(P.png(GREY)).hexdigest() and got[1].sha256 == hashlib.sha256(b"\xff\xd8jpeg").hexdigest()
