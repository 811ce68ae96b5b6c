import io
import struct
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from weft.sources import readers as R
from weft.sources import sinks as K
from weft.sources.pdf import pdf

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'




def zipped(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in files.items():
            z.writestr(name, data)
    return out.getvalue()


DOCX = zipped({"word/document.xml": f"""<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p>
<w:p><w:r><w:rPr><w:b/></w:rPr><w:t>bold</w:t></w:r><w:r><w:t xml:space="preserve"> plain</w:t></w:r></w:p><w:p><w:pPr><w:numPr/></w:pPr><w:r><w:t>item</w:t></w:r></w:p>
<w:tbl><w:tr><w:tc><w:p><w:r><w:t>a|b</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>c</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>"""})
A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
PPTX = zipped({f"ppt/slides/slide{n}.xml": f"<x {A}><a:p><a:t>Title {n}</a:t></a:p><a:p><a:t>point</a:t></a:p></x>" for n in (10, 2)})
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
XLSX = zipped({"xl/workbook.xml": f'<workbook {S}><sheets><sheet name="One"/></sheets></workbook>', "xl/sharedStrings.xml": f"<sst {S}><si><t>name</t></si></sst>", "xl/worksheets/sheet1.xml": f'<worksheet {S}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>3.0</v></c></row><row><c r="A2"><v>2.456</v></c></row></sheetData></worksheet>'})
ODT = zipped({"content.xml": '<o xmlns:t="u:t"><t:p>one &amp; two</t:p><t:p> </t:p><t:h>three</t:h></o>'})
EPUB = zipped({"META-INF/container.xml": '<c xmlns="u:c"><rootfile full-path="b/x.opf"/></c>', "b/x.opf": '<package xmlns="u:p" xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>Book</dc:title><dc:creator>Me</dc:creator></metadata><manifest><item id="i" href="c.html"/></manifest><spine><itemref idref="i"/></spine></package>', "b/c.html": "<h1>Ch</h1><p>text</p>"})
ORG = b"#+TITLE: T\n* TODO Head :tag:\n#+BEGIN_SRC py\n* x\n#+END_SRC\n| a | b |\n|---+---|\n[[http://u][l]] *b* /i/ =c="
PNG = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 200, 150) + b"rest"


def test_formats(spark):
    rows = [("a.docx", DOCX), ("b.pptx", PPTX), ("c.xlsx", XLSX), ("d.odt", ODT), ("e.epub", EPUB), ("f.org", ORG), ("g.txt", "é".encode()), ("h.png", PNG), ("i.pdf", b"x"), ("j.docx", b"broken"), ("k.html", b"<p>hi</p>"), ("l.md", None)]
    got = {r.path: (r.text, r.error) for r in R.extract(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert got["a.docx"][0] == "## Head\n\n**bold** plain\n\n- item\n\n| a\\|b | c |\n| --- | --- |"
    assert got["b.pptx"][0] == "## Slide 2\n**Title 2**\n- point\n\n## Slide 10\n**Title 10**\n- point"
    assert got["c.xlsx"][0] == "| name |  | 3 |\n| --- | --- | --- |\n| 2.46 |  |  |"
    assert got["d.odt"][0] == "one & two\nthree" and got["e.epub"][0] == "# Book\n\n**Author:** Me\n\n# Ch\n\ntext"
    assert got["f.org"][0] == "# T\n# Head\n```py\n* x\n```\n| a | b |\n| --- | --- |\n[l](http://u) **b** *i* `c`"
    assert got["g.txt"] == ("é", None) and got["h.png"][0] == "[png file: h.png]" and got["i.pdf"] == (None, "ValueError: not a PDF file") and got["j.docx"][1].startswith("BadZipFile")
    assert got["k.html"][0] == "hi" and got["l.md"] == ("", None)


def pdf_file(*objects, trailer=b"trailer << /Root 1 0 R >>"):
    body = b"".join(b"%d 0 obj\n%s\nendobj\n" % (n, o) for n, o in enumerate(objects, 1))
    return b"%PDF-1.5\n" + body + trailer


def stream(data, head=b""):
    return b"<< /Length %d %s >>\nstream\n%s\nendstream" % (len(data), head, data)


def test_pdf():
    cmap = b"1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfchar <0001> <00480069> endbfchar 2 beginbfrange <0002> <0004> <0061> <0005> <0006> [<4E2D> <6587>] endbfrange"
    first = rb"BT /F1 12 Tf 72 700 Td (Left \(one\)\054) Tj 0 -14 Td [(ker) -20 (ned) -300 (gap)] TJ T* (caf\351) ' ET BI /W 1 ID (x) Tj EI /X1 Do"
    second = b"BT /F2 10 Tf 1 0 0 1 72 700 Tm <000100020004> Tj 1 0 0 1 172 700 Tm <00050006> Tj ET"
    catalog = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R 4 0 R 2 0 R] /Resources << /Font << /F1 5 0 R /F2 6 0 R >> /XObject << /X1 10 0 R >> >> >>"]
    pages = [b"<< /Type /Page /Parent 2 0 R /Contents [7 0 R] >>", b"<< /Type /Page /Contents 8 0 R >>"]
    fonts = [b"<< /Type /Font /Subtype /Type1 /Encoding << /Differences [44 /semicolon] >> >>", b"<< /Type /Font /Subtype /Type0 /ToUnicode 9 0 R >>"]
    form = stream(b"BT /F1 9 Tf (in a form) Tj /X1 Do ET", b"/Subtype /Form")
    parts = [*catalog, *pages, *fonts, stream(zlib.compress(first), b"/Filter /FlateDecode"), stream(second), stream(cmap), form]
    whole = "Left (one);\nkerned gap\ncaf\u00e9\nin a form\n\nHiac \u4e2d\u6587"
    assert pdf(pdf_file(*parts)) == whole
    # an object stream, and no trailer
    inner = b"1 0 2 %d " % (len(parts[0]) + 1) + parts[0] + b" " + parts[1]
    packed = stream(zlib.compress(inner), b"/Type /ObjStm /N 2 /First %d /Filter [/FlateDecode]" % inner.index(b"<<"))
    assert pdf(pdf_file(b"null", b"null", *parts[2:], packed, trailer=b"")) == whole
    # the last version of an object holds
    assert pdf(pdf_file(*parts) + b"\n8 0 obj " + stream(b"BT (new) Tj ET") + b" endobj").endswith("\n\nnew")
    assert pdf(b"%PDF-1.4") == ""
    for broken, error in ((pdf_file(*parts, trailer=b"trailer << /Encrypt 3 0 R >>"), "encrypted"), (b"", "not a PDF"), (pdf_file(*parts[:6], stream(b"x", b"/Filter /LZWDecode"), *parts[7:]), "LZWDecode"), (b"%PDF-1.4 1 0 obj " + b"[" * 500, "deeply")):
        with pytest.raises(ValueError, match=error):
            pdf(broken)


def test_images(spark):
    small = PNG[:16] + struct.pack(">II", 20, 150) + b"rest"
    rows = [("a.docx", zipped({"m/1.png": PNG, "m/2.png": small})), ("b.docx", b"no"), ("c.docx", zipped({"m/x.txt": "t"}))]
    got = R.images(spark.createDataFrame(rows, "path string, content binary")).collect()
    assert [(r.path, r["index"], r.mime, r.width, r.height) for r in got] == [("a.docx", 0, "image/png", 200, 150)]


def test_wiki_and_listing(spark, tmp_path):
    for name, text in {"wiki/b/x-y.md": "# Head\n[[Other]]", "wiki/a.md": "---\ntitle: T\ntype: Concept\nsources: [s.pdf]\n---\n", "wiki/.hidden.md": "x", "wiki/z.txt": "x"}.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    got = {r.path: (r.title, r.type, r.links, r.sources) for r in R.wiki_pages(spark, str(tmp_path / "wiki")).collect()}
    assert R.wiki_pages(spark, str(tmp_path / "wiki"), cap=1).count() == 1
    assert got == {"a.md": ("T", "concept", [], ["s.pdf"]), "b/x-y.md": ("Head", "other", ["Other"], [])}
    assert [(r.path, r.is_dir) for r in R.listing(spark, str(tmp_path / "wiki")).collect()] == [("b", True), ("a.md", False), ("z.txt", False), ("b/x-y.md", False)]
    with pytest.raises(ValueError):
        R.listing(spark, str(tmp_path / "wiki"), max_files=2)


def test_addresses(spark):
    text = "http://a.com/x#f\nftp://b\nhttps://u:p@c.com\nhttp://a.com/x\n\nhttps://127.0.0.1/\nhttp://192.168.1.1\nHTTPS://d.com\n"
    df = spark.createDataFrame([(text,)], "text string")
    assert [r.url for r in R.url_batch(df).collect()] == ["http://a.com/x", "HTTPS://d.com"]
    with pytest.raises(ValueError):
        R.url_batch(df, most=1)


def test_caches(spark):
    import datetime as dt

    t = lambda d: dt.datetime(2024, 1, d)
    sources = spark.createDataFrame([("a.txt", b"new", t(2)), ("b.txt", b"b", t(1))], "path string, content binary, mtime timestamp")
    cache = spark.createDataFrame([("a.txt", "old", t(1)), ("b.txt", "cached", t(1))], "path string, text string, mtime timestamp")
    assert {r.path: r.text for r in R.cached_extract(sources, cache).collect()} == {"a.txt": "new", "b.txt": "cached"}
    known = spark.createDataFrame([("a.txt", "x")], "path string, md5 string")
    files = sources.withColumn("size", F.lit(3)).union(spark.createDataFrame([("config/c.json", b"c", t(1), 1), ("big.txt", b"", t(1), 200_000_000)], "path string, content binary, mtime timestamp, size int"))
    assert sorted(r.path for r in R.scheduled_import(files, known).collect()) == ["a.txt", "b.txt"]
    hashed = spark.createDataFrame([("a.txt", b"new")], "path string, content binary").select(F.sha2("content", 256)).first()[0]
    outputs = spark.createDataFrame([("a.txt", hashed, ["w1", "w2"])], "path string, hash string, outputs array<string>")
    for there, want in ((["w1", "w2"], True), (["w1"], False)):
        existing = spark.createDataFrame([(x,) for x in there], "path string")
        assert {r.path: r.hit for r in R.cache_probe(sources, outputs, existing).collect()} == {"a.txt": want, "b.txt": False}


def test_vector_store(spark, tmp_path):
    store = K.VectorStore(spark, f"file://{tmp_path}/v")
    schema = "page_id string, chunk_index int, chunk_text string, heading_path string, vector array<float>"
    chunk = lambda p, i, *v: (p, i, "t", "", list(v))
    made = lambda *rows: spark.createDataFrame(list(rows), schema)
    assert store.read().count() == 0 and store.counts().first().chunks == 0
    store.upsert(made(chunk("a", 0, 1.0, 2.0), chunk("a", 1, 1.0, 2.0), chunk("b", 0, 1.0, 2.0)))
    assert store.upsert(made()) == 0 and store.read().count() == 3
    store.upsert(made(chunk("a", 0, 3.0, 2.0)))
    assert sorted((r.chunk_id, r.vector[0]) for r in store.read().collect()) == [("a#0", 3.0), ("b#0", 1.0)]
    for bad in (made(chunk("c", 0, 1.0)), made(chunk("c", 0)), made(chunk("c", 0, 1.0, 2.0), chunk("c", 1, 1.0))):
        with pytest.raises(ValueError):
            store.upsert(bad)
    store.compact()
    assert len(store.table.versions()) == 1 and store.read().count() == 2 and len(store.read().inputFiles()) == 1 and store.table.size() > 0
    part = spark.createDataFrame([("a", 0, "t", "", [9.0, 9.0], None), ("c", 0, "t", "", None, "failed")], schema + ", error string")
    assert store.rebuild(part) == {"chunks": 1, "failed": 1} and store.read().count() == 2
    assert store.rebuild(part.where("page_id = 'a'").withColumn("vector", F.array(F.lit(1.0)).cast("array<float>"))) == {"chunks": 1, "failed": 0}
    assert store.read().count() == 1
    store.delete(["a", "none"])
    store.delete([])
    assert store.read().count() == 0
    store.clear()
    store.clear()


def test_clips(spark):
    clips = spark.createDataFrame([(0, "A Page!", "u", "m"), (1, "a page", "v", "n"), (2, "New", "w", "o")], "pos int, title string, url string, markdown string")
    taken = spark.createDataFrame([("raw/sources/a-page-2024-01-02.md",)], "path string")
    got = {r.path: r.content for r in K.clip_pages(clips, taken, "2024-01-02").collect()}
    assert sorted(got) == ["raw/sources/a-page-2024-01-02-2.md", "raw/sources/a-page-2024-01-02-3.md", "raw/sources/new-2024-01-02.md"]
    assert 'url: "w"' in got["raw/sources/new-2024-01-02.md"]
