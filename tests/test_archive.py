"""Round trips of tables of pages, and archives that aren't safe."""

import io
import zipfile

import pytest

from weft.sources.archive import read_archive, write_archive

FILES = "path string, content binary"


def test_round_trip_over_several_zips(spark, tmp_path):
    rows = [("wiki/index.md", b"# I")] + [(f"wiki/c {i}/ä{i}.md", bytes([i % 256]) * (i * 37 % 5000)) for i in range(300)] + [("raw/empty", None)]
    folder = f"file://{tmp_path}/out"
    made = write_archive(spark.createDataFrame(rows, FILES).repartition(5), folder).collect()
    assert len(made) == 5 and sum(r.entries for r in made) == len(rows)
    (tmp_path / "out/part-left-over.zip").write_bytes(b"of a failed task")
    got = {r.path: bytes(r.content) for r in read_archive(spark, folder).collect()}
    assert got == {p: c or b"" for p, c in rows}
    with zipfile.ZipFile(tmp_path / "out" / made[0].archive) as z:  # other programs can read it
        assert z.testzip() is None
    one = write_archive(spark.createDataFrame(rows, FILES).coalesce(1), f"{tmp_path}/one").collect()
    assert read_archive(spark, f"{tmp_path}/one/{one[0].archive}").count() == len(rows)


def test_paths_are_checked_before_anything_is_written(spark, tmp_path):
    for bad in ("../x", "/x", "a/../b", "C:/x", "a\\b", "", None, "wiki/index.md"):
        with pytest.raises(ValueError, match="unsafe or repeated"):
            write_archive(spark.createDataFrame([("wiki/index.md", b"x"), (bad, b"y")], FILES), f"{tmp_path}/bad")
    assert not (tmp_path / "bad").exists()
    assert write_archive(spark.createDataFrame([], FILES), f"{tmp_path}/none").count() == 0
    with pytest.raises(ValueError, match="no wiki/index.md"):
        read_archive(spark, f"{tmp_path}/none")
    assert read_archive(spark, f"{tmp_path}/none", index=None).count() == 0


def zipped(tmp_path, name, *entries):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        for path, content, mode in (("wiki/index.md", b"i", 0o644), ("wiki/", b"", 0o755), *entries):
            info = zipfile.ZipInfo(path)
            info.external_attr = (mode if mode > 0o7777 else 0o100000 | mode) << 16
            z.writestr(info, content, zipfile.ZIP_DEFLATED)
    (tmp_path / name).write_bytes(held.getvalue())
    return f"{tmp_path}/{name}"


def test_unsafe_archives_are_refused(spark, tmp_path):
    assert [r.path for r in read_archive(spark, zipped(tmp_path, "good.zip", ("a/b.md", b"x", 0o644))).orderBy("path").collect()] == ["a/b.md", "wiki/index.md"]
    cases = [(("../up", b"x", 0o644), {}, "outside"), (("/abs", b"x", 0o644), {}, "outside"), (("link", b"/etc/passwd", 0o120777), {}, "links"), (("big", b"0" * 100_000, 0o644), {"most_bytes": 50_000}, "bytes"), (("more", b"", 0o644), {"most_entries": 1}, "entries")]
    for n, (entry, bounds, why) in enumerate(cases):
        with pytest.raises(ValueError, match=why):
            read_archive(spark, zipped(tmp_path, f"{n}.zip", entry), **bounds)
    path = zipped(tmp_path, "lie.zip", ("bomb", b"0" * 100_000, 0o644))
    data = bytearray((tmp_path / "lie.zip").read_bytes())
    at = data.rfind(b"bomb") - 46  # the central directory says ten bytes
    data[at + 24 : at + 28] = (10).to_bytes(4, "little")
    (tmp_path / "lie.zip").write_bytes(bytes(data))
    with pytest.raises(Exception, match="isn't as long|CRC|EOF"):
        read_archive(spark, path).collect()
