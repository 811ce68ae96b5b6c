"""Queues as state: a fake clock (the commands' own times, which the watermark follows), restarts from the checkpoint, and slots."""

import json
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from weft.streaming import queues

START = datetime(2024, 3, 1)


class Stream:
    """A folder of commands and a query over it that is stopped and started again from its checkpoint for every batch."""

    def __init__(self, spark, folder, rules, clock="EventTime"):
        self.spark, self.rules, self.clock, self.seq, self.rows = spark, rules, clock, 0, []
        self.source, self.checkpoint, self.out = (f"{folder}/{x}" for x in ("in", "checkpoint", "out"))
        (folder / "in").mkdir()

    def send(self, *commands, project="p"):
        with open(f"{self.source}/{self.seq:05}.json", "w") as f:
            for minutes, action, *rest in commands:
                path, more = (rest + [None])[0], (rest + [None, {}])[1] or {}
                self.seq += 1
                at = (START + timedelta(minutes=minutes)).strftime("%Y-%m-%dT%H:%M:%S.%f")
                row = {"project": project, "at": at, "seq": self.seq, "action": action, "path": path} | more
                self.rows.append(row)
                f.write(json.dumps(row) + "\n")
            self.seq += 1
        return self.run()

    def run(self, wait=0.0):
        stream = self.spark.readStream.schema(queues.COMMANDS).json(self.source)
        live = queues.live(stream, self.rules, self.clock)
        trigger = {"availableNow": True} if self.clock == "EventTime" else {"processingTime": "300 milliseconds"}
        query = live.writeStream.format("parquet").option("path", self.out).option("checkpointLocation", self.checkpoint).outputMode("append").trigger(**trigger).start()
        if self.clock == "EventTime":
            query.awaitTermination()
        else:
            time.sleep(wait)
            query.stop()
        return [(r.what, r.path, r.attempt) for r in self.transitions().orderBy("at", F.monotonically_increasing_id()).collect()]

    def transitions(self):
        return self.spark.read.schema(queues.TRANSITIONS).parquet(self.out)

    def count(self, what):
        return self.transitions().where(F.col("what") == what).count()


OK, LIMIT, BAD = {"ok": True, "files": 2}, {"ok": False, "error": "429 Too Many Requests"}, {"ok": False, "error": "broken"}


@pytest.fixture(autouse=True)
def few_partitions(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", old)


def test_a_pause_after_a_usage_limit_ends_by_its_timer_across_restarts(spark, tmp_path):
    s = Stream(spark, tmp_path, queues.INGEST)
    s.send((0, "add", "a"), (0, "add", "b"))
    assert s.count("started") == 1
    s.send((1, "done", "a", LIMIT))
    assert s.count("paused") == 1 and s.count("started") == 1
    s.send((15.9, "add", "d"), project="q")  # the clock moves on by another project's command, not far enough
    assert s.count("resumed") == 0
    s.send((16.1, "add", "e"), project="q")
    assert s.count("resumed") == 1
    resumed = s.transitions().where("what = 'resumed'").first()
    assert resumed.at == START + timedelta(minutes=16)  # a pause of 15 minutes to the millisecond
    assert s.transitions().where("project = 'p' and what = 'started'").count() == 2


def test_three_tries_and_one_task_at_a_time(spark, tmp_path):
    s = Stream(spark, tmp_path, queues.INGEST)
    s.send((0, "add", "a"), (0, "add", "b"), (0, "add", "b"), (1, "done", None, BAD))
    s.send((2, "done", None, BAD), (3, "done", None, {"ok": True, "files": 0}))
    got = s.transitions()
    assert [r.attempt for r in got.where("path = 'a' and what = 'started'").orderBy("at").collect()] == [1, 2, 3]
    assert got.where("path = 'a' and what = 'failed'").first().error == queues.NO_OUTPUT
    assert got.where("path = 'b' and what = 'started'").count() == 1
    s.send((4, "done", "b", OK), (5, "add", "a"))  # asked for again: all tries anew
    assert s.count("drained") == 1 and s.transitions().where("path = 'a' and what = 'started'").orderBy(F.desc("at")).first().attempt == 1


def test_a_restored_backlog_waits(spark, tmp_path):
    s = Stream(spark, tmp_path, queues.INGEST)
    s.send((0, "add", "a"), (0, "add", "b"))
    s.send((1, "restart"), (2, "done", "a", OK))  # an answer to the earlier run
    assert s.count("started") == 1 and s.count("done") == 0
    s.send((3, "add", "b"))
    assert [r.path for r in s.transitions().where("what = 'started'").orderBy("at").collect()] == ["a", "b"]
    s.send((4, "done", "b", OK), (5, "resume"))
    assert [r.path for r in s.transitions().where("what = 'started'").orderBy("at").collect()] == ["a", "b", "a"]


def test_never_more_than_three_in_work_over_any_batch_border(spark, tmp_path):
    s = Stream(spark, tmp_path, queues.RESEARCH)
    work = [f"t{i}" for i in range(8)]
    s.send(*[(0, "add", w) for w in work[:2]])
    s.send(*[(1, "add", w) for w in work[2:]])
    for minute in (2, 4, 6, 8):
        s.send((minute, "done", None, OK), (minute + 1, "done", None, BAD))
        steps = s.transitions().orderBy("at", F.when(F.col("what") == "started", 1).otherwise(0)).collect()
        running = 0
        for r in steps:
            running += {"started": 1, "done": -1, "failed": -1}.get(r.what, 0)
            assert 0 <= running <= 3
    assert s.count("started") == 8 and s.count("done") + s.count("failed") == 8 and s.count("again") == 0


def test_the_stream_ends_in_the_state_of_the_fold(spark, tmp_path):
    s = Stream(spark, tmp_path, queues.INGEST)
    s.send((0, "add", "a"), (0, "add", "b"), (1, "done", "a", BAD))
    s.send((2, "done", "a", LIMIT), (3, "add", "c"))
    s.send((20, "done", "a", OK), (21, "cancel", "c"))
    rows = [tuple(r.get(k) for k in ("project", "at", "seq", "action", "path")) + (None, r.get("ok"), r.get("files"), r.get("error")) for r in s.rows]
    table = spark.createDataFrame([(p, datetime.fromisoformat(t), *r) for p, t, *r in rows], queues.COMMANDS)
    left = queues.fold(table).collect()
    assert [(r.path, r.status, r.retries, r.held) for r in left] == [("b", "processing", 0, False)]
    got = {w: s.count(w) for w in ("started", "done", "failed", "drained")}
    assert got == {w: left[0][w] for w in got} and left[0].most_running == 1


def test_merges_name_groups_in_any_order(spark):
    rows = [("p", START, i, a, path, None, ok, n, None) for i, (a, path, ok, n) in enumerate([("add", "B,a", None, None), ("add", "A,b", None, None), ("add", "c,d", None, None), ("add", "D,c", None, None), ("done", "b,A", True, 1)])]
    left = queues.fold(spark.createDataFrame(rows, queues.COMMANDS), queues.MERGE).collect()
    assert [(r.path, r.status, r.started, r.done) for r in left] == [("c,d", "processing", 2, 1)]


def test_timers_of_the_machines_time(spark, tmp_path):
    s = Stream(spark, tmp_path, queues.Rules(pause_ms=1500), "ProcessingTime")
    with open(f"{s.source}/0.json", "w") as f:
        for i, (a, more) in enumerate((("add", {}), ("done", LIMIT))):
            f.write(json.dumps({"project": "p", "at": "2024-01-01T00:00:00", "seq": i, "action": a, "path": "a"} | more) + "\n")
    s.run(wait=12)
    assert s.count("paused") == 1
    if s.count("resumed") == 0:
        s.run(wait=10)
    assert s.count("resumed") == 1 and s.count("started") == 2


def test_odd_commands(spark):
    rows = [(None, START, 1, "add", "a", None, None, None, None), ("p", None, 2, "add", "a", None, None, None, None), ("p", START, 3, "add", None, None, None, None, None), ("p", START, 4, None, "a", None, None, None, None), ("p", START, 5, "done", "a", None, None, None, None)]
    table = spark.createDataFrame(rows, queues.COMMANDS)
    assert [(r.project, r.place, r.started) for r in queues.fold(table).collect()] == [("p", None, 0)]
    assert queues.fold(table.limit(0)).count() == 0
