"""Queries of work queues: commands made from the events of users, folded to each queue's state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.session import table
from weft.streaming import queues


def commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events as commands: views and signups add a source, the others answer, resume or restart."""
    e, v = table(spark, sf_dir, "events"), F.col("value")
    kind = F.col("event_type")
    adds = kind.isin("view", "signup")
    action = F.when(adds, "add").when((kind == "error") & (v < 5), "restart").when((kind == "purchase") & (v < 10), "resume").when((kind == "purchase") & (v < 14), "pause").when((kind == "purchase") & (v < 20), "retry").when((kind == "click") & (v < 3), "cancel").otherwise("done")
    ok = (kind == "purchase") | ((kind == "click") & (v < 90))
    error = F.when((kind == "error") & (v > 60), "HTTP 429: slow down").when(~ok, "timeout")
    path = F.when(action != "done", F.concat(F.lit("raw/sources/s"), F.floor(v).cast("long") % 12))
    files = F.when(ok, F.when(v < 30, 0).otherwise(1)).otherwise(0)
    return e.select(F.col("user_id").cast("string").alias("project"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq"), action.alias("action"), path.alias("path"), F.lit("").alias("folder"), ok.alias("ok"), files.cast("int").alias("files"), error.alias("error"))


def ingest_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One task at a time, three tries, a pause of 15 minutes after a usage limit."""
    return queues.fold(commands(spark, sf_dir), queues.INGEST)


def research_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three tasks at a time, one try, no pause."""
    return queues.fold(commands(spark, sf_dir), queues.RESEARCH)


def merge_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One merge at a time; a group of pages is one task, in whatever order it is named."""
    c = commands(spark, sf_dir)
    n = F.regexp_extract("path", r"(\d+)$", 1).cast("int")
    pair = F.when(F.col("seq") % 2 == 0, F.concat(F.lit("P"), (n % 4).cast("string"), F.lit(",x"))).otherwise(F.concat(F.lit("x,p"), (n % 4).cast("string")))
    return queues.fold(c.withColumn("path", F.when(F.col("path").isNotNull(), pair)), queues.MERGE)


def _struct(task: str, **changed: str) -> str:
    return "{" + ", ".join(f"'{f}': {changed.get(f, f'{task}.{f}')}" for f in ("path", "status", "retries", "held", "error")) + "}"


_FIELDS = ("tasks", "paused", "resume_at", "worked", "started", "done", "failed", "drained", "most")


def _state(**changed: str) -> str:
    return "{" + ", ".join(f"'{f}': {changed.get(f, f's.{f}')}" for f in _FIELDS) + "}"


def _set(place: str, task: str) -> str:
    """The tasks with the one at a place changed to an expression of ``t``."""
    return f"list_transform(s.tasks, lambda t, k: CASE WHEN k = {place} THEN {task} ELSE t END)"


def _first(condition: str) -> str:
    return f"list_position(list_transform(s.tasks, lambda t: {condition}), true)"


def fold_sql(slots: int, tries: int, pause_ms: int | None, path: str = "path", groups: bool = False) -> str:
    """The same rules as one expression of state and step, reduced over each project's steps: run out a pause, dispatch, apply, dispatch."""
    key = "lower(split_part(replace(t.path, 'x,', ''), ',', 1)) = lower(split_part(replace(x.path, 'x,', ''), ',', 1))" if groups else "t.path = x.path"
    any_of = lambda *st: f"t.status IN ({', '.join(repr(s) for s in st)}) AND {key}"
    none = "s"
    pending = "len(list_filter(s.tasks, lambda t: t.status = 'pending'))"
    running = "len(list_filter(s.tasks, lambda t: t.status = 'processing'))"
    ready = _first("t.status = 'pending' AND NOT t.held")
    dispatch = f"""CASE WHEN {running} >= {slots} OR s.paused AND {pending} > 0 THEN {none}
        WHEN {ready} > 0 THEN {_state(tasks=_set(ready, _struct('t', status="'processing'")), paused='false', resume_at='CASE WHEN s.paused THEN NULL ELSE s.resume_at END', started='s.started + 1', most=f'greatest(s.most, {running} + 1)')}
        ELSE {_state(paused='false', resume_at='CASE WHEN s.paused THEN NULL ELSE s.resume_at END', drained=f'CASE WHEN {pending} = 0 AND {running} = 0 AND s.worked THEN s.drained + 1 ELSE s.drained END', worked=f's.worked AND NOT ({pending} = 0 AND {running} = 0)')} END"""
    known, busy, mine = _first(any_of("pending", "failed")), _first(any_of("processing")), _first("t.status = 'processing'")
    failed, either = _first(any_of("failed")), _first(any_of("processing", "pending", "failed"))
    # cancelled: a task in work before a pending one, by place
    fresh = "{'path': x.path, 'status': 'pending', 'retries': 0, 'held': false, 'error': NULL::VARCHAR}"
    reset = _struct("t", path="t.path" if groups else "x.path", status="'pending'", retries="0", held="false", error="NULL::VARCHAR")
    add = f"CASE WHEN {known} > 0 THEN {_state(tasks=_set(known, reset))} " + (f"WHEN {busy} > 0 THEN s " if groups else "") + f"ELSE {_state(tasks=f'list_append(s.tasks, {fresh})')} END"
    without = lambda place: f"list_filter(s.tasks, lambda t, k: k <> {place})"
    why = f"CASE WHEN x.ok THEN '{queues.NO_OUTPUT}' ELSE coalesce(x.error, 'failed') END"
    limit = f"WHEN NOT x.ok AND contains(x.error, '429') THEN {_state(tasks=_set(mine, _struct('t', status=chr(39) + 'pending' + chr(39), error=why)), paused='true', resume_at=f'coalesce(s.resume_at, x.ms + {pause_ms})')}" if pause_ms else ""
    once_more = f"s.tasks[{mine}].retries + 1"
    done = f"""CASE WHEN coalesce({mine}, 0) = 0 THEN s WHEN x.ok AND x.files > 0 THEN {_state(tasks=without(mine), worked='true', done='s.done + 1')} {limit}
        ELSE {_state(tasks=_set(mine, _struct('t', status=f"CASE WHEN t.retries + 1 >= {tries} THEN 'failed' ELSE 'pending' END", retries='t.retries + 1', error=why)), failed=f'CASE WHEN {once_more} >= {tries} THEN s.failed + 1 ELSE s.failed END')} END"""
    held = f"list_transform(s.tasks, lambda t: {_struct('t', status=chr(67) + 'ASE WHEN t.status = ' + repr('processing') + ' THEN ' + repr('pending') + ' ELSE t.status END', held='t.status IN (' + repr('processing') + ', ' + repr('pending') + ')')})"
    apply = f"""CASE x.action WHEN 'add' THEN {add} WHEN 'done' THEN {done}
        WHEN 'cancel' THEN CASE WHEN {either} > 0 THEN {_state(tasks=without(either))} ELSE s END
        WHEN 'retry' THEN CASE WHEN {failed} > 0 THEN {_state(tasks=_set(failed, _struct('t', status=chr(39) + 'pending' + chr(39), retries='0', held='false', error='NULL::VARCHAR')))} ELSE s END
        WHEN 'pause' THEN {_state(paused='true')} WHEN 'resume' THEN {_state(paused='false', resume_at='NULL::BIGINT', tasks='list_transform(s.tasks, lambda t: ' + _struct('t', held='false') + ')')}
        WHEN 'restart' THEN {_state(tasks=held)} ELSE s END"""
    step = f"CASE WHEN x.step = 'time' THEN CASE WHEN s.resume_at <= x.ms THEN {_state(paused='false', resume_at='NULL::BIGINT')} ELSE s END WHEN x.step = 'apply' THEN {apply} ELSE {dispatch} END"
    steps = ", ".join(["'time'", *["'dispatch'"] * slots, "'apply'", *["'dispatch'"] * (slots + 1)])
    return f"""
WITH c AS (SELECT user_id::VARCHAR AS project, epoch_us(ts) // 1000 AS ms, event_id AS seq, value AS v,
    CASE WHEN event_type IN ('view', 'signup') THEN 'add' WHEN event_type = 'error' AND value < 5 THEN 'restart' WHEN event_type = 'purchase' AND value < 10 THEN 'resume' WHEN event_type = 'purchase' AND value < 14 THEN 'pause'
        WHEN event_type = 'purchase' AND value < 20 THEN 'retry' WHEN event_type = 'click' AND value < 3 THEN 'cancel' ELSE 'done' END AS action,
    event_type = 'purchase' OR event_type = 'click' AND value < 90 AS ok, CASE WHEN event_type = 'error' AND value > 60 THEN 'HTTP 429: slow down' WHEN NOT (event_type = 'purchase' OR event_type = 'click' AND value < 90) THEN 'timeout' END AS error,
    'raw/sources/s' || floor(value)::BIGINT % 12 AS source, CASE WHEN value < 30 THEN 0 ELSE 1 END AS files FROM events),
p AS (SELECT *, CASE WHEN action <> 'done' THEN {path} END AS path FROM (SELECT *, source AS named FROM c)),
x AS (SELECT project, ms, seq, unnest(range(1, {2 * slots + 4})) AS i, {{'step': ([{steps}])[i], 'ms': ms, 'action': action, 'path': path, 'ok': ok, 'files': files, 'error': error}} AS x FROM p),
l AS (SELECT project, list(x ORDER BY ms, seq, i) AS steps FROM x GROUP BY 1),
s AS (SELECT project, list_reduce(steps, lambda s, x: {step}, {{'tasks': []::STRUCT(path VARCHAR, status VARCHAR, retries INTEGER, held BOOLEAN, error VARCHAR)[], 'paused': false, 'resume_at': NULL::BIGINT, 'worked': false, 'started': 0, 'done': 0, 'failed': 0, 'drained': 0, 'most': 0}}) AS s FROM l),
r AS (SELECT project, s, CASE WHEN len(s.tasks) = 0 THEN [NULL] ELSE range(1, len(s.tasks) + 1) END AS places FROM s)
SELECT project, place::INTEGER AS place, s.tasks[place].path AS path, s.tasks[place].status AS status, s.tasks[place].retries::INTEGER AS retries, s.tasks[place].held AS held, s.tasks[place].error AS error,
    s.paused AS paused, s.resume_at AS resume_at, s.started::BIGINT AS started, s.done::BIGINT AS done, s.failed::BIGINT AS failed, s.drained::BIGINT AS drained, s.most::INTEGER AS most_running FROM (SELECT project, s, unnest(places) AS place FROM r)
"""


_PAIR = "CASE WHEN seq % 2 = 0 THEN 'P' || floor(value_)::BIGINT % 12 % 4 || ',x' ELSE 'x,p' || floor(value_)::BIGINT % 12 % 4 END".replace("value_", "v")
QUERIES = {
    "ingest_queue": (ingest_queue, fold_sql(1, 3, 15 * 60 * 1000, "named")),
    "merge_queue": (merge_queue, fold_sql(1, 3, None, _PAIR, True)),
    "research_queue": (research_queue, fold_sql(3, 1, None, "named")),
}
