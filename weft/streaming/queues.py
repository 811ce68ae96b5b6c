"""Work queues as keyed state: serial ingest with retries and a pause after a usage limit, merges, and research in three slots.

Commands of one project come as rows; its queue is state that survives a restart, and answers with transitions: which
task to start, what is done, failed, paused or drained. Workers read ``started`` rows and send ``done`` commands back.
The same rules fold a table of commands in batch (``fold``), so the state of a stream can be checked against its history.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import astuple, dataclass, field, replace
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
USAGE_LIMIT = re.compile(r"\b429\b|rate[_\s-]*limit|usage\s+limit|quota|too many requests", re.I)
NO_OUTPUT = "no output files"
#: add (path, folder), done (path or null for the oldest task in work; ok, files, error), cancel and retry (path), pause, resume, restart.
COMMANDS = "project string, at timestamp, seq long, action string, path string, folder string, ok boolean, files int, error string"
TRANSITIONS = "project string, at timestamp, what string, path string, attempt int, error string"


@dataclass(frozen=True)
class Rules:
    """How a queue works: tasks in work at a time, tries of a task, and the pause after a usage limit (none: such an error is one like any other).
    With ``groups``, a path is a list of ids joined by commas that names the same task in any order and case."""

    slots: int = 1
    tries: int = 3
    pause_ms: int | None = 15 * 60 * 1000
    groups: bool = False

    def key(self, path: str | None) -> str:
        return ",".join(sorted((path or "").lower().split(","))) if self.groups else path or ""


INGEST = Rules()
MERGE = Rules(pause_ms=None, groups=True)
RESEARCH = Rules(slots=3, tries=1, pause_ms=None)


@dataclass
class Task:
    path: str
    folder: str
    status: str = "pending"
    retries: int = 0
    error: str | None = None
    held: bool = False  # pending from before a restart: waits until it is asked for


@dataclass
class Queue:
    """One project's queue. ``tasks`` by number of arrival; each method returns transitions (at, what, path, attempt, error)."""

    rules: Rules
    tasks: dict[int, Task] = field(default_factory=dict)
    paused: bool = False
    resume_at: int | None = None
    worked: bool = False
    next: int = 0
    out: list[tuple] = field(default_factory=list)

    def say(self, at: int, what: str, task: Task | None = None) -> None:
        self.out.append((at, what, task.path if task else None, task.retries + 1 if task else None, task.error if task else None))

    def advance(self, now: int) -> None:
        """A pause that has run out ends at its own time."""
        if self.resume_at is not None and self.resume_at <= now:
            at, self.resume_at, self.paused = self.resume_at, None, False
            self.say(at, "resumed")
            self.dispatch(at)

    def find(self, path: str | None, *status: str) -> int | None:
        return next((n for n, t in self.tasks.items() if t.status in status and (path is None or self.rules.key(t.path) == self.rules.key(path))), None)

    def dispatch(self, at: int) -> None:
        """Start pending tasks in order while there are slots; a queue that has run dry after work says so once."""
        running = sum(t.status == "processing" for t in self.tasks.values())
        while running < self.rules.slots:
            pending = [t for t in self.tasks.values() if t.status == "pending"]
            if self.paused:
                if pending:
                    return
                self.paused, self.resume_at = False, None  # a pause is for what is there, not for later imports
            task = next((t for t in pending if not t.held), None)
            if task is None:
                if not pending and not running and self.worked:
                    self.worked = False
                    self.say(at, "drained")
                return
            task.status, running = "processing", running + 1
            self.say(at, "started", task)

    def apply(self, now: int, action: str, path: str | None, folder: str | None, ok: bool | None, files: int | None, error: str | None) -> None:
        """One command at a time ``now``; commands that fit no task change nothing."""
        self.advance(now)
        if action == "add" and path is not None:
            self.add(path, folder or "")
        elif action == "done":
            self.done(now, path, bool(ok), files or 0, error)
        elif action in ("cancel", "retry") and path is not None:
            n = self.find(path, "failed") if action == "retry" else self.find(path, "processing", "pending", "failed")
            if n is not None and action == "retry":
                self.tasks[n] = replace(self.tasks[n], status="pending", retries=0, error=None, held=False)
            elif n is not None:
                self.say(now, "aborted" if self.tasks[n].status == "processing" else "cancelled", self.tasks.pop(n))
        elif action == "pause":
            self.paused = True
        elif action == "resume":
            self.paused, self.resume_at = False, None
            for t in self.tasks.values():
                t.held = False
        elif action == "restart":
            for t in self.tasks.values():
                t.status = "pending" if t.status == "processing" else t.status
                t.held = t.status == "pending"
        self.dispatch(now)

    def add(self, path: str, folder: str) -> None:
        n = self.find(path, "pending", "failed")
        if n is None and self.rules.groups:
            n = self.find(path, "processing")
            if n is not None:
                return  # a merge in work needs no second one
        if n is not None:
            old = self.tasks[n]
            self.tasks[n] = Task(path if not self.rules.groups else old.path, folder or old.folder)
        else:
            self.tasks[self.next] = Task(path, folder)
            self.next += 1

    def done(self, now: int, path: str | None, ok: bool, files: int, error: str | None) -> None:
        n = self.find(path, "processing")
        if n is None:
            return  # an answer to a task that was cancelled, or to one of an earlier run
        task = self.tasks[n]
        if ok and files > 0:
            self.worked = True
            self.say(now, "done", self.tasks.pop(n))
            return
        task.error = (error or "failed") if not ok else NO_OUTPUT
        if self.rules.pause_ms is not None and USAGE_LIMIT.search(task.error):
            task.status, self.paused = "pending", True
            self.resume_at = self.resume_at if self.resume_at is not None else now + self.rules.pause_ms
            self.say(now, "paused", task)
            return
        self.say(now, "failed" if task.retries + 1 >= self.rules.tries else "again", task)
        task.retries += 1
        task.status = "failed" if task.retries >= self.rules.tries else "pending"


def _millis(at: pd.Timestamp) -> int:
    return at.value // 1_000_000


def _plain(row) -> tuple:
    """action, path, folder, ok, files, error of a row, with None for missing values."""
    return tuple(None if v is None or v is pd.NA or v != v else v for v in (row.action, row.path, row.folder, row.ok, row.files, row.error))


def _frame(key: str, out: list[tuple]) -> pd.DataFrame:
    rows = [(key, datetime.fromtimestamp(at / 1000, UTC).replace(tzinfo=None), what, path, attempt, error) for at, what, path, attempt, error in out]
    return pd.DataFrame(rows, columns=["project", "at", "what", "path", "attempt", "error"]).astype({"attempt": "Int32"})


class _Stateful(StatefulProcessor):
    """A queue in a state store: its tasks by number, and a row of the rest."""

    def __init__(self, rules: Rules, clock: str, keep_ms: int | None) -> None:
        self.rules, self.clock, self.keep_ms = rules, clock, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rest = handle.getValueState("rest", "paused boolean, resume_at long, worked boolean, next long", self.keep_ms)
        self.tasks = handle.getMapState("tasks", "n long", "path string, folder string, status string, retries int, error string, held boolean", self.keep_ms)

    def _load(self) -> Queue:
        rest = self.rest.get()
        queue = Queue(self.rules)
        if rest is not None:
            queue.paused, queue.resume_at, queue.worked, queue.next = rest
        queue.tasks = {int(n[0]): Task(*row) for n, row in sorted(self.tasks.iterator(), key=lambda kv: kv[0][0])}
        return queue

    def _save(self, queue: Queue, before: dict[int, tuple], resume_before: int | None) -> None:
        for n in before.keys() - queue.tasks.keys():
            self.tasks.removeKey((n,))
        for n, t in queue.tasks.items():
            if before.get(n) != astuple(t):
                self.tasks.updateValue((n,), astuple(t))
        self.rest.update((queue.paused, queue.resume_at, queue.worked, queue.next))
        if queue.resume_at != resume_before:
            if resume_before is not None:
                self.handle.deleteTimer(resume_before)
            if queue.resume_at is not None:
                self.handle.registerTimer(queue.resume_at)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        queue = self._load()
        before, resume = {n: astuple(t) for n, t in queue.tasks.items()}, queue.resume_at
        commands = pd.concat(list(rows)).sort_values(["at", "seq"], kind="stable")
        wall = timerValues.getCurrentProcessingTimeInMs() if self.clock == "ProcessingTime" else None
        for row in commands.itertuples():
            queue.apply(_millis(row.at) if wall is None else wall, *_plain(row))
        self._save(queue, before, resume)
        yield _frame(key[0], queue.out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        queue = self._load()
        before, resume = {n: astuple(t) for n, t in queue.tasks.items()}, queue.resume_at
        queue.advance(expiredTimerInfo.getExpiryTimeInMs())
        if queue.resume_at != resume:
            resume = None  # this timer is the one that has run out
        self._save(queue, before, resume)
        yield _frame(key[0], queue.out)

    def close(self) -> None:
        pass


def live(commands: DataFrame, rules: Rules = INGEST, clock: str = "ProcessingTime", late: str = "0 seconds", keep_days: int | None = 90) -> DataFrame:
    """Transitions of the queues of a stream of commands, one queue for each project.

    With the processing clock, commands count when they come, pauses end by timers of the machine's time, and the state of a project
    unheard of for ``keep_days`` goes. With ``clock="EventTime"`` the commands' own times are the clock, which moves by the watermark: for
    replays and tests; commands that come later than ``late`` behind it are dropped by Spark. The session needs the RocksDB state store (``PROVIDER``).
    """
    commands.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    keep = keep_days * 24 * 3600 * 1000 if keep_days and clock == "ProcessingTime" else None
    keyed = (commands.withWatermark("at", late) if clock == "EventTime" else commands).where("project is not null and at is not null").groupBy("project")
    return keyed.transformWithStateInPandas(_Stateful(rules, clock, keep), TRANSITIONS, "append", clock)


STATE = "project string, place int, path string, status string, retries int, held boolean, error string, paused boolean, resume_at long, started long, done long, failed long, drained long, most_running int"


def fold(commands: DataFrame, rules: Rules = INGEST) -> DataFrame:
    """The queues after all commands of a table, in order of time and number: a row for each task left, by its place (and a row without one for an
    empty queue), with how often tasks were started, done and failed, how often the queue ran dry, and the most tasks in work at once.

    Projects are dealt by key, sorted, and read as a stream: a task holds the live tasks of one project, not its history. Rows
    without a project or a time are no commands."""

    def ended(project: str, queue: Queue, counts: dict[str, int], most: int) -> list[tuple]:
        totals = (queue.paused, queue.resume_at, *(counts.get(w, 0) for w in ("started", "done", "failed", "drained")), most)
        rows = [(project, i, t.path, t.status, t.retries, t.held, t.error, *totals) for i, t in enumerate(queue.tasks.values(), 1)]
        return rows or [(project, None, None, None, None, None, None, *totals)]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in STATE.split(", ")]
        kinds = {"place": "Int32", "retries": "Int32", "held": "boolean", "resume_at": "Int64"}
        project, queue, counts, most = None, Queue(rules), {}, 0
        for part in parts:
            rows = []
            for row in part.itertuples():
                if row.project != project:
                    if project is not None:
                        rows += ended(project, queue, counts, most)
                    project, queue, counts, most = row.project, Queue(rules), {}, 0
                queue.apply(_millis(row.at), *_plain(row))
                for _, what, *_ in queue.out:
                    counts[what] = counts.get(what, 0) + 1
                queue.out.clear()
                most = max(most, sum(t.status == "processing" for t in queue.tasks.values()))
            yield pd.DataFrame(rows, columns=names).astype(kinds)
        if project is not None:
            yield pd.DataFrame(ended(project, queue, counts, most), columns=names).astype(kinds)

    rows = commands.where("project is not null and at is not null").repartition("project").sortWithinPartitions("project", "at", "seq")
    return rows.mapInPandas(run, STATE)
