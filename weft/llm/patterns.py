"""Sequential patterns of clients' events under gap and span limits, mined SPAM-style with numpy bitsets.

Events are ordered by client and time. Each type has a bitset over them. A pattern's bitset marks the events at which
an occurrence of it can end; smearing it over the gap window behind each event and ANDing the result with a type's
bitset gives the bitset of the pattern with that type appended. Patterns long enough to break the span limit are
verified with the array of latest starts: of all occurrences that end at an event, the one that starts last.

A client's time line is cut into bins; a bin also gets the events of one span behind its end, so every occurrence lies
whole in the bin where it starts, and a client with a third of all events is spread over as many rows as it has bins.
Bins are dealt by ranges of (client, bin). What a task holds at once is bounded by time, not by a client's events.

Lengths grow level by level: a candidate's first and last parts, one type shorter, were kept (deleting an inner type
can break the gap limit, so other parts don't prune). A client's patterns travel as a
bitset over the candidates; bitsets of one client are ORed and counted, and Spark adds up the counts. Only the types and kept patterns reach the driver: with a least share of clients, they number at most a
function of how many types a client has on average, whatever the input's size.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

from weft.session import materialize

SECOND = 1_000_000
BIN_SECONDS = 3 * 3600
BATCH_EVENTS = 1 << 17
#: Bits of clients by candidates that a task holds at once.
HELD_BITS = 1 << 26
#: Candidates whose sums a task passes on in one row.
BLOCK = 256
RESULT = "pattern string, length int, support long, clients_crc long, n_wider long, closed boolean"


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970 of a timestamp column, in its own clock if it has no zone."""
    if not isinstance(df.schema[name].dataType, TimestampNTZType):
        return F.unix_micros(F.col(name).cast("timestamp"))
    at = f"`{name}`"
    return F.expr(f"(datediff(CAST({at} AS DATE), DATE'1970-01-01') * 86400L + hour({at}) * 3600L + minute({at}) * 60L) * {SECOND}L + CAST(extract(SECOND FROM {at}) * {SECOND} AS BIGINT)")


def click_events(clicks: DataFrame, one_in: int = 5) -> DataFrame:
    """``(client, t, type)`` of clicks with a client, a time and a kind; a click whose number's CRC-32 is divisible by
    ``one_in`` adds ``open`` a second before and ``shut`` a second after itself."""
    rows = clicks.where("client_id is not null and ts is not null and kind is not null")
    rows = rows.select(F.col("client_id").cast("long").alias("client"), micros(rows, "ts").alias("t"), F.col("kind").alias("type"), F.crc32(F.col("click_id").cast("string").cast("binary")).alias("crc"))
    event = lambda shift, kind: F.struct((F.col("t") + shift).alias("t"), kind.alias("type"))
    own = F.array(event(0, F.col("type")))
    more = F.array(event(-SECOND, F.lit("open")), event(SECOND, F.lit("shut")))
    return rows.select("client", F.explode(F.when(F.col("crc") % one_in == 0, F.concat(own, more)).otherwise(own)).alias("e")).select("client", "e.t", "e.type")


def bins(events: DataFrame, types: DataFrame, span: int, width: int = BIN_SECONDS * SECOND) -> DataFrame:
    """``(client, bin, events)``: the sorted distinct events (t, code) of each client's bins, with those up to ``span`` after
    the bin; bins without an event of their own are left out. A client's bins stand together, so that a batch gives a client's pattern once."""
    coded = events.join(F.broadcast(types), "type").select("client", "t", "code", F.expr(f"(t - pmod(t, {width}L)) div {width}L").alias("bin"))
    before = F.when(F.col("t") - F.col("bin") * width <= span, F.array(F.col("bin"), F.col("bin") - 1)).otherwise(F.array("bin"))
    dealt = coded.select("client", F.explode(before).alias("bin"), "t", "code").repartitionByRange("client", "bin")
    held = dealt.groupBy("client", "bin").agg(F.sort_array(F.collect_set(F.struct("t", "code"))).alias("events"))
    return held.where(F.col("events")[0]["t"] < (F.col("bin") + 1) * width).sortWithinPartitions("client", "bin")


class _Timeline:
    """Bitsets over the events of some bins, laid out one after another."""

    def __init__(self, t: np.ndarray, codes: np.ndarray, sizes: np.ndarray, gap: int, span: int) -> None:
        self.gap, self.span, self.n = gap, span, len(t)
        self.bin = np.repeat(np.arange(len(sizes)), sizes)
        firsts = np.cumsum(sizes) - sizes
        lasts = firsts + sizes - 1
        far = np.cumsum(t[lasts] - t[firsts] + gap + 1)  # bins stand further apart than the gap, so no window reaches over
        self.t = t - t[firsts][self.bin] + np.concatenate(([0], far[:-1]))[self.bin]
        self.after = np.searchsorted(self.t, self.t, "left") - 1  # the last event strictly before
        self.first = np.searchsorted(self.t, self.t - gap, "left")  # the first event within the gap
        self.places = np.arange(self.n)
        self.types = {int(x): np.packbits(codes == x) for x in np.unique(codes)}

    def smear(self, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bitset of events with a marked event in their gap window, and the last marked event before each."""
        marked = np.unpackbits(bits, count=self.n).astype(bool)
        last = np.maximum.accumulate(np.where(marked, self.places, -1))
        before = np.where(self.after >= 0, last[self.after], -1)
        return np.packbits(before >= self.first), before

    def within_span(self, places: np.ndarray, before: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The events at which some occurrence doesn't span too much. Latest starts never fall from one marked event to
        a later one, so the last marked event of the window has the latest start."""
        return places[self.t[places] - starts[before[places]] <= self.span]

    def find(self, tree: dict, length: int, bits: np.ndarray | None = None, starts: np.ndarray | None = None, depth: int = 0) -> Iterator[tuple[int, np.ndarray]]:
        """(pattern number, events at which it ends) for the patterns of a tree of candidates that occur."""
        smeared = before = latest = None
        if bits is not None:
            smeared, before = self.smear(bits)
        for code, below in tree.items():
            own = self.types.get(code)
            if own is None:
                continue
            now, long = own if smeared is None else own & smeared, depth * self.gap > self.span
            if long or depth + 1 == length:
                places = np.flatnonzero(np.unpackbits(now, count=self.n))
                if long:
                    places = self.within_span(places, before, starts)
                if not len(places):
                    continue
                if depth + 1 == length:
                    yield below, places
                    continue
                kept = np.zeros(self.n, bool)
                kept[places] = True
                now = np.packbits(kept)
            elif not now.any():
                continue
            if latest is None:
                latest = self.t if before is None else np.where(before >= 0, starts[before], -1)
            yield from self.find(below, length, now, latest, depth + 1)


def _tree(candidates: list[tuple[int, ...]]) -> dict:
    root: dict = {}
    for number, codes in enumerate(candidates):
        at = root
        for c in codes[:-1]:
            at = at.setdefault(c, {})
        at[codes[-1]] = number
    return root


def supporters(held: DataFrame, candidates: list[tuple[int, ...]], gap: int, span: int) -> DataFrame:
    """``(client, found)``: which candidates (all of one length) a client supports, as a bitset by their place in the list; a client in several
    batches has several."""
    length, tree, many = len(candidates[0]), _tree(candidates), len(candidates)
    most_bins = max(1, HELD_BITS // many)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = batch.column(1).offsets.to_numpy()
            at = 0
            while at < batch.num_rows:
                end = min(at + most_bins, max(at + 1, int(np.searchsorted(ends, ends[at] + BATCH_EVENTS, "right")) - 1))
                part = batch.column(1).values.slice(ends[at], ends[end] - ends[at])
                clients, who = np.unique(batch.column(0).slice(at, end - at).to_numpy(), return_inverse=True)
                line = _Timeline(part.field("t").to_numpy(), part.field("code").to_numpy(), np.diff(ends[at : end + 1]), gap, span)
                mine, found = who[line.bin], np.zeros((many, len(clients)), bool)
                for number, places in line.find(tree, length):
                    found[number, mine[places]] = True
                bits = np.packbits(found.T, axis=1)
                yield pa.record_batch([pa.array(clients), pa.array([row.tobytes() for row in bits], pa.binary())], names=["client", "found"])
                at = end

    return held.select("client", "events").mapInArrow(run, "client long, found binary")


def _bit_counts(found: DataFrame, many: int) -> DataFrame:
    """``(pattern, support, clients_crc)`` of clients' bitsets (client, found): a client's bitsets are ORed, then counted in its task, and the tasks' sums
    are added up by blocks of candidates: a row for each task and block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        support, crc, last, held = np.zeros(many, np.int64), np.zeros(many, np.int64), None, None

        def count(clients: np.ndarray, bits: np.ndarray) -> None:
            for at in range(0, len(clients), 1024):
                some = np.unpackbits(bits[at : at + 1024], axis=1, count=many)
                support[:] += some.sum(0, dtype=np.int64)
                crc[:] += np.array([zlib.crc32(str(c).encode()) for c in clients[at : at + 1024].tolist()], np.int64) @ some

        for batch in batches:
            if not batch.num_rows:
                continue
            clients = batch.column(0).to_numpy()
            bits = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(len(clients), -1)
            if last is not None:
                clients, bits = np.concatenate((last, clients)), np.concatenate((held, bits))
            starts = np.flatnonzero(np.concatenate(([True], clients[1:] != clients[:-1])))
            clients, bits = clients[starts], np.bitwise_or.reduceat(bits, starts, axis=0)
            count(clients[:-1], bits[:-1])  # the last client may go on in the next batch
            last, held = clients[-1:], bits[-1:]
        if last is not None:
            count(last, held)
            firsts = range(0, many, BLOCK)
            blocks = [np.concatenate((support[i : i + BLOCK], crc[i : i + BLOCK])).astype("<i8").tobytes() for i in firsts]
            yield pa.record_batch([pa.array(list(firsts), pa.int32()), pa.array(blocks, pa.binary())], names=["first", "sums"])

    def add(rows: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(b, "<i8") for b in rows["sums"].to_pylist())
        support, crc = np.split(total, 2)
        return pa.table({"pattern": np.arange(len(support), dtype=np.int32) + np.int32(rows["first"][0].as_py()), "support": support, "clients_crc": crc})

    sums = found.repartition("client").sortWithinPartitions("client").mapInArrow(run, "first int, sums binary")
    return sums.groupBy("first").applyInArrow(add, "pattern int, support long, clients_crc long")


def _counts(found: DataFrame, by: str) -> DataFrame:
    crc = F.crc32(F.col("client").cast("string").cast("binary"))
    return found.select("client", by).distinct().groupBy(by).agg(F.count("*").alias("support"), F.sum(crc).alias("clients_crc"))


def _wider(kept: dict[tuple[int, ...], tuple[int, int]]) -> dict[tuple[int, ...], int]:
    """How many longer kept patterns of equal support become each pattern by deleting entries."""
    out = dict.fromkeys(kept, 0)
    for codes, (support, _) in kept.items():
        for part in {x for n in range(1, len(codes)) for x in combinations(codes, n)}:
            if part in kept and kept[part][0] == support:
                out[part] += 1
    return out


def mine(events: DataFrame, gap_seconds: int = 600, span_percent: int = 200, longest: int = 4, least: int = 2, least_percent: int = 10) -> DataFrame:
    """The patterns of 1 to ``longest`` types that at least ``least`` clients and ``least_percent`` percent of the clients with events support.

    ``events``: (client, t in microseconds, type). A client supports a pattern if it has events of its types in order, each more
    than 0 and at most ``gap_seconds`` after the one before, the last at most ``span_percent`` percent of that after the first. Returns
    ``pattern`` (types joined by ``>``), ``length``, ``support``, ``clients_crc`` (the sum of the CRC-32 of the supporters' numbers),
    ``n_wider`` (longer kept patterns of equal support that become this one by deleting entries) and ``closed`` (none).

    Rows with a null in any of the three columns are no events; equal events count once; events at one time don't follow each
    other; no events give no rows. Extra columns are ignored.
    """
    spark = events.sparkSession
    events = events.select("client", "t", "type").where("client is not null and t is not null and type is not null")
    gap, span = gap_seconds * SECOND, gap_seconds * SECOND * span_percent // 100
    seen = materialize(events.select("client", "type").distinct(), "types")
    clients = seen.select("client").distinct().count()
    enough = lambda counts: counts.where((F.col("support") >= least) & (F.col("support") * 100 >= least_percent * clients))
    singles = sorted(enough(_counts(seen, "type")).collect(), key=lambda r: r.type.encode())
    names = [r.type for r in singles]
    kept = {(i,): (r.support, r.clients_crc) for i, r in enumerate(singles)}
    if longest > 1 and kept:
        types = spark.createDataFrame(list(enumerate(names)), "code int, type string")
        held = materialize(bins(events, types, span), "bins")
        level = list(kept)
        for _ in range(longest - 1):
            last = set(level)
            candidates = [p + (x,) for p in level for x in range(len(names)) if p[1:] + (x,) in last]
            if not candidates:
                break
            found = enough(_bit_counts(supporters(held, candidates, gap, span), len(candidates))).collect()
            level = [candidates[r.pattern] for r in found]
            kept |= {candidates[r.pattern]: (r.support, r.clients_crc) for r in found}
    wider = _wider(kept)
    rows = [(">".join(names[c] for c in codes), len(codes), support, crc, wider[codes], not wider[codes]) for codes, (support, crc) in kept.items()]
    return spark.createDataFrame(rows, RESULT)
