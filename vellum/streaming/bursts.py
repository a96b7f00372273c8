"""Change notices gathered into flushes, by event-time timers of ``transformWithState``.

Notices (channel, ts, id, kind) of a channel wait in the state until their flush is due,
slice by slice of time, those of ``debounce`` summed up as bursts:

* ``debounce``: every notice starts the delay anew, so a flush comes when a channel has been
  quiet for the delay;
* ``coalesce``: the first notice starts the delay, so a flush comes at a fixed time after it.

A null id means that everything is affected: such a flush lists no ids. Of an id's notices
in a flush the last one tells its kind. A flush is due at a time that the watermark must
have passed, so notices may come late, out of order, or repeated, and give the flushes that
the same notices give in order; those later than the watermark are dropped.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterable, Iterator
from datetime import datetime, timedelta, timezone
from itertools import islice

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from vellum.session import ship

FLUSH_SCHEMA = "channel string, flushed timestamp, notices long, everything boolean, changed array<string>, removed array<string>"
#: A notice of this kind takes its id out; all others change it.
REMOVED = "delete"
EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)

#: A waiting notice: time in microseconds, id or None, kind.
Notice = tuple[int, str | None, str]


def micros(ts: datetime) -> int:
    """Microseconds since 1970; times without a zone are taken as local ones, as Spark gives them to Python."""
    return (ts.astimezone(timezone.utc) - EPOCH) // timedelta(microseconds=1)


def flushes(waiting: list[Notice], delay: int, restart: bool) -> list[tuple[int, list[Notice]]]:
    """Waiting notices, in order of time, as flushes: when each is due, and what it holds."""
    out: list[tuple[int, list[Notice]]] = []
    for notice in waiting:
        if out and notice[0] < out[-1][0]:
            due, held = out[-1]
            held.append(notice)
            out[-1] = (notice[0] + delay if restart else due), held
        else:
            out.append((notice[0] + delay, [notice]))
    return out


def in_order(notice: Notice) -> tuple[int, bool, str, str]:
    """Order is by time, then id and kind, so equal times do not depend on arrival."""
    return notice[0], notice[1] is not None, notice[1] or "", notice[2]


def told_row(channel: str, due: int, n: int, everything: bool, last: dict[str, str]) -> Row:
    """The row of a flush of ``n`` notices, with the last kind of each id; "everything" dominates the ids."""
    listed = {} if everything else last
    changed = sorted(i for i, kind in listed.items() if kind != REMOVED)
    removed = sorted(i for i, kind in listed.items() if kind == REMOVED)
    return Row(channel=channel, flushed=EPOCH + timedelta(microseconds=due), notices=n, everything=everything, changed=changed, removed=removed)


def flush_row(channel: str, due: int, held: list[Notice]) -> Row:
    """The row of one flush."""
    return told_row(channel, due, len(held), any(i is None for _, i, _ in held), {i: kind for _, i, kind in held})


class Flusher(StatefulProcessor):
    """State of a channel: the notices that wait, as one value. A timer stands at the time at which its first flush is due.

    It needs memory for all that waits; ``Slicer`` gives the same flushes, and tests compare the two.
    """

    def __init__(self, delay: int, restart: bool):
        self.delay, self.restart = delay, restart

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getValueState("waiting", "ts array<bigint>, id array<string>, kind array<string>")

    def _held(self) -> list[Notice]:
        if not self.waiting.exists():
            return []
        ts, ids, kinds = self.waiting.get()
        return list(zip(ts, ids, kinds, strict=True))

    def _keep(self, waiting: list[Notice]) -> None:
        if waiting:
            self.waiting.update(tuple(map(list, zip(*waiting, strict=True))))
        else:
            self.waiting.clear()

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # A notice that came twice is one.
        waiting = sorted({*self._held(), *((micros(r.ts), r.id, r.kind) for r in rows)}, key=in_order)
        self._wait_for(flushes(waiting, self.delay, self.restart))
        self._keep(waiting)
        return iter([])

    def _wait_for(self, coming: list[tuple[int, list[Notice]]]) -> None:
        if coming:
            self.handle.registerTimer(-(-coming[0][0] // 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        # All that the watermark has passed is flushed at once: the notices are read once, not once for each flush.
        now = timerValues.getCurrentWatermarkInMs() * 1000
        due, rest = [], []
        for at, held in flushes(self._held(), self.delay, self.restart):
            (due if at <= now else rest).append((at, held))
        if due:
            self._keep([n for _, held in rest for n in held])
        self._wait_for(rest)
        return iter([flush_row(key[0], at, held) for at, held in due])

    def close(self) -> None:
        pass


#: How many notices are gathered before they go to the state, how many delays one slice of time is long, and into how many a slice of more notices is dealt.
CHUNK, SLICE, FINER = 50_000, 256, 16

#: A part of a slice: when the slice begins, how long it is (both in microseconds), the number of the part, and how many notices it has.
Part = tuple[int, int, int, int]


class Slicer(StatefulProcessor):
    """State of a channel: the notices that wait, by slices of time, each in as many parts as were added.

    Slices are read in order of time when the watermark has passed them. One of more than a
    chunk of notices, or with a shorter one inside it, is first dealt into shorter ones, so
    what is held in memory is two chunks of notices, the numbers of the parts, and the ids of
    one flush. Only notices of one microsecond, each there once, are read together however many
    they are. Notices that came twice lie in one slice.
    """

    def __init__(self, delay: int):
        self.delay, self.slice = delay, SLICE * delay

    def init(self, handle) -> None:
        self.handle = handle
        self.parts = handle.getMapState("parts", "start bigint, length bigint, part bigint, n bigint", "notices string")
        self.added = handle.getValueState("added", "n bigint")

    def _put(self, notices: Iterable[Notice], length: int, origin: int = 0) -> list[Part]:
        """Keep notices by slices of a length, counted from an origin."""
        number = self.added.get()[0] if self.added.exists() else 0
        slices: dict[int, list[Notice]] = {}
        for notice in notices:
            slices.setdefault(origin + (notice[0] - origin) // length * length, []).append(notice)
        made = []
        for start, held in slices.items():
            made.append((start, length, number, len(held)))
            self.parts.updateValue(made[-1], (json.dumps(held),))
        self.added.update((number + 1,))
        return made

    def _take(self, part: Part) -> list[Notice]:
        held = [(at, i, kind) for at, i, kind in json.loads(self.parts.getValue(part)[0])]
        self.parts.removeKey(part)
        return held

    def _deal(self, parts: list[Part]) -> Iterator[Part]:
        """Parts of one slice, dealt into slices of a fraction of its length."""
        start, length = parts[0][:2]
        finer, held = -(-length // FINER), set()
        for part in parts:
            held.update(self._take(part))
            if len(held) >= CHUNK:
                yield from self._put(held, finer, start)
                held = set()
        if held:
            yield from self._put(held, finer, start)

    def _wait_for(self, due: int) -> None:
        self.handle.registerTimer(-(-due // 1000))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        first = None
        while chunk := {(micros(r.ts), r.id, r.kind) for r in islice(rows, CHUNK)}:
            self._put(chunk, self.slice)
            earliest = min(chunk, key=in_order)[0]
            first = earliest if first is None else min(first, earliest)
        if first is not None:
            self._wait_for(first + self.delay)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        slices: dict[tuple[int, int], list[Part]] = {}
        queue: list[tuple[int, int]] = []  # of slices that begin at the same time, the longest comes first

        def add(part: Part) -> None:
            if (at := (part[0], -part[1])) not in slices:
                slices[at] = []
                heapq.heappush(queue, at)
            slices[at].append(part)

        for part in self.parts.keys():
            add(tuple(part))
        due = None  # of the flush that is being gathered; only one that the watermark has passed is begun
        while queue:
            start, length = queue[0][0], -queue[0][1]
            if due is not None and start >= due:
                yield told_row(key[0], due, n, everything, last)
                due = None
            if due is None and start + self.delay > now:
                self._wait_for(start + self.delay)
                return
            parts = slices.pop(heapq.heappop(queue))
            if length > 1 and (sum(p[3] for p in parts) > CHUNK or (queue and queue[0][0] < start + length)):
                for part in self._deal(parts):
                    add(part)
                continue
            notices = sorted({notice for part in parts for notice in self._take(part)}, key=in_order)
            for k, (at, i, kind) in enumerate(notices):
                if due is not None and at >= due:
                    yield told_row(key[0], due, n, everything, last)
                    due = None
                if due is None:
                    if at + self.delay > now:
                        self._put(notices[k:], length, start)
                        self._wait_for(at + self.delay)
                        return
                    due, n, everything, last = at + self.delay, 0, False, {}
                n += 1
                if i is None:
                    everything, last = True, {}
                elif not everything:
                    last[i] = kind
        if due is not None:
            yield told_row(key[0], due, n, everything, last)

    def close(self) -> None:
        pass


#: A burst, or a part of one: times of its first and last notice, how many, whether any affects everything, and each id's last time and kind.
Burst = list


def burst_of(notice: Notice) -> Burst:
    at, i, kind = notice
    return [at, at, 1, i is None, {} if i is None else {i: [at, kind]}]


def joined(bursts: list[Burst], delay: int) -> list[Burst]:
    """Bursts in order of time, those less than a delay apart put together; parts of bursts may come in any order and overlap."""
    out: list[Burst] = []
    for burst in sorted(bursts, key=lambda b: b[:2]):
        if not out or burst[0] - out[-1][1] >= delay:
            out.append([*burst[:4], dict(burst[4])])
            continue
        last = out[-1]
        last[1], last[2], last[3] = max(last[1], burst[1]), last[2] + burst[2], last[3] or burst[3]
        for i, told in burst[4].items():
            if i not in last[4] or last[4][i] < list(told):
                last[4][i] = list(told)
    return out


def burst_row(channel: str, delay: int, burst: Burst) -> Row:
    _, last, n, everything, ids = burst
    return told_row(channel, last + delay, n, everything, {i: kind for i, (_, kind) in ids.items()})


class Burster(StatefulProcessor):
    """State of a channel: bursts by the slice of time that they begin in, in as many parts as were added.

    Notices, each of which comes once, are summed up as they are read, and parts are put
    together when the watermark has passed them, one slice at a time: what is held in memory
    is a chunk of notices, the numbers of the slices, and the bursts of one slice.
    """

    def __init__(self, delay: int):
        self.delay, self.slice = delay, SLICE * delay

    def init(self, handle) -> None:
        self.handle = handle
        self.parts = handle.getMapState("parts", "slice bigint, part bigint", "bursts string")
        self.added = handle.getValueState("added", "n bigint")

    def _add(self, bursts: list[Burst]) -> None:
        n = self.added.get()[0] if self.added.exists() else 0
        by_slice: dict[int, list[Burst]] = {}
        for burst in bursts:
            by_slice.setdefault(burst[0] // self.slice, []).append(burst)
        for k, held in by_slice.items():
            self.parts.updateValue((k, n), (json.dumps(held),))
        self.added.update((n + 1,))

    def _wait_for(self, due: int) -> None:
        self.handle.registerTimer(-(-due // 1000))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        first = None
        while chunk := [burst_of((micros(r.ts), r.id, r.kind)) for r in islice(rows, CHUNK)]:
            found = joined(chunk, self.delay)
            self._add(found)
            first = min(first or found[0], found[0], key=lambda b: b[1])
        if first:
            self._wait_for(first[1] + self.delay)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        passed = lambda burst: burst[1] + self.delay <= now
        slices: dict[int, list[int]] = {}
        for k, part in self.parts.keys():
            slices.setdefault(k, []).append(part)
        last: list[Burst] = []  # the burst at the end of the slices read so far
        for k in sorted(slices):
            if last and last[0][1] + self.delay <= k * self.slice and passed(last[0]):
                yield burst_row(key[0], self.delay, last.pop())
            if (last and not passed(last[0])) or (not last and k * self.slice + self.delay > now):
                self._wait_for(last[0][1] + self.delay if last else k * self.slice + self.delay)
                break
            for part in slices[k]:
                last += json.loads(self.parts.getValue((k, part))[0])
                self.parts.removeKey((k, part))
            *done, end = joined(last, self.delay)
            for at, burst in enumerate(done):
                if not passed(burst):  # nor is any burst after it
                    self._add(done[at:] + [end])
                    self._wait_for(burst[1] + self.delay)
                    return
                yield burst_row(key[0], self.delay, burst)
            last = [end]
        if last and passed(last[0]):
            yield burst_row(key[0], self.delay, last.pop())
        if last:
            self._add(last)
            self._wait_for(last[0][1] + self.delay)

    def close(self) -> None:
        pass


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _flushed(notices: DataFrame, late: str, once: bool, processor: StatefulProcessor) -> DataFrame:
    notices.sparkSession.conf.set(STATE_STORE, ROCKS)  # the only one that keeps timers
    timed = notices.select(F.col("channel").cast("string"), F.col("ts").cast("timestamp"), F.col("id").cast("string"), F.coalesce(F.col("kind").cast("string"), F.lit("")).alias("kind"))
    timed = timed.filter("channel IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", late)
    timed = timed.dropDuplicates(["channel", "ts", "id", "kind"]) if once else timed
    return timed.groupBy("channel").transformWithState(statefulProcessor=processor, outputStructType=FLUSH_SCHEMA, outputMode="append", timeMode="eventTime")


def debounce(notices: DataFrame, delay_ms: int = 8_000, late: str = "1 minute") -> DataFrame:
    """Flushes of a stream of notices, each when its channel has been quiet for the delay.

    Repeated notices are dropped by the state store, whatever their channel; what waits are
    bursts, not notices, and a task holds those of one slice of time. Rows without a channel
    or a time are left out.
    """
    return _flushed(notices, late, True, Burster(delay_ms * 1000))


def coalesce(notices: DataFrame, delay_ms: int = 250, late: str = "1 minute") -> DataFrame:
    """Flushes of a stream of notices, each one delay after the first notice that it holds.

    An earlier notice that comes late moves the flushes after it, so what waits are notices; a
    task holds two chunks of them, the numbers of the parts kept and the ids of one flush.
    """
    return _flushed(notices, late, False, Slicer(delay_ms * 1000))


def debounced(notices: DataFrame, delay_ms: int = 8_000) -> DataFrame:
    """What ``debounce`` gives in the end, of a table: the batch twin, by windows and sums alone."""
    ts: Column = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = notices.select(F.col("channel").cast("string"), ts.alias("ts"), F.col("id").cast("string"), F.coalesce(F.col("kind").cast("string"), F.lit("")).alias("kind"))
    rows = rows.filter("channel IS NOT NULL AND ts IS NOT NULL").distinct()
    order = Window.partitionBy("channel").orderBy("ts", F.col("id").isNotNull(), F.coalesce("id", F.lit("")), "kind")
    starts = F.coalesce(F.col("ts") - F.lag("ts").over(order) >= delay_ms * 1000, F.lit(True)).cast("int")
    numbered = rows.withColumn("starts", starts).withColumn("burst", F.sum("starts").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # An id's last notice of a burst; "everything" has one row like any id, told by its null.
    last = numbered.groupBy("channel", "burst", "id").agg(F.max_by("kind", F.struct("ts", "kind")).alias("kind"), F.max("ts").alias("ts"), F.count(F.lit(1)).alias("n"))
    ids = lambda gone: F.sort_array(F.collect_list(F.when(F.col("id").isNotNull() & ((F.col("kind") == REMOVED) == gone), F.col("id"))))
    flushed = last.groupBy("channel", "burst").agg(F.max("ts").alias("ts"), F.sum("n").alias("notices"), F.max(F.col("id").isNull()).alias("everything"), ids(False).alias("changed"), ids(True).alias("removed"))
    listed = lambda c: F.when(F.col("everything"), F.array().cast("array<string>")).otherwise(F.col(c)).alias(c)
    return flushed.select("channel", F.timestamp_micros(F.col("ts") + delay_ms * 1000).alias("flushed"), "notices", "everything", listed("changed"), listed("removed"))


ship(__name__)
