import random
from datetime import datetime, timedelta, timezone

import pytest

from vellum.streaming import bursts
from vellum.streaming.events import run_available

START = datetime(2024, 5, 1, tzinfo=timezone.utc)


def naive(notices, delay, restart):
    """All flushes of notices in order of time."""
    out = {}
    for channel in {c for c, *_ in notices}:
        rows = sorted({(t, i, k) for c, t, i, k in notices if c == channel}, key=lambda n: (n[0], n[1] is not None, n[1] or "", n[2]))
        now = []
        for row in rows:
            if now and row[0] >= (now[-1] if restart else now[0])[0] + delay:
                out[channel, (now[-1] if restart else now[0])[0] + delay] = now
                now = []
            now.append(row)
        if now:
            out[channel, (now[-1] if restart else now[0])[0] + delay] = now
    flushed = {}
    for key, held in out.items():
        everything = any(i is None for _, i, _ in held)
        last = {} if everything else {i: k for _, i, k in held}
        flushed[key] = (len(held), everything, sorted(i for i, k in last.items() if k != "delete"), sorted(i for i, k in last.items() if k == "delete"))
    return flushed


def notices(seed, n=300):
    random.seed(seed)
    t, out = 0, []
    for _ in range(n):
        t += random.choice([0, 50, 200, 900, 4_000, 20_000])
        out.append((random.choice("abc"), t, None if random.random() < 0.04 else f"i{random.randint(0, 5)}", random.choice(["add", "modify", "delete"])))
    return out


@pytest.mark.parametrize(("gather", "delay", "restart"), [(bursts.debounce, 8_000, True), (bursts.coalesce, 250, False)])
def test_late_and_repeated_notices_flush_as_in_order(spark, tmp_path, gather, delay, restart):
    rows = notices(delay)
    # Three files; some notices come a file late or twice, and the last file moves the watermark past all.
    files = [rows[:120], rows[120:200], rows[200:]]
    files[1] += [r for r in files[0][-12:] if random.random() < 0.5]
    late = files[0][-6:-2]
    files[0] = [r for r in files[0] if r not in late]
    files[1] += late
    for part in files:
        random.shuffle(part)
    end = max(t for _, t, _, _ in rows)
    files.append([("end", end + 10_000_000, "x", "add")])
    schema = "channel string, ts timestamp, id string, kind string"
    for k, part in enumerate(files):
        spark.createDataFrame([(c, START + timedelta(milliseconds=t), i, kind) for c, t, i, kind in part], schema).coalesce(1).write.parquet(f"{tmp_path}/in/f={k}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    out = run_available(gather(stream, delay, "10 minutes"), "bursts").collect()
    micros = lambda ts: bursts.micros(ts) - bursts.micros(START)
    found = {(r.channel, micros(r.flushed) // 1000): (r.notices, r.everything, r.changed, r.removed) for r in out}
    assert len(found) == len(out)
    assert found == naive([r for part in files[:3] for r in part], delay, restart)
    if restart:
        table = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        twin = {(r.channel, micros(r.flushed) // 1000): (r.notices, r.everything, r.changed, r.removed) for r in bursts.debounced(table, delay).collect()}
        assert {k: v for k, v in twin.items() if k[0] != "end"} == found


def test_notices_without_time_or_channel_and_empty_tables(spark):
    rows = [(None, START, "a", "add"), ("c", None, "a", "add"), ("c", START, "a", None)]
    frame = spark.createDataFrame(rows, "channel string, ts timestamp, id string, kind string")
    (row,) = bursts.debounced(frame).collect()
    assert (row.channel, row.notices, row.changed) == ("c", 1, ["a"])
    assert bursts.debounced(frame.limit(0)).count() == 0


def test_one_timer_gives_all_flushes_that_the_watermark_has_passed():
    """The waiting notices are read once at a watermark, not once for each flush that it has passed."""
    from types import SimpleNamespace as Some

    class State:
        value, reads = None, 0

        def exists(self):
            return self.value is not None

        def get(self):
            self.reads += 1
            return self.value

        def update(self, value):
            self.value = value

        def clear(self):
            self.value = None

    state, timers = State(), []
    flusher = bursts.Flusher(250_000, restart=False)
    flusher.init(Some(getValueState=lambda *_: state, registerTimer=timers.append))
    rows = [Some(ts=START + timedelta(seconds=k), id=str(k), kind="add") for k in range(50)]
    assert list(flusher.handleInputRows(("c",), iter(rows), None)) == []
    assert timers == [(bursts.micros(START) + 250_000) // 1000]
    watermark = bursts.micros(START + timedelta(seconds=40)) // 1000
    found = list(flusher.handleExpiredTimer(("c",), Some(getCurrentWatermarkInMs=lambda: watermark), Some(getExpiryTimeInMs=lambda: timers[0])))
    assert [r.changed for r in found] == [[str(k)] for k in range(40)] and state.reads == 1
    # The next flush has a timer of its own.
    assert timers[1:] == [(bursts.micros(START) + 40_250_000) // 1000]


def test_bursts_are_held_slice_by_slice(monkeypatch):
    """However many notices wait, a channel is never read or written as one value; parts of a burst may lie in many slices."""
    from types import SimpleNamespace as Some

    monkeypatch.setattr(bursts, "CHUNK", 40)
    monkeypatch.setattr(bursts, "SLICE", 3)
    held, count, timers = {}, [], []
    parts = Some(keys=lambda: iter(list(held)), getValue=held.__getitem__, updateValue=held.__setitem__, removeKey=held.pop)
    added = Some(exists=lambda: bool(count), get=lambda: count[-1], update=count.append)
    random.seed(7)
    times = sorted(random.sample(range(0, 4_000_000, 1_000), 700))
    rows = [("c", t, None if t % 97 == 0 else str(t // 1000 % 5), random.choice(["add", "delete"])) for t in times]
    want, found, delay = naive(rows, 9_000, True), {}, 9_000
    burster = bursts.Burster(delay)
    burster.init(Some(getMapState=lambda *_: parts, getValueState=lambda *_: added, registerTimer=timers.append))
    shuffled = random.sample(rows, len(rows))
    assert list(burster.handleInputRows(("c",), (Some(ts=START + timedelta(microseconds=t), id=i, kind=k) for _, t, i, k in shuffled), None)) == []
    assert len(held) > 100 and max(len(v[0]) for v in held.values()) < 2_000
    for at in (500, 501, 2_000, 2_400, 9_000):
        watermark = bursts.micros(START) // 1000 + at
        for r in burster.handleExpiredTimer(("c",), Some(getCurrentWatermarkInMs=lambda w=watermark: w), None):
            due = bursts.micros(r.flushed) - bursts.micros(START)
            assert due <= at * 1000 and due not in found
            found["c", due] = (r.notices, r.everything, r.changed, r.removed)
        assert all(key in found for key in want if key[1] <= at * 1000)
    assert found == want and not held


@pytest.mark.parametrize(("chunk", "slice_", "seed"), [(40, 256, 1), (40, 3, 2), (7, 16, 3), (1_000, 1, 4)])
def test_notices_are_held_slice_by_slice(monkeypatch, chunk, slice_, seed):
    """However many notices wait, no value of the state has more than two chunks of them; late ones move the flushes after them."""
    from types import SimpleNamespace as Some

    monkeypatch.setattr(bursts, "CHUNK", chunk)
    monkeypatch.setattr(bursts, "SLICE", slice_)
    held, count, timers, sizes = {}, [], [], []
    parts = Some(keys=lambda: iter(list(held)), getValue=held.__getitem__, removeKey=held.pop, updateValue=lambda k, v: (sizes.append(k[3]), held.__setitem__(k, v)))
    added = Some(exists=lambda: bool(count), get=lambda: count[-1], update=count.append)
    random.seed(seed)
    delay = 9_000
    times = random.choices(range(0, 4_000_000, 500), k=1_500) + [1_000_000] * 5
    rows = [("c", t, None if t % 97_000 == 0 else str(random.randint(0, 9)), random.choice(["add", "delete"])) for t in times]
    want, found = naive(rows, delay, False), {}
    slicer = bursts.Slicer(delay)
    slicer.init(Some(getMapState=lambda *_: parts, getValueState=lambda *_: added, registerTimer=timers.append))

    def come(new):
        new = new + random.choices(new, k=len(new) // 5)  # some come twice
        assert list(slicer.handleInputRows(("c",), (Some(ts=START + timedelta(microseconds=t), id=i, kind=k) for _, t, i, k in random.sample(new, len(new))), None)) == []

    waiting, at = random.sample(rows, len(rows)), 0
    while at < 4_100:
        # What the watermark has passed must have come; of the rest, a part comes now and a part later.
        coming = [r for r in waiting if r[1] < (at + 200) * 1000 or random.random() < 0.2]
        waiting = [r for r in waiting if r not in coming]
        if coming:
            come(coming)
        at += random.choice([1, 7, 60, 200])
        before = len(timers)
        for r in slicer.handleExpiredTimer(("c",), Some(getCurrentWatermarkInMs=lambda: bursts.micros(START) // 1000 + at), None):
            due = bursts.micros(r.flushed) - bursts.micros(START)
            assert due <= at * 1000 and ("c", due) not in found
            found["c", due] = (r.notices, r.everything, r.changed, r.removed)
        assert all(key in found for key in want if key[1] <= at * 1000)
        assert bool(held) == (len(timers) > before) and all(t > bursts.micros(START) // 1000 + at for t in timers[before:])
    assert found == want and not held
    assert max(sizes) <= 2 * chunk
