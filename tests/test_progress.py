import random
from datetime import date, datetime, timedelta

import pytest

from vellum.operators import progress as P

START = datetime(2024, 1, 1)
PERIODS = [("w1", date(2024, 1, 1), date(2024, 1, 7)), ("w2", date(2024, 1, 8), date(2024, 1, 14)), ("both", date(2024, 1, 3), date(2024, 1, 12)), ("none", date(2024, 3, 2), date(2024, 3, 1)), ("late", date(2024, 2, 1), date(2024, 2, 3))]


def moments(seed, n, last=20):
    random.seed(seed)
    return [START + timedelta(hours=random.randrange(24 * last)) for _ in range(n)]


@pytest.fixture(scope="module")
def periods(spark):
    return spark.createDataFrame(PERIODS, "period string, start date, end date")


def inside(at, p):
    return p[1] <= at.date() <= p[2]


@pytest.mark.parametrize("before", [False, True])
def test_as_of(spark, before):
    facts = [(random.choice("ab"), at, k) for k, at in enumerate(moments(1, 40))] + [(None, START, 1), ("a", None, 2), ("a", START + timedelta(hours=5), 100), ("a", START + timedelta(hours=5), 99)]
    rows = [(k, random.choice("abc"), at) for k, at in enumerate(moments(2, 60))] + [(90, "a", START + timedelta(hours=5)), (91, None, START), (92, "a", None)]
    got = P.as_of(spark.createDataFrame(rows, "id int, k string, at timestamp"), spark.createDataFrame(facts, "k string, at timestamp, v int"), "k", "at", ["v"], before)
    found = {r.id: (r.fact_time, r.v) for r in got.collect()}
    for k, key, at in rows:
        past = [(t, v) for f, t, v in facts if f is not None and f == key and t and at and (t < at or (t == at and not before))]
        assert found[k] == (max(past) if past else (None, None)), k


def test_status_changes(spark, periods):
    log = [(random.choice("abc"), at, random.choice(["x", "y", None]), random.choice(["x", "y", "z"])) for at in moments(3, 60)]
    got = {(r.period, r.key): (r.before, r.after, r.entries) for r in P.status_changes(spark.createDataFrame(log + [(None, START, "x", "y")], "key string, at timestamp, old string, new string"), periods).collect()}
    want = {}
    for p in PERIODS:
        for key in "abc":
            own = sorted((r for r in log if r[0] == key and inside(r[1], p)), key=lambda r: (r[1], r[3]))
            if own and own[0][2] != own[-1][3]:
                want[p[0], key] = (own[0][2], own[-1][3], len(own))
    assert got == want


def test_snapshots_and_totals(spark, periods):
    snaps = [(random.choice("ab"), at, k, -k) for k, at in enumerate(moments(4, 25))]
    got = {(r.review, r.period): (r.x, r.y, r.x_change, r.y_change) for r in P.snapshot_changes(spark.createDataFrame(snaps + [("c", None, 1, 1)], "review string, at timestamp, x int, y int"), periods, ["x", "y"]).collect()}
    want = {}
    for p in PERIODS:
        for review in "ab":
            past = lambda day: max(((t, x, y) for r, t, x, y in snaps if r == review and t < datetime.combine(day, datetime.min.time())), default=None)  # noqa: E731,B023
            now, then = past(p[2] + timedelta(1)), past(p[1])
            if now:
                want[review, p[0]] = (now[1], now[2], now[1] - then[1] if then else None, now[2] - then[2] if then else None)
    assert got == want

    versions = [(random.choice("abc"), at, random.choice([None, 10, 25, 300])) for at in moments(5, 40)]
    got = {r.period: (r.total, r.change, r.updated) for r in P.totals_by_period(spark.createDataFrame(versions, "draft string, at timestamp, words int"), periods).collect()}
    state = lambda day: sum(max((t, w or 0) for d, t, w in versions if d == draft and t.date() <= day)[1] for draft in "abc" if any(d == draft and t.date() <= day for d, t, _ in versions))
    assert got == {p[0]: (state(p[2]), state(p[2]) - state(p[1] - timedelta(1)), len({d for d, t, _ in versions if inside(t, p)})) for p in PERIODS}


def test_dated_counts_and_empty_tables(spark, periods):
    items = [(at, random.choice([None, at + timedelta(days=3)])) for at in moments(6, 30)]
    got = {r.period: (r.added, r.read) for r in P.dated_counts(spark.createDataFrame(items, "added timestamp, read timestamp"), periods, ["added", "read"]).collect()}
    assert got == {p[0]: tuple(sum(x[k] is not None and inside(x[k], p) for x in items) for k in (0, 1)) for p in PERIODS}
    empty = spark.createDataFrame([], "draft string, at timestamp, words int")
    assert {(r.total, r.change, r.updated) for r in P.totals_by_period(empty, periods).collect()} == {(0, 0, 0)}
    assert P.snapshot_changes(spark.createDataFrame([], "review string, at timestamp, x int"), periods, ["x"]).count() == 0
