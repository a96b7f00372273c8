import random
import re

import pytest

from vellum.llm import mixing as M


def fill(sizes, weights, cap=3):
    """Water-filling by repeated reshare."""
    total, target, free = sum(sizes.values()), dict.fromkeys(sizes, 0.0), set(sizes)
    while free:
        level = (total - sum(target[s] for s in sizes if s not in free)) / sum(weights[s] for s in free)
        over = {s for s in free if level * weights[s] > cap * sizes[s]}
        for s in over or free:
            target[s] = min(level * weights[s], cap * sizes[s])
        if not over:
            break
        free -= over
    return target


@pytest.fixture
def rows():
    random.seed(5)
    names = [*"abcdefg", "Z", "é", None]
    size = lambda s: 1 if s == "c" else random.choice([3, 30, 400 if s == "a" else 50])
    return [(k, " ".join(["w"] * size(s)) + "\t\x0b", s, "clash") for k in range(3_000) for s in [random.choice(names if random.random() < 0.6 else ["a"])]]


def test_targets_and_taken(spark, rows, monkeypatch):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, target string").repartition(5)
    found = [r.asDict() for r in M.mix(docs).collect()]
    source = {r[0]: r[2] for r in rows}
    sizes = {}
    for r in rows:
        sizes[r[2]] = sizes.get(r[2], 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r[1]))
    order = sorted((s for s in sizes if s is not None)) + [None]
    target = fill(sizes, {s: (1, 2, 3)[k % 3] for k, s in enumerate(order)})
    taken = dict.fromkeys(sizes, 0)
    for r in found:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(target[s])
        assert r["taken"] == r["size"] * r["repeats"] <= 3 * r["size"]
        taken[s] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - target[s]) <= max(25, 0.02 * target[s])
    assert len(found) == len(rows)
    again = {r.doc_id: r.repeats for r in M.mix(docs.repartition(3)).collect()}
    assert again == {r["doc_id"]: r["repeats"] for r in found}


def test_nulls_empties_and_repeats(spark):
    rows = [(1, None, "a"), (2, "", None), (3, "one two", "a"), (3, "one two", "a"), (None, "x", None)]
    found = M.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert sorted(r["size"] for r in found) == [0, 0, 1, 2, 2]
    assert {r["source_size"] for r in found} == {4, 1}


def test_empty_table_and_no_words(spark):
    assert M.mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
    found = M.mix(spark.createDataFrame([(1, None, "a")], "doc_id long, text string, source string")).collect()
    assert [(r["target"], r["taken"]) for r in found] == [(0.0, 0)]
