import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.llm import hnsw as H


def exact(rows, query_id, vector):
    d = sorted({(float(np.sqrt(((np.array(v, float) - vector) ** 2).sum())), i) for i, v in rows if i != query_id and len(v) == len(vector)})
    return d[:10]


def as_frame(spark, rows, kind="float"):
    return spark.createDataFrame([(i, v, "clash") for i, v in rows], f"vec_id long, embedding array<{kind}>, score string").repartition(3)


def found_of(spark, rows):
    found = {}
    for r in H.nearest(as_frame(spark, rows), F.pmod("vec_id", F.lit(100)) == 0).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return {q: sorted(x) for q, x in found.items()}


@pytest.mark.parametrize("shard", [150, 4_096])
def test_recall_and_exact_scores(spark, monkeypatch, shard):
    monkeypatch.setattr(H, "SHARD_VECTORS", shard)
    rng = np.random.default_rng(0)
    rows = [(k, rng.normal(size=24).astype(np.float32).tolist()) for k in range(1_200)]
    found = found_of(spark, rows)
    hit = 0
    for q, got in found.items():
        want = exact(rows, q, np.array(rows[q][1]))
        scores = {i: float(np.sqrt(((np.array(v, float) - np.array(rows[q][1])) ** 2).sum())) for i, v in rows}
        assert [r for r, _, _ in got] == list(range(1, 11)) and all(s == scores[i] for _, i, s in got)
        hit += len({i for _, i, _ in got} & {i for _, i in want})
    assert len(found) == 12 and hit / (10 * len(found)) >= 0.95


def test_one_large_graph_has_high_recall():
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(3_000, 32))
    graph = H.Graph.build(vectors, H._levels(len(vectors), 1))
    hit = 0
    for q in rng.normal(size=(30, 32)):
        want = np.argsort(((vectors - q) ** 2).sum(axis=1))[:10]
        hit += len(set(want) & set(graph.search(q, H.SEARCH_WIDTH)))
    assert hit >= 0.95 * 300


def test_copies_ties_and_unusable_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(k, [1.0, 0.0]) for k in range(0, 60)] + [(100, [1.0, 0.0]), (200, [0.0, 2.0, 0.0]), (201, [0.0, 1.0, 0.0])]
    rows += [(300, None), (400, [0.0, 0.0]), (500, [nan, 1.0]), (600, [None, 1.0]), (700, [inf, 1.0]), (800, []), (None, [1.0, 0.0]), (100, [1.0, 0.0])]
    found = found_of(spark, rows)
    assert [i for _, i, _ in found[0]] == list(range(1, 11)) and [i for _, i, _ in found[100]] == list(range(10))
    assert found[200] == [(1, 201, 1.0)] and set(found) == {0, 100, 200}


def test_empty_table(spark):
    assert H.nearest(as_frame(spark, []), F.lit(True)).count() == 0
    assert H.nearest(as_frame(spark, [(0, [1.0])]), F.lit(True)).count() == 0


@pytest.mark.parametrize("sf, shard, block", [("0.001", 16_384, 8_192), ("0.01", 60, 2), ("0.1", 16_384, 8_192), ("0.1", 400, 7)])
def test_recall_on_the_embeddings(spark, monkeypatch, sf, shard, block):
    path = f"/root/testdata/sf{sf}/embeddings.parquet"
    if not os.path.exists(path):
        pytest.skip("needs the test tables")
    monkeypatch.setattr(H, "SHARD_VECTORS", shard)
    monkeypatch.setattr(H, "QUERY_BLOCK", block)
    table = spark.read.parquet(path)
    rows = [(r.vec_id, np.array(r.embedding, float)) for r in table.collect()]
    ids, vectors = np.array([i for i, _ in rows]), np.stack([v for _, v in rows])
    found = {}
    for r in H.nearest(table, F.pmod("vec_id", F.lit(100)) == 0).collect():
        found.setdefault(r.query_id, []).append(r.vec_id)
    hit = 0
    for q, got in found.items():
        own = vectors[ids == q][0]
        far = ((vectors - own) ** 2).sum(axis=1)
        far[ids == q] = np.inf
        hit += len(set(ids[np.argsort(far)[:10]]) & set(got))
    assert len(found) == sum(i % 100 == 0 for i in ids) and hit >= 0.95 * sum(map(len, found.values()))
