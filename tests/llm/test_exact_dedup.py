import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.llm import exact_dedup as E

SCHEMA = "doc_id long, text string, keep_id string, digest string"


def brute(rows):
    """One row of each text is kept, though others repeat its doc_id."""
    groups, done = {}, set()
    for doc_id, text in rows:
        groups.setdefault(text or "", []).append(doc_id)
    out = []
    for doc_id, text in rows:
        known = [i for i in groups[text or ""] if i is not None]
        keep = max(known) if known else None
        kept = doc_id == keep and (text or "") not in done
        if kept:
            done.add(text or "")
        out.append((doc_id, keep, len(groups[text or ""]), kept, hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=repr)


ROWS = [(1, "a"), (2, "b"), (3, "a"), (4, None), (5, ""), (6, "A"), (7, "long " * 50_000), (8, "long " * 50_000), (None, "a"), (None, "only"), (None, "only"), (9, "b"), (9, "b"), (9, "c"), (9, "a")]


@pytest.mark.parametrize("history", ["doc_id % 2 = 0", "true", "false", "doc_id > 100"])
@pytest.mark.parametrize("shard", [2, 65_536])
def test_matches_brute_force_whatever_came_first(spark, history, shard):
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in ROWS], SCHEMA)
    found = E.exact_dedup(docs, F.expr(history), shard)
    assert sorted(map(tuple, found.collect()), key=repr) == brute(ROWS)


def test_empty_table(spark):
    found = E.exact_dedup(spark.createDataFrame([], SCHEMA), F.lit(True))
    assert found.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"] and found.count() == 0


def test_hash_is_minimal_and_perfect_and_misses_are_caught_by_bytes():
    digests = np.frombuffer(b"".join(hashlib.sha256(str(k).encode()).digest() for k in range(5_000)), np.uint8).reshape(-1, 32)
    levels, slots = E.build_levels(digests[:4_000])
    assert sorted(slots) == list(range(4_000))
    assert (E.find_slots(levels, digests[:4_000]) == slots).all()
    held = digests[:4_000][np.argsort(slots)]
    at = E.find_slots(levels, digests[4_000:])
    assert not ((at >= 0) & (held[np.maximum(at, 0)] == digests[4_000:]).all(axis=1)).any()
