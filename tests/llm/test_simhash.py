import random
import re

import numpy as np
import pytest
import xxhash

from vellum.llm import simhash as S
from vellum.operators.components import connected_components


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(ids, values):
    root = dict(zip(ids, ids, strict=True))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in zip(ids, values, strict=True):
        for j, b in zip(ids, values, strict=True):
            if (a ^ b).bit_count() <= 2 and find(i) != find(j):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return {i: find(i) for i in ids}


def test_fingerprints():
    for text in ["", "  \n", "One", "One two", "One  TWO\tthree", "É é İ É", "a b c d e f g " * 9_000, "x y z x y z x y z"]:
        assert S.fingerprint(text.encode()) == slow_fingerprint(text)


@pytest.mark.parametrize("shard", [8, 8_192])
def test_components_match_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(S, "SHARD_FINGERPRINTS", shard)
    random.seed(3)
    base = [" ".join(random.choice("abcdefgh") * 3 for _ in range(400)) for _ in range(12)]
    texts = [None, "", "x", "X"]
    for text in base:
        words = text.split()
        for _ in range(6):
            words[random.randrange(400)] = random.choice("abcdefgh")
            texts.append(" ".join(words))
    rows = [(1_000 - k, t, "clash") for k, t in enumerate(texts)] + [(None, base[0], "clash"), (5, texts[7], "clash"), (5, texts[7], "clash")]
    got = S.simhash_groups(spark.createDataFrame(rows, "doc_id long, text string, fp string")).collect()
    want = slow_components([r[0] for r in rows if r[0]], [slow_fingerprint(r[1]) for r in rows if r[0]])
    assert len(got) == len(rows)
    assert {r.doc_id: r.component_id for r in got if r.doc_id} == want
    assert all(int(r.fingerprint, 16) == slow_fingerprint(dict((x[0], x[1]) for x in rows)[r.doc_id]) for r in got)


def test_a_common_leading_block_reaches_over_shards(spark, monkeypatch):
    monkeypatch.setattr(S, "SHARD_FINGERPRINTS", 16)
    rng = np.random.default_rng(1)
    near = [0xABCDEF0123456789 ^ sum(1 << int(b) for b in rng.choice(40, 3, replace=False)) for _ in range(150)]
    values = sorted({v - (1 << 64) if v >> 63 else v for v in [*near, *(int(x) for x in rng.integers(0, 1 << 63, 100))]})
    links = connected_components(S.near_links(spark.createDataFrame([(v,) for v in values], "fp long"))).collect()
    got = {v: v for v in values} | {r.node: r.root for r in links}
    want = slow_components(values, [v & (1 << 64) - 1 for v in values])
    groups = lambda roots: sorted(sorted(v for v in values if roots[v] == r) for r in set(roots.values()))
    assert groups(got) == groups(want)


def test_tree_finds_all_within_the_limit():
    rng = np.random.default_rng(2)
    values = np.unique(rng.integers(0, 1 << 12, 700).astype(np.uint64))
    values = values[np.argsort(S.gray_rank(values))]
    probe, leaf = S.GrayTree(values, np.full(len(values), ~np.uint64(0))).within(values, 2)
    want = {(a, b) for a in range(len(values)) for b in range(len(values)) if int(values[a] ^ values[b]).bit_count() <= 2}
    assert set(zip(probe.tolist(), leaf.tolist(), strict=True)) == want


def test_empty_table(spark):
    assert S.simhash_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_chains_stars_and_repeats(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 7), (7, 7), (None, 3), (2, 1)]
    found = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 130)}
