import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from vellum.llm import collocations

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, top):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            words = re.findall(r"[^ \t]+", piece)
            n[lang] += len(words)
            for size in range(1, 6):
                f[lang].update(tuple(words[k : k + size]) for k in range(len(words) - size + 1))
    out = set()
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        scored = []
        for p, a in candidates.items():
            if any(len(q) > len(p) and 100 * b >= 100 * a and any(q[k : k + len(p)] == p for k in range(len(q) - len(p) + 1)) for q, b in candidates.items()):
                continue
            score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            out.add((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return out


def texts(seed, n):
    random.seed(seed)
    words = ["the", "The", "of", "a", "b", "c", "Is", "onhe", "été", "x\xa0y", "日本", "rare1", "rare2", "zz"]
    weights = [12, 3, 9, 6, 5, 4, 3, 3, 2, 2, 2, 1, 1, 1]
    rows = []
    for k in range(n):
        parts = random.choices(words, weights, k=random.randint(0, 40))
        text = "".join(p + random.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "\x0b"]) for p in parts)
        rows.append((random.choice(["en", "en", "fr", None, "und"]), text if k % 17 else None))
    return rows + [("en", "new york city is new york city"), ("en", "")] * 12 + [("de", "a a a a a a a a a a a a a")] * 4 + rows[:9]


@pytest.mark.parametrize(("least", "top", "sizes"), [(6, 40, {}), (4, 3, {"part_words": 300, "pivot_words": 50}), (10, 2_000, {"part_words": 40, "pivot_words": 1})])
def test_as_by_brute_force(spark, monkeypatch, least, top, sizes):
    monkeypatch.setattr(collocations, "CHUNK_BYTES", 900)
    rows = texts(least, 250)
    docs = spark.createDataFrame([(lang, text, "x", 1) for lang, text in rows], "lang string, text string, word string, f int").repartition(3)
    found = collocations.collocations(docs, least, top, **sizes)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert {tuple(r) for r in found.collect()} == brute(rows, least, top)


def test_products_beyond_64_bits_are_exact(spark, monkeypatch):
    a, n, left, right = 8 * 10**15, 9 * 10**17 + 7, 9 * 10**15 + 1, 8 * 10**15 + 3
    words = spark.createDataFrame([("en", b"x", left, 1), ("en", b"y", right, 2)], "lang string, word binary, f long, id long")
    found = spark.createDataFrame([("en", (1).to_bytes(8) + (2).to_bytes(8), a)], "lang string, phrase binary, f long")
    monkeypatch.setattr(collocations, "phrases", lambda docs, least: (words, spark.createDataFrame([("en", n)], "lang string, n long"), found, 8))
    (row,) = collocations.collocations(None).collect()
    assert (row.phrase, row.score) == ("x y", 1000 * a * n // (left * right))


def test_packed_rows_hold_the_fragments():
    random.seed(2)
    sequence = np.array([random.choice([0, 1, 2, 3, 70_000, 5]) for _ in range(400)])
    for width in (4, 8):
        rows, weights = collocations._fragments(sequence, np.ones(400, np.int64), width)
        ids = np.arange(70_001)
        data = sequence.astype("<u4")
        chunk = pa.table({"lang": ["en"], "sequence": [collocations._planes(data)], "weights": [collocations._planes(np.ones(int((sequence == 0).sum()) + 1, "<u8"))]})
        known = pa.table({"known": [[{"place": int(k) - 1, "id": int(k), "f": 120} for k in ids[1:]]]})
        packed = collocations._routed(3, 50, width)(chunk, known)
        assert set(packed["part"].to_pylist()) == {0, 1, 2} and all(packed["dealt"].to_pylist())
        got, n, _, _ = collocations._unpacked(packed, width)
        assert sorted(zip(map(tuple, got.tolist()), n.tolist(), strict=True)) == sorted(zip(map(tuple, rows.tolist()), weights.tolist(), strict=True))


def test_empty_tables_and_texts(spark):
    empty = spark.createDataFrame([], "lang string, text string")
    assert collocations.collocations(empty).count() == 0
    assert collocations.collocations(spark.createDataFrame([("en", None), (None, ""), ("en", " .,\n")], "lang string, text string")).count() == 0
