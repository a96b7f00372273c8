import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from vellum.llm import packing, pieces

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOKENIZER = Tokenizer.from_file(PATH)
ODD = ["", " ", "a", "  two  spaces ", "x\n\ny z \n end", "<|endoftext|> and <|endoftext|>x", "\x1c a\x85 b", "日本語 テスト　x", "z" * 3_000, "tab\t word  \t", "I'll 's don't", "".join(map(chr, range(1, 0x250)))]


def want(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("pattern", [None, public_tokenizers.PATTERN])
def test_ids_of_the_whole_text(pattern):
    encode = pieces.ByteIds(open(PATH).read(), pattern=pattern)
    assert (encode.quick is None) == (pattern is None)
    random.seed(3)
    texts = ODD + ["".join(random.choice(["a", "Bc", " ", " ", "  ", "\n", "7", ".", "é", "'s", "\x1c", " "]) for _ in range(60)) for _ in range(300)]
    assert [np.frombuffer(x, "<u4").tolist() for x in encode(texts)] == [want(t) for t in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in encode(texts)] == [want(t) for t in texts]


def test_memory_of_pieces_is_bounded_and_changes_nothing(monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 3)
    monkeypatch.setattr(pieces, "LONGEST", 4)
    encode = pieces.ByteIds(open(PATH).read())
    for text in ("one two three four", "five six", "one longest six"):
        assert np.frombuffer(encode([text])[0], "<u4").tolist() == want(text)
        assert all(len(p) <= 4 for p in encode.inner.known)


def test_other_rules_are_left_to_the_tokenizer():
    rules = open(PATH).read()
    assert pieces.as_ranks(rules.replace('"add_prefix_space":false', '"add_prefix_space":true').replace('"add_prefix_space": false', '"add_prefix_space": true'), public_tokenizers.PATTERN) is None


def squares(levels, window):
    return sum(n * n for level, n in levels.items() if 0 < level < window)


def brute_level(levels, size, window):
    """The level of least sum of squares, found by trying each; ties to the fullest, a new window last."""
    best = None
    for level in sorted([k for k, n in levels.items() if n and k + size <= window], reverse=True) + [0]:
        tried = dict(levels)
        if level:
            tried[level] -= 1
        tried[level + size] = tried.get(level + size, 0) + 1
        cost = squares(tried, window)
        if best is None or cost < best[0]:
            best = cost, level
    return best[1]


@pytest.mark.parametrize("window", [16, 33])
def test_every_placement_makes_the_sum_of_squares_least(window):
    random.seed(window)
    packer = packing.Packer(window, most_open=10**9)
    for row in range(600):
        size = random.randint(1, window - 1)
        levels = {k: int(n) for k, n in enumerate(packer.counts)}
        expected = brute_level(levels, size, window)
        assert packer.level_for(size) == expected
        packer.add(row, b"\1\0\0\0" * size)
    assert packer.open == packer.counts.sum() == sum(map(len, packer.at))
    packer.close()
    sizes = [sum(len(p[2]) // 4 for p in pieces) for pieces in packer.closed]
    assert sum(s != window for s in sizes) <= window.bit_length() and all(s == window or s & (s - 1) == 0 for s in sizes)


def check(rows, docs, window):
    """Every id in one piece, windows gapless, no padding; returns the windows."""
    by_doc, by_window = {}, {}
    for r in rows:
        by_doc.setdefault(r.key, []).append(r)
        by_window.setdefault(r.sequence_id, []).append(r)
    assert by_doc.keys() == docs.keys()
    for key, found in by_doc.items():
        ids = [*want(docs[key]), 1]
        at = 0
        for r in sorted(found, key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids == ids[at : at + r.length] and len(r.ids) == r.length
            assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for found in by_window.values():
        at = 0
        for r in sorted(found, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == window or at & (at - 1) == 0
    return by_window


def test_pieces_of_all_documents(spark):
    random.seed(5)
    texts = [None, *ODD, *[" ".join(random.choice(["alpha", "beta", "gamma,", "Delta"]) for _ in range(random.randint(0, 90))) for _ in range(300)]]
    texts += texts[20:40]
    docs = dict(enumerate(texts))
    frame = spark.createDataFrame([(k, k % 7 or None, t, "x") for k, t in docs.items()], "key long, doc_id long, text string, length string").repartition(3)
    rows = packing.pack(frame, PATH, public_tokenizers.PATTERN, window=64, keep=("key", "doc_id", "length"), with_ids=True).collect()
    windows = check(rows, docs, 64)
    total = sum(len(want(t)) + 1 for t in texts)
    assert len(windows) <= total // 64 + 3 * 7
    assert packing.pack(frame.limit(0), PATH).count() == 0
    assert packing.pack(frame, PATH).columns == ["doc_id", *[c for c, _ in packing.MADE]]


def test_windows_close_when_many_are_open():
    random.seed(9)
    packer = packing.Packer(64, most_open=10)
    sizes = [random.randint(1, 200) for _ in range(400)]
    for row, size in enumerate(sizes):
        packer.add(row, b"\1\0\0\0" * size)
        assert packer.open < 10
    packer.close()
    assert sum(len(p[2]) // 4 for pieces in packer.closed for p in pieces) == sum(sizes)
