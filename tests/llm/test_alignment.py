import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from vellum.llm import alignment, pieces

FIRST, SECOND = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
A = Tokenizer.from_file(FIRST)
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=SECOND)
ODD = [None, "", " ", "a", "  two  spaces ", "x\n\ny z \n end", "<|endoftext|> <s> </s>", "▁under ▁ x", "日本語 テスト　x", "z" * 700, "tab\t word  \t", "naïve café — x", "\U0001f600\U0001f600 é​"]


def token_bytes():
    letters = pieces.byte_letters()
    a = {k: bytes(letters[c] for c in t) for t, k in A.get_vocab().items() if t != "<|endoftext|>"}
    b = {k: bytes([int(B.id_to_piece(k)[3:5], 16)]) if B.is_byte(k) else B.id_to_piece(k).replace("▁", " ").encode() for k in range(B.get_piece_size())}
    return a, b


def brute(texts):
    """Groups by an explicit walk with two pointers, links as all pairs, counts by document."""
    of_a, of_b = token_bytes()
    groups = []
    for text in texts:
        found = []
        if text:
            a, b = A.encode(" " + text, add_special_tokens=False).ids, B.encode(text)
            if b"".join(of_a[i] for i in a) == (" " + text).encode() == b"".join(of_b[i] for i in b):
                i = j = at_a = at_b = 0
                now = [], []
                while i < len(a) or j < len(b):
                    if at_a <= at_b and i < len(a):
                        now[0].append(a[i])
                        at_a += len(of_a[a[i]])
                        i += 1
                    else:
                        now[1].append(b[j])
                        at_b += len(of_b[b[j]])
                        j += 1
                    if at_a == at_b:
                        found.append(now)
                        now = [], []
        groups.append(found)
    links = [[(x, y) for a, b in found for x in a for y in b] for found in groups]
    count = Counter(p for found in links for p in set(found))
    highest = defaultdict(int)
    for (x, _), n in count.items():
        highest[x] = max(highest[x], n)
    rows = [
        (
            sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(f), sum(count[p] == highest[p[0]] for p in f), sum(count[p] for p in f),
            ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g),
        )
        for g, f in zip(groups, links, strict=True)
    ]
    return rows, count, highest


@pytest.mark.parametrize("block", [300, 2_000_000])
def test_documents_and_pairs_as_by_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(alignment, "BLOCK_CHARS", block)
    monkeypatch.setattr(alignment, "WIDE", 256 if block > 300 else 2)
    random.seed(8)
    texts = ODD + [" ".join(random.choice(["alpha", "unbelievably", "Größe", "don't", "1234567", "x.y", "日本", "the", "the,\nand"]) for _ in range(random.randint(1, 40))) for _ in range(60)]
    texts += texts[15:20]
    want, count, highest = brute(texts)
    frame = spark.createDataFrame([(k, None if k % 5 == 0 else k, t, "q") for k, t in enumerate(texts)], "key long, doc_id long, text string, n_a string").repartition(3)
    found, pairs = alignment.align(frame, FIRST, SECOND, None if block == 300 else public_tokenizers.PATTERN, keep=("key", "n_a"))
    assert found.columns == ["key", *[n for n, _ in alignment.MADE], "n_best", "count_sum"]
    assert {r.key: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups) for r in found.collect()} == dict(enumerate(want))
    assert {(r.a, r.b): (r.n, r.best) for r in pairs.collect()} == {p: (n, n == highest[p[0]]) for p, n in count.items()}


def test_digests_empty_tables_and_groups_in_parts(spark, monkeypatch):
    frame = spark.createDataFrame([(1, "one two"), (2, None)], "doc_id long, text string")
    rows, _, _ = brute(["one two"])
    found = {r.doc_id: r.groups for r in alignment.align(frame, FIRST, SECOND, with_groups=False)[0].collect()}
    assert found == {1: hashlib.sha256(rows[0][6].encode()).hexdigest(), 2: ""}
    assert alignment.align(frame.limit(0), FIRST, SECOND)[0].count() == 0
    monkeypatch.setattr(alignment, "LINKS", 3)
    a, b = [5, 6, 5, 7, 8], [1, 2, 1, 3]
    found = Counter()
    for pairs, times in alignment.wide_links(np.array(a), np.array(b)):
        assert len(pairs) <= 3
        found.update(dict(zip(pairs.tolist(), times.tolist(), strict=True)))
    assert found == Counter(x * alignment.SIDE + y for x in a for y in b)


def test_texts_are_whole_where_tokens_join_words():
    sides = alignment.Sides(open(FIRST).read(), open(SECOND, "rb").read())
    assert sides.by_piece
    texts = [t or "" for t in ODD]
    by_piece = sides.encode(texts)
    sides.by_piece = False
    assert sides.encode(texts) == by_piece
