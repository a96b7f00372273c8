import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from vellum.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
VOCABULARY = bpe.load_vocabulary(PATH, public_tokenizers.PATTERN)
REFERENCE = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}, special_tokens={})
ODD = ["", " a  b   c\n\n d\t e", "   ", "x   ", "日本語 テスト  漢字", "a" * 3_000, "<|endoftext|> ok", "I'll don't 's  s", "é ​　x\x1c \x85y", "0" * 2_000 + "abc" * 900, "\U0001f600 \U0001f600\U0001f600"]


def ids(texts):
    return [np.frombuffer(x, "<u4").tolist() for x in bpe.Encoder(VOCABULARY).encode(texts)]


def test_odd_texts_as_the_library():
    assert ids(ODD) == [REFERENCE.encode_ordinary(t) for t in ODD]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(codec="utf-8"), max_size=60), max_size=4))
def test_any_text_as_the_library(texts):
    assert ids(texts) == [REFERENCE.encode_ordinary(t) for t in texts]


def test_words_out_of_rank_order_are_done_again():
    ranks = {bytes([b]): b for b in range(256)} | {b"abc": 256, b"bc": 300, b"aa": 301, b"aaa": 302}
    small = bpe.Vocabulary(ranks, public_tokenizers.PATTERN)
    words = [b"xabc", b"bcabcabc", b"aaaaaaa", b"aabcaa"]
    assert [x.tolist() for x in bpe.replay(small, words)] == [small.one_word(w) for w in words]


def test_memory_of_pieces_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    random.seed(1)
    texts = [" ".join(random.choice(["alpha", "betagamma", "delt", "é"]) + str(k % 3) for k in range(20)) for _ in range(8)]
    encoder = bpe.Encoder(VOCABULARY)
    got = [np.frombuffer(x, "<u4").tolist() for t in texts for x in encoder.encode([t])]
    assert got == [REFERENCE.encode_ordinary(t) for t in texts]


def test_round_trip_nulls_repeats_and_clashing_columns(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, "Hello  wörld", "c"), (3, "Hello  wörld", "c"), (None, "x", "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    found = bpe.bpe_encode(docs, PATH, public_tokenizers.PATTERN, keep=("doc_id", "n_tokens"), with_ids=True).collect()
    assert len(found) == 5
    for r, (doc_id, text, _) in zip(found, rows, strict=True):
        want = REFERENCE.encode_ordinary(text or "")
        assert (r.doc_id, r.n_tokens, r.ids, r.decoded) == (doc_id, len(want), want, text or "")
        assert r.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert bpe.bpe_encode(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0
