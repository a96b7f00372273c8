import random
import zlib

import numpy as np
import pytest

from vellum.llm import passages as P

SCHEMA = "doc_id long, text string, passage string"


def prose(rng, n, low=6, high=18):
    """Sentences of made-up words, n words or a few more."""
    words = []
    while len(words) < n:
        sentence = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(low, high))]
        words += [sentence[0].capitalize(), *sentence[1:-1], sentence[-1] + "."]
    return words


def shingles(words):
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)}


def brute(docs):
    """Passages from all pairs of paragraphs compared by exact Jaccard similarity."""
    units = []
    for doc_id, text in docs:
        if doc_id is not None and text is not None:
            words, _, first, length = P.paragraphs(text.encode())
            units += [(doc_id, a, n, shingles([w.decode() for w in words[a : a + n]])) for a, n in zip(first.tolist(), length.tolist(), strict=True) if n >= P.LEAST_WORDS]
    root = list(range(len(units)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(units):
        for j in range(i):
            both = len(a[3] & units[j][3])
            if both >= 0.8 * len(a[3] | units[j][3]):
                root[find(i)] = find(j)
    docs_of = {}
    for i, u in enumerate(units):
        docs_of.setdefault(find(i), set()).add(u[0])
    found = {}
    for i, u in enumerate(units):
        if len(docs_of[find(i)]) > 1:
            found.setdefault(u[0], {})[u[1]] = (u[2], min(docs_of[find(i)]))
    rows = set()
    for doc_id, places in found.items():
        runs = []
        for a in sorted(places):
            if runs and a - runs[-1][1] <= P.BRIDGE_WORDS:
                runs[-1][1] = a + places[a][0]
            else:
                runs.append([a, a + places[a][0], places[a][1]])
        rows |= {(doc_id, k, a, b - a, keep, keep != doc_id) for k, (a, b, keep) in enumerate(runs, 1) if b - a >= P.LEAST_PASSAGE}
    return rows


def corpus(seed):
    rng = random.Random(seed)
    shared = [prose(rng, 60) for _ in range(3)]
    docs = [(k, " ".join(prose(rng, 80)) + "\n" + " ".join(prose(rng, 40))) for k in range(20)]
    for k in range(20, 45):
        own, planted = prose(rng, 120), list(shared[k % 3])
        if k % 4 == 0:
            planted[rng.randrange(20, len(planted))] = "changed"
        at = rng.randrange(len(own))
        docs.append((k, " ".join(own[:at] + planted + own[at:])))
    return docs, set(range(20, 45))


@pytest.mark.parametrize("seed", [1, 2])
def test_planted_passages_are_found_and_clean_documents_left_alone(spark, seed):
    docs, planted = corpus(seed)
    got = P.repeated_passages(spark.createDataFrame([(*d, "clash") for d in docs], SCHEMA).repartition(3)).collect()
    # A changed word can leave less of a passage than LEAST_PASSAGE; the exact copies are all found.
    assert {k for k in planted if k % 4} <= {r.doc_id for r in got} <= planted
    assert all(r.keep_doc_id % 3 == r.doc_id % 3 and r.keep_doc_id <= r.doc_id and r.removed == (r.doc_id != r.keep_doc_id) for r in got)


def test_same_as_comparing_all_paragraphs(spark):
    docs, _ = corpus(7)
    docs += [(100, docs[21][1]), (101, docs[21][1].replace(" ", "\n", 1)), (102, "same words here again and again now stop. " * 40), (103, "Other. " + "same words here again and again now stop. " * 25)]
    got = P.repeated_passages(spark.createDataFrame([(*d, "c") for d in docs], SCHEMA)).collect()
    assert {tuple(r) for r in got} == brute(docs)


def test_crowded_bands_are_dealt_anew(spark, monkeypatch):
    monkeypatch.setattr(P, "CROWD", 3)
    docs, _ = corpus(3)
    got = P.repeated_passages(spark.createDataFrame([(*d, "c") for d in docs], SCHEMA)).collect()
    assert {tuple(r) for r in got} == brute(docs)


def test_dividing_crowds_changes_nothing(spark, monkeypatch):
    """Hundreds of texts with one common phrase, some of them similar, on both sides of the bound and far below it."""
    rng = random.Random(12)
    phrase = "all rights reserved by the lovely firm of this country".split()
    docs = []
    for k in range(0, 240, 2):
        own = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(14)]
        near = [*own[:-1], "other"] if k % 4 else own[::-1]
        docs += [(k, " ".join(phrase + own)), (k + 1, " ".join(phrase + near))]
    docs += [(1_000 + k, " ".join([*phrase, *("same words stand here in all of the many copies of it".split()), f"n{k}"])) for k in range(60)]
    # No cuts: a text is one paragraph.
    whole = lambda data: (w := data.lower().split(), np.fromiter(map(zlib.crc32, w), np.uint64, len(w)), np.zeros(1, np.int64), np.array([len(w)]))
    monkeypatch.setattr(P, "paragraphs", whole)
    frame = spark.createDataFrame([(*d, "c") for d in docs], SCHEMA)
    found = []
    for crowd in (1, 59, 60, 61, 10**9):
        monkeypatch.setattr(P, "CROWD", crowd)
        found.append({tuple(r) for r in P.repeated_paragraphs(frame).collect()})
    assert all(f == found[0] for f in found)
    similar = {d for k in range(0, 240, 2) if k % 4 for d in (k, k + 1)} | {1_000 + k for k in range(60)}
    assert {r[0] for r in found[0]} == similar


def test_bands_follow_the_wanted_recall():
    assert [P.tuned_bands(0.8, r) for r in (0.5, 0.8, 0.95, 0.99, 0.9999)] == [1, 1, 2, 3, 6] and P.tuned_bands(0.8, 0.99, 2) == 5


def test_least_passage_is_a_parameter(spark):
    rng = random.Random(13)
    text = " ".join(prose(rng, 12)[:12])
    frame = spark.createDataFrame([(1, text, "c"), (2, text, "c")], SCHEMA)
    assert P.passage_removals(frame).count() == 0 and P.passage_removals(frame, least_passage=6).count() == 2


def test_nulls_empties_repeats_and_long_texts(spark):
    rng = random.Random(5)
    text, long = " ".join(prose(rng, 60)), " ".join(prose(rng, 30_000))
    docs = [(1, None), (2, ""), (3, "a b"), (None, text), (4, text), (4, text), (5, long), (6, long), (7, "!! " * 500), (8, "x\n" * 500)]
    got = {tuple(r) for r in P.repeated_passages(spark.createDataFrame([(*d, "c") for d in docs], SCHEMA)).collect()}
    assert {r[0] for r in got} == {5, 6} and all(r[4] == 5 for r in got)
    assert sum(r[3] for r in got if r[0] == 6) > 0.95 * 30_000
    assert P.repeated_passages(spark.createDataFrame([], SCHEMA)).count() == 0


def test_paragraphs_cover_all_words_in_order():
    rng = random.Random(2)
    for text in ["", "one", "A. b. c.", " ".join(prose(rng, 500, 1, 90)), "w! " * 300, "x\n\ny\n" * 20, "no stops at all " * 100]:
        words, _, first, length = P.paragraphs(text.encode())
        assert words == text.encode().lower().split() and length.sum() == len(words)
        assert (first[1:] == first[:-1] + length[:-1]).all()


@pytest.mark.parametrize("common_first", [True, False])
def test_what_has_another_keeper_is_another_passage(spark, common_first):
    rng = random.Random(11)
    common, text = " ".join(prose(rng, 60)), " ".join(prose(rng, 90))
    both = "\n".join([common, text] if common_first else [text, common])
    docs = [(1, common), (5, both), (9, both)]
    rows = P.passage_removals(spark.createDataFrame([(*d, "c") for d in docs], SCHEMA)).collect()
    kept = {}  # the documents that keep each word of either part
    for r in rows:
        words = both.lower().split() if r.doc_id > 1 else common.lower().split()
        for w in words[r.first_word : r.first_word + r.n_words]:
            kept.setdefault(w, set()).update([] if r.removed else [r.doc_id])
    # A paragraph over the border of the two parts belongs to neither; a word of both parts is kept in both.
    parts = [(p.lower().split()[20:-20], keeper) for p, keeper in ((common, 1), (text, 5))]
    for own, keeper in parts:
        assert all(kept[w] == {keeper} for w in own if common.lower().split().count(w) + text.lower().split().count(w) == 1)


def wrapped(words, width):
    return "\n".join(" ".join(words[k : k + width]) for k in range(0, len(words), width))


def pasted(rng, shared, width):
    own = [w.strip(".") for w in prose(rng, 200)]
    at = rng.randrange(len(own))
    return wrapped([w.lower() for w in own[:at]] + shared + [w.lower() for w in own[at:]], width)


def sharing(docs, n):
    """Documents that have n words in a row with another one, line ends aside."""
    having = {}
    for doc_id, text in docs:
        words = text.lower().split()
        for k in range(len(words) - n + 1):
            having.setdefault(tuple(words[k : k + n]), set()).add(doc_id)
    return set().union(*[d for d in having.values() if len(d) > 1])


def test_short_lines_and_other_widths(spark):
    rng = random.Random(4)
    docs = []
    for k in range(0, 40, 2):
        shared = [w.strip(".").lower() for w in prose(rng, 90)]
        docs += [(k, pasted(rng, shared, rng.randint(3, 7))), (k + 1, pasted(rng, shared, rng.randint(3, 12)))]
    docs += [(100 + k, pasted(rng, [], 5)) for k in range(10)]
    verse = wrapped([w.strip(".") for w in prose(rng, 2_000)], 6)
    docs += [(200, verse), (201, verse)]
    rows = P.passage_removals(spark.createDataFrame([(*d, "c") for d in docs], SCHEMA)).collect()
    assert {r.doc_id for r in rows} == sharing(docs, 80)
    assert sum(r.n_words for r in rows if r.doc_id == 201 and r.removed) >= 2_000


def test_all_words_lie_in_paragraphs_long_enough():
    rng = random.Random(3)
    for text in [wrapped(prose(rng, 300), 4), "w! " * 300, "x\n\ny\n" * 20, "a b c d e f g h"]:
        words, _, _, length = P.paragraphs(text.encode())
        assert length.min() >= P.LEAST_WORDS and length.sum() == len(words)


def test_passages_of_51_to_100_words_without_punctuation_are_found(spark):
    rng = random.Random(6)
    docs, lengths = [], {}
    for k in range(0, 200, 2):
        shared = [w.strip(".").lower() for w in prose(rng, 110)][: rng.randint(51, 100)]
        lengths[k] = len(shared)
        docs += [(k, pasted(rng, shared, 10_000)), (k + 1, pasted(rng, shared, 10_000))]
    rows = P.passage_removals(spark.createDataFrame([(*d, "c") for d in docs], SCHEMA)).collect()
    wanted = sharing(docs, 51)
    assert len(wanted) == 200 and {r.doc_id for r in rows} <= wanted
    assert len({r.doc_id for r in rows}) >= 0.97 * len(wanted)
    assert {k for k, n in lengths.items() if n >= 65} <= {r.doc_id for r in rows}
