"""Alignment of two tokenizers over a corpus, and how surely each id goes with one of the other side.

Both token streams of a text cover the same bytes. A two-pointer merge of their cumulative
ends cuts them into groups where both end; tokens that share a group are linked. The texts
of a block are laid end to end, so one merge of two ascending lists does them all: every
text is a place where both end.

A task deals its rows into blocks of BLOCK_CHARS and gives, of each block, the distinct
linked pairs with the number of documents that hold them, and of each document the places
of its pairs in that list. Spark sums the counts by pair, finds the highest count of every
id of the first side, and joins both back to the blocks' lists: a pair that every document
holds is one row a block. The lists then meet the documents of their block.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import chunks, ship, store
from vellum.llm.pieces import ByteIds, Remembered, byte_letters, pieces_of

#: Characters of the texts of a block (a longer text is a block of its own).
BLOCK_CHARS = 2_000_000
#: Groups of more links than this are laid out by their distinct ids, others link by link.
WIDE = 256
#: Pairs of distinct ids that are laid out at once for one wide group.
LINKS = 1 << 20
#: Place of the first side's id in the number of a pair.
SIDE = 1 << 32


class Sides:
    """Both tokenizers with the bytes of every id."""

    def __init__(self, definition: str, model: bytes, pattern: str | None = None):
        import sentencepiece

        self.first = ByteIds(definition, plain_specials=True, pattern=pattern)
        self.second = sentencepiece.SentencePieceProcessor(model_proto=model)
        letters = byte_letters()
        vocabulary = self.first.tokenizer.get_vocab()
        self.first_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, k in vocabulary.items():
            self.first_bytes[k] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        tokens = [self.second.id_to_piece(k) for k in range(self.second.get_piece_size())]
        self.second_bytes = [bytes([int(t[1:-1], 16)]) if self.second.is_byte(k) else t.replace("▁", " ").encode() for k, t in enumerate(tokens)]
        #: Whether no token joins what stands before a space to it; if some does, texts are not cut.
        self.by_piece = not any("▁" in t.lstrip("▁") for t in tokens)
        self.remembered = Remembered(self._packed)

    def _packed(self, texts: list[str]) -> list[bytes]:
        return [array("I", ids).tobytes() for ids in self.second.encode(texts, num_threads=1)]

    def encode(self, texts: list[str]) -> tuple[list[bytes], list[bytes]]:
        """Ids of a space and each text on both sides."""
        second = [b"".join(found) for found in self.remembered([pieces_of(t) for t in texts])] if self.by_piece else self._packed(texts)
        return self.first([f" {t}" for t in texts]), second

    def aligned(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """As ``encode``; nothing on both sides where a text is empty, or where the bytes of its tokens are not its own."""
        first, second = ([np.frombuffer(ids, "<u4") for ids in side] for side in self.encode(texts))
        of_a, of_b = self.first_bytes.__getitem__, self.second_bytes.__getitem__
        for k, text in enumerate(texts):
            whole = b" " + text.encode()
            if not text or b"".join(map(of_a, first[k].tolist())) != whole or b"".join(map(of_b, second[k].tolist())) != whole:
                first[k] = second[k] = np.zeros(0, np.uint32)
        return first, second


def merged(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (one past) in both lists of ends where the same end stands, by a merge of the two ascending lists."""
    if not len(first) or not len(second):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.searchsorted(second, first)
    same = np.nonzero(second[np.minimum(at, len(second) - 1)] == first)[0]
    return same + 1, at[same] + 1


def wide_links(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a group's distinct ids with the number of their links, in parts of bounded size."""
    left, left_n = np.unique(a, return_counts=True)
    right, right_n = np.unique(b, return_counts=True)
    step = max(1, LINKS // len(right))
    for k in range(0, len(left), step):
        yield (left[k : k + step, None].astype(np.int64) * SIDE + right).ravel(), (left_n[k : k + step, None] * right_n).ravel()


class Block:
    """The groups of texts laid end to end, and what each text has of them."""

    def __init__(self, sides: Sides, texts: list[str]):
        first, second = sides.aligned(texts)
        length_a, length_b = (np.array([len(x) for x in side], np.int64) for side in (sides.first_bytes, sides.second_bytes))
        self.sizes_a, self.sizes_b = (np.array([len(x) for x in side], np.int64) for side in (first, second))
        self.a, self.b = (np.concatenate(side).astype(np.int64) if side else np.zeros(0, np.int64) for side in (first, second))
        self.cut_a, self.cut_b = merged(np.cumsum(length_a[self.a]), np.cumsum(length_b[self.b]))
        self.n_a, self.n_b = np.diff(self.cut_a, prepend=0), np.diff(self.cut_b, prepend=0)
        # The text of a group is that in which its last token stands.
        ends = np.cumsum(self.sizes_a)
        self.text_of = np.searchsorted(ends, self.cut_a - 1, side="right")
        self.texts = len(texts)

    def by_text(self, of_group: np.ndarray) -> np.ndarray:
        return np.bincount(self.text_of, of_group, self.texts).astype(np.int64)

    def written(self, names_a: list[bytes], names_b: list[bytes]) -> list[bytes]:
        """Of each text its groups as `a1,a2|b1;a3|b2`; names are the ids' digits with a comma, then the same with the sign that ends a side."""
        group_a, group_b = (np.repeat(np.arange(len(n)), n) for n in (self.n_a, self.n_b))
        half_a, half_b = len(names_a) // 2, len(names_b) // 2
        code_a, code_b = self.a.copy(), self.b + len(names_a)
        code_a[self.cut_a - 1] += half_a
        code_b[self.cut_b - 1] += half_b
        line = np.empty(len(code_a) + len(code_b), np.int64)
        line[np.arange(len(code_a)) + (self.cut_b - self.n_b)[group_a]] = code_a
        line[np.arange(len(code_b)) + self.cut_a[group_b]] = code_b
        names = [*names_a, *names_b]
        out = list(map(names.__getitem__, line.tolist()))
        stops = np.cumsum(self.sizes_a + self.sizes_b).tolist()
        return [b"".join(out[i:j])[:-1] for i, j in zip([0, *stops], stops, strict=False)]

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pairs by text: the text, the pair, and the number of its links there."""
        counts = self.n_a * self.n_b
        text, pair, times = [], [], []
        few = counts <= WIDE
        group = np.repeat(np.arange(len(counts)), np.where(few, self.n_a, 0))
        left = np.nonzero(np.repeat(few, self.n_a))[0]
        rounds = self.n_b[group]
        group, left = np.repeat(group, rounds), np.repeat(left, rounds)
        step = np.arange(len(group)) - np.repeat(np.cumsum(rounds) - rounds, rounds)
        text.append(self.text_of[group])
        pair.append(self.a[left] * SIDE + self.b[(self.cut_b - self.n_b)[group] + step])
        times.append(np.ones(len(group), np.int64))
        for g in np.nonzero(~few)[0].tolist():
            for pairs, n in wide_links(self.a[self.cut_a[g] - self.n_a[g] : self.cut_a[g]], self.b[self.cut_b[g] - self.n_b[g] : self.cut_b[g]]):
                text.append(np.full(len(pairs), self.text_of[g]))
                pair.append(pairs)
                times.append(n)
        return np.concatenate(text), np.concatenate(pair), np.concatenate(times)


MADE = [("n_a", "long"), ("n_b", "long"), ("n_groups", "long"), ("n_links", "long"), ("groups", "string")]


def _names(count: int, end: str) -> list[bytes]:
    return [b"%d," % k for k in range(count)] + [f"{k}{end}".encode() for k in range(count)]


def _blocks(sides, kept: int, with_groups: bool, arrow: pa.Schema):
    """The function of a task: rows of documents, and a row for each block with its list of pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = Sides(*sides.value)
        names = _names(len(both.first_bytes), "|"), _names(len(both.second_bytes), ";")
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            done = 0
            for texts in chunks([t or "" for t in batch.column(kept).to_pylist()], BLOCK_CHARS):
                n = len(texts)
                block = Block(both, texts)
                text, pair, times = block.links()
                known, where = np.unique(pair, return_inverse=True)
                held, back = np.unique(text * max(1, len(known)) + where, return_inverse=True)
                times = np.bincount(back, times, len(held)).astype("<u4")
                text, place = held // max(1, len(known)), (held % max(1, len(known))).astype("<u4")
                stops = np.searchsorted(text, np.arange(n), side="right").tolist()
                spans = list(zip([0, *stops], stops, strict=False))
                groups = block.written(*names)
                written = [g.decode() for g in groups] if with_groups else [hashlib.sha256(g).hexdigest() if g else "" for g in groups]
                totals = [block.sizes_a, block.sizes_b, block.by_text(np.ones(len(block.n_a))), block.by_text(block.n_a * block.n_b)]
                columns = [batch.column(k).slice(done, n) for k in range(kept)] + [pa.array(t, pa.int64()) for t in totals] + [pa.array(written, pa.string()), pa.array([number] * n, pa.int64())]
                columns += [pa.array([place[i:j].tobytes() for i, j in spans], pa.binary()), pa.array([times[i:j].tobytes() for i, j in spans], pa.binary()), *[pa.nulls(n, arrow.field(k).type) for k in (-2, -1)]]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)
                columns = [pa.nulls(1, f.type) for f in arrow]
                holders = np.bincount(place, minlength=len(known))
                columns[-5], columns[-2:] = pa.array([number], pa.int64()), [pa.array([known], pa.list_(pa.int64())), pa.array([holders.astype(np.int64)], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)
                done += n
                number += 1

    return run


def _measured(kept: list[str], arrow: pa.Schema):
    """The function of a block: its documents meet the counts of its list of pairs."""

    def run(documents: pa.Table, found: pa.Table) -> pa.Table:
        size = len(found)
        count, best = np.zeros(size, np.int64), np.zeros(size, bool)
        place = np.asarray(found["place"])
        count[place], best[place] = np.asarray(found["n"]), np.asarray(found["best"])
        sums, bests = [], []
        for places, times in zip(documents["places"].to_pylist(), documents["times"].to_pylist(), strict=True):
            own, each = np.frombuffer(places, "<u4"), np.frombuffer(times, "<u4").astype(np.int64)
            sums.append(int((count[own] * each).sum()))
            bests.append(int(each[best[own]].sum()))
        return pa.table([*[documents[c] for c in [*kept, *[n for n, _ in MADE]]], pa.array(bests, pa.int64()), pa.array(sums, pa.int64())], schema=arrow)

    return run


def pair_counts(pairs: DataFrame) -> DataFrame:
    """Rows ``pair, holders`` summed to one row per pair: a, b, n (documents that hold it linked), best (n is the highest of its a)."""
    counts = store(pairs.groupBy("pair").agg(F.sum("holders").alias("n")).withColumn("a", F.shiftright("pair", 32)), "counts")
    highest = counts.groupBy("a").agg(F.max("n").alias("highest"))
    return counts.join(highest, "a").select("pair", F.col("a").cast("int").alias("a"), F.col("pair").bitwiseAND(SIDE - 1).cast("int").alias("b"), "n", (F.col("n") == F.col("highest")).alias("best"))


def align(docs: DataFrame, first_path: str, second_path: str, pattern: str | None = None, text: str = "text", keep: tuple[str, ...] = ("doc_id",), with_groups: bool = True) -> tuple[DataFrame, DataFrame]:
    """Alignment of every text, and the table of linked pairs (a, b, n, best).

    The first frame has one row per row of ``docs``: columns ``keep``, n_a, n_b, n_groups,
    n_links, groups (`a1,a2|b1;a3|b2,b3`, or its SHA-256 without ``with_groups``), n_best
    (links whose count is the highest of their first id) and count_sum (counts over all
    links). Texts that are null, empty, or whose bytes the tokenizers do not give back have
    zeros and the empty string. Repeated rows are documents each for itself, and all count;
    an empty table gives none. Only named columns are read; where ``keep`` has one of the
    names made here, that one is replaced. The driver reads both files; the first
    side's split ``pattern`` only makes it faster.
    """
    made = [n for n, _ in MADE] + ["n_best", "count_sum"]
    kept = [c for c in keep if c not in made]
    with open(first_path, encoding="utf-8") as one, open(second_path, "rb") as two:
        sides = docs.sparkSession.sparkContext.broadcast((one.read(), two.read(), pattern))  # as large as the vocabularies, whatever the corpus
    inputs = docs.select(*[F.col(c).alias(f"k{k}") for k, c in enumerate(kept)], F.col(text).alias("text"))
    own = [f"k{k} {f.dataType.simpleString()}" for k, f in enumerate(inputs.schema.fields[:-1])]
    made_here = [f"{n} {t}" for n, t in MADE]
    tail = ["block long", "places binary", "times binary", "pairs array<bigint>", "holders array<bigint>"]
    blocks = inputs.sparkSession.createDataFrame([], ", ".join([*own, *made_here, *tail]))
    rows = store(inputs.mapInArrow(_blocks(sides, len(kept), with_groups, _arrow(blocks)), blocks.schema), "aligned")
    listed = rows.filter("pairs IS NOT NULL").select("block", F.posexplode(F.arrays_zip("pairs", "holders")).alias("place", "at")).select("block", "place", F.col("at.pairs").alias("pair"), F.col("at.holders").alias("holders"))
    counted = store(pair_counts(listed.select("pair", "holders")), "pairs")
    back = listed.select("block", "place", "pair").join(counted.select("pair", "n", "best"), "pair").select("block", "place", "n", "best")
    names = [f"k{k}" for k in range(len(kept))]
    result = ", ".join([*own, *made_here, "n_best long", "count_sum long"])
    measure = _measured(names, _arrow(inputs.sparkSession.createDataFrame([], result)))
    documents = rows.filter("pairs IS NULL").withColumn("own", F.col("block") + 0).drop("block", "pairs", "holders")  # a column that the other side does not have
    done = documents.groupBy("own").cogroup(back.groupBy("block")).applyInArrow(measure, result)
    return done.select(*[F.col(n).alias(c) for n, c in zip(names, kept, strict=True)], *made), counted.select("a", "b", "n", "best")


def _arrow(frame: DataFrame) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(frame.schema)


ship(__name__)
