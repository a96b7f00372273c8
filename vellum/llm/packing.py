"""Packing of documents into token windows by the online sum-of-squares rule.

A level array counts the partially filled windows of each fill level. A document goes
into a window of the level that makes the sum of the squared counts least, or into a new
window where that is least; ties go to the fullest level. Documents longer than a window
give whole windows first, and their rest is placed.

A task packs the rows it reads and needs no others, so nothing is shuffled and a lost task
is done again by itself. It closes its windows at its end, or when OPEN_WINDOWS are partly
filled: the emptiest windows are cut up to fill the fullest, and what is left over is cut
into windows of powers of two. Windows then need no padding, and only documents of
windows that were open at such an end are cut for it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import chunks, ship
from vellum.llm.pieces import ByteIds

WINDOW = 2_048
#: Id that ends every document.
END = 1
#: Windows that a task keeps open; at this number all are closed (4 bytes for each of their tokens at most).
OPEN_WINDOWS = 4_096
#: Characters of text encoded at once.
CHUNK_CHARS = 1_000_000
#: Sequence ids are a task's number times this, and a number in the task.
PER_TASK = 1 << 40

#: A piece of a document: its row, its place in the document, its ids.
Piece = tuple[int, int, bytes]


class Packer:
    """Windows of one task; ``closed`` collects those that are complete, each a list of pieces."""

    def __init__(self, window: int = WINDOW, most_open: int = OPEN_WINDOWS):
        self.window, self.most_open = window, most_open
        self.counts = np.zeros(window + 1, np.int64)  # of level `window` none is ever kept
        self.at: list[list[list[Piece]]] = [[] for _ in range(window + 1)]
        self.open = 0
        self.closed: list[list[Piece]] = []

    def level_for(self, size: int) -> int:
        """The level, 0 for a new window, into which ``size`` ids (fewer than a window) go."""
        top = self.window - size
        here, there = self.counts[1 : top + 1], self.counts[1 + size : self.window + 1]
        # What the sum of squares grows by: (n - 1)^2 - n^2 at the level left, (n + 1)^2 - n^2 at the one reached, unless full.
        growth = np.where(here > 0, 2 * (there - here) + 2, np.iinfo(np.int64).max)
        if here[top - 1]:
            growth[top - 1] = 1 - 2 * here[top - 1]
        best = top - 1 - int(np.argmin(growth[::-1]))
        return best + 1 if growth[best] <= 2 * self.counts[size] + 1 else 0

    def add(self, row: int, ids: bytes) -> None:
        """Place a document."""
        step = 4 * self.window
        whole = len(ids) // step * step
        self.closed += [[(row, k // 4, ids[k : k + step])] for k in range(0, whole, step)]
        rest = (len(ids) - whole) // 4
        if not rest:
            return
        level = self.level_for(rest)
        if level:
            pieces = self.at[level].pop()
            self.counts[level] -= 1
            self.open -= 1
        else:
            pieces = []
        pieces.append((row, whole // 4, ids[whole:]))
        if level + rest == self.window:
            self.closed.append(pieces)
            return
        self.at[level + rest].append(pieces)
        self.counts[level + rest] += 1
        self.open += 1
        if self.open >= self.most_open:
            self.close()

    def close(self) -> None:
        """Close all windows: gaps of the fullest are filled with pieces cut from the emptiest."""
        waiting = [(level, pieces) for level in range(self.window) for pieces in self.at[level]]
        first, loose, have = 0, [], 0  # pieces of emptied windows, and how many ids they hold
        while len(waiting) > first:
            level, pieces = waiting.pop()
            gap = self.window - level
            while have < gap and first < len(waiting):
                loose += waiting[first][1]
                have += waiting[first][0]
                first += 1
            if have < gap:
                loose, have = loose + pieces, have + level
                break
            given, loose = _cut(loose, gap)
            have -= gap
            self.closed.append(pieces + given)
        while have:
            size = min(self.window, 1 << (have.bit_length() - 1))
            given, loose = _cut(loose, size)
            have -= size
            self.closed.append(given)
        self.counts[:] = 0
        self.at = [[] for _ in range(self.window + 1)]
        self.open = 0


def _cut(pieces: list[Piece], size: int) -> tuple[list[Piece], list[Piece]]:
    """The last ``size`` ids of the pieces, and the pieces without them."""
    taken: list[Piece] = []
    pieces = list(pieces)
    while size:
        row, start, ids = pieces.pop()
        have = len(ids) // 4
        if have > size:
            pieces.append((row, start, ids[: 4 * (have - size)]))
            start, ids, have = start + have - size, ids[4 * (have - size) :], size
        taken.append((row, start, ids))
        size -= have
    return taken, pieces


MADE = [("start", "long"), ("length", "long"), ("ids_crc32", "long"), ("doc_tokens", "long"), ("sequence_id", "long"), ("offset", "long")]


def pack(docs: DataFrame, path: str, pattern: str | None = None, window: int = WINDOW, end: int = END, text: str = "text", keep: tuple[str, ...] = ("doc_id",), with_ids: bool = False) -> DataFrame:
    """One row per piece: columns ``keep`` of its row, start, length, ids_crc32, doc_tokens, sequence_id, offset; with_ids adds ids.

    A document is its text's ids under the tokenizer at ``path`` (read by the driver; its
    split ``pattern`` only makes it faster) and ``end``; null and empty texts have ``end`` alone. A special token's string in a text
    gives that token, as the library does by default. Rows are documents each for itself,
    repeated ones too. Windows have ``window`` ids, or a power of two of fewer. Which
    window a document gets depends on the rows that its task reads, so rows whose order is
    not fixed (after a shuffle) should be stored first. An empty table gives no pieces. Only
    named columns are read; where ``keep`` has one of the names made here, that one is
    replaced.
    """
    made = MADE + [("ids", "array<int>")] * with_ids
    kept = [c for c in keep if c not in dict(made)]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema], *[f"{n} {t}" for n, t in made]])
    with open(path, encoding="utf-8") as file:
        definition = docs.sparkSession.sparkContext.broadcast(file.read())  # as large as the vocabulary, whatever the corpus
    last = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = ByteIds(definition.value, pattern=pattern)
        packer = Packer(window)
        rows: dict[int, tuple[list, int, int]] = {}  # of documents with ids still open: values of keep, ids in all, ids not given out
        number, sequence = 0, TaskContext.get().partitionId() * PER_TASK

        def given() -> pa.RecordBatch:
            nonlocal sequence
            columns: list[list] = [[] for _ in range(len(kept) + len(made))]
            for pieces in packer.closed:
                offset = 0
                for row, start, ids in pieces:
                    values, total, left = rows[row]
                    size = len(ids) // 4
                    cells = [*values, start, size, zlib.crc32(ids), total, sequence, offset] + [np.frombuffer(ids, "<u4").tolist()] * with_ids
                    for column, cell in zip(columns, cells, strict=True):
                        column.append(cell)
                    offset += size
                    if left == size:
                        del rows[row]
                    else:
                        rows[row] = values, total, left - size
                sequence += 1
            packer.closed = []
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        arrow = None
        for batch in batches:
            if arrow is None:
                types = {"long": pa.int64(), "array<int>": pa.list_(pa.int32())}
                arrow = pa.schema([*[batch.schema.field(k).with_name(c) for k, c in enumerate(kept)], *[pa.field(n, types[t]) for n, t in made]])
            keys = list(zip(*[batch.column(k).to_pylist() for k in range(len(kept))], strict=True)) if kept else [()] * batch.num_rows
            done = 0
            for chunk in chunks([t or "" for t in batch.column(len(kept)).to_pylist()], CHUNK_CHARS):
                for values, ids in zip(keys[done : done + len(chunk)], encode(chunk), strict=True):
                    ids += last
                    rows[number] = list(values), len(ids) // 4, len(ids) // 4
                    packer.add(number, ids)
                    number += 1
                done += len(chunk)
                yield given()
        if arrow is not None:
            packer.close()
            yield given()

    return docs.select(*kept, F.col(text).alias("_text")).mapInArrow(run, schema)


ship(__name__)
