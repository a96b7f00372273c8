"""Byte-level BPE by merge replay over the words of a corpus.

A task takes its partition of the corpus in chunks. The distinct words of a chunk
(matches of the split pattern) are laid out in one array of tokens with links to the
left and right neighbour, and an inverted index holds, for the rank of every mergeable
pair, the positions of that pair in all words. Merges are then applied in the order of
their ranks, each to all its positions at once; only the neighbours of a merged place
are looked at again and enter the index. Since a word's tokens depend on that word
alone, chunks of the corpus give what the whole corpus gives, and no text is shuffled.

Where a merge makes a pair of lower rank than its own, replay order and the order
within a word could part; such words are done again word by word, lowest rank first.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import chunks, ship

#: Characters of text a chunk holds before its words are encoded (a longer text is a chunk of its own).
CHUNK_CHARS = 4_000_000
#: Pieces of text whose tokens a task remembers from chunk to chunk; the memory is emptied when full.
REMEMBERED = 500_000


class Vocabulary:
    """Ranks of tokens, and the rank that each mergeable pair of tokens has."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, pairs: tuple[np.ndarray, np.ndarray] | None = None):
        self.ranks = ranks
        self.pattern = pattern
        self.split = regex.compile(pattern)
        self.bytes_of: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.pair_keys, self.pair_ranks = pairs or self._pairs(ranks)

    @staticmethod
    def _pairs(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
        pairs = [
            ((ranks[token[:k]] << 32) | ranks[token[k:]], rank)
            for token, rank in ranks.items()
            for k in range(1, len(token))
            if token[:k] in ranks and token[k:] in ranks
        ]
        pairs.sort()
        return np.array([k for k, _ in pairs], np.int64), np.array([r for _, r in pairs], np.int64)

    def parts(self) -> tuple:
        """What the constructor takes: plain values, which executors can read without this package."""
        return self.ranks, self.pattern, (self.pair_keys, self.pair_ranks)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the token that each pair merges into; -1 where there is none."""
        keys = (left << 32) | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], -1)

    def one_word(self, word: bytes) -> list[int]:
        """Tokens of a word: the leftmost pair of lowest rank is merged until none is left."""
        parts = [bytes([b]) for b in word]
        while True:
            best = min(((r, k) for k, pair in enumerate(zip(parts, parts[1:], strict=False)) if (r := self.ranks.get(pair[0] + pair[1])) is not None), default=None)
            if best is None:
                return [self.ranks[p] for p in parts]
            k = best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]


def load_vocabulary(path: str, pattern: str) -> Vocabulary:
    """The vocabulary of a file of lines "base64 token, rank"."""
    with open(path, "rb") as lines:
        return Vocabulary({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}, pattern)


def replay(vocabulary: Vocabulary, words: list[bytes]) -> list[np.ndarray]:
    """Token ids of each word."""
    return [np.frombuffer(x, "<u4") for x in packed(vocabulary, words)]


def packed(vocabulary: Vocabulary, words: list[bytes]) -> list[bytes]:
    """Token ids of each word (little-endian, 32 bits), by replaying all merges in rank order over all words."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    token = vocabulary.of_byte[np.frombuffer(b"".join(words), np.uint8)]
    n = len(token)
    ends = np.cumsum(lengths)
    word_of = np.repeat(np.arange(len(words)), lengths)
    right = np.arange(1, n + 1)
    right[ends - 1] = -1
    left = np.arange(-1, n - 1)
    left[ends - lengths] = -1
    odd = np.zeros(len(words), bool)
    index: dict[int, list[np.ndarray]] = {}
    due: list[int] = []

    def enter(at: np.ndarray, after: int) -> None:
        """Put the pairs that begin at these positions into the index."""
        ranks = vocabulary.merged(token[at], token[right[at]])
        at, ranks = at[ranks >= 0], ranks[ranks >= 0]
        if not len(at):
            return
        odd[word_of[at[ranks < after]]] = True
        order = np.argsort(ranks, kind="stable")
        at, ranks = at[order], ranks[order]
        starts = np.nonzero(np.diff(ranks, prepend=-1))[0]
        for rank, positions in zip(ranks[starts].tolist(), np.split(at, starts[1:]), strict=True):
            if rank not in index:
                index[rank] = []
                heapq.heappush(due, rank)
            index[rank].append(positions)

    if n:
        first = np.nonzero(right >= 0)[0]
        if len(first):
            enter(first, -1)
    while due:
        rank = heapq.heappop(due)
        found = index.pop(rank)
        at = np.unique(np.concatenate(found)) if len(found) > 1 else np.sort(found[0])
        at = at[(token[at] >= 0) & (right[at] >= 0)]
        at = at[vocabulary.merged(token[at], token[right[at]]) == rank]  # pairs that other merges have taken are gone
        if not len(at):
            continue
        # Of overlapping places the first, third, ... merge: each one takes the next one's left token.
        chained = np.concatenate([[False], right[at[:-1]] == at[1:]])
        run = np.maximum.accumulate(np.where(chained, 0, np.arange(len(at))))
        at = at[(np.arange(len(at)) - run) % 2 == 0]
        gone = right[at]
        after = right[gone]
        token[at], token[gone] = rank, -1
        right[at] = after
        left[after[after >= 0]] = at[after >= 0]
        before = left[at]
        touched = np.unique(np.concatenate([at[after >= 0], before[before >= 0]]))
        if len(touched):
            enter(touched, rank)
    kept = token >= 0
    data = token[kept].astype("<u4").tobytes()
    stops = (4 * np.cumsum(np.bincount(word_of[kept], minlength=len(words)))).tolist()
    ids = [data[i:j] for i, j in zip([0, *stops], stops, strict=False)]
    for k in np.nonzero(odd)[0]:
        ids[k] = np.array(vocabulary.one_word(words[k]), "<u4").tobytes()
    return ids


#: Before a single space that stands between other characters. No match of the split
#: pattern crosses such a place, so what lies between two of them is encoded by itself.
CUT = re.compile(r"(?<=\S)(?= \S)")


class Encoder:
    """Encodes texts in chunks; remembers the tokens of the pieces it has met."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.known: dict[str, bytes] = {}

    def learn(self, pieces: set[str]) -> None:
        """Encode pieces (as little-endian unsigned 32-bit ids) by one replay over their distinct words."""
        if len(self.known) + len(pieces) > REMEMBERED:
            self.known.clear()
        order = list(pieces)
        split = list(map(self.vocabulary.split.findall, order))
        words = sorted(set().union(*split))
        coded = [w.encode() for w in words]
        ranks = list(map(self.vocabulary.ranks.get, coded))
        rare = [w for w, rank in zip(coded, ranks, strict=True) if rank is None]
        merged = iter(packed(self.vocabulary, rare))
        ids = {w: next(merged) if rank is None else rank.to_bytes(4, "little") for w, rank in zip(words, ranks, strict=True)}
        self.known.update(zip(order, [b"".join(map(ids.__getitem__, found)) for found in split], strict=True))

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text, as bytes, in order."""
        cut = list(map(CUT.split, texts))
        met = set().union(*cut)
        new = met - self.known.keys()
        if new:
            self.learn(met if len(self.known) + len(new) > REMEMBERED else new)
        for pieces in cut:
            yield b"".join(map(self.known.__getitem__, pieces))


def bpe_encode(docs: DataFrame, path: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), with_ids: bool = False) -> DataFrame:
    """Columns ``keep`` with n_tokens, ids_sha256 and decoded_sha256 of each row's text; with_ids adds ids and decoded text.

    Null counts as the empty text: no tokens, and the digests of no bytes. Special
    tokens are ordinary text. Rows are encoded each on its own, so repeated rows give
    repeated results; an empty table gives none. Only the named columns are read, and
    where ``keep`` has one of the names made here, that one is replaced. The driver
    reads the file at ``path``.
    """
    made = [("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string")] + [("ids", "array<int>"), ("decoded", "string")] * with_ids
    kept = [c for c in keep if c not in dict(made)]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema], *[f"{n} {t}" for n, t in made]])
    names = [*kept, *[n for n, _ in made]]

    shared = docs.sparkSession.sparkContext.broadcast(load_vocabulary(path, pattern).parts())  # as large as the vocabulary, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Vocabulary(*shared.value))
        bytes_of = encoder.vocabulary.bytes_of
        for batch in batches:
            counts, id_digests, text_digests, ids_out, texts_out = [], [], [], [], []
            for chunk in chunks([t or "" for t in batch.column(len(kept)).to_pylist()], CHUNK_CHARS):
                for packed in encoder.encode(chunk):
                    ids = np.frombuffer(packed, "<u4").tolist()
                    decoded = b"".join(map(bytes_of.__getitem__, ids))
                    counts.append(len(ids))
                    id_digests.append(hashlib.sha256(packed).hexdigest())
                    text_digests.append(hashlib.sha256(decoded).hexdigest())
                    if with_ids:
                        ids_out.append(ids)
                        texts_out.append(decoded.decode("utf-8", "replace"))
            columns = [pa.array(counts, pa.int64()), pa.array(id_digests, pa.string()), pa.array(text_digests, pa.string())]
            if with_ids:
                columns += [pa.array(ids_out, pa.list_(pa.int32())), pa.array(texts_out, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *columns], names)

    return docs.select(*kept, F.col(text).alias("_text")).mapInArrow(run, schema)


ship(__name__)
