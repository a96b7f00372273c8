"""SimHash near-dedup with a Gray-order hierarchical index.

Two fingerprints that differ in two bits agree on one of three blocks of their bits.
The index is therefore kept in three turns, each rotated so that another block leads.
In a turn, fingerprints are sorted by Gray rank (their place in the reflected binary
code, in which neighbours differ in one bit) and cut into shards of neighbours. In a
shard, runs of FANOUT neighbours form a node that holds the bits they all share (mask
and pattern); nodes form nodes again up to one root. Each node keeps only the shared
bits that its parent lacks, so the differences of a probe add up on the way down, and
a node whose sum passes the limit is dropped with everything below it.

A fingerprint is sent to its own shard. Where those that share its leading block reach
into later shards, as a very common block does, it is sent on to the ones that their
roots do not rule out: the roots (24 bytes each, 3 * MAX_SHARDS at most) are the leaves
of one more such tree. Shards return spanning links of what they find, from which
components are computed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import join_back, ship, store
from vellum.operators.components import connected_components

SHINGLE_WORDS = 3
SEED = 42
MAX_DISTANCE = 2
#: Rotation to the left of each turn and bits of the block that then leads.
TURNS = ((0, 22), (22, 21), (43, 21))
#: Distinct fingerprints a shard holds on average, and the most shards of a turn (their roots are sent to every task).
SHARD_FINGERPRINTS = 8_192
MAX_SHARDS = 65_536
FANOUT = 16
#: Probes that descend together, which bounds the memory of a task.
PROBES = 1_024
#: Hashes whose bits are counted together.
COUNTED = 16_384


def shingle_hashes(data: bytes) -> np.ndarray:
    """XXH64 of the 3-word shingles of a text given as UTF-8; of all words where there are fewer."""
    words = data.lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    n = len(words)
    if n < SHINGLE_WORDS:
        return np.array([digest(b" ".join(words), SEED)], np.uint64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    starts = np.concatenate([[0], ends[: n - SHINGLE_WORDS]]).tolist()
    return np.array([digest(line[a:b], SEED) for a, b in zip(starts, (ends[SHINGLE_WORDS - 1 :] - 1).tolist(), strict=True)], np.uint64)


def fingerprint(data: bytes) -> int:
    """The 64-bit SimHash: a bit is 1 if set in over half the hashes. No words give zero."""
    hashes = shingle_hashes(data)
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), COUNTED):
        bits = np.unpackbits(hashes[k : k + COUNTED].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def gray_rank(values: np.ndarray) -> np.ndarray:
    """Place of each value in the reflected binary code."""
    rank = values.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def rotated(values: np.ndarray, left: int) -> np.ndarray:
    return values if left % 64 == 0 else (values << np.uint64(left)) | (values >> np.uint64(64 - left))


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([fingerprint(x.as_py() or b"") for x in batch.column(1)], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64)), *batch.columns[2:]], ["doc_id", "fp", *batch.schema.names[2:]])


class GrayTree:
    """The hierarchical index over leaves in Gray order; a leaf is a pattern with the mask of the bits that it fixes."""

    def __init__(self, pattern: np.ndarray, mask: np.ndarray):
        levels = [(pattern & mask, mask)]
        while len(levels[0][0]) > 1:
            p, m = levels[0]
            starts = np.arange(0, len(p), FANOUT)
            shared = np.bitwise_and.reduceat(m, starts) & ~(np.bitwise_or.reduceat(p, starts) ^ np.bitwise_and.reduceat(p, starts))
            levels.insert(0, (np.bitwise_and.reduceat(p, starts) & shared, shared))
        own = [levels[0][1]]
        for (_, above), (_, m) in zip(levels, levels[1:], strict=False):
            own.append(m & ~np.repeat(above, FANOUT)[: len(m)])  # bits that the parent has compared already
        self.levels = [(p, m) for (p, _), m in zip(levels, own, strict=True)]

    def within(self, probes: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (probe, leaf) whose differences on the bits compared are at most ``limit``."""
        p, m = self.levels[0]
        differ = np.bitwise_count((probes ^ p[0]) & m[0]).astype(np.int64)
        probe = np.nonzero(differ <= limit)[0]
        node, differ = np.zeros(len(probe), np.int64), differ[probe]
        for p, m in self.levels[1:]:
            probe, differ = np.repeat(probe, FANOUT), np.repeat(differ, FANOUT)
            node = (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
            there = node < len(p)
            probe, differ, node = probe[there], differ[there], node[there]
            differ = differ + np.bitwise_count((probes[probe] ^ p[node]) & m[node])
            near = differ <= limit
            probe, differ, node = probe[near], differ[near], node[near]
        return probe, node


def _unite(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (smallest index of each component) after linking a[i] with b[i]."""
    while len(a):
        la, lb = labels[a], labels[b]
        apart = la != lb
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(labels, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            jumped = labels[labels]
            if (jumped == labels).all():
                break
            labels = jumped
    return labels


def _links(table: pa.Table) -> pa.Table:
    """Spanning links among a shard's fingerprints and the probes routed to it."""
    values = np.asarray(table["value"]).view(np.uint64)
    own = np.asarray(table["own"].combine_chunks().cast(pa.int8())).astype(bool)
    index = values[own][np.argsort(gray_rank(values[own]), kind="stable")]
    if not len(index):
        return pa.table({"u": pa.array([], pa.int64()), "v": pa.array([], pa.int64())})
    back = 64 - TURNS[table["shard"][0].as_py() // MAX_SHARDS][0]
    probes = np.concatenate([index, values[~own]])
    tree = GrayTree(index, np.full(len(index), ~np.uint64(0)))
    labels = np.arange(len(probes))
    for k in range(0, len(probes), PROBES):
        probe, leaf = tree.within(probes[k : k + PROBES], MAX_DISTANCE)
        probe = probe + k
        new = leaf < probe  # a pair of the shard's own comes twice
        labels = _unite(labels, probe[new], leaf[new])
    linked = np.nonzero(labels != np.arange(len(labels)))[0]
    return pa.table({"u": rotated(probes[linked], back).view(np.int64), "v": rotated(probes[labels[linked]], back).view(np.int64)})


class Router:
    """Cuts of the turns into shards, and the roots of the shards."""

    def __init__(self, cuts: list[np.ndarray]):
        self.cuts = cuts
        self.trees: list[GrayTree | None] = [None] * len(TURNS)
        self.numbers: list[np.ndarray] = [np.zeros(0, np.int64)] * len(TURNS)

    @staticmethod
    def place(values: np.ndarray) -> np.ndarray:
        """Gray rank as a double, without the bits that a double cannot hold."""
        return (gray_rank(values) >> np.uint64(11)).astype(np.float64)

    def home(self, turn: int, values: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.cuts[turn], self.place(values), side="right")

    def last(self, turn: int, values: np.ndarray) -> np.ndarray:
        """The last shard in which a fingerprint with the same leading block can be."""
        rest = (np.uint64(1) << np.uint64(64 - TURNS[turn][1])) - np.uint64(1)
        return np.searchsorted(self.cuts[turn], ((gray_rank(values) | rest) >> np.uint64(11)).astype(np.float64), side="right")

    def add_roots(self, turn: int, numbers: np.ndarray, every: np.ndarray, some: np.ndarray) -> None:
        self.numbers[turn], self.trees[turn] = numbers, GrayTree(every, ~(every ^ some))

    def beyond(self, turn: int, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (place in ``values``, later shard) that may hold links."""
        home, last = self.home(turn, values), self.last(turn, values)
        far = np.nonzero(last > home)[0]
        if not len(far) or self.trees[turn] is None:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        probe, leaf = self.trees[turn].within(values[far], MAX_DISTANCE)
        probe, shard = far[probe], self.numbers[turn][leaf]
        wanted = (shard > home[probe]) & (shard <= last[probe])
        return probe[wanted], shard[wanted]


def near_links(fingerprints: DataFrame) -> DataFrame:
    """Links ``u, v`` that connect just what links of at most MAX_DISTANCE bits connect.

    ``fingerprints`` has distinct values in ``fp`` and must be stored.
    """
    shards = min(MAX_SHARDS, max(1, -(-fingerprints.count() // SHARD_FINGERPRINTS)))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.asarray(batch.column(0)).view(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(Router.place(rotated(values, left))) for left, _ in TURNS], [f"turn{k}" for k in range(len(TURNS))])

    cuts = [np.zeros(0)] * len(TURNS)
    if shards > 1:
        columns = [f"turn{k}" for k in range(len(TURNS))]
        placed = fingerprints.select("fp").mapInArrow(places, ", ".join(f"{c} double" for c in columns))
        cuts = [np.array(sorted(set(found))) for found in placed.approxQuantile(columns, [k / shards for k in range(1, shards)], 1 / (4 * shards))]
    router = Router(cuts)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.asarray(batch.column(0)).view(np.uint64)
            for turn, (left, _) in enumerate(TURNS):
                own = rotated(values, left)
                yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array((turn * MAX_SHARDS + router.home(turn, own)).astype(np.int32))], ["value", "shard"])

    turned = store(fingerprints.select("fp").mapInArrow(dealt, "value long, shard int"), "turned")
    roots = turned.groupBy("shard").agg(F.bit_and("value").alias("every"), F.bit_or("value").alias("some")).orderBy("shard").collect()  # 3 * MAX_SHARDS rows at most
    for turn in range(len(TURNS)):
        if of_turn := [r for r in roots if r["shard"] // MAX_SHARDS == turn]:
            every, some = (np.array([r[c] for r in of_turn], np.int64).view(np.uint64) for c in ("every", "some"))
            router.add_roots(turn, np.array([r["shard"] % MAX_SHARDS for r in of_turn]), every, some)

    def sent_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, of = np.asarray(batch.column(0)).view(np.uint64), np.asarray(batch.column(1)) // MAX_SHARDS
            for turn in range(len(TURNS)):
                here = values[of == turn]
                for k in range(0, len(here), PROBES):
                    probe, shard = router.beyond(turn, here[k : k + PROBES])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(here[k : k + PROBES][probe].view(np.int64)), pa.array((turn * MAX_SHARDS + shard).astype(np.int32)), pa.array(np.zeros(len(probe), bool))], ["value", "shard", "own"]
                    )

    probes = turned.mapInArrow(sent_on, "value long, shard int, own boolean")
    return turned.withColumn("own", F.lit(True)).unionByName(probes).groupBy("shard").applyInArrow(_links, "u long, v long")


def simhash_groups(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id, root_fp, and the columns ``keep``.

    Null and empty texts have fingerprint zero and link like any other. component_id is
    the smallest doc_id reachable over fingerprints that differ in MAX_DISTANCE bits or
    fewer; null only where no row of the component has a doc_id. root_fp is the same for
    all rows of a component, and for no others. Repeated rows share their component.
    doc_id has any type that can be ordered. Only doc_id, text and ``keep`` (names not
    made here) are read, so extra columns cannot clash. Empty tables give an empty result.
    """
    own, *passed = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select("doc_id", *keep).schema]
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("data"), *keep).mapInArrow(_fingerprints, ", ".join([own, "fp long", *passed]))
    rows = store(rows.withColumn("row", F.monotonically_increasing_id()), "fingerprints")
    values = store(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")), "values")
    roots = store(connected_components(near_links(values)), "roots")
    linked = store(values.join(roots, values.fp == roots.node).select("fp", "first", "root"), "linked")
    least = store(linked.groupBy("root").agg(F.min("first").alias("component"), F.count(F.lit(1)).alias("size")), "least")
    of_linked = join_back(linked.select("fp", "root"), least, "root", "size", F.col("fp")).select(F.col("fp").alias("linked_fp"), "root", "component")
    alone = F.col("linked_fp").isNull()
    verdicts = values.join(of_linked, values.fp == F.col("linked_fp"), "left")
    verdicts = store(verdicts.select("fp", "n", F.when(alone, F.col("first")).otherwise(F.col("component")).alias("component_id"), F.when(alone, F.col("fp")).otherwise(F.col("root")).alias("root_fp")), "verdicts")
    joined = join_back(rows, verdicts, "fp", "n", F.col("row"))
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "root_fp", *keep)


ship(__name__)
