"""Exact dedup against a minimal perfect hash over the distinct digests of what came before.

History is indexed once. Its distinct SHA-256 digests are dealt into shards by their
leading bits; each shard gets a minimal perfect hash of cascading bit arrays (a key
takes the slot of the first level in which no other key of the shard shares its bit;
slots are numbered by rank). A slot holds the whole digest, so a look-up compares
bytes and a digest that history lacks is never taken for a member, and the winner's
locator (its doc_id and the number of its row) with the number of rows it stands for.

New rows are first summed by digest, then looked up shard by shard. Members join the
winner of their slot; nonmembers form groups among themselves.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import join_back, ship, store

#: Digests a shard holds on average; its index then takes about 4 MB.
SHARD_DIGESTS = 65_536
#: Bits of a level per key that is left; higher is faster to build and larger.
GAMMA = 2.0

INDEX_SCHEMA = "shard int, levels array<binary>, sizes array<long>, digests binary, winners binary, counts binary"


def text_digest(text: Column) -> Column:
    """SHA-256 of the text as UTF-8, 32 bytes; null counts as the empty text."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def shard_of(digest: Column, shards: int) -> Column:
    """The shard of a digest, from its leading 31 bits: the same for history and new rows."""
    return F.expr("0").cast("int") if shards <= 1 else F.pmod(F.conv(F.hex(F.substring(digest, 1, 4)), 16, 10).cast("long"), F.lit(shards)).cast("int")


def _words(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit halves of each digest, from bytes that ``shard_of`` does not use."""
    view = digests[:, 8:24].copy().view("<u8")
    return view[:, 0], view[:, 1]


def _bit(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
    """Place of each key in the bit array of a level."""
    with np.errstate(over="ignore"):
        mixed = a + np.uint64(level + 1) * (b | np.uint64(1))
        mixed ^= mixed >> np.uint64(33)
        mixed *= np.uint64(0xFF51AFD7ED558CCD)
        mixed ^= mixed >> np.uint64(33)
    return (mixed % np.uint64(size)).astype(np.int64)


def build_levels(digests: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Bit arrays of the levels, and the slot (0..n-1) of each of n distinct digests."""
    a, b = _words(digests)
    left, levels, slots, before = np.arange(len(digests)), [], np.zeros(len(digests), np.int64), 0
    while len(left):
        size = max(64, int(GAMMA * len(left)))
        place = _bit(a[left], b[left], len(levels), size)
        alone = np.bincount(place, minlength=size) == 1
        own = alone[place]
        rank = np.cumsum(alone) - 1
        slots[left[own]] = before + rank[place[own]]
        before += int(own.sum())
        levels.append(alone)
        left = left[~own]
    return levels, slots


def find_slots(levels: list[np.ndarray], digests: np.ndarray) -> np.ndarray:
    """The slot that each digest would have; -1 where no level has a bit for it."""
    a, b = _words(digests)
    slots, left, before = np.full(len(digests), -1, np.int64), np.arange(len(digests)), 0
    for k, bits in enumerate(levels):
        if not len(left):
            break
        place = _bit(a[left], b[left], k, len(bits))
        hit = bits[place]
        slots[left[hit]] = before + (np.cumsum(bits) - 1)[place[hit]]
        before += int(bits.sum())
        left = left[~hit]
    return slots


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 32)


def _build(table: pa.Table) -> pa.Table:
    """One index row from the distinct digests of a shard."""
    digests = _matrix(table["digest"])
    levels, slots = build_levels(digests)
    order = np.argsort(slots)
    winner = table["winner"]
    # A winner without an id is told by its flag, since no long is free to stand for null.
    parts = (winner.fill_null(0), winner.is_valid().cast(pa.int64()), table["row"])
    locators = np.stack([np.asarray(x)[order] for x in parts], axis=1)
    return pa.table(
        {
            "shard": pa.array([table["shard"][0].as_py()], pa.int32()),
            "levels": pa.array([[np.packbits(x).tobytes() for x in levels]], pa.list_(pa.binary())),
            "sizes": pa.array([[len(x) for x in levels]], pa.list_(pa.int64())),
            "digests": pa.array([digests[order].tobytes()], pa.binary()),
            "winners": pa.array([locators.astype("<i8").tobytes()], pa.binary()),
            "counts": pa.array([np.asarray(table["n"])[order].astype("<i8").tobytes()], pa.binary()),
        }
    )


def _look_up(index: pa.Table, asked: pa.Table) -> pa.Table:
    """For each digest asked: whether history has it, with the winner and count of its slot."""
    n = asked.num_rows
    member, locators, counts = np.zeros(n, bool), np.zeros((n, 3), np.int64), np.zeros(n, np.int64)
    if n and index.num_rows:
        row = {c: index[c][0].as_py() for c in ("levels", "sizes", "digests", "winners", "counts")}
        levels = [np.unpackbits(np.frombuffer(x, np.uint8), count=size).astype(bool) for x, size in zip(row["levels"], row["sizes"], strict=True)]
        digests = _matrix(asked["digest"])
        held = np.frombuffer(row["digests"], np.uint8).reshape(-1, 32)
        slots = find_slots(levels, digests)
        at = np.where(slots < 0, 0, slots)
        member = (slots >= 0) & (held[at] == digests).all(axis=1)
        locators = np.frombuffer(row["winners"], "<i8").reshape(-1, 3)[at]
        counts = np.where(member, np.frombuffer(row["counts"], "<i8")[at], 0)
    made = {
        "digest": asked["digest"].combine_chunks() if n else pa.array([], pa.binary()),
        "member": pa.array(member),
        "old_winner": pa.array(locators[:, 0], pa.int64(), mask=~(member & (locators[:, 1] == 1))),
        "old_row": pa.array(locators[:, 2], pa.int64(), mask=~member),
        "old_n": pa.array(counts, pa.int64()),
    }
    new = {f"new_{c}": asked[c].combine_chunks() if n else pa.array([], pa.int64()) for c in ("winner", "row", "n")}
    return pa.table(made | new)


def summed(rows: DataFrame) -> DataFrame:
    """One row per digest: the largest doc_id, one row that has it (where none has an id, the last row) and the number of rows. Summed before the shuffle."""
    at = F.coalesce(F.max_by("row", "doc_id"), F.max("row"))
    return rows.groupBy("digest").agg(F.max("doc_id").alias("winner"), at.alias("row"), F.count(F.lit(1)).alias("n"))


def build_index(distinct: DataFrame, shards: int) -> DataFrame:
    """The sharded index (``INDEX_SCHEMA``) over rows of distinct ``digest`` with ``winner``, ``row``, ``n``."""
    dealt = distinct.select("digest", "winner", "row", "n", shard_of(F.col("digest"), shards).alias("shard"))
    return dealt.groupBy("shard").applyInArrow(_build, INDEX_SCHEMA)


def look_up(index: DataFrame, distinct: DataFrame, shards: int) -> DataFrame:
    """Winner and size of each asked digest's group, history and new rows together."""
    asked = distinct.select("digest", "winner", "row", "n", shard_of(F.col("digest"), shards).alias("shard"))
    schema = "digest binary, member boolean, old_winner long, old_row long, old_n long, new_winner long, new_row long, new_n long"
    found = index.groupBy("shard").cogroup(asked.groupBy("shard")).applyInArrow(_look_up, schema)
    newer = F.coalesce(F.col("new_winner") > F.col("old_winner"), ~F.col("member") | (F.col("old_winner").isNull() & F.col("new_winner").isNotNull()))
    return found.select(
        "digest",
        F.when(newer, F.col("new_winner")).otherwise(F.col("old_winner")).alias("keep_id"),
        F.when(newer, F.col("new_row")).otherwise(F.col("old_row")).alias("keep_row"),
        (F.col("old_n") + F.col("new_n")).alias("group_size"),
        "member",
    )


def exact_groups(history: DataFrame, incoming: DataFrame, shard_digests: int = SHARD_DIGESTS) -> DataFrame:
    """Group of every distinct digest of both inputs: ``digest, keep_id, keep_row, group_size``.

    Inputs have ``doc_id``, ``row`` (different for all rows of both) and ``digest`` and
    should be stored. Groups that only history has keep the winner and size of their
    slot. The largest doc_id wins; of rows with that doc_id one wins, history first.
    Rows without an id win only where no row of the group has one.
    """
    old, new = store(summed(history), "history"), store(summed(incoming), "incoming")
    shards = max(1, -(-old.count() // shard_digests))
    index = store(build_index(old, shards), "mphf")
    found = store(look_up(index, new, shards), "found")
    untouched = old.join(found.filter("member").select("digest"), "digest", "left_anti")
    return found.drop("member").unionByName(untouched.select("digest", F.col("winner").alias("keep_id"), F.col("row").alias("keep_row"), F.col("n").alias("group_size")))


def exact_dedup(docs: DataFrame, arrived_before: Column, shard_digests: int = SHARD_DIGESTS, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, and the columns ``keep``.

    ``arrived_before`` says which rows are history (indexed); all others are looked up.
    The result does not depend on it, only the work does. Texts are equal when their
    bytes are; null counts as empty. Of a group, one row stays (``kept``): one with the
    largest doc_id, though other rows repeat that doc_id; in a group without any doc_id
    some row, with keep_id null. doc_id is an integer. Only doc_id, text and ``keep``
    (names not made here) are read, so extra columns cannot clash. Empty tables give an
    empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_digest(F.col("text")).alias("digest"), arrived_before.alias("old"), *keep)
    rows = store(rows.withColumn("row", F.monotonically_increasing_id()), "digests")
    groups = store(exact_groups(rows.filter("old"), rows.filter(~F.coalesce(F.col("old"), F.lit(False))), shard_digests), "groups")
    joined = join_back(rows.select("doc_id", "digest", "row", *keep), groups, "digest", "group_size", F.unhex(F.sha2(F.col("row").cast("string"), 256)))
    return joined.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), *keep)


ship(__name__)
