"""Substring dedup: paragraph MinHash banding, exact Jaccard, removals by components.

A paragraph is a run of words between two cuts. A cut stands after a word whose rank is
the least among the LEAST_WORDS - 1 words on each side, which is one in 11; ranks are hashes of a word and the
one before, and words that end a sentence rank before all others. Cuts thus depend on
the words near them alone, not on lines: a passage pasted into another text or wrapped
at another width has the same cuts but near its ends, and every paragraph has LEAST_WORDS
words or more, unless the text has fewer.

Paragraphs with the same words are one text, told by a 128-bit digest. Texts are banded
by minima of hashed five-word shingles. Bands have one row, and there are as many as
RECALL asks for: with three, texts at the limit of 0.8 meet with probability
1 - 0.2^3 = 0.992 and more similar ones oftener. A band in which more than CROWD texts
meet is divided by the rarest shingles of its texts, so that no similar pair is parted. Texts
that meet are compared by the exact Jaccard similarity of their shingle sets; links
give components. A component that stands in two documents or more is repeated; its
occurrence in the smallest doc_id stays, all others are removals. Repeated paragraphs
that follow each other in a document are one run, reported from LEAST_PASSAGE words (a parameter); a
run is one passage for each stretch that the same document keeps.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.common import join_back, ship, store
from vellum.operators.components import connected_components
from vellum.storage import discard, stage

SHINGLE_WORDS = 5
SIMILARITY = 0.8
#: Wanted probability that two texts at the limit meet.
RECALL = 0.99


def tuned_bands(similarity: float, recall: float, rows: int = 1) -> int:
    """The least number of bands of so many rows in which texts of that similarity meet with the wanted probability."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows) - 1e-9))


BANDS = tuned_bands(SIMILARITY, RECALL)
LEAST_WORDS = 6
#: Words that may stand between repeated paragraphs of one passage, and the words a passage has at least.
BRIDGE_WORDS, LEAST_PASSAGE = 12, 20
#: Texts that meet in one band before it is divided (which changes no result), and rows that are compared in one group.
CROWD, PART_ROWS = 2_048, 16_384

_SEEDS = np.cumsum(np.full(BANDS, 0x9E3779B97F4A7C15, np.uint64))


def mixed(values: np.ndarray) -> np.ndarray:
    """Well-spread 64-bit values (one round of a finalizer)."""
    with np.errstate(over="ignore"):
        out = values ^ (values >> np.uint64(33))
        out = out * np.uint64(0xFF51AFD7ED558CCD)
        return out ^ (out >> np.uint64(33))


def paragraphs(data: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Words of a text in lower case, their hashes, and first word and length of each paragraph."""
    words = data.lower().split()
    n = len(words)
    if not n:
        empty = np.zeros(0, np.int64)
        return words, empty.astype(np.uint64), empty, empty
    hashes = np.fromiter(map(zlib.crc32, words), np.uint64, n)
    last = np.frombuffer(b"".join([w[-1:] for w in words]), np.uint8)
    with np.errstate(over="ignore"):
        picked = mixed(hashes * np.uint64(0x100000001B3) + np.concatenate([hashes[:1], hashes[:-1]])) >> np.uint64(1)
    picked[(last != 46) & (last != 33) & (last != 63)] += np.uint64(1 << 63)
    # A cut is the least of the LEAST_WORDS - 1 words on each side, the first of equal ones.
    ends = np.ones(n, bool)
    for k in range(1, min(LEAST_WORDS, n)):
        ends[k:] &= picked[k:] < picked[:-k]
        ends[:-k] &= picked[:-k] <= picked[k:]
    ends[: LEAST_WORDS - 1] = False
    ends[-LEAST_WORDS:] = False
    ends[-1] = True
    stops = np.nonzero(ends)[0] + 1
    lengths = np.diff(stops, prepend=0)
    return words, hashes, stops - lengths, lengths


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Paragraphs, all but those of texts too short to compare: place, digest and the minima of their shingles."""
    for batch in batches:
        docs, firsts, sizes, digests, minima = [], [], [], [], []
        for k, x in enumerate(batch.column(1)):
            words, hashes, first, length = paragraphs(x.as_py() or b"")
            long = length >= LEAST_WORDS
            first, length = first[long], length[long]
            if not len(first):
                continue
            shingles = np.zeros(len(words) - SHINGLE_WORDS + 1, np.uint64)
            with np.errstate(over="ignore"):
                for j in range(SHINGLE_WORDS):
                    shingles = shingles * np.uint64(0x100000001B3) + hashes[j : len(shingles) + j]
            # Shingles inside a paragraph lie from its first word to SHINGLE_WORDS - 1 before its end.
            edges = np.stack([first, first + length - SHINGLE_WORDS + 1], axis=1).ravel()
            edges = edges[:-1] if edges[-1] == len(shingles) else edges
            minima.append(np.stack([np.minimum.reduceat(mixed(shingles ^ seed), edges)[::2] for seed in _SEEDS]))
            docs += [k] * len(first)
            firsts.append(first)
            sizes.append(length)
            digests += [xxhash.xxh3_128_digest(b" ".join(words[a : a + n])) for a, n in zip(first.tolist(), length.tolist(), strict=True)]
        if docs:
            keys = np.concatenate(minima, axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(docs)), pa.array(np.concatenate(firsts).astype(np.int32)), pa.array(np.concatenate(sizes).astype(np.int32)), pa.array(digests, pa.binary()), *map(pa.array, keys)],
                ["doc_id", "first", "words", "id", *[f"band{b}" for b in range(BANDS)]],
            )


def _shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted hashes of the distinct shingles of the paragraphs asked for; a paragraph with another digest is not the one meant."""
    for batch in batches:
        ids, sets = [], []
        for text, asked in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = (text or b"").lower().split()
            for place in asked:
                own = words[place["first"] : place["first"] + place["words"]]
                if xxhash.xxh3_128_digest(b" ".join(own)) == place["id"]:
                    ids.append(place["id"])
                    sets.append(sorted({xxhash.xxh64_intdigest(b" ".join(own[k : k + SHINGLE_WORDS])) - (1 << 63) for k in range(len(own) - SHINGLE_WORDS + 1)}))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(sets, pa.list_(pa.int64()))], ["id", "shingles"])


def similar(a: set, b: set) -> bool:
    """Whether the Jaccard similarity reaches the limit."""
    both = len(a & b)
    return both >= SIMILARITY * (len(a) + len(b) - both)


def _links(table: pa.Table) -> pa.Table:
    """Spanning links of the texts that meet in each band of a group and are similar."""
    crowds: dict[int, dict[bytes, set]] = {}
    for key, i, shingles in zip(table["key"].to_pylist(), table["id"].to_pylist(), table["shingles"].to_pylist(), strict=True):
        crowds.setdefault(key, {})[i] = set(shingles)
    u, v = [], []
    for crowd in crowds.values():
        left = sorted(crowd)
        while left:
            # Everything similar to the first, then to what that has reached, and so on.
            root, left = left[0], left[1:]
            reached = [root]
            while reached and left:
                now, rest = reached.pop(), []
                size = len(crowd[now])
                for i in left:
                    if SIMILARITY * size <= len(crowd[i]) <= size / SIMILARITY and similar(crowd[now], crowd[i]):
                        reached.append(i)
                        u.append(i)
                        v.append(root)
                    else:
                        rest.append(i)
                left = rest
    return pa.table({"u": pa.array(u, pa.binary()), "v": pa.array(v, pa.binary())})


def near_texts(texts: DataFrame, docs: DataFrame) -> DataFrame:
    """Links ``u, v`` between digests of similar texts.

    ``texts`` has one row per digest, so that a text with any number of copies goes into
    its bands once, with a document that has it and its place there. It must be stored.
    """
    rows = texts.select("id", F.posexplode(F.array(*[F.col(f"band{b}") for b in range(BANDS)])).alias("band", "low")).select("id", F.xxhash64("band", "low").alias("key"))
    met = store(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "met")  # one row per text and band
    meetings = store(rows.join(met, "key").select("key", "id", "n"), "meetings")
    discard(met)
    wanted = meetings.select("id").distinct()
    at = F.struct(F.shiftright("place", 32).cast("int").alias("first"), F.col("place").bitwiseAND((1 << 32) - 1).cast("int").alias("words"), "id")
    asked = store(texts.join(wanted, "id", "left_semi").groupBy(F.col("low").alias("of")).agg(F.collect_list(at).alias("asked")), "asked")
    bodies = docs.select("doc_id", F.col("text").cast("binary").alias("data")).join(asked, F.col("doc_id") == F.col("of")).select("data", "asked")
    sets = store(bodies.mapInArrow(_shingle_sets, "id binary, shingles array<bigint>").dropDuplicates(["id"]), "shingles")
    discard(asked)
    small = meetings.filter(F.col("n") <= CROWD).select("key", "id")
    crowded, crowd_rows = meetings.filter(F.col("n") > CROWD).select("key", "id"), None
    while (now := crowded.count()) and (crowd_rows is None or now < crowd_rows):
        crowd_rows = now
        divided = store(_divided(crowded, sets), "divided")
        sizes = store(divided.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "sizes")
        divided = store(divided.join(sizes, "key"), "divided")
        small = small.unionByName(divided.filter(F.col("n") <= CROWD).select("key", "id"))
        crowded = divided.filter(F.col("n") > CROWD).select("key", "id")
    dealt = store(small.unionByName(crowded), "dealt")
    discard(meetings)
    parts = max(1, -(-dealt.count() // PART_ROWS))
    paired = dealt.join(sets, "id").select("id", "shingles", "key", F.pmod(F.xxhash64("key", F.lit(1)), F.lit(parts)).alias("part"))
    return paired.groupBy("part").applyInArrow(_links, "u binary, v binary")


def _divided(crowded: DataFrame, sets: DataFrame) -> DataFrame:
    """Rows ``key, id`` anew, by a key for each of the rarest shingles that a text has.

    Shingles are ordered by the number of texts under the same key that have them. Of two
    sets of which one holds 0.8 of the other, the first fifth of each (and one more) have a
    shingle in common, whatever the order, so every similar pair meets under a new key.
    What all texts of a crowd share comes last and brings them together no more.
    """
    rows = store(crowded.join(sets, "id").select("key", "id", F.explode("shingles").alias("shingle")).withColumn("place", F.xxhash64("key", "shingle")), "crowds")
    counts = store(rows.groupBy("place").agg(F.count(F.lit(1)).alias("times")).filter("times > 1"), "times")
    known = join_back(rows, counts, "place", "times", F.xxhash64("id", "shingle")).withColumn("times", F.coalesce("times", F.lit(1)))
    order = known.groupBy("key", "id").agg(F.sort_array(F.collect_list(F.struct("times", "shingle"))).alias("order"))
    # In whole numbers: n less the least that 0.8 n may be, and one.
    first = order.select("key", "id", F.expr("slice(order, 1, cast(size(order) - (4 * size(order) + 4) div 5 + 1 as int))").alias("first"))
    return first.select("id", "key", F.inline("first")).filter("times > 1").select(F.xxhash64("key", "shingle").alias("key"), "id")


def repeated_paragraphs(docs: DataFrame) -> DataFrame:
    """Paragraphs that stand in two documents or more: doc_id, first, words, keep (the smallest doc_id that has it).

    Null and empty texts have no paragraphs, and rows without a doc_id are not looked at.
    A paragraph repeated in one document only does not count; repeated rows of one doc_id
    are one document. Only doc_id and text are read, so extra columns cannot clash.
    Empty tables give an empty result.
    """
    docs = docs.select("doc_id", "text").filter("doc_id IS NOT NULL AND text IS NOT NULL")
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, first int, words int, id binary, " + ", ".join(f"band{b} long" for b in range(BANDS))
    units = store(docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(_units, schema), "units")
    place = F.min_by(F.col("first").cast("long") * (1 << 32) + F.col("words"), "doc_id").alias("place")  # numbers only, so that sums are hashed
    bands = [F.min(f"band{b}").alias(f"band{b}") for b in range(BANDS)]
    texts = store(units.groupBy("id").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count(F.lit(1)).alias("n"), place, *bands), "texts")
    with stage():
        roots = store(connected_components(near_texts(texts, docs)), "roots")
    linked = texts.join(roots, F.col("id") == F.col("node"), "left").select("id", "low", "high", "n", F.coalesce("root", "id").alias("class"), F.col("root").isNotNull().alias("near"))
    # Texts alone in their class are done; only those that are linked meet again by class.
    stored = store(linked.filter("near OR low <> high"), "candidates")
    discard(texts)
    classes = stored.filter("near").groupBy("class").agg(F.min("low").alias("class_low"), F.max("high").alias("class_high"), F.count(F.lit(1)).alias("members"))
    near = join_back(stored.filter("near"), store(classes, "classes"), "class", "members", F.col("id"))
    verdicts = near.select("id", "n", F.col("class_low").alias("keep"), F.col("class_high").alias("high")).unionByName(stored.filter("NOT near").select("id", "n", F.col("low").alias("keep"), "high"))
    verdicts = store(verdicts.filter("keep <> high").select("id", "n", "keep"), "verdicts")
    # Occurrences without a verdict match nothing; the key of a hot text is met by broadcast.
    return store(join_back(units.select("doc_id", "first", "words", "id"), verdicts, "id", "n", F.unhex(F.md5(F.concat_ws("|", "doc_id", "first")))).filter("keep IS NOT NULL").select("doc_id", "first", "words", "keep").distinct(), "found")


def _runs(found: DataFrame) -> DataFrame:
    """Repeated paragraphs with ``gap`` (1 where a run begins) and ``run``, its number in the document."""
    order = Window.partitionBy("doc_id").orderBy("first")
    gap = F.coalesce(F.col("first") - F.lag(F.col("first") + F.col("words")).over(order) > BRIDGE_WORDS, F.lit(True))
    return found.withColumn("gap", gap.cast("int")).withColumn("run", F.sum("gap").over(order.rowsBetween(Window.unboundedPreceding, 0)))


def repeated_passages(docs: DataFrame, least_passage: int = LEAST_PASSAGE) -> DataFrame:
    """Whole runs of repeated paragraphs: doc_id, passage, first_word, n_words, keep_doc_id, removed.

    One row per run and document that has it; a document without repeated passages has
    none. Words are runs of other than ASCII white space, numbered from 0. ``passage``
    numbers runs in a document. ``keep_doc_id`` is the smallest doc_id with the run's first
    paragraph; the others may have another one, so removals go by ``passage_removals``.
    """
    spans = _runs(repeated_paragraphs(docs)).withColumnRenamed("run", "passage")
    spans = spans.groupBy("doc_id", "passage").agg(F.min("first").alias("first_word"), F.max(F.col("first") + F.col("words")).alias("stop"), F.min_by("keep", "first").alias("keep_doc_id"))
    return _rows(spans.filter(F.col("stop") - F.col("first_word") >= least_passage))


def passage_removals(docs: DataFrame, least_passage: int = LEAST_PASSAGE) -> DataFrame:
    """As ``repeated_passages``, but a run is one passage for each stretch that the same document keeps.

    ``keep_doc_id`` is the smallest doc_id that has the passage's repeated paragraphs, and
    ``removed`` says that this occurrence goes. ``least_passage`` holds for whole runs, so a
    passage beside one with another keeper may have fewer words.
    """
    order = Window.partitionBy("doc_id").orderBy("first")
    starts = (F.col("gap") == 1) | F.coalesce(F.col("keep") != F.lag("keep").over(order), F.lit(True))
    parts = _runs(repeated_paragraphs(docs)).withColumn("starts", starts.cast("int")).withColumn("passage", F.sum("starts").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = parts.groupBy("doc_id", "run", "passage").agg(F.min("first").alias("first_word"), F.max(F.col("first") + F.col("words")).alias("stop"), F.min("keep").alias("keep_doc_id"))
    whole = Window.partitionBy("doc_id", "run")
    return _rows(spans.withColumn("run_words", F.max("stop").over(whole) - F.min("first_word").over(whole)).filter(F.col("run_words") >= least_passage))


def _rows(spans: DataFrame) -> DataFrame:
    return spans.select("doc_id", "passage", "first_word", (F.col("stop") - F.col("first_word")).alias("n_words"), "keep_doc_id", (F.col("keep_doc_id") != F.col("doc_id")).alias("removed"))


ship(__name__)
