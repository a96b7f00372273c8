"""Phrase collocations, mined by pivot partitioning.

Words are ordered by their frequency in a language. A phrase belongs to the rarest of its
words, its pivot, at the place where that word stands first in it; so every occurrence of a
phrase is owned by one place of the text. For each place a fragment goes to the partition
of its word: the words around it, up to four on either side, as far as they are as frequent
as the pivot or more so. Rarer words, and those below the least frequency, end a fragment.
A partition counts the phrases it owns level by level, longer ones only where both shorter
ones are frequent, and gives the frequent ones.

What is hot is split twice: equal fragments of a chunk of text are one with a weight, and
a pivot of many occurrences is dealt into parts by a hash of the fragment, whose counts are
summed afterwards. The fragments that a chunk sends to a part travel as one packed row.

Texts are cut into chunks whatever their length, and their words are numbered in each
chunk. The frequencies come back to the chunk's own list of distinct words by a join, so
nothing as large as the vocabulary is broadcast.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.common import join_back, ship, store
from vellum.storage import discard

LEAST = 100
LONGEST = 5
TOP = 2_000
#: Bytes of text whose words are numbered together.
CHUNK_BYTES = 4_000_000
#: Occurrences of pivots that meet in one group, on average, and the most that a part of one pivot stands for.
PART_WORDS, PIVOT_WORDS = 300_000, 150_000
#: Pieces end at these bytes; letters A-Z become lower case.
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes.maketrans(PIECE_ENDS + bytes(range(65, 91)), b"\n" * len(PIECE_ENDS) + bytes(range(97, 123)))

CHUNK_SCHEMA = "chunk long, lang string, total long, words array<binary>, times array<bigint>, sequence binary, weights binary"


def _chunk(pieces: Counter) -> tuple[list[bytes], list[int], bytes, bytes]:
    """Distinct words of pieces with their counts, all distinct pieces as word numbers (from 1) each ended by a 0, and the pieces' weights."""
    number = defaultdict(count(1).__next__)
    flat, sizes, weights = [], [], []
    for piece, times in pieces.items():
        words = piece.split()
        if words:
            flat += [number[w] for w in words]
            flat.append(0)
            sizes.append(len(words) + 1)
            weights.append(times)
    sequence = np.array(flat, "<u4")
    each = np.repeat(np.array(weights, np.int64), sizes)
    times = np.bincount(sequence, each, len(number) + 1).astype(np.int64)[1:]
    return list(number), times.tolist(), _planes(sequence), _planes(np.array(weights, "<u8"))


def _planes(values: np.ndarray) -> bytes:
    """Numbers as all their lowest bytes, then all the next ones, and so on: the high ones are mostly zeros, which packs well."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def _unplaned(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts (lang, text as bytes) of a task in chunks of one language each."""
    chunk = TaskContext.get().partitionId() << 32
    held: dict[str, Counter] = {}
    size = 0

    def given() -> Iterator[pa.RecordBatch]:
        nonlocal chunk
        for lang, pieces in held.items():
            words, times, sequence, weights = _chunk(pieces)
            if words:
                columns = [[chunk], [lang], [sum(times)], [words], [times], [sequence], [weights]]
                types = [pa.int64(), pa.string(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["chunk", "lang", "total", "words", "times", "sequence", "weights"])
                chunk += 1
        held.clear()

    for batch in batches:
        for lang, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            pieces = data.as_py().translate(_TABLE).split(b"\n")
            start = 0
            while start < len(pieces):
                stop = start
                while stop < len(pieces) and size < CHUNK_BYTES:
                    size += len(pieces[stop]) + 1
                    stop += 1
                held.setdefault(lang, Counter()).update(pieces[start:stop])
                start = stop
                if size >= CHUNK_BYTES:
                    yield from given()
                    size = 0
    yield from given()


def frequent_words(chunks: DataFrame, least: int) -> DataFrame:
    """Words of ``least`` occurrences or more in their language: lang, word, f, id; ids ascend from 1 as f falls in a language."""
    words = chunks.select("lang", F.explode(F.arrays_zip("words", "times")).alias("w")).groupBy("lang", F.col("w.words").alias("word")).agg(F.sum("w.times").alias("f"))
    order = ["lang", F.col("f").desc(), "word"]
    ordered = store(words.filter(F.col("f") >= least).repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "words")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ordered.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))  # one row per partition
    inside = Window.partitionBy("part").orderBy(*order)
    return ordered.join(parts, "part").select("lang", "word", "f", (F.col("before") + F.row_number().over(inside)).alias("id"))


def _fragments(sequence: np.ndarray, weights: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct fragments, rows of 2 * LONGEST - 1 ids with the pivot in the middle and zeros around, and their weights.

    ``sequence`` has ids, and 0 for words that are not frequent; ``weights`` one number per place.
    """
    reach, kind = LONGEST - 1, f">u{width}"
    sequence = sequence.astype(f"<u{width}")
    padded = np.concatenate([np.zeros(reach, sequence.dtype), sequence, np.zeros(reach, sequence.dtype)])
    n = len(sequence)
    left, right = sequence > 0, sequence > 0
    sides = np.zeros((n, 2 * LONGEST - 1), kind)
    sides[:, reach] = sequence
    for step in range(1, LONGEST):
        here = padded[reach - step : reach - step + n]
        left = left & (here > 0) & (here < sequence)  # the pivot stands first where it stands again
        sides[left, reach - step] = here[left]
        here = padded[reach + step : reach + step + n]
        right = right & (here > 0) & (here <= sequence)
        sides[right, reach + step] = here[right]
    some = (sides[:, reach - 1] > 0) | (sides[:, reach + 1] > 0)
    rows, of = sides[some], weights[some]
    if not len(rows):
        return rows, of
    found = pa.FixedSizeBinaryArray.from_buffers(pa.binary(rows.shape[1] * width), len(rows), [None, pa.py_buffer(rows.tobytes())]).dictionary_encode()
    distinct = np.frombuffer(b"".join(found.dictionary.to_pylist()), kind).reshape(-1, rows.shape[1])
    return distinct, np.bincount(found.indices.to_numpy(), of, len(distinct)).astype(np.int64)


FRAGMENT_SCHEMA = "part int, lang string, dealt boolean, befores binary, afters binary, ids binary, weights binary"


def _mixed(values: np.ndarray) -> np.ndarray:
    """Numbers spread over 64 bits."""
    values = values.astype(np.uint64)
    for factor, shift in ((0x9E3779B97F4A7C15, 29), (0xC2B2AE3D27D4EB4F, 32)):
        values = values * np.uint64(factor)
        values ^= values >> np.uint64(shift)
    return values


def _routed(parts: int, pivot_words: int, width: int):
    """The function of a chunk: its word numbers become ids, and its fragments go to the parts of their pivots."""

    def run(chunk: pa.Table, known: pa.Table) -> pa.Table:
        columns: list[list] = [[] for _ in range(7)]
        found = known["known"].combine_chunks().flatten() if len(known) else ()
        if len(chunk) and len(found):
            sequence, weights = _unplaned(chunk["sequence"][0].as_py(), "<u4"), _unplaned(chunk["weights"][0].as_py(), "<u8").astype(np.int64)
            ids, times = np.zeros(int(sequence.max()) + 1, np.int64), np.zeros(int(sequence.max()) + 1, np.int64)
            place = np.asarray(found.field("place")) + 1
            ids[place], times[place] = np.asarray(found.field("id")), np.asarray(found.field("f"))
            rows, total = _fragments(ids[sequence], weights[np.cumsum(sequence == 0) - (sequence == 0)], width)
            pivots = rows[:, LONGEST - 1].astype(np.int64)
            order = np.argsort(ids, kind="stable")
            shares = np.maximum(-(-times[order[np.searchsorted(ids[order], pivots)]] // pivot_words), 1)
            salt = np.zeros(len(rows), np.uint64)
            for column in range(rows.shape[1]):
                salt = _mixed(salt ^ rows[:, column].astype(np.uint64))
            part = (_mixed(_mixed(pivots) ^ (salt % shares.astype(np.uint64))) % np.uint64(parts)).astype(np.int64)
            lane = part * 2 + (shares > 1)
            order = np.lexsort((pivots, lane))
            rows, total, lane = rows[order], total[order], lane[order]
            held = rows > 0
            befores, afters = (held[:, : LONGEST - 1].sum(axis=1), held[:, LONGEST:].sum(axis=1))
            starts = [*np.nonzero(np.diff(lane, prepend=-1))[0].tolist(), len(lane)]
            for i, j in zip(starts, starts[1:], strict=False):
                cells = int(lane[i]) // 2, chunk["lang"][0].as_py(), bool(lane[i] % 2), befores[i:j].astype(np.uint8).tobytes(), afters[i:j].astype(np.uint8).tobytes(), _planes(rows[i:j][held[i:j]].astype(f"<u{width}")), _planes(total[i:j].astype("<u8"))
                for values, cell in zip(columns, cells, strict=True):
                    values.append(cell)
        types = [pa.int32(), pa.string(), pa.bool_(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
        return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["part", "lang", "dealt", "befores", "afters", "ids", "weights"])

    return run


def _unpacked(rows: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Fragments of packed rows as in ``_fragments``, with the row each came in, and whether its pivot is dealt."""
    befores, afters = ([np.frombuffer(x, np.uint8) for x in rows[c].to_pylist()] for c in ("befores", "afters"))
    of = np.repeat(np.arange(len(rows)), [len(x) for x in befores])
    before, after = (np.concatenate(x).astype(np.int64) for x in (befores, afters))
    ids = np.concatenate([_unplaned(x, f"<u{width}") for x in rows["ids"].to_pylist()])
    weights = np.concatenate([_unplaned(x, "<u8") for x in rows["weights"].to_pylist()]).astype(np.int64)
    size = before + 1 + after
    row = np.repeat(np.arange(len(size)), size)
    column = np.arange(len(ids)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(LONGEST - 1 - before, size)
    whole = np.zeros((len(size), 2 * LONGEST - 1), f">u{width}")
    whole[row, column] = ids
    return whole, weights, of, np.asarray(rows["dealt"])[of]


def _mined(least: int, width: int):
    """The function of a part: counts of the phrases that its pivots own."""

    def run(rows: pa.Table) -> pa.Table:
        whole, weight, of, dealt = _unpacked(rows, width)
        reach = LONGEST - 1
        good: dict[tuple[int, int], np.ndarray] = {(0, 0): np.ones(len(whole), bool)}
        keys, totals, firsts = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for size in range(2, LONGEST + 1):
            for a in range(size):
                b = size - 1 - a
                wanted = np.ones(len(whole), bool)
                if a:
                    wanted &= (whole[:, reach - a] > 0) & good[a - 1, b]
                if b:
                    wanted &= (whole[:, reach + b] > 0) & good[a, b - 1]
                here = np.nonzero(wanted)[0]
                good[a, b] = np.zeros(len(whole), bool)
                if not len(here):
                    continue
                phrases = whole[here, reach - a : reach + b + 1].tobytes()
                found = pa.FixedSizeBinaryArray.from_buffers(pa.binary(width * size), len(here), [None, pa.py_buffer(phrases)]).dictionary_encode()
                index = found.indices.to_numpy()
                n = np.bincount(index, weight[here]).astype(np.int64)
                first = np.zeros(len(n), np.int64)
                first[index[::-1]] = here[::-1]
                kept = (n >= least) | dealt[first]  # a pivot dealt into parts is summed before it is judged
                good[a, b][here] = kept[index]
                kept = np.nonzero(kept)[0]
                keys += found.dictionary.take(pa.array(kept)).to_pylist()
                totals.append(n[kept])
                firsts.append(first[kept])
        first = np.concatenate(firsts)
        return pa.table([rows["lang"].take(pa.array(of[first])), pa.array(keys, pa.binary()), pa.array(np.concatenate(totals)), pa.array(dealt[first])], names=["lang", "phrase", "f", "dealt"])

    return run


PHRASE_SCHEMA = "lang string, phrase binary, f long, dealt boolean"


def _number(id: Column, width: int) -> Column:
    """An id as the bytes that stand for it in a phrase."""
    return F.unhex(F.lpad(F.hex(id), 2 * width, "0"))


def phrases(docs: DataFrame, least: int = LEAST, part_words: int = PART_WORDS, pivot_words: int = PIVOT_WORDS) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """Stored tables of frequent words (lang, word, f, id), of sums by language (lang, n), and of frequent phrases (lang, phrase, f).

    ``phrase`` holds the ids of two to LONGEST words, each of as many bytes as the number
    given last: four, or eight where there are more frequent words than four bytes can number.
    """
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("data"))
    chunks = store(texts.mapInArrow(_chunks, CHUNK_SCHEMA), "chunks")
    sums = store(chunks.groupBy("lang").agg(F.sum("total").alias("n")), "sums")
    words = store(frequent_words(chunks, least), "frequent")
    total, most = words.agg(F.coalesce(F.sum("f"), F.lit(0)), F.coalesce(F.max("id"), F.lit(0))).first()
    width = 4 if most < 1 << 32 else 8
    listed = chunks.select(F.col("chunk").alias("of"), "lang", F.posexplode("words").alias("place", "word"))
    # Nearly all words of a small corpus are rare and few of a large one: every listed word gets an answer, by a shuffle at every size.
    answered = listed.join(words.hint("merge"), ["lang", "word"], "left")
    known = answered.groupBy("of").agg(F.collect_list(F.when(F.col("id").isNotNull(), F.struct("place", "id", "f"))).alias("known"))
    route = _routed(max(1, -(-total // part_words)), pivot_words, width)
    fragments = chunks.select("chunk", "lang", "sequence", "weights").groupBy("chunk").cogroup(known.groupBy("of")).applyInArrow(route, FRAGMENT_SCHEMA)
    mined = store(fragments.groupBy("part").applyInArrow(_mined(least, width), PHRASE_SCHEMA), "mined")
    discard(chunks)
    whole = mined.filter("NOT dealt").select("lang", "phrase", "f")
    dealt = mined.filter("dealt").groupBy("lang", "phrase").agg(F.sum("f").alias("f")).filter(F.col("f") >= least)
    return words, sums, store(whole.unionByName(dealt), "phrases"), width


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, **sizes: int) -> DataFrame:
    """The ``top`` collocations of every language: lang, rank, phrase, a, l, r, n, score.

    Texts (lower case A-Z) are split into pieces at `[.,;:!?\\x0A-\\x0D]` and those into words
    at spaces and tabs; phrases of two to five words with ``least`` occurrences (a) are
    scored by their worst cut: floor(1000 a n / (l r)) with the frequencies l and r of the
    parts and n words in the language; ties go to the first cut. A phrase that stands in a
    longer one of the same frequency is left out. Null languages count as `und`, null texts
    as empty; repeated rows count each; empty tables give an empty result. Only lang and
    text are read, so extra columns cannot clash.
    """
    words, sums, found, width = phrases(docs, least, **sizes)
    size = (F.length("phrase") / width).cast("int")
    counts = store(found.select(F.col("phrase").alias("part"), "f").unionByName(words.select(_number(F.col("id"), width).alias("part"), "f")), "counts")
    cuts = found.select("lang", "phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.select("*", F.expr(f"substring(phrase, 1, {width} * k)").alias("left"), F.expr(f"substring(phrase, {width} * k + 1)").alias("right"))
    spread = F.concat("phrase", F.col("k").cast("string").cast("binary"), F.lit("|").cast("binary"))  # of a length that no part has
    # A part of q phrases has a frequency of q times `least` or more, so the 256 most frequent are the hot ones.
    cuts = join_back(cuts, counts.select(F.col("part").alias("left"), F.col("f").alias("l")), "left", "l", spread)
    cuts = join_back(cuts, counts.select(F.col("part").alias("right"), F.col("f").alias("r")), "right", "r", spread)
    cuts = cuts.join(sums, "lang")
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    score = F.call_function("div", exact("a") * F.lit(1000).cast("decimal(4,0)") * exact("n"), exact("l") * exact("r"))
    worst = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("worst")).select("lang", "phrase", "worst.*")
    longer = found.filter(size > 2).select("f", F.explode(F.array(F.expr(f"substring(phrase, 1, length(phrase) - {width})"), F.expr(f"substring(phrase, {width} + 1)"))).alias("inside"))
    closed = worst.join(longer.distinct(), (F.col("phrase") == F.col("inside")) & (F.col("a") == F.col("f")), "left_anti")
    order = [F.col("score").desc(), F.col("a").desc()]
    first = store(closed.withColumn("place", F.rank().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("place") <= top), "first")  # with ties, which the words decide
    spelled = first.select("lang", "phrase", F.posexplode(F.sequence(F.lit(1), size)).alias("at", "k")).select("lang", "phrase", "at", F.expr(f"substring(phrase, {width} * (k - 1) + 1, {width})").alias("part"))
    letters = spelled.join(words.select(_number(F.col("id"), width).alias("part"), "word"), "part")
    texts = letters.groupBy("lang", "phrase").agg(F.sort_array(F.collect_list(F.struct("at", F.col("word").cast("string").alias("word")))).alias("w"))
    texts = texts.select("lang", "phrase", F.concat_ws(" ", F.transform("w", lambda x: x["word"])).alias("text"))
    named = first.drop("place").join(texts, ["lang", "phrase"]).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order, "text")))
    return named.filter(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), F.col("text").alias("phrase"), "a", "l", "r", "n", "score")


ship(__name__)
