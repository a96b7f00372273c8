"""Quotes and numbers checked against their sources; repeated page edges; greedy chunks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions.identifiers import nfkc_of_odd
from vellum.functions.text import CJK, MAYBE_CJK, edge_key, numbers_in
from vellum.operators.updates import stepwise
from vellum.session import ship
from vellum.storage import store

FUZZY_SHARE = 0.9
SLACK = 2

#: Rarest tokens of a quote that are looked at beside those it may miss; as many must stand in a text.
ANCHORS = 3


#: Hyphens and apostrophes dropped within words of texts without a sign of ``MAYBE_UNFOLDED``: the ranges in front tell most letters in few steps, and the letter before a sign is looked at only where the sign is.
PLAIN_SIGN = r"[\-'`\x{2010}-\x{2019}&&[\-'`\x{2010}-\x{2013}\x{2018}\x{2019}]](?:(?<=\p{L}[\-\x{2010}-\x{2013}])\s*(?=\p{L})|(?<=\p{L}['`\x{2018}\x{2019}])(?=\p{L}|\s|$))"
#: Small letters and digits of texts without a sign of ``MAYBE_UNFOLDED``. Signs named one by one are told by one table, ranges and classes each by a call.
PLAIN = f"[{''.join(map(chr, (*range(48, 58), *range(97, 123), *range(223, 247), *range(248, 256))))}\\x{{100}}-\\x{{17E}}]+"


def match_tokens(column: Column) -> Column:
    """Words and numbers of a text as compared: folded, hyphens and apostrophes within words dropped, CJK characters one by one.

    Most texts have no sign that needs folding, no soft hyphen, unseen sign or CJK character,
    all told by one look. There what a hyphen or an apostrophe is decided by is never
    dropped with another, so one pass drops them all.
    """
    text = F.coalesce(column, F.lit(""))
    odd = nfkc_of_odd(text)
    plain = F.lower(F.regexp_replace(text, PLAIN_SIGN, ""))
    # U+02BC is an apostrophe and a letter, and look-behinds miss letters beyond 16 bits: here the letter before a sign is taken with it.
    hyphens = r"(\p{L})[\-\x{AD}\x{2010}-\x{2013}\x{2212}]"
    bare = F.regexp_replace(odd, r"[\x{200B}-\x{200D}\x{2060}\x{FEFF}]", "")
    bare = F.regexp_replace(F.regexp_replace(bare, rf"{hyphens}\s+(?=\p{{L}})", "$1"), r"\x{AD}", "")
    bare = F.regexp_replace(F.regexp_replace(bare, rf"{hyphens}(?=\p{{L}})", "$1"), r"(\p{L})['’‘`´ʼ](?=\p{L}|\s|$)", "$1")
    apart = F.regexp_replace(F.lower(bare), f"[{MAYBE_CJK}&&{CJK}]", " $0 ")
    found = lambda text, pattern: F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(odd.isNull(), found(plain, PLAIN)).otherwise(found(apart, r"[\p{L}\p{M}\p{N}]+"))


def misses_of(n: Column) -> Column:
    """Tokens that a quote of ``n`` may miss: a tenth, none below three tokens."""
    return F.when(n < 3, 0).otherwise(n - F.ceil(n * FUZZY_SHARE)).cast("int")


def candidate_pairs(quotes: DataFrame, texts: DataFrame, fuzzy: bool) -> DataFrame:
    """Pairs (quote_id, text_id) with the tokens of both, joined on the rarest tokens of the quotes.

    A text that matches with m misses lacks at most m tokens of the quote, so of the m +
    ``ANCHORS`` rarest distinct ones it holds ``ANCHORS``, or all but m where a quote has
    fewer: no match is lost, very common words join nothing, and hardly any other text
    passes. Tokens go by their hashes, which at worst lets a pair more through. Takes
    (quote_id, tokens), stored, and (text_id, tokens), stored, or (text_id, text): then
    texts are read twice, the second time only those of pairs are made tokens, and no
    tokens are stored.
    """
    split = lambda df: df if "tokens" in df.columns else df.withColumn("tokens", match_tokens(F.col("text"))).drop("text")
    asked = quotes.select("quote_id", F.xxhash64("tokens").alias("of"), (misses_of(F.size("tokens")) if fuzzy else F.lit(0)).alias("misses"), F.explode("tokens").alias("token")).withColumn("token", F.xxhash64("token")).distinct()
    held = split(texts).select("text_id", F.explode(F.array_distinct("tokens")).alias("token")).select("text_id", F.xxhash64("token").alias("token")).join(asked.select("token").distinct(), "token", "left_semi")
    held = store(held, "held")
    frequency = held.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    ranked = asked.join(frequency, "token", "left").groupBy("quote_id", "of", "misses").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "token"))).alias("by_df"))
    rarest = ranked.withColumn("by_df", F.slice("by_df", 1, F.col("misses") + ANCHORS))
    anchors = rarest.select("quote_id", "of", F.greatest(F.size("by_df") - F.col("misses"), F.lit(1)).alias("least"), F.explode("by_df").alias("a")).select("quote_id", "of", "least", "a.token")
    # Once stored, anchors and pairs have a size that Spark knows: while they are few, neither what is held nor texts are shuffled.
    met = store(anchors, "anchors").join(held, "token").groupBy("quote_id", "of", "text_id").agg(F.count(F.lit(1)).alias("n"), F.max("least").alias("least"))
    pairs = store(met.filter("n >= least").select("quote_id", "text_id").distinct(), "pairs")
    return split(texts.join(pairs, "text_id")).withColumnRenamed("tokens", "text").join(quotes.withColumnRenamed("tokens", "quote"), "quote_id")


def _grams(tokens: Column) -> Column:
    """Hashes of all runs of three tokens, in order; none for fewer tokens."""
    return F.when(F.size(tokens) >= 3, F.transform(F.sequence(F.lit(0), F.size(tokens) - 3), lambda k: F.xxhash64(F.get(tokens, k), F.get(tokens, k + 1), F.get(tokens, k + 2))))


def exact_quotes(quotes: DataFrame, texts: DataFrame) -> DataFrame:
    """``quote_id, text_id`` where the tokens of the quote stand in the text in one run.

    A quote is looked for by its two rarest runs of three tokens, which must stand at their
    distance; only then are tokens compared. Quotes of one or two tokens are looked for by
    the rarest. Takes (quote_id, tokens) and (text_id, tokens), both stored.
    """
    short = quotes.filter(F.size("tokens") < 3)
    line = lambda c: F.concat(F.lit(" "), F.array_join(c, " "), F.lit(" "))
    few = candidate_pairs(short, texts, fuzzy=False).filter(F.contains(line("text"), line("quote"))).select("quote_id", "text_id") if short.take(1) else None
    asked = store(quotes.filter(F.size("tokens") >= 3).select("quote_id", F.posexplode(_grams(F.col("tokens"))).alias("at", "gram")), "asked")
    wanted = store(asked.select("gram").distinct(), "wanted")
    held = store(texts.select("text_id", F.posexplode(_grams(F.col("tokens"))).alias("place", "gram")).join(wanted, "gram", "left_semi"), "held")
    rarity = held.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    ranked = asked.join(rarity, "gram", "left").groupBy("quote_id").agg(F.slice(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "at", "gram"))), 1, 2).alias("best"))
    anchors = store(ranked.select("quote_id", F.size("best").alias("needed"), F.explode("best").alias("b")).select("quote_id", "needed", "b.at", "b.gram"), "anchors")
    # A place counts once for each of a quote's anchors that stands where it should.
    hits = anchors.join(held, "gram").groupBy("quote_id", "text_id", (F.col("place") - F.col("at")).alias("start")).agg(F.count_distinct("at").alias("n"), F.max("needed").alias("needed"))
    met = hits.filter("n = needed AND start >= 0").select("quote_id", "text_id", "start")
    pairs = met.join(quotes, "quote_id").withColumnRenamed("tokens", "quote").join(texts, "text_id")
    same = F.slice("tokens", F.col("start") + 1, F.size("quote")) == F.col("quote")
    many = pairs.filter(same).select("quote_id", "text_id").distinct()
    return many if few is None else many.unionByName(few)


def lcs_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, by bits: a column of the usual table is one number, whose zeros are the steps up."""
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    column = full
    for y in b:
        if met := column & places.get(y, 0):
            column = ((column + met) | (column - met)) & full
    return len(a) - column.bit_count()


def fuzzy_in(quote: list[str], text: list[str]) -> bool:
    """Whether the quote stands in the text, up to a tenth of its tokens missing, in a window about as long as it."""
    n = len(quote)
    if not n:
        return False
    need = n if n < 3 else math.ceil(n * FUZZY_SHARE)
    places: dict[str, list[int]] = {}
    for k, token in enumerate(text):
        places.setdefault(token, []).append(k)
    order = sorted(range(n), key=lambda k: len(places.get(quote[k], ())))
    first = order[0]
    if any(text[p - first : p - first + n] == quote for p in places.get(quote[first], ()) if p >= first):
        return True
    if need == n:
        return False
    slack = n - need + SLACK
    tried = set()
    for k in order[: n - need + 1]:
        for p in places.get(quote[k], ()):
            start = max(0, p - k - slack)
            if start not in tried:
                tried.add(start)
                if lcs_length(quote, text[start : p - k + n + slack]) >= need:
                    return True
    return False


def _fuzzy(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        keep = [fuzzy_in(list(q), list(t)) for q, t in zip(batch["quote"], batch["text"], strict=True)]
        yield batch.loc[keep, ["quote_id", "text_id"]]


def fuzzy_quotes(quotes: DataFrame, texts: DataFrame) -> DataFrame:
    """``quote_id, text_id`` where the quote stands in the text with up to a tenth of its tokens missing."""
    return candidate_pairs(quotes, texts, fuzzy=True).select("quote_id", "text_id", "quote", "text").mapInPandas(_fuzzy, "quote_id long, text_id long")


def unsupported_numbers(claims: DataFrame, sources: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, number`` of the claims' numbers that no source of the same keys has."""
    # Only what is left is made distinct: tables of all numbers met so far would grow with a task's rows.
    of = lambda df: df.select(*keys, F.explode(F.array_distinct(numbers_in(F.col("text")))).alias("number"))
    return of(claims).join(of(sources), [*keys, "number"], "left_anti").distinct()


def repeated_edges(pages: DataFrame, lines: int = 3, least: int = 3, share: float = 0.3) -> DataFrame:
    """``doc, key, n_pages`` of masked lines among the first and last ``lines`` of many pages of a document.

    ``pages`` has doc, page and text. A line repeats if it stands on ``least`` pages and on ``share`` of all.
    """
    every = F.filter(F.split("text", "\n"), lambda line: F.trim(line) != "")
    edges = F.array_union(F.slice(every, 1, lines), F.slice(every, F.greatest(F.size(every) - (lines - 1), F.lit(1)), lines))
    rows = pages.select("doc", "page", F.explode(F.array_distinct(F.transform(edges, edge_key))).alias("key")).distinct()
    counts = rows.groupBy("doc", "key").agg(F.count(F.lit(1)).alias("n_pages"))
    totals = pages.groupBy("doc").agg(F.countDistinct("page").alias("total"))
    return counts.join(totals, "doc").filter(F.col("n_pages") >= F.greatest(F.lit(least), F.ceil(F.col("total") * share))).select("doc", "key", "n_pages")


class Packing:
    """Puts entries in turn into the last chunk while its size and count stay within limits."""

    def __init__(self, most: int, count: int) -> None:
        self.most, self.count, self.chunk, self.used, self.n = most, count, 0, 0, 0

    def next(self, size: int) -> int:
        if self.n > 0 and (self.used + size > self.most or self.n >= self.count):
            self.chunk, self.used, self.n = self.chunk + 1, 0, 0
        self.used, self.n = self.used + size, self.n + 1
        return self.chunk


def greedy_chunks(rows: DataFrame, group: str, order: str, size: Column, most: int, count: int) -> DataFrame:
    """``group, order, chunk``: rows of a group packed in order, a new chunk where size or count would pass the limit.

    A row larger than the limit is a chunk of its own; a null size is none. Rows need a
    group. A group streams through one task with a state of fixed size.
    """
    sized = rows.filter(F.col(group).isNotNull()).select(group, order, F.coalesce(size, F.lit(0)).cast("long").alias("_size"))
    return stepwise(sized, group, (order, "_size"), "chunk long", lambda: Packing(most, count), lambda state, row: state.next(int(row[2]))).drop("_size")


ship(__name__)
