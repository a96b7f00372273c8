"""Quotes placed in running texts: where each stands, exactly or nearly, in reading order and without overlap; evidence verified by its quotes.

Each quote's possible places are found by itself, in lanes that hold QUOTES_A_LANE quotes of a
text; a text with many quotes is looked at in several lanes. Which places are taken is then
decided quote by quote in reading order, in a stream over a text's quotes.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions.prose import join_hyphens
from vellum.operators.updates import stepwise
from vellum.operators.verify import FUZZY_SHARE, SLACK, lcs_length
from vellum.session import ship
from vellum.storage import store

QUOTES_A_LANE = 500
#: Quotes of fewer tokens prove nothing.
LEAST_TOKENS = 4

SCRIPTS = r"\p{Script=Han}\p{Script=Hiragana}\p{Script=Katakana}\p{Script=Hangul}"
TOKEN = regex.compile(rf"[{SCRIPTS}]|(?:(?![{SCRIPTS}])[\p{{L}}\p{{M}}\p{{N}}])+")
#: The same of a text of ASCII alone, in small letters.
PLAIN = re.compile(r"[a-z0-9]+")
#: Signs that leave something out: three dots or more, or such in brackets.
LEFT_OUT = r"\s*(?:[\[(（［]\s*(?:…+|(?:\.\s*){3})\s*[\])）］]|(?:\.\s*){3,}|…+|⋯+)\s*"

Span = tuple[int, int]


def misses(n: int) -> int:
    """Tokens that a quote of ``n`` may miss: a tenth, none below three tokens."""
    return n - math.ceil(n * FUZZY_SHARE) if n >= 3 else 0


class Places:
    """Tokens of a text with their places. What a quote finds is kept, so repeated quotes are looked for once."""

    def __init__(self, text: str):
        found = list(PLAIN.finditer(text.lower()) if text.isascii() else TOKEN.finditer(text))
        self.tokens = [_folded(m[0]) for m in found]
        self.starts, self.ends = [m.start() for m in found], [m.end() for m in found]
        self.known: dict[tuple[bool, tuple[str, ...]], list[Span]] = {}
        self.at: dict[str, list[int]] = {}
        for k, token in enumerate(self.tokens):
            self.at.setdefault(token, []).append(k)

    def rarest(self, quote: list[str]) -> list[int]:
        """Places in the quote, those of the rarest tokens of the text first."""
        return sorted(range(len(quote)), key=lambda k: len(self.at.get(quote[k], ())))

    def exact(self, quote: list[str]) -> list[Span]:
        """Where the quote stands token by token, in order."""
        return self._kept(True, quote, self._exact)

    def near(self, quote: list[str]) -> list[Span]:
        """Where nine tenths of the quote stand in order in a stretch about as long as it; none for under three tokens."""
        return self._kept(False, quote, self._near)

    def _kept(self, exact: bool, quote: list[str], find) -> list[Span]:
        key = exact, tuple(quote)
        if key not in self.known:
            self.known[key] = find(quote)
        return self.known[key]

    def _exact(self, quote: list[str]) -> list[Span]:
        n = len(quote)
        if not n:
            return []
        anchor = self.rarest(quote)[0]
        starts = (p - anchor for p in self.at.get(quote[anchor], ()))
        return [(s, s + n - 1) for s in starts if s >= 0 and self.tokens[s : s + n] == quote]

    def _near(self, quote: list[str]) -> list[Span]:
        n = len(quote)
        if n < 3:
            return []
        most = misses(n)
        need, slack = n - most, most + SLACK
        order = self.rarest(quote)
        places = [self.at.get(quote[k], ()) for k in order]
        tried, out = set(), []
        found: dict[tuple[str, ...], Span | None] = {}
        for anchor in order[: most + 1]:
            for p in self.at.get(quote[anchor], ()):
                start, stop = max(0, p - anchor - slack), p - anchor + n + slack
                if start in tried:
                    continue
                tried.add(start)
                if _lacks(places, start, stop, most):
                    continue
                stretch = tuple(self.tokens[start:stop])
                if stretch not in found:
                    found[stretch] = matched(quote, stretch) if lcs_length(quote, stretch) >= need else None
                if span := found[stretch]:
                    out.append((start + span[0], start + span[1]))
        return out


def _lacks(places: list[list[int]], start: int, stop: int, most: int) -> bool:
    """Whether more than ``most`` of the tokens, given by their places, the rarest first, are not from ``start`` up to ``stop``."""
    for at in places:
        k = bisect_left(at, start)
        if k == len(at) or at[k] >= stop:
            most -= 1
            if most < 0:
                return True
    return False


class PageIndex:
    """Pages of a text, in order: which of them can hold a quote is told by its tokens, only those are read."""

    def __init__(self, pages: list[tuple[int, str]]):
        self.pages = sorted(pages, key=lambda x: x[0])
        self.places: dict[int, Places] = {}
        self.holds: dict[str, int] = {}
        for k, (_, text) in enumerate(self.pages):
            for token in set(_tokens(text)):
                self.holds[token] = self.holds.get(token, 0) | 1 << k

    def _possible(self, quote: list[str]) -> int:
        """Pages, as bits, that lack no more tokens of the quote than it may miss."""
        lacking = [(1 << len(self.pages)) - 1] * (misses(len(quote)) + 1)  # that lack at most 0, 1, ... so far
        for token in quote:
            has = self.holds.get(token, 0)
            lacking = [(now & has) | less for now, less in zip(lacking, [0, *lacking], strict=False)]
        return lacking[-1]

    def first(self, quotes: list[list[str]]) -> int | None:
        """The first page on which all the quotes stand, exactly or nearly."""
        left = (1 << len(self.pages)) - 1 if quotes and all(quotes) else 0  # an empty quote stands nowhere
        for quote in quotes:
            left &= self._possible(quote)
        while left:
            k = (left & -left).bit_length() - 1
            left &= left - 1
            if k not in self.places:
                self.places[k] = Places(self.pages[k][1])
            if all(self.places[k].exact(q) or self.places[k].near(q) for q in quotes):
                return self.pages[k][0]
        return None


def matched(quote: list[str], stretch: list[str] | tuple[str, ...]) -> Span:
    """First and last place of the stretch that a longest common subsequence uses: from the ends, a pair that is part of one is taken, else the quote gives way first."""
    length = [[0] * (len(stretch) + 1)]
    for x in quote:
        above, row = length[-1], [0]
        for j, y in enumerate(stretch):
            row.append(above[j] + 1 if x == y else max(above[j + 1], row[j]))
        length.append(row)
    i, j, used = len(quote), len(stretch), []
    while i and j:
        if quote[i - 1] == stretch[j - 1]:
            used.append(j - 1)
            i, j = i - 1, j - 1
        elif length[i - 1][j] >= length[i][j - 1]:
            i -= 1
        else:
            j -= 1
    return used[-1], used[0]


def fragments(column: Column) -> Column:
    """Parts of a quote between signs that leave something out, broken words put together."""
    text = join_hyphens(F.regexp_replace(F.coalesce(column, F.lit("")), r"[\x{200B}-\x{200D}\x{2060}\x{FEFF}]", ""))
    return F.filter(F.split(text, LEFT_OUT), lambda f: f.rlike(r"[\p{L}\p{M}\p{N}]"))


def _folded(token: str) -> str:
    return token.lower() if token.isascii() else unicodedata.normalize("NFKC", token).lower()


def _tokens(text: str) -> list[str]:
    return PLAIN.findall(text.lower()) if text.isascii() else [_folded(m[0]) for m in TOKEN.finditer(text)]


def in_lanes(quotes: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both with ``lane`` and the number of ``lanes``: quotes of a text dealt into lanes, and the text once for each; texts without quotes are left out."""
    quotes = store(quotes, "quotes")  # they are read twice
    sizes = store(quotes.groupBy("text_id").agg(F.ceil(F.count(F.lit(1)) / QUOTES_A_LANE).alias("lanes")), "lanes")
    dealt = quotes.join(sizes, "text_id").withColumn("lane", F.pmod(F.xxhash64(*[F.col(c).cast("string") for c in quotes.columns if c != "text_id"]), F.col("lanes")).cast("int"))
    held = texts.join(sizes, "text_id").withColumn("lane", F.explode(F.sequence(F.lit(0), (F.col("lanes") - 1).cast("int"))))
    return dealt, held


_SPANS = pa.list_(pa.list_(pa.int32()))
FOUND = [(name, _SPANS, "array<array<int>>") for name in ("exact", "near")]


def _asked(dealt: DataFrame, held: DataFrame, columns: list[str], found: list[tuple[str, pa.DataType, str]], prepare, answer, order: tuple[str, ...] = ()) -> DataFrame:
    """Quotes with what ``answer(prepare(sources), fragments)`` says of each; sources are the pairs (page, text) of its lane.

    A lane's texts come before its quotes in a sorted stream, so a lane costs no call of its own and no quotes are held.
    """
    quotes = dealt.withColumn("_quote", F.lit(1))
    rows = held.withColumn("_quote", F.lit(0)).unionByName(quotes, allowMissingColumns=True).select(*columns, "lane", "_quote", "fragments", "_page", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sources, ready = None, [], None
        for batch in batches:
            told: list[list] = [[] for _ in found]
            quote = batch["_quote"].to_pylist()
            for key, is_quote, fragments, page, text in zip(zip(batch["text_id"].to_pylist(), batch["lane"].to_pylist(), strict=True), quote, *(batch[c].to_pylist() for c in ("fragments", "_page", "text")), strict=True):
                if key != now:
                    now, sources, ready = key, [], None
                if not is_quote:
                    sources.append((page, text or ""))
                    continue
                if ready is None:
                    ready = prepare(sources)
                for out, value in zip(told, answer(ready, [_tokens(f) for f in fragments or []]), strict=True):
                    out.append(value)
            kept = batch.filter(pa.array([bool(q) for q in quote], pa.bool_()))
            yield pa.RecordBatch.from_arrays([*[kept[c] for c in columns], *[pa.array(out, kind) for out, (_, kind, _) in zip(told, found, strict=True)]], names=[*columns, *[name for name, _, _ in found]])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.select(*columns).schema], *[f"{name} {kind}" for name, _, kind in found]])
    return rows.repartition("text_id", "lane").sortWithinPartitions("text_id", "lane", "_quote", *order).mapInArrow(run, schema)


def _placed_in(sources: list[tuple[None, str]]) -> Places | None:
    return Places("\n".join(sorted(text for _, text in sources))) if sources else None


def _flat(places: Places | None, found: list[Span]) -> list[int]:
    return [x for a, b in found for x in (a, b, places.starts[a], places.ends[b])]


def _all_places(places: Places | None, asked: list[list[str]]) -> tuple[list, list]:
    return tuple([_flat(places, find(places, q)) if places else [] for q in asked] for find in (Places.exact, Places.near))


def _taken_in(ready: tuple[Places | None, Taken], asked: list[list[str]]) -> tuple[list[list[int]] | None]:
    places, taken = ready
    return (taken.place([_flat(places, places.exact(q)) for q in asked], lambda k: _flat(places, places.near(asked[k]))) if places else None,)


def candidates(quotes: DataFrame, texts: DataFrame) -> DataFrame:
    """``quotes`` (text_id, pos, quote_id, quote) with ``exact`` and ``near``: of each fragment its places (first and last token, start and end), flat.

    ``texts`` has text_id and text, one row per id (several are one text, in order). Quotes
    of ids that no text has find nothing.
    """
    return _asked(*_wanted(quotes, texts), ["text_id", "pos", "quote_id"], FOUND, _placed_in, _all_places)


def _wanted(quotes: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    wanted = quotes.select("text_id", "pos", "quote_id", fragments(F.col("quote")).alias("fragments")).filter("text_id IS NOT NULL")
    return in_lanes(wanted, texts.select("text_id", F.lit(None).cast("int").alias("_page"), "text"))


class Taken:
    """Places of a text that earlier quotes have taken, and where the last of them ended."""

    def __init__(self) -> None:
        self.firsts: list[int] = []
        self.last: dict[int, int] = {}
        self.prefer = 0

    def free(self, first: int, last: int) -> bool:
        """Whether no taken place has a token in common with this one."""
        k = bisect_left(self.firsts, first)
        return (k == 0 or self.last[self.firsts[k - 1]] < first) and (k == len(self.firsts) or self.firsts[k] > last)

    def choose(self, flat: list[int], prefer: int) -> tuple[int, int, int, int] | None:
        """Of the free places the first at or after ``prefer``, or else the first."""
        found = [tuple(flat[k : k + 4]) for k in range(0, len(flat), 4)]
        return min((x for x in found if self.free(x[0], x[1])), key=lambda x: (x[0] < prefer, x[0]), default=None)

    def place(self, exact, near) -> list[list[int]] | None:
        """Places of all fragments of a quote, in order, taken from now on; None, and nothing taken, if one has no place after the one before.

        ``near`` is asked only for fragments without a free exact place.
        """
        spans: list[tuple[int, int, int, int]] = []
        prefer = self.prefer
        for k, a in enumerate(exact):
            span = self.choose(list(a), prefer) or self.choose(list(near(k)), prefer)
            if span is None or (spans and span[0] <= spans[-1][1]):
                return None
            spans.append(span)
            prefer = span[1] + 1
        if not spans:
            return None
        for first, last, _, _ in spans:
            insort(self.firsts, first)
            self.last[first] = last
        self.prefer = prefer
        return [[int(start), int(end)] for _, _, start, end in spans]


def placed(quotes: DataFrame, texts: DataFrame) -> DataFrame:
    """``text_id, pos, quote_id, spans``: where each quote stands in its text (starts and ends of its fragments), null where it does not.

    Quotes are placed in order of ``pos``, then quote_id: each at its first free place after
    the one before, else at its first free place, an exact one before a near one. Fragments of
    a quote follow each other. Empty quotes and ids stand nowhere. Rows without a text_id are
    left out, an empty table gives none.
    """
    columns = ["text_id", "pos", "quote_id"]
    dealt, held = _wanted(quotes, texts)
    one, many = ([df.filter(where) for df in (dealt, held)] for where in ("lanes = 1", "lanes > 1"))
    # A text of one lane is decided where it is read; else places found in several lanes are brought together.
    whole = _asked(*one, columns, [("spans", _SPANS, "array<array<int>>")], lambda sources: (_placed_in(sources), Taken()), _taken_in, ("pos", "quote_id"))
    found = _asked(*many, columns, FOUND, _placed_in, _all_places)
    parted = stepwise(found, "text_id", ("pos", "quote_id"), "spans array<array<int>>", Taken, lambda taken, row: taken.place(row.exact, lambda k: row.near[k]))
    return whole.unionByName(parted.select(*columns, "spans"))


def marked(texts: DataFrame, spans: DataFrame, opening: Column, closing: Column) -> DataFrame:
    """``text_id, text`` with the marks put in: every line of a span is wrapped by itself, a heading's sign stays outside.

    ``spans`` is as from ``placed``, with what the columns of the marks need.
    """
    rows = spans.select("text_id", F.explode("spans").alias("span"), opening.alias("open"), closing.alias("close"))
    marks = rows.groupBy("text_id").agg(F.sort_array(F.collect_list(F.struct(F.get("span", F.lit(0)).alias("start"), F.get("span", F.lit(1)).alias("end"), "open", "close"))).alias("marks"))
    both = texts.select("text_id", "text").join(marks, "text_id", "left")

    def wrapped(mark: Column) -> Column:
        inside = F.split(F.substring("text", mark["start"] + 1, mark["end"] - mark["start"]), "\n")
        parts = [r"^((?:#{1,6} )?\s*)(.*?)(\s*)$"]

        def line(x: Column) -> Column:
            lead, body, tail = (F.regexp_extract(x, parts[0], k) for k in (1, 2, 3))
            return F.when(body == "", x).otherwise(F.concat(lead, mark["open"], body, mark["close"], tail))

        return F.array_join(F.transform(inside, line), "\n")

    def piece(mark: Column, k: Column) -> Column:
        before = F.coalesce(F.get("marks", k - 1)["end"], F.lit(0))
        return F.concat(F.substring("text", before + 1, mark["start"] - before), wrapped(mark))

    rest = F.substring("text", F.element_at("marks", -1)["end"] + 1, F.length("text"))
    text = F.when(F.col("marks").isNull(), F.col("text")).otherwise(F.concat(F.array_join(F.transform("marks", piece), ""), rest))
    return both.select("text_id", text.alias("text"))


def _texts_and_pages(sources: list[tuple[int | None, str]]) -> tuple[list[Places], PageIndex]:
    return [Places(text) for page, text in sources if page is None], PageIndex([x for x in sources if x[0] is not None])


def _verified(ready: tuple[list[Places], PageIndex], asked: list[list[str]]) -> tuple[bool, int | None]:
    texts, pages = ready
    stands = any(bool(asked) and all(where.exact(q) or where.near(q) for q in asked) for where in texts)
    good = sum(map(len, asked)) >= LEAST_TOKENS and stands
    return good, pages.first(asked) if good else None


def verified_quotes(quotes: DataFrame, texts: DataFrame, pages: DataFrame) -> DataFrame:
    """``text_id, item, n, quote, page, kept, page_found``: of each quote whether it stands in a text of its id, and on which page first.

    ``quotes`` has text_id, item, n, quote and page (as given, may be null); ``texts`` text_id
    and text, ``pages`` text_id, page and text. A quote of under LEAST_TOKENS tokens is not
    kept; ``page_found`` is null where no page has a kept quote, which then keeps the page given.
    """
    wanted = quotes.select("text_id", "item", "n", "quote", F.col("page").cast("int").alias("page"), fragments(F.col("quote")).alias("fragments")).filter("text_id IS NOT NULL")
    sources = texts.select("text_id", F.lit(None).cast("int").alias("_page"), "text").unionByName(pages.select("text_id", F.col("page").cast("int").alias("_page"), "text").filter("_page IS NOT NULL"))
    dealt, held = in_lanes(wanted, sources)
    return _asked(dealt, held, ["text_id", "item", "n", "quote", "page"], [("kept", pa.bool_(), "boolean"), ("page_found", pa.int32(), "int")], _texts_and_pages, _verified)


def verified_items(items: DataFrame, quotes: DataFrame) -> DataFrame:
    """Items (text_id, item) with kept, dropped, located (on a page) and low_confidence: no quote of theirs is kept. Items without quotes have low confidence."""
    counts = quotes.groupBy("text_id", "item").agg(F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("dropped"), F.count_if(F.col("page_found").isNotNull()).alias("located"))
    none = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return items.select("text_id", "item").distinct().join(counts, ["text_id", "item"], "left").select("text_id", "item", none("kept"), none("dropped"), none("located"), (F.coalesce("kept", F.lit(0)) == 0).alias("low_confidence"))


ship(__name__)
