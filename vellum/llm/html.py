"""Main text of web pages by suffix arrays over the token streams of a host.

A page is parsed into blocks of text. Its markup only bounds the blocks and sorts them:
text of the article (``article`` or ``main``) stays, since articles are copied too; what
the page itself marks as chrome (menus, headers, footers, forms, adverts and the like)
goes; all other blocks are open. Open are blocks outside an article, and blocks inside
one under a class that may mean chrome or not (``social``, ``related``, ``notice``).

Repeated runs decide about open blocks. The streams of a host, which are the blocks
outside its articles, are concatenated in pieces of bounded size, and all suffixes of a
piece are sorted by prefix doubling, so that those that agree on MIN_TOKENS tokens stand
together. A longer substring that pages share is covered by its runs of MIN_TOKENS, each
of which they share too, so no deeper order is needed to know what repeats cover. A block
of fewer tokens is a run of its own, repeated only as a whole. Each piece gives its runs
with the number of distinct pages that have them. Pages with equal text are counted once,
wherever they lie, so the numbers of pieces add up to those of the host, and the result
depends neither on pieces nor on partitions. An open block goes where runs cover most of
it that stand on MIN_PAGES pages and on HOST_SHARE of all distinct pages of the host: what a
few pages of a large host have in common by chance stays.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import join_back, ship, store

#: Tokens that make a repeated run long, distinct pages that must share it and their share of a host's, and the share of a block it must cover.
MIN_TOKENS = 12
MIN_PAGES = 3
HOST_SHARE = 0.001
COVERED = 0.8
#: Tokens of one suffix array. This bounds memory and changes no result.
RUN_TOKENS = 400_000

#: Elements without text of the page's own, elements and roles of chrome, and words of classes and ids that mark it.
SILENT = frozenset("script style noscript template head title canvas iframe object embed applet audio video map datalist desc metadata annotation annotation-xml".split())
IN_HEAD = frozenset("title meta link script style base noscript template".split())
CHROME = frozenset("nav footer aside form button select textarea input fieldset menu dialog".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsored sidebar nav navbar navigation breadcrumb breadcrumbs footer cookie cookies consent gdpr newsletter comment comments commentlist responses disqus signup".split()
)
#: Words that may mark chrome inside an article, but may as well be the article's subject.
DOUBTFUL = frozenset("sponsor promo promotion menu notice notices subscribe share sharing social replies respond related recommended".split())
OUTER_MARKS = MARKS | DOUBTFUL | frozenset("side menubar header masthead alert banner popup modal overlay signup login reply widget pager pagination skip".split())
#: Words that say nothing beside a mark of the same class: ``ad-slot`` is an ad, ``ad-hoc`` is none.
FILLERS = frozenset("area article banner bar block body bottom box button buttons content container form head header icon icons inner inline item items left link links list main message outer overlay page popup post reader readers right section site slot text thread title top unit user users widget wrap wrapper".split())
CONTENT = frozenset("article main".split())
CONTENT_MARKS = frozenset("article content main post entry story".split())
NEVER_CONTENT = frozenset("comment comments commentlist replies ad ads advert advertisement sidebar related recommended".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html "
    "li link main menu meta nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = BLOCKS - {"br", "link", "meta", "option", "optgroup", "col"}
#: Elements that end an open one of the same kind, up to the element that holds them.
ENDS = {
    "li": (("li",), frozenset(("ul", "ol", "menu"))),
    "dt": (("dt", "dd"), frozenset(("dl",))),
    "dd": (("dt", "dd"), frozenset(("dl",))),
    "td": (("td", "th"), frozenset(("tr", "table"))),
    "th": (("td", "th"), frozenset(("tr", "table"))),
    "tr": (("tr",), frozenset(("table",))),
    "option": (("option",), frozenset(("select",))),
}
WORDS = re.compile(r"[a-z0-9]+")
NOT_SHOWN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)

KEPT, OPEN, DROPPED, DOUBTED, WEAK = 0, 1, 2, 3, 4
#: Share of a doubtful block's text in links that makes it a list of links.
LINKS = 0.8


def marks_chrome(classes: str) -> int | None:
    """What the classes of an element inside an article say of it: DROPPED, DOUBTED or nothing.

    A class counts only as a whole: all its words must be marks or fillers.
    """
    found = None
    for name in classes.split():
        words = WORDS.findall(name)
        if words and all(w in MARKS or w in DOUBTFUL or w in FILLERS for w in words):
            if any(w in MARKS for w in words):
                return DROPPED
            if any(w in DOUBTFUL for w in words):
                found = DOUBTED
    return found


class Blocks(HTMLParser):
    """Blocks of text in page order, each with its zone: in the article, open, or dropped by the page's own marks."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[int, str]] = []
        self.stack: list[str] = []
        self.zones: list[int | None] = [OPEN]  # one more than the stack: what holds outside every element
        self.parts: list[tuple[int, str, bool]] = []

    def zone_of(self, tag: str, attributes: list[tuple[str, str | None]]) -> int | None:
        """The zone of an element's content; None where nothing in it is text."""
        now = self.zones[-1]
        if now is None or now == DROPPED:
            return now
        if tag in SILENT:
            return None
        named = dict(attributes)
        role = (named.get("role") or "").lower()
        shown = "hidden" not in named and (named.get("aria-hidden") or "").lower() != "true" and not NOT_SHOWN.search(named.get("style") or "")
        if tag in CHROME or role in ROLES or not shown or (tag == "header" and now not in (KEPT, DOUBTED)):
            return DROPPED
        if tag not in HEADINGS and tag not in ("html", "body"):
            classes = f"{named.get('class') or ''} {named.get('id') or ''}".lower()
            if now in (KEPT, DOUBTED):
                if (found := marks_chrome(classes)) is not None:
                    return found
            else:
                marks = set(WORDS.findall(classes))
                content = tag in CONTENT or bool(marks & CONTENT_MARKS)
                if marks_chrome(classes) == DROPPED or (marks & NEVER_CONTENT and (content or now == WEAK)):
                    return DROPPED
                if not content and marks & (OUTER_MARKS | NEVER_CONTENT):
                    return WEAK  # chrome beside an article; of a page without one the runs decide
        return KEPT if now in (OPEN, WEAK) and (tag in CONTENT or role in CONTENT) else now

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self.end_block()
        if tag == "body" or (self.zones[-1] is None and "head" in self.stack and tag not in IN_HEAD):
            self.end_element("head")  # its end tag may be left out
        if tag in CLOSES_P:
            self.end_element("p", within=CLOSES_P - {"p"})
        for other in ENDS.get(tag, ((), frozenset()))[0]:
            self.end_element(other, within=ENDS[tag][1])
        if tag in VOID:
            return
        zone = self.zone_of(tag, attrs)
        self.stack.append(tag)
        self.zones.append(zone)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # a slash on an element that is not void changes nothing

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self.end_block()
        self.end_element(tag)

    def end_element(self, tag: str, within: frozenset[str] = frozenset()) -> None:
        """End the innermost open element of that name, with all inside it; an element of ``within`` hides those outside it."""
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k] == tag:
                del self.stack[k:], self.zones[k + 1 :]
                return
            if self.stack[k] in within:
                return

    def handle_data(self, data):
        if self.zones[-1] is not None:
            zone = self.zones[-1]
            self.parts.append((zone, data, zone == DOUBTED and "a" in self.stack))

    def end_block(self) -> None:
        for zone in dict.fromkeys(z for z, _, _ in self.parts):
            if text := " ".join("".join(d for z, d, _ in self.parts if z == zone).split()):
                if zone == DOUBTED:
                    linked = len("".join("".join(d for z, d, a in self.parts if z == zone and a).split()))
                    zone = DROPPED if linked >= LINKS * len(text.replace(" ", "")) else OPEN
                self.blocks.append((zone, text))
        self.parts = []

    def finish(self) -> None:
        """Read what is left and end the last block."""
        self.close()
        self.end_block()


def blocks_of(html: str) -> list[tuple[int, str]]:
    """Blocks (zone, text) of a page, script and style left out.

    A block under a class that may mean chrome is dropped where the page has an article, and
    open where it has none.
    """
    parser = Blocks()
    parser.feed(html)
    parser.finish()
    weak = DROPPED if any(zone == KEPT for zone, _ in parser.blocks) else OPEN
    return [(weak if zone == WEAK else zone, text) for zone, text in parser.blocks]


def suffix_groups(tokens: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of ``tokens`` sorted to ``depth`` tokens or deeper, and each suffix's rank group.

    Prefix doubling: the rank of 2k tokens is the rank of the pair of ranks of k tokens.
    Suffixes of one group agree on at least ``depth`` tokens.
    """
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    order, known = np.argsort(rank, kind="stable"), 1
    while known < depth:
        step = min(known, depth - known)
        after = np.full(len(rank), -1, np.int64)
        after[: len(rank) - step] = rank[step:]
        pair = rank * (len(rank) + 1) + after + 1
        order = np.argsort(pair, kind="stable")
        ordered = pair[order]
        rank = np.empty(len(pair), np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]]))
        known += step
    return order, rank


def joined(streams: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Streams one after the other with an end of its own behind each, and the first place of each."""
    lengths = np.array([len(x) for x in streams], np.int64)
    begins = np.cumsum(lengths + 1) - lengths - 1
    line = np.empty(int((lengths + 1).sum()), np.int64)
    for k, (begin, stream) in enumerate(zip(begins.tolist(), streams, strict=True)):
        line[begin : begin + len(stream)] = stream
        line[begin + len(stream)] = -1 - k
    return line, begins


def run_keys(tokens: np.ndarray, depth: int, host: int = 0) -> np.ndarray:
    """64-bit key of the run of ``depth`` tokens that begins at each place, within its host."""
    n = max(0, len(tokens) - depth + 1)
    keys = np.full(n, host & (2**64 - 1), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(depth):
            keys = (keys ^ tokens[k : k + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            keys ^= keys >> np.uint64(32)
    return keys.view(np.int64)


def run_pages(streams: list[np.ndarray], pages: np.ndarray, depth: int = MIN_TOKENS, host: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Every run of ``depth`` tokens by its key, with the number of pages that have it.

    ``pages`` has the page of each stream; a run lies within one stream. Tokens are hashes, none negative.
    """
    if not any(len(x) >= depth for x in streams):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    line, begins = joined(streams)
    lengths = np.array([len(x) for x in streams], np.int64)
    order, rank = suffix_groups(line, depth)
    stream_of = np.repeat(np.arange(len(streams)), lengths + 1)
    inside = np.arange(len(line)) + depth <= (begins + lengths)[stream_of]  # the run ends before its stream does
    order = order[inside[order]]
    groups, of = rank[order], pages[stream_of[order]]
    by = np.lexsort((of, groups))
    groups, of, at = groups[by], of[by], order[by]
    begin = np.concatenate([[True], groups[1:] != groups[:-1]])
    new = begin | np.concatenate([[True], of[1:] != of[:-1]])
    counts = np.add.reduceat(new.astype(np.int64), np.nonzero(begin)[0])
    return run_keys(np.append(line, np.zeros(depth - 1, np.int64)), depth, host)[at[begin]], counts


def covered(tokens: np.ndarray, repeated: np.ndarray, depth: int = MIN_TOKENS, host: int = 0) -> np.ndarray:
    """Which tokens of a stream the repeated runs (sorted keys) cover."""
    starts = np.nonzero(np.isin(run_keys(tokens, depth, host), repeated))[0]
    edge = np.zeros(len(tokens) + 1, np.int64)
    edge[starts] += 1
    np.add.at(edge, starts + depth, -1)
    return np.cumsum(edge[:-1]) > 0


def covered_tokens(pages: list[np.ndarray], depth: int = MIN_TOKENS, min_pages: int = MIN_PAGES) -> list[np.ndarray]:
    """For each page's tokens, which are covered by runs of ``depth`` tokens or longer that enough distinct pages share.

    Pages with equal token streams count as one, so a copy of a page makes nothing boilerplate.
    """
    distinct = list({p.tobytes(): p for p in pages}.values())
    keys, counts = run_pages(distinct, np.arange(len(distinct)), depth)
    repeated = np.sort(keys[counts >= min_pages])
    return [covered(p, repeated, depth) for p in pages]


def token_ids(text: str) -> np.ndarray:
    """A 63-bit hash of each token."""
    return np.array([xxhash.xxh3_64_intdigest(w) >> 1 for w in text.encode().split()], np.int64)


#: Sets the keys of whole short blocks apart from those of runs.
SHORT = 0x5BD1E9955BD1E995


def short_keys(stream: str, host: int) -> np.ndarray:
    """Keys of the blocks of a stream (one a line) that have fewer than MIN_TOKENS tokens."""
    short = [token_ids(b) for b in stream.split("\n") if b.count(" ") + 1 < MIN_TOKENS]
    return np.concatenate([np.zeros(0, np.int64), *[run_keys(t, len(t), host ^ SHORT) for t in short if len(t)]])


def host_key(host: str) -> int:
    return xxhash.xxh3_64_intdigest(host.encode())


def laid_out(blocks: list[tuple[int, str]]) -> tuple[int, list[str], list[dict]]:
    """Of a page: a digest of all its text, its streams outside the article, and its kept and open blocks.

    Neighbouring blocks outside the article are one stream, a line each. An open block knows its
    stream and the number of its first token there; a kept one has stream -1.
    """
    streams: list[list[str]] = []
    shown, before, first = [], KEPT, 0
    for zone, text in blocks:
        if zone == KEPT:
            shown.append({"stream": -1, "first": 0, "text": text})
        else:
            if before == KEPT:
                streams.append([])
                first = 0
            streams[-1].append(text)
            if zone == OPEN:
                shown.append({"stream": len(streams) - 1, "first": first, "text": text})
            first += text.count(" ") + 1
        before = zone
    mark = xxhash.xxh3_64_intdigest("\n".join([text for _, text in blocks]).encode()) - (1 << 63)
    return mark, ["\n".join(x) for x in streams], shown


def open_runs(streams: list[str], blocks: list[dict], host: int) -> np.ndarray:
    """Distinct keys of the runs of the streams in which open blocks stand."""
    wanted = sorted({b["stream"] for b in blocks if b["stream"] >= 0})
    return np.unique(np.concatenate([np.zeros(0, np.int64), *[keys for k in wanted for keys in (run_keys(token_ids(streams[k]), MIN_TOKENS, host), short_keys(streams[k], host))]]))


def kept_text(streams: list[str], blocks: list[dict], repeated: np.ndarray, host: int) -> str:
    """Text of the kept blocks, and of the open ones that repeated runs do not cover."""
    repeated = np.sort(repeated)
    flags = {k: covered(token_ids(streams[k]), repeated, MIN_TOKENS, host) for k in {b["stream"] for b in blocks if b["stream"] >= 0}}
    kept = []
    for b in blocks:
        size = b["text"].count(" ") + 1
        if b["stream"] >= 0 and np.isin(short_keys(b["text"], host), repeated).any():
            continue
        if b["stream"] < 0 or flags[b["stream"]][b["first"] : b["first"] + size].mean() < COVERED:
            kept.append(b["text"])
    return " ".join(kept)


def _piece(streams: list[str], owners: list[int], host: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs and short blocks of one piece with their numbers of pages."""
    keys, counts = run_pages([token_ids(x) for x in streams], np.array(owners), MIN_TOKENS, host)
    short = [short_keys(x, host) for x in streams]
    pairs = np.unique(np.stack([np.concatenate([np.zeros(0, np.int64), *short]), np.repeat(np.array(owners, np.int64), [len(x) for x in short])]), axis=1)
    blocks, pages = np.unique(pairs[0], return_counts=True)
    return np.concatenate([keys, blocks]), np.concatenate([counts, pages])


def counted_runs(host: str, pages: Iterable[list[str]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys and page numbers of all runs of a host's distinct pages, by pieces of bounded size."""
    key, streams, owners, size = host_key(host), [], [], 0
    for number, page in enumerate(pages):
        for text in page:
            streams.append(text)
            owners.append(number)
            size += text.count(" ") + text.count("\n") + 1
        if size >= RUN_TOKENS:
            yield _piece(streams, owners, key)
            streams, owners, size = [], [], 0
    if streams:
        yield _piece(streams, owners, key)


def host_of(url: Column) -> Column:
    """Host of an address in lower case; null and addresses without one share the empty host."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)", 1)), F.lit(""))


BLOCK = pa.struct([("stream", pa.int32()), ("first", pa.int32()), ("text", pa.string())])
LAID_OUT = "mark long, streams array<string>, blocks array<struct<stream: int, first: int, text: string>>"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [laid_out(blocks_of(x.as_py() or "")) for x in batch.column(3)]
        marks, streams, blocks = zip(*found, strict=True) if found else ((), (), ())
        made = [pa.array(marks, pa.int64()), pa.array(streams, pa.list_(pa.string())), pa.array(blocks, pa.list_(BLOCK))]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], *made], ["page_id", "url", "host", "mark", "streams", "blocks"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of the rows (host, mark, streams), which come sorted; of rows with equal host and mark the first counts."""

    def distinct() -> Iterator[tuple[str, list[str]]]:
        last = None
        for batch in batches:
            for host, mark, streams in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (host, mark) != last:
                    last = (host, mark)
                    yield host, streams

    found, size = [], 0
    for host, rows in groupby(distinct(), key=lambda row: row[0]):
        for counted in counted_runs(host, (streams for _, streams in rows)):
            found.append(counted)
            size += len(counted[0])
            if size >= RUN_TOKENS:
                yield _runs_batch(found)
                found, size = [], 0
    if found:
        yield _runs_batch(found)


def _runs_batch(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], ["run", "pages"])


def _ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, host, streams, blocks in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            keys = open_runs(streams, blocks, host_key(host))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), row)), pa.array(keys)], ["row", "run"])


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        host, streams, blocks, runs = (c.to_pylist() for c in batch.columns[2:])
        texts = [kept_text(s, b, np.array(r or [], np.int64), host_key(h)) for h, s, b, r in zip(host, streams, blocks, runs, strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string())], ["page_id", "url", "text"])


def extract(pages: DataFrame) -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars.

    Null and empty html give the empty text. What stands in an article (or main) element
    is kept, and so are the open blocks that repeated runs do not cover, whether or not
    the page has an article. All pages of a host are compared, whatever the partitions.
    Repeated rows get equal results; only page_id, url and html are read, so extra
    columns cannot clash; an empty table gives none.
    """
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pages.select("page_id", "url").schema)
    rows = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), "html")
    parsed = rows.mapInArrow(_parse, f"{fields}, host string, {LAID_OUT}")
    parsed = store(parsed.withColumn("row", F.monotonically_increasing_id()), "pages")
    is_open = F.exists("blocks", lambda b: b["stream"] >= 0)
    plain = parsed.filter(~is_open).select("page_id", "url", F.array_join(F.col("blocks.text"), " ").alias("text"))

    # Ranges of (host, mark) divide a host of many pages, but keep pages of equal text together.
    streams = parsed.filter(F.size("streams") > 0).select("host", "mark", "streams")
    counted = streams.repartitionByRange("host", "mark").sortWithinPartitions("host", "mark").mapInArrow(_count, "run long, pages long")
    repeated = store(counted.groupBy("run").agg(F.sum("pages").alias("pages")).filter(F.col("pages") >= MIN_PAGES), "runs")
    undecided = parsed.filter(is_open)
    sizes = store(parsed.select("host", "mark").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("distinct_pages")), "hosts")
    wanted = undecided.select("row", "host", "streams", "blocks").mapInArrow(_ask, "row long, run long")
    met = join_back(wanted, repeated, "run", "pages", F.xxhash64("row", "run")).filter("pages IS NOT NULL")
    # A page asks with all its runs, and takes those that stand on enough of its host's pages.
    found = met.groupBy("row").agg(F.collect_list(F.struct("run", "pages")).alias("found"))
    of_host = join_back(undecided, sizes, "host", "distinct_pages", F.concat(F.lit("row "), F.col("row").cast("string")))
    often = F.transform(F.filter("found", lambda x: x["pages"] >= F.col("distinct_pages") * HOST_SHARE), lambda x: x["run"])
    decided = of_host.join(found, "row", "left").select("page_id", "url", "host", "streams", "blocks", often.alias("runs")).mapInArrow(_decide, f"{fields}, text string")
    return plain.unionByName(decided).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


ship(__name__)
