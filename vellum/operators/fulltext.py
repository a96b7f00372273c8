"""Texts of pages as paragraphs: running heads out, wrapped lines joined, paragraphs that go on over pages put together.

``pages`` has doc, page (a number) and text. Lines, paragraphs and pages are rows in order;
what belongs together is told by flags and running sums over them (gaps and islands), so a
text of any number of pages needs no loop. Pages are dealt by text once, in ``page_lines``;
all that follows is told by windows within a text, so no line is shuffled or stored again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions.prose import heading_id, join_hyphens
from vellum.functions.text import CJK, edge_key
from vellum.operators.assembly import escaped

#: Lines at the top and at the bottom of a page that may be running heads; on how many pages, and on what share of all, they must stand.
EDGE_LINES, LEAST_PAGES, EDGE_SHARE = 3, 3, 0.3
#: Longer lines than these are no running heads: such that end a sentence, such that are no stamps, and any.
SENTENCE, PLAIN, STAMP = 60, 100, 250
#: Words of stamps, and bare page numbers.
STAMP_WORDS = r"(?i)https?://|www\.|downloaded|copyright|©|all rights reserved|licen[cs]e|terms and conditions|下載|版權"
PAGE_NUMBER = (
    r"(?i)^(?:(?:page|pp?\.?)\s*)?[-–—]?\s*\d{1,4}\s*[-–—]?(?:\s*(?:of|/)\s*\d{1,4})?$",
    r"^第\s*\d{1,4}\s*頁(?:\s*[,，/／]?\s*共\s*\d{1,4}\s*頁)?$",
)
SENTENCE_END = r"[.!?:;。！？：；」』\])）”\"'’]\s*$"
#: A text is wrapped if, of so many pairs of lines at least, this share goes on in the next line.
WRAPPED_PAIRS, WRAPPED_SHARE = 3, 0.25

_BROKEN = r"\p{L}[-\x{AD}\x{2010}]$"
_NUMBERED = r"^[一二三四五六七八九十壹貳參肆伍陸柒捌玖拾]+[、.．]"


def _goes_on(a: Column, b: Column) -> Column:
    """Whether a line ends so that the next one can only go on: a broken word before a small letter, or Han and the like on both sides."""
    return (a.rlike(_BROKEN) & b.rlike(r"^\p{Ll}")) | (a.rlike(rf"{CJK}$") & b.rlike(rf"^{CJK}"))


def page_lines(pages: DataFrame) -> DataFrame:
    """``doc, page, line, text`` of the lines of pages, numbered in their page; null texts have none.

    Line ends are unified and signs of no width dropped. Of rows of one page the texts are
    put one after the other in order of their text.
    """
    dealt = pages.filter("doc IS NOT NULL AND page IS NOT NULL AND text IS NOT NULL").select("doc", "page", "text").repartition("doc")
    one = dealt.groupBy("doc", "page").agg(F.array_join(F.sort_array(F.collect_list("text")), "\n").alias("text"))
    clean = F.regexp_replace(F.regexp_replace("text", r"\r\n?", "\n"), r"[\x{200B}-\x{200D}\x{2060}\x{FEFF}]", "")
    return one.select("doc", "page", F.posexplode(F.split(clean, "\n")).alias("line", "text"))


def without_running_lines(lines: DataFrame) -> DataFrame:
    """``lines`` without those that repeat at the edges of many pages, and without bare page numbers at an edge.

    A heading, a line that ends a long sentence, and a long line that is no stamp stay. A
    text of one page keeps all; of two it loses page numbers only.
    """
    trimmed = F.trim(F.regexp_replace("text", r"\s+", " "))
    shown = trimmed != ""
    by_page, by_doc, by_key = Window.partitionBy("doc", "page"), Window.partitionBy("doc"), Window.partitionBy("doc", "key")
    total = lambda flag, window: F.sum(flag.cast("int")).over(window)
    first = lambda window: F.row_number().over(window.orderBy("line")) == 1
    down = total(F.col("shown"), by_page.orderBy("line"))
    placed = lines.withColumn("own", trimmed).withColumn("shown", shown).withColumn("down", down).withColumn("all", total(F.col("shown"), by_page)).withColumn("top", first(by_page))
    edge = F.col("shown") & ((F.col("down") <= EDGE_LINES) | (F.col("down") > F.col("all") - EDGE_LINES))
    placed = placed.withColumn("key", F.when(edge, edge_key(F.col("text")))).withColumn("pages", total(F.col("top"), by_doc))
    # A key counts once for each of its pages; lines without a key are counted too, which tells nothing.
    known = placed.withColumn("once", first(Window.partitionBy("doc", "key", "page"))).withColumn("n", total(F.col("once"), by_key))
    size = F.length("own")
    kept = heading_id(F.col("own")).isNotNull() | ((size > SENTENCE) & F.col("own").rlike(r"[.!?。！？]$")) | ((size > PLAIN) & ~((size <= STAMP) & F.col("own").rlike(STAMP_WORDS)))
    running = F.col("key").isNotNull() & (F.col("pages") >= LEAST_PAGES) & (F.col("n") >= F.greatest(F.lit(LEAST_PAGES), F.ceil(F.col("pages") * EDGE_SHARE))) & ~kept
    left = known.filter(~F.coalesce(running, F.lit(False))).select("doc", "page", "line", "text", "own", "shown", "pages")
    # What is the first or last line of a page is told anew, now that running lines are gone.
    numbers = F.col("own").rlike("|".join(f"(?:{p})" for p in PAGE_NUMBER))
    ends = (F.col("down") == 1) | (F.col("down") == F.col("all"))
    bare = (F.col("pages") > 1) & F.col("shown") & ends & numbers
    return left.withColumn("down", down).withColumn("all", total(F.col("shown"), by_page)).filter(~bare).select("doc", "page", "line", "text")


def told_wrapped(lines: DataFrame) -> DataFrame:
    """``lines`` with ``wrapped``: whether paragraphs of their text run over several lines; told by the pairs of adjacent lines, over pages too."""
    by_doc = Window.partitionBy("doc")
    a, b = F.trim("text"), F.col("after")
    pair = F.expr("trim(text) <> '' AND after <> '' AND NOT startswith(trim(text), '|') AND NOT startswith(after, '|')")
    on = b.rlike(r"^\p{Ll}") | a.rlike(_BROKEN) | _goes_on(a, b)
    pairs, goes_on = (F.count_if(F.col(c)).over(by_doc) for c in ("pair", "on"))
    paired = lines.withColumn("after", F.lead(F.trim("text")).over(by_doc.orderBy("page", "line"))).withColumn("pair", pair).withColumn("on", F.col("pair") & on)
    return paired.withColumn("wrapped", (pairs >= WRAPPED_PAIRS) & (goes_on >= pairs * WRAPPED_SHARE)).drop("after", "pair", "on")


def joined(lines: Column) -> Column:
    """Lines of one paragraph as one: broken words put together, Han and the like without a space, all else with one."""
    text = F.regexp_replace(join_hyphens(lines), rf"(?<={CJK})\n(?={CJK})", "")
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def _islands(rows: DataFrame, starts: Column, order: list[str], name: str) -> DataFrame:
    """``rows`` with the number of their island in their text: a row begins one where ``starts`` holds."""
    by_doc = Window.partitionBy("doc").orderBy(*order)
    return rows.withColumn(name, F.sum(F.coalesce(starts, F.lit(True)).cast("int")).over(by_doc.rowsBetween(Window.unboundedPreceding, 0)))


def _gathered(rows: DataFrame, island: str, place: list[str]) -> DataFrame:
    pieces = F.transform(F.sort_array(F.collect_list(F.struct(*place, "text"))), lambda x: x["text"])
    return rows.groupBy("doc", island).agg(F.min("page").alias("first_page"), F.max("page").alias("last_page"), F.array_join(pieces, "\n").alias("text"))


def paragraphs(pages: DataFrame, wrapped: bool | None = None) -> DataFrame:
    """``doc, pos, first_page, last_page, kind, section, text`` of the paragraphs of all texts, in order from 0.

    ``kind`` is heading, table (a row of one) or text; ``section`` is that of a heading. Whether
    lines are wrapped is told from each text unless given. A heading that repeats the heading
    right before it is left out. Null docs, pages and texts give nothing, an empty table an
    empty result; only doc, page and text are read.
    """
    lines = without_running_lines(page_lines(pages))
    rows = told_wrapped(lines) if wrapped is None else lines.withColumn("wrapped", F.lit(wrapped))
    rows = rows.withColumn("text", F.trim(F.regexp_replace("text", "[ \t]+", " ")))
    rows = rows.withColumn("alone", F.col("text").startswith("|") | heading_id(F.col("text")).isNotNull())
    order = Window.partitionBy("doc", "page").orderBy("line")
    before, alone_before = F.lag("text").over(order), F.lag("alone").over(order)
    rows = _islands(rows, before.isNull() | (before == "") | alone_before | F.col("alone") | ~F.col("wrapped"), ["page", "line"], "part").filter("text <> ''")
    parts = _gathered(rows, "part", ["page", "line"])
    parts = parts.withColumn("alone", heading_id(F.col("text")).isNotNull() | F.col("text").startswith("|"))

    by_doc = Window.partitionBy("doc").orderBy("part")
    a, b = F.lag("text").over(by_doc), F.col("text")
    follows = (a.rlike(_BROKEN) & b.rlike(r"^\p{Ll}")) | (~a.rlike(SENTENCE_END) & (b.rlike(r"^\p{Ll}") | (_goes_on(a, b) & ~b.rlike(_NUMBERED))))
    starts = (F.lag("last_page").over(by_doc) == F.col("first_page")) | F.lag("alone").over(by_doc) | F.col("alone") | ~follows
    over = _gathered(_islands(parts, starts, ["part"], "whole").withColumnRenamed("first_page", "page").drop("last_page", "alone"), "whole", ["part"])

    tidy = over.withColumn("text", joined(F.col("text")))
    section = heading_id(F.col("text"))
    named = tidy.withColumn("section", section).withColumn("text", F.when(section.isNotNull(), F.trim(F.regexp_replace("text", r"\A\\|[\s:：]+\z", ""))).otherwise(F.col("text")))
    in_order = Window.partitionBy("doc").orderBy("whole")
    again = F.col("section").isNotNull() & F.coalesce((F.lag("text").over(in_order) == F.col("text")) & F.lag("section").over(in_order).isNotNull(), F.lit(False))
    kind = F.when(F.col("section").isNotNull(), "heading").when(F.col("text").startswith("|"), "table").otherwise("text")
    done = named.withColumn("again", again).filter("NOT again").withColumn("pos", F.row_number().over(in_order) - 1)
    return done.select("doc", "pos", "first_page", "last_page", kind.alias("kind"), "section", "text")


def to_markdown(rows: DataFrame, tables: bool = False) -> DataFrame:
    """``doc, md, headings`` of paragraphs: headings marked, signs of Markdown escaped, rows of a table kept together."""
    mark = F.when(F.col("kind") == "heading", F.concat(F.lit("## "), F.col("text"))).when((F.col("kind") == "table") & F.lit(tables), F.col("text")).otherwise(escaped(F.col("text")))
    row = F.col("kind") == "table"
    after_row = F.coalesce(F.lag(row).over(Window.partitionBy("doc").orderBy("pos")), F.lit(False))
    spaced = rows.withColumn("md", F.concat(F.when(F.col("pos") == 0, "").when(row & after_row, "\n").otherwise("\n\n"), mark))
    ordered = F.sort_array(F.collect_list(F.struct("pos", "md", "section")))
    return spaced.groupBy("doc").agg(ordered.alias("o")).select("doc", F.array_join(F.transform("o", lambda x: x["md"]), "").alias("md"), F.filter(F.transform("o", lambda x: x["section"]), lambda s: s.isNotNull()).alias("headings"))
