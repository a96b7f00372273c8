"""Markdown as a tree of blocks, one row per block with its parent and place, and back.

A reader keeps a stack of the blocks that are open: quotes by their marks, lists by their
indent, sections by nothing at all. Each line closes what it does not belong to and opens
what it begins; what a text leaves open ends with it.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.session import ship

BLOCK = "pos int, parent int, place int, depth int, kind string, text string, more string"

FENCE = re.compile(r"^(`{3,}|~{3,})\s*(\S*)\s*$")
HEADING = re.compile(r"^(#{1,6})\s+(.*?)\s*$")
RULE = re.compile(r"^(?:-{3,}|\*{3,}|_{3,})\s*$")
ITEM = re.compile(r"^([-*+]|\d{1,9}[.)])(?:\s+(.*))?$")
BOX = re.compile(r"^\[([ xX])\]\s+(.*)$")
CALLOUT = re.compile(r"^\[!([\w-]+)\]([+-]?)\s*(.*)$")
COMMENT = re.compile(r"^%%.*%%\s*$")
IMAGE = re.compile(r"^!\[\[([^\]|]+?)(?:\|[^\]]*)?\]\]\s*$")
TAB = "  "


def special(text: str) -> bool:
    """Whether a line of this text would begin another block than a paragraph, or has a sign against that."""
    if text.startswith("\\"):
        return special(text[1:])
    row = text.startswith("|") and text.endswith("|") and len(text) > 1
    return row or text.startswith(">") or any(p.match(text) for p in (FENCE, HEADING, RULE, ITEM, COMMENT, IMAGE))


@dataclass
class Block:
    """A block; ``indent`` is where an open list item began."""

    kind: str
    text: str = ""
    more: dict = field(default_factory=dict)
    parent: Block | None = None
    children: list[Block] = field(default_factory=list)
    indent: int = -1


class Reader:
    """Builds the tree of one text, line by line."""

    def __init__(self) -> None:
        self.root = Block("root")
        self.open = [self.root]
        self.paragraph: Block | None = None
        self.table: Block | None = None
        self.fence: tuple[str, int, list[str]] | None = None

    def add(self, block: Block) -> Block:
        block.parent = self.open[-1]
        block.parent.children.append(block)
        self.paragraph = block if block.kind == "paragraph" else None
        self.table = block if block.kind == "table" else None
        return block

    def close_to(self, keep: int) -> None:
        del self.open[keep:]
        self.paragraph = self.table = None

    def line(self, raw: str) -> None:
        rest = raw.replace("\t", TAB)
        quotes = 0
        if self.fence is None:
            while (m := re.match(r"^ {0,3}>\s?(.*)$", rest)) is not None:
                quotes, rest = quotes + 1, m[1]
        else:
            for _ in range(self.fence[1]):
                rest = re.sub(r"^ {0,3}>\s?", "", rest)
            if not re.match(rf"^\s*{re.escape(self.fence[0])}\s*$", rest):
                self.fence[2].append(rest)
                return
            self.paragraph = None
            self.add_code()
            return
        self._quoted(quotes)
        self._content(rest, quotes)

    def add_code(self) -> None:
        mark, _, lines = self.fence
        self.code.text = "\n".join(lines)
        self.fence = None

    def _quoted(self, quotes: int) -> None:
        """Close or open quotes until as many are open as the line has marks."""
        held = [k for k, b in enumerate(self.open) if b.kind in ("quote", "callout")]
        if len(held) > quotes:
            self.close_to(held[quotes])
        for _ in range(quotes - len(held)):
            self._end_lists()
            self.open.append(self.add(Block("quote")))

    def _end_lists(self) -> None:
        while self.open[-1].indent >= 0:
            self.close_to(len(self.open) - 1)

    def _content(self, rest: str, quotes: int) -> None:
        body = rest.lstrip(" ")
        indent = len(rest) - len(body)
        if not body:
            self.paragraph = self.table = None
            return
        if quotes and not self.open[-1].children and self.open[-1].kind == "quote" and (m := CALLOUT.match(body)):
            self.open[-1].kind, self.open[-1].text, self.open[-1].more = "callout", m[3], {"type": m[1], "fold": m[2]}
            return
        item = None if RULE.match(body) else ITEM.match(body)
        if self.paragraph is not None and indent == 0 and not item and not any(p.match(body) for p in (FENCE, HEADING, RULE, COMMENT, IMAGE)) and not body.startswith("|"):
            self.paragraph.text += " " + body.rstrip()
            return
        # An item, or anything indented below one, belongs to the innermost item that began left of it.
        while self.open[-1].indent >= 0 and indent <= self.open[-1].indent:
            self.close_to(len(self.open) - 1)
        if not item and indent == 0:
            self._end_lists()
        if item:
            mark, text = item[1], item[2] or ""
            box = BOX.match(text)
            kind = "to_do" if box else "bullet" if mark in "-*+" else "number"
            block = Block(kind, (box[2] if box else text).rstrip(), {"checked": box[1] != " "} if box else {"n": int(mark[:-1])} if kind == "number" else {}, indent=indent)
            self.open.append(self.add(block))
        elif m := FENCE.match(body):
            self.code = self.add(Block("code", "", {"language": m[2]} if m[2] else {}))
            self.fence = m[1], quotes, []
        elif m := HEADING.match(body):
            self.add(Block("heading", m[2], {"level": len(m[1])}))
        elif RULE.match(body):
            self.add(Block("rule"))
        elif COMMENT.match(body):
            self.paragraph = self.table = None
        elif m := IMAGE.match(body):
            self.add(Block("image", m[1]))
        elif body.startswith("|") and body.rstrip().endswith("|") and len(body.rstrip()) > 1:
            self._row(body.rstrip())
        else:
            if self.paragraph is None:
                plain = body.rstrip()
                self.add(Block("paragraph", plain[1:] if plain.startswith("\\") and special(plain) else plain))
            else:
                self.paragraph.text += " " + body.rstrip()

    def _row(self, body: str) -> None:
        self.paragraph = None
        if re.match(r"^\|[\s:|-]+\|$", body) and "-" in body:
            if self.table is not None and len(self.table.children) == 1:
                self.table.more = {"header": True}
            return
        table = self.table or self.add(Block("table"))
        row = Block("row", "", {"cells": [c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", body[1:-1])]}, table)
        table.children.append(row)

    def end(self) -> Block:
        if self.fence is not None:
            self.add_code()
        return self.root


def parse(text: str) -> Block:
    """The tree of a text."""
    reader = Reader()
    for line in (text or "").replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        reader.line(line)
    return reader.end()


def rows_of(root: Block) -> Iterator[tuple]:
    """Blocks in order, each before those inside it: pos, parent (-1 at the top), place among its siblings, depth, kind, text, more."""
    stack = [(child, -1, k, 0) for k, child in reversed(list(enumerate(root.children)))]
    pos = 0
    while stack:
        block, parent, place, depth = stack.pop()
        yield pos, parent, place, depth, block.kind, block.text, json.dumps(block.more, ensure_ascii=False, sort_keys=True) if block.more else ""
        stack += [(child, pos, k, depth + 1) for k, child in reversed(list(enumerate(block.children)))]
        pos += 1


def block_rows(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``key, pos, parent, place, depth, kind, text, more`` of the blocks of every text, in order.

    ``more`` is JSON of what else a block has (level, checked, n, type, language, cells), or
    empty. Null and empty texts have no blocks; repeated rows each give theirs. A text is
    read in one piece.
    """
    schema = f"`{key}` {texts.schema[key].dataType.simpleString()}, {BLOCK}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, columns = [], [[] for _ in range(7)]
            for k, value in enumerate(batch.column(1)):
                for row in rows_of(parse(value.as_py())):
                    at.append(k)
                    for column, cell in zip(columns, row, strict=True):
                        column.append(cell)
            kinds = [pa.int32()] * 4 + [pa.string()] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]], [key, "pos", "parent", "place", "depth", "kind", "text", "more"])

    return texts.select(key, F.col(text).alias("text")).mapInArrow(run, schema)


def written(rows: list[tuple]) -> str:
    """The Markdown of blocks in order (pos, parent, place, depth, kind, text, more): what reads as the same blocks again."""
    lead: dict[int, str] = {-1: ""}
    kinds: dict[int, str] = {}
    out: list[str] = []
    last: tuple[int, str] | None = None
    for at, (pos, parent, place, _, kind, text, more) in enumerate(rows):
        extra = json.loads(more) if more else {}
        before = lead[parent]
        inside = kinds.get(parent) in ("bullet", "number", "to_do")
        listed = kind in ("bullet", "number", "to_do")
        if kind == "row":
            out.append(before + "| " + " | ".join(c.replace("|", "\\|") for c in extra["cells"]) + " |")
            if lead.pop(-2 - parent, None):
                out.append(before + "|" + " --- |" * len(extra["cells"]))
            continue
        begins = kinds.get(parent) == "quote" and place == 0
        if out and not begins and not (listed and (inside or last == (parent, "list"))) and not (kinds.get(parent) == "callout" and last is not None and last[1] == "callout"):
            out.append(before.rstrip())
        if kind in ("quote", "callout"):
            lead[pos] = before + "> "
            if kind == "quote" and (at + 1 == len(rows) or rows[at + 1][1] != pos):
                out.append(before + ">")
            elif kind == "callout":
                out.append(f"{before}> [!{extra['type']}]{extra['fold']} {text}".rstrip())
        elif listed:
            mark = "-" if kind == "bullet" else f"- [{'x' if extra['checked'] else ' '}]" if kind == "to_do" else f"{extra['n']}."
            out.append(f"{before}{mark} {text}".rstrip())
            lead[pos] = before + TAB
        elif kind == "code":
            fence = "`" * max(3, 1 + max((len(m) for m in re.findall(r"^\s*(`+)", text, re.MULTILINE)), default=0))
            out += [before + fence + extra.get("language", ""), *[before + line if line else before.rstrip() or "" for line in text.split("\n") if text], before + fence]
        elif kind == "table":
            lead[pos] = before
            if extra.get("header"):
                lead[-2 - pos] = "header"
        else:
            if kind == "paragraph" and special(text):
                text = "\\" + text
            out.append(before + {"heading": "#" * extra.get("level", 1) + " " + text, "rule": "---", "image": f"![[{text}]]"}.get(kind, text))
        kinds[pos] = kind
        last = parent, "list" if listed else kind
    return "\n".join(out)


def markdown_of(blocks: DataFrame, key: str) -> DataFrame:
    """``key, text``: the Markdown of each text's blocks."""
    ordered = F.sort_array(F.collect_list(F.struct("pos", "parent", "place", "depth", "kind", "text", "more")))
    whole = blocks.groupBy(key).agg(ordered.alias("blocks"))
    schema = f"`{key}` {blocks.schema[key].dataType.simpleString()}, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [written([tuple(b.values()) for b in rows]) for rows in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [key, "text"])

    return whole.mapInArrow(run, schema)


ship(__name__)
