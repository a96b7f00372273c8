"""Markdown and HTML conversions, loose JSON and reversible ids: small per-row helpers behind Arrow batches."""

from __future__ import annotations

import html
import json
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from vellum.session import ship

_SKIP = frozenset(("script", "style", "head", "template", "noscript"))
_MARKS = {"b": "**", "strong": "**", "i": "*", "em": "*", "code": "`", "del": "~~", "s": "~~"}
_BREAKS = frozenset("p div section article header footer main aside nav table tr ul ol blockquote pre figure h1 h2 h3 h4 h5 h6 li".split())


class _Markdown(HTMLParser):
    """Writes Markdown as the elements of a page come by."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.skip = 0
        self.lists: list[int | None] = []
        self.links: list[str] = []
        self.cells: list[str] | None = None
        self.rows = 0

    def handle_starttag(self, tag, attrs):
        if tag in _SKIP:
            self.skip += 1
        if self.skip:
            return
        if tag in _BREAKS:
            self.out.append("\n\n" if tag not in ("li", "tr") else "\n")
        if re.fullmatch("h[1-6]", tag):
            self.out.append("#" * int(tag[1]) + " ")
        elif tag in ("ul", "ol"):
            self.lists.append(0 if tag == "ol" else None)
        elif tag == "li":
            depth = max(0, len(self.lists) - 1)
            if self.lists and self.lists[-1] is not None:
                self.lists[-1] += 1
            self.out.append("  " * depth + (f"{self.lists[-1]}. " if self.lists and self.lists[-1] is not None else "- "))
        elif tag == "br":
            self.out.append("\n")
        elif tag == "hr":
            self.out.append("\n\n---\n\n")
        elif tag == "a":
            self.links.append(dict(attrs).get("href") or "")
            self.out.append("[" if self.links[-1] else "")
        elif tag == "img":
            named = dict(attrs)
            self.out.append(f"![{named.get('alt') or ''}]({named.get('src') or ''})")
        elif tag == "table":
            self.rows = 0
        elif tag == "tr":
            self.cells = []
        elif tag in ("td", "th") and self.cells is not None:
            self.out.append("| ")
            self.cells.append(tag)
        elif tag in _MARKS:
            self.out.append(_MARKS[tag])

    def handle_endtag(self, tag):
        if tag in _SKIP:
            self.skip = max(0, self.skip - 1)
            return
        if self.skip:
            return
        if tag in _MARKS:
            self.out.append(_MARKS[tag])
        elif tag == "a" and self.links:
            link = self.links.pop()
            self.out.append(f"]({link})" if link else "")
        elif tag in ("ul", "ol") and self.lists:
            self.lists.pop()
        elif tag in ("td", "th"):
            self.out.append(" ")
        elif tag == "tr" and self.cells is not None:
            self.out.append("|")
            if not self.rows:
                self.out.append("\n" + "| --- " * len(self.cells) + "|")
            self.rows += 1
            self.cells = None
        if tag in _BREAKS and tag not in ("li", "tr"):
            self.out.append("\n\n")

    def handle_data(self, data):
        if not self.skip:
            self.out.append(re.sub(r"\s+", " ", data))


def html_to_markdown(page: str | None) -> str:
    """Markdown of a page: headings, lists, links, images, emphasis and tables."""
    writer = _Markdown()
    writer.feed(page or "")
    writer.close()
    text = re.sub(r"[ \t]+\n", "\n", "".join(writer.out))
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"\n +(?![ \-\d])", "\n", text)).strip()


def _inline(text: str) -> str:
    text = html.escape(text, quote=False)
    text = re.sub(r"`([^`]+)`", r"<code>\1</code>", text)
    text = re.sub(r"\*\*([^*]+)\*\*", r"<strong>\1</strong>", text)
    text = re.sub(r"\*([^*]+)\*", r"<em>\1</em>", text)
    return re.sub(r"\[([^\]]*)\]\(([^)\s]*)\)", r'<a href="\2">\1</a>', text)


def markdown_to_html(text: str | None) -> str:
    """HTML of the Markdown of notes: headings, paragraphs, flat lists, quotes, code blocks."""
    out, paragraph, kind, code = [], [], None, None

    def end() -> None:
        nonlocal kind
        if paragraph:
            out.append(f"<p>{_inline(' '.join(paragraph))}</p>")
            paragraph.clear()
        if kind:
            out.append(f"</{kind}>")
            kind = None

    for line in (text or "").splitlines():
        if line.startswith("```"):
            if code is None:
                end()
                code = []
            else:
                out.append(f"<pre><code>{html.escape(chr(10).join(code), quote=False)}</code></pre>")
                code = None
        elif code is not None:
            code.append(line)
        elif m := re.match(r"(#{1,6})\s+(.*)", line):
            end()
            out.append(f"<h{len(m[1])}>{_inline(m[2].strip())}</h{len(m[1])}>")
        elif m := re.match(r"\s*(?:([-*+])|\d+\.)\s+(.*)", line):
            wanted = "ul" if m[1] else "ol"
            if kind != wanted:
                end()
                out.append(f"<{wanted}>")
                kind = wanted
            out.append(f"<li>{_inline(m[2].strip())}</li>")
        elif m := re.match(r">\s?(.*)", line):
            end()
            out.append(f"<blockquote>{_inline(m[1])}</blockquote>")
        elif line.strip():
            if kind:
                end()
            paragraph.append(line.strip())
        else:
            end()
    end()
    if code is not None:
        out.append(f"<pre><code>{html.escape(chr(10).join(code), quote=False)}</code></pre>")
    return "\n".join(out)


def close_json(text: str) -> str:
    """Text of JSON that was cut off, with what is open closed."""
    open_, inside, escaped = [], False, False
    for c in text:
        if inside:
            inside, escaped = escaped or c != '"', not escaped and c == "\\"
        elif c == '"':
            inside = True
        elif c in "{[":
            open_.append("}" if c == "{" else "]")
        elif c in "}]" and open_:
            open_.pop()
    if inside:
        text = (text[:-1] if escaped else text) + '"'
    text = re.sub(r",\s*\"[^\"]*\"\s*:?\s*$|[,:]\s*$", "", text)
    return text + "".join(reversed(open_))


def loose_json(text: str | None) -> str | None:
    """Canonical JSON out of an answer: fences and prose around it, trailing commas and a cut-off end are mended."""
    text = (text or "").strip()
    if fence := re.search(r"```(?:json)?\s*(.*?)(?:```|\Z)", text, re.IGNORECASE | re.DOTALL):
        text = fence[1].strip()
    begin = re.search(r"[\[{]", text)
    if not begin:
        return None
    text = text[begin.start() :]
    last = max(text.rfind("}"), text.rfind("]"))
    for attempt in (text[: last + 1], re.sub(r",\s*([}\]])", r"\1", text[: last + 1]), close_json(text)):
        try:
            return json.dumps(json.loads(attempt), ensure_ascii=False, separators=(",", ":"))
        except ValueError:
            continue
    return None


def encode_id(ref: str) -> str | None:
    """Reversible id of letters, digits, - and _; null if it gets longer than 64."""
    out = "".join(c if c.isascii() and c.isalnum() else "-" if c == "/" else f"_{ord(c):04x}" for c in ref)
    return out if 0 < len(out) <= 64 and all(ord(c) <= 0xFFFF for c in ref) else None


def decode_id(encoded: str) -> str:
    return re.sub(r"_([0-9a-f]{4})|-", lambda m: chr(int(m[1], 16)) if m[1] else "/", encoded)


def _mapped(function):
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: function(v) if v is not None else function(""))

    return run


def encoded_id(column: Column) -> Column:
    """``encode_id`` of every value; null for none."""
    return F.pandas_udf(lambda v: v.map(lambda x: None if x is None else encode_id(x)), "string")(column)


def decoded_id(column: Column) -> Column:
    """``decode_id`` of every value; null for none."""
    return F.pandas_udf(lambda v: v.map(lambda x: None if x is None else decode_id(x)), "string")(column)


def html_to_md(column: Column) -> Column:
    """Pages go to Python by the hundred: a batch of Arrow holds ten thousand of them, whatever their size."""
    return F.udf(lambda v: html_to_markdown(v or ""), StringType(), useArrow=False)(column)


def md_to_html(column: Column) -> Column:
    return F.pandas_udf(_mapped(markdown_to_html), StringType())(column)


def parse_loose(column: Column) -> Column:
    return F.pandas_udf(_mapped(loose_json), StringType())(column)


ship(__name__)
