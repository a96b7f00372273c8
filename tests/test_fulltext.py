import random
import re

from vellum.operators import fulltext

HEADINGS = {"methods": "methods", "results": "results", "references": "references"}
KEEP = {"self", "long"}
STOP = {"and", "or"}


def heading(line):
    s = line.strip()
    s = re.sub(r"^(?:\(?\d{1,2}(?:\.\d{1,2})*[.)]?|[IVX]{1,4}[.)])\s*", "", s)
    return HEADINGS.get(re.sub(r"[\s:.]+$", "", s).lower()) if len(line.strip()) <= 80 else None


def hyphens(text):
    def put(m):
        left, gap, right = m.group(1), m.group(2), m.group(3)
        if not gap or right in STOP:
            return m.group(0)
        return left + "-" if left.lower() in KEEP else left

    return re.sub(r"([A-Za-zé]+)-([ \t]*\n?[ \t]*)(?=([a-zé]+))", put, text)


def piece(a, b):
    if re.search(r"[A-Za-z]-$", a) and re.match("[a-z]", b):
        return hyphens(a + "\n" + b)
    return a + " " + b


def walk(pages):
    """One text, line by line: the paragraphs as a reader would put them together."""
    pages = [[*p.split("\n")] for p in pages]
    edges = []
    for lines in pages:
        shown = [k for k, x in enumerate(lines) if x.strip()]
        edges.append(sorted({*shown[:3], *shown[-3:]}))
    if len(pages) >= 3:
        key = lambda x: re.sub(r"\s+", " ", re.sub(r"\d+", "#", x.strip().lower()))
        counts = {}
        for lines, at in zip(pages, edges):
            for k in {key(lines[i]) for i in at}:
                counts[k] = counts.get(k, 0) + 1
        for lines, at in zip(pages, edges):
            for i in at:
                t = re.sub(r"\s+", " ", lines[i].strip())
                if heading(t) or (len(t) > 60 and re.search(r"[.!?]$", t)) or (len(t) > 100 and not (len(t) <= 250 and "copyright" in t.lower())):
                    continue
                if counts[key(lines[i])] >= max(3, -(-len(pages) * 3 // 10)):
                    lines[i] = None
    if len(pages) > 1:
        for lines in pages:
            shown = [k for k, x in enumerate(lines) if x is not None and x.strip()]
            for i in {*shown[:1], *shown[-1:]}:
                if re.fullmatch(r"(?i)(?:page\s*)?-?\s*\d{1,4}\s*-?(?:\s*(?:of|/)\s*\d{1,4})?", lines[i].strip()):
                    lines[i] = None
    flat = [x.strip() for lines in pages for x in lines if x is not None]
    pairs = [(a, b) for a, b in zip(flat, flat[1:]) if a and b and a[0] != "|" and b[0] != "|"]
    on = sum(bool(re.match("[a-zé]", b) or re.search("[A-Za-z]-$", a)) for a, b in pairs)
    wrapped = len(pairs) >= 3 and on / len(pairs) >= 0.25
    out = []
    for n, lines in enumerate(pages):
        own, now = [], None
        for line in [*[x for x in lines if x is not None], ""]:
            t = re.sub(r"[ \t]+", " ", line).strip()
            alone = t.startswith("|") or heading(t)
            if now is not None and (not t or alone or not wrapped):
                own.append(now)
                now = None
            if alone:
                own.append(t)
            elif t:
                now = t if now is None else piece(now, t)
        if own and out:
            a, b = out[-1][2], own[0]
            whole = heading(a) or heading(b) or a[0] == "|" or b[0] == "|"
            if not whole and (re.search("[A-Za-z]-$", a) and re.match("[a-z]", b) or (not re.search(r"[.!?:;\])\"']\s*$", a) and re.match("[a-zé]", b))):
                out[-1] = (out[-1][0], n, piece(a, own.pop(0)))
        out += [(n, n, t) for t in own]
    rows, last = [], None
    for first, final, t in out:
        t = hyphens(re.sub(r"\s+", " ", t))
        section = heading(t)
        if section:
            t = re.sub(r"[\s:]+$", "", t)
            if last == t:
                continue
        last = t if section else None
        rows.append((first, final, "heading" if section else "table" if t[0] == "|" else "text", section, t))
    return [(k, *r) for k, r in enumerate(rows)]


def book(seed):
    random.seed(seed)
    words = ["alpha", "beta", "gamma", "delta", "self- aware", "interven- tion", "pre- and", "and", "Zeta", "ended.", "été", "so:"]  # a broken word after another would depend on which is joined first
    pages = []
    for n in range(random.choice([1, 2, 3, 5, 8])):
        lines = [f"Journal of Trials  {n + 10}"] if random.random() < 0.8 else []
        for _ in range(random.randint(0, 9)):
            lines.append(random.choice([["", "Methods", "2. Results:", "| a | b |", "Methods"], " ".join(random.choices(words, k=9)).replace("- ", random.choice(["- ", "-\n"])).split("\n")]))
        lines = [x for part in lines for x in ([random.choice(part)] if isinstance(part, list) and "" in part else part if isinstance(part, list) else [part])]
        lines += random.choice([[], [str(n + 1)], [f"Page {n + 1} of 9"], ["Copyright 2020 the authors"]])
        pages.append("\n".join(lines))
    return pages


def test_paragraphs_as_read_line_by_line(spark):
    books = {k: book(k) for k in range(60)}
    rows = [(k, n, text, "x") for k, pages in books.items() for n, text in enumerate(pages)]
    frame = spark.createDataFrame(rows + [(None, 0, "a", "x"), (99, None, "a", "x"), (98, 0, None, "x")], "doc long, page int, text string, line string").repartition(4)
    found = {}
    for r in fulltext.paragraphs(frame).collect():
        found.setdefault(r.doc, []).append((r.pos, r.first_page, r.last_page, r.kind, r.section, r.text))
    for k, pages in books.items():
        assert sorted(found.get(k, [])) == walk(pages), k
    assert found.keys() <= books.keys()


def test_han_text_over_pages_and_markdown(spark):
    pages = [("a", 1, "研究方\n法\n本研究以護理人\n員為對象，收集"), ("a", 2, "資料進行\n分析。\n\n== x ==\n| a | b |\n| c | d |"), ("b", 1, "")]
    rows = fulltext.paragraphs(spark.createDataFrame(pages, "doc string, page int, text string"), wrapped=True)
    got = [(r.pos, r.first_page, r.last_page, r.kind, r.text) for r in sorted(rows.collect(), key=lambda r: r.pos)]
    assert got == [(0, 1, 2, "text", "研究方法本研究以護理人員為對象，收集資料進行分析。"), (1, 2, 2, "text", "== x =="), (2, 2, 2, "table", "| a | b |"), (3, 2, 2, "table", "| c | d |")]
    (md,) = fulltext.to_markdown(rows, tables=True).collect()
    assert md.md == "研究方法本研究以護理人員為對象，收集資料進行分析。\n\n=\\= x =\\=\n\n| a | b |\n| c | d |"
    assert fulltext.paragraphs(spark.createDataFrame([], "doc string, page int, text string")).count() == 0


def test_texts_are_dealt_once(spark):
    pages = spark.range(40).selectExpr("concat('d', id % 4) AS doc", "cast(id AS int) AS page", "concat('Head\nline ', id, '\nmore\n', id) AS text")
    shuffles = [x for x in fulltext.paragraphs(pages)._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange" in x]
    assert len(shuffles) == 1 and "hashpartitioning(doc" in shuffles[0]
