import random
import re

from pyspark.sql import functions as F

from vellum.operators import placement


def lcs_span(q, s, start, end):
    n, w = len(q), end - start
    dp = [[0] * (w + 1) for _ in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, w + 1):
            dp[i][j] = dp[i - 1][j - 1] + 1 if q[i - 1] == s[start + j - 1] else max(dp[i - 1][j], dp[i][j - 1])
    i, j, used = n, w, []
    while i > 0 and j > 0:
        if q[i - 1] == s[start + j - 1] and dp[i][j] == dp[i - 1][j - 1] + 1:
            used.append(start + j - 1)
            i, j = i - 1, j - 1
        elif dp[i - 1][j] >= dp[i][j - 1]:
            i -= 1
        else:
            j -= 1
    return dp[n][w], used[-1] if used else -1, used[0] if used else -1


def brute(text, quotes):
    """Each quote in turn against every place of the text."""
    words = [(m[0].lower(), m.start(), m.end()) for m in re.finditer(r"\w+", text)]
    s = [w for w, _, _ in words]
    taken, prefer, out = [], 0, []
    for quote in quotes:
        parts = [re.findall(r"\w+", p.lower()) for p in re.split(r"\s*(?:\[\.\.\.\]|\.\.\.+|…)\s*", quote or "")]
        parts = [p for p in parts if p]
        spans, at = [], prefer
        for q in parts:
            n = len(q)
            free = lambda c: all(c[1] < a or c[0] > b for a, b in taken)
            best = lambda cs: min((c for c in cs if free(c)), key=lambda c: (c[0] < at, c[0]), default=None)  # noqa: E731,B023
            hit = best([(k, k + n - 1) for k in range(len(s) - n + 1) if s[k : k + n] == q])
            need = -(-9 * n // 10)
            if hit is None and n >= 3:
                slack, order, near = n - need + 2, sorted(range(n), key=lambda k: s.count(q[k])), {}
                for anchor in order[: n - need + 1]:
                    for p in [k for k, w in enumerate(s) if w == q[anchor]]:
                        start = max(0, p - anchor - slack)
                        if start not in near:
                            length, a, b = lcs_span(q, s, start, min(len(s), p - anchor + n + slack))
                            near[start] = (a, b) if length >= need else None
                hit = best([c for c in near.values() if c])
            if hit is None or (spans and hit[0] <= spans[-1][1]):
                spans = []
                break
            spans.append(hit)
            at = hit[1] + 1
        if spans:
            taken += spans
            prefer = at
        out.append([[words[a][1], words[b][2]] for a, b in spans] or None)
    return out


def corpus(seed):
    random.seed(seed)
    vocabulary = [f"w{k}" for k in range(25)] + ["the", "of"]
    words = random.choices(vocabulary, k=160)
    text = "".join(w + random.choice([" ", " ", ", ", ".\n", "\n## "]) for w in words)
    quotes = []
    for _ in range(14):
        a = random.randrange(140)
        q = words[a : a + random.randint(1, 14)]
        if len(q) > 4 and random.random() < 0.4:
            q[random.randrange(len(q))] = "changed"
        if len(q) > 6 and random.random() < 0.3:
            q[3] = random.choice(["...", "[...]", "…"])
        quotes.append(" ".join(q).upper() if random.random() < 0.2 else " ".join(q))
    return text, quotes + ["", "absent words here", None]


def test_quotes_in_order_without_overlap_as_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(placement, "QUOTES_A_LANE", 5)
    found = {k: corpus(k) for k in range(12)}
    texts = spark.createDataFrame([(k, text, "x") for k, (text, _) in found.items()] + [(99, "no quotes", "x")], "text_id long, text string, quote string")
    quotes = spark.createDataFrame([(k, n, n, q) for k, (_, qs) in found.items() for n, q in enumerate(qs)] + [(98, 0, 0, "w1"), (None, 0, 0, "w1")], "text_id long, pos int, quote_id int, quote string").repartition(4)
    placed = placement.placed(quotes, texts)
    got = {}
    for r in placed.collect():
        got.setdefault(r.text_id, {})[r.pos] = r.spans
    assert got.pop(98) == {0: None} and got.keys() == found.keys()
    for k, (text, qs) in found.items():
        assert [got[k][n] for n in range(len(qs))] == brute(text, qs), k

    marks = placement.marked(texts, placed.filter("spans IS NOT NULL"), F.concat(F.lit("<"), F.col("pos").cast("string"), F.lit(":")), F.lit(">"))
    for r in marks.collect():
        text = "no quotes" if r.text_id == 99 else found[r.text_id][0]
        assert re.sub(r"<\d+:|>", "", r.text) == text
        for line in r.text.split("\n"):
            assert line.count("<") == line.count(">") and not re.search(r"<\d+:(?:#| )", line)
        if r.text_id != 99:
            spans = [s for v in got[r.text_id].values() for s in v or []]
            assert r.text.count("<") == sum(sum(bool(re.sub(r"^#{1,6} ", "", part).strip()) for part in text[a:b].split("\n")) for a, b in spans)


def test_han_quotes_and_broken_words(spark):
    texts = spark.createDataFrame([(1, "研究顯示護理人員的離職意圖偏高；interven-\ntion worked.")], "text_id long, text string")
    quotes = spark.createDataFrame([(1, 0, 0, "護理人員的離職"), (1, 1, 1, "離職意圖")], "text_id long, pos int, quote_id int, quote string")
    got = {r.pos: r.spans for r in placement.placed(quotes, texts).collect()}
    assert got == {0: [[4, 11]], 1: None}


def test_evidence_is_kept_by_its_quotes(spark):
    page1, page2 = "The trial enrolled forty nurses in two wards.", "Falls fell by half after the new training. Nobody left."
    texts = spark.createDataFrame([(1, page1 + "\n" + page2), (2, None)], "text_id long, text string")
    pages = spark.createDataFrame([(1, 1, page1), (1, 2, page2), (1, None, "x")], "text_id long, page int, text string")
    rows = [
        (1, "a", 0, "Falls fell by half after the new training", None), (1, "a", 1, "never said in this text", 3), (1, "b", 0, "two wards", None),
        (1, "c", 0, "in two wards. falls fell by half", 7), (2, "d", 0, "Falls fell by half", None), (1, "e", 0, None, None),
    ]
    quotes = placement.verified_quotes(spark.createDataFrame(rows, "text_id long, item string, n int, quote string, page int"), texts, pages)
    got = {(r["item"], r["n"]): (r["kept"], r["page_found"], r["page"]) for r in quotes.collect()}
    assert got == {("a", 0): (True, 2, None), ("a", 1): (False, None, 3), ("b", 0): (False, None, None), ("c", 0): (True, None, 7), ("d", 0): (False, None, None), ("e", 0): (False, None, None)}
    items = spark.createDataFrame([(1, i) for i in "abcef"] + [(2, "d")], "text_id long, item string")
    verdicts = {r["item"]: (r.kept, r.dropped, r.located, r.low_confidence) for r in placement.verified_items(items, quotes).collect()}
    assert verdicts == {"a": (1, 1, 1, False), "b": (0, 1, 0, True), "c": (1, 0, 0, False), "d": (0, 1, 0, True), "e": (0, 1, 0, True), "f": (0, 0, 0, True)}


def slow_near(where, quote):
    """Places of a quote as before: every stretch around its rarest tokens is compared."""
    n = len(quote)
    need, out, tried = -(-9 * n // 10), [], set()
    if n < 3:
        return []
    slack = n - need + 2
    for anchor in where.rarest(quote)[: n - need + 1]:
        for p in where.at.get(quote[anchor], ()):
            start = max(0, p - anchor - slack)
            if start not in tried:
                tried.add(start)
                length, a, b = lcs_span(quote, where.tokens, start, min(len(where.tokens), p - anchor + n + slack))
                if length >= need:
                    out.append((a, b))
    return out


def test_near_places_compare_only_stretches_that_hold_the_tokens(monkeypatch):
    random.seed(5)
    words = [random.choice([f"w{k}" for k in range(12)] + [f"r{k}" for k in range(200)]) for _ in range(1500)]
    where, compared = placement.Places(" ".join(words)), []
    monkeypatch.setattr(placement, "lcs_length", lambda a, b: compared.append(1) or lcs_span(a, b, 0, len(b))[0])
    anchors = 0
    for k in range(0, 1400, 7):
        quote = words[k : k + random.randint(1, 24)]
        if len(quote) > 11 and k % 2:
            quote[5] = "other"
        anchors += sum(len(where.at.get(quote[a], ())) for a in where.rarest(quote)[: placement.misses(len(quote)) + 1]) if len(quote) > 2 else 0
        assert where.near(quote) == slow_near(where, quote)
        assert where.near(quote) is where.near(list(quote))
    assert len(compared) < anchors / 4


def test_only_pages_that_can_hold_a_quote_are_read(monkeypatch):
    read = []
    monkeypatch.setattr(placement.Places, "__init__", lambda self, text, init=placement.Places.__init__: read.append(text) or init(self, text))
    words = [f"w{k % 97}x{k}" for k in range(5000)]
    pages = placement.PageIndex([(k // 50, " ".join(words[k : k + 50])) for k in range(0, 5000, 50)][::-1])
    assert pages.first([words[2010:2016]]) == 40 and pages.first([[*words[2010:2019], "other"]]) == 40
    assert pages.first([words[2010:2014], words[2020:2024]]) == 40 and pages.first([words[2010:2014], words[2060:2064]]) is None
    assert pages.first([[]]) is None and pages.first([]) is None and pages.first([["none"]]) is None
    assert len(read) == 1
