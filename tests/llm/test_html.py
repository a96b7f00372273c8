import html
import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.llm import html as H
from vellum.session import table

DATA = "/root/testdata/sf0.01"


def text_of(*pages):
    """Texts of the pages of one host."""
    laid = [H.laid_out(H.blocks_of(p)) for p in pages]
    repeated: dict[int, int] = {}
    for keys, counts in H.counted_runs("h", list({mark: streams for mark, streams, _ in laid}.values())):
        for key, n in zip(keys.tolist(), counts.tolist(), strict=True):
            repeated[key] = repeated.get(key, 0) + n
    often = np.array([key for key, n in repeated.items() if n >= H.MIN_PAGES], np.int64)
    return [H.kept_text(streams, blocks, often, H.host_key("h")) for _, streams, blocks in laid]


def test_suffix_array_sorts_to_depth():
    rng = np.random.default_rng(1)
    tokens = rng.integers(0, 4, 400)
    for depth in (1, 2, 3, 4, 7):
        order, rank = H.suffix_groups(tokens, depth)
        cut = [tuple(tokens[k : k + depth]) for k in range(len(tokens))]
        assert [cut[k] for k in order] == sorted(cut)
        assert all((rank[a] == rank[b]) == (cut[a] == cut[b]) for a in range(0, 400, 7) for b in range(400))


def test_covered_tokens_match_brute_force():
    rng = np.random.default_rng(2)
    pages = [np.concatenate([rng.integers(0, 50, 30), [90, 91, 92, 93, 94], rng.integers(0, 50, 9)]) for _ in range(5)] + [np.array([], np.int64)]
    pages.append(pages[0].copy())
    got = H.covered_tokens(pages, 4, 3)
    runs = {}
    for k, p in enumerate({p.tobytes(): p for p in pages}.values()):
        for a in range(len(p) - 3):
            runs.setdefault(tuple(p[a : a + 4]), set()).add(k)
    for p, flags in zip(pages, got, strict=True):
        want = np.zeros(len(p), bool)
        for a in range(len(p) - 3):
            want[a : a + 4] |= len(runs[tuple(p[a : a + 4])]) >= 3
        assert (flags == want).all()


def test_boilerplate_by_repetition_and_by_mark():
    page = "<title>x</title><body><div><p>Welcome to our lovely site today</p><p>Own text {0} of the page {0} and more {0}</p><p>All rights reserved by the lovely firm</div>"
    assert text_of(*[page.format(k) for k in range(4)]) == [f"Own text {k} of the page {k} and more {k}" for k in range(4)]
    assert text_of(*[page.format(0)] * 4) == [re.sub("<[^>]+>", " ", page.format(0))[2:].strip().replace("  ", " ").replace("  ", " ")] * 4
    marked = "<div class='cookie-notice'>no</div><nav>no</nav><main><h1 class=header>T&eacute;st &#169;</h1><p>a<b>b</b>c <span class=ad>no</span>d<br>e<aside>no</aside><p>x&nbsp;y<div id=comments><p>no</div><form>no</form><p hidden>no<p style='display: none'>no<p>end</main><footer>no</footer><script>no</script>"
    assert text_of(marked) == ["Tést © abc d e x y end"]


def test_article_text_stays_though_repeated():
    page = "<nav>menu {0}</nav><article><h1>Same title of all the copies</h1><p>Same text in all of the pages here</p></article><div class=ad>ad {0}</div>"
    assert set(text_of(*[page.format(k) for k in range(5)])) == {"Same title of all the copies Same text in all of the pages here"}


@pytest.mark.parametrize("bad", ["", "   ", "<", "<p", "</p></div>", "<!-- open", "<p>a", "a<b", "&amp", "<script>x", "<title>t", "<head><p>a", "<article><p>a</article></article>b"])
def test_broken_pages(bad):
    assert len(text_of(bad)) == 1


@pytest.mark.skipif(not os.path.exists(DATA), reason="needs the test tables")
def test_all_pages_match_the_article(spark):
    pages = {r.page_id: r.html for r in table(spark, DATA, "pages").collect()}
    found = H.extract(table(spark, DATA, "pages")).collect()
    assert len(found) == len(pages)
    for r in found:
        inner = re.sub("</?b>", "", re.search("(?s)<article>(.*)</article>", pages[r.page_id])[1])
        assert r.text == " ".join(html.unescape(re.sub("<[^>]+>", " ", inner)).split()) and r.n_chars == len(r.text)


def test_hosts_nulls_repeats_and_clashing_columns(spark):
    rows = [(1, None, None, "c"), (2, "http://A.example/x?y#z", "", "c"), (3, "http://a.example", "<p>hello", "c"), (3, "http://a.example", "<p>hello", "c"), (None, "odd", "<p>x" + " long" * 50_000, "c")]
    found = H.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in found) == [(0, 250_001), (1, 0), (2, 0), (3, 5), (3, 5)]
    hosts = spark.createDataFrame([("http://A.b/c",), ("https://x.y?z",), (None,), ("z",)], "u string").select(H.host_of(F.col("u")).alias("h")).collect()
    assert [r.h for r in hosts] == ["a.b", "x.y", "", ""]
    assert H.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("partitions, adaptive, run_tokens", [(1, True, 50), (1, False, 400_000), (8, True, 400_000), (8, False, 50), (32, True, 7), (32, False, 400_000)])
def test_pieces_and_partitions_change_nothing(spark, monkeypatch, partitions, adaptive, run_tokens):
    monkeypatch.setattr(H, "RUN_TOKENS", run_tokens)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.enabled", str(adaptive).lower())
    try:
        rows = [(k, "http://one.example/p", f"<div>Menu of the site here</div><p>page {k} own words {k}") for k in range(40)]
        rows += [(100 + k, f"http://two.example/{k}", f"<div>Menu of the site here</div><p>page {k % 2} own words {k % 2}") for k in range(6)]
        rows += [(200 + k, f"http://h{k}.example", f"<div>Menu of the site here</div><p>page {k} own words {k}") for k in range(4)]
        found = {r.page_id: r.text for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert [found[k] for k in range(40)] == [f"page {k} own words {k}" for k in range(40)]
    # Two distinct pages of a host, and pages of hosts of their own, repeat nothing.
    assert [found[100 + k] for k in range(6)] == [f"Menu of the site here page {k % 2} own words {k % 2}" for k in range(6)]
    assert [found[200 + k] for k in range(4)] == [f"Menu of the site here page {k} own words {k}" for k in range(4)]


def test_classes_inside_an_article():
    page = (
        "<article><p>Let <math><mi>x</mi></math> be.</p><div class='social contract'><p>The contract of all</p></div><label>Kept label</label><div class='share'><a>T</a> <a>F</a></div>"
        "<div class=ad-slot>no</div><div class=ad-hoc>Made for this</div><div class=article-footer>no</div><svg><title>no</title><text>Figure {0}</text></svg>{1}</article>"
    )
    kept = "Let x be. The contract of all Kept label Made for this Figure "
    assert text_of(page.format(1, "")) == [kept + "1"]
    # A doubtful class is decided by the runs that other pages of the host repeat.
    notice = "<div class=notice>We moved our shop to the new street</div>"
    assert text_of(*[page.format(k, notice) for k in range(3)]) == [f"Let x be. Kept label Made for this Figure {k}" for k in range(3)]
    assert text_of(*[page.format(k, notice) for k in range(2)]) == [f"{kept}{k} We moved our shop to the new street" for k in range(2)]


def test_repeated_runs_decide_open_blocks_of_pages_with_an_article():
    page = "<div><p>Read all about our site here</p><p>Body {0} in plain divs {0} and more {0}</p></div><article>Teaser {0}</article>"
    assert text_of(*[page.format(k) for k in range(4)]) == [f"Body {k} in plain divs {k} and more {k} Teaser {k}" for k in range(4)]


@pytest.mark.skipif(not os.path.exists(DATA), reason="needs the test tables")
def test_pages_with_a_teaser_article_keep_their_body(spark):
    # The body in a plain element, and a small article beside it: few body blocks are repeated, so nearly all stay.
    pages = table(spark, DATA, "pages").withColumn("html", F.regexp_replace(F.regexp_replace("html", "<article>", "<div>"), "</article>", "</div><article>Teaser</article>"))
    whole = {r.page_id: r.text for r in H.extract(table(spark, DATA, "pages")).collect()}
    found = {r.page_id: r.text for r in H.extract(pages).collect()}
    assert sum(found[k] == f"{t} Teaser".strip() for k, t in whole.items()) >= 0.95 * len(whole)


def brute_text(pages, k, min_tokens=12):
    """Text of an open page of one host: every run of a block is looked for in every other distinct page."""
    streams = [[w for b in p for w in b.split()] for p in pages]
    distinct = list(dict.fromkeys(tuple(p) for p in pages))
    needed = max(3, 0.001 * len(distinct))
    flat = {p: [w for b in p for w in b.split()] for p in distinct}
    has = lambda run: sum(any(flat[p][a : a + len(run)] == run for a in range(len(flat[p]))) for p in distinct) >= needed
    often = [False] * len(streams[k])
    for a in range(len(streams[k]) - min_tokens + 1):
        if has(streams[k][a : a + min_tokens]):
            often[a : a + min_tokens] = [True] * min_tokens
    out, at = [], 0
    for b in pages[k]:
        n = len(b.split())
        whole = n < min_tokens and sum(b in p for p in distinct) >= needed
        if not whole and sum(often[at : at + n]) / n < 0.8:
            out.append(b)
        at += n
    return " ".join(out)


def test_open_pages_by_brute_force():
    rng = np.random.default_rng(4)
    words = [f"w{k}" for k in range(30)]
    long = ["this long notice stands on very many pages of the whole site and says nothing new", "read more about us"]
    pages = []
    for _ in range(14):
        blocks = [" ".join(rng.choice(words, int(rng.integers(1, 25)))) for _ in range(int(rng.integers(0, 5)))]
        for extra in long:
            if rng.random() < 0.5:
                blocks.insert(int(rng.integers(0, len(blocks) + 1)), extra + rng.choice(["", " a tail of own words here"]))
        pages.append(blocks)
    pages += pages[:2]
    texts = text_of(*["".join(f"<div>{b}</div>" for b in p) for p in pages])
    assert texts == [brute_text(pages, k) for k in range(len(pages))]


def test_own_text_stays_however_large_the_host():
    # Everyday runs of a few words reach many pages; only whole boilerplate goes.
    rng = np.random.default_rng(5)
    words = np.array([f"w{k}" for k in range(12)])
    bodies = [" ".join(rng.choice(words, 40)) for _ in range(1_500)]
    texts = text_of(*[f"<div>Welcome to our site</div><div>{b}</div><div>Copyright by the lovely firm</div>" for b in bodies])
    assert texts == bodies


def test_repeats_on_a_small_share_of_a_host_stay(spark, monkeypatch):
    notice = "<div>A notice of twelve words or more that three pages of the host share today</div>"
    rows = [(k, "http://h.example", f"<div>Body {k} in own words {k}</div>{notice if k < 3 else ''}") for k in range(12)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    kept = lambda: sum("notice" in r.text for r in H.extract(pages).collect())
    assert kept() == 0
    monkeypatch.setattr(H, "HOST_SHARE", 0.5)
    assert kept() == 3


def test_classes_of_readers_and_notices():
    page = "<article><p>Own text</p>{}</article>"
    for name in ("user-comments", "responses", "cookie-banner", "signup-box", "comment-list"):
        assert text_of(page.format(f"<div class='{name}'>no</div>")) == ["Own text"], name
    assert text_of(page.format("<div id='disqus_thread'>no</div>")) == ["Own text"]
    assert text_of(page.format("<div class='cookies-recipe'>Mix it</div>")) == ["Own text Mix it"]
    # Of a page without an article a doubtful class leaves the decision to the runs.
    body = "<div class='elementor-widget-text-editor'><p>Body {0} of the page</p></div><div class='right-side column'>More {0}</div>"
    assert text_of(*[body.format(k) for k in range(4)]) == [f"Body {k} of the page More {k}" for k in range(4)]
    assert text_of(body.format(1) + "<article>The article</article>") == ["The article"]
