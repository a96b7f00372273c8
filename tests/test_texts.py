"""Cases with stated results for text, metadata, markup, verification, sources and sinks."""

import json
import random
import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vellum.functions import identifiers as I
from vellum.functions import markup as K
from vellum.functions import metadata as M
from vellum.functions import text as T
from vellum.functions import quality as Q
from vellum.operators import records, verify
from vellum.sources import notes, sinks


def each(spark, function, values):
    """Results of a column function over the values, in order."""
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string").coalesce(1)
    return [r[0] for r in df.orderBy("k").select(function(F.col("v"))).collect()]


CASES = [
    (I.normalize_doi, {"https://doi.org/10.1000/AbC.": "10.1000/abc", "doi: 10.1000/x%2By": "10.1000/x+y", "10.1000/a+b": "10.1000/a+b", "10.1000/100%": "10.1000/100%", "10.1/x": "", None: ""}),
    (I.normalize_title, {"The <i>Étude</i>: 2nd-Ed.": "theetude2nded", "陳 美玲": "陳美玲", None: ""}),
    (I.pmid_of, {"PMID: 123": "123", "https://pubmed.ncbi.nlm.nih.gov/456/": "456", "789": "789", "x 12": "", None: ""}),
    (I.concept_key, {"Burn_Out - x": "burn out x", "Ｆｕｌｌ－width": "full width", None: ""}),
    (I.match_key, {"A-b C!": "abc", None: ""}),
    (T.count_words, {"don't stop 3.5 well-known 護理師": 7, "a..b -c- d'e'f 護x理.y": 8, "": 0, None: 0}),
    (T.estimate_tokens, {"護理abcde": 4, "": 0, None: 0}),
    (T.guess_language, {"護理 in practice": "en", "護理研究ab": "zh", "テスト": "ja", "한국": "ko", "abc": "en", " ": "", None: ""}),
    (T.wikilinks, {"a [[x|y]] ![[pic]] [[z#h]]": ["x", "z"], None: []}),
    (T.numbers_in, {"n = 1,234.50, p = .001, 007 and 1.2.3 or a5": ["1234.5", "0.001", "7", "1.2"], "0.0 0 00": ["0", "0", "0"], "共１２３人，4·5％，SF-36 and COVID-19 scored 12": ["123", "4.5", "12"], None: []}),
    (T.edge_key, {"  Page 12  OF 30 ": "page # of #", None: None}),
    (T.csv_cell, {"=1+1": "'=1+1", "-5": "-5", 'a"b,c': '"a""b,c"', "@x": "'@x", None: ""}),
    (T.user_text, {"---\na: 1\n---\n# T\nown [[x|y]] words\n```\ncode\n```\n%% vellum:start v1 %%\nmine\n%% vellum:end %%\n[@cite] end": "\nown y words\n\n\n end"}),
    (T.redact, {"see https://a.b/c?d=1 or a@b.org, token=abcdef123 C:\\Users\\me /home/me/x.txt paper.pdf": "see <url> or <email>, token=<token> <path> <path> <file>", None: "",
        "Could not open C:\\Users\\Bob Chen\\My Vault\\Smith 2020 - Falls.md at line 3": "Could not open <path> at line 3", "\\\\srv\\share\\my me\\cohort data.xlsx missing": "<path> missing",
        "NotFound: /Users/Bob Yu/Application Support/x.default/z.sqlite is missing": "NotFound: <path> is missing", "wrote a/b/c.md, and/or 1/2 N = 120/240": "wrote <path>, and/or 1/2 N = 120/240",
        "pk_live_abcdef12345 ghs_abcdefgh1234 rk_live_abcdef1": "<token> <token> <token>", "SyntaxError: unexpected token: }": "SyntaxError: unexpected token: }",
        "Authorization: Bearer abc.def password='p@ss word'": "Authorization: Bearer <token> password=<token>", "key 0123abcd4567efgh8901ijkl2345 panel-window-cmd-report-issue-of-user": "key <hidden> panel-window-cmd-report-issue-of-user",
        "page 01234567-89ab-cdef-0123-456789abcdef of 0123456789abcdef0123456789abcdef.": "page <id> of <id>.", 'pref "obsidian.vaultPath" not "My own title"': 'pref "obsidian.vaultPath" not "…"',
        "同步「護理人員的經驗」失敗 can't read 'foo' of 'Falls RCTs'": "同步「…」失敗 can't read 'foo' of '…'", "(/mnt/c/Users/bob/vault)": "(<path>)", "saw /tmp/x and then /tmp/y, a (D:/b)/c d": "saw <path> and then <path>, a (<path> d", "Bearer abc.def GET https://bob:pw@API.openai.com/v1/x doi.org https://doi.org/ ftp://h/x": "Bearer <token> GET https://api.openai.com/… doi.org https://doi.org <link>", "x-api-key: 0a1b2c3d4e5f; api_key=supersecret123&tool=zb": "x-api-key: <token>; api_key=<token>&tool=zb", "path=/Volumes/USB/d.sav": "path=<path>"}),
    (lambda c: T.redact(c, ("My Vault", "alice", "跌倒預防")), {"My Vault of ALICE (alicex) in 跌倒預防論文": "<hidden> of <hidden> (alicex) in <hidden>論文"}),
    (M.normalize_pages, {"ｐ．４５～５６頁": "45-56", "第45至56頁": "45-56", "pp. 3, 7-9": "3, 7-9", "see below": None, "p45": "45", "第 12 頁": "12", "S1–S12、e3": "S1-S12, e3", "45-": None, "頁次：1 ~ 2": "1-2", None: None}),
    (M.normalize_design, {"隨機對照試驗": "RCT", "系統性文獻回顧": "systematic review", "質性研究": "qualitative", "Case_Control": "case-control", "rct": "RCT", "Systematic review and meta-analysis": "meta-analysis", "opinion": "other", "未報告": "", None: ""}),
    (M.clean_volume, {"第70卷": "70", "Vol. 7": "7", "7a": None, None: None}),
    (M.clean_issue, {"第2 - 3期": "2-3", "No. 4": "4", "(5)": "5", "x": None}),
    (lambda c: M.split_volume(c)["issue"], {"70（2）": "2", "第70卷第2期": "2", "Vol. 70, No. 2": "2", "70": None}),
    (lambda c: M.roc_date(c)["date"], {"民國112年": "2023", "中華民國112年4月1日": "2023-04-01", "112/04/01": "2023-04-01", "99.04": "2010-04", "112": "2023", "2020": None, "112/13": None, "99": None, None: None}),
    (M.clean_han, {"陳　美玲 et  al": "陳美玲 et al", None: ""}),
    (M.sample_size, {"N = 1,234 nurses": 1234, "not reported": None, "12": 12, None: None}),
    (M.evidence_level, {"Level II": "2", "CEBM 2011 level 3": "3", "iv": "4", "n/a": "", "high": ""}),
    (M.normalize_answer, {"**Yes**": "yes", "Can't tell": "unclear", "N/A": "not applicable", "是": "yes", "否": "no", "**不清楚**": "unclear", "不適用": "not applicable", "無法判斷": "unclear", "maybe": "", None: ""}),
    (lambda c: M.normalize_answer(c, ("是", "否", "不清楚", "不適用")), {"yes": "是", "不適用": "不適用", "x": ""}),
    (M.file_name, {"a/b: c?. ": "a b c", "": "Untitled", None: "Untitled"}),
    (M.status_of_tag, {"status/read ✅": "read", "other": ""}),
    (lambda c: notes.frontmatter_map(notes.split_frontmatter(c)["frontmatter"]), {'---\nkey: "N1"\ntags:\n  - a\n  - \'b c\'\nlist: [x, y]\nempty:\nkey: N2\n---\nbody': {"key": ["N2"], "tags": ["a", "b c"], "list": ["x", "y"], "empty": []}, "no front": {}}),
]


@pytest.mark.parametrize(("function", "cases"), CASES, ids=lambda x: getattr(x, "__name__", ""))
def test_functions(spark, function, cases):
    assert each(spark, function, cases) == list(cases.values())


def test_key_suffixes(spark):
    df = spark.range(0, 800).select("id", I.key_suffix(F.col("id")).alias("s"))
    assert [r.s for r in df.orderBy("id").collect()] == ["", *[I.suffix(n) for n in range(799)]]
    assert [I.suffix(n) for n in (0, 25, 26, 701, 702)] == ["a", "z", "aa", "zz", "aaa"]


def slow_score(term, text):
    if text == term:
        return 100
    at = text.find(term)
    if at == 0:
        return 80
    if at > 0:
        return 70 if text[at - 1] in " (:/,-" else 60
    if len(term) < 2:
        return 0
    pos, first = -1, None
    for c in term:
        pos = text.find(c, pos + 1)
        if pos < 0:
            return 0
        first = pos if first is None else first
    return 10 + int(20 * len(term) / (pos - first + 1) + 0.5)


def test_search_scores(spark):
    random.seed(2)
    labels = ["red steel", "redder", "a red", "x-red", "r e d", "", *["".join(random.choice("red sx") for _ in range(9)) for _ in range(60)]]
    assert each(spark, lambda c: T.term_score("red", c), labels) == [slow_score("red", x) for x in labels]
    df = spark.createDataFrame([("Red Steel", ["bar"], "g"), ("blue", ["red"], "steel"), ("blue", None, None)], "l string, k array<string>, g string")
    assert [r[0] for r in df.select(T.search_score("red steel", F.col("l"), F.col("k"), F.col("g"))).collect()] == [240 + 210 + 18, 200 + 100, None]


def brute_fuzzy(quote, text):
    n, need = len(quote), len(quote) if len(quote) < 3 else -(-9 * len(quote) // 10)
    if any(text[k : k + n] == quote for k in range(len(text))):
        return True
    slack = n - need + 2
    return need < n and any(verify.lcs_length(quote, text[max(0, s) : s + n + 2 * slack]) >= need for s in range(-slack, len(text)))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcdefghijkl"), min_size=1, max_size=14), st.lists(st.sampled_from("abcdefghijklm"), max_size=40), st.integers(0, 40), st.integers(0, 13))
def test_fuzzy_quotes_find_what_brute_force_finds(quote, text, at, gone):
    planted = text[:at] + [q for k, q in enumerate(quote) if k != gone] + text[at:]
    if verify.fuzzy_in(quote, planted):
        assert brute_fuzzy(quote, planted)
    if len(quote) >= 10 or gone >= len(quote):
        assert verify.fuzzy_in(quote, planted)


def test_quotes_join_on_rare_tokens(spark):
    words = [f"w{k}" for k in range(40)]
    texts = [(1, " ".join(words)), (2, "w1 w2 the the"), (3, None), (4, "Pre-\ntest of patients’ care")]
    quotes = [(1, "w3 w4 w5"), (2, "w5 w3"), (3, " ".join(w for w in words[5:25] if w != "w9")), (4, "pretest of patients care"), (5, "")]
    tokens = verify.match_tokens(F.col("t")).alias("tokens")
    q = spark.createDataFrame(quotes, "quote_id long, t string").select("quote_id", tokens)
    t = spark.createDataFrame(texts, "text_id long, t string").select("text_id", tokens)
    assert sorted(map(tuple, verify.exact_quotes(q, t).collect())) == [(1, 1), (4, 4)]
    assert sorted(map(tuple, verify.fuzzy_quotes(q, t).collect())) == [(1, 1), (3, 1), (4, 4)]


def by_steps(column):
    """The tokens of a text, each sign dropped by a pass of its own over a text folded in Python."""
    hyphens, letter = r"[\-\x{AD}\x{2010}-\x{2013}\x{2212}]", r"(\p{L})"
    text = F.regexp_replace(F.coalesce(I._nfkc(column), F.lit("")), r"[\x{200B}-\x{200D}\x{2060}\x{FEFF}]", "")
    text = F.regexp_replace(text, rf"{letter}{hyphens}\s+(?=\p{{L}})", "$1")
    text = F.regexp_replace(F.regexp_replace(text, r"\x{AD}", ""), rf"{letter}{hyphens}(?=\p{{L}})", "$1")
    text = F.lower(F.regexp_replace(text, letter + r"['’‘`´ʼ](?=\p{L}|\s|$)", "$1"))
    return F.regexp_extract_all(F.regexp_replace(text, f"({T.CJK})", " $1 "), F.lit(r"[\p{L}\p{M}\p{N}]+"), F.lit(0))


def test_tokens_in_one_pass_are_those_of_all_steps(spark):
    draw = random.Random(4)
    plain = "aZ9 éßŁİſĳŉ\n\t\r-‐‑–−'’‘`´ʼ.—“²×"
    odd = plain + "\xad\u200b\ufeff\u0301ﬁＡ護カ한𝒜𐐀"
    made = ["".join(draw.choices(signs, k=draw.randrange(12))) for signs in (plain, plain[:20], "aé-‐'’ \n", odd) for _ in range(3000)]
    single = [f"a{chr(k)}B {chr(k)}" for k in range(1, 0x3000)]
    df = spark.createDataFrame([(t,) for t in [*made, *single, None]], "t string")
    assert df.filter(verify.match_tokens(F.col("t")) != by_steps(F.col("t"))).collect() == []
    # Accented letters and marks of print need no folding, so such a text is not sent to Python.
    kept = "".join(chr(k) for k in range(1, 0x2100) if chr(k) not in odd) + plain
    letters = spark.createDataFrame([(c,) for c in kept], "c string")
    asis = [r.c for r in letters.filter(I.nfkc_of_odd(F.col("c")).isNull()).collect()]
    assert {"é", "Ł", "’", "—"} <= set(asis)
    assert all(unicodedata.normalize("NFKC", a + b) == a + b for a in asis for b in asis)


def pairs_of(df):
    return sorted({(r.quote_id, r.text_id) for r in df.select("quote_id", "text_id").collect()})


def test_texts_with_a_rare_token_alone_are_no_candidates(spark):
    words = [f"w{k}" for k in range(20)]
    quotes = spark.createDataFrame([(1, words), (2, ["a", "b"])], "quote_id long, tokens array<string>")
    texts = [(k, [words[k]]) for k in range(20)] + [(20, words[2:]), (21, [*words[:9], *words[10:], "a"]), (22, ["b", "x", "a"])]
    texts = spark.createDataFrame(texts, "text_id long, tokens array<string>")
    assert pairs_of(verify.candidate_pairs(quotes, texts, fuzzy=True)) == [(1, 20), (1, 21), (2, 22)]
    assert pairs_of(verify.candidate_pairs(quotes, texts, fuzzy=False)) == [(2, 22)]


def test_candidates_lose_no_match(spark):
    draw = random.Random(5)
    words = [f"w{k}" for k in range(30)]
    # Ids that repeat with other tokens, quotes of few and of repeated tokens.
    quotes = [(k // 2, draw.choices(words[: draw.choice([1, 3, 12, 30])], k=draw.choice([1, 2, 3, 9, 10, 25, 40]))) for k in range(60)]
    texts = [(k, draw.choices(words, k=5) + [t for t in draw.choice(quotes)[1] if draw.random() > 0.08] + draw.choices(words, k=5)) for k in range(200)]
    wanted = sorted({(i, j) for i, q in quotes for j, t in texts if verify.fuzzy_in(q, t)})
    q = spark.createDataFrame(quotes, "quote_id long, tokens array<string>")
    t = spark.createDataFrame(texts, "text_id long, tokens array<string>")
    assert wanted and pairs_of(verify.fuzzy_quotes(q, t)) == wanted
    assert pairs_of(verify.fuzzy_quotes(q, t.select("text_id", F.array_join("tokens", " ").alias("text")))) == wanted


def test_unsupported_numbers(spark):
    claims = spark.createDataFrame([(1, "found 1,200 of 3.50 and 7"), (2, "5")], "k int, text string")
    sources = spark.createDataFrame([(1, "1200 then 3.5"), (2, None)], "k int, text string")
    assert sorted(map(tuple, verify.unsupported_numbers(claims, sources, ["k"]).collect())) == [(1, "7"), (2, "5")]


def test_repeated_edges_and_chunks(spark):
    pages = spark.createDataFrame([("d", k, f"Journal {k}\nbody {'x' * k}\n\nmore\nend") for k in range(4)] + [("e", 0, "Journal 1")], "doc string, page int, text string")
    assert {tuple(r) for r in verify.repeated_edges(pages, lines=1).collect()} == {("d", "journal #", 4), ("d", "end", 4)}
    rows = spark.createDataFrame([("g", k, s) for k, s in enumerate([5, 5, 1, 20, 1, 1, 1])], "g string, i int, s int")
    got = verify.greedy_chunks(rows, "g", "i", F.col("s"), 10, 2).orderBy("i").collect()
    assert [r.chunk for r in got] == [0, 0, 1, 2, 3, 3, 4]


def test_html_to_markdown():
    page = "<head><title>x</title></head><h2>T &amp; U</h2><p>a <b>b</b> <a href='u'>l</a></p><ul><li>one<li>two<ol><li>in</ol></ul><table><tr><th>h<th>i</tr><tr><td>1<td>2</tr></table><script>no</script>"
    md = K.html_to_markdown(page)
    assert md.startswith("## T & U\n\na **b** [l](u)") and "- one" in md and "  1. in" in md and "| h | i |".replace(" ", "") in md.replace(" ", "") and "no" not in md
    assert K.html_to_markdown(None) == ""


def test_markdown_to_html():
    assert K.markdown_to_html("# A\n\nb *c* `d<`\n- x\n- y\n\n1. z\n> q\n```\n<k>\n```") == "<h1>A</h1>\n<p>b <em>c</em> <code>d&lt;</code></p>\n<ul>\n<li>x</li>\n<li>y</li>\n</ul>\n<ol>\n<li>z</li>\n</ol>\n<blockquote>q</blockquote>\n<pre><code>&lt;k&gt;</code></pre>".replace("</p>\n<ul>", "</p>\n<ul>")


@settings(max_examples=150, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=6), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=4), x, max_size=3), max_leaves=8))
def test_loose_json_reads_json(value):
    if isinstance(value, dict | list) and "`" not in json.dumps(value):
        assert json.loads(K.loose_json(f"Answer:\n```json\n{json.dumps(value)}\n```\nbye")) == value


def test_loose_json_mends():
    assert K.loose_json('x {"a": [1, 2,], } y') == '{"a":[1,2]}'
    assert K.loose_json('{"a": {"b": "cut of') == '{"a":{"b":"cut of"}}'
    assert K.loose_json('{"a": 1, "b') == '{"a":1}' and K.loose_json("nothing") is None and K.loose_json(None) is None


@given(st.text(alphabet=st.characters(max_codepoint=0xFFFF, exclude_categories=["Cs"]), min_size=1, max_size=12))
def test_ids_are_reversible(ref):
    if (encoded := K.encode_id(ref)) is not None:
        assert re.fullmatch(r"[A-Za-z0-9_-]{1,64}", encoded) and K.decode_id(encoded) == ref


def test_findings_and_repair(spark):
    df = spark.createDataFrame([("doi:10.1000/A", "p.45~56", "70(2)", "", "民國112年", "a  b"), ("10.1000/a", "45-56", "70", "2", "2023", "a b"), (None, None, None, None, None, None)], "doi string, pages string, volume string, issue string, date string, title string")
    record = {c: F.col(c) for c in df.columns}
    found = df.select(M.findings(record).alias("f")).collect()
    assert [(x.field, x.problem) for x in found[0].f] == [("doi", "form"), ("pages", "form"), ("volume", "issue inside"), ("issue", "in volume"), ("date", "republic year"), ("title", "spaces")]
    assert found[1].f == [] and found[2].f == []
    repaired = df.select(*[c.alias(k) for k, c in M.apply_findings(record, M.findings(record)).items()]).collect()
    assert tuple(repaired[0]) == ("10.1000/a", "45-56", "70", "2", "2023", "a b") and tuple(repaired[1]) == tuple(df.collect()[1])


def test_authors_and_citations(spark):
    schema = "creators array<struct<lastName: string, firstName: string, name: string, creatorType: string>>, year string"
    person = lambda last, first=None, kind="author": (last, first, None, kind)
    df = spark.createDataFrame([([person("Lee", "A"), person("Ed", "E", "editor")], "2020"), ([person("陳", "美玲"), person("Wu")], None), ([(None, None, "World Health Organization", "author"), person("B"), person("C")], "2019"), ([], "2018"), (None, "2017")], schema)
    got = [r[0] for r in df.select(M.short_citation(M.author_names(F.col("creators")), F.col("year"))).collect()]
    assert got == ["(Lee, 2020)", "(陳美玲 & Wu, n.d.)", "(World Health Organization et al., 2019)", "(Anonymous, 2018)", "(Anonymous, 2017)"]


def test_distinct_values(spark):
    df = spark.createDataFrame([(["SF-36", "sf-36", " ", "n/a", "BDI"],), ([],)], "v array<string>")
    assert [r[0] for r in df.select(M.distinct_values(F.col("v"))).collect()] == [["SF-36", "BDI"], []]


def test_regions_keep_the_users_text(spark):
    df = spark.createDataFrame([("mine\n<S>\nold\n<E>\nalso mine",), ("only mine",), ("",), (None,)], "t string")
    got = [r[0] for r in df.select(notes.replace_region(F.col("t"), F.lit("new"), "<S>", "<E>")).collect()]
    assert got == ["mine\n<S>\nnew\n<E>\nalso mine", "only mine\n\n<S>\nnew\n<E>\n", "<S>\nnew\n<E>", "<S>\nnew\n<E>"]


def test_vault_and_lines(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / ".hidden").mkdir()
    for name in ("a.md", "sub/b.md", ".hidden/c.md", "d.txt"):
        (tmp_path / name).write_text(f"---\nkey: K\n---\n{name}")
    vault = notes.read_vault(spark, f"file://{tmp_path}")
    assert vault.count() == 2
    keyed = vault.withColumn("key", F.element_at(notes.frontmatter_map(notes.split_frontmatter(F.col("text"))["frontmatter"])["key"], 1))
    assert notes.first_copy(keyed, "key").count() == 1
    lines = notes.config_lines(spark.createDataFrame([("# c\n a \n\n//x\nb",)], "text string"))
    assert [tuple(r) for r in lines.collect()] == [(2, "a"), (5, "b")]
    good, bad = notes.json_lines(spark.createDataFrame([('{"id": 1}',), ("oops",), (" ",), ("[1]",)], "value string"), "id long")
    assert [tuple(r) for r in good.collect()] == [(1,)] and sorted(r.line for r in bad.collect()) == ["[1]", "oops"]


def test_sinks(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, v string")
    new = spark.createDataFrame([(1, "a"), (2, "B"), (4, "d"), (3, None)], "k int, v string")
    assert sorted(r.k for r in sinks.changed_only(new, old, "k").collect()) == [2, 4]
    changes = spark.createDataFrame([(2, "x", False), (3, "y", True), (9, "z", None)], "k int, v string, gone boolean")
    assert sorted(map(tuple, sinks.upsert(old, changes, "k", "gone").collect())) == [(1, "a"), (2, "x"), (9, "z")]
    now, history = sinks.with_history(old.withColumn("ver", F.lit(1)), old.withColumn("ver", F.lit(1)).limit(0), spark.createDataFrame([(1, "c", 2)], "k int, v string, ver int"), "k", "ver")
    assert {tuple(r) for r in history.collect()} == {(1, "a", 1)} and (1, "c", 2) in {tuple(r) for r in now.collect()}
    sinks.write_csv(spark.createDataFrame([("1,a",)], "line string"), f"file://{tmp_path}/out.csv", "k,v")
    assert b"".join(p.read_bytes() for p in sorted((tmp_path / "out.csv").glob("part-*"))) == "\ufeffk,v\r\n1,a\r\n".encode()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=12), st.lists(st.sampled_from("abcde"), max_size=15))
def test_lcs_by_bits(a, b):
    row = [0] * (len(a) + 1)
    for y in b:
        row = [0] + [0] * len(a) if not a else _next_row(a, y, row)
    assert verify.lcs_length(a, b) == row[-1]


def _next_row(a, y, row):
    new = [0]
    for i, x in enumerate(a, 1):
        new.append(row[i - 1] + 1 if x == y else max(row[i], new[i - 1]))
    return new


QUALITY_CASES = [
    (I.repair_doi, {"HTTPS://doi.org/10.1000/Ab(2).": "10.1000/Ab(2)", "10.1000/a(b).": "10.1000/a(b)", "10.1000/x))": "10.1000/x", "10.1000/[x]": "10.1000/[x]", "10.1000/x].": "10.1000/x", "10.1/x": "", "": "", None: ""}),
    (I.loose_doi, {"DOI: 10.12/Q": "10.12/q", "dx.doi.org/10.1/x": "10.1/x", "x": "", None: ""}),
    (I.work_key, {"https://openalex.org/w12": "W12", "W1 x": "", None: ""}),
    (Q.tidy_title, {" 護理 : 研究。": "護理：研究", "A:  b": "A: b", None: ""}),
    (lambda c: Q.chinese_part(c, 2), {"護理雜誌 Journal of Nursing": "護理雜誌", "護理 AB": None, "Nursing": None, None: None}),
    (Q.tidy_journal, {"《護理》": "護理", " x ": "x", None: ""}),
    (Q.note_tag, {"#a b!": "a-b", "2020": "", None: ""}),
    (Q.uri_component, {"a b/c+(d)é~*": "a%20b%2Fc%2B(d)%C3%A9~*", None: None}),
    (Q.unwrap_callout, {"> [!x] T\n> a\n>b": "a\nb", "": "", None: ""}),
    (lambda c: Q.demote_headings(c, 1), {"# a\n```\n# b\n```\n###### c\n#d": "## a\n```\n# b\n```\n###### c\n#d", None: ""}),
    (lambda c: Q.fold_with_offsets(c)["folded"], {"Ｅ́é ﬁX": "ee fix", "": "", None: None}),
    (lambda c: Q.fold_with_offsets(c)["starts"], {"aﬁb": [0, 1, 1, 2], "": [], None: None}),
    (Q.last_json_block, {"x\n```json\n{1}\n```\n```json\n{2}\n```": "{2}", "```json\n{3}\n> ⚠️ cut": "{3}", "```\n{}\n```": None, "": None, None: None}),
    (Q.without_json_block, {"x\n\n## JSON\n```json\n{}\n```\nz": "x\n\nz", "no block": "no block", None: ""}),
    (lambda c: Q.embedded_json(c, "f"), {'<pre>{"format":"f","a":1}</pre><pre>x</pre>': '{"format":"f","a":1}', "<pre>{}</pre>": None, None: None}),
]


@pytest.mark.parametrize(("function", "cases"), QUALITY_CASES)
def test_quality_functions(spark, function, cases):
    assert each(spark, function, cases) == list(cases.values())


def test_citekeys_of_other_bases_and_reserved_places(spark):
    entries = [(1, "u1", None, "lee2020x", "2020"), (2, "u2", None, "lee2020x", "2021"), (3, "u3", None, "lee2020xa", "2019"), (4, "u4", "Lee2020XB", "x", "2018"), (5, "u5", "lee2020xb", "x", "2022"), (6, "u6", None, "lee2020x", "2022"), (7, "u7", None, "wu", None)]
    frame = spark.createDataFrame(entries, "id int, uid string, explicit string, base string, added string")
    kept = spark.createDataFrame([("u6", "lee2020xq"), ("gone", "lee2020x"), ("u7", "other")], "uid string, citekey string")
    retired = spark.createDataFrame([("wua",)], "citekey string")
    found = {r.id: r.citekey for r in records.assign_citekeys(frame, kept, retired).collect()}
    # Bare lee2020x is held by an entry that is gone, ...a is another entry's base, ...b explicit.
    assert found == {1: "lee2020xc", 2: "lee2020xd", 3: "lee2020xa", 4: "Lee2020XB", 5: "lee2020xba", 6: "lee2020xq", 7: "wu"}


def test_citekeys_pass_occupied_places_of_any_length_and_meet_no_list_of_them(spark):
    occupied = {0, 2, 18_278, 18_279}  # the bare base, b, zzz and aaaa
    entries = spark.range(18_281).selectExpr("id", "cast(id AS string) AS uid", "cast(NULL AS string) AS explicit", "'b1x' AS base", "'2020' AS added")
    retired = spark.createDataFrame([("b1x",), ("B1Xb",), ("b1xzzz",), ("b1xaaaa",), ("b1x-a",), ("other",)], "citekey string")
    found = records.assign_citekeys(entries, spark.createDataFrame([], "uid string, citekey string"), retired)
    # An array of a base's places beside each of its rows would grow with the square of the base.
    assert "collect_set" not in found._jdf.queryExecution().analyzed().toString()
    free = [n for n in range(18_290) if n not in occupied][:18_281]
    assert {r.id: r.citekey for r in found.collect()} == {k: f"b1x{I.suffix(n - 1)}" for k, n in enumerate(free)}


def test_features_in_a_circle_or_without_what_they_require_stay_off(spark):
    rows = [("a", True, []), ("b", True, ["a"]), ("c", True, ["d"]), ("d", True, ["c"]), ("e", True, ["nothing"]), ("f", None, None), ("g", True, ["b", "f"])]
    found = records.enabled_features(spark.createDataFrame(rows, "id string, on boolean, requires array<string>")).collect()
    assert {r.id for r in found if r.enabled} == {"a", "b"} and len(found) == 7


def test_settings_come_back_with_values_or_an_error(spark):
    rows = [(1, '{"name": "a"}'), (2, "{"), (3, None), (4, '{"name": null}'), (5, "[]"), (6, "")]
    read = records.read_settings(spark.createDataFrame(rows, "id int, text string"), "text", "name string", ("name",)).orderBy("id").collect()
    assert [r.error for r in read] == [None, "json", "json", "name", "json", "json"] and [r.settings is None for r in read] == [False] + [True] * 5


def test_findings_read_each_field_once(spark):
    """A text's shape is told once for each function that looks at it, not once for each use of the result."""
    record = {k: F.col(k) for k in ("doi", "pages", "volume", "issue", "date", "title")}
    df = spark.createDataFrame([("", "", "70(2)", "", "112/04", "x")], ", ".join(f"{k} string" for k in record))
    plan = df.select(M.findings(record).alias("f"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("translate(") <= 6
    (row,) = df.select(M.findings(record).alias("f")).collect()
    assert [(f.field, f.suggested) for f in row.f] == [("volume", "70"), ("issue", "2"), ("date", "2023-04")]


def test_folding_plain_texts_needs_no_python(spark):
    """Only texts with signs beyond ASCII are sent to Python, where a batch's places are one array of integers."""
    rows = [("Ab\nC",), ("",), (None,), ("ﬁÉx",)]
    found = spark.createDataFrame(rows, "t string").select(Q.fold_with_offsets(F.col("t")).alias("f")).collect()
    assert [None if r.f is None else (r.f.folded, r.f.starts) for r in found] == [("ab\nc", [0, 1, 2, 3]), ("", []), None, ("fiex", [0, 0, 1, 2])]
    plan = spark.createDataFrame(rows, "t string").select(Q.fold_with_offsets(F.col("t")).alias("f"))._jdf.queryExecution().analyzed().toString()
    assert re.search(r"_folded\(CASE WHEN NOT RLIKE", plan)


def test_guarded_shapes_find_what_the_shapes_find(spark):
    """Random texts, whose spans by one guarded pattern are those by the plain alternation; one has the mark itself."""
    import random

    random.seed(11)
    bits = ["data:", "http://", "a.b", "@x.org", "Bearer ", "token = ", "sk-", "C:\\", "~/", "/", "\\", "My file", ".pdf", ".docx", "report", "Word", "x9", "-", "_", ".", ",", ";", " ", " ", "\n", "'", '"', "“", "”", "「", "」", "é", "跌倒", "0" * 8, "abcdef0123456789" * 2, "a" * 32, "b1" * 13, "%TEMP%", "(", ")", ":", "ghp_abcdefgh"]
    texts = ["".join(random.choices(bits, k=random.randint(1, 40))) for _ in range(3000)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    plain, guarded = "|".join(p for _, p in T.SHAPES), T.guarded()
    found = rows.select("t", F.regexp_extract_all("t", F.lit(plain), F.lit(0)).alias("a"), F.regexp_extract_all("t", F.lit(guarded), F.lit(0)).alias("b")).collect()
    assert all(r.a == r.b for r in found) and sum(len(r.a) for r in found) > 3000
    told = spark.createDataFrame([(f"{T.MARK}see a@b.org{T.MARK} or",)], "t string").select(T.redact(F.col("t")).alias("t")).first().t
    assert told == f"{T.MARK}see <email>{T.MARK} or"


def test_pages_go_to_python_in_small_batches(spark):
    rows = spark.createDataFrame([("<p>a</p>",), (None,)], "html string").select(K.html_to_md(F.col("html")).alias("md"))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan
    assert [r.md.strip() for r in rows.collect()] == ["a", ""]


def test_numbers_are_made_distinct_only_where_no_source_has_them(spark):
    claims = spark.createDataFrame([(1, "In 12 of 13, and 12."), (1, "Again 12 and 13"), (None, "12"), (3, None)], "id long, text string")
    sources = spark.createDataFrame([(1, "Saw 13 and 13"), (2, "12")], "id long, text string")
    left = verify.unsupported_numbers(claims, sources, ["id"])
    assert sorted((r.id or 0, r.number) for r in left.collect()) == [(0, "12"), (1, "12")]
    plan = left._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1 and plan.index("Aggregate") < plan.index("Join")
