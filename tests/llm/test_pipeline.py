import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from vellum.llm import langid, mixing, simhash


@pytest.fixture(scope="module")
def docs(spark):
    random.seed(9)
    words = {"en": "the of and thing with that".split(), "fr": "le que est dans avec une".split()}
    rows = []
    for k in range(150):
        lang = "en" if k % 3 else "fr"
        rows.append((k, " ".join(random.choice(words[lang]) + random.choice(["", "", str(k)]) for _ in range(60)), lang, f"s{k % 4}", 1))
    rows += [(1_000 + k, rows[k][1], rows[k][2], "s0", 1) for k in range(30)] + [(2_000, None, "en", "s1", 0), (2_001, "123 456", "en", "s1", 7), (2_002, "", None, None, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)


def test_stages_against_brute_force(spark, docs):
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language", "exact", "near", "mixing", "encoding"]
    model = langid.train(docs, ~langid.held_out(F.col("doc_id")))
    kept = stages["language"](spark, docs, "")
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.collect() if not model.predict(r.text)[2]}

    best = {}
    for r in kept.collect():
        best[r.text] = max(best.get(r.text, -1), r.doc_id)
    exact = stages["exact"](spark, kept, "")
    assert exact.columns == docs.columns and sorted(r.doc_id for r in exact.collect()) == sorted(best.values())

    rows = {r.doc_id: simhash.fingerprint(r.text.encode()) for r in exact.collect()}
    root = {i: i for i in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in rows:
        for j in rows:
            if (rows[i] ^ rows[j]).bit_count() <= 2 and find(i) != find(j):
                root[max(find(i), find(j))] = min(find(i), find(j))
    near = stages["near"](spark, exact, "")
    assert sorted(r.doc_id for r in near.collect()) == sorted({find(i) for i in rows})

    repeats = {r.doc_id: r.repeats for r in mixing.mix(near).collect()}
    mixed = stages["mixing"](spark, near, "")
    assert mixed.columns == docs.columns
    assert sorted(r.doc_id for r in mixed.collect()) == sorted(i for i, n in repeats.items() for _ in range(n))

    coded = stages["encoding"](spark, mixed, "").collect()
    assert sorted(r.doc_id for r in coded) == sorted(r.doc_id for r in mixed.collect()) and all(r.n_tokens > 0 for r in coded)


def test_repeated_and_missing_doc_ids(spark):
    """Rows are judged by their own text: one row of a text stays, and rows of one id with other texts stay too."""
    stages = dict(corpus_pipeline.STAGES)
    texts = [" ".join(f"w{k}x{j}" for j in range(40)) for k in range(6)]
    rows = [(1, texts[0]), (1, texts[0]), (1, texts[1]), (None, texts[2]), (None, texts[2]), (None, texts[3]), (7, texts[4]), (7, texts[4]), (3, texts[4]), (None, texts[4]), (8, None), (8, ""), (None, texts[1])]
    docs = spark.createDataFrame([(i, t, "en", None, 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    for name, best in (("exact", 7), ("near", 3)):
        want = sorted([(1, texts[0]), (1, texts[1]), (None, texts[2]), (None, texts[3]), (best, texts[4]), (8, "")], key=repr)
        kept = stages[name](spark, docs, "")
        assert kept.columns == docs.columns
        assert sorted([(r.doc_id, r.text or "") for r in kept.collect()], key=repr) == want
    # All sources are one and take all words once.
    mixed = stages["mixing"](spark, docs, "")
    assert mixed.columns == docs.columns and sorted(map(tuple, mixed.filter("text <> ''").collect()), key=repr) == sorted(map(tuple, docs.filter("text <> ''").collect()), key=repr)


def test_run_on_no_documents(spark, docs, tmp_path):
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_clashing_columns_pass_through(spark, docs):
    extra = ("_repeats", "_copy", "_row", "_file", "_text", "own0x", "_metadata")
    clashing = docs.withColumns({c: F.concat(F.lit(f"{c}-"), F.col("doc_id").cast("string")) for c in extra})
    now = clashing
    for name, function in corpus_pipeline.STAGES[:-1]:
        now = function(spark, now, "")
        assert now.columns == clashing.columns, name
    rows = now.collect()
    assert rows and all(r[c] == f"{c}-{r.doc_id}" for r in rows for c in extra)
    assert corpus_pipeline.STAGES[-1][1](spark, now, "").count() == len(rows)
