import os

import pytest
from pyspark.sql import functions as F

from vellum.llm import langid as L
from vellum.session import table

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    docs = table(spark, DATA, "documents")
    return L.train(docs, ~L.held_out(F.col("doc_id")))


@pytest.mark.skipif(not os.path.exists(DATA), reason="needs the test tables")
def test_held_out_accuracy(spark, model):
    docs = table(spark, DATA, "documents")
    found = L.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").filter(L.held_out(F.col("doc_id")))
    n, right, rejected = found.agg(F.count("*"), F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.sum(F.col("rejected").cast("int"))).first()
    assert n > 200 and right > 0.98 and rejected <= 0.02 * n


FOREIGN = {
    "russian": "Все люди рождаются свободными и равными в своём достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства.",
    "chinese": "人人生而自由，在尊严和权利上一律平等。他们赋有理性和良心，并应以兄弟关系的精神相对待。",
    "finnish": "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä.",
    "polish": "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa.",
    "turkish": "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler ve birbirlerine karşı kardeşlik zihniyeti ile hareket etmelidirler.",
    "gibberish": "xq zvkj wpfq gjkx bzzq vwxk jqpd kxzv mqjf wxvz qqkj zpwx fvkq jzxw",
    "keys": "asdf jklö qwer uiop zxcv bnmm fghj dfgh werty sdfg hjkl cvbn rtyu",
}


@pytest.mark.skipif(not os.path.exists(DATA), reason="needs the test tables")
@pytest.mark.parametrize("name", FOREIGN)
def test_languages_never_learned_are_rejected(model, name):
    label, score, rejected = model.predict(FOREIGN[name])
    assert label in model.labels and rejected and score < model.threshold


@pytest.mark.skipif(not os.path.exists(DATA), reason="needs the test tables")
def test_right_predictions_stay(spark, model):
    docs = table(spark, DATA, "documents").filter(L.held_out(F.col("doc_id")))
    right = L.identify(docs, model, keep=("doc_id", "lang")).filter("lang = lang_pred").collect()
    assert sum(not r.rejected for r in right) >= 0.98 * len(right)
    assert 0.01 < model.temperature < 20


def test_a_few_texts_and_many_languages(spark):
    few = L.fit(["the thing", "le chose", "the other"], ["en", "fr", "en"])
    assert few.labels == ["en", "fr"] and few.predict("the")[0] == "en" and not few.predict("the")[2]
    many = L.fit([f"{chr(97 + k // 10)}{chr(107 + k % 10)} wort" for k in range(230)], [f"l{k}" for k in range(230)])
    assert len(many.labels) == 230


@pytest.mark.skipif(not os.path.exists(DATA), reason="needs the test tables")
def test_training_never_sees_the_held_out_fold(spark, model):
    docs = table(spark, DATA, "documents")
    other = docs.withColumn("lang", F.when(L.held_out(F.col("doc_id")), "xx").otherwise(F.col("lang"))).withColumn("text", F.when(L.held_out(F.col("doc_id")), "qqq").otherwise(F.col("text")))
    again = L.train(other, ~L.held_out(F.col("doc_id")))
    assert again.labels == model.labels and (again.table == model.table).all() and again.threshold == model.threshold


def test_texts_without_letters_are_undetermined(model):
    for text in (None, "", "12 34 ½²", "... !!"):
        assert model.predict(text) == ("und", 0.0, True)


def test_very_long_texts_and_forgetting(model, monkeypatch):
    monkeypatch.setattr(L, "REMEMBERED", 10)
    text = "the and of thing " * 20_000
    assert model.predict(text)[:2] == model.predict(text)[:2]
    assert model.predict("z" * 50_000)[0] in model.labels


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "abc", None), (2, None, "en")], "doc_id long, text string, lang string")
    empty = L.train(docs, F.lit(True))
    assert [tuple(r) for r in L.identify(docs, empty).collect()] == [(1, "und", 0.0, True), (2, "und", 0.0, True)]
    assert L.identify(docs.limit(0), empty).count() == 0


def test_filter_keeps_all_columns(spark, model):
    docs = spark.createDataFrame([(1, "the and of that thing", "s", "x"), (2, None, "s", "y"), (1, "the and of that thing", "s", "x")], "doc_id long, text string, score string, lang_pred string")
    kept = L.identify(docs, model, keep=tuple(docs.columns), only_accepted=True)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [1, 1]


def test_words_not_seen_are_accepted_and_noise_is_not():
    import random

    random.seed(3)
    syllables = {"aa": "ka to mi ren sol va".split(), "bb": "brü stei chen wald ung ver".split(), "cc": "çon aux lleu îr oué ent".split()}
    word = lambda lang: "".join(random.choice(syllables[lang]) for _ in range(random.randint(2, 4)))
    seen = {lang: [word(lang) for _ in range(150)] for lang in syllables}
    texts, langs = zip(*[(" ".join(random.choice(seen[lang]) for _ in range(60)), lang) for lang in syllables for _ in range(60)], strict=True)
    model = L.fit(list(texts), list(langs))
    known = {w for words in seen.values() for w in words}
    new = [(lang, " ".join(w for w in (word(lang) for _ in range(40)) if w not in known)) for lang in syllables for _ in range(40)]
    found = model.predict_all([t for _, t in new])
    assert sum(p[0] == lang for p, (lang, _) in zip(found, new, strict=True)) >= 0.98 * len(new)
    assert sum(p[2] for p in found) <= 0.05 * len(new)  # rejected for it
    noise = [" ".join("".join(random.choice("bcdfghjklmnpqrstvwxz") for _ in range(6)) for _ in range(12)) for _ in range(60)]
    assert sum(not p[2] for p in model.predict_all(noise)) <= 0.05 * len(noise)  # accepted for all that


def test_most_labels_bound_what_is_learned(spark, monkeypatch):
    monkeypatch.setattr(L, "MOST_LABELS", 2)
    rows = [(k, f"word{k % 3} text of many letters", f"l{k % 3}" if k < 60 else f"rare{k}") for k in range(90)]
    model = L.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    assert model.labels == ["l0", "l1"]
