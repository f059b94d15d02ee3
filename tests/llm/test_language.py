import random

import numpy as np
from pyspark.sql import functions as F

from corpusloom.llm import language

VOICES = {"aa": ["kato", "mira", "solo", "pani"], "bb": ["grüß", "schtz", "krampf", "wald"], "cc": ["ойла", "мир", "снег"]}


def made(rng, lang, words=30):
    return " ".join(rng.choice(VOICES[lang]) for _ in range(words))


def rows(n=90):
    rng = random.Random(5)
    langs = sorted(VOICES)
    return [(i, made(rng, langs[i % 3]), langs[i % 3]) for i in range(n)]


def test_languages_of_held_out_rows_and_odd_texts(spark):
    odd = [(1000, None, "aa"), (1001, "", "aa"), (1002, "123 !!", "aa"), (1003, "kato " * 30000, None), (None, "wald", "bb")]
    docs = spark.createDataFrame(rows() + odd + rows(3), "doc_id long, text string, lang string")
    docs = docs.withColumn("score", F.lit("clash")).withColumn("lang_pred", F.lit(0))
    model = language.learn(docs, F.col("doc_id") % 4 != 2, per_language=15, rows=40, landmarks=20)
    got = language.identify(docs, model).select("doc_id", "lang", "text", "__language.*").collect()
    assert len(got) == 98
    for r in got:
        if r.doc_id in (1000, 1001, 1002):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred == (r.lang or "aa") and 0.5 < r.score <= 1.0


def test_weights_per_ngram_equal_the_kernel_expansion():
    texts = [t for _, t, _ in rows(12)]
    langs = [lang for *_, lang in rows(12)]
    model = language.fit(texts, langs, landmarks=12)
    place = model.places()
    whole = model.scores(["kato wald solo"], place)
    own = set(language.grams("kato wald solo").tolist()) & set(model.codes.tolist())
    by_hand = sum(model.weights[model.codes.tolist().index(c)] for c in own) / len(own) ** 0.5
    assert abs(whole[0] - by_hand).max() < 1e-4


def test_matrices_in_parts_give_the_same_model_and_answers(monkeypatch):
    texts, langs = [t for _, t, _ in rows(30)], [lang for *_, lang in rows(30)]
    whole = language.fit(texts, langs, landmarks=9)
    asked = [t for _, t, _ in rows(60)] + [None, "", "77"]
    names, scores = language.predict(whole, asked)
    monkeypatch.setattr(language, "CELLS_AT_ONCE", 100)
    parts = language.fit(texts, langs, landmarks=9)
    assert parts.codes.tolist() == whole.codes.tolist() and abs(parts.weights - whole.weights).max() < 1e-6
    again, close = language.predict(parts, asked, parts.places())
    assert again == names and abs(close - scores).max() < 1e-5


def test_weights_equal_ridge_regression_on_the_plain_kernel():
    texts, langs = [t for _, t, _ in rows(12)], [lang for *_, lang in rows(12)]
    model = language.fit(texts, langs, landmarks=12, ridge=1e-2)
    sets = [set(language.grams(t).tolist()) & set(model.codes.tolist()) for t in texts]
    kernel = np.array([[len(a & b) / (len(a) * len(b)) ** 0.5 for b in sets] for a in sets])
    wanted = np.array([[1.0 if lang == name else -1.0 for name in model.languages] for lang in langs])
    expected = kernel @ np.linalg.solve(kernel + 1e-2 * len(texts) * np.eye(len(texts)), wanted)  # all texts are landmarks
    assert abs(model.scores(texts, model.places()) - expected).max() < 1e-3


def test_blocks_of_a_long_text_give_the_same_ngrams(monkeypatch):
    text = "abcdefgh" * 50 + "é"
    expected = language.grams(text).tolist()
    monkeypatch.setattr(language, "BLOCK_BYTES", 7)
    assert language.grams(text).tolist() == expected


def test_no_rows_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "kato", None)], "doc_id long, text string, lang string")
    model = language.learn(docs, F.lit(True))
    assert model is None
    assert language.identify(docs, model).first()["__language"].lang_pred == "und"
    assert language.identify(docs.limit(0), model).count() == 0


def test_empty_texts_take_no_places(spark):
    rows = [(i, "" if i % 2 else None, "sparse") for i in range(600)] + [(1000 + i, f"zzq zq {i}", "sparse") for i in range(6)]
    rows += [(2000 + i, f"the word {i}", "full") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.learn(docs, F.lit(True), per_language=20, landmarks=10)
    found = language.identify(docs.where("length(text) > 0"), model).select("lang", "__language.lang_pred").collect()
    assert all(r.lang == r.lang_pred for r in found)
