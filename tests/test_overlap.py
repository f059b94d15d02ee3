import math
import random
from collections import Counter

import pytest

from corpusloom.operators import overlap as O

SCHEMA = "doc_id long, language string, prediction string, reference string"


def lcs(a, b):
    line = [0] * (len(b) + 1)
    for x in a:
        before = line[:]
        for j, y in enumerate(b):
            line[j + 1] = before[j] + 1 if x == y else max(before[j + 1], line[j])
    return line[-1]


def test_common_length_against_dynamic_programming():
    rng = random.Random(4)
    for _ in range(300):
        a = [rng.choice("abcd") for _ in range(rng.randrange(90))]
        b = [rng.choice("abcde") for _ in range(rng.randrange(90))]
        assert O.common_length(a, b) == lcs(a, b)


def grams(words, n):
    return Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def brute_bleu(pairs):
    hits, totals, c, r = [0] * 4, [0] * 4, 0, 0
    for p, q in pairs:
        p, q = p.split(), q.split()
        c, r = c + len(p), r + len(q)
        for n in range(4):
            a, b = grams(p, n + 1), grams(q, n + 1)
            hits[n] += sum(min(v, b[g]) for g, v in a.items())
            totals[n] += sum(a.values())
    if not any(hits) or not all(totals):
        return 0.0
    logs, miss = [], 1.0
    for h, t in zip(hits, totals):
        if h == 0:
            miss *= 2
            logs.append(math.log(1 / (miss * t)))
        else:
            logs.append(math.log(h / t))
    bp = 1.0 if c >= r else math.exp(1 - r / c)
    return 100 * bp * math.exp(sum(logs) / 4)


GROUPS = {
    "same": [("a b c d e", "a b c d e")],
    "apart": [("a b c d", "w x y z")],
    "short": [("a b", "a b")],
    "empty": [("", "a b")],
    "mixed": [("a a a b c", "a b c a d e"), ("x y z q r s", "x y q z"), ("one", "two")],
}


@pytest.fixture(scope="module")
def table(spark):
    data = [(i, g, p, r) for g, ps in GROUPS.items() for i, (p, r) in enumerate(ps, start=10 * len(g) + len(ps))]
    data = [(i, g, p, r) for i, (_, g, p, r) in enumerate(data)]
    return spark.createDataFrame(data, SCHEMA)


def test_bleu(table):
    got = {r.language: r.bleu for r in O.corpus_bleu(table).collect()}
    assert got == pytest.approx({g: brute_bleu(ps) for g, ps in GROUPS.items()})
    assert got["same"] == pytest.approx(100.0) and got["apart"] == got["empty"] == 0.0


def f(m, p, r):
    return 2 * m / (p + r) if m else 0.0


def test_rouge(table):
    got = {r.language: r for r in O.rouge_n(table).collect()}
    long = {r.language: r.rougeL for r in O.rouge_l(table).collect()}
    for g, ps in GROUPS.items():
        for n in (1, 2):
            scores = []
            for p, q in ps:
                a, b = grams(p.split(), n), grams(q.split(), n)
                scores.append(f(sum(min(v, b[k]) for k, v in a.items()), sum(a.values()), sum(b.values())))
            assert got[g][f"rouge{n}"] == pytest.approx(sum(scores) / len(scores))
        expected = [f(lcs(p.split(), q.split()), len(p.split()), len(q.split())) for p, q in ps]
        assert long[g] == pytest.approx(sum(expected) / len(expected))


def test_other_scripts_need_the_unicode_rule(spark):
    df = spark.createDataFrame([(1, "ru", "Привет мир", "привет мир")], SCHEMA)
    assert O.rouge_n(df).first().rouge1 == 1.0
    assert O.rouge_n(df, ascii_only=True).first().rouge1 == 0.0


def test_bleu_word_rule(spark):
    df = spark.createDataFrame([("It's 3.5, &quot;well-known&quot; (ok).\nNew 5-6",)], "t string")
    words = df.select(O.bleu_words(df.t)).first()[0]
    assert words == ["It's", "3.5", ",", '"', "well-known", '"', "(", "ok", ")", ".", "New", "5", "-", "6"]


def test_missing_texts_read_none_in_every_metric(spark):
    rows = [(0, "en", None, "none a"), (1, "en", "b", None), (2, "en", None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert O.rouge_l(df).first().rougeL == pytest.approx((2 / 3 + 0 + 1) / 3)
    assert O.rouge_n(df, (1,)).first().rouge1 == pytest.approx((2 / 3 + 0 + 1) / 3)
    assert O.corpus_bleu(df).first().bleu == 0.0


def test_words_of_the_caller(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(0, "en", "walks talked", "walk talks")], SCHEMA)
    stems = lambda text: F.split(F.regexp_replace(text, "(s|ed)( |$)", "$2"), " ")
    assert O.rouge_n(df, (1,), words=stems).first().rouge1 == 1.0 and O.rouge_l(df, words=stems).first().rougeL == 1.0
    assert O.rouge_n(df, (1,)).first().rouge1 == 0.0
