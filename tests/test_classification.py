import math
import random
from collections import Counter

import pytest

from corpusloom.operators import classification as C, losses as L, planning as PL


def brute_report(pairs):
    classes = sorted({x for p in pairs for x in p})
    out = {}
    for c in classes:
        tp = sum(a == b == c for a, b in pairs)
        support, predicted = sum(a == c for a, _ in pairs), sum(b == c for _, b in pairs)
        p, r = tp / predicted if predicted else 0.0, tp / support if support else 0.0
        f = [(1 + b * b) * p * r / (b * b * p + r) if b * b * p + r else 0.0 for b in (1, 2)]
        out[c] = (p, r, *f, support)
    return out


def frame(spark, pairs):
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "ex_id long, label long, pred long")


@pytest.fixture(scope="module")
def pairs():
    rng = random.Random(2)
    # class 3 is only predicted, class 4 is never predicted
    return [(rng.choice([0, 1, 1, 1, 4]), rng.choice([0, 1, 3])) for _ in range(200)]


def test_report(spark, pairs):
    got = {r.label: (r.precision, r.recall, r.f1, r.f2, r.support) for r in C.class_report(frame(spark, pairs)).collect()}
    expected = brute_report(pairs)
    assert got.keys() == expected.keys()
    for c in expected:
        assert got[c] == pytest.approx(expected[c])
    means = C.macro_and_weighted(C.class_report(frame(spark, pairs))).first()
    assert means.macro_f2 == pytest.approx(sum(e[3] for e in expected.values()) / len(expected))
    assert means.accuracy == pytest.approx(sum(a == b for a, b in pairs) / len(pairs))
    assert means.accuracy == pytest.approx(C.accuracy(frame(spark, pairs)).first().accuracy)


def test_confusion_has_the_cells_that_occur_or_all_of_a_class_list(spark, pairs):
    count = Counter(pairs)
    got = {(r.label, r.pred): r.n for r in C.confusion_matrix(frame(spark, pairs)).collect()}
    assert got == dict(count)
    full = {(r.label, r.pred): r.n for r in C.confusion_matrix(frame(spark, pairs), classes=range(6)).collect()}
    assert full == {(a, b): count[(a, b)] for a in range(6) for b in range(6)}
    grouped = frame(spark, pairs).selectExpr("*", "ex_id % 2 AS part")
    cells = C.confusion_matrix(grouped, ["part"], classes=(0, 1)).collect()
    assert len(cells) == 8 and sum(r.n for r in cells) == sum(n for (a, b), n in count.items() if a < 2 and b < 2)


def test_very_many_classes(spark):
    df = spark.range(20000).selectExpr("id AS ex_id", "id AS label", "id AS pred")
    assert C.confusion_matrix(df).count() == 20000


def test_weights(spark):
    df = spark.createDataFrame([(0,), (0,), (0,), (2,)], "label long")
    got = {r.label: (r.n, r.pct, r.weight) for r in C.class_weights(df, 3).collect()}
    assert got == {0: (3, 75.0, 4 / 9), 1: (0, 0.0, 0.0), 2: (1, 25.0, 4 / 3)}
    with pytest.raises(Exception, match="label out of range: 2"):
        C.class_weights(df, 2).collect()


def test_batch_means_are_means_of_batches(spark, pairs):
    drawn = C.draw_batches(frame(spark, pairs), "ex_id", 5, 8, 3).cache()
    batches = {}
    for r in drawn.collect():
        batches.setdefault(r.batch_id, []).append((r.label, r.pred))
    assert {k: len(v) for k, v in batches.items()} == {i: 8 for i in range(5)}
    got = C.batch_mean_metrics(drawn).first()
    f2 = [sum(e[3] for e in brute_report(b).values()) / len(brute_report(b)) for b in batches.values()]
    assert got.mean_f2 == pytest.approx(sum(f2) / 5)
    acc = [sum(a == b for a, b in v) / 8 for v in batches.values()]
    assert got.mean_accuracy == pytest.approx(sum(acc) / 5)


def test_weighted_cross_entropy(spark):
    data = [(0, [2.0, 1.0]), (1, [0.5, 3.0]), (1, [4.0, 0.0])]
    df = spark.createDataFrame(data, "label long, logits array<double>")
    weights = C.class_weights(df, 2)
    w = {0: 3 / 2, 1: 3 / 4}
    nll = [math.log(sum(math.exp(x) for x in l)) - l[y] for y, l in data]
    expected = sum(w[y] * n for (y, _), n in zip(data, nll)) / sum(w[y] for y, _ in data)
    assert C.weighted_cross_entropy(df, weights).first().loss == pytest.approx(expected)


def test_token_loss_and_summary(spark):
    rows = spark.createDataFrame(
        [("a", 3, -1.0), ("a", 4, -3.0), ("a", -100, -9.0), ("b", None, None), ("c", 3, -0.5)],
        "language string, label int, logp double",
    )
    got = {r.language: r for r in L.token_loss(rows).collect()}
    assert (got["a"].num_tokens, got["a"].loss) == (2, 2.0) and math.isnan(got["b"].loss) and got["c"].loss == 0.5
    report = {r.language: r for r in L.summarise_groups(L.token_loss(rows), ["loss"], "num_tokens").collect()}
    assert report["macro"].loss == 1.25 and report["weighted"].loss == pytest.approx(4.5 / 3)
    strict = {r.language: r for r in L.summarise_groups(L.token_loss(rows), ["loss"], "num_tokens", skip_nan=False).collect()}
    assert math.isnan(strict["macro"].loss)


def test_labels_without_score_rows_stay(spark):
    packs = spark.createDataFrame([("a", [-100, 4]), ("b", [-100])], "language string, labels array<int>")
    scores = spark.createDataFrame([(4, -2.0)], "id int, logp double")
    got = {r.language: r.num_tokens for r in L.token_loss(L.score_labels(packs, scores, score_rows=1)).collect()}
    assert got == {"a": 1, "b": 0}


def test_plans(spark):
    headers = spark.createDataFrame([("data_val_000000.bin", 9), ("data_train_000001.bin", 15)], "file string, tokens long")
    row = PL.plan_iterations(PL.train_files(headers), 1, 10).first()
    assert (row.tokens, row.iterations) == (15, 2)  # 1.5 rounds to the even 2
    assert PL.plan_iterations(PL.train_files(headers), 1, 6).first().iterations == 2  # so does 2.5
    assert {r.file: r.tokens for r in PL.count_tokens(headers).collect()}[None] == 24
    assert PL.plan_iterations(headers.limit(0)).first().tokens == 0
    row = PL.example_iterations(spark.range(33), 8, 4, 2, 3).first()
    assert (row.max_iters, row.warmup, row.decay) == (15, 1, 13)
