import math
import random

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from corpusloom.operators import classification as C
from corpusloom.operators import classifier as ML

WORDS = ("kato mira solo pani lume dora vint hask".split(), "grun schtz krampf wald berg tal".split())


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    made = []
    for i in range(600):
        label = int(i % 5 == 0)
        mixed = [rng.choice(WORDS[label] if rng.random() < 0.75 else WORDS[1 - label]) for _ in range(8)]
        made.append((i, " ".join(mixed), label))
    return ML.split_rows(spark.createDataFrame(made, "doc_id long, text string, label long"), 42).cache()


def test_parts_are_fixed_by_the_key(rows, spark):
    sizes = {r.part: r["count"] for r in rows.groupBy("part").count().collect()}
    assert set(sizes) == set(ML.PARTS) and 240 < sizes["train"] < 360 and sizes["test"] > 100
    again = ML.split_rows(rows.drop("part").repartition(7), 42)
    assert sorted(again.select("doc_id", "part").collect()) == sorted(rows.select("doc_id", "part").collect())


def test_choice_by_held_out_loss(rows):
    model, tried = ML.choose_classifier(rows, 2, (1e-4, 1e-3, 50.0))
    assert [p for p, _ in tried] == [50.0, 1e-3, 1e-4]
    weights = {r.label: r.weight for r in C.class_weights(rows.where("part = 'train'"), 2).collect()}
    scored = model.transform(rows).select("part", "label", vector_to_array("probability").alias("p"), "prediction").collect()
    held = [r for r in scored if r.part == "validation"]
    loss = sum(-weights[r.label] * math.log(r.p[r.label]) for r in held) / sum(weights[r.label] for r in held)
    assert loss == pytest.approx(min(v for _, v in tried), rel=1e-9)
    assert max(v for _, v in tried) == dict(tried)[50.0]  # nearly constant predictions

    test = [r for r in scored if r.part == "test"]
    wanted = rows.where("part = 'test'")
    report = C.class_report(C.align_predictions(ML.classify(model, wanted), wanted.select("doc_id", "label"), "doc_id")).collect()
    for line in report:
        hits = sum(r.prediction == r.label == line.label for r in test)
        found, there = sum(r.prediction == line.label for r in test), sum(r.label == line.label for r in test)
        precision, recall = hits / found, hits / there
        assert line.f2 == pytest.approx(5 * precision * recall / (4 * precision + recall))
        assert line.f2 > 0.6


def test_test_rows_play_no_part(rows):
    other = rows.withColumn("label", F.when(F.col("part") == "test", 1 - F.col("label")).otherwise(F.col("label")))
    one, two = (ML.choose_classifier(df, 2, (1e-3,))[1] for df in (rows, other))
    assert one == two


def test_without_validation_rows(rows):
    with pytest.raises(ValueError, match="no validation rows"):
        ML.choose_classifier(rows.where("part <> 'validation'"), 2, (1e-3,))
