import random

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import mixing


def plain_targets(sizes, weights=(5, 2, 1), most=3):
    """Shares by weight; what lies above a bound is shared again until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    capped, total = set(), sum(sizes.values())
    while True:
        rest = total - sum(most * sizes[s] for s in capped)
        open_ = [s for s in names if s not in capped]
        share = {s: rest * weight[s] / sum(weight[o] for o in open_) for s in open_}
        above = {s for s in open_ if share[s] >= most * sizes[s]}
        if not above:
            return share | {s: most * sizes[s] for s in capped}
        capped |= above


def rows(n=4000):
    rng = random.Random(3)
    made = [(i, " ".join("w" * rng.randrange(1, 3) for _ in range(rng.randrange(0, 40))), rng.choice("aaaaaabcdefg")) for i in range(n)]
    return made + [(n, None, "a"), (n + 1, "one two three \x1c x", None), (None, "some words", None), (n + 2, "", "zero")]


def test_targets_and_taken_words(spark):
    docs = spark.createDataFrame(rows(), "doc_id long, text string, source string").withColumn("size", F.lit("clash"))
    got = mixing.mix_report(docs).join(docs.select("doc_id", "source"), "doc_id", "left").collect()
    assert len(got) == len(rows())
    sizes, taken, target = {}, {}, {}
    for r in got:
        key = r.source if r.doc_id is not None else None
        sizes[key] = sizes.get(key, 0) + r["size"]
        taken[key] = taken.get(key, 0) + r.taken
        target[key] = r.target
        assert r.taken <= 3 * r["size"] and (r["size"] == 0 or r.taken % r["size"] == 0)
    expected = plain_targets(sizes)
    for key in sizes:
        assert target[key] == pytest.approx(expected[key])
        assert abs(taken[key] - target[key]) <= 40
        assert {r.source_size for r in got if (r.source if r.doc_id is not None else None) == key} == {sizes[key]}
    again = mixing.mix_report(docs.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(str(r[: len(again[0])]) if 0 else str(r) for r in mixing.mix_report(docs).collect())


def test_smaller_share_is_a_subset(spark):
    docs = spark.createDataFrame([(i, "a b c d e", "x" if i < 500 else "y") for i in range(1000)], "doc_id long, text string, source string")
    little = {r.doc_id for r in mixing.mix_report(docs, (1, 9)).collect() if r.taken and r.doc_id < 500}
    more = {r.doc_id for r in mixing.mix_report(docs, (1, 3)).collect() if r.taken and r.doc_id < 500}
    assert 0 < len(little) < len(more) and little < more


def test_mix_repeats_documents(spark):
    docs = spark.createDataFrame([(i, "a b", "rare" if i % 50 == 0 else "zcommon") for i in range(1000)], "doc_id long, text string, source string")
    report = {r.doc_id: r.taken for r in mixing.mix_report(docs).collect()}
    counts = {r.doc_id: r["count"] for r in mixing.mix(docs).groupBy("doc_id").count().collect()}
    assert counts == {i: t // 2 for i, t in report.items() if t}
    assert counts[0] == 3


def test_repeated_rows_and_one_row_and_none(spark):
    schema = "doc_id long, text string, source string"
    same = spark.createDataFrame([(1, "a b c", "s")] * 5, schema)
    assert {r.taken for r in mixing.mix_report(same).collect()} == {3}
    assert mixing.mix_report(spark.createDataFrame([(1, None, None)], schema)).first().target == 0.0
    assert mixing.mix_report(spark.createDataFrame([], schema)).count() == 0


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame(rows(20), "doc_id long, text string, source string")
    plan = mixing.mix_report(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
