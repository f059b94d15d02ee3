import pytest
from pyspark.sql import functions as F

from corpusloom.operators import examples as E


def pack(prompt, target, context, target_max, eos):
    """The packing rule, written out for one row."""
    goal = target[:target_max] + ([eos] if eos is not None else [])
    room = context - len(goal)
    if not goal or room <= 0:
        return None
    return prompt[:room] + goal, [-100] * len(prompt[:room]) + goal


CASES = [
    ([5, 6, 7], []),  # empty target still ends with the mark
    ([], [8]),
    (list(range(3, 40)), [8, 9]),
    ([5], list(range(3, 30))),  # target longer than its limit
]


@pytest.mark.parametrize("context,target_max,eos", [(10, 4, 1), (5, 4, 1), (6, 4, 1), (8, 3, None)])
def test_packs(spark, context, target_max, eos):
    df = spark.createDataFrame(
        [(i, p, t) for i, (p, t) in enumerate(CASES)], "k long, prompt_ids array<int>, target_ids array<int>"
    )
    got = {r.k: r for r in E.encode_packs(df, context, target_max, eos).collect()}
    for i, (p, t) in enumerate(CASES):
        expected, r = pack(p, t, context, target_max, eos), got[i]
        assert r.skip == (expected is None)
        if expected:
            assert (r.input_ids, r.labels) == expected
            assert r.attention_mask == [1] * len(r.input_ids)
            assert r.prompt_len + r.target_len == len(r.input_ids) <= context
        else:
            assert r.input_ids is None
    kept = E.drop_skipped(E.encode_packs(df, context, target_max, eos)).count()
    assert kept == sum(pack(p, t, context, target_max, eos) is not None for p, t in CASES)


def test_closing_cue_survives(spark):
    df = spark.createDataFrame([(list(range(10)), [50])], "prompt_ids array<int>, target_ids array<int>")
    row = E.encode_packs(df, 8, 4, 1, suffix_len=2).first()
    assert row.input_ids == [0, 1, 2, 3, 8, 9, 50, 1]
    short = E.encode_packs(df, 40, 4, 1, suffix_len=2).first()
    assert short.input_ids == [*range(10), 50, 1]


def test_representations(spark):
    df = spark.createDataFrame([("a", "b")], "text_romanized string, summary_romanized string")
    assert tuple(E.select_representation(df, "romanized", []).first()) == ("a", "b")
    with pytest.raises(ValueError, match="unknown representation"):
        E.select_representation(df, "morse", [])


def test_missing_columns_skip_only_that_dataset(spark):
    good, bad = spark.range(1).withColumn("text", F.lit("x")), spark.range(1)
    usable, report = E.require_columns({"good": good, "bad": bad}, ["text", "id"])
    assert list(usable) == ["good"] and report == {"bad": ["text"]}
    assert E.pair_with_labels(["x/one", "two"], []) == [("x/one", "one"), ("two", "two")]
    with pytest.raises(ValueError):
        E.pair_with_labels(["a", "b"], ["only"])


def test_split_counts_and_guard(spark):
    df = spark.createDataFrame([("train",), ("train",), ("test",)], "split string")
    counts = E.split_counts(df)
    assert {r.split: r.rows for r in counts.collect()} == {"train": 2, "validation": 0, "test": 1}
    with pytest.raises(Exception, match="no rows left in split validation"):
        E.require_nonempty(counts).collect()


def test_padded_batches(spark):
    data = [(i, [7] * (i + 1), [-100] * i + [7], [1] * (i + 1)) for i in range(5)]
    df = spark.createDataFrame(data, "k long, input_ids array<int>, labels array<int>, attention_mask array<int>")
    got = {r.k: r for r in E.pad_batch(E.number_batches(df, "k", 2)).collect()}
    assert [got[i].batch_id for i in range(5)] == [0, 0, 1, 1, 2]
    assert got[0].input_ids == [7, 0] and got[0].labels == [7, -100] and got[0].attention_mask == [1, 0]
    assert got[2].width == 4 and got[4].width == 5 and got[2].pad_cells == 1


def test_classification_row(spark):
    df = spark.createDataFrame([(1, [4, 0, 5]), (2, []), (3, [9] * 6)], "k long, ids array<int>")
    got = {r.k: r for r in E.classification_examples(df, 4).collect()}
    assert got[1].input_ids == [4, 0, 5, 0] and got[1].attention_mask == [1, 0, 1, 0] and got[1].last_index == 2
    assert got[2].input_ids == [0] * 4 and got[2].last_index == 0
    assert got[3].input_ids == [9] * 4 and got[3].last_index == 3
