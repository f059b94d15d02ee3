from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusloom.functions.text import seeded_draw
from corpusloom.operators import sampling as S


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i, "en" if i % 4 else "de", f"t{i}") for i in range(40)] + [(100 + i, "fr", "x") for i in range(30)]
    return spark.createDataFrame(data, "doc_id long, language string, text string")


def sizes(df):
    return dict(Counter(r.language for r in df.collect()))


@pytest.mark.parametrize("repeats", [1 << 12, 1])  # with 1, every row is copied for its draws
def test_balanced_mix(spark, rows, monkeypatch, repeats):
    monkeypatch.setattr(S, "ROW_REPEATS", repeats)
    mixed = S.mix_languages(rows, "balanced", ("de", "en", "fr"), "doc_id", 42).cache()
    assert sizes(mixed) == {"de": 30, "en": 30, "fr": 30}
    got = mixed.collect()
    assert sorted(r.out_pos for r in got) == list(range(90))
    whole = {r.doc_id for r in rows.collect() if r.language in ("en", "fr")}
    assert {r.doc_id for r in got if r.language != "de"} == whole  # both have the largest size and stay as they are
    german = sorted(r.doc_id for r in rows.where("language = 'de'").collect())
    draws = spark.range(30).select("id", (seeded_draw(42, F.lit("draw"), F.lit("de"), F.col("id")) % 10).alias("i"))
    expected = {r.id: german[r.i] for r in draws.collect()}
    assert {r.draw: r.doc_id for r in got if r.language == "de"} == expected
    assert all(r.text == f"t{r.doc_id}" for r in got if r.language != "fr")
    mixed.unpersist()


def test_balanced_mix_needs_rows_of_every_language(rows):
    with pytest.raises(Exception, match="no rows for language xx"):
        S.mix_balanced(rows, ("de", "xx"), "doc_id", 1).collect()


def test_natural_mix_and_modes(rows):
    got = S.mix_languages(rows, "natural", ("de", "fr"), "doc_id", 1)
    assert sizes(got) == {"de": 10, "fr": 30}
    with pytest.raises(ValueError, match="unknown mix mode"):
        S.mix_languages(rows, "other", ("de",), "doc_id", 1)


@pytest.mark.parametrize("fraction,expected", [(0.3, {"de": 3, "en": 9, "fr": 9}), (0.001, {"de": 1, "en": 1, "fr": 1})])
def test_sample_sizes(rows, fraction, expected):
    assert sizes(S.sample_per_language(rows, ("de", "en", "fr"), ["doc_id"], fraction, 3)) == expected


def test_sample_edges(rows):
    assert S.sample_per_language(rows, ("de", "en", "fr"), ["doc_id"], 1.0, 3).count() == 70
    with pytest.raises(ValueError):
        S.sample_per_language(rows, ("de",), ["doc_id"], 0.0, 3)


def test_head(rows):
    got = S.head_per_language(rows, "doc_id", 2)
    assert sorted((r.language, r.doc_id) for r in got.collect()) == [
        ("de", 0), ("de", 4), ("en", 1), ("en", 2), ("fr", 100), ("fr", 101),
    ]
    assert S.head_per_language(rows, "doc_id", 0).count() == 70


@pytest.mark.parametrize("n", [1000, 1001])
def test_head_with_text_keys(spark, n):
    df = spark.range(2500).selectExpr("format_string('k%05d', id) AS doc_id", "IF(id % 5 = 0, 'a', 'b') AS language")
    got = S.head_per_language(df, "doc_id", n).collect()
    keys = {g: sorted(f"k{i:05d}" for i in range(2500) if (i % 5 == 0) == (g == "a"))[:n] for g in "ab"}
    assert sorted((r.language, r.doc_id) for r in got) == [(g, k) for g in "ab" for k in keys[g]]


def test_natural_mix_with_keys_that_repeat_over_languages(spark):
    df = spark.createDataFrame([(i, g) for g in ("de", "fr") for i in range(5)], "doc_id long, language string")
    got = S.mix_natural(df, ("de", "fr"), "doc_id", 3).collect()
    assert sorted(r.out_pos for r in got) == list(range(10)) and sizes(S.mix_natural(df, ("de", "fr"), "doc_id", 3)) == {"de": 5, "fr": 5}


def test_few_rows_with_many_draws_make_their_copies_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(S, "ROW_REPEATS", 1)
    monkeypatch.setattr(S, "SALT_CHUNK", 4)
    df = spark.createDataFrame([(0, "de")] + [(i, "fr") for i in range(40)], "doc_id long, language string")
    assert sizes(S.mix_balanced(df, ("de", "fr"), "doc_id", 3)) == {"de": 40, "fr": 40}


def test_drawn_numbers_are_not_broadcast(spark):
    df = spark.range(3000).selectExpr("id AS doc_id", "IF(id % 3 = 0, 'de', 'fr') AS language")
    mixed = S.mix_balanced(df, ("de", "fr"), "doc_id", 5)
    assert sizes(mixed) == {"de": 2000, "fr": 2000}
    plan = mixed._jdf.queryExecution().executedPlan().toString()  # as it ran
    joins = [line for line in plan.splitlines() if "Join" in line and "row_index" in line]
    assert joins and all("SortMergeJoin" in line for line in joins)


def test_numbers_are_made_by_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(S, "DRAW_CHUNK", 7)
    counts = spark.createDataFrame([("de", 300), ("fr", 5)], "language string, n long")
    made = S.draw_numbers(counts, "n", ["language"]).withColumn("task", F.spark_partition_id()).collect()
    assert sorted((r.language, r.draw) for r in made) == [("de", i) for i in range(300)] + [("fr", i) for i in range(5)]
    assert len({r.task for r in made}) > 1


@pytest.mark.parametrize("repeats,chunk", [(1 << 12, 1 << 16), (3, 7)])
def test_draws(spark, monkeypatch, repeats, chunk):
    monkeypatch.setattr(S, "ROW_REPEATS", repeats)
    monkeypatch.setattr(S, "DRAW_CHUNK", chunk)
    df = spark.createDataFrame([(10, "a"), (20, "b"), (30, "c")], "k long, v string")
    got = {r.draw: (r.k, r.v) for r in S.draw_with_replacement(df, "k", 50, 9).collect()}
    picks = spark.range(50).select("id", (seeded_draw(9, F.lit("draw"), F.col("id")) % 3).alias("i")).collect()
    assert got == {r.id: [(10, "a"), (20, "b"), (30, "c")][r.i] for r in picks}


def test_concat_keeps_duplicates(spark):
    a = spark.createDataFrame([(1,), (1,)], "x int")
    assert sorted(tuple(r) for r in S.concat([a, a]).collect()) == [(1, 0), (1, 0), (1, 1), (1, 1)]
