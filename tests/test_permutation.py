import pytest
from pyspark.sql import functions as F

from corpusloom.operators import sampling as S
from corpusloom.operators.permutation import permuted, unpermuted


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 7, 8, 9, 10, 97, 100, 1000, 4097])
def test_every_number_has_one_place_and_comes_back(spark, n):
    i, salt = F.col("id"), F.lit(3)
    placed = spark.range(n).select("id", permuted(i, n, 42).alias("p"), permuted(i, F.lit(n), 42, salt).alias("q"), permuted(i, n, 43).alias("r"))
    back = placed.select("*", unpermuted(F.col("p"), n, 42).alias("a"), unpermuted(F.col("q"), n, 42, salt).alias("b")).collect()
    for column in "pqr":
        assert sorted(r[column] for r in back) == list(range(n))
    assert all(r.a == r.id == r.b for r in back)
    if n > 90:
        orders = [tuple(r[c] for r in back) for c in ("id", "p", "q", "r")]
        assert len(set(orders)) == 4


def test_the_largest_range(spark):
    n = 9 * 10**18
    rows = spark.createDataFrame([(0,), (1,), (n - 1,), (n // 3,)], "id long")
    got = rows.select("id", permuted(F.col("id"), n, 5).alias("p")).withColumn("b", unpermuted(F.col("p"), n, 5)).collect()
    assert all(r.b == r.id and 0 <= r.p < n for r in got) and len({r.p for r in got}) == 4


def test_places_look_drawn(spark):
    """Neighbours move apart and halves mix: within five standard deviations of a random order."""
    n = 20_000
    got = [r.p for r in spark.range(n).select("id", permuted(F.col("id"), n, 7).alias("p")).orderBy("id").collect()]
    early = sum(p < n // 2 for p in got[: n // 2])
    assert abs(early - n / 4) < 5 * (n / 16) ** 0.5
    rising = sum(a < b for a, b in zip(got, got[1:]))
    assert abs(rising - n / 2) < 5 * (n / 12) ** 0.5
    fixed = sum(i == p for i, p in enumerate(got))
    assert fixed < 10


@pytest.mark.parametrize("index", ["-1", "10", "CAST(null AS bigint)"])
def test_numbers_outside_fail(spark, index):
    with pytest.raises(Exception, match="no place for number"):
        spark.range(1).select(permuted(F.expr(index), 10, 1)).collect()


def test_shuffles_sort_no_digests(spark):
    rows = spark.range(50).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "de").otherwise("fr").alias("language"))
    frames = (S.seeded_order(rows, 4, "doc_id"), S.mix_natural(rows, ("de", "fr"), "doc_id", 4), S.mix_balanced(rows, ("de", "fr"), "doc_id", 4))
    for df, n in zip(frames, (50, 50, 66)):
        assert "md5(concat_ws(:, 4, cast(doc_id" not in df._jdf.queryExecution().executedPlan().toString()
        assert sorted(r.out_pos for r in df.collect()) == list(range(n))
