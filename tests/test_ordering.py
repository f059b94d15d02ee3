import hashlib
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import ordering as O


def brute(data, op):
    """Exclusive running value per group, row by row."""
    out, state = {}, {}
    for group, key, value in sorted(data, key=lambda r: (str(r[0]), r[1])):
        seen = state.setdefault(group, [])
        out[(group, key)] = (sum(seen) if op == "sum" else (min(seen) if seen else None))
        seen.append(value)
    return out


@pytest.mark.parametrize("op", ["sum", "min"])
def test_running_matches_brute_force(spark, op):
    rng = random.Random(5)
    keys = rng.sample(range(1 << 21), 300) + [0, (1 << 63) - 1]
    # one group owns most rows, one is null
    data = [(rng.choice(["a", "a", "a", "b", None]), k, rng.randrange(1000)) for k in keys]
    df = spark.createDataFrame(data, "g string, k long, v long")
    got = O.running(df, "before", F.col("v"), [F.col("k")], O.id_buckets(F.col("k")), ["g"], op)
    assert {(r.g, r.k): r.before for r in got.collect()} == brute(data, op)
    assert got.columns == ["g", "k", "v", "before"]


def test_several_levels_agree(spark):
    keys = random.Random(1).sample(range(1 << 30), 200)
    df = spark.createDataFrame([(k, k % 7) for k in keys], "k long, v long")
    one = O.running(df, "s", F.col("v"), [F.col("k")], O.id_buckets(F.col("k")))
    three = O.running(df, "s", F.col("v"), [F.col("k")], O.id_buckets(F.col("k"), (25, 15, 4)))
    assert sorted(one.collect()) == sorted(three.collect())


def test_key_out_of_range_fails(spark):
    for bad in (-1, None):
        df = spark.createDataFrame([(bad,)], "k long")
        with pytest.raises(Exception, match="ordering key below 0"):
            O.row_index(df, "k").collect()


def test_shuffle_order_is_the_digest_order(spark):
    df = spark.range(500).repartition(3)
    got = {r.id: r.out_pos for r in O.shuffled_index(df, 7, ["id"]).collect()}
    expected = sorted(range(500), key=lambda i: (hashlib.md5(f"7:{i}".encode()).hexdigest(), i))
    assert got == {k: i for i, k in enumerate(expected)}


def test_time_order_with_one_hot_timestamp(spark):
    rng = random.Random(3)
    data = [(1_700_000_000_000_000 if rng.random() < 0.4 else rng.randrange(1 << 50), i) for i in range(400)]
    df = spark.createDataFrame(data, "us long, id long").withColumn("ts", F.timestamp_micros("us"))
    buckets = O.time_buckets(F.col("ts"), F.col("id"))
    got = O.running(df, "n", F.lit(1).cast("long"), [F.col("ts"), F.col("id")], buckets)
    expected = {k: i for i, k in enumerate(sorted(data))}
    assert {(r.us, r.id): r.n for r in got.collect()} == expected
