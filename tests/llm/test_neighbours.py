import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, k, every):
    """Whole answer by comparing everything."""
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if v is not None and None not in v]
    good = [(i, v) for i, v in good if np.isfinite(v).all() and v.any()]
    out = []
    for q, a in good:
        if q % every == 0:
            others = sorted((-float((b * a).sum()), i) for i, b in good if i != q)[:k]
            out += [(q, rank, i, -s) for rank, (s, i) in enumerate(others, 1)]
    return sorted(out)


def clustered(n, seed=1, size=12):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, size))
    made = [(i, (centres[i % 12] + 0.1 * rng.normal(size=size)).astype(np.float32).tolist()) for i in range(n)]
    return made


def answer(spark, rows, every=10, **more):
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("asks", F.lit("clash")).withColumn("v", F.lit(1))
    return neighbours.nearest(frame, F.col("vec_id") % every == 0, **more)


def check(spark, rows, k=5, every=10):
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in answer(spark, rows, every, k=k).collect())
    expected = brute(rows, k, every)
    assert [g[:3] for g in got] == [e[:3] for e in expected]
    assert np.allclose([g[3] for g in got], [e[3] for e in expected], rtol=0, atol=1e-12)


@pytest.fixture
def small_windows(monkeypatch):
    monkeypatch.setattr(neighbours, "WINDOW", 32)
    monkeypatch.setattr(neighbours, "GROUP", 2)
    monkeypatch.setattr(neighbours, "GROUPS_AT_ONCE", 3)


def test_clusters_equal_brute_force(spark, small_windows):
    check(spark, clustered(500))


def test_vectors_without_structure_equal_brute_force(spark, small_windows):
    rng = np.random.default_rng(2)
    check(spark, [(i, rng.normal(size=10).astype(np.float32).tolist()) for i in range(300)])


def test_copies_and_ties_go_to_the_smaller_id(spark, small_windows):
    rows = clustered(200) + [(1000 + i, clustered(1)[0][1]) for i in range(150)]
    check(spark, rows)


def test_rows_that_take_no_part(spark):
    odd = [(500, None), (510, [0.0] * 12), (520, [1.0] * 11 + [None]), (530, [float("nan")] * 12), (540, [float("inf")] + [0.0] * 11), (550, [-0.0] * 12)]
    check(spark, clustered(60) + odd)
    short = [(r.query_id, r.vec_id) for r in answer(spark, clustered(60) + [(600, [1.0])]).collect()]
    assert all(600 not in pair for pair in short)


def test_few_and_no_rows(spark):
    check(spark, clustered(4))
    check(spark, clustered(1))
    assert answer(spark, []).count() == 0
    assert answer(spark, [(1, [1.0, 2.0]), (3, [1.0, 1.0])]).count() == 0


def test_repeated_rows_count_once(spark):
    rows = clustered(40)
    got = answer(spark, rows + rows[:20], k=5).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got) == [e[:3] for e in brute(rows, 5, 10)]


def test_windows_alone_reach_most_neighbours_in_clusters(spark, small_windows):
    rows = clustered(600)
    got = {(r.query_id, r.vec_id) for r in answer(spark, rows, k=5, exact=False).collect()}
    expected = {(q, i) for q, _, i, _ in brute(rows, 5, 10)}
    assert len(got & expected) / len(expected) >= 0.9


def test_neighbours_on_the_curve_are_neighbours_in_space():
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), axis=-1).reshape(-1, 3)
    keys = neighbours.hilbert_keys(cells, 3)
    assert sorted(keys) == list(range(512))
    assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize("size", [12, 64])
def test_ties_of_distinct_vectors_go_to_the_smaller_id(spark, size):
    rng = np.random.default_rng(4)
    signs = np.unique(rng.choice([-1.0, 1.0], size=(700, size)), axis=0)
    rows = [(int(i), v.tolist()) for i, v in zip(rng.permutation(len(signs)), signs)]
    check(spark, rows, k=20)
