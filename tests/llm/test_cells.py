import numpy as np
import pyarrow as pa
import pytest

from corpusloom.llm import cells

SHAPE = "vec_id long, label int, embedding array<float>, point string, times int"


def takes_part(row):
    i, label, v = row
    return i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)


def brute(rows, link=cells.LINK):
    """All pairs of equal label and length."""
    linked = [set() for _ in rows]
    groups = {}
    for n, row in enumerate(rows):
        if takes_part(row):
            groups.setdefault((row[1], len(row[2])), []).append(n)
    for members in groups.values():
        unit = np.array([np.array(rows[n][2], np.float32) for n in members], float)
        unit /= np.abs(unit).max(axis=1)[:, None]
        unit /= np.linalg.norm(unit, axis=1)[:, None]
        for a, b in zip(*np.nonzero(unit @ unit.T >= link)):
            if a != b:
                linked[members[a]].add(members[b])
    least = {row[0]: row[0] for row in rows}
    moved = True
    while moved:
        moved = False
        for n, row in enumerate(rows):
            for m in linked[n]:
                low = min(least[row[0]], least[rows[m][0]])
                for i in (row[0], rows[m][0]):
                    moved |= least[i] != low
                    least[i] = low
    return [(r[0], len(linked[n]), least[r[0]], r[0] is None or r[0] == least[r[0]]) for n, r in enumerate(rows)]


def clustered(seed, groups, of, size=16, noise=0.03):
    rng = np.random.default_rng(seed)
    made = []
    for g in range(groups):
        centre = rng.normal(size=size)
        for _ in range(of if g else 6 * of):
            made.append(centre / np.linalg.norm(centre) + noise * rng.normal(size=size))
    return [(int(i), int(rng.integers(2)), np.array(v, np.float32).tolist()) for i, v in enumerate(np.array(made)[rng.permutation(len(made))])]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 3) for r in rows], SHAPE).repartition(5)


def answer(spark, rows, **bounds):
    return sorted(map(repr, map(tuple, cells.near_duplicates(frame(spark, rows), **bounds).collect())))


@pytest.mark.parametrize("bounds", [{}, {"cell": 16, "block": 10}, {"cell": 4, "block": 1000}, {"cell": 40, "block": 64, "sample": 30}])
def test_no_link_is_lost(spark, bounds):
    rows = clustered(3, 25, 12)
    assert answer(spark, rows, **bounds) == sorted(map(repr, brute(rows)))


def test_links_across_many_cells(spark):
    """A chain of directions a little apart: cells cut it everywhere, and the plane's distance finds each link."""
    turns = np.arange(400) * 0.15
    rows = [(i, 1, [float(np.cos(t)), float(np.sin(t)), 0.01]) for i, t in enumerate(turns[:40])]
    rows += [(1000 + i, 2, [float(np.cos(t)), float(np.sin(t))]) for i, t in enumerate(turns * 0.1)]
    assert answer(spark, rows, cell=4, block=16) == sorted(map(repr, brute(rows)))


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    base = [0.5, 1.0, -2.0]
    rows = [
        (1, 1, base), (2, 1, base), (3, 1, [x * 1e-30 for x in base]), (4, 2, base), (5, None, base), (6, 1, None), (7, 1, []),
        (8, 1, [0.0, 0.0, 0.0]), (9, 1, [nan, 1.0, 1.0]), (10, 1, [inf, 1.0, 1.0]), (11, 1, [1.0, None, 1.0]), (12, 1, [-x for x in base]),
        (13, 1, [1.0, -2.0]), (14, 1, [2.0, -4.0]), (15, 1, [0.5, 1.0, -2.0, 0.0]), (16, 1, [1e30, 2e30, -4e30]), (None, 1, base), (None, 3, base),
        (17, 5, [0.0, 1.0]), (18, 5, [-0.0, 1.0]),
    ]
    assert answer(spark, rows) == sorted(map(repr, brute(rows)))


def test_rows_that_share_an_id(spark):
    rows = [(1, 1, [1.0, 0.0]), (1, 1, [1.0, 0.0]), (2, 1, [1.0, 0.01]), (2, 1, [0.0, 1.0]), (3, 1, [0.01, 1.0])]
    assert answer(spark, rows) == sorted(map(repr, brute(rows)))
    kept = cells.keep_one(frame(spark, rows + [(None, 1, [1.0, 0.0])])).collect()
    assert sorted(str(r.vec_id) for r in kept) == ["1", "None"]


def test_a_vector_that_fills_a_third(spark):
    rows = clustered(5, 10, 10) + [(10_000 + i, 1, [1.0] * 16) for i in range(300)]
    assert answer(spark, rows) == sorted(map(repr, brute(rows)))


def test_empty_table(spark):
    assert answer(spark, []) == []


def test_unit_centres():
    rng = np.random.default_rng(0)
    sample = rng.normal(size=(200, 5))
    sample /= np.linalg.norm(sample, axis=1)[:, None]
    centres = cells.spherical_means(sample, 7)
    assert centres.shape == (7, 5) and np.allclose((centres**2).sum(axis=1), 1)
    assert len(cells.spherical_means(sample[:3], 7)) == 3
    assert cells.matrix(pa.array([[1.0, 2.0, 3.0], [4.0]]), 2).tolist() == [[1.0, 2.0], [4.0, 0.0]]
