import numpy as np
import pyarrow as pa

from corpusloom.operators import overlap as O


def sides(n):
    left = [[f"w{(i * j) % 5}" for j in range(i % 9)] for i in range(n)]
    return pa.array(left, pa.list_(pa.string())), pa.array([row[::2] if i % 4 else None for i, row in enumerate(left)], pa.list_(pa.string()))


def test_spans_hold_all_rows_and_a_bounded_number_of_words():
    p, r = sides(300)
    spans = O.row_spans(p, r, 40)
    assert [i for a, b in spans for i in range(a, b)] == list(range(300))
    words = [sum(len(s or []) for side in (p, r) for s in side.slice(a, b - a).to_pylist()) for a, b in spans]
    assert len(spans) > 20 and max(words) <= 40 + 13  # a span ends with the row that fills it
    assert O.row_spans(p.slice(0, 0), r.slice(0, 0)) == []


def test_spans_count_what_the_whole_batch_counts():
    p, r = sides(300)
    whole = O.clipped_counts(p, r, (1, 2, 3))
    parts = [O.clipped_counts(p.slice(a, b - a), r.slice(a, b - a), (1, 2, 3)) for a, b in O.row_spans(p, r, 40)]
    for expected, got in zip(whole, zip(*parts)):
        assert np.concatenate(got).tolist() == expected.tolist()
