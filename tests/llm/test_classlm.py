import math
import random
from collections import Counter

import numpy as np
import pytest

from corpusloom.llm import classlm
from corpusloom.llm.queries import learned_from as trains


def corpus(n=250, seed=4):
    """Two kinds of sentences with their own word classes."""
    rng = random.Random(seed)
    nouns, verbs = [f"N{i}" for i in range(40)], [f"v{i}é" for i in range(40)]
    other = [f"z{i}" for i in range(60)]
    rows = []
    for i in range(n):
        if i % 2:
            words = [w for _ in range(rng.randrange(3, 12)) for w in ("the", rng.choice(nouns), rng.choice(verbs))]
        else:
            words = [rng.choice(other) for _ in range(rng.randrange(5, 30))]
        rows.append((i, " ".join(words) + ("\n" if i % 7 else "\t zz" + str(i))))
    return rows + [(1000, None), (1001, ""), (1002, "\x0b\x0c"), (1003, "unseen word here"), (None, "the n1"), (5, "the N2 v2é")]


def plain(rows):
    split = lambda t: [*(t or "").encode().lower().split(), b"\n"]
    counts = Counter(w for i, t in rows if trains(i) for w in split(t))
    total, kinds = sum(counts.values()), len(counts)
    out = []
    for i, t in rows:
        words = split(t)
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in words)
        out.append((i or -1, len(words), sum(counts[w] > 0 for w in words), total, round(base, 6)))
    return sorted(out)


def got(spark, rows, **more):
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS n", "0 AS word")
    return classlm.scored(docs, trains, **more).collect()


@pytest.mark.parametrize("size", [300, 1 << 20])
def test_base_equals_brute_force_and_classes_beat_it(spark, monkeypatch, size):
    monkeypatch.setattr(classlm, "CHUNK_BYTES", size)
    rows = corpus()
    found = got(spark, rows, head=30, classes=6)
    assert sorted((r.doc_id or -1, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found) == plain(rows)
    held = [r for r in found if not trains(r.doc_id)]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def plain_scores(rows, classes):
    """Score of every text, word by word with dictionaries; all training words are in the head."""
    split = lambda t: [*(t or "").encode().lower().split(), b"\n"]
    learned = [split(t) for i, t in rows if trains(i)]
    counts = Counter(w for words in learned for w in words)
    listed = sorted((w for w in counts if w != b"\n"), key=lambda w: (-counts[w], w)) + [b"\n"]
    number = {w: i for i, w in enumerate(listed)}
    pairs = np.zeros((len(listed) + 1, len(listed) + 1), np.int64)
    for words in learned:
        for a, b in zip([b"\n", *words], words):
            pairs[number[a], number[b]] += 1
    of = dict(zip(listed, classlm.exchange(pairs, classes)[0].tolist()))
    mass, kinds, moves = Counter(), Counter(), Counter()
    for w, n in counts.items():
        mass[of[w]] += n
        kinds[of[w]] += 1
    for words in learned:
        moves.update(zip([of[w] for w in [b"\n", *words]], [of[w] for w in words]))
    once, twice = (sum(n == k for n in counts.values()) for k in (1, 2))
    discount, total = once / (once + 2 * twice), sum(mass.values())

    def chance(before, c):
        seen = sum(moves[before, x] for x in mass) if before is not None else 0
        return ((moves[before, c] if before is not None else 0) + classlm.PRIOR * mass[c] / total) / (seen + classlm.PRIOR)

    out = {}
    for i, t in rows:
        score, before = 0.0, of[b"\n"]
        for w in split(t):
            if w in counts:
                score += math.log10(chance(before, of[w]) * (counts[w] - discount) / mass[of[w]])
                before = of[w]
            else:
                score += math.log10(sum(chance(before, c) * discount * kinds[c] / mass[c] for c in mass))
                before = None
        out[i] = score
    return out


def test_scores_equal_brute_force(spark):
    rows = [r for r in corpus(80) if r[1] is None or "N2 v2" not in r[1]]
    found = {r.doc_id: r.score for r in got(spark, rows, head=1000, classes=5)}
    expected = plain_scores(rows, 5)
    assert found.keys() == expected.keys() and all(found[i] == pytest.approx(expected[i], abs=1e-8) for i in found)


def test_chunks_do_not_change_scores(spark, monkeypatch):
    rows = corpus(60)
    one = sorted((r.doc_id or -1, round(r.score, 8)) for r in got(spark, rows, head=20, classes=4))
    monkeypatch.setattr(classlm, "CHUNK_BYTES", 200)
    assert sorted((r.doc_id or -1, round(r.score, 8)) for r in got(spark, rows, head=20, classes=4)) == one


def test_probabilities_sum_to_one():
    model = classlm.Model(np.array([30, 12, 8]), 0.6, np.array([5, 3, 1]), np.array([[3, 2, 1], [0, 4, 2], [5, 5, 0]]))
    words = [(c, n) for c, ns in enumerate([[10, 9, 8, 2, 1], [6, 4, 2], [8]]) for n in ns]
    steps = model.steps()
    for before in range(4):
        known = sum(10 ** (steps[before, c] + model.emission(np.array([n]), np.array([c]))[0]) for c, n in words)
        assert known + 10 ** steps[before, 3] == pytest.approx(1)


def likelihood(pairs, of, total):
    member = np.eye(total)[of]
    table = member.T @ pairs @ member
    return classlm._phi(table).sum() - classlm._phi(table.sum(axis=0)).sum() - classlm._phi(table.sum(axis=1)).sum()


def test_exchange_moves_raise_the_likelihood_to_a_maximum():
    rng = np.random.default_rng(6)
    pairs = rng.poisson(0.3 + 6.0 * (np.add.outer(np.arange(14), np.arange(14)) % 3 == 1)).astype(float)
    start, _ = classlm.exchange(pairs, 4, rounds=0)
    of, table = classlm.exchange(pairs, 4, rounds=30)
    best = likelihood(pairs, of, 6)
    assert best > likelihood(pairs, start, 6)
    member = np.eye(6)[of]
    assert np.allclose(table, member.T @ pairs @ member)
    for w in range(12):
        for c in range(4):
            other = of.copy()
            other[w] = c
            assert likelihood(pairs, other, 6) <= best + 1e-6


def test_nothing_to_learn_from_and_no_rows(spark):
    lone = next(i for i in range(100) if not trains(i))
    r = got(spark, [(lone, "a b")])[0]
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (3, 0, 0, 0.0, 0.0)
    assert got(spark, []) == []
