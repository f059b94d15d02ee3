import random

import numpy as np
from pyspark.sql import functions as F

from corpusloom.llm import quality


def made(n, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7))) for _ in range(rng.randrange(20, 60))]
        good = i % 3 != 0
        rows.append((i, " ".join(words) + "." if good else " ".join(w + rng.choice(["***", "%%%"]) for w in words), int(good)))
    return rows


def test_held_out_accuracy(spark):
    rows = made(400)
    odd = [(1000, None), (1001, ""), (1002, "x"), (1003, "abc def " * 300_000), (None, "abc. def.")]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + odd + [rows[0][:2]], "doc_id long, text string")
    docs = docs.withColumn("quality", F.lit("clash"))
    marks = [(i, q) for i, _, q in rows] + [(1, None), (2, 7), (3, 0), (9999, 1)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int")
    network = quality.learn(docs, labels, F.col("doc_id") % 5 != 0, per_label=150)
    got = quality.score(docs, network).select("doc_id", "text", "__quality").collect()
    assert len(got) == 406
    assert all(0 <= r[2] <= 1 for r in got)
    truth = {i: q for i, _, q in rows}
    held = [(r[2] >= 0.3) == truth[r[0]] for r in got if r[0] is not None and r[0] < 400 and r[0] % 5 == 0]
    assert np.mean(held) >= 0.95
    assert next(r[2] for r in got if r[0] == 1000) == next(r[2] for r in got if r[0] == 1001)


def test_the_last_byte_counts_and_pieces_change_nothing(monkeypatch):
    network = quality.fit([b"aaaa aaaa", b"aaaa*aaaa"] * 8, [1, 0] * 8, rounds=3, least_steps=0)
    text = bytes(random.Random(1).choices(range(256), k=5003))
    whole, where = network.maxima(text)
    chunks = np.array([quality.padded_chunk(text, s) for s in range(0, len(text) - quality.STRIDE + 8, quality.STRIDE)])
    values = network.vectors[chunks].reshape(len(chunks), -1) @ network.filters + network.shift
    assert np.allclose(values.max(axis=0), whole, atol=1e-4)
    monkeypatch.setattr(quality, "PIECE", 64)
    assert np.allclose(network.maxima(text)[0], whole, atol=1e-4)
    starts = {s for s, _ in quality.pieces(text)}
    assert max(starts) + 64 >= len(text)


def test_gradient_lowers_the_loss():
    texts, labels = [t.encode() for _, t, _ in made(60)], [q for *_, q in made(60)]
    loss = lambda n: -np.mean([np.log(p if q else 1 - p) for p, q in zip(n.scores(texts), labels)])
    assert loss(quality.fit(texts, labels, rounds=8, least_steps=0)) < 0.6 * loss(quality.fit(texts, labels, rounds=0, least_steps=0))


def test_without_both_labels_and_without_rows(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    network = quality.learn(docs, labels, F.lit(True))
    assert network is None
    assert [r[0] for r in quality.score(docs, network).select("__quality").collect()] == [0.5, 0.5]
    assert quality.score(docs.limit(0), network).count() == 0


def test_labels_of_empty_or_absent_texts_take_no_places(spark):
    rows = [(i, "" if i % 2 else None) for i in range(400)] + [(1000 + i, "good plain words here" if i % 2 else "%%% ### ***") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows] + [(5000 + i, i % 2) for i in range(300)], "doc_id long, quality int")
    assert quality.learn(docs, labels, F.lit(True), per_label=10) is not None
