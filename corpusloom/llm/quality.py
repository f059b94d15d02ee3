"""Document quality from raw bytes: a small convolutional network in numpy.

Bytes have learned vectors. Filters look at chunks of 16 bytes that overlap by
half and cover the whole text, up to its last byte. Each filter keeps its
greatest value over the text, and these maxima, through one hidden layer, give
one probability. Learning is plain back-propagation: of each filter only the
chunk with the maximum has a gradient.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.llm.common import raw, sample_texts, small_batches

VECTOR = 4  # numbers per byte
STRIDE = 8
CHUNK = 16
FILTERS = 32
HIDDEN = 16
PIECE = 1 << 20  # bytes that are looked at together; a long text's maxima are taken over its pieces


@dataclass
class Network:
    """The parameters, in the order in which learning updates them."""

    vectors: np.ndarray  # (256, VECTOR)
    filters: np.ndarray  # (CHUNK * VECTOR, FILTERS)
    shift: np.ndarray  # (FILTERS,)
    hidden: np.ndarray  # (FILTERS, HIDDEN)
    hidden_shift: np.ndarray  # (HIDDEN,)
    out: np.ndarray  # (HIDDEN + 1,), the constant last

    def parts(self) -> list[np.ndarray]:
        return [self.vectors, self.filters, self.shift, self.hidden, self.hidden_shift, self.out]

    def maxima(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Each filter's greatest value over the whole text, and the byte at which that chunk starts."""
        best, where = np.full(FILTERS, -np.inf, np.float32), np.zeros(FILTERS, np.int64)
        half = STRIDE * VECTOR
        for start, piece in pieces(text):
            rows = self.vectors[piece].reshape(-1, half)
            values = rows[:-1] @ self.filters[:half] + rows[1:] @ self.filters[half:]
            at = values.argmax(axis=0)
            top = values[at, np.arange(FILTERS)]
            better = top > best
            best, where = np.where(better, top, best), np.where(better, start + at * STRIDE, where)
        return best + self.shift, where

    def combined(self, maxima: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probability of quality 1 for rows of maxima, and the two layers before it."""
        first = np.tanh(maxima)
        second = np.tanh(first @ self.hidden + self.hidden_shift)
        return 1 / (1 + np.exp(-(second @ self.out[:-1] + self.out[-1]))), first, second

    def scores(self, texts: Iterator[bytes]) -> np.ndarray:
        rows = [self.maxima(t)[0] for t in texts]
        return self.combined(np.array(rows))[0].astype(np.float64) if rows else np.empty(0)


def pieces(text: bytes) -> Iterator[tuple[int, np.ndarray]]:
    """The text's bytes in pieces that overlap by half a chunk; the last is filled up with zeros to whole chunks."""
    data = np.frombuffer(text, np.uint8)
    for start in range(0, max(len(data), 1), PIECE):
        piece = data[start : start + PIECE + STRIDE]
        short = max(2 * STRIDE, -(-len(piece) // STRIDE) * STRIDE) - len(piece)
        yield start, np.concatenate([piece, np.zeros(short, np.uint8)]) if short else piece


def padded_chunk(text: bytes, start: int) -> np.ndarray:
    piece = np.frombuffer(text[start : start + CHUNK], np.uint8)
    return np.concatenate([piece, np.zeros(CHUNK - len(piece), np.uint8)])


def fit(
    texts: Sequence[bytes],
    labels: Sequence[int],
    rounds: int = 6,
    least_steps: int = 500,
    batch: int = 32,
    rate: float = 4e-3,
    seed: int = 5,
) -> Network:
    """Learn from texts and labels 0 or 1; both labels weigh alike. The seed fixes the result.

    Adam steps over batches: ``rounds`` times over all texts, more often if that is fewer than ``least_steps``.
    """
    rounds = max(rounds, -(-least_steps * batch // max(len(texts), 1)))
    rng = np.random.default_rng(seed)
    f32 = np.float32
    network = Network(
        rng.normal(0, 0.5, (256, VECTOR)).astype(f32), rng.normal(0, 0.15, (CHUNK * VECTOR, FILTERS)).astype(f32),
        np.full(FILTERS, -0.5, f32), rng.normal(0, 0.3, (FILTERS, HIDDEN)).astype(f32), np.zeros(HIDDEN, f32),
        rng.normal(0, 0.3, HIDDEN + 1).astype(f32),
    )
    target = np.array(labels, f32)
    share = target.mean() if len(target) else 0.5
    weight = np.where(target == 1, 0.5 / max(share, 1e-6), 0.5 / max(1 - share, 1e-6))
    means = [np.zeros_like(p) for p in network.parts()]
    squares = [np.zeros_like(p) for p in network.parts()]
    step, half = 0, STRIDE * VECTOR
    for _ in range(rounds):
        order = rng.permutation(len(texts))
        for low in range(0, len(order), batch):
            rows = order[low : low + batch]
            found = [network.maxima(texts[i]) for i in rows]
            chance, first, second = network.combined(np.array([m for m, _ in found]))
            error = ((chance - target[rows]) * weight[rows] / len(rows)).astype(f32)
            to_second = error[:, None] * network.out[:-1] * (1 - second**2)
            to_first = to_second @ network.hidden.T * (1 - first**2)
            slopes = [np.zeros_like(p) for p in network.parts()]
            slopes[5][:-1], slopes[5][-1] = second.T @ error, error.sum()
            slopes[4], slopes[3], slopes[2] = to_second.sum(axis=0), first.T @ to_second, to_first.sum(axis=0)
            for row, (_, where) in enumerate(found):
                chunks = np.array([padded_chunk(texts[rows[row]], at) for at in where])  # (FILTERS, CHUNK)
                seen = network.vectors[chunks].reshape(FILTERS, 2 * half)
                slopes[1] += (seen * to_first[row][:, None]).T
                back = (network.filters.T * to_first[row][:, None]).reshape(FILTERS * CHUNK, VECTOR)
                np.add.at(slopes[0], chunks.ravel(), back)
            step += 1
            for part, slope, mean, square in zip(network.parts(), slopes, means, squares):
                mean += 0.1 * (slope - mean)
                square += 0.001 * (slope**2 - square)
                part -= rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return network


def learn(docs: DataFrame, labels: DataFrame, trains: Column, per_label: int = 1500) -> Network | None:
    """Fit on at most ``per_label`` whole texts of each label that ``trains`` (a test on doc_id) allows.

    Labels other than 0 and 1 are left out; an id with both counts as what its
    mean rounds to. Without texts of both labels there is no network.
    """
    marked = labels.where(trains & F.col("quality").isin(0, 1)).groupBy("doc_id")
    marked = marked.agg(F.when(F.avg("quality") >= 0.5, 1).otherwise(0).alias("grp"))
    marked = marked.join(docs.where(F.length("text") > 0).select("doc_id"), "doc_id", "left_semi")
    picked = sample_texts(docs, marked, per_label, 2 * per_label)
    if len({r["grp"] for r in picked}) < 2:
        return None
    return fit([r["text"].encode() for r in picked], [int(r["grp"]) for r in picked])


def score(docs: DataFrame, network: Network | None) -> DataFrame:
    """All columns of ``docs`` and ``__quality``, the probability that the text's label is 1.

    Null and empty texts are a chunk of zeros and get a score too; repeated rows
    score alike; without a network every score is 0.5; an empty table stays empty.
    """

    small_batches(docs.sparkSession)

    @F.arrow_udf("double")
    def scored(column: pa.Array) -> pa.Array:
        if network is None:
            return pa.array([0.5] * len(column), pa.float64())
        return pa.array(network.scores(raw(column)), pa.float64())

    return docs.withColumn("__quality", scored("text"))
