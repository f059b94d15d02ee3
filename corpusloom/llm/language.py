"""Language identification with string kernels.

A text is the set of its byte n-grams, n from 1 to 3 (the blended spectrum, by
presence), of which those count that the model knows. The kernel of two texts is
the number of n-grams they share, divided by the root of the product of their
set sizes. The Nyström method keeps a
bounded number of landmark texts; kernel ridge regression, one versus rest, is
solved in the space they span. As scores are linear in the kernel, they are
folded into one weight per n-gram and language, and a batch of texts is scored
by one matrix product of its presence matrix.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.llm.common import sample_texts, small_batches

NGRAMS = (1, 2, 3)
BASES = {1: 0, 2: 1 << 8, 3: (1 << 8) + (1 << 16)}  # where the codes of each length begin
CODES = (1 << 8) + (1 << 16) + (1 << 24)
UNKNOWN = "und"
BLOCK_BYTES = 1 << 22
TEXTS_AT_ONCE = 256
CELLS_AT_ONCE = 1 << 24  # of a presence matrix, whatever the number of n-grams


@dataclass
class KernelModel:
    """Fitted classifier: sorted n-gram codes, their weights per language, and the languages."""

    codes: np.ndarray
    weights: np.ndarray
    languages: tuple[str, ...]
    sharpness: float

    def places(self) -> np.ndarray:
        """Column of every possible n-gram; those that the model lacks share the last one."""
        place = np.full(CODES, len(self.codes), np.int32)
        place[self.codes] = np.arange(len(self.codes), dtype=np.int32)
        return place

    def scores(self, texts: Sequence[str], place: np.ndarray) -> np.ndarray:
        """Regression values, one row per text and one column per language."""
        presence = np.zeros((len(texts), len(self.codes) + 1), np.float32)
        for row, text in enumerate(texts):
            for codes in gram_blocks(text):
                presence[row, place[codes]] = 1
        presence = presence[:, :-1]
        sizes = np.maximum(presence.sum(axis=1, keepdims=True), 1)
        return (presence @ self.weights) / np.sqrt(sizes)


def gram_blocks(text: str) -> Iterator[np.ndarray]:
    """N-gram codes of the whole text, in blocks that overlap by the longest n-gram."""
    data = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)
    for start in range(0, max(len(data), 1), BLOCK_BYTES):
        code = part = data[start : start + BLOCK_BYTES + max(NGRAMS) - 1].astype(np.int32)
        made = []
        for n in NGRAMS:
            if len(part) < n:
                break
            if n > 1:
                code = (code[:-1] << 8) + part[n - 1 :]
            made.append(code + BASES[n])
        yield np.concatenate(made) if made else np.empty(0, np.int32)


def grams(text: str) -> np.ndarray:
    """The text's set of n-grams."""
    return np.unique(np.concatenate(list(gram_blocks(text))))


def presence_blocks(columns: Sequence[np.ndarray], width: int) -> Iterator[tuple[int, np.ndarray]]:
    """The presence matrix of texts given by their sorted columns, some columns at a time: the first of them and the part."""
    step = max(1, CELLS_AT_ONCE // max(len(columns), 1))
    for low in range(0, width, step):
        block = np.zeros((len(columns), min(step, width - low)), np.float32)
        for row, own in enumerate(columns):
            start, end = np.searchsorted(own, (low, low + step))
            block[row, own[start:end] - low] = 1
        yield low, block


def fit(texts: Sequence[str], languages: Sequence[str], landmarks: int = 400, ridge: float = 1e-2) -> KernelModel:
    """Kernel ridge regression on at most ``landmarks`` of the given texts.

    The n-grams are those of at least two given texts; all others are zero in
    every product with a landmark that shares none.
    """
    names = tuple(sorted(set(languages)))
    sets = [grams(t) for t in texts]
    codes, seen = np.unique(np.concatenate(sets), return_counts=True)
    codes = codes[seen >= min(2, len(sets))] if (seen >= 2).any() else codes
    columns = [np.searchsorted(codes, own[np.isin(own, codes, assume_unique=True)]) for own in sets]
    marked = columns[:landmarks]
    shared = np.zeros((len(columns), len(marked)))
    for low, block in presence_blocks(columns, len(codes)):
        shared += block @ block[: len(marked)].T
    roots = np.sqrt(np.maximum([len(own) for own in columns], 1))
    kernel = shared / np.outer(roots, roots[: len(marked)])
    # Nyström features: kernel to the landmarks times the inverse root of the landmarks' own kernel
    values, vectors = np.linalg.eigh(kernel[: len(marked)])
    usable = values > 1e-8 * values.max()
    basis = vectors[:, usable] / np.sqrt(values[usable])
    features = kernel @ basis
    wanted = np.array([[1.0 if lang == name else -1.0 for name in names] for lang in languages])
    # frequent and rare languages weigh alike
    share = {name: max(1, sum(lang == name for lang in languages)) for name in names}
    weight = np.array([1.0 / share[lang] for lang in languages])
    weight *= len(languages) / weight.sum()
    normal = features.T @ (features * weight[:, None]) + ridge * len(languages) * np.eye(features.shape[1])
    solved = np.linalg.solve(normal, features.T @ (wanted * weight[:, None]))
    per_mark = (basis @ solved) / roots[: len(marked), None]
    gram_weights = np.zeros((len(codes), len(names)), np.float32)
    for low, block in presence_blocks(marked, len(codes)):
        gram_weights[low : low + block.shape[1]] = block.T @ per_mark
    return KernelModel(codes, gram_weights, names, sharpness=4.0)


def learn(
    docs: DataFrame, trains: Column, per_language: int = 150, rows: int = 3000, landmarks: int = 400
) -> KernelModel | None:
    """Fit on a bounded sample: the first ``per_language`` rows of each language by a digest, ``rows`` in all.

    ``trains`` says which rows may be learned from. Rows with a null or empty
    text or a null language are left out; without any row there is no model.
    """
    known = docs.where(trains & (F.length("text") > 0)).select("doc_id", F.col("lang").alias("grp"))
    picked = sample_texts(docs, known, per_language, rows)
    if not picked:
        return None
    return fit([r["text"] for r in picked], [r["grp"] for r in picked], landmarks)


def lettered(text: str | None) -> bool:
    """Whether a text has a letter of any script."""
    return bool(text) and any(map(str.isalpha, text))


def with_letters(docs: DataFrame) -> DataFrame:
    """The rows whose text has a letter, with all columns."""
    small_batches(docs.sparkSession)

    @F.arrow_udf("boolean")
    def has(text: pa.Array) -> pa.Array:
        return pa.array([lettered(t) for t in text.to_pylist()], pa.bool_())

    return docs.where(has("text"))


def predict(
    model: KernelModel | None, texts: Sequence[str | None], place: np.ndarray | None = None
) -> tuple[list[str], np.ndarray]:
    """Language and score (0 to 1) of each text; ``und`` and 0 without a letter or without a model.

    ``place`` is the model's :meth:`KernelModel.places`, for callers with many batches.
    """
    names, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
    if model is None:
        return names, score
    usable = [i for i, t in enumerate(texts) if lettered(t)]
    place = model.places() if place is None else place
    step = min(TEXTS_AT_ONCE, max(1, CELLS_AT_ONCE // (len(model.codes) + 1)))
    for start in range(0, len(usable), step):
        part = usable[start : start + step]
        values = model.scores([texts[i] for i in part], place).astype(np.float64)
        soft = np.exp(model.sharpness * (values - values.max(axis=1, keepdims=True)))
        soft /= soft.sum(axis=1, keepdims=True)
        best = soft.argmax(axis=1)
        for row, i in enumerate(part):
            names[i], score[i] = model.languages[best[row]], soft[row, best[row]]
    return names, score


def identify(docs: DataFrame, model: KernelModel | None) -> DataFrame:
    """All columns of ``docs`` and ``__language`` (a struct of ``lang_pred`` and ``score``).

    Null and empty texts and texts without a letter are ``und`` with score 0;
    ties go to the language that sorts first; every row stays, repeated or not.
    """

    small_batches(docs.sparkSession)

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        place = model.places() if model else None  # once per task
        for text in batches:
            names, score = predict(model, text.to_pylist(), place)
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(score)], ["lang_pred", "score"])

    return docs.withColumn("__language", scored("text"))
