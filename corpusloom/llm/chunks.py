"""Documents as chunks: the distinct words of some megabytes of text, and each text as positions in that list.

Exploding a corpus into one row per word multiplies it. A chunk has one entry
per *distinct* word instead; what a join finds for these words reaches all their
positions through the codes. Chunks have a bounded size, so a word that occurs
everywhere has one entry per chunk and is combined before any shuffle. Lists of
words and numbers travel packed, at some two bytes a token.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame

SCHEMA = "chunk long, doc_ids array<long>, lengths array<int>, codes binary, words binary"
LEVEL = 3  # of the packing


class Numbers(dict):
    """Numbers words in the order in which they are first asked for."""

    def __missing__(self, word):
        self[word] = number = len(self)
        return number


def pack(numbers: np.ndarray, width: int = 4) -> bytes:
    """Unsigned numbers of ``width`` bytes, all low bytes first, so that small ones pack well."""
    planes = np.ascontiguousarray(numbers, f"<u{width}").reshape(-1, 1).view(np.uint8).T
    return zstandard.compress(planes.tobytes(), LEVEL)


def unpack(packed: bytes, width: int = 4) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(packed), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, -1).T).view(f"<u{width}").ravel()


def pack_words(words: Sequence[bytes]) -> bytes:
    lengths = pack(np.fromiter(map(len, words), np.uint32, len(words)))
    return len(lengths).to_bytes(4, "little") + lengths + zstandard.compress(b"".join(words), LEVEL)


def word_array(packed: bytes) -> pa.Array:
    """Packed words as an Arrow array of binaries."""
    head = 4 + int.from_bytes(packed[:4], "little")
    ends = np.cumsum(unpack(packed[4:head]), dtype=np.int64)
    data = pa.py_buffer(zstandard.decompress(packed[head:]))
    offsets = pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64).tobytes())
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, offsets, data])


def dealt(words: Sequence[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words dealt out by hash: the bucket of each, positions bucket by bucket, the buckets in use and where each starts."""
    hashes = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % buckets
    order = np.argsort(hashes, kind="stable")
    used, starts = np.unique(hashes[order], return_index=True)
    return hashes, order, used, starts


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions ``starts[i] .. starts[i] + sizes[i] - 1`` for each i, one after the other."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - sizes), sizes)


def chunked(
    docs: DataFrame,
    split: Callable[[bytes], Iterable],
    words_of: Callable[[object], Sequence[bytes]] | None = None,
    chunk_bytes: int = 1 << 23,
) -> DataFrame:
    """One row per chunk of ``docs`` (doc_id, text), of ``chunk_bytes`` of text or a little more.

    ``split`` cuts the UTF-8 bytes of a text (a null is empty) into hashable
    pieces, which are words themselves, or which ``words_of`` turns into words,
    once per chunk for each distinct piece. ``codes`` holds each document's
    words, in order, as positions in ``words``, the most frequent ones first;
    ``lengths`` says how many are each document's. A chunk's number is made of
    its task and its place there, so it is the same if a task runs again.
    """

    def row(serial: int, ids: list, pieces: list[np.ndarray], numbers: Numbers) -> pa.RecordBatch:
        codes = np.concatenate(pieces)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        words: Sequence[bytes] = list(numbers)
        if words_of:
            known = Numbers()
            made = [[known[w] for w in words_of(piece)] for piece in words]
            sizes = np.fromiter(map(len, made), np.int64, len(made))
            flat = np.fromiter((w for own in made for w in own), np.int64, int(sizes.sum()))
            bounds = np.concatenate([[0], np.cumsum(lengths)])
            covered = np.concatenate([[0], np.cumsum(sizes[codes])])
            codes, lengths = flat[ragged((np.cumsum(sizes) - sizes)[codes], sizes[codes])], np.diff(covered[bounds])
            words = list(known)
        order = np.argsort(-np.bincount(codes, minlength=len(words)), kind="stable")
        rank = np.empty(len(words), np.uint32)
        rank[order] = np.arange(len(words), dtype=np.uint32)
        columns = [
            pa.array([serial], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int32())),
            pa.array([pack(rank[codes])], pa.binary()), pa.array([pack_words([words[i] for i in order])], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["chunk", "doc_ids", "lengths", "codes", "words"])

    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial = TaskContext.get().partitionId() << 32
        ids, pieces, numbers, held = [], [], Numbers(), 0
        for batch in batches:
            keys = batch.column("doc_id").to_pylist()
            for key, value in zip(keys, batch.column("text").cast(pa.large_binary())):
                text = value.as_py() or b""
                pieces.append(np.fromiter(map(numbers.__getitem__, split(text)), np.uint32))
                ids.append(key)
                held += len(text) + 16
                if held >= chunk_bytes:
                    yield row(serial, ids, pieces, numbers)
                    serial += 1
                    ids, pieces, numbers, held = [], [], Numbers(), 0
        if ids:
            yield row(serial, ids, pieces, numbers)

    return docs.select("doc_id", "text").mapInArrow(make, SCHEMA)
