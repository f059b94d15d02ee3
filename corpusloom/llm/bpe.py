"""Byte-level BPE encoding and decoding with a shuffle of distinct words.

Texts are cut into pre-tokens by the vocabulary's pattern and held as positions
in their chunk's list of distinct pre-tokens (``chunks``). The lists go through
one shuffle by word hash, so every distinct word of the corpus meets in one task
and is encoded there once. Its ids go back to the chunks that asked, and each
text is put together again by position. Words travel in blocks, one row for each
chunk and hash bucket; a very frequent word is one entry per chunk.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from hashlib import sha256

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.llm.chunks import chunked, dealt, pack, pack_words, ragged, unpack, word_array
from corpusloom.llm.common import small_batches

BUCKETS = 64  # of the word hash, at least; a task holds the distinct words of one bucket, so there are more with more rows
ROWS_PER_BUCKET = 8192
LONG_TEXT = 1 << 20
SHORT_WORD = 48
TOKENS_AT_ONCE = 1 << 20
_NEVER = 1 << 62


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file: base64 token, blank, rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the pair of least rank is merged first, the leftmost of equal ones."""
    if word in ranks:
        return [ranks[word]]
    return _merge_short(word, ranks) if len(word) <= SHORT_WORD else _merge_long(word, ranks)


def _merge_short(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    parts = [word[i : i + 1] for i in range(len(word))]
    pairs = [ranks.get(word[i : i + 2], _NEVER) for i in range(len(word) - 1)]
    while pairs and (least := min(pairs)) < _NEVER:
        i = pairs.index(least)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i < len(pairs):
            pairs[i] = ranks.get(parts[i] + parts[i + 1], _NEVER)
        if i:
            pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], _NEVER)
    return [ranks[part] for part in parts]


def _merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same by a heap of candidate pairs, which keeps very long words at n log n.

    A candidate is (rank, start, end); it is stale if its span no longer holds
    two parts. The place behind a part that was merged into another is -1.
    """
    n = len(word)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2], _NEVER)) < _NEVER]
    heapq.heapify(heap)
    while heap:
        _, start, end = heapq.heappop(heap)
        middle = after[start]
        if not 0 <= middle < end or after[middle] != end:
            continue
        after[start], after[middle] = end, -1
        if end < n:
            before[end] = start
            if (r := ranks.get(word[start : after[end]], _NEVER)) < _NEVER:
                heapq.heappush(heap, (r, start, after[end]))
        if (left := before[start]) >= 0 and (r := ranks.get(word[left:end], _NEVER)) < _NEVER:
            heapq.heappush(heap, (r, left, end))
    ids, at = [], 0
    while at < n:
        ids.append(ranks[word[at : after[at]]])
        at = after[at]
    return ids


_BLANK = re.compile(r" (?=\S)")  # a blank that a visible character follows is the first of its pre-token
_ODD = re.compile(r" (?:\s|\Z)")


def segments(text: bytes) -> Iterable[str]:
    """A text cut at every blank that a visible character follows; the blanks go, the first segment gets one.

    Such a blank can only be the first character of a pre-token. So segments are
    independent, and the pattern has to run once for each distinct one.
    """
    decoded = text.decode("utf-8")
    return _cut(decoded, True) if len(decoded) <= LONG_TEXT else _cut_long(decoded)


def _cut(part: str, first: bool) -> list[str]:
    found = _BLANK.split(part) if _ODD.search(part) else part.split(" ")
    if first:
        found[0] = " " + found[0]
    return found


def _cut_long(decoded: str) -> Iterator[str]:
    """The same in parts, so that no list of all segments is made."""
    start = 0
    while start < len(decoded):
        cut = _BLANK.search(decoded, start + LONG_TEXT) if len(decoded) - start > LONG_TEXT else None
        yield from _cut(decoded[start : cut.start() if cut else len(decoded)], start == 0)
        start = cut.end() if cut else len(decoded)


def pre_tokens(pattern: str) -> Callable[[str], Sequence[bytes]]:
    """The pre-tokens of a segment: without its blank if it is a text's first, with one else."""
    find = regex.compile(pattern).findall

    def cut(segment: str) -> Sequence[bytes]:
        return [w.encode() for w in find(segment[1:] if segment.startswith(" ") else " " + segment)]

    return cut


def _deal_words(count: int) -> Callable:
    """The words of each chunk by hash bucket: ``(bucket, of_chunk, places, words)``."""

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                words = word_array(batch.column("words")[row].as_py()).to_pylist()
                _, order, buckets, starts = dealt(words, count)
                parts = np.split(order, starts[1:]) if len(order) else []
                columns = [
                    pa.array(buckets.astype(np.int32)), pa.array([batch.column("chunk")[row].as_py()] * len(parts), pa.int64()),
                    pa.array([pack(np.diff(p, prepend=0)) for p in parts], pa.binary()),
                    pa.array([pack_words([words[i] for i in p]) for p in parts], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["bucket", "of_chunk", "places", "words"])

    return deal


def _encode_words(ranks: dict[bytes, int]) -> Callable:
    """Encodes rows sorted by bucket; a word is encoded once, as all its rows are of one bucket."""

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, list[int]] = {}
        current = None
        for batch in batches:
            for row in range(batch.num_rows):
                if (bucket := batch.column("bucket")[row].as_py()) != current:
                    known, current = {}, bucket
                found = []
                for word in word_array(batch.column("words")[row].as_py()).to_pylist():
                    if (own := known.get(word)) is None:
                        known[word] = own = merge(word, ranks)
                    found.append(own)
                sizes = pack(np.fromiter(map(len, found), np.uint32, len(found)))
                ids = pack(np.fromiter((i for own in found for i in own), np.uint32))
                columns = [batch.column("of_chunk")[row : row + 1], batch.column("places")[row : row + 1], pa.array([sizes]), pa.array([ids])]
                yield pa.RecordBatch.from_arrays(columns, names=["of_chunk", "places", "sizes", "ids"])

    return encode


def _reassemble(chunks: pa.Table, found: pa.Table) -> pa.Table:
    """The ids of each document of a chunk, from its codes and the ids of its words; some 2^20 words at a time."""
    places = [np.cumsum(unpack(p)) for p in found.column("places").to_pylist()]
    sizes = [unpack(p) for p in found.column("sizes").to_pylist()]
    flat = [unpack(p).astype(np.int32) for p in found.column("ids").to_pylist()]
    order = np.argsort(np.concatenate(places)) if places else np.empty(0, np.int64)
    word_sizes = np.concatenate(sizes).astype(np.int64) if sizes else np.empty(0, np.int64)
    word_starts = (np.cumsum(word_sizes) - word_sizes)[order]
    word_sizes = word_sizes[order]
    word_ids = np.concatenate(flat) if flat else np.empty(0, np.int32)
    doc_ids, ids = [], []
    for row in range(chunks.num_rows):
        codes = unpack(chunks.column("codes")[row].as_py())
        bounds = np.concatenate([[0], np.cumsum(chunks.column("lengths")[row].values.to_numpy(), dtype=np.int64)])
        doc_ids.append(chunks.column("doc_ids")[row].values)
        low = 0
        while low < len(bounds) - 1:
            high = max(low + 1, int(np.searchsorted(bounds, bounds[low] + TOKENS_AT_ONCE, side="right")) - 1)
            own = codes[bounds[low] : bounds[high]]
            per_word = word_sizes[own]
            ends = np.concatenate([[0], np.cumsum(per_word)])[bounds[low : high + 1] - bounds[low]]
            tokens = word_ids[ragged(word_starts[own], per_word)]
            ids.append(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(tokens)))
            low = high
    return pa.table({"doc_id": pa.chunked_array(doc_ids, pa.int64()), "ids": pa.chunked_array(ids, pa.list_(pa.int32()))})


def encode(
    docs: DataFrame,
    ranks: dict[bytes, int],
    pattern: str,
    finish: Callable[[pa.Table], pa.Table] = lambda table: table,
    shape: str = "doc_id long, ids array<int>",
    buckets: int | None = None,
) -> DataFrame:
    """``(doc_id, ids)`` for every row of ``docs`` (doc_id, text; other columns are left alone).

    The ids are those of ordinary encoding, without special tokens. Null and
    empty texts have no ids; repeated rows and null document ids stay rows of
    their own; an empty table gives an empty result. ``finish`` may turn each
    Arrow table of results into one of another ``shape`` where it is made.
    Without a number of ``buckets`` the rows are counted, which of a stored
    table reads no data.
    """
    small_batches(docs.sparkSession)
    buckets = buckets or max(BUCKETS, docs.count() // ROWS_PER_BUCKET)
    # one shuffle of the chunks serves both: all columns go both ways, so that Spark can use it again
    chunks = chunked(docs, segments, pre_tokens(pattern)).repartition("chunk")
    words = chunks.mapInArrow(_deal_words(buckets), "bucket int, of_chunk long, places binary, words binary")
    met = words.repartition("bucket").sortWithinPartitions("bucket")
    found = met.mapInArrow(_encode_words(ranks), "of_chunk long, places binary, sizes binary, ids binary")

    def gather(chunks: pa.Table, found: pa.Table) -> pa.Table:
        return finish(_reassemble(chunks, found))

    return chunks.groupBy("chunk").cogroup(found.groupBy("of_chunk")).applyInArrow(gather, shape)


def token_table(ranks: dict[bytes, int]) -> list[bytes | None]:
    """The bytes of each token, by id."""
    by_id = {rank: token for token, rank in ranks.items()}
    return [by_id.get(i) for i in range(max(by_id) + 1)]


def _binaries(bounds: np.ndarray, data) -> pa.Array:
    offsets = pa.py_buffer(np.ascontiguousarray(bounds, np.int64).tobytes())
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, offsets, data])


def _ends(lists: pa.Array) -> np.ndarray:
    lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])


def decode_lists(ids: pa.Array, table: pa.Array) -> pa.Array:
    """The bytes of each list of ids: the ids joined with the token-byte table, whose bytes then lie one after the other."""
    taken = table.take(ids.flatten())
    if taken.null_count:
        raise ValueError("an id is not in the token table")
    offsets = np.frombuffer(taken.buffers()[1], np.int64)[taken.offset : taken.offset + len(taken) + 1]
    return _binaries(offsets[_ends(ids)], taken.buffers()[2])


def pack_lists(ids: pa.Array) -> pa.Array:
    """The ids of each list as little-endian unsigned 32-bit integers, one after the other."""
    data = np.ascontiguousarray(ids.flatten().to_numpy(zero_copy_only=False), "<u4")
    return _binaries(4 * _ends(ids), pa.py_buffer(data.tobytes()))


def decoded(ranks: dict[bytes, int]) -> Callable[[Column | str], Column]:
    """Column function ``ids -> bytes``. A null has no bytes; an id outside the table ends the job."""
    tokens = token_table(ranks)

    @F.arrow_udf("binary")
    def decode(ids: pa.Array) -> pa.Array:
        return decode_lists(ids, pa.array(tokens, pa.large_binary())).cast(pa.binary())

    return decode


DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def digests(ranks: dict[bytes, int], keep: Sequence[str] = ("doc_id", "ids")) -> Callable[[pa.Table], pa.Table]:
    """A ``finish`` for :func:`encode`: the columns ``keep`` and ``DIGESTS``, of the ids and of what they decode to."""
    tokens = token_table(ranks)

    def add(table: pa.Table) -> pa.Table:
        by_id, n, packed, plain = pa.array(tokens, pa.large_binary()), [], [], []
        for ids in table.column("ids").chunks:
            n += ids.value_lengths().to_pylist()
            packed += [sha256(v.as_buffer() or b"").hexdigest() for v in pack_lists(ids)]
            plain += [sha256(v.as_buffer() or b"").hexdigest() for v in decode_lists(ids, by_id)]
        kept = {c: table.column(c) for c in keep}
        return pa.table({**kept, "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(packed, pa.string()), "decoded_sha256": pa.array(plain, pa.string())})

    return add
