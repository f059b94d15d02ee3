"""Ranked lexical search with Block-Max MaxScore over compressed shards.

``build_index`` turns documents into shards: some megabytes of text each, with a
list of postings per term, cut into blocks that are packed one by one. A
block's greatest term frequency and least document length are kept beside it,
so that a bound of its scores is known for any collection statistics without
opening it.

``search`` weighs the terms of a bounded block of queries by their counts over
all shards and scores every shard on its own. A query's lists go from the
greatest global bound to the least. Once the lists that are left cannot lift a
new document to the k-th best score so far, they are not essential: documents
that no earlier list holds are out, and of the others only those stay whose
score, with the maxima of the blocks that may hold them, still reaches that
score. Only the blocks of these are opened. The heaps of all tasks are merged.

The scores are integers, and a bound that equals the k-th score is kept, so the
result is that of scoring everything.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from corpusloom.llm.chunks import Numbers, pack, pack_words, ragged, unpack, word_array
from corpusloom.llm.common import raw, small_batches
from corpusloom.session import staged

K = 10
SHARD_BYTES = 1 << 24  # text in a shard
BLOCK = 128  # postings in a block
QUERY_BYTES = 1 << 22  # text of the queries that are answered together

# Fixed values of the score.
SCALE, FREQUENCY, LENGTH = 1_000_000_000, 1000, 8
LENGTH_SHARE, WEIGHT_SCALE = 90, 1000

#: Every byte that is no part of a term becomes a blank, A-Z becomes lower case.
TERM_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)

INDEX = (
    "doc_ids array<long>, lengths binary, terms binary, counts binary, firsts binary, lasts binary, "
    "tops binary, shortest binary, widths binary, postings binary, n_docs long, n_terms long"
)


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(TERM_BYTES).split()


def widths_of(greatest: np.ndarray) -> np.ndarray:
    """Bytes that numbers up to these need: 0 (all are zero), 1, 2 or 4."""
    return np.select([greatest == 0, greatest < 1 << 8, greatest < 1 << 16], [0, 1, 2], 4)


def packed_blocks(starts: np.ndarray, ends: np.ndarray, documents: np.ndarray, frequencies: np.ndarray) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Each block's distances from its first document, then its frequencies less one, in as few bytes each as it needs.

    Returns a code of both widths and the place of each block, and the bytes of all.
    """
    sizes = ends - starts
    distances = documents - np.repeat(documents[starts], sizes)
    columns = (distances, frequencies - 1)
    widths = [widths_of(np.maximum.reduceat(c, starts)) if len(starts) else np.empty(0, np.int64) for c in columns]
    room = sizes * (widths[0] + widths[1])
    places = np.concatenate([[0], np.cumsum(room)])
    out = np.zeros(int(places[-1]), np.uint8)
    within = np.arange(len(documents)) - np.repeat(starts, sizes)
    for column, width, base in zip(columns, widths, (places[:-1], places[:-1] + sizes * widths[0])):
        of_posting, at = np.repeat(width, sizes), np.repeat(base, sizes)
        for w in (1, 2, 4):
            some = np.flatnonzero(of_posting == w)
            spot = at[some] + w * within[some]
            data = column[some].astype(f"<u{w}").view(np.uint8).reshape(-1, w)
            out[spot[:, None] + np.arange(w)] = data
    return widths[0] * 8 + widths[1], places[:-1], out.tobytes()


def open_block(data: bytes, place: int, code: int, first: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents and frequencies of the block at ``place``."""

    def numbers(width: int, at: int) -> np.ndarray:
        return np.frombuffer(data, f"<u{width}", size, at).astype(np.int64) if width else np.zeros(size, np.int64)

    return numbers(code // 8, place) + first, numbers(code % 8, place + size * (code // 8)) + 1


def shard_row(ids: list, pieces: list[np.ndarray], numbers: Numbers) -> pa.RecordBatch:
    """The index of some documents, given as term numbers."""
    n_docs = len(ids)
    lengths = np.fromiter(map(len, pieces), np.int64, n_docs)
    words = list(numbers)
    codes = np.concatenate(pieces).astype(np.int64) if pieces else np.empty(0, np.int64)
    keys = codes * n_docs + np.repeat(np.arange(n_docs), lengths)
    keys, frequency = np.unique(keys, return_counts=True)
    term, document = keys // max(n_docs, 1), keys % max(n_docs, 1)
    counts = np.bincount(term, minlength=len(words))
    blocks_of = -(-counts // BLOCK)
    starts = np.repeat(np.cumsum(counts) - counts, blocks_of) + ragged(np.zeros(len(words), np.int64), blocks_of) * BLOCK
    ends = np.minimum(starts + BLOCK, np.repeat(np.cumsum(counts), blocks_of))
    reduce = lambda f, x: f.reduceat(x, starts) if len(starts) else np.empty(0, np.int64)
    codes, places, data = packed_blocks(starts, ends, document, frequency)
    columns = [
        pa.array([ids], pa.list_(pa.int64())), pa.array([pack(lengths)]), pa.array([pack_words(words)]), pa.array([pack(counts)]),
        pa.array([pack(document[starts])]), pa.array([pack(document[ends - 1])]), pa.array([pack(reduce(np.maximum, frequency))]),
        pa.array([pack(reduce(np.minimum, lengths[document]))]), pa.array([pack(codes, 1)]), pa.array([data], pa.binary()),
        pa.array([int((lengths > 0).sum())], pa.int64()), pa.array([int(lengths.sum())], pa.int64()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=[part.split()[0] for part in INDEX.split(", ")])


def build_index(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per shard, columns as in ``INDEX``; documents stay in their task."""
    small_batches(docs.sparkSession)

    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, pieces, numbers, held = [], [], Numbers(), 0
        for batch in batches:
            for key, text in zip(batch.column("doc_id").to_pylist(), raw(batch.column("text"))):
                pieces.append(np.fromiter(map(numbers.__getitem__, terms_of(text)), np.uint32))
                ids.append(key)
                held += len(text) + 16
                if held >= shard_bytes:
                    yield shard_row(ids, pieces, numbers)
                    ids, pieces, numbers, held = [], [], Numbers(), 0
        if ids:
            yield shard_row(ids, pieces, numbers)

    given = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return given.mapInArrow(make, INDEX)


def gains(frequencies: np.ndarray, damping: np.ndarray) -> np.ndarray:
    """What an occurrence count is worth at a length part of the score, before the term's weight."""
    return (SCALE * frequencies) // (FREQUENCY * frequencies + LENGTH * damping)


def damped(lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """The length part of the score; lengths are few per call, so that products beyond 64 bits are taken exactly."""
    if len(lengths) and LENGTH_SHARE * int(lengths.max()) * n_docs >= 1 << 63:
        exact = [100 - LENGTH_SHARE + LENGTH_SHARE * int(n) * n_docs // n_terms for n in lengths]
        return np.array(exact, np.int64)
    return 100 - LENGTH_SHARE + (LENGTH_SHARE * lengths * n_docs) // max(n_terms, 1)


def weight(n_docs: int, held_by: int) -> int:
    return math.floor(WEIGHT_SCALE * math.log((2 * n_docs + 2) / (2 * held_by + 1)))


@dataclass
class Shard:
    """One row of the index, opened as far as needed."""

    ids: list
    lengths: np.ndarray
    words: pa.Array
    counts: np.ndarray
    firsts: np.ndarray
    lasts: np.ndarray
    maxima: np.ndarray  # of each block, before the weight
    widths: np.ndarray
    postings: bytes
    damping: np.ndarray  # length part of each document's score
    opened: int = 0

    @classmethod
    def of(cls, batch: pa.RecordBatch, row: int, n_docs: int, n_terms: int) -> "Shard":
        get = lambda name: batch.column(name)[row].as_py()
        numbers = lambda name: unpack(get(name)).astype(np.int64)
        lengths = numbers("lengths")
        maxima = gains(numbers("tops"), damped(numbers("shortest"), n_docs, n_terms))
        return cls(
            get("doc_ids"), lengths, word_array(get("terms")), numbers("counts"), numbers("firsts"), numbers("lasts"),
            maxima, unpack(get("widths"), 1).astype(np.int64), get("postings"), damped(lengths, n_docs, n_terms),
        )

    def __post_init__(self):
        blocks = -(-self.counts // BLOCK)
        self.ends = np.cumsum(blocks)
        self.starts = self.ends - blocks
        within = ragged(np.zeros(len(blocks), np.int64), blocks)
        self.sizes = np.minimum(BLOCK, np.repeat(self.counts, blocks) - BLOCK * within)
        room = self.sizes * (self.widths // 8 + self.widths % 8)
        self.places = np.cumsum(room) - room
        self.best = np.maximum.reduceat(self.maxima, self.starts) if len(blocks) else np.empty(0, np.int64)  # of each term
        self.seen: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # opened blocks, for the other queries

    def block(self, number: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents of a block (numbered over all terms) and what it adds to their scores, before the weight."""
        if number not in self.seen:
            where = (int(x[number]) for x in (self.places, self.widths, self.firsts, self.sizes))
            documents, frequency = open_block(self.postings, *where)
            self.seen[number] = documents, gains(frequency, self.damping[documents])
            self.opened += 1
        return self.seen[number]


@dataclass
class Heap:
    """The best of one query so far: scores from high to low, equal ones by id."""

    k: int
    scores: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    ids: list = field(default_factory=list)

    def bar(self) -> int:
        """A score below this one is out; only documents with a score above 0 count."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def add(self, scores: np.ndarray, ids: list) -> None:
        merged = sorted([*zip((-self.scores).tolist(), self.ids), *zip((-scores).tolist(), ids)], key=in_order)[: self.k]
        self.scores = np.array([-s for s, _ in merged], np.int64)
        self.ids = [i for _, i in merged]


def in_order(entry: tuple) -> tuple:
    score, doc_id = entry
    return score, doc_id is None, 0 if doc_id is None else doc_id


def raised(bar: int, scores: np.ndarray, k: int) -> int:
    """The bar after seeing ``scores``, each of another document and none above its final value."""
    return max(bar, int(np.partition(scores, -k)[-k])) if len(scores) >= k else bar


def search_shard(shard: Shard, lists: Sequence, heap: Heap, total: np.ndarray) -> None:
    """Add a shard's best to ``heap``. ``lists`` has (term, weight, global bound), the greatest bound first.

    ``total`` is a zero score per document, and is left so.
    """
    k, bar = heap.k, heap.bar()
    if sum(w * int(shard.best[t]) for t, w, _ in lists) < bar:
        return
    left = np.cumsum([b for *_, b in lists][::-1])[::-1].tolist()  # global bound of this list and those behind it
    at = 0
    while at < len(lists) and left[at] >= bar:  # essential
        term, w, _ = lists[at]
        for number in range(int(shard.starts[term]), int(shard.ends[term])):
            documents, gain = shard.block(number)
            total[documents] += w * gain
        at += 1
        if at < len(lists):
            bar = raised(bar, total, k)
    found = np.flatnonzero(total)
    scores = total[found]
    total[found] = 0
    if at < len(lists) and len(found):
        scores, found = check_rest(shard, lists[at:], scores, found, k, bar)
    keep = scores >= bar
    scores, found = scores[keep], found[keep]
    if len(scores) > k:  # ties at the last place all stay
        keep = scores >= np.partition(scores, -k)[-k]
        scores, found = scores[keep], found[keep]
    if len(scores):
        heap.add(scores, [shard.ids[i] for i in found.tolist()])


def check_rest(shard: Shard, rest: Sequence, scores: np.ndarray, found: np.ndarray, k: int, bar: int):
    """Scores of the candidates that the lists which are not essential may still lift to the bar."""
    keep = scores + sum(w * int(shard.best[t]) for t, w, _ in rest) >= bar
    scores, found = scores[keep], found[keep]
    blocks, bounds = np.empty((2, len(rest), len(found)), np.int64)
    for i, (term, w, _) in enumerate(rest):
        a, b = int(shard.starts[term]), int(shard.ends[term])
        block = a + np.searchsorted(shard.lasts[a:b], found)
        inside = block < b
        block = np.minimum(block, b - 1)
        inside &= shard.firsts[block] <= found
        blocks[i] = np.where(inside, block, -1)
        bounds[i] = np.where(inside, w * shard.maxima[block], 0)
    hope = bounds.sum(axis=0)
    for i, (_, w, _) in enumerate(rest):
        # who is out stays out, as the bar only rises and hope only falls
        live = np.flatnonzero(scores + hope >= bar)
        if not len(live):
            return scores[live], found[live]
        hope -= bounds[i]
        own = blocks[i][live]
        for number in np.unique(own[own >= 0]).tolist():
            documents, gain = shard.block(number)
            asked = live[own == number]
            spot = np.minimum(np.searchsorted(documents, found[asked]), len(documents) - 1)
            hit = documents[spot] == found[asked]
            scores[asked[hit]] += w * gain[spot[hit]]
        bar = raised(bar, scores[live], k)
    return scores, found


def term_statistics(index: DataFrame, words: list[bytes], n_docs: int, n_terms: int) -> dict[int, tuple[int, int]]:
    """For each of the ``words`` (by place) that some document holds: documents that hold it, greatest block maximum.

    As many rows as ``words``, which are those of one block of queries.
    """

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, most = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        asked = pa.array(words, pa.large_binary())
        for batch in batches:
            for row in range(batch.num_rows):
                shard = Shard.of(batch, row, n_docs, n_terms)
                at = pc.fill_null(pc.index_in(asked, shard.words), -1).to_numpy()
                here = np.flatnonzero(at >= 0)
                held[here] += shard.counts[at[here]]
                most[here] = np.maximum(most[here], shard.best[at[here]])
        got = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(got), pa.array(held[got]), pa.array(most[got])], names=["word", "held", "most"])

    rows = index.mapInArrow(count, "word long, held long, most long").groupBy("word").agg(F.sum("held"), F.max("most"))
    return {r[0]: (r[1], r[2]) for r in rows.collect()}


def answer_block(index: DataFrame, block: list[tuple[int, int | None, list[bytes]]], n_docs: int, n_terms: int, k: int) -> DataFrame:
    """``(place, item_id, doc_id, score)``: each task's best documents for the queries ``(place, item_id, terms)`` of one block."""
    words = sorted({w for *_, own in block for w in own})
    known = term_statistics(index, words, n_docs, n_terms)
    weights = {i: weight(n_docs, held) for i, (held, _) in known.items()}
    number = {w: i for i, w in enumerate(words)}
    plans = []
    for place, item, own in block:
        lists = [(i, weights[i], weights[i] * known[i][1]) for i in (number[w] for w in own) if weights.get(i, 0) > 0]
        plans.append((place, item, sorted(lists, key=lambda x: (-x[2], x[0]))))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps = [Heap(k) for _ in plans]
        asked = pa.array(words, pa.large_binary())
        for batch in batches:
            for row in range(batch.num_rows):
                shard = Shard.of(batch, row, n_docs, n_terms)
                at = pc.fill_null(pc.index_in(asked, shard.words), -1).to_numpy().tolist()
                total = np.zeros(len(shard.ids), np.int64)
                for heap, (*_, lists) in zip(heaps, plans):
                    here = [(at[i], w, b) for i, w, b in lists if at[i] >= 0]
                    if here:
                        search_shard(shard, here, heap, total)
        found = [(place, item, doc, score) for h, (place, item, _) in zip(heaps, plans) for doc, score in zip(h.ids, h.scores.tolist())]
        columns = [pa.array(list(c), pa.int64()) for c in zip(*found)] or [pa.array([], pa.int64())] * 4
        yield pa.RecordBatch.from_arrays(columns, names=["place", "item_id", "doc_id", "score"])

    return index.mapInArrow(run, "place long, item_id long, doc_id long, score long")


def search(index: DataFrame, queries: DataFrame, k: int = K, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``k`` best documents of ``index`` for each row of ``queries`` (item_id, text).

    Highest score first, equal scores by ascending doc_id (a null one last); only
    scores above 0, so a query without a term that some document holds has no
    row. Rows of equal id and text are one query; rows that share an id but not
    the text are answered one by one. Queries are dealt into blocks of some
    ``query_bytes`` of text by hash; the driver holds one block at a time, and
    each block is one pass over the index.
    """
    asked = queries.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text IS NOT NULL").distinct()
    asked = staged(asked, "queries")
    size = asked.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    n_docs, n_terms = (x or 0 for x in index.agg(F.sum("n_docs"), F.sum("n_terms")).first())
    blocks = max(1, -(-size // query_bytes))
    of = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    found = None
    for number in range(blocks):
        rows = asked.where(of == number).orderBy("item_id", "text").collect()
        block = [(number << 32 | i, r["item_id"], sorted(set(terms_of(r["text"].encode())))) for i, r in enumerate(rows)]
        part = answer_block(index, block, n_docs, n_terms, k)
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("place").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def ranked(docs: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """The ``k`` best rows of ``docs`` (doc_id, text) for each of ``queries``; see :func:`search`.

    A document without a term (a null or empty text, say) is found by nothing
    and does not count in the statistics. Every row is a document of its own:
    repeated rows and rows of equal id are listed as often as they occur. An
    empty table on either side gives an empty result. Only the named columns of
    both tables are read, whatever others are called.
    """
    return search(staged(build_index(docs), "lexical-index"), queries, k)
