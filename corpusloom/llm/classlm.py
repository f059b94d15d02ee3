"""Language-model scores with Brown classes: class transitions times word emissions.

    P(text) = prod P(class_i | class_{i-1}) * P(word_i | class_i)

1. Texts become chunks of word positions (``chunks``), written once.
2. Words are counted over all training texts; a chunk deals its distinct words
   out by hash, and the rows of one hash bucket are added up in one task.
3. Exchange clustering: the ``HEAD`` most frequent words move one at a time to
   the class that raises the class-bigram likelihood most, until none moves. The pair
   counts of these words and of two stand-ins (text end, any other word) come
   from all training texts; their table has a fixed size.
4. Every other word takes part in one exchange step: its neighbours' classes are
   counted over all training texts, bucket by bucket as before, and it joins the
   class that explains them best. README has figures for other sizes of the head.
5. Class and count of every word go back to the chunks that asked, transitions
   are counted over all training texts, and every text is scored.

Emissions keep back an absolute discount for the one unknown word; transitions
are interpolated with class frequencies. All probabilities sum to one over the
known words, the end and the unknown word.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from corpusloom.llm.chunks import Numbers, chunked, dealt, pack, pack_words, unpack, word_array
from corpusloom.llm.common import small_batches
from corpusloom.session import staged

CLASSES = 48  # of words; the end of a text is a class of its own
HEAD = 2048  # words that exchange clustering moves one at a time
BUCKETS = 128  # of the word hash, at least; a task holds one bucket, so there are more with more chunks
CHUNK_BYTES = 1 << 23
WORDS_AT_ONCE = 1 << 16
PARTS = 512  # shares of the tasks whose pair counts are added up on their own first
END = b"\n"  # no word holds a line break
PRIOR = 20.0  # weight of the class frequencies in a transition


def tokens(text: bytes) -> list[bytes]:
    """Words at ASCII white space after lower-casing A-Z, then the end."""
    return [*text.lower().split(), END]


def _documents(batch: pa.RecordBatch, row: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of a chunk, the document of each, and the ids (as objects)."""
    lengths = batch.column("lengths")[row].values.to_numpy()
    codes = unpack(batch.column("codes")[row].as_py())
    return codes, np.repeat(np.arange(len(lengths)), lengths), np.array(batch.column("doc_ids")[row].as_py(), object)


def _words(batch: pa.RecordBatch, row: int) -> list[bytes]:
    return word_array(batch.column("words")[row].as_py()).to_pylist()


def _training(ids: np.ndarray, trains: Callable[[object], bool]) -> np.ndarray:
    return np.fromiter((trains(i) for i in ids), bool, len(ids))


def _coded(words: list[bytes], numbers: dict[bytes, int], other: int) -> np.ndarray:
    return np.fromiter((numbers.get(w, other) for w in words), np.int64, len(words))


def _by_bucket(rows: DataFrame) -> DataFrame:
    return rows.repartition("bucket").sortWithinPartitions("bucket")


def _buckets_of(batches: Iterable[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of each bucket, from rows sorted by bucket."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and held[0]["bucket"] != row["bucket"]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


# ---------------------------------------------------------------- counts

TOTALS = "word binary, n long, tokens long, kinds long, once long, twice long"


def word_totals(chunks: DataFrame, trains: Callable[[object], bool], head: int, buckets: int) -> DataFrame:
    """The most frequent words of every bucket, ``head`` of each and the end, with their count ``n``.

    A row without a word has the bucket's sums: tokens, distinct words, words
    that occur once and twice. Words are counted over all training texts.
    """

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                codes, owner, ids = _documents(batch, row)
                n = np.bincount(codes[_training(ids, trains)[owner]], minlength=1)
                words = _words(batch, row)
                seen = np.flatnonzero(n)
                kept = [words[i] for i in seen]
                _, order, used, starts = dealt(kept, buckets)
                parts = np.split(order, starts[1:]) if len(order) else []
                columns = [
                    pa.array(used.astype(np.int32)), pa.array([pack_words([kept[i] for i in p]) for p in parts], pa.binary()),
                    pa.array([pack(n[seen[p]]) for p in parts], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["bucket", "words", "n"])

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _buckets_of(batches):
            names = Numbers()
            to = [np.array([names[w] for w in word_array(r["words"]).to_pylist()], np.int64) for r in rows]
            n = np.bincount(np.concatenate(to), np.concatenate([unpack(r["n"]) for r in rows])).astype(np.int64)
            words = list(names)
            best = sorted(range(len(words)), key=lambda i: (-n[i], words[i]))[: head + 1]
            sums = [int(n.sum()), len(n), int((n == 1).sum()), int((n == 2).sum())]
            empty = [None] * len(best)
            columns = [
                pa.array([None, *(words[i] for i in best)], pa.binary()), pa.array([None, *(int(n[i]) for i in best)], pa.int64()),
                *[pa.array([s, *empty], pa.int64()) for s in sums],
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["word", "n", "tokens", "kinds", "once", "twice"])

    return _by_bucket(chunks.mapInArrow(deal, "bucket int, words binary, n binary")).mapInArrow(add, TOTALS)


def head_pairs(chunks: DataFrame, numbers: dict[bytes, int], trains: Callable[[object], bool]) -> np.ndarray:
    """How often head word j follows head word i in training texts; the last index is any other word.

    ``numbers`` holds the end too. Each task sends one packed row of counts per
    head word; rows are added up by head word and a share of the tasks first,
    then by head word, so that no task gets a row of every other one. The table
    is bounded by the head.
    """
    size = len(numbers) + 1
    end = numbers[END]

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * size, np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                codes, owner, ids = _documents(batch, row)
                heads = _coded(_words(batch, row), numbers, size - 1)[codes]
                before = np.concatenate([[end], heads[:-1]]) if len(heads) else heads
                learned = _training(ids, trains)[owner]  # a text starts after an end, as the text before it has one
                total += np.bincount((before * size + heads)[learned], minlength=size * size)
        part = TaskContext.get().partitionId() % PARTS
        for i, counts in enumerate(total.reshape(size, size)):
            if counts.any():
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([part]), pa.array([_squeeze(counts)])], names=["i", "part", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(_spread(c, size) for c in table.column("counts").to_pylist())
        return pa.table({"i": table.column("i")[:1], "counts": pa.array([_squeeze(total)])})

    rows = chunks.mapInArrow(count, "i long, part long, counts binary")
    for group in (["i", "part"], ["i"]):
        rows = rows.groupBy(*group).applyInArrow(add, "i long, counts binary")
    pairs = np.zeros((size, size))
    for r in rows.collect():
        pairs[r["i"]] = _spread(r["counts"], size)
    return pairs


def _squeeze(counts: np.ndarray) -> bytes:
    used = np.flatnonzero(counts)
    return np.concatenate([used, counts[used]]).astype("<i8").tobytes()


def _spread(squeezed: bytes, size: int) -> np.ndarray:
    used, counts = np.frombuffer(squeezed, "<i8").reshape(2, -1)
    made = np.zeros(size, np.int64)
    made[used] = counts
    return made


# ---------------------------------------------------------------- exchange clustering


def _phi(values: np.ndarray) -> np.ndarray:
    return values * np.log(np.maximum(values, 1e-300))


def exchange(pairs: np.ndarray, classes: int, rounds: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the words, and the counts of class pairs.

    The last two rows of ``pairs`` are the end and any other word; they keep
    classes of their own, the last two. Words start in turn by frequency and are
    moved one at a time; each move takes the class with the greatest likelihood
    of the class bigram; the first of equal ones. Without a number of
    ``rounds`` over all words they go on until none moves, which comes to pass
    as every move raises the likelihood.
    """
    words = len(pairs) - 2
    total = classes + 2
    count = pairs.sum(axis=0)
    of = np.concatenate([np.arange(words) % max(classes, 1), [classes, classes + 1]])
    member = np.eye(total)[of]
    left, right = pairs.T @ member, pairs @ member  # (word, class before it), (word, class behind it)
    table = member.T @ right
    mass_in, mass_out = table.sum(axis=0), table.sum(axis=1)
    free = np.arange(classes)
    moved, turn = words, 0
    while moved and turn != rounds:
        moved, turn = 0, turn + 1
        for w in range(words):
            old, own = of[w], pairs[w, w]
            before, behind = left[w].copy(), right[w].copy()
            before[old] -= own
            behind[old] -= own
            _place(table, old, before, behind, own, -1)
            mass_in[old] -= count[w]
            mass_out[old] -= pairs[w].sum()
            rows, columns = table[free], table[:, free].T
            gain = (_phi(rows + behind) - _phi(rows)).sum(axis=1) + (_phi(columns + before) - _phi(columns)).sum(axis=1)
            corner = table[free, free]
            gain -= _phi(corner + behind[free]) + _phi(corner + before[free]) - 2 * _phi(corner)
            gain += _phi(corner + behind[free] + before[free] + own) - _phi(corner)
            gain -= _phi(mass_in[free] + count[w]) - _phi(mass_in[free])
            gain -= _phi(mass_out[free] + pairs[w].sum()) - _phi(mass_out[free])
            new = int(gain.argmax())
            if gain[new] <= gain[old] + 1e-9:
                new = old
            _place(table, new, before, behind, own, 1)
            mass_in[new] += count[w]
            mass_out[new] += pairs[w].sum()
            if new != old:
                of[w] = new
                moved += 1
                left[:, old] -= pairs[w]
                left[:, new] += pairs[w]
                right[:, old] -= pairs[:, w]
                right[:, new] += pairs[:, w]
    return of, table


def _place(table: np.ndarray, at: int, before: np.ndarray, behind: np.ndarray, own: float, sign: int) -> None:
    table[at] += sign * behind
    table[:, at] += sign * before
    table[at, at] += sign * own


def explained(table: np.ndarray, classes: int) -> np.ndarray:
    """(2 * all classes, word classes): log-likelihood gain of a class for one neighbour before, or behind, the word."""
    joint = table + 0.5 / len(table)
    before = np.log(joint / joint.sum(axis=1, keepdims=True) / joint.sum(axis=0))
    behind = np.log(joint / joint.sum(axis=1, keepdims=True) / joint.sum(axis=0)).T
    return np.concatenate([before[:, :classes], behind[:, :classes]])


FOUND = "of_chunk long, places binary, classes binary, n binary, kinds array<long>, mass array<long>"


def word_classes(
    chunks: DataFrame,
    numbers: dict[bytes, int],
    head_counts: np.ndarray,
    of: np.ndarray,
    table: np.ndarray,
    trains: Callable[[object], bool],
    buckets: int,
) -> DataFrame:
    """Class and count of every word, packed in one row for each chunk and bucket that asks.

    A chunk deals its words out by hash, with the classes around their training
    occurrences; the rows of one bucket are added up in one task, word by word.
    ``places`` are steps from word to word of the chunk. A word that no training
    text has counts 0 and has the class number behind the last. A row without a
    chunk has the bucket's sums by class over its words outside the head.
    """
    size, total = len(numbers) + 1, len(table)
    classes, gains, end, unknown = total - 2, explained(table, total - 2).astype(np.float32), numbers[END], total - 1
    width = 2 * total

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                codes, owner, ids = _documents(batch, row)
                words = _words(batch, row)
                heads = _coded(words, numbers, size - 1)
                around = of[heads][codes]
                at = np.flatnonzero((heads == size - 1)[codes] & _training(ids, trains)[owner])
                before = np.where(at > 0, around[at - 1], of[end])
                behind = around[np.minimum(at + 1, len(codes) - 1)]  # a text closes with its end, so there is a next token
                cells = np.concatenate([codes[at] * np.int64(width) + before, codes[at] * np.int64(width) + total + behind])
                cells, n = np.unique(cells, return_counts=True)
                hashes, order, used, starts = dealt(words, buckets)
                inside = np.empty(len(words), np.int64)
                sizes = np.diff(np.append(starts, len(order)))
                inside[order] = np.arange(len(order)) - np.repeat(starts, sizes)
                owners = hashes[cells // width]
                by_bucket = np.argsort(owners, kind="stable")
                edges = np.searchsorted(owners[by_bucket], used)
                cells = (inside[cells // width] * width + cells % width)[by_bucket]
                places = np.split(order, starts[1:]) if len(order) else []
                columns = [
                    pa.array(used.astype(np.int32)), pa.array([batch.column("chunk")[row].as_py()] * len(used), pa.int64()),
                    pa.array([pack(np.diff(p, prepend=0)) for p in places], pa.binary()),
                    pa.array([pack_words([words[i] for i in p]) for p in places], pa.binary()),
                    pa.array([pack(c) for c in np.split(cells, edges[1:])][: len(used)], pa.binary()),
                    pa.array([pack(c) for c in np.split(n[by_bucket], edges[1:])][: len(used)], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["bucket", "of_chunk", "places", "words", "cells", "n"])

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _buckets_of(batches):
            names, to, keys, counts = Numbers(), [], [], []
            for r in rows:
                to.append(np.array([names[w] for w in word_array(r["words"]).to_pylist()], np.int64))
                cells = unpack(r["cells"]).astype(np.int64)
                keys.append(to[-1][cells // width] * width + cells % width)
                counts.append(unpack(r["n"]))
            keys, counts = np.concatenate(keys), np.concatenate(counts)
            order = np.argsort(keys, kind="stable")
            keys, counts = keys[order], counts[order]
            found, n = np.empty(len(names), np.int64), np.empty(len(names), np.int64)
            for low in range(0, len(names), WORDS_AT_ONCE):
                high = min(low + WORDS_AT_ONCE, len(names))
                part = slice(*np.searchsorted(keys, [low * width, high * width]))
                around = np.bincount(keys[part] - low * width, counts[part], (high - low) * width).reshape(-1, width)
                found[low:high] = (around.astype(np.float32) @ gains).argmax(axis=1)
                n[low:high] = around[:, :total].sum(axis=1)
            found[n == 0] = unknown
            heads = _coded(list(names), numbers, -1)
            rest = (heads < 0) & (n > 0)
            kinds, mass = np.bincount(found[rest], minlength=classes), np.bincount(found[rest], n[rest], classes)
            found[heads >= 0], n[heads >= 0] = of[heads[heads >= 0]], head_counts[heads[heads >= 0]]
            columns = [
                pa.array([*(r["of_chunk"] for r in rows), None], pa.int64()), pa.array([*(r["places"] for r in rows), None], pa.binary()),
                pa.array([*(pack(found[t], 2) for t in to), None], pa.binary()), pa.array([*(pack(n[t], 8) for t in to), None], pa.binary()),
                pa.array([*[None] * len(rows), kinds.tolist()], pa.list_(pa.int64())),
                pa.array([*[None] * len(rows), mass.astype(np.int64).tolist()], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["of_chunk", "places", "classes", "n", "kinds", "mass"])

    rows = chunks.mapInArrow(deal, "bucket int, of_chunk long, places binary, words binary, cells binary, n binary")
    return _by_bucket(rows).mapInArrow(assign, FOUND)


# ---------------------------------------------------------------- scoring


@dataclass
class Model:
    """What scoring needs besides each word's class and count: sums by class, all of fixed size."""

    mass: np.ndarray  # training tokens per class
    discount: float
    kinds: np.ndarray  # distinct words per class
    transitions: np.ndarray | None = None

    @property
    def train_tokens(self) -> int:
        return int(self.mass.sum())

    @property
    def words(self) -> int:
        return int(self.kinds.sum())

    def emission(self, n: np.ndarray, cls: np.ndarray) -> np.ndarray:
        """log10 P(word | class) of known words, 0 for unknown ones."""
        return np.log10(np.where(n > 0, (n - self.discount) / np.maximum(self.mass, 1)[cls], 1.0))

    def steps(self) -> np.ndarray:
        """log10 P(class | class before), the last index being the unknown word, which has no class.

        Without any training text every token is unknown, with certainty.
        """
        if not self.train_tokens:
            return np.zeros((len(self.mass) + 1, len(self.mass) + 1))
        share = self.mass / max(self.mass.sum(), 1)
        seen = np.vstack([self.transitions, np.zeros(len(share))])
        chance = (seen + PRIOR * share) / (seen.sum(axis=1, keepdims=True) + PRIOR)
        unknown = chance @ (self.discount * self.kinds / np.maximum(self.mass, 1))
        return np.log10(np.maximum(np.column_stack([chance, unknown]), 1e-300))

    def base(self, n: np.ndarray) -> np.ndarray:
        """log10 of the smoothed share of each word, unknown words included."""
        return np.log10((n + 0.5) / (self.train_tokens + 0.5 * (self.words + 1)))


PLACED = "doc_ids array<long>, lengths array<int>, classes binary, n_known array<long>, base array<double>, emitted array<double>"


def _place_words(model: Model) -> Callable:
    """Per chunk: classes of its tokens and, per text, known words, base score and emissions."""

    def place(chunks: pa.Table, found: pa.Table) -> pa.Table:
        out: dict[str, list] = {c: [] for c in ("doc_ids", "lengths", "classes", "n_known", "base", "emitted")}
        spots = np.concatenate([np.cumsum(unpack(p)) for p in found.column("places").to_pylist()])
        word_class, word_count = np.empty(len(spots), np.int64), np.empty(len(spots), np.int64)
        word_class[spots] = np.concatenate([unpack(c, 2) for c in found.column("classes").to_pylist()])
        word_count[spots] = np.concatenate([unpack(c, 8) for c in found.column("n").to_pylist()]).astype(np.int64)
        known = np.minimum(word_class, len(model.mass) - 1)
        base, emission = model.base(word_count), model.emission(word_count, known)
        for batch in chunks.to_batches():
            for row in range(batch.num_rows):
                codes, owner, ids = _documents(batch, row)
                docs = len(ids)
                out["doc_ids"].append(ids.tolist())
                out["lengths"].append(np.bincount(owner, minlength=docs))
                out["classes"].append(pack(word_class[codes], 2))
                out["n_known"].append(np.bincount(owner, word_count[codes] > 0, docs).astype(np.int64))
                out["base"].append(np.bincount(owner, base[codes], docs))
                out["emitted"].append(np.bincount(owner, emission[codes], docs))
        kinds = [pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.float64())]
        return pa.table({name: pa.array(values, kind) for (name, values), kind in zip(out.items(), kinds)})

    return place


def _pairs_of(batch: pa.RecordBatch, row: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Classes of a chunk's tokens, those before them (the end before a text), and the owner of each."""
    lengths = batch.column("lengths")[row].values.to_numpy()
    classes = unpack(batch.column("classes")[row].as_py(), 2).astype(np.int64)
    before = np.concatenate([[end], classes[:-1]]) if len(classes) else classes
    return classes, before, np.repeat(np.arange(len(lengths)), lengths), np.array(batch.column("doc_ids")[row].as_py(), object)


def transitions(placed: DataFrame, size: int, end: int, trains: Callable[[object], bool]) -> np.ndarray:
    """Counts of class pairs over all training texts; each task sends one table of fixed size."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * size, np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                classes, before, owner, ids = _pairs_of(batch, row, end)
                learned = _training(ids, trains)[owner]
                total += np.bincount((before * size + classes)[learned], minlength=size * size)
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total[cells])], names=["cell", "n"])

    rows = placed.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    table = np.zeros(size * size)
    for r in rows.collect():
        table[r["cell"]] = r["n"]
    return table.reshape(size, size)


def scored(docs: DataFrame, trains: Callable[[object], bool], head: int = HEAD, classes: int = CLASSES) -> DataFrame:
    """One row per document: ``doc_id, n_tokens, n_known, train_tokens, base_score, score``.

    ``trains`` says of a doc_id whether its text is learned from. Null and empty
    texts are the end alone; repeated rows count as often as they occur; null
    ids are judged by ``trains`` too; an empty table gives an empty result.
    Words of equal count enter the head by their bytes.
    """
    small_batches(docs.sparkSession)
    chunks = staged(chunked(docs, tokens, chunk_bytes=CHUNK_BYTES), "chunks")
    buckets = max(BUCKETS, chunks.count() // 2)
    totals = staged(word_totals(chunks, trains, head, buckets), "word-totals")
    frequent = totals.where((F.col("word") != END) & F.col("word").isNotNull())
    frequent = frequent.orderBy(F.desc("n"), "word").limit(head).collect()
    numbers = {bytes(r["word"]): i for i, r in enumerate(frequent)} | {END: len(frequent)}
    pairs = head_pairs(chunks, numbers, trains)
    of, table = exchange(pairs, classes)
    ends = int(pairs[:, numbers[END]].sum())
    head_counts = np.array([*(r["n"] for r in frequent), ends], np.int64)
    found = staged(word_classes(chunks, numbers, head_counts, of, table, trains, buckets), "word-classes")

    total = classes + 1  # the stand-in for other words ends here, every word has a class of its own
    mass = np.bincount(of[: len(numbers)], head_counts, total)
    kinds = np.bincount(of[: len(numbers)], head_counts > 0, total)
    sums = found.where("of_chunk IS NULL").select(F.posexplode(F.arrays_zip("kinds", "mass")).alias("class", "s"))
    for r in sums.groupBy("class").agg(F.sum("s.kinds").alias("kinds"), F.sum("s.mass").alias("mass")).collect():
        mass[r["class"]] += r["mass"]
        kinds[r["class"]] += r["kinds"]
    once, twice = totals.agg(F.sum("once"), F.sum("twice")).first()
    discount = once / (once + 2 * twice) if once and twice else 0.5
    model = Model(mass, discount, kinds)

    asked = found.where("of_chunk IS NOT NULL").select("of_chunk", "places", "classes", "n")
    texts = chunks.select("chunk", "doc_ids", "lengths", "codes")
    placed = texts.groupBy("chunk").cogroup(asked.groupBy("of_chunk")).applyInArrow(_place_words(model), PLACED)
    placed = staged(placed, "placed")
    size = total + 1
    model.transitions = transitions(placed, size, int(of[numbers[END]]), trains)[:total, :total]
    steps, end = model.steps(), int(of[numbers[END]])

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                now, before, owner, ids = _pairs_of(batch, row, end)
                moved = np.bincount(owner, steps[before, now], len(ids))
                emitted, base, n_known = (batch.column(c)[row].values.to_numpy() for c in ("emitted", "base", "n_known"))
                columns = [
                    pa.array(ids.tolist(), pa.int64()), pa.array(np.bincount(owner, minlength=len(ids))), pa.array(n_known),
                    pa.array(np.full(len(ids), model.train_tokens)), pa.array(base), pa.array(moved + emitted),
                ]
                yield pa.RecordBatch.from_arrays(
                    columns, names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
                )

    schema = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return placed.mapInArrow(score, schema)
