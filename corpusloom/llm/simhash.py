"""Near-duplicates by SimHash fingerprints, linked through pivot distance tables.

A fingerprint's row in the pivot table holds its Hamming distances to reference
fingerprints. Distance 0 is to the zero fingerprint, the others are to random
references that have bits in one of six blocks only. Two facts make the join:

* ``d(x, r) - d(x, 0)`` depends on the bits of x in r's block alone. If x and y
  differ in at most three bits, at least three blocks are untouched, so that
  for some three blocks all these differences agree: one of 20 equi-join keys.
* ``|d(x, r) - d(y, r)| <= d(x, y)``, so a pair with a larger difference in any
  coordinate is discarded; the Hamming distance of the survivors is computed.

Both are exact: no link is lost, and there is no cap on partners. Links come out
of a task as a spanning forest, never as all pairs of a group. A key with very
many fingerprints is cut into blocks, and pairs of blocks go to separate tasks.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from corpusloom.llm.common import raw, small_batches
from corpusloom.llm.graph import components
from corpusloom.session import staged

SHINGLE = 3
HASH_SEED = 42
BITS = 64
LINK = 3
BLOCK_WIDTHS = (11, 11, 11, 11, 10, 10)
REFERENCES_PER_BLOCK = 8
BLOCK_ROWS = 4096  # fingerprints that one task compares with as many others
SMALL_GROUP = 32
HASHES_AT_ONCE = 1 << 18

_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(text: bytes | None) -> int:
    """The 64-bit fingerprint of a text: bit i is set if it is set in over half of the shingles' hashes.

    Words are cut at ASCII white space after lower-casing A-Z; three words make
    a shingle, fewer the whole sequence. No word gives zero.
    """
    words = (text or b"").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    first = np.concatenate([[0], ends[:-1] + 1])
    total = max(len(words) - SHINGLE + 1, 1)
    last = ends[min(SHINGLE, len(words)) - 1 :]
    counts = np.zeros((8, 256), np.int64)
    digest, step = xxhash.xxh64_intdigest, HASHES_AT_ONCE
    for start in range(0, total, step):
        bounds = zip(first[start : min(start + step, total)].tolist(), last[start : start + step].tolist())
        hashes = np.array([digest(line[a:b], HASH_SEED) for a, b in bounds], np.uint64)
        octets = hashes.astype(">u8").view(np.uint8).reshape(-1, 8) + np.arange(0, 2048, 256)
        counts += np.bincount(octets.ravel(), minlength=2048).reshape(8, 256)
    majority = (2 * (counts @ _BYTE_BITS) > total).astype(np.uint8).ravel()
    return int(np.packbits(majority).view(">u8")[0])


@F.arrow_udf(T.LongType())
def fingerprint_column(text: pa.Array) -> pa.Array:
    """Fingerprints as signed 64-bit numbers; a null text is empty."""
    values = np.array([fingerprint(t) for t in raw(text)], np.uint64)
    return pa.array(values.view(np.int64))


def hex_digits(column: Column) -> Column:
    """16 lowercase hex digits of a signed 64-bit number."""
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def references(seed: int = 7) -> tuple[np.ndarray, list[slice]]:
    """The reference fingerprints, zero first, and the slice of each block's references."""
    rng, shift, made, where = np.random.default_rng(seed), 0, [0], []
    for width in BLOCK_WIDTHS:
        where.append(slice(len(made), len(made) + REFERENCES_PER_BLOCK))
        made += [int(v) << shift for v in rng.integers(1, 1 << width, REFERENCES_PER_BLOCK)]
        shift += width
    return np.array(made, np.uint64), where


def pivot_table(prints: np.ndarray) -> np.ndarray:
    """Hamming distances of each fingerprint to each reference."""
    return np.bitwise_count(prints[:, None] ^ references()[0][None, :]).astype(np.int16)


def _mix(value: np.ndarray) -> np.ndarray:
    value = (value ^ (value >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return value ^ (value >> np.uint64(29))


def join_keys(prints: np.ndarray) -> np.ndarray:
    """20 numbers per fingerprint; two fingerprints within three bits share one at least."""
    table = pivot_table(prints)
    shifted = (table[:, 1:] - table[:, :1] + BITS).astype(np.uint64)
    codes = np.zeros((len(prints), len(BLOCK_WIDTHS)), np.uint64)
    for block in range(len(BLOCK_WIDTHS)):
        for j in range(REFERENCES_PER_BLOCK):
            codes[:, block] = codes[:, block] * np.uint64(131) + shifted[:, block * REFERENCES_PER_BLOCK + j]
    keys = []
    for number, chosen in enumerate(combinations(range(len(BLOCK_WIDTHS)), len(BLOCK_WIDTHS) - LINK)):
        key = np.full(len(prints), number + 1, np.uint64)
        for block in chosen:
            key = _mix(key * np.uint64(0xD6E8FEB86659FD93) + codes[:, block])
        keys.append(key)
    return np.stack(keys, axis=1).view(np.int64)


def _emit_keys(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = batch.column("fp").to_numpy(zero_copy_only=False)
        for start in range(0, len(prints), 8192):
            part = prints[start : start + 8192]
            keys = join_keys(part.view(np.uint64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.ravel()), pa.array(np.repeat(part, keys.shape[1]))], names=["key", "fp"]
            )


class _Forest:
    """Union-find over the positions 0..n-1, joined in batches of pairs."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.label[a], self.label[b]
            open_ = x != y
            if not open_.any():
                return
            a, b = a[open_], b[open_]
            np.minimum.at(self.label, np.maximum(x, y)[open_], np.minimum(x, y)[open_])
            while (jumped := self.label[self.label] != self.label).any():
                self.label = np.where(jumped, self.label[self.label], self.label)


def _link(prints: np.ndarray, table: np.ndarray, forest: _Forest, a: np.ndarray, b: np.ndarray) -> None:
    """Join the pairs (a, b) whose fingerprints link: first by the pivot table, then by the distance itself."""
    apart = forest.label[a] != forest.label[b]
    a, b = a[apart], b[apart]
    for columns in (slice(0, 1), slice(1, 9), slice(9, None)):
        if not len(a):
            return
        near = (np.abs(table[a, columns] - table[b, columns]) <= LINK).all(axis=1)
        a, b = a[near], b[near]
    near = np.bitwise_count(prints[a] ^ prints[b]) <= LINK
    forest.join(a[near], b[near])


def linked_stars(keys: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among rows of equal ``keys`` (sorted), as pairs (fingerprint, lesser one)."""
    nodes, where = np.unique(prints, return_inverse=True)
    table, forest = pivot_table(nodes), _Forest(len(nodes))
    cuts = np.flatnonzero(np.diff(keys)) + 1
    starts = np.concatenate([[0], cuts])
    sizes = np.diff(np.concatenate([starts, [len(keys)]]))
    last = np.repeat(starts + sizes, sizes)
    small = np.flatnonzero(np.repeat(sizes, sizes) <= SMALL_GROUP)
    for step in range(1, SMALL_GROUP):
        small = small[small + step < last[small]]
        if not len(small):
            break
        _link(nodes, table, forest, where[small], where[small + step])
    for start, size in zip(starts[sizes > SMALL_GROUP], sizes[sizes > SMALL_GROUP]):
        members = np.unique(where[start : start + size])
        members = members[np.argsort(table[members, 0], kind="stable")]
        reach = np.searchsorted(table[members, 0], table[members, 0] + LINK, side="right")
        for low in range(0, len(members), 64):  # rows low..low+63 against all that sort later within reach
            rows = np.arange(low, min(low + 64, len(members)))
            width = int(reach[rows[-1]]) - low
            a, b = np.repeat(rows, width), np.tile(np.arange(low, low + width), len(rows))
            later = b > a
            _link(nodes, table, forest, members[a[later]], members[b[later]])
    tied = np.flatnonzero(forest.label != np.arange(len(nodes)))
    return nodes[tied], nodes[forest.label[tied]]


def _emit_links(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads rows sorted by ``cell``; whole cells are gathered, some 2^16 rows at a time."""
    cells, prints = np.empty(0, np.int64), np.empty(0, np.int64)

    def made(upto: int) -> pa.RecordBatch:
        a, b = linked_stars(cells[:upto], prints[:upto].view(np.uint64))
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    for batch in batches:
        cells = np.concatenate([cells, batch.column("cell").to_numpy(zero_copy_only=False)])
        prints = np.concatenate([prints, batch.column("fp").to_numpy(zero_copy_only=False)])
        whole = int(np.searchsorted(cells, cells[-1])) if len(cells) else 0
        if whole >= 1 << 16 or (whole and len(cells) >= 1 << 17):
            yield made(whole)
            cells, prints = cells[whole:], prints[whole:]
    if len(cells):
        yield made(len(cells))


def links(prints: DataFrame) -> DataFrame:
    """``(a, b)``: a spanning forest per task of all links between the different fingerprints in column ``fp``."""
    keyed = prints.select("fp").mapInArrow(_emit_keys, "key long, fp long")
    keyed = staged(keyed, "pivot-keys")
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = keyed.join(shared, "key")
    blocks = F.ceil(F.col("n") / BLOCK_ROWS).cast("int")
    own = F.pmod(F.xxhash64("fp"), blocks.cast("long")).cast("int")
    met = met.select("key", "fp", blocks.alias("blocks"), own.alias("own"))
    one = met.where("blocks = 1").select(F.xxhash64("key").alias("cell"), "fp")
    others = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    crowded = met.where("blocks > 1").select("key", "fp", "own", others.alias("other"))
    pair = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
    rows = one.unionByName(crowded.select(pair.alias("cell"), "fp"))
    return rows.repartition("cell").sortWithinPartitions("cell").mapInArrow(_emit_links, "a long, b long")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: its id, ``fp`` (signed 64 bits) and ``component_id``.

    ``component_id`` is the least id that is reachable over links of at most
    three differing bits, the document's own id included. Null and empty texts
    have fingerprint zero and link like any other; repeated rows stay and share
    their group; null ids get their group's id (null if it has none); an empty
    table gives an empty result; other columns of ``docs`` are not touched.
    """
    small_batches(docs.sparkSession)
    made = staged(docs.select(F.col(id_column).alias("doc_id"), fingerprint_column(text_column).alias("fp")), "prints")
    grouped = print_groups(made)
    leasts = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    named = grouped.join(leasts, "root").select("fp", "component_id")
    return made.join(named, "fp").select("doc_id", "fp", "component_id")


def print_groups(made: DataFrame) -> DataFrame:
    """``(fp, least, root)`` of each fingerprint of ``made`` (doc_id, fp): its least id, and a name for its group."""
    prints = staged(made.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-prints")
    roots = components(links(prints), "a", "b")
    grouped = prints.join(roots, prints.fp == roots.node, "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    return staged(grouped, "print-roots")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text) with one of each near-duplicate group left.

    That is the one with the least id, a missing id being the greatest; of rows
    that share it the one with the least digest of its text, then of all its
    columns. So rows that share an id but not the text are documents of their
    own, and rows without an id are compared like any other.
    """
    small_batches(docs.sparkSession)
    names = ["__id", "__no_id", "__text"]
    key = [F.coalesce("doc_id", F.lit(0)), F.col("doc_id").isNull(), F.md5(F.coalesce("text", F.lit("")))]
    key = [c.alias(n) for c, n in zip(key, names)]
    made = staged(docs.select("doc_id", *key, fingerprint_column("text").alias("fp")), "prints")
    grouped = print_groups(made.select("doc_id", "fp")).select("fp", "root")
    first = F.min(F.struct("__no_id", "__id", "__text")).alias("first")
    kept = made.join(grouped, "fp").groupBy("root").agg(first).select("first.*").distinct()
    rows = docs.select(*key, F.struct(*docs.columns).alias("__row"), F.xxhash64(*docs.columns).alias("__digest"))
    found = rows.join(kept, names, "left_semi")
    return found.groupBy(*names).agg(F.min_by("__row", "__digest").alias("__row")).select("__row.*")
