"""Lookups in large tables for lists: blocks with a dictionary of their own.

A list column would have to be exploded to join its values, one row per value,
and regrouped afterwards. Here a task gathers its rows into blocks first: a
block has each *distinct* value once, and the lists as positions in those. Only
the distinct values are joined; what they map to meets the block's rows again in
one task, and the lists are gathered from it. So what is shuffled is a block's
distinct values, and the coded rows once.

A block stays many rows, one for each row that went in, and is put together for
one function call alone. A task holds the values of one block at a time,
whatever the number of blocks that fall to it.

Spark sends a function its rows in batches of 10,000, which for long lists is
many times a block. Lists go there in slices of bounded length, one a row, so a
batch is about a block however long the lists are, and however many a task has.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F, types as T

from corpusloom.functions.numbers import whole
from corpusloom.session import staged

BLOCK_VALUES = 1 << 20  # list values in a block, and what its last row has beyond them
SLICE_VALUES = 128  # list values that one row takes to a function; some 2^20 in a batch
BLOCKS_PER_TASK = 33  # bits for numbers of blocks within a task
HEAD_ROWS = 1 << 16  # of a table that are broadcast: the driver holds some 150 bytes for each, several times over


def _lengths(lists: pa.ListArray) -> np.ndarray:
    """Numbers of values, a null list having none."""
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)


def _ends(lengths: np.ndarray) -> pa.Array:
    """Offsets of lists of these lengths in their flattened values."""
    return pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))


def sliced_lists(df: DataFrame, lists: Sequence[str], values: int = SLICE_VALUES) -> DataFrame:
    """Each row as often as its longest list has slices of ``values``: the slices of its lists, in order, and their number as ``__at``.

    A row without values is one row, where a null list is null.
    """
    longest = F.greatest(F.lit(1), *[F.size(n) for n in lists])
    numbered = df.select("*", F.explode(F.sequence(F.lit(0), whole(longest - 1, values).cast("int"))).alias("__at"))
    begin = F.col("__at") * values + 1
    return numbered.withColumns({n: F.slice(n, begin, F.lit(values)) for n in lists})


def coded_blocks(df: DataFrame, lists: Mapping[str, Column], carried: Sequence[str], values: int = BLOCK_VALUES) -> DataFrame:
    """``(block, entries, counts, <carried>, <lists>)``: the given rows, their lists as positions in the distinct values of the block.

    ``entries`` has these values and ``counts`` their occurrences, in the first
    row of a block; both are null in the others. The other columns are named by their place. A null list stays null
    and a null value is a null position. Block numbers tell blocks apart and
    mean nothing else; they depend on how rows fell to tasks, so store the
    result before it is read twice.
    """
    names = [f"__list{i}" for i in range(len(lists))]
    given = df.select(*carried, *[c.alias(n) for n, c in zip(names, lists.values())])
    value = given.schema[names[0]].dataType.elementType
    coded = T.ArrayType(T.IntegerType())
    shape = T.StructType([
        T.StructField("block", T.LongType()),
        T.StructField("entries", T.ArrayType(value)),
        T.StructField("counts", T.ArrayType(T.LongType())),
        *(T.StructField(f"__{i}", coded if f.name in names else f.dataType) for i, f in enumerate(given.schema)),
    ])
    where = [i for i, f in enumerate(given.schema) if f.name in names]

    def packed(number: int, batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        """A block of whole rows, given in slices."""
        *columns, at = [pa.concat_arrays([b.column(i) for b in batches]) for i in range(batches[0].num_columns)]
        firsts = np.flatnonzero(at.to_numpy() == 0)
        flat = [columns[i].flatten() for i in where]
        known = pc.dictionary_encode(pa.concat_arrays(flat))
        low = 0
        for i, column in enumerate(columns):
            if i not in where:
                columns[i] = column.take(pa.array(firsts))
                continue
            lengths = np.add.reduceat(_lengths(column), firsts)
            mask = pc.is_null(column).take(pa.array(firsts)) if column.null_count else None
            size = int(lengths.sum())
            columns[i] = pa.ListArray.from_arrays(_ends(lengths), known.indices.slice(low, size), mask=mask)
            low += size
        n = len(firsts)
        block = pa.repeat(pa.scalar(number, pa.int64()), n)
        ends = pa.array([0, *[len(known.dictionary)] * n], pa.int32())
        others = pa.array(np.arange(n) > 0)
        times = np.bincount(known.indices.drop_null().to_numpy(), minlength=len(known.dictionary)).astype(np.int64)
        once = [pa.ListArray.from_arrays(ends, values_, mask=others) for values_ in (known.dictionary, pa.array(times))]
        return pa.RecordBatch.from_arrays([block, *once, *columns], names=shape.names)

    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A block ends before the first row that finds ``values`` values in it."""
        number, held, size = TaskContext.get().partitionId() << BLOCKS_PER_TASK, [], 0
        for batch in batches:
            ends = np.cumsum(sum(_lengths(batch.column(i)) for i in where) + 1)
            before = np.concatenate([[0], ends])  # values before each slice, and all of them
            firsts = np.flatnonzero(batch.column(batch.num_columns - 1).to_numpy() == 0)
            low = 0
            while (at := np.searchsorted(before[firsts], values - size + before[low])) < len(firsts):
                yield packed(number, [*held, batch.slice(low, firsts[at] - low)])
                number, held, size, low = number + 1, [], 0, firsts[at]
            held.append(batch.slice(low))
            size += before[-1] - before[low]
        if size:
            yield packed(number, held)

    return sliced_lists(given, names).mapInArrow(make, shape)


def joined_entries(entries: DataFrame, table: DataFrame, source: str, target: str, limit: int) -> DataFrame:
    """``(block, code, target)`` of each entry that ``table`` (source, target; one row per source) has.

    The first ``limit`` ids (at most ``HEAD_ROWS``), the most frequent entries, are broadcast after
    they were counted; only what misses them is shuffled. A value is one row per
    block at most, so a frequent one that misses is no multiple of its occurrences.
    """
    limit = min(limit, HEAD_ROWS)
    columns = ["block", "code", target]
    number = "id" if "id" in (source, target) else target
    frequent = table.where(F.col(number) < limit)
    if not limit or frequent.limit(limit + 1).count() > limit:  # ids that are no ranks say nothing about frequency
        return entries.join(table, source).select(columns)
    hits = entries.join(F.broadcast(frequent), source).select(columns)
    misses = entries.join(F.broadcast(frequent.select(source)), source, "left_anti")
    return hits.unionByName(misses.join(table, source).select(columns))


def look_up_lists(
    df: DataFrame, lists: Mapping[str, Column], table: DataFrame, source: str, target: str, missing, carried: Sequence[str], limit: int
) -> DataFrame:
    """``carried`` columns and ``lists`` with each value replaced by its ``target`` in ``table``, or by ``missing``.

    ``table`` has one row per ``source``. Rows come out as often as they go in,
    whatever they hold; a null list gives an empty one, a null value ``missing``.
    """
    blocks = staged(coded_blocks(df, lists, carried), "coded-blocks")
    return look_up_blocks(blocks, table, source, target, missing, carried, list(lists), limit)


def look_up_blocks(
    blocks: DataFrame, table: DataFrame, source: str, target: str, missing, carried: Sequence[str], lists: Sequence[str], limit: int
) -> DataFrame:
    """:func:`look_up_lists` for stored :func:`coded_blocks`, whose columns are to be named ``carried`` and ``lists``."""
    entries = blocks.select("block", F.posexplode("entries").alias("code", source)).where(F.col(source).isNotNull())
    found = joined_entries(entries, table, source, target, limit)
    kind = table.schema[target].dataType
    kinds = [blocks.schema[f"__{i}"].dataType for i in range(len(carried))]
    shape = T.StructType(
        [*(T.StructField(n, k) for n, k in zip(carried, kinds)), *(T.StructField(n, T.ArrayType(kind)) for n in lists)]
    )
    n_carried, out_names = len(carried), [*carried, *lists]

    def gather(rows: pa.Table, found: pa.Table) -> pa.Table:
        """One block: its rows, and what those of its values that are known map to."""
        codes, targets = found.column("code").to_numpy(), found.column(target).combine_chunks()
        most = max(pc.max(pc.list_flatten(rows.column(f"__{c}"))).as_py() or 0 for c in range(n_carried, len(out_names)))
        of_code = np.zeros(max(most, codes.max(initial=0)) + 1, np.int64)  # place 0 has what stands for unknown values
        of_code[codes] = np.arange(1, len(codes) + 1)
        known = pa.concat_arrays([pa.array([missing], targets.type), targets])
        places, made = pa.array(of_code), []
        for part in rows.to_batches():
            columns = [part.column(f"__{c}") for c in range(len(out_names))]
            for c in range(n_carried, len(out_names)):
                flat = pc.fill_null(places.take(columns[c].flatten()), 0)
                columns[c] = pa.ListArray.from_arrays(_ends(_lengths(columns[c])), known.take(flat))
            made.append(pa.RecordBatch.from_arrays(columns, names=out_names))
        return pa.Table.from_batches(made)

    found = found.withColumnRenamed("block", "of_block")  # both sides come from one table
    return blocks.drop("entries", "counts").groupBy("block").cogroup(found.groupBy("of_block")).applyInArrow(gather, shape)
