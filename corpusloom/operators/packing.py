"""From encoded documents to one token stream, and from the stream to shards,
training batches and attention blocks.

Everything moves slices of id arrays, never one row per token. Positions come
from arithmetic on document offsets, so no step walks the stream in sequence.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from corpusloom.functions.numbers import whole
from corpusloom.operators.ordering import id_buckets, running
from corpusloom.operators.permutation import permuted
from corpusloom.session import staged

MOST_PARTS = 1 << 20  # parts whose first documents are shared with the tasks, some 24 MB
BLOCK = 128  # fixed value: tokens in one attention block


def token_offsets(lengths: DataFrame, key: str = "doc_id", length: str = "n_ids") -> DataFrame:
    """``start_pos`` and ``end_pos`` of each document in the stream ordered by ``key``."""
    placed = running(lengths, "start_pos", F.col(length).cast("long"), [F.col(key)], id_buckets(F.col(key)))
    return placed.withColumn("end_pos", F.col("start_pos") + F.col(length))


def split_name(shard: Column) -> Column:
    """Shard 0 is for validation, all others for training."""
    return F.when(shard == 0, "val").otherwise("train")


def shard_file(shard: Column) -> Column:
    return F.format_string("data_%s_%06d.bin", split_name(shard), shard)


def cut_stream(
    docs: DataFrame,
    size: int,
    part: str,
    ids: str | None = None,
    keep: Sequence[str] = ("doc_id",),
    overlap: int = 0,
) -> DataFrame:
    """Cut positioned documents at multiples of ``size``.

    Input has ``start_pos`` and ``end_pos``. Output has one row per document and
    part it touches: ``part``, ``lo``, ``hi`` (positions inside the part) and,
    if ``ids`` is given, that slice. A document may span any number of parts.
    With ``overlap`` each part also holds the first ids of the next part.
    """
    first = whole(F.greatest(F.col("start_pos") - overlap, F.lit(0)), size)
    last = whole(F.col("end_pos") - 1, size)
    spans = docs.where(F.col("end_pos") > F.col("start_pos")).withColumn(part, F.explode(F.sequence(first, last)))
    lo = F.greatest(F.col("start_pos"), F.col(part) * size)
    hi = F.least(F.col("end_pos"), F.col(part) * size + size + overlap)
    columns = [part, *keep, (lo - F.col(part) * size).alias("lo"), (hi - F.col(part) * size).alias("hi")]
    if ids:
        begin = (lo - F.col("start_pos") + 1).cast("int")
        columns.append(F.slice(F.col(ids), begin, (hi - lo).cast("int")).alias("ids"))
    return spans.select(*columns)


def part_starts(offsets: DataFrame, size: int, key: str = "doc_id") -> DataFrame:
    """``(part, key, start_pos)``: the document that holds the first id of each part of ``size`` ids."""
    first, last = whole(F.col("start_pos") + (size - 1), size), whole(F.col("end_pos") - 1, size)
    opening = offsets.where((F.col("end_pos") > F.col("start_pos")) & (first <= last))
    return opening.select(F.explode(F.sequence(first, last)).alias("part"), key, "start_pos")


def slices_by_part(
    docs: DataFrame, offsets: DataFrame, size: int, key: str = "doc_id", limit: int = MOST_PARTS
) -> DataFrame:
    """``(part, key, ids)``: encoded documents cut at multiples of ``size``, without moving them.

    ``docs`` has the ids, ``offsets`` the place of each document in the order of
    ``key``, which is unique. A part is known by the document that opens it, so
    one number and one key per part tell where any document belongs: only
    documents that open a part can reach over its edge, and their places are in
    that list. The list is fetched and shared with the tasks if it has at most
    ``limit`` parts; otherwise documents are joined with their offsets, which
    moves them once more.
    """
    starts = part_starts(offsets, size, key).limit(limit + 1).toArrow()
    if starts.num_rows > limit:
        placed = docs.join(offsets.select(key, "start_pos", "end_pos"), key)
        return cut_stream(placed, size, "part", "ids", [key]).select("part", key, "ids")
    starts = starts.sort_by("part")
    columns = tuple(starts.column(c).to_numpy() for c in (key, "part", "start_pos"))
    shared = docs.sparkSession.sparkContext.broadcast(columns)

    @F.arrow_udf(T.StructType([T.StructField("part", T.LongType()), T.StructField("start", T.LongType())]))
    def locate(keys: pa.Array) -> pa.Array:
        openers, parts, places = shared.value
        keys = keys.to_numpy(zero_copy_only=False)
        at = np.searchsorted(openers, keys, side="right") - 1
        opens = openers[at] == keys
        return pa.StructArray.from_arrays([pa.array(parts[at]), pa.array(places[at], mask=~opens)], names=["part", "start"])

    located = (docs if starts.num_rows else docs.limit(0)).select(key, "ids", locate(F.col(key)).alias("at"))
    begin, n = F.col("at.start"), F.size("ids")
    inside = F.array(F.col("at.part"))
    across = F.sequence(whole(begin, size), whole(begin + n - 1, size))
    parts = F.when(n == 0, F.array().cast("array<bigint>")).when(begin.isNull(), inside).otherwise(across)
    spread = located.select(key, "ids", begin.alias("begin"), F.explode(parts).alias("part"))
    low = F.greatest(F.col("part") * size - F.col("begin"), F.lit(0))
    high = F.least(F.col("part") * size + size - F.col("begin"), n)
    cut = F.slice("ids", (low + 1).cast("int"), (high - low).cast("int"))
    return spread.select("part", key, F.when(F.col("begin").isNull(), F.col("ids")).otherwise(cut).alias("ids"))


def gathered_parts(slices: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(part, key, lo, hi, ids)``: the slices of a part together in one task, with their places in the part.

    This is the one time that ids move; what groups by ``part`` and more stays there.
    """
    moved = slices.repartition("part").withColumn("n", F.size("ids").cast("long"))
    before = Window.partitionBy("part").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    lo = F.coalesce(F.sum("n").over(before), F.lit(0))
    return moved.select("part", key, lo.alias("lo"), (lo + F.col("n")).alias("hi"), "ids")


def sequences_of_parts(parts: DataFrame, size: int, length: int) -> DataFrame:
    """``(part, seq, ids)``: gathered parts of ``size`` ids cut into sequences of ``length``, of which ``size`` is a multiple."""
    if size % length:
        raise ValueError("a part must hold whole sequences")
    located = parts.select("part", F.col("lo").alias("start_pos"), F.col("hi").alias("end_pos"), "ids")
    cut = cut_stream(located, length, "own", "ids", ["part"])
    seq = F.col("part") * (size // length) + F.col("own")
    return assemble(cut.select("part", seq.alias("seq"), "lo", "ids"), ["part", "seq"])


def cut_shards(
    docs: DataFrame, shard_size: int, ids: str | None = None, keep: Sequence[str] = ("doc_id",)
) -> DataFrame:
    """Fill shards to exactly ``shard_size``; only the last one may be shorter."""
    cut = cut_stream(docs, shard_size, "shard", ids, keep)
    return cut.withColumn("split", split_name(F.col("shard")))


def assemble(slices: DataFrame, group: Sequence[str]) -> DataFrame:
    """Join the slices of each group in position order into one ``ids`` array.

    For groups of bounded length: sequences and batches, not whole shards.
    """
    ordered = F.sort_array(F.collect_list(F.struct("lo", "ids")))
    return slices.groupBy(*group).agg(F.flatten(F.transform(ordered, lambda s: s["ids"])).alias("ids"))


def train_batches(shards: DataFrame, length: int, world: int, together: str | None = None) -> DataFrame:
    """Windows of ``length + 1`` ids per ``(file, batch, rank)``.

    Input: slices ``(file, lo, ids)``, with ``hi`` if known. If they are already
    partitioned by a column that a file has one value of, ``together`` names it,
    and nothing moves. Neighbouring windows share one id, the
    target of the last input. A batch is whole only if one more id follows it,
    so the tail of a file that does not fill ``world`` windows is left out.
    """
    end = F.col("hi") if "hi" in shards.columns else F.col("lo") + F.size("ids")
    file = ["file"] if together is None else [together, "file"]
    located = shards.select(*file, "ids", F.col("lo").alias("start_pos"), end.alias("end_pos"))
    cut = cut_stream(located, length, "window", "ids", file, overlap=1)
    slices = cut.select(
        *file,
        whole(F.col("window"), world).alias("batch"),
        (F.col("window") % world).cast("int").alias("rank"),
        "lo",
        "ids",
    )
    if together is None:
        slices = slices.repartition("file", "batch")
    windows = assemble(slices, [*file, "batch", "rank"])
    filled = F.sum(F.size("ids")).over(Window.partitionBy(*file, "batch"))
    first = F.col("batch") * (length * world) + F.col("rank") * length
    return (
        windows.withColumn("__filled", filled)
        .where(F.col("__filled") == world * (length + 1))
        .select("file", "batch", "rank", first.alias("first_pos"), "ids")
    )


def require_whole_batch(headers: DataFrame, length: int, world: int) -> DataFrame:
    """``headers`` unchanged; a shard too short for one batch fails the job."""
    needed = length * world + 1
    message = F.concat(F.col("file"), F.lit(f" holds fewer than {needed} tokens"))
    checked = F.when(F.col("tokens") >= needed, F.col("tokens")).otherwise(F.raise_error(message).cast("long"))
    return headers.withColumn("tokens", checked)


def segment_docs(sequences: DataFrame, eot: int, key: str = "seq") -> DataFrame:
    """``(key, doc_no, first_pos, tokens)``: a new segment begins at every ``eot``.

    Only the positions of the marks are expanded, not the tokens. Segment 0 is
    what precedes the first mark and is absent if the sequence begins with one.
    """
    size = F.size("ids")
    marks = F.filter(F.transform("ids", lambda x, i: F.when(x == eot, i)), lambda i: i.isNotNull())
    bounded = sequences.select(key, F.concat(F.array(F.lit(0)), marks, F.array(size)).alias("__edge"))
    spans = bounded.select(key, F.posexplode("__edge").alias("doc_no", "first_pos"), "__edge").select(
        key,
        F.col("doc_no").cast("long").alias("doc_no"),
        "first_pos",
        (F.get("__edge", F.col("doc_no") + 1) - F.col("first_pos")).alias("tokens"),
    )
    return spans.where("tokens > 0")


def block_ranges(sequences: DataFrame, eot: int, key: str = "seq", block: int = BLOCK) -> DataFrame:
    """First and last document number in each block, and where its first document began.

    ``doc_block`` is the block in which document ``doc_low`` starts. A sequence
    is short, so one window per sequence over its blocks is bounded.
    """
    starts = F.sequence(F.lit(0), F.floor((F.size("ids") - 1) / block).cast("int"))
    parts = F.transform(starts, lambda b: F.slice(F.col("ids"), b * block + 1, F.lit(block)))
    blocks = (
        sequences.where(F.size("ids") > 0)
        .select(key, F.posexplode(parts).alias("block", "part"))
        .select(
            key,
            "block",
            F.size(F.filter("part", lambda x: x == eot)).alias("marks"),
            (F.get("part", F.lit(0)) == eot).alias("opens"),
        )
    )
    window = Window.partitionBy(key).orderBy("block")
    earlier = window.rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("marks").over(earlier), F.lit(0))
    last_marked = F.max(F.when(F.col("marks") > 0, F.col("block"))).over(earlier)
    began = F.when(F.col("opens"), F.col("block")).otherwise(F.coalesce(last_marked, F.lit(0)))
    return blocks.select(
        key,
        "block",
        (before + F.col("opens").cast("int")).alias("doc_low"),
        (before + F.col("marks")).alias("doc_high"),
        began.alias("doc_block"),
    )


def block_overlap(ranges: DataFrame, window: int, key: str = "seq") -> DataFrame:
    """Which earlier blocks a query block attends to, in part or in full.

    Document numbers never fall along a sequence. So the blocks that share a
    document with block ``q`` are exactly ``doc_block .. q``, and the full ones
    are the earlier blocks that hold nothing but the single document of ``q``.
    That gives the counts and lists by arithmetic instead of by pairing blocks.

    ``partial_n`` and ``full_n`` count all related blocks. The full ones end
    just before the block itself and begin at ``full_from``; the partial ones
    are the block itself and ``partial_from`` to ``partial_to`` before the full
    ones (null if there are none). So a row has a bounded size, however long the
    sequence. ``partial_kept`` and ``full_kept`` are the counts that fit a
    window of ``window`` blocks.
    """
    uniform = F.col("doc_low") == F.col("doc_high")
    same = Window.partitionBy(key, "doc_low", "__uniform").orderBy("block")
    counted = ranges.withColumn("__uniform", uniform).withColumn(
        "full_n", F.when(F.col("__uniform"), F.row_number().over(same) - 1).otherwise(0).cast("long")
    )
    any_n = F.col("block") - F.col("doc_block") + 1
    earlier = any_n - F.col("full_n") > 1  # the block itself is always related in part
    return counted.select(
        key,
        F.col("block").alias("q_block"),
        (any_n - F.col("full_n")).cast("long").alias("partial_n"),
        "full_n",
        F.when(earlier, F.col("doc_block")).alias("partial_from"),
        F.when(earlier, F.col("block") - F.col("full_n") - 1).cast("int").alias("partial_to"),
        F.when(F.col("full_n") > 0, F.col("block") - F.col("full_n")).cast("int").alias("full_from"),
        F.least(any_n - F.col("full_n"), F.greatest(F.lit(window) - F.col("full_n"), F.lit(1))).alias("partial_kept"),
        F.least(F.col("full_n"), F.lit(window - 1)).alias("full_kept"),
    )


def file_order(files: DataFrame, epochs: int, seed: int = 0, reshuffle: bool = False) -> DataFrame:
    """``(epoch, rank, file)``: the same order in every pass, by name if ``seed`` is 0.

    The table lists files, not data, so one window stays small. Shuffled ranks
    are computed from ranks by name; ``reshuffle`` draws a new order for each pass.
    """
    alone = Window.partitionBy(F.lit(0))
    named = files.select(
        "file", (F.row_number().over(alone.orderBy("file")) - 1).cast("long").alias("rank"), F.count(F.lit(1)).over(alone).alias("n")
    )
    passes = named.select(F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch"), "rank", "n", "file")
    rank = permuted(F.col("rank"), F.col("n"), seed, F.col("epoch") if reshuffle else None) if seed else F.col("rank")
    return passes.select("epoch", rank.alias("rank"), "file")


def batch_schedule(
    headers: DataFrame, epochs: int, length: int, world: int, seed: int = 0, reshuffle: bool = False
) -> DataFrame:
    """``(step, epoch, file, batch, rank)``: which batch of which file each step and rank takes.

    Files come in the order of :func:`file_order`, each gives its whole batches
    one after the other, and its tail is left out. A file without a whole batch
    fails the job. A step's number is a running count of whole batches over the
    files before it.
    """
    whole_batches = whole(F.col("tokens") - 1, length * world).alias("batches")
    sized = require_whole_batch(headers, length, world).select("file", whole_batches)
    ordered = file_order(sized.select("file"), epochs, seed, reshuffle).join(sized, "file")
    last = F.lit(1 << 31)
    place = F.col("epoch").cast("long") * last + F.col("rank")
    placed = running(staged(ordered, "file-order"), "before", F.col("batches"), [place], id_buckets(place))
    batches = placed.select(
        "epoch", "file", "before", F.explode(F.sequence(F.lit(0).cast("long"), F.col("batches") - 1)).alias("batch")
    )
    ranks = F.explode(F.sequence(F.lit(0), F.lit(world - 1))).alias("rank")
    return batches.select((F.col("before") + F.col("batch")).alias("step"), "epoch", "file", "batch", ranks)
