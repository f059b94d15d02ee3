"""Near-duplicate vectors by spherical k-means cells and blocked cosine products.

Directions are assigned to the nearest of some centres, fitted on a bounded
sample. Two directions with a cosine of at least ``LINK`` are at most ``chord``
apart, so they lie in one cell, or both lie within ``chord`` of the plane that
separates their cells. A direction therefore also visits each lesser cell whose
plane is that near. Members and visitors of a cell are dealt into blocks of
bounded size, and each pair of blocks is one product of two matrices, wherever
it runs. A product gives each direction's number of links and a spanning forest,
never the pairs themselves. No link is lost, however many cells there are.

Rows of equal label and vector are one point with a count, so that copies cost
nothing. A cell that holds a third of the table is many blocks; its pairs of
blocks are keys of their own and spread over the tasks.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from corpusloom.llm.common import small_batches
from corpusloom.llm.graph import components
from corpusloom.session import staged

LINK = 0.98
CELL = 512  # directions that a cell of the most frequent label has on average
MOST_CELLS = 1024  # centres that the sample can carry; larger cells are more blocks
BLOCK = 1024  # directions in a block, on average
SAMPLE = 8192  # vectors on which the centres are fitted
ROUNDS = 12  # of k-means
ROUNDING = 1e-9  # within which a matrix product is recomputed, and by which bounds are widened


def matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """Rows of an array column; with ``width`` cut or filled with zeros to that length."""
    ends = np.asarray(column.offsets)
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.diff(ends)
    width = int(sizes[0]) if width is None and len(sizes) else width or 0
    out = np.zeros((len(sizes), width))
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        used = min(int(size), width)
        out[rows, :used] = flat[ends[:-1][rows][:, None] + np.arange(used)]
    return out


def spherical_means(sample: np.ndarray, cells: int, rounds: int = ROUNDS, seed: int = 3) -> np.ndarray:
    """Unit centres of ``cells`` groups of unit vectors; a group that loses all its vectors keeps its centre."""
    distinct = np.unique(sample, axis=0)
    rng = np.random.default_rng(seed)
    centres = distinct[rng.permutation(len(distinct))[:cells]]
    for _ in range(rounds):
        of = (sample @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, of, sample)
        length = np.sqrt((sums**2).sum(axis=1, keepdims=True))
        moved = np.where(length > 1e-12, sums / np.maximum(length, 1e-12), centres)
        if np.array_equal(moved, centres):
            break
        centres = moved
    return centres


def points(vectors: DataFrame) -> DataFrame:
    """``(point, tag, times, label, v)``: rows of equal label and vector, named by their least id.

    The tag tells points apart that have the same least id, as rows may share one.

    Rows without a label or an id, zero vectors and those with a null or
    non-finite component take no part. Of a vector whose length is no finite
    double above 0, the direction is taken after scaling by its largest component.
    """
    v = F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0))  # negative zeros become zeros
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select("vec_id", "label", v.alias("v")).where("vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL")
    rows = rows.where(finite & F.exists("v", lambda x: x != 0))
    once = rows.groupBy("label", "v").agg(F.min("vec_id").alias("point"), F.count("*").alias("times"))
    return once.withColumn("tag", F.xxhash64("label", "v"))


def directions(found: pa.Array, width: int | None = None) -> np.ndarray:
    rows = matrix(found, width)
    rows = rows / np.maximum(np.abs(rows).max(axis=1, keepdims=True), np.finfo(float).tiny)
    return rows / np.maximum(np.sqrt((rows**2).sum(axis=1, keepdims=True)), np.finfo(float).tiny)


def fit_centres(found: DataFrame, sample: int, cell: int, most: int) -> np.ndarray:
    """Centres from a share of all points that is drawn by hash, so that about ``sample`` of them reach the driver."""
    sizes = found.groupBy("label").count()
    total, largest = sizes.agg(F.sum("count"), F.max("count")).first()
    if not total:
        return np.ones((1, 1))
    unit = F.shiftrightunsigned(F.xxhash64(F.lit(97), "point"), 11) / F.lit(float(1 << 53))
    drawn = found.where(unit < min(1.0, sample / total)).select("point", "v").limit(2 * sample).toArrow()
    if not drawn.num_rows:
        return np.ones((1, 1))
    drawn = drawn.combine_chunks().sort_by("point")
    column = drawn.column("v").combine_chunks()
    lengths, times = np.unique(np.diff(np.asarray(column.offsets)), return_counts=True)
    width = int(lengths[times.argmax()])
    unit_rows = directions(column, width)
    unit_rows = unit_rows[(unit_rows**2).sum(axis=1) > 0.5]
    return spherical_means(unit_rows, int(min(most, -(-largest // cell)))) if len(unit_rows) else np.ones((1, width))


def placed(found: DataFrame, centres: np.ndarray, link: float) -> DataFrame:
    """``found`` once for the cell of each point (``home``) and once for each cell that it visits."""
    chord = np.sqrt(2 - 2 * link) + ROUNDING
    apart = np.sqrt(np.maximum(((centres[:, None, :] - centres[None, :, :]) ** 2).sum(axis=2), 0)) if len(centres) <= 64 else None

    def between(home: np.ndarray) -> np.ndarray:
        """Distance of each row's centre from all centres."""
        if apart is not None:
            return apart[home]
        squares = (centres**2).sum(axis=1)
        return np.sqrt(np.maximum(squares[home][:, None] + squares - 2 * centres[home] @ centres.T, 0))

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            near = directions_cut(batch.column("v"), centres.shape[1]) @ centres.T
            home = near.argmax(axis=1)
            beyond = near[np.arange(len(home)), home][:, None] - near  # times the plane's distance
            visits = beyond <= chord * between(home) + ROUNDING
            visits &= np.arange(len(centres)) < home[:, None]
            rows, cells = np.nonzero(visits)
            rows, cells = np.concatenate([np.arange(len(home)), rows]), np.concatenate([home, cells])
            at_home = np.arange(len(rows)) < len(home)
            own = pa.array(rows)
            columns = [pa.array(cells, pa.int32()), pa.array(at_home), *(c.take(own) for c in batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, names=["cell", "home", *batch.schema.names])

    label = found.schema["label"].dataType.simpleString()
    shape = f"cell int, home boolean, label {label}, v array<double>, point long, tag long, times long"
    return found.select("label", "v", "point", "tag", "times").mapInArrow(place, shape)


def directions_cut(column: pa.Array, width: int) -> np.ndarray:
    """Directions, then cut or filled to the centres' length: that brings no two of them further apart."""
    ends = np.asarray(column.offsets)
    sizes = np.diff(ends)
    out = np.zeros((len(sizes), width))
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        whole = directions(column.take(pa.array(rows)))
        out[rows, : min(int(size), width)] = whole[:, :width]
    return out


def blocks(cells: DataFrame, size: int) -> DataFrame:
    """Points packed by label, length, cell and block: ``(key columns, block, members, visitors, points, tags, times, vectors)``.

    Points are dealt out by hash to as many blocks as their number asks for.
    """
    key = ["label", "length", "cell"]
    rows = cells.withColumn("length", F.size("v"))
    counts = rows.groupBy(*key).agg(
        F.ceil(F.count_if("home") / size).cast("int").alias("members"), F.ceil(F.count_if(~F.col("home")) / size).cast("int").alias("visitors")
    )
    dealt = rows.join(counts.where("members > 0"), key)
    dealt_by = F.xxhash64("point", "tag")
    of = F.when(F.col("home"), F.pmod(dealt_by, F.col("members"))).otherwise(F.col("members") + F.pmod(dealt_by, F.col("visitors")))
    dealt = dealt.withColumn("block", of.cast("int"))
    group = [*key, "block", "members", "visitors"]

    def gather(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("point")
        rows = directions(table.column("v").combine_chunks())
        first = {name: table.column(name)[:1] for name in group}
        return pa.table(first | {
            **{f"{c}s": pa.array([table.column(c).to_numpy().tolist()], pa.list_(pa.int64())) for c in ("point", "tag")},
            "times": pa.array([table.column("times").to_numpy().tolist()], pa.list_(pa.int64())),
            "vectors": pa.array([rows.tobytes()], pa.binary()),
        })

    kinds = {f.name: f.dataType.simpleString() for f in dealt.schema}
    shape = ", ".join([*(f"{name} {kinds[name]}" for name in group), "points array<long>", "tags array<long>", "times array<long>", "vectors binary"])
    return dealt.select(*group, "v", "point", "tag", "times").groupBy(*group).applyInArrow(gather, shape)


def least_reachable(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` nodes the least one it reaches over the pairs."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        label = label[label]
        if np.array_equal(label, before):
            return label


def compared(left: tuple, right: tuple | None, link: float) -> tuple[np.ndarray, ...]:
    """Links between two blocks, or within one (``right`` None): points, tags and numbers of links, and a forest (a, b).

    A block is (points, tags, times, unit rows). Cosines within rounding of ``link`` are summed again, in one order.
    """
    names, tags, times, rows = left
    other_names, other_tags, other_times, other = left if right is None else right
    product = rows @ other.T
    linked = product >= link
    for i, j in zip(*np.nonzero(np.abs(product - link) <= ROUNDING)):
        linked[i, j] = float((rows[i] * other[j]).sum()) >= link
    if right is None:
        linked |= linked.T
        np.fill_diagonal(linked, False)
        n_links = linked @ other_times
        a, b = np.nonzero(np.triu(linked))
        nodes = names
    else:
        n_links = np.concatenate([linked @ other_times, linked.T @ times])
        a, b = np.nonzero(linked)
        b = b + len(names)
        nodes, tags = np.concatenate([names, other_names]), np.concatenate([tags, other_tags])
    root = least_reachable(a, b, len(nodes)) if len(a) else np.arange(len(nodes))
    tied = np.flatnonzero(root != np.arange(len(nodes)))
    some = np.flatnonzero(n_links)
    return nodes[some], tags[some], n_links[some], nodes[tied], nodes[root[tied]]


def links(packed: DataFrame, link: float) -> DataFrame:
    """``(a, b, n)``: a number ``n`` of links of the point ``a`` with tag ``b``, or one pair of a forest (``n`` null)."""
    key = ["label", "length", "cell"]
    last = F.col("members") + F.col("visitors") - 1
    body = ["points", "tags", "times", "vectors"]
    # a pair (i, j) has i <= j, i a block of members; each block knows the pairs it is part of
    pairs = F.when(F.col("block") < F.col("members"), F.transform(F.sequence("block", last), lambda j: F.struct(F.col("block").alias("i"), j.alias("j")))).otherwise(
        F.array().cast("array<struct<i:int,j:int>>")
    )
    as_second = F.transform(F.sequence(F.lit(0), F.least(F.col("block"), F.col("members")) - 1), lambda i: F.struct(i.alias("i"), F.col("block").alias("j")))
    firsts = packed.select(*key, F.inline(pairs), *body)
    seconds = packed.where("block > 0").select(*key, F.inline(as_second), *[F.col(c).alias(f"other_{c}") for c in body])
    met = firsts.join(seconds.where("i < j"), [*key, "i", "j"], "left").where("i = j OR other_points IS NOT NULL")

    def unpacked(batch: pa.RecordBatch, row: int, prefix: str) -> tuple | None:
        names = batch.column(f"{prefix}points")[row].as_py()
        if names is None:
            return None
        rows = np.frombuffer(batch.column(f"{prefix}vectors")[row].as_py(), np.float64).reshape(len(names), -1)
        tags, times = (np.array(batch.column(f"{prefix}{c}")[row].as_py(), np.int64) for c in ("tags", "times"))
        return np.array(names, np.int64), tags, times, rows

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                some, tags, n, a, b = compared(unpacked(batch, row, ""), unpacked(batch, row, "other_"), link)
                one = pa.array(np.concatenate([some, a]))
                two = pa.array(np.concatenate([tags, b]))
                number = pa.concat_arrays([pa.array(n.astype(np.int64)), pa.nulls(len(a), pa.int64())])
                yield pa.RecordBatch.from_arrays([one, two, number], names=["a", "b", "n"])

    sent = met.select(*body, *[f"other_{c}" for c in body])
    return sent.mapInArrow(compare, "a long, b long, n long")


def near_duplicates(
    vectors: DataFrame, link: float = LINK, cell: int = CELL, block: int = BLOCK, sample: int = SAMPLE, most_cells: int = MOST_CELLS
) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, one row per row of ``vectors`` (vec_id, embedding, label).

    Vectors of equal label and length link if the cosine of the two, in doubles,
    is at least ``link``. ``component_id`` is the least id reachable over links,
    ``kept`` says whether that is the row's own. Copies link with one another
    and count one by one. A row that takes no part (see :func:`points`) has no
    link, is its own component and is kept, also one without an id, whose
    component is null. Rows that share an id are one node of the graph, and each
    of them is returned. An empty table gives an empty result; other columns of
    ``vectors`` are not read. The centres are fitted on about ``sample``
    vectors, every vector is assigned and compared.
    """
    small_batches(vectors.sparkSession)
    found = staged(points(vectors), "points")
    centres = fit_centres(found, sample, cell, most_cells)
    packed = staged(blocks(placed(found, centres, link), block), "blocks")
    made = staged(links(packed, link), "links")
    counted = made.where("n IS NOT NULL").groupBy(F.col("a").alias("point"), F.col("b").alias("tag")).agg(F.sum("n").alias("n"))
    roots = components(made.where("n IS NULL"), "a", "b").withColumnRenamed("node", "point")
    known = found.join(counted, ["point", "tag"], "left").join(roots, "point", "left")
    known = known.select(
        "label", "v", (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("root", "point").alias("root")
    )
    v = F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0))
    rows = vectors.select("vec_id", "label", v.alias("v")).join(known, ["label", "v"], "left")
    given = F.col("vec_id").isNotNull()
    component = F.when(given, F.coalesce("root", "vec_id"))
    return rows.select(
        "vec_id",
        F.when(given, F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )


def keep_one(vectors: DataFrame, link: float = LINK, **bounds: int) -> DataFrame:
    """``vectors`` with one row of each group left, that of the least id; its rows of equal id are one row.

    Of rows with equal id and different contents the first by a digest stays. Rows without an id all stay.
    """
    kept = near_duplicates(vectors, link, **bounds).where("kept AND vec_id IS NOT NULL").select("vec_id").distinct()
    numbered = vectors.join(kept, "vec_id", "left_semi")
    digest = F.xxhash64("label", "embedding")
    first = F.row_number().over(Window.partitionBy("vec_id").orderBy(digest))
    place = "__place"
    one = numbered.withColumn(place, first).where(F.col(place) == 1).drop(place)
    return one.select(vectors.columns).unionByName(vectors.where("vec_id IS NULL"))
