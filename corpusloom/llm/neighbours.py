"""Nearest neighbours by inner product over shifted Hilbert curves.

Vectors are projected to a few dimensions, shifted and quantised, once per
curve, and sorted by their Hilbert key. The sort deals key ranges out to tasks,
which cut them into windows of consecutive vectors. A query meets the windows
around its own on every curve; what they give is merged and reranked by the true
inner product. An exact check follows: a window of the first curve is searched
too if its centre and radius allow a better candidate than those found. Where
vectors form clusters this leaves out nearly all windows; where they have no
structure, windows cannot be told apart and most are searched.

Equal vectors are one point with its least ids, so that a vector that fills a
third of the table is searched once, and its copies are found by id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusloom.llm.common import small_batches
from corpusloom.session import staged

K = 20
CURVES = 4
DIMENSIONS = 8
BITS = 7  # a key has DIMENSIONS * BITS bits
WINDOW = 1024  # vectors in a window
REACH = 1  # windows to either side that a query meets
SAMPLE = 4096  # vectors from which projections and ranges are fitted
GROUP = 20  # windows whose queries are checked together
GROUPS_AT_ONCE = 1 << 14  # summaries of query groups that one pass over the windows carries


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of each row of ``cells`` (integers below 2^bits), by Skilling's transform."""
    x = [cells[:, i].astype(np.int64) for i in range(cells.shape[1])]
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        for i in range(len(x)):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(high, q - 1, swap)
            x[i] ^= swap
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        turn ^= np.where((x[-1] & q) != 0, q - 1, 0)
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for axis in x:
            key = (key << 1) | (((axis ^ turn) >> bit) & 1)
    return key


@dataclass
class Curves:
    """One projection, shift and scale per curve."""

    projections: np.ndarray  # (curves, vector, dimensions)
    low: np.ndarray  # (curves, dimensions)
    width: np.ndarray

    def keys(self, vectors: np.ndarray, curve: int) -> np.ndarray:
        places = (vectors @ self.projections[curve] - self.low[curve]) / self.width[curve]
        return hilbert_keys(np.clip(places * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64), BITS)


def fit_curves(sample: np.ndarray, curves: int, seed: int = 13) -> Curves:
    """Projections to random mixtures of the sample's main directions; ranges are the sample's, shifted at random."""
    rng = np.random.default_rng(seed)
    size = sample.shape[1]
    dimensions = min(DIMENSIONS, size)
    _, scale, directions = np.linalg.svd(sample - sample.mean(axis=0), full_matrices=False)
    main = directions[: max(dimensions, min(2 * DIMENSIONS, int((scale > 1e-9).sum())))]
    projections, low, width = [], [], []
    for _ in range(curves):
        mixed, _ = np.linalg.qr(rng.normal(size=(len(main), len(main))))
        projection = (main.T @ mixed)[:, :dimensions]
        placed = sample @ projection
        span = np.maximum(placed.max(axis=0) - placed.min(axis=0), 1e-9) * 1.25
        projections.append(projection)
        low.append(placed.min(axis=0) - rng.uniform(0, 0.2, projection.shape[1]) * span)
        width.append(span)
    return Curves(np.array(projections), np.array(low), np.array(width))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of an array column as doubles; all have one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def usable(vectors: DataFrame) -> DataFrame:
    """``(vec_id, v)`` of the rows that take part, as arrays of doubles.

    Null ids and vectors, zero vectors and those with a null or non-finite
    component do not, nor do vectors of another length than the most frequent
    one (the longer of equally frequent ones).
    """
    v = F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0))  # negative zeros become zeros
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select("vec_id", v.alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL")
    rows = rows.where(finite & F.exists("v", lambda x: x != 0))
    most = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    return rows.where(F.size("v") == (most[0]["n"] if most else 0))


def points(rows: DataFrame, asks: Column, k: int) -> DataFrame:
    """Distinct vectors: ``(point, ids, asks, v)`` with the least ``k + 1`` ids in order, the first being the point's name.

    Ids behind these are among the nearest of no query. Ranks are limited before
    the shuffle, so that a frequent vector is no group in one task.
    """
    once = rows.select("vec_id", "v", asks.alias("asks"))
    order = Window.partitionBy("v").orderBy("vec_id")
    least = once.select("vec_id", "v").distinct().withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
    ids = least.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    asked = once.groupBy("v").agg(F.max("asks").alias("asks"))
    return ids.join(asked, "v").select(F.element_at("ids", 1).alias("point"), "ids", "asks", "v")


def windows(found: DataFrame, curves: Curves) -> DataFrame:
    """``(curve, window, ids, vectors, query_ids, queries, centre, radius)``; windows are numbered along each curve."""
    number, size = len(curves.projections), WINDOW

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = matrix(batch.column("v"))
            for curve in range(number):
                columns = [pa.array(np.full(len(vectors), curve, np.int32)), pa.array(curves.keys(vectors, curve))]
                yield pa.RecordBatch.from_arrays([*columns, *batch.columns], names=["curve", "key", "point", "asks", "v"])

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, serial, current = TaskContext.get().partitionId(), 0, None
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def made(ids: np.ndarray, asks: np.ndarray, vectors: np.ndarray) -> pa.RecordBatch:
            centre = vectors.mean(axis=0)
            radius = float(np.sqrt(((vectors - centre) ** 2).sum(axis=1).max()))
            columns = [
                pa.array([part], pa.int32()), pa.array([current], pa.int32()), pa.array([serial], pa.int64()),
                pa.array([ids.tolist()], pa.list_(pa.int64())), pa.array([vectors.tobytes()]),
                pa.array([ids[asks].tolist()], pa.list_(pa.int64())), pa.array([vectors[asks].tobytes()]),
                pa.array([centre.tolist()], pa.list_(pa.float64())), pa.array([radius]),
            ]
            names = ["part", "curve", "serial", "ids", "vectors", "query_ids", "queries", "centre", "radius"]
            return pa.RecordBatch.from_arrays(columns, names=names)

        def flush(least: int) -> Iterator[pa.RecordBatch]:
            nonlocal held, serial
            while held and sum(len(h[0]) for h in held) >= least:
                ids, asks, vectors = (np.concatenate(x) for x in zip(*held))
                yield made(ids[:size], asks[:size], vectors[:size])
                serial += 1
                held = [(ids[size:], asks[size:], vectors[size:])] if len(ids) > size else []

        for batch in batches:
            of = batch.column("curve").to_numpy()
            for curve in np.unique(of):
                if curve != current:
                    yield from flush(1)
                    current, serial = int(curve), 0
                own = batch.filter(pa.array(of == curve))
                asks = own.column("asks").to_numpy(zero_copy_only=False).astype(bool)
                held.append((own.column("point").to_numpy(), asks, matrix(own.column("v"))))
                yield from flush(size)
        yield from flush(1)

    keyed = found.select("point", "asks", "v").mapInArrow(
        place, "curve int, key long, point long, asks boolean, v array<double>"
    )
    shape = "part int, curve int, serial long, ids array<long>, vectors binary, query_ids array<long>, queries binary, centre array<double>, radius double"
    packs = staged(keyed.orderBy("curve", "key", "point").drop("key").mapInArrow(cut, shape), "windows")
    counts = packs.groupBy("curve", "part").agg(F.count("*").alias("n"))  # as many rows as tasks
    before = F.sum("n").over(Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("curve", "part", F.coalesce(before, F.lit(0)).alias("start"))
    numbered = packs.join(starts, ["curve", "part"]).withColumn("window", F.col("start") + F.col("serial"))
    return staged(numbered.drop("part", "start", "serial"), "numbered-windows")


def best_of(queries: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row of the query, ids, inner products) of its ``k`` best. Products of those are summed alike wherever they meet."""
    rough = queries @ vectors.T
    # the matrix product rounds in another way; whatever may reach the last place or tie with it is computed again
    longest = np.sqrt((vectors**2).sum(axis=1).max(initial=0))
    margins = 4 * vectors.shape[1] * np.finfo(float).eps * longest * np.sqrt((queries**2).sum(axis=1))
    for row, scores in enumerate(rough):
        last = np.partition(scores, -k)[-k] if len(scores) > k else -np.inf
        near = np.flatnonzero(~(scores < last - margins[row]))
        exact = (vectors[near] * queries[row]).sum(axis=1)
        order = np.lexsort((ids[near], -exact))[:k]
        yield row, ids[near][order], exact[order]


FOUND = "query long, point long, score double"


def _results(rows: list[tuple[int, np.ndarray, np.ndarray]], query_ids: np.ndarray) -> pa.RecordBatch:
    asked = [np.full(len(ids), query_ids[row]) for row, ids, _ in rows]
    join = lambda parts, kind: np.concatenate(parts) if parts else np.empty(0, kind)
    columns = [join(asked, np.int64), join([i for _, i, _ in rows], np.int64), join([s for *_, s in rows], np.float64)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query", "point", "score"])


def _unpacked(batch: pa.RecordBatch, row: int, ids: str, vectors: str) -> tuple[np.ndarray, np.ndarray]:
    names = np.array(batch.column(ids)[row].as_py(), np.int64)
    return names, np.frombuffer(batch.column(vectors)[row].as_py(), np.float64).reshape(len(names), -1)


def search_windows(packs: DataFrame, k: int) -> DataFrame:
    """``(query, point, score)``: each query's best of the windows around its own on every curve."""

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                asked, queries = _unpacked(batch, row, "query_ids", "queries")
                ids, vectors = _unpacked(batch, row, "ids", "vectors")
                yield _results(list(best_of(queries, vectors, ids, k)), asked)

    near = F.explode(F.sequence(F.col("window") - REACH, F.col("window") + REACH)).alias("window")
    asking = packs.where(F.size("query_ids") > 0).select("curve", near, "query_ids", "queries")
    return asking.join(packs.select("curve", "window", "ids", "vectors"), ["curve", "window"]).mapInArrow(meet, FOUND)


def best(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best points of each query; a point found more than once counts once."""
    once = found.groupBy("query", "point").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "point")
    return once.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def check_exactly(packs: DataFrame, first: DataFrame, k: int) -> DataFrame:
    """What the windows of the first curve add to the points in ``first`` (query, point, score, place).

    Queries go in groups along the curve. By the triangle inequality no product
    of a group's query and a window's vector exceeds a bound from both centres
    and radii; the pair is searched only if that bound reaches the least of the
    group's ``k``-th scores, and for a query only if its own bound does.
    """
    curve = packs.where("curve = 0")
    worst = first.groupBy("query").agg(F.max("place").alias("n"), F.min("score").alias("least"))
    worst = worst.select("query", F.when(F.col("n") >= k, F.col("least")).otherwise(F.lit(float("-inf"))).alias("least"))
    asking = curve.where(F.size("query_ids") > 0)
    group = F.floor(F.col("window") / GROUP).alias("grp")
    named = asking.select(group, "window", F.posexplode("query_ids").alias("spot", "query")).join(worst, "query")
    leasts = named.groupBy("window").agg(F.transform(F.array_sort(F.collect_list(F.struct("spot", "least"))), lambda s: s["least"]).alias("least"))

    def gather(table: pa.Table) -> pa.Table:
        ids = np.concatenate([np.array(i, np.int64) for i in table.column("query_ids").to_pylist()])
        vectors = np.concatenate([np.frombuffer(q, np.float64) for q in table.column("queries").to_pylist()]).reshape(len(ids), -1)
        least = np.concatenate([np.array(x) for x in table.column("least").to_pylist()])
        centre = vectors.mean(axis=0)
        radius = float(np.sqrt(((vectors - centre) ** 2).sum(axis=1).max()))
        return pa.table({
            "grp": table.column("grp")[:1], "query_ids": pa.array([ids.tolist()], pa.list_(pa.int64())), "queries": pa.array([vectors.tobytes()]),
            "least": pa.array([least.tobytes()]), "q_centre": pa.array([centre.tolist()], pa.list_(pa.float64())),
            "q_radius": pa.array([radius]), "bar": pa.array([float(least.min())]),
        })

    shape = "grp long, query_ids array<long>, queries binary, least binary, q_centre array<double>, q_radius double, bar double"
    packed = asking.select(group, "window", "query_ids", "queries").join(leasts, "window")
    groups = staged(packed.groupBy("grp").applyInArrow(gather, shape), "query-groups")

    bounds = curve.select("window", "centre", "radius")
    last = groups.agg(F.max("grp")).first()[0]
    pairs = None
    for start in range(0, (last if last is not None else -1) + 1, GROUPS_AT_ONCE):
        within = groups.where((F.col("grp") >= start) & (F.col("grp") < start + GROUPS_AT_ONCE))
        some = within.select("grp", "q_centre", "q_radius", "bar").collect()
        part = bounds.mapInArrow(_reachable([tuple(r) for r in some]), "grp long, window long")
        pairs = part if pairs is None else pairs.unionByName(part)
    if pairs is None:
        return first.select("query", "point", "score")

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                asked, queries = _unpacked(batch, row, "query_ids", "queries")
                ids, vectors = _unpacked(batch, row, "ids", "vectors")
                least = np.frombuffer(batch.column("least")[row].as_py(), np.float64)
                centre, radius = np.array(batch.column("centre")[row].as_py()), batch.column("radius")[row].as_py()
                may = np.flatnonzero(_slack(queries @ centre + np.sqrt((queries**2).sum(axis=1)) * radius) >= least)
                rows = [
                    (may[i], points_[scores >= least[may[i]]], scores[scores >= least[may[i]]])
                    for i, points_, scores in best_of(queries[may], vectors, ids, k)
                ]
                yield _results(rows, asked)

    window_rows = curve.select("window", "ids", "vectors", "centre", "radius")
    group_rows = groups.select("grp", "query_ids", "queries", "least")
    return pairs.join(window_rows, "window").join(group_rows, "grp").mapInArrow(meet, FOUND)


def _slack(bound: np.ndarray) -> np.ndarray:
    """A little above the bound, for rounding."""
    return bound + 1e-9 * (1 + np.abs(bound))


def _reachable(groups: list[tuple]) -> Callable:
    """For each window, the groups of queries to which it may add something."""
    numbers = np.array([g[0] for g in groups], np.int64)
    centres, radii, bars = np.array([g[1] for g in groups]), np.array([g[2] for g in groups]), np.array([g[3] for g in groups])

    def reach(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = np.sqrt((centres**2).sum(axis=1))
        for batch in batches:
            for row in range(batch.num_rows):
                centre, radius = np.array(batch.column("centre")[row].as_py()), batch.column("radius")[row].as_py()
                bound = centres @ centre + lengths * radius + radii * (np.sqrt((centre**2).sum()) + radius)
                met = numbers[_slack(bound) >= bars]
                window = np.full(len(met), batch.column("window")[row].as_py(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(window)], names=["grp", "window"])

    return reach


def nearest(vectors: DataFrame, asks: Column, k: int = K, curves: int = CURVES, exact: bool = True) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each asking row its ``k`` nearest others by inner product.

    ``vectors`` has vec_id and embedding; ``asks`` says which vec_ids are queries.
    Nearest first, ties to the smaller vec_id; fewer than ``k`` others are all
    returned. Rows of equal id and vector are one; a row of another vector under
    the query's own id counts as the query's own. See :func:`usable` for rows
    that take no part. Projections are fitted on ``SAMPLE`` vectors, every vector
    is indexed. ``exact=False`` leaves out the check and keeps the windows' answer.
    """
    small_batches(vectors.sparkSession)
    rows = staged(usable(vectors).withColumn("asks", asks), "vectors")
    found = staged(points(rows, F.col("asks"), k), "points")
    sample = found.orderBy(F.xxhash64("point")).limit(SAMPLE).select("v").collect()
    fitted = np.array([r["v"] for r in sample], np.float64) if sample else np.ones((1, 1))
    packs = windows(found, fit_curves(fitted, curves))
    result = staged(best(search_windows(packs, k + 1), k + 1), "found")
    if exact:
        more = check_exactly(packs, result, k + 1)
        result = best(result.select("query", "point", "score").unionByName(more), k + 1)
    named = result.join(found.select("point", F.explode("ids").alias("vec_id")), "point")
    asked = rows.where("asks").select(F.col("vec_id").alias("query_id"), "v").distinct()
    by_point = asked.join(found.select("v", F.col("point").alias("query")), "v").select("query", "query_id")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    kept = named.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
    listed = kept.select("query", "vec_id", "score").join(by_point, "query").where("vec_id != query_id")
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = listed.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
