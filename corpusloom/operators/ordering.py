"""Running totals and positions over a whole table, without a one-task window.

Spark rows have no order, and a window without PARTITION BY (or with one hot
partition) moves its rows to a single task. The operators here split the sort
order into nested buckets that are computed from the key alone, so no sampling
and no driver step is needed. Each bucket holds a bounded number of rows, also
if one ``by`` value owns a third of the table:

1. add up the values per bucket (partial aggregation on the map side);
2. from the coarsest level down, turn the totals into starting values;
3. run the window inside each finest bucket, with the starting value put in as
   one extra row that sorts first. No join is needed for it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusloom.functions.text import digest_number, seeded_key

ID_SHIFTS = (40, 18)  # at most 2^23 spans of 2^22 buckets of 2^18 ids: all non-negative longs
DIGEST_SHIFTS = (28,)  # at most 2^20 buckets, filled evenly
TIME_SHIFTS = (40, 24)  # some 12 days, then some 16 seconds

_OPS = {"sum": F.sum, "min": F.min, "max": F.max}


def id_buckets(key: Column, shifts: Sequence[int] = ID_SHIFTS) -> list[Column]:
    """Nested buckets of a non-negative integer key; a negative one or a null fails the job."""
    key = key.cast("long")
    message = F.concat(F.lit("ordering key below 0: "), F.coalesce(key.cast("string"), F.lit("null")))
    safe = F.when(key >= 0, key).otherwise(F.raise_error(message).cast("long"))
    return [F.shiftright(safe, s) for s in shifts]


def digest_buckets(digest: Column, shifts: Sequence[int] = DIGEST_SHIFTS) -> list[Column]:
    """Nested buckets of a hex digest; digests spread evenly by nature."""
    number = digest_number(digest)
    return [F.shiftright(number, s) for s in shifts]


def time_buckets(ts: Column, tie: Column) -> list[Column]:
    """Nested buckets for the order (timestamp, integer id).

    A span of time holds any number of rows, a default date say a third of the
    table. So the exact timestamp and the id split it further.
    """
    micros = F.unix_micros(ts.cast("timestamp"))
    return [*[F.shiftright(micros, s) for s in TIME_SHIFTS], micros, *id_buckets(tie)]


def running(
    df: DataFrame,
    name: str,
    value: Column,
    order: Sequence[Column],
    buckets: Sequence[Column],
    by: Sequence[str] = (),
    op: str = "sum",
    starts: Sequence[tuple] | None = None,
) -> DataFrame:
    """Add ``name``: ``op`` of ``value`` over all rows that sort before this one.

    ``buckets`` go from coarse to fine and must agree with ``order``: a row in a
    lower bucket sorts first. The first row of a group gets 0 for ``sum`` and
    null for ``min`` and ``max``. A null in ``by`` forms its own group.

    ``starts`` has the coarsest bucket's values with what ``op`` gives before
    each, where these few are known beforehand (without ``by``); they are then
    not computed.

    The input is read twice, once for its key and value alone: pass a table, or
    stage what is costly to compute. All columns of ``df`` pass the window, so
    keep it narrow and join wide columns afterwards.
    """
    combine = _OPS[op]
    levels = [f"__level{i}" for i in range(len(buckets))]
    by = list(by)
    rows = df.select("*", value.alias("__value"), *[b.alias(n) for b, n in zip(buckets, levels)])
    totals = {}
    below = rows
    known = starts is not None
    for depth in range(len(levels), int(known), -1):
        below = below.groupBy(*by, *levels[:depth]).agg(combine("__value").alias("__value"))
        totals[depth] = below
    seeds = None
    if known:
        kinds = [f"{levels[0]} {rows.schema[levels[0]].dataType.simpleString()}", f"__value {rows.schema['__value'].dataType.simpleString()}"]
        seeds = df.sparkSession.createDataFrame(list(starts), ", ".join(kinds))
    for depth in range(1 + known, len(levels) + 1):
        started = _scan(totals[depth], seeds, by + levels[: depth - 1], [F.col(levels[depth - 1])], combine)
        seeds = started.select(*by, *levels[:depth], F.col("__before").alias("__value"))
    result = _scan(rows, seeds, by + levels, list(order), combine)
    before = F.coalesce("__before", F.lit(0)) if op == "sum" else F.col("__before")
    return result.select(*df.columns, before.alias(name))


def _scan(rows: DataFrame, seeds: DataFrame | None, group: list[str], order: list[Column], combine) -> DataFrame:
    """Exclusive running value inside ``group``, which starts from the seed row."""
    tagged = rows.withColumn("__rank", F.lit(1))
    if seeds is not None:
        tagged = tagged.unionByName(seeds.withColumn("__rank", F.lit(0)), allowMissingColumns=True)
    window = Window.partitionBy(*(group or [F.lit(0)])).orderBy("__rank", *order)
    before = combine("__value").over(window.rowsBetween(Window.unboundedPreceding, -1))
    return tagged.withColumn("__before", before).where("__rank = 1")


def head_rows(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int, salts: int = 1024) -> DataFrame:
    """The first ``n`` rows of each group, for keys of any type and any ``n``.

    A group is cut by a digest of its row; each part gives its first ``n`` rows,
    and those of all parts give the group's. A group that owns a third of the
    table is thus ranked in ``salts`` tasks.
    """
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts)))
    for group in ([*by, "__salt"], list(by)):
        place = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
        salted = salted.withColumn("__place", place).where(F.col("__place") <= n).drop("__place")
    return salted.drop("__salt")


def row_index(df: DataFrame, key: str, by: Sequence[str] = (), name: str = "row_index") -> DataFrame:
    """Zero-based position inside ``by`` in the order of a unique integer key."""
    return running(df, name, F.lit(1).cast("long"), [F.col(key)], id_buckets(F.col(key)), by)


def shuffled_index(
    df: DataFrame, seed: int, key: Sequence[str], by: Sequence[str] = (), name: str = "out_pos"
) -> DataFrame:
    """Zero-based position inside ``by`` after a reproducible shuffle.

    The order is the digest of ``seed`` and ``key``, then ``key`` itself, so it
    does not depend on partitions, and equal seeds give equal results anywhere.
    """
    digest = seeded_key(seed, *[F.col(k) for k in key])
    keyed = df.withColumn("__digest", digest)
    placed = running(
        keyed,
        name,
        F.lit(1).cast("long"),
        [F.col("__digest"), *[F.col(k) for k in key]],
        digest_buckets(F.col("__digest")),
        by,
    )
    return placed.drop("__digest")
