"""Mixing sources to target weights with hash-threshold histograms, in DataFrame functions only.

Each source gets a share of all words by its weight, at most ``MOST`` times its
own size. A share is met by whole copies of the source and by one more copy of
the documents whose hash lies below a threshold. The thresholds are nested: a
smaller share takes a subset of what a larger one takes. A threshold is found
from sums by source and hash bucket; only the bucket in which the share ends is
looked at again in finer buckets. No row is sorted, and no source is one group:
sums are combined before each shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusloom.llm.common import WORD
from corpusloom.session import staged

WEIGHTS = (5, 2, 1)
MOST = 3
LEVELS = 3
LEVEL_BITS = 12  # 4096 buckets a level; 36 bits tell documents apart
SEED = 17


def size(text: Column) -> Column:
    """Words of a text; a null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def place(doc_id: Column, text: Column, seed: int = SEED) -> Column:
    """A number of 36 bits that depends on the seed, the id and the text; the same on each run."""
    parts = [F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")), F.coalesce(text, F.lit(""))]
    digest = F.md5(F.concat_ws(":", *parts).cast("binary"))
    return F.conv(F.substring(digest, 1, LEVELS * LEVEL_BITS // 4), 16, 10).cast("long")


def ranked(sources: DataFrame) -> DataFrame:
    """Adds ``rank`` from 0 by code point, null last.

    The sort deals sources out by range; ranks are counted inside each range and
    shifted by the counts of the ranges before it, so sources need not fit in one task.
    """
    dealt = sources.orderBy(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id())
    dealt = staged(dealt, "sources")
    counts = dealt.groupBy("part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("part", F.coalesce(before, F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    return dealt.withColumn("inside", inside).join(starts, "part").withColumn("rank", F.col("start") + F.col("inside"))


def targets(sized: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``(source, source_size, target)``: all words shared by weight, no target above ``most`` times the source.

    The level is words per unit of weight. It rises while sources stop at their
    bound and the rest takes over the excess; only sums reach the driver.
    """
    sources = ranked(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    of_rank = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    sources = staged(
        sources.select("source", "source_size", of_rank.alias("weight"), (most * F.col("source_size")).alias("bound")),
        "targets",
    )
    stopped, bounds, level = -1, 0, None
    while True:
        full = F.lit(False) if level is None else F.col("bound") <= F.col("weight") * F.lit(level)
        sums = sources.agg(
            F.sum("source_size"), F.count_if(full), F.sum(F.when(full, F.col("bound"))), F.sum(F.when(~full, F.col("weight")))
        ).first()
        total, now, bounds, open_weight = sums[0] or 0, sums[1], sums[2] or 0, sums[3] or 0
        if now == stopped or not open_weight:
            break
        stopped, level = now, (total - bounds) / open_weight
    target = F.least(F.col("bound").cast("double"), F.col("weight") * F.lit(float(level or 0)))
    return sources.select("source", "source_size", target.alias("target"))


def _bucket(level: int) -> Column:
    return F.shiftright("place", (LEVELS - 1 - level) * LEVEL_BITS)


def thresholds(sized: DataFrame, shares: DataFrame) -> DataFrame:
    """Adds ``copies``, the whole copies, and ``threshold``: documents placed below it are taken once more.

    ``rest`` is what whole copies leave of the share. At each level the sums of
    a source's buckets are added up in order; only the rows of the bucket in
    which ``rest`` ends go on to the next level. At the last one the nearer bound is taken.
    """
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    found = shares.withColumn("copies", copies.cast("long"))
    found = found.withColumn("rest", F.col("target") - F.col("copies") * F.col("source_size"))
    open_ = staged(found.select(F.col("source").alias("s"), "rest", F.lit(0).cast("long").alias("at")), "rests")
    for level in range(LEVELS):
        same, kept = F.col("source").eqNullSafe(F.col("s")), sized
        if level:
            kept = sized.join(open_.drop("rest"), same & (_bucket(level - 1) == F.col("at"))).drop("s", "at")
        sums = kept.groupBy("source", _bucket(level).alias("bucket")).agg(F.sum("size").alias("words"))
        inside = sums.join(open_, same)
        order = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        upto = inside.withColumn("upto", F.sum("words").over(order))
        last = level == LEVELS - 1
        # the bucket in which the rest ends; at the last level the bucket goes in if half of it does
        due = F.col("upto") - F.col("words") / 2 if last else F.col("upto")
        ends = upto.groupBy("source").agg(
            F.min(F.when(due > F.col("rest"), F.struct("bucket", (F.col("upto") - F.col("words")).alias("before")))).alias("end"),
            F.first("rest").alias("rest"),
            F.max("bucket").alias("greatest"),
        )
        at = F.coalesce("end.bucket", F.col("greatest") + 1)
        left = F.col("rest") - F.coalesce("end.before", F.lit(0))
        open_ = staged(ends.select(F.col("source").alias("s"), left.alias("rest"), at.alias("at")), f"level{level}")
    plan = found.join(open_, F.col("source").eqNullSafe(F.col("s")), "left").select(
        "source", "source_size", "target", "copies", F.coalesce("at", F.lit(0)).alias("threshold")
    )
    return staged(plan, "mixture")  # as a table its size is known, so Spark shares it with the tasks if it is small


def mixture(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """The plan of a mixture: one row per source with its target, copies and threshold.

    Null and empty texts have size 0; a null source is a source of its own and
    sorts last; rows of equal id and text have the same place and are taken
    alike; an empty table gives an empty plan.
    """
    sized = docs.select("source", size(F.col("text")).alias("size"), place(F.col("doc_id"), F.col("text"), seed).alias("place"))
    sized = staged(sized, "sizes")
    return thresholds(sized, targets(sized, weights, most))


def taken_times(docs: DataFrame, plan: DataFrame, place_column: Column) -> DataFrame:
    """Adds ``__mix`` to documents: a struct of ``times`` (copies taken), ``source_size`` and ``target``."""
    named = plan.select(F.col("source").alias("__source"), F.struct(*plan.columns[1:]).alias("__plan"))
    times = F.col("__plan.copies") + F.when(place_column < F.col("__plan.threshold"), 1).otherwise(0)
    mix = F.struct(times.alias("times"), F.col("__plan.source_size").alias("source_size"), F.col("__plan.target").alias("target"))
    joined = docs.join(named, F.col("source").eqNullSafe(F.col("__source")))
    return joined.withColumn("__mix", mix).drop("__source", "__plan")


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """The mixture itself: every document as many times as it is taken, with its own columns."""
    plan = mixture(docs, weights, most, seed)
    marked = taken_times(docs, plan, place(F.col("doc_id"), F.col("text"), seed))
    repeated = F.explode(F.array_repeat(F.lit(True), F.col("__mix.times").cast("int"))).alias("__copy")
    return marked.select(*docs.columns, repeated).drop("__copy")


def mix_report(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """One row per document: its size, its source's size and target, and the words the mixture takes of it."""
    sized = docs.select(
        "doc_id", "source", size(F.col("text")).alias("size"), place(F.col("doc_id"), F.col("text"), seed).alias("place")
    )
    sized = staged(sized, "sizes")
    plan = thresholds(sized, targets(sized, weights, most))
    marked = taken_times(sized, plan, F.col("place"))
    return marked.select(
        "doc_id", "size", "__mix.source_size", "__mix.target", (F.col("size") * F.col("__mix.times")).alias("taken")
    )
