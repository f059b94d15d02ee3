"""Token loss and the report over languages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.functions.arrays import IGNORE
from corpusloom.operators.vocabulary import BROADCAST_ROWS, lookup


def unigram_scores(vocab: DataFrame) -> DataFrame:
    """``(id, logp)``: add-one smoothed log-probability of each vocabulary entry.

    Stands in for a model's scores where none are given. The totals come from
    one extra pass over the vocabulary, which is small.
    """
    total = vocab.agg((F.sum("cnt") + F.count(F.lit(1))).alias("mass")).scalar()
    return vocab.select("id", F.log((F.col("cnt") + 1) / total).alias("logp"))


def score_labels(
    packs: DataFrame,
    scores: DataFrame,
    keep: Sequence[str] = ("language",),
    score_rows: int | None = None,
    limit: int = BROADCAST_ROWS,
) -> DataFrame:
    """One row per scored label: ``keep``, ``label``, ``logp``. Rows without any stay, with nulls."""
    scored = F.filter("labels", lambda x: x != IGNORE)
    long = packs.select(*keep, F.explode_outer(scored).alias("id"))
    return lookup(long, scores, "id", score_rows, limit).select(*keep, F.col("id").alias("label"), "logp")


def token_loss(rows: DataFrame, by: str = "language") -> DataFrame:
    """``(by, num_tokens, loss)`` from aligned ``(label, logp)`` rows; NaN for a group with no token.

    The caller aligns labels with scores (with or without a shift by one).
    """
    used = F.col("label").isNotNull() & (F.col("label") != IGNORE)
    count = F.sum(used.cast("long"))
    total = F.sum(F.when(used, -F.col("logp")))
    return rows.groupBy(by).agg(
        count.alias("num_tokens"),
        F.when(count > 0, total / F.greatest(count, F.lit(1))).otherwise(F.lit(float("nan"))).alias("loss"),
    )


def summarise_groups(
    rows: DataFrame, metrics: Sequence[str], count: str, by: str = "language", skip_nan: bool = True
) -> DataFrame:
    """Per-group rows, then ``macro`` (plain mean) and ``weighted`` (by ``count``).

    ``position`` orders them: 0 groups, 1 macro, 2 weighted. With ``skip_nan``
    a group without a value is left out of that metric's means. Each row is
    counted towards its three lines at once, so ``rows`` is computed only once.
    """
    lines = F.array(
        F.struct(F.col(by).alias(by), F.lit(0).alias("position")),
        F.struct(F.lit("macro").alias(by), F.lit(1).alias("position")),
        F.struct(F.lit("weighted").alias(by), F.lit(2).alias("position")),
    )
    spread = rows.select(F.inline(lines), count, *metrics)

    def summed_up(metric: str) -> Column:
        value = F.nanvl(F.col(metric), F.lit(None).cast("double")) if skip_nan else F.col(metric)
        weight = F.when(value.isNotNull(), F.col(count))
        weighted = F.sum(value * F.col(count)) / F.greatest(F.sum(weight), F.lit(1))
        position = F.col("position")
        return F.when(position == 0, F.max(metric)).when(position == 1, F.avg(value)).otherwise(weighted).alias(metric)

    summary = spread.groupBy(by, "position").agg(F.sum(count).alias(count), *[summed_up(m) for m in metrics])
    return summary.select(by, count, *metrics, "position")
