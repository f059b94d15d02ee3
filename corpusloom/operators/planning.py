"""How many steps a corpus gives."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

TOKENS_PER_ITER = 524_288
SETUPS = {"large": TOKENS_PER_ITER, "small": 393_216}  # fixed values: tokens of a step in the larger and in the small set-up
WARMUP_SHARE, DECAY_SHARE = 0.1, 0.9  # fixed values


def count_tokens(headers: DataFrame) -> DataFrame:
    """``(file, tokens)`` per shard, and the total in the row without a file name."""
    return headers.rollup("file").agg(F.sum("tokens").alias("tokens"))


def train_files(headers: DataFrame) -> DataFrame:
    return headers.where(F.col("file").rlike(r"data_train_\d+\.bin$"))


def plan_iterations(headers: DataFrame, epochs: int = 1, tokens_per_iter: int = TOKENS_PER_ITER) -> DataFrame:
    """Tokens of all passes divided by the tokens of a step, rounded half to even."""
    total = headers.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))
    exact = F.col("tokens") * epochs / F.lit(tokens_per_iter)
    return total.select(
        "tokens",
        F.lit(epochs).alias("epochs"),
        (F.col("tokens") * epochs).alias("total_tokens"),
        F.bround(exact, 0).cast("long").alias("iterations"),
    )


def example_iterations(df: DataFrame, context: int, batch: int, accumulation: int, epochs: int) -> DataFrame:
    """Steps for fixed-width rows (padding counts), with warm-up and decay steps."""
    counted = df.agg(F.count(F.lit(1)).alias("examples"))
    per_step = accumulation * batch * context
    steps = (F.ceil(F.col("examples") * context / F.lit(per_step)) * epochs).cast("long")
    planned = counted.select("examples", steps.alias("max_iters"))
    return planned.select(
        "examples",
        "max_iters",
        F.floor(F.col("max_iters") * F.lit(WARMUP_SHARE)).alias("warmup"),
        F.floor(F.col("max_iters") * F.lit(DECAY_SHARE)).alias("decay"),
    )
