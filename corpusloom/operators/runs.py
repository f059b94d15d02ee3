"""Training run logs and checkpoint choice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from corpusloom.operators.ordering import id_buckets, running

# How a log line and a checkpoint name are written.
LOG_FIELDS = {
    "step": (r"step:(\d+)/", "long"),
    "total_steps": (r"step:\d+/(\d+)", "long"),
    "train_loss": (r"train_loss:([0-9.]+)", "double"),
    "val_loss": (r"val_loss:([0-9.]+)", "double"),
    "train_time": (r"train_time:(\d+)ms", "long"),
    "step_avg": (r"step_avg:([0-9.]+)ms", "double"),
}
CHECKPOINT_NAME = r"best_state_step(\d+)_val([0-9.]+)\.pt$"


def parse_log_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """Add one typed column per log field; a field a line lacks is null."""
    fields = [
        F.nullif(F.regexp_extract(line, pattern, 1), F.lit("")).try_cast(kind).alias(name)
        for name, (pattern, kind) in LOG_FIELDS.items()
    ]
    return lines.select("*", *fields)


def parse_checkpoints(paths: DataFrame, path: str = "path") -> DataFrame:
    """Add ``step`` and ``val_loss`` from the file name; other files are left out."""
    named = paths.where(F.col(path).rlike(CHECKPOINT_NAME))
    return named.select(
        "*",
        F.regexp_extract(path, CHECKPOINT_NAME, 1).try_cast("long").alias("step"),
        F.regexp_extract(path, CHECKPOINT_NAME, 2).try_cast("double").alias("val_loss"),
    )


def run_summary(logs: DataFrame) -> DataFrame:
    """Best and last validation loss, last step and mean step time of each run."""
    evaluated = F.col("val_loss").isNotNull()
    return logs.groupBy("run").agg(
        F.min("val_loss").alias("best_val"),
        F.max("step").alias("last_step"),
        F.max_by("val_loss", F.when(evaluated, F.col("step"))).alias("last_val"),
        F.avg("step_avg").alias("mean_step_ms"),
    )


def train_loss_since_eval(steps: DataFrame) -> DataFrame:
    """Mean training loss of the steps up to each evaluation, counted anew after it.

    Steps after the last evaluation form a window without ``eval_step``.
    """
    is_eval = F.col("val_loss").isNotNull()
    counted = running(
        steps.select("run", "step", "train_loss", "val_loss"),
        "eval_no",
        is_eval.cast("long"),
        [F.col("step")],
        id_buckets(F.col("step")),
        ["run"],
    )
    return counted.groupBy("run", "eval_no").agg(
        F.max(F.when(is_eval, F.col("step"))).alias("eval_step"),
        F.count("train_loss").alias("steps"),
        F.avg("train_loss").alias("mean_train_loss"),
    )


def best_per_group(checkpoints: DataFrame, by: Sequence[str] = ("representation", "size")) -> DataFrame:
    """Lowest validation loss per group, the later step on ties.

    A minimum over a struct is pre-aggregated, unlike a ranking window.
    """
    rest = [c for c in checkpoints.columns if c not in (*by, "val_loss", "step")]
    candidate = F.struct("val_loss", (-F.col("step")).alias("neg_step"), *rest)
    best = checkpoints.groupBy(*by).agg(F.min(candidate).alias("best"))
    return best.select(
        *by, (-F.col("best.neg_step")).alias("step"), "best.val_loss", *[F.col(f"best.{c}").alias(c) for c in rest]
    )


def require_found(best: DataFrame, groups: DataFrame, by: Sequence[str] = ("representation", "size")) -> DataFrame:
    """``best`` for every requested group; a group without a checkpoint fails the job."""
    message = F.concat(F.lit("no checkpoint for "), F.concat_ws("/", *by))
    found = groups.join(best, list(by), "left")
    return found.withColumn(
        "step", F.when(F.col("step").isNotNull(), F.col("step")).otherwise(F.raise_error(message).cast("long"))
    )


def best_so_far(evaluations: DataFrame, order: str = "step", by: str = "run") -> DataFrame:
    """Evaluations strictly better than all earlier ones, with the loss they replace (``prev_best``)."""
    scored = evaluations.where(F.col("val_loss").isNotNull())
    marked = running(
        scored, "prev_best", F.col("val_loss"), [F.col(order)], id_buckets(F.col(order)), [by], op="min"
    )
    return marked.where(F.col("prev_best").isNull() | (F.col("val_loss") < F.col("prev_best")))
