"""Run logs and checkpoint folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusloom.operators.runs import parse_checkpoints, parse_log_lines


def read_run_logs(spark: SparkSession, path: str, run_pattern: str = r"([^/]+)$") -> DataFrame:
    """Parsed lines of all log files; ``run`` is taken from the file name."""
    lines = spark.read.text(path).select(
        F.regexp_extract(F.col("_metadata.file_path"), run_pattern, 1).alias("run"), F.col("value").alias("line")
    )
    return parse_log_lines(lines)


def list_checkpoints(spark: SparkSession, root: str) -> DataFrame:
    """``(path, representation, size, step, val_loss)`` of all checkpoints below ``root``.

    Only the file listing is used; contents are not read.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "best_state_step*_val*.pt")
        .load(root)
        .select("path")
    )
    placed = files.select(
        "path",
        F.regexp_extract("path", r"models/([^/]+)/([^/]+)/", 1).alias("representation"),
        F.regexp_extract("path", r"models/([^/]+)/([^/]+)/", 2).alias("size"),
    )
    return parse_checkpoints(placed)
