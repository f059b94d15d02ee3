"""Datasets, packs, examples and reports on files."""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from corpusloom.session import staged

FILES_PER_JOIN = 250_000  # some 40 MB of names


def read_dataset(
    spark: SparkSession, path: str, config: str | None = None, split: str | None = "train", fmt: str = "parquet"
) -> DataFrame:
    """One split of a dataset; ``config`` and ``split`` are partition columns if the folder has them.

    Both filters are on partition columns, so other folders are not read.
    """
    df = spark.read.format(fmt).load(path)
    for column, wanted in (("config", config), ("split", split)):
        if wanted is None:
            continue
        if column in df.columns:
            df = df.where(F.col(column) == wanted)
        elif column == "config":
            raise ValueError(f"{path} has no configurations")
    return df


def number_rows(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of parquet files with their position in the dataset: files by name, rows in file order.

    The position of a file is the sum of the rows before it, from one count per
    file that reads no data columns. It is joined to the rows by broadcast, for
    at most ``FILES_PER_JOIN`` files at a time: more files are dealt into groups,
    and Spark lists only a group's files for its part of the union. So each file
    is read once, and no row is sorted or moved, whatever the number of files.
    """
    columns = rows.columns
    placed = rows.select(
        "*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row")
    )
    files = placed.groupBy("__file").agg((F.max("__row") + 1).alias("__rows"))
    earlier = Window.partitionBy(F.lit(0)).orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("__rows").over(earlier), F.lit(0))  # one row per file, as the driver lists them itself
    starts = staged(files.select("__file", before.alias("__start")), "files")
    groups = max(1, -(-starts.count() // FILES_PER_JOIN))
    parts = []
    for group in range(groups):
        own = rows.where(_group_of(F.col("_metadata.file_path"), groups) == group) if groups > 1 else rows
        own = own.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
        few = starts.where(_group_of(F.col("__file"), groups) == group)
        joined = own.join(F.broadcast(few), "__file").withColumn(key, F.col("__start") + F.col("__row"))
        parts.append(joined.select(*columns, key))
    return reduce(DataFrame.unionByName, parts)


def _group_of(path, groups: int):
    return F.pmod(F.xxhash64(path), F.lit(groups))


def read_numbered(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """All parquet rows below ``path``, numbered by :func:`number_rows`."""
    return number_rows(spark.read.parquet(path), key)


def read_languages(spark: SparkSession, root: str, languages: Sequence[str], split: str | None = None) -> DataFrame:
    """All listed languages in one scan of folders ``language=...``, others pruned."""
    df = spark.read.parquet(root).where(F.col("language").isin(*languages))
    return df.where(F.col("split") == split) if split else df


def write_partitioned(df: DataFrame, path: str, by: Sequence[str], mode: str = "errorifexists") -> None:
    df.write.mode(mode).partitionBy(*by).parquet(path)


def write_examples(df: DataFrame, path: str, force: bool = False) -> None:
    """Save examples; an existing folder is kept unless ``force``."""
    df.write.mode("overwrite" if force else "ignore").parquet(path)


def read_examples(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_packs(packs: DataFrame, path: str, metadata: dict, splits: Sequence[str]) -> None:
    """Save packs by split, then ``metadata.json`` with the row count of each split.

    Counts are taken from the written files, so the packs are computed once. The
    metadata comes last and marks the folder as complete; an empty split stops it.
    """
    spark = packs.sparkSession
    packs.write.mode("overwrite").partitionBy("split").parquet(f"{path}/packs")
    counted = {r["split"]: r["n"] for r in read_packs(spark, path).groupBy("split").agg(F.count("*").alias("n")).collect()}
    empty = [s for s in splits if not counted.get(s)]
    if empty:
        raise RuntimeError(f"no rows left in split {', '.join(empty)}")
    document = {**metadata, "splits": {s: counted[s] for s in splits}}
    write_document(spark, f"{path}/metadata.json", document)


def read_packs(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    df = spark.read.parquet(f"{path}/packs")
    return df.where(F.col("split") == split) if split else df


def packs_complete(spark: SparkSession, path: str) -> bool:
    """Whether an earlier build finished, so that it can be used again."""
    target = f"{path}/metadata.json"
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(target)
    return hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop_path)


def write_document(spark: SparkSession, path: str, document: dict) -> None:
    """A small JSON document as a one-row table; values that JSON has no number for become null."""
    text = json.dumps(_plain(document), ensure_ascii=True, allow_nan=False)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def _plain(value):
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    return None if isinstance(value, float) and not math.isfinite(value) else value


def read_document(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first()["value"])


def write_report(report: DataFrame, path: str, order: Sequence[str], fmt: str = "json") -> None:
    """A metric table as one JSON or CSV file in the given row order.

    Reports have one row per language or class, hence the single file.
    """
    ordered = report.coalesce(1).sortWithinPartitions(*order)
    writer = ordered.write.mode("overwrite")
    if fmt == "json":
        writer.json(path)
    elif fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        raise ValueError(f"unknown report format: {fmt}")
