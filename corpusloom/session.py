"""Session set-up and shared scratch space."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "corpusloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are tuned for.

    Keyword arguments override the defaults; write dots as double underscores
    (``spark__sql__shuffle__partitions="2000"``).
    """
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for checkpoints and staged tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session may
    go without: it gets a temporary folder, since driver and tasks share a disk.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="corpusloom-"))
    return spark.sparkContext.getCheckpointDir()


def scratch_folder(spark: SparkSession, label: str) -> str:
    """A new, unused folder below the checkpoint folder."""
    return f"{checkpoint_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


class Scratch:
    """Owner of staged tables: they are removed when its block ends.

    For jobs that have written their result by then. A table that a returned
    DataFrame still reads must not have an owner.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> "Scratch":
        return self

    def __exit__(self, *error) -> None:
        for path in self.paths:
            remove_folder(self.spark, path)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store it is."""
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def staged(df: DataFrame, label: str, owner: Scratch | None = None) -> DataFrame:
    """Write ``df`` once to shared storage and read it back.

    Use it where a costly result has several readers: they then scan a small
    columnar table, and a lost executor costs a re-read, not a recomputation.
    """
    path = scratch_folder(df.sparkSession, label)
    if owner:
        owner.paths.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
