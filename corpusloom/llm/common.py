"""Small helpers that several operators share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from corpusloom.session import staged

WORD = r"[^\x20\x09-\x0D]+"  # bytes.split() of the UTF-8 text cuts at the same characters


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Let Spark hand over Arrow batches of a few megabytes, unless the session says otherwise.

    By default a batch has 10,000 rows, whatever their size; of long texts that is
    more than a task should hold twice, in the JVM and in Python.
    """
    for name, value in (("maxRecordsPerBatch", "2000"), ("maxBytesPerBatch", "8m")):
        if spark.conf.get(f"spark.sql.execution.arrow.{name}", None) is None:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", value)


def remainder(key: str, divisor: int) -> Column:
    """crc32 of the column as text, modulo ``divisor``; a null counts as empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % divisor


def raw(column: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of each text, without decoding; a null is empty."""
    for value in column.cast(pa.large_binary()):
        yield value.as_py() or b""


def sample_texts(docs: DataFrame, groups: DataFrame, per_group: int, rows: int) -> list:
    """A bounded sample ``(doc_id, grp, text)`` of ``docs``, even over the column ``grp`` of ``groups`` (doc_id, grp).

    The first ``per_group`` ids of each group by a digest, ``rows`` in all; the
    bounds are documented parameters of the callers. ``groups`` should name only
    ids whose text is not empty, as others would take up places for nothing. Groups are counted first,
    and only ids whose digest lies in the needed share of all digests (with some
    margin) are ranked, so that a frequent group does not meet in one task. Of
    rows with equal ids one is taken; null ids and null or empty texts are not.
    """
    digest = F.xxhash64(F.lit(20240229), F.col("doc_id"))
    known = groups.where("doc_id IS NOT NULL AND grp IS NOT NULL").select("doc_id", "grp", digest.alias("digest"))
    needed = F.lit(per_group + 6 * per_group**0.5 + 20) / F.count("*")
    shares = known.groupBy("grp").agg(needed.alias("share")).withColumnRenamed("grp", "of")
    shares = staged(shares, "shares")  # of known size, so that few groups are shared before the ids are shuffled
    unit = F.shiftrightunsigned("digest", 11) / F.lit(float(1 << 53))
    few = known.join(shares, F.col("grp") == F.col("of")).where(unit < F.col("share"))
    place = F.row_number().over(Window.partitionBy("grp").orderBy(unit, "doc_id"))
    kept = few.withColumn("place", place).where(F.col("place") <= per_group)
    picked = {r["doc_id"]: r for r in kept.orderBy("place", unit, "grp", "doc_id").limit(rows).collect()}
    if not picked:
        return []
    keys = docs.sparkSession.createDataFrame([(r["doc_id"], str(r["grp"])) for r in picked.values()], "doc_id long, grp string")
    found = docs.where(F.length("text") > 0).select("doc_id", "text").join(F.broadcast(keys), "doc_id")
    first = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"))
    once = found.withColumn("__first", F.row_number().over(first)).where("__first = 1").drop("__first")
    got = {r["doc_id"]: r for r in once.collect()}
    return [got[k] for k in picked if k in got]
