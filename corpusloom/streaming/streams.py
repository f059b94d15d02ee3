"""Structured Streaming forms of tokenization, counting and run tracking.

Each function takes a streaming DataFrame and starts a query that writes files;
``drain`` runs it over what is there now. Sinks and state live in the shared
checkpoint folder, and a restarted query continues where it stopped.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from corpusloom.functions.text import piece_count
from corpusloom.operators.runs import best_so_far
from corpusloom.operators.vocabulary import UNK, tokenize_corpus, vocab_column
from corpusloom.session import Scratch, staged
from corpusloom.sources.shards import stream_token_shards


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_stream(
    spark: SparkSession, folder: str, schema, pattern: str = "*.parquet", files_per_batch: int | None = None
) -> DataFrame:
    """New parquet files in ``folder`` whose names match ``pattern``."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def drain(query: StreamingQuery) -> None:
    query.awaitTermination()


def stream_tokenize(
    docs: DataFrame, vocab: DataFrame, path: str, checkpoint: str, key: str = "doc_id"
) -> StreamingQuery:
    """Rows ``(key, ids)`` of new documents, against a fixed vocabulary; one row per document.

    The vocabulary is fetched once, when the query starts. A batch is encoded by
    the batch operator, without a shuffle while the vocabulary can be shared
    with the tasks. Every batch writes to a folder of
    its own number, so a repeated batch replaces its output.
    """

    code = vocab_column(vocab, "token", "id", UNK)

    def store(batch: DataFrame, number: int) -> None:
        coded = tokenize_corpus(batch, vocab, key=[key], code=code)
        coded.write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = docs.writeStream.option("checkpointLocation", checkpoint)
    return writer.foreachBatch(store).trigger(availableNow=True).start()


def stream_count_tokens(docs: DataFrame, path: str, checkpoint: str, by: str = "lang") -> StreamingQuery:
    """Running documents and tokens per group; ``path`` holds the latest totals of every batch."""
    counted = docs.groupBy(by).agg(
        F.count(F.lit(1)).alias("docs"), F.sum(piece_count("text").cast("long")).alias("tokens")
    )

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = counted.writeStream.outputMode("complete").option("checkpointLocation", checkpoint)
    return writer.foreachBatch(store).trigger(availableNow=True).start()


def latest_totals(spark: SparkSession, path: str) -> DataFrame:
    """The totals written by the last batch of :func:`stream_count_tokens`."""
    stored = spark.read.parquet(path)
    last = stored.agg(F.max("batch")).first()[0]
    return stored.where(F.col("batch") == last).drop("batch")


def stream_shard_counts(spark: SparkSession, folder: str, path: str, checkpoint: str) -> StreamingQuery:
    """Running number of shards and tokens per split, from the headers of shards as they arrive in ``folder``.

    Each batch writes the splits that changed; :func:`latest_by_key` has the totals.
    """
    headers = stream_token_shards(spark, folder, headers=True)
    counted = headers.groupBy("split").agg(F.count(F.lit(1)).alias("files"), F.sum("tokens").alias("tokens"))

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = counted.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
    return writer.foreachBatch(store).trigger(availableNow=True).start()


def latest_by_key(spark: SparkSession, path: str, key: Sequence[str]) -> DataFrame:
    """The newest row of each key among those that batches have written in update mode."""
    stored = spark.read.parquet(path)
    values = [c for c in stored.columns if c not in (*key, "batch")]
    newest = stored.groupBy(*key).agg(F.max_by(F.struct(*values), "batch").alias("newest"))
    return newest.select(*key, "newest.*")


def stream_windowed_metrics(
    events: DataFrame,
    path: str,
    checkpoint: str,
    length: str = "1 day",
    slide: str | None = None,
    delay: str = "1 hour",
    by: Sequence[str] = (),
) -> StreamingQuery:
    """Count, mean loss and accuracy per time window; a window is written once it is complete.

    Input: ``ts`` (timestamp), ``loss`` (double), ``correct`` (boolean).
    """
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    grouped = events.withWatermark("ts", delay).groupBy(window.alias("w"), *by)
    metrics = grouped.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("loss").alias("mean_loss"),
        F.avg(F.col("correct").cast("double")).alias("accuracy"),
    ).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, "n", "mean_loss", "accuracy")
    writer = metrics.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    return writer.option("path", path).trigger(availableNow=True).start()


def stream_best_so_far(evaluations: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Improvements ``(run, step, val_loss, prev_best)`` as evaluations arrive.

    A step not above the last one seen of its run is late and is left out. The
    state is one row per run (last step, best loss), kept as a table per batch.
    A batch is handled by the batch operator, seeded with the state: a busy run
    is therefore spread over tasks, which a per-key state function would not do.
    Every batch writes to folders of its own number, so a repeated batch
    replaces its output.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        state = _state_before(spark, path, number)
        known = batch.join(state.select("run", "last_step"), "run", "left")
        on_time = F.col("last_step").isNull() | (F.col("step") > F.col("last_step"))
        fresh = known.where(on_time).select("run", "step", "val_loss")
        seeds = state.select("run", F.col("last_step").alias("step"), F.col("best").alias("val_loss"))
        rows = fresh.withColumn("old", F.lit(False)).unionByName(seeds.withColumn("old", F.lit(True)))
        with Scratch(spark) as scratch:  # the arrivals are read once, what follows scans the stored rows
            rows = staged(rows, "arrivals", scratch)
            better = best_so_far(rows.where(F.col("val_loss").isNotNull())).where(~F.col("old")).drop("old")
            better.write.mode("overwrite").parquet(f"{path}/improvements/batch={number}")
            after = rows.groupBy("run").agg(F.max("step").alias("last_step"), F.min("val_loss").alias("best"))
            after.write.mode("overwrite").parquet(f"{path}/state/batch={number}")

    writer = evaluations.writeStream.option("checkpointLocation", checkpoint)
    return writer.foreachBatch(step).trigger(availableNow=True).start()


class BestOfRun(StatefulProcessor):
    """Per run one value: the last step seen and the best loss so far."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("best", "last_step long, best double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last, best = self.state.get() if self.state.exists() else (None, None)
        arrived = pd.concat(list(rows)).sort_values(["step", "val_loss"], kind="stable")
        fresh = arrived if last is None else arrived[arrived["step"] > last]
        better = []
        for step, loss in zip(fresh["step"].tolist(), fresh["val_loss"].tolist()):
            if pd.notna(loss) and (best is None or loss < best):
                better.append((key[0], step, loss, best))
                best = loss
        if len(fresh):
            self.state.update((int(fresh["step"].max()), best))
        columns = {"run": "int64", "step": "int64", "val_loss": "float64", "prev_best": "float64"}
        yield pd.DataFrame(better, columns=list(columns)).astype(columns)

    def close(self) -> None:
        pass


def stream_best_by_key(evaluations: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """As :func:`stream_best_so_far`, with Spark's keyed state: for many runs of ordinary size.

    A run's new rows and its state meet in one task, without a table per batch;
    a run with very many rows at once is better off with the batch form. The
    state is a value per run in the RocksDB store, checkpointed by Spark.
    """
    spark = evaluations.sparkSession
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, ROCKSDB)  # the only store with values of keyed state; read when the query starts
    try:
        shape = "run long, step long, val_loss double, prev_best double"
        better = evaluations.select("run", "step", "val_loss").groupBy("run").transformWithStateInPandas(
            BestOfRun(), outputStructType=shape, outputMode="Append", timeMode="None"
        )
        known = F.when(~F.isnan("prev_best"), F.col("prev_best"))
        rows = better.select("run", "step", "val_loss", known.alias("prev_best"))
        writer = rows.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
        return writer.option("path", path).trigger(availableNow=True).start()
    finally:
        if before is None:
            spark.conf.unset(STATE_STORE)
        else:
            spark.conf.set(STATE_STORE, before)


_STATE_SCHEMA = "run long, last_step long, best double"


def _state_before(spark: SparkSession, path: str, number: int) -> DataFrame:
    if number == 0:
        return spark.createDataFrame([], _STATE_SCHEMA)
    return spark.read.schema(_STATE_SCHEMA).parquet(f"{path}/state/batch={number - 1}")
