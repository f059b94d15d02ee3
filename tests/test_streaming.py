from datetime import datetime

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import vocabulary as V
from corpusloom.sources import shards as SH
from corpusloom.streaming import streams as ST


def add(df, folder):
    df.coalesce(1).write.mode("append").parquet(str(folder))


def test_tokens_and_counts_over_two_arrivals(spark, tmp_path):
    schema = "doc_id long, lang string, text string"
    first = spark.createDataFrame([(0, "en", "a b a"), (1, "de", "c")], schema)
    second = spark.createDataFrame([(2, "en", "b zzz"), (3, "en", "")], schema)
    vocab = V.build_vocab(first, 10)
    for batch in (first, second):  # the second start continues from the checkpoint
        add(batch, tmp_path / "in")
        stream = ST.read_stream(spark, str(tmp_path / "in"), first.schema)
        ST.drain(ST.stream_tokenize(stream, vocab, str(tmp_path / "out"), str(tmp_path / "s1")))
        ST.drain(ST.stream_count_tokens(stream, str(tmp_path / "n"), str(tmp_path / "s2")))
    got = sorted((r.doc_id, r.ids) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    batch = V.tokenize_corpus(first.union(second), vocab)
    assert got == sorted((r.doc_id, r.ids) for r in batch.collect()) and got[2:] == [(2, [5, V.UNK]), (3, [])]
    totals = {r.lang: (r.docs, r.tokens) for r in ST.latest_totals(spark, str(tmp_path / "n")).collect()}
    assert totals == {"en": (3, 5), "de": (1, 1)}


@pytest.mark.parametrize("keyed", [False, True])
def test_best_so_far_over_batches(spark, tmp_path, keyed):
    schema = "run long, step long, val_loss double"
    arrivals = [
        [(0, 25, 5.0), (0, 50, 4.0), (1, 25, 7.0)],
        [(0, 75, 4.0), (0, 30, 1.0), (0, 100, 3.0), (1, 50, 8.0)],  # step 30 comes late
        [(1, 75, 6.0), (2, 25, 2.0)],
    ]
    for rows in arrivals:  # every start continues from the checkpoint
        add(spark.createDataFrame(rows, schema), tmp_path / "in")
        stream = ST.read_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema)
        if keyed:
            ST.drain(ST.stream_best_by_key(stream, str(tmp_path / "out" / "improvements"), str(tmp_path / "state")))
        else:
            ST.drain(ST.stream_best_so_far(stream, str(tmp_path / "out"), str(tmp_path / "state")))
    got = spark.read.parquet(str(tmp_path / "out" / "improvements")).select("run", "step", "prev_best")
    assert sorted(tuple(r) for r in got.where("prev_best is not null").collect()) == [
        (0, 50, 5.0), (0, 100, 4.0), (1, 75, 7.0),
    ]
    assert sorted(tuple(r)[:2] for r in got.where("prev_best is null").collect()) == [(0, 25), (1, 25), (2, 25)]


def test_vocabulary_is_fetched_once(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(i, "a b") for i in range(4)], "doc_id long, text string")
    vocab, fetched = V.build_vocab(docs), []
    monkeypatch.setattr(ST, "vocab_column", lambda *a, f=ST.vocab_column: fetched.append(1) or f(*a))
    monkeypatch.setattr(V, "vocab_column", lambda *a: pytest.fail("fetched for a batch"))
    for i in range(3):
        add(docs.where(F.col("doc_id") == i), tmp_path / "in")
    stream = ST.read_stream(spark, str(tmp_path / "in"), docs.schema, files_per_batch=1)
    ST.drain(ST.stream_tokenize(stream, vocab, str(tmp_path / "out"), str(tmp_path / "s")))
    assert spark.read.parquet(str(tmp_path / "out")).select("batch").distinct().count() == 3 and len(fetched) == 1


def test_shards_are_counted_as_they_arrive(spark, tmp_path):
    folder, out, state = (str(tmp_path / n) for n in ("shards", "out", "state"))

    def put(*numbers):
        pieces = [(n, 0, list(range(n + 5))) for n in numbers]
        SH.write_token_shards(spark.createDataFrame(pieces, "shard long, lo long, ids array<int>"), folder, 1, mode="append")

    def counted():
        ST.drain(ST.stream_shard_counts(spark, folder, out, state))
        return {r.split: (r.files, r.tokens) for r in ST.latest_by_key(spark, out, ["split"]).collect()}

    put(0, 1, 2)
    assert counted() == {"val": (1, 5), "train": (2, 13)}
    put(4)  # waits for number 3
    assert counted() == {"val": (1, 5), "train": (2, 13)}
    put(3)
    assert counted() == {"val": (1, 5), "train": (4, 30)}
    headers = SH.scan_shard_headers(spark, folder).groupBy("split").agg(F.count("*"), F.sum("tokens"))
    assert {r[0]: (r[1], r[2]) for r in headers.collect()} == counted()
    chunks = SH.stream_token_shards(spark, folder, split="train").select("file", "ids")
    query = chunks.writeStream.format("parquet").option("path", f"{out}-ids").option("checkpointLocation", f"{state}-ids")
    ST.drain(query.trigger(availableNow=True).start())
    assert {r.file: r.ids for r in spark.read.parquet(f"{out}-ids").collect()} == {f"data_train_{n:06d}.bin": list(range(n + 5)) for n in (1, 2, 3, 4)}


def test_windows_drop_events_behind_the_watermark(spark, tmp_path):
    schema = "ts timestamp, loss double, correct boolean"

    def at(hour, minute, loss, correct=True):
        return (datetime(2024, 1, 1, hour, minute), loss, correct)

    arrivals = [
        [at(0, 5, 1.0), at(0, 50, 3.0, False), at(3, 0, 9.0)],
        [at(0, 10, 100.0), at(5, 0, 1.0)],  # the first is later than the watermark of 02:30
    ]
    for rows in arrivals:
        add(spark.createDataFrame(rows, schema), tmp_path / "in")
        stream = ST.read_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema)
        ST.drain(
            ST.stream_windowed_metrics(
                stream, str(tmp_path / "out"), str(tmp_path / "state"), length="1 hour", delay="30 minutes"
            )
        )
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("window_start").collect()
    assert [(r.window_start.hour, r.n, r.mean_loss, r.accuracy) for r in got] == [(0, 2, 2.0, 0.5), (3, 1, 9.0, 1.0)]
