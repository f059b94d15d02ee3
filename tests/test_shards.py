import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import packing as P
from corpusloom.sources import shards as SH


def slices(spark, docs, size):
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "doc_id long, ids array<int>")
    placed = df.join(P.token_offsets(df.select("doc_id", F.size("ids").alias("n_ids"))), "doc_id")
    return P.cut_shards(placed, size, "ids")


DOCS = [list(range(7)), [65535], [], list(range(100, 123)), [1]]
STREAM = [t for d in DOCS for t in d]


def folder(path):
    return f"{path}/{open(f'{path}/_current').read()}"


def content(spark, path, **options):
    reader = spark.read.format("token_shards")
    for k, v in options.items():
        reader = reader.option(k, v)
    got = {}
    for r in reader.load(path).orderBy("file", "lo").collect():
        assert r.lo == len(got.setdefault(r.file, []))
        got[r.file] += r.ids
    return got


@pytest.mark.parametrize("version", [1, 2])
def test_round_trip_and_bytes(spark, tmp_path, version):
    path = str(tmp_path / "shards")
    SH.write_token_shards(slices(spark, DOCS, 10), path, version)
    names = ["data_val_000000.bin", "data_train_000001.bin", "data_train_000002.bin", "data_train_000003.bin"]
    assert sorted(os.listdir(folder(path))) == sorted(names)
    assert SH.scan_shard_headers(spark, path).count() == 4  # registers the source and lets filters through
    expected = {n: STREAM[i * 10 : i * 10 + 10] for i, n in enumerate(names)}
    assert content(spark, path) == expected
    assert content(spark, path, chunk=3, taskBytes=4) == expected  # many chunks, many tasks per file
    assert set(content(spark, path, split="train")) == set(names[1:])
    raw = np.fromfile(f"{folder(path)}/{names[1]}", dtype="<i4", count=256)
    assert raw[:3].tolist() == [20240520, version, 10] and raw[3] == (0 if version == 1 else 32)
    body = np.fromfile(f"{folder(path)}/{names[1]}", dtype="<u2" if version == 1 else "<u4", offset=1024)
    assert body.tolist() == expected[names[1]]
    headers = {r.file: (r.split, r.shard_index, r.tokens) for r in SH.scan_shard_headers(spark, path).collect()}
    assert headers[names[0]] == ("val", 0, 10) and headers[names[3]] == ("train", 3, 2)
    batches = P.train_batches(SH.read_token_shards(spark, path), 3, 2)
    assert {(r.file, r.rank): r.ids for r in batches.collect()}[(names[1], 1)] == expected[names[1]][3:7]


def test_overwrite_leaves_only_the_new_shards(spark, tmp_path):
    path = str(tmp_path / "shards")
    SH.write_token_shards(slices(spark, DOCS, 5), path)
    SH.write_token_shards(slices(spark, DOCS, 100), path)
    assert os.listdir(folder(path)) == ["data_val_000000.bin"]
    assert sorted(os.listdir(path)) == sorted(["_current", os.path.basename(folder(path))])


def test_a_failed_overwrite_keeps_the_old_shards(spark, tmp_path):
    path = str(tmp_path / "shards")
    SH.write_token_shards(slices(spark, DOCS, 10), path)
    before = content(spark, path)
    with pytest.raises(Exception, match="does not fit in 16 bits"):
        SH.write_token_shards(slices(spark, [[1, 2], [70000]], 2), path)
    assert content(spark, path) == before and len(os.listdir(path)) == 2


def test_one_shard_per_task(spark, tmp_path):
    path = str(tmp_path / "shards")
    many = slices(spark, [list(range(400))], 10)
    SH.write_token_shards(many, path, tasks=40)
    assert SH.scan_shard_headers(spark, path).count() == 40
    dealt = many.repartitionById(40, F.col("shard").cast("int")).withColumn("part", F.spark_partition_id())
    assert dealt.groupBy("part").agg(F.countDistinct("shard").alias("n")).where("n != 1").count() == 0


def test_filters_and_columns_reach_the_source(spark, tmp_path):
    path = str(tmp_path / "shards")
    SH.write_token_shards(slices(spark, [list(range(100))], 10), path)
    some = SH.read_token_shards(spark, path).where("split = 'train' AND shard_index BETWEEN 3 AND 5 AND lo >= 0")
    assert some.rdd.getNumPartitions() == 3
    assert sorted(r.shard_index for r in some.collect()) == [3, 4, 5]
    assert SH.read_token_shards(spark, path).where("file = 'data_val_000000.bin'").rdd.getNumPartitions() == 1
    assert SH.read_token_shards(spark, path).where("shard_index IN (2, 7)").rdd.getNumPartitions() == 2
    thin = SH.read_token_shards(spark, path, columns=["file", "n_tokens"])
    assert thin.columns == ["file", "n_tokens"] and thin.agg(F.sum("n_tokens")).first()[0] == 100


def test_plain_folders_and_full_32_bit_ids_are_read(spark, tmp_path):
    path = shard(tmp_path, [20240520, 2, 2, 32], np.array([2**32 - 1, 5], "<u4").tobytes())
    assert SH.read_token_shards(spark, path).first().ids == [2**32 - 1, 5]


def test_empty_folder_gives_no_rows(spark, tmp_path):
    assert SH.scan_shard_headers(spark, str(tmp_path)).count() == 0
    assert SH.read_token_shards(spark, str(tmp_path)).count() == 0


def shard(path, fields, body=b""):
    head = np.zeros(256, dtype="<i4")
    head[: len(fields)] = fields
    (path / "data_val_000000.bin").write_bytes(head.tobytes() + body)
    return str(path)


@pytest.mark.parametrize(
    "fields,body,message",
    [
        ([1, 1, 0], b"", "not a token shard"),
        ([20240520, 3, 0], b"", "unknown version"),
        ([20240520, 2, 0, 8], b"", "unknown token width"),
        ([20240520, 1, 5], b"\0\0", "payload does not match"),
    ],
)
def test_damaged_files(spark, tmp_path, fields, body, message):
    with pytest.raises(Exception, match=message):
        SH.read_token_shards(spark, shard(tmp_path, fields, body)).collect()


def test_width_zero_means_32_bits(spark, tmp_path):
    path = shard(tmp_path, [20240520, 2, 2, 0], np.array([7, 70000], "<u4").tobytes())
    assert SH.read_token_shards(spark, path).first().ids == [7, 70000]


def test_failed_write_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "shards")
    with pytest.raises(Exception, match="does not fit in 16 bits"):
        SH.write_token_shards(slices(spark, [[1, 2], [70000]], 2), path)
    assert not os.path.exists(path) or os.listdir(path) == []
    gap = spark.createDataFrame([(0, 0, [1]), (0, 2, [3])], "shard long, lo long, ids array<int>")
    with pytest.raises(Exception, match="ids missing or doubled"):
        SH.write_token_shards(gap, path)


def test_version_follows_vocabulary():
    assert SH.shard_version(65536) == 1 and SH.shard_version(65537) == 2


def test_small_files_share_a_task_once_there_are_many():
    reader = SH.ShardReader({"path": "shards"})
    entry = lambda i, n: (f"shards/data_train_{i:06d}.bin", f"data_train_{i:06d}.bin", SH.HEADER_BYTES + n)
    many = [entry(i, 200_000) for i in range(20_000)] + [entry(20_000, 3 * SH.TASK_BYTES)]
    tasks = reader.tasks(many)
    assert len(tasks) < 200
    assert max(sum(f[2] - SH.HEADER_BYTES for f in t.files) for t in tasks if t.parts == 1) <= SH.TASK_BYTES
    assert [f for t in tasks if t.parts == 1 for f in t.files] == many[:-1]
    assert [(t.part, t.parts) for t in tasks if t.parts > 1] == [(i, 3) for i in range(3)]
    assert [len(t.files) for t in reader.tasks(many[:10])] == [1] * 10  # few files keep a task each
