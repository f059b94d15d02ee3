import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import packing as P


def positioned(spark, docs):
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "doc_id long, ids array<int>")
    return df.join(P.token_offsets(df.select("doc_id", F.size("ids").alias("n_ids"))), "doc_id").drop("n_ids")


def stream_of(docs):
    return [t for d in docs for t in d]


@pytest.mark.parametrize(
    "sizes",
    [[3, 3, 4], [5, 5], [25, 1, 2], [4], [1, 0, 9, 1]],  # exact multiple, one long document, one shard, empty text
)
def test_shards_equal_a_plain_cut(spark, sizes):
    rng = random.Random(0)
    docs = [[rng.randrange(100) for _ in range(n)] for n in sizes]
    cut = P.cut_shards(positioned(spark, docs), 5, "ids")
    got = {r.shard: (r.ids, r.split) for r in P.assemble(cut, ["shard", "split"]).collect()}
    stream = stream_of(docs)
    expected = {
        i: (stream[i * 5 : i * 5 + 5], "val" if i == 0 else "train") for i in range((len(stream) + 4) // 5)
    }
    assert got == expected


def cut_docs(spark, docs, size, limit):
    df = spark.createDataFrame([(7 * i, d) for i, d in enumerate(docs)], "doc_id long, ids array<int>").repartition(3)
    offsets = P.token_offsets(df.select("doc_id", F.size("ids").alias("n_ids")))
    return P.gathered_parts(P.slices_by_part(df, offsets, size, limit=limit))


@pytest.mark.parametrize("limit", [P.MOST_PARTS, 0])  # parts found from shared starts, or by a join
@pytest.mark.parametrize("sizes", [[3, 3, 4], [5, 5], [25, 1, 2], [4], [1, 0, 9, 1], [0, 0, 12, 0, 5, 5, 3, 0], [0, 0], [2] * 40])
def test_parts_hold_the_stream_in_order(spark, sizes, limit):
    rng = random.Random(1)
    docs = [[rng.randrange(100) for _ in range(n)] for n in sizes]
    got = {}
    for r in sorted(cut_docs(spark, docs, 5, limit).collect(), key=lambda r: (r.part, r.lo)):
        assert r.lo == len(got.setdefault(r.part, [])) and r.hi == r.lo + len(r.ids) and r.ids
        got[r.part] += r.ids
    stream = stream_of(docs)
    assert got == {i: stream[5 * i : 5 * i + 5] for i in range((len(stream) + 4) // 5)}


def test_sequences_of_parts(spark):
    docs = [list(range(i, i + 13)) for i in range(0, 260, 13)]
    for limit in (P.MOST_PARTS, 0):
        got = {r.seq: r.ids for r in P.sequences_of_parts(cut_docs(spark, docs, 40, limit), 40, 8).collect()}
        assert got == {i: list(range(8 * i, min(8 * i + 8, 260))) for i in range(33)}
    with pytest.raises(ValueError):
        P.sequences_of_parts(None, 41, 8)


def test_ids_move_once(spark):
    parts = cut_docs(spark, [[1, 2, 3]] * 9, 6, P.MOST_PARTS)
    rows = parts.select("part", F.format_string("f%d", "part").alias("file"), "lo", "hi", "ids")
    for df in (P.train_batches(rows, 2, 2, "part"), P.sequences_of_parts(parts, 6, 3)):
        assert df._jdf.queryExecution().executedPlan().toString().count("Exchange hash") == 1
    together = {(r.file, r.batch, r.rank): r.ids for r in P.train_batches(rows, 2, 2, "part").collect()}
    assert together == {(r.file, r.batch, r.rank): r.ids for r in P.train_batches(rows.drop("part"), 2, 2).collect()}


def test_offsets_over_many_buckets(spark):
    df = spark.range(2000).select((F.col("id") * 1000).alias("doc_id"), (F.col("id") % 5).alias("n_ids"))
    got = [tuple(r) for r in P.token_offsets(df).orderBy("doc_id").select("start_pos", "end_pos").collect()]
    at = 0
    for i, (start, end) in enumerate(got):
        assert (start, end) == (at, at + i % 5)
        at = end


def test_batches_equal_a_sequential_reader(spark):
    length, world = 4, 3
    files = {"a": list(range(100, 161)), "b": list(range(200, 213)), "c": list(range(12)), "d": list(range(13))}
    pieces = []
    for name, ids in files.items():
        cuts = sorted({0, len(ids), *random.Random(name).sample(range(1, len(ids)), 3)})
        pieces += [(name, lo, ids[lo:hi]) for lo, hi in zip(cuts, cuts[1:])]
    df = spark.createDataFrame(pieces, "file string, lo long, ids array<int>")
    got = {(r.file, r.batch, r.rank): (r.first_pos, r.ids) for r in P.train_batches(df, length, world).collect()}
    expected, step = {}, length * world
    for name, ids in files.items():
        pos = batch = 0
        while pos + step + 1 <= len(ids):
            for rank in range(world):
                low = pos + rank * length
                expected[(name, batch, rank)] = (low, ids[low : low + length + 1])
            pos, batch = pos + step, batch + 1
    assert got == expected and ("c", 0, 0) not in got and ("d", 0, 2) in got


def test_short_shard_is_reported(spark):
    headers = spark.createDataFrame([("f", 12)], "file string, tokens long")
    assert P.require_whole_batch(headers, 3, 2).first().tokens == 12
    with pytest.raises(Exception, match="f holds fewer than 13 tokens"):
        P.require_whole_batch(headers, 4, 3).collect()


def random_sequences(count, blocks, block):
    rng = random.Random(9)
    out = []
    for s in range(count):
        rate = rng.choice([0.0, 0.01, 0.1, 0.6])
        ids = [1 if rng.random() < rate else 5 for _ in range(blocks * block)]
        if s % 2:
            ids[0] = 1
        if s % 3 == 0:
            ids[block * 2] = 1
        out.append((s, ids))
    return out


def numbered(ids):
    out, n = [], 0
    for t in ids:
        n += t == 1
        out.append(n)
    return out


def test_segments(spark):
    data = random_sequences(6, 4, 8)
    got = P.segment_docs(spark.createDataFrame(data, "seq long, ids array<int>"), 1)
    expected = {}
    for s, ids in data:
        for p, d in enumerate(numbered(ids)):
            first, n = expected.get((s, d), (p, 0))
            expected[(s, d)] = (first, n + 1)
    assert {(r.seq, r.doc_no): (r.first_pos, r.tokens) for r in got.collect()} == expected


def test_block_relations_equal_the_dense_matrices(spark):
    block, window = 8, 3
    data = random_sequences(12, 7, block)
    ranges = P.block_ranges(spark.createDataFrame(data, "seq long, ids array<int>"), 1, block=block)
    got = {(r.seq, r.q_block): r for r in P.block_overlap(ranges, window).collect()}
    for s, ids in data:
        docs = numbered(ids)
        low, high = docs[::block], docs[block - 1 :: block]
        for q in range(len(low)):
            related = [k for k in range(q + 1) if low[q] <= high[k] and high[q] >= low[k]]
            full = [k for k in related if q > k and low[q] == high[k] and high[q] == low[k]]
            partial = [k for k in related if k not in full]
            r = got[(s, q)]
            before = [] if r.partial_from is None else list(range(r.partial_from, r.partial_to + 1))
            assert [*before, q] == partial
            assert full == ([] if r.full_from is None else list(range(r.full_from, q)))
            assert (r.partial_n, r.full_n) == (len(partial), len(full))
            assert r.partial_kept == min(len(partial), max(window - len(full), 1))
            assert r.full_kept == min(len(full), window - 1)


def test_file_order(spark):
    files = spark.createDataFrame([("c",), ("a",), ("b",)], "file string")
    plain = P.file_order(files, 2).orderBy("epoch", "rank").collect()
    assert [r.file for r in plain] == ["a", "b", "c"] * 2
    seeded = [r.file for r in P.file_order(files, 2, seed=3).orderBy("epoch", "rank").collect()]
    assert seeded[:3] == seeded[3:] and sorted(seeded[:3]) == ["a", "b", "c"]
    many = spark.createDataFrame([(f"f{i}",) for i in range(20)], "file string")
    redrawn = [r.file for r in P.file_order(many, 2, seed=3, reshuffle=True).orderBy("epoch", "rank").collect()]
    assert redrawn[:20] != redrawn[20:] and sorted(redrawn[:20]) == sorted(redrawn[20:])


def test_batch_schedule_counts_whole_batches_over_files_and_passes(spark):
    files = {"data_train_000001.bin": 41, "data_train_000002.bin": 20, "data_train_000003.bin": 100}
    headers = spark.createDataFrame(list(files.items()), "file string, tokens long")
    got = P.batch_schedule(headers, 2, 5, 2, seed=3).collect()
    order = [r.file for r in P.file_order(headers.select("file"), 1, 3).orderBy("rank").collect()]
    expected, step = [], 0
    for epoch in range(2):
        for file in order:
            for batch in range((files[file] - 1) // 10):
                expected += [(step, epoch, file, batch, rank) for rank in range(2)]
                step += 1
    assert sorted(tuple(r) for r in got) == expected
    with pytest.raises(Exception, match="holds fewer than 41 tokens"):
        P.batch_schedule(headers, 1, 20, 2).collect()
