from pyspark.sql import functions as F

from corpusloom.functions.text import piece_count
from corpusloom.operators import blocks as B, vocabulary as V


def lists_of(spark, n=400):
    made = F.expr("transform(sequence(1, cast(id % 7 as int) + 1), x -> concat('w', (id * x) % 23))")
    return spark.range(n, numPartitions=2).select(F.col("id").alias("doc_id"), made.alias("words"))


def test_a_block_stays_rows_and_is_never_one_row(spark):
    df = lists_of(spark)
    got = B.coded_blocks(df, {"words": F.col("words")}, ["doc_id"], values=50).collect()
    assert sorted(r["__0"] for r in got) == list(range(400))  # a row for each document
    blocks = {}
    for r in got:
        blocks.setdefault(r.block, []).append(r)
    assert len(blocks) > 4
    words = {r.doc_id: r.words for r in df.collect()}
    for rows in blocks.values():
        (entries,) = [r.entries for r in rows if r.entries is not None]
        assert len(entries) == len(set(entries))
        assert all([entries[c] for c in r["__1"]] == words[r["__0"]] for r in rows)


def test_values_of_a_block_meet_its_rows_without_an_array_of_them(spark):
    df = lists_of(spark).withColumn("words", F.when(F.col("doc_id") % 5 != 0, F.col("words")))
    table = spark.createDataFrame([(f"w{i}", i) for i in range(0, 23, 2)], "token string, id int")
    got = B.look_up_lists(df, {"ids": F.col("words")}, table, "token", "id", -1, ["doc_id"], 4)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "FlatMapCoGroupsInArrow" in plan
    known = {f"w{i}": i for i in range(0, 23, 2)}
    expected = {r.doc_id: [known.get(w, -1) for w in r.words or []] for r in df.collect()}
    assert {r.doc_id: r.ids for r in got.collect()} == expected


def test_only_the_head_of_a_large_table_is_broadcast(spark, monkeypatch):
    table = spark.range(70_000).selectExpr("concat('w', id) AS token", "CAST(id AS int) AS id")
    lists = {0: ["w1", "w65535", "w65536", "x"], 1: ["w69999", "w1"]}
    df = spark.createDataFrame(list(lists.items()), "doc_id long, words array<string>")
    sent = []
    monkeypatch.setattr(B.F, "broadcast", lambda d, f=B.F.broadcast: sent.append(d.count()) or f(d))
    got = B.look_up_lists(df, {"ids": F.col("words")}, table, "token", "id", -1, ["doc_id"], 1 << 20)
    assert {r.doc_id: r.ids for r in got.collect()} == {0: [1, 65535, 65536, -1], 1: [69999, 1]}
    assert sent and max(sent) <= 1 << 16


def test_texts_split_once_give_the_vocabulary_the_lengths_and_the_ids(spark):
    texts = [(0, "a b, a"), (1, None), (2, ""), (3, "b 12 b c!! a"), (4, "été a")]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    blocks = V.text_blocks(df)
    vocab = V.build_vocab(df, blocks=blocks)
    plain = V.build_vocab(df)
    assert "regexp" not in vocab._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, vocab.collect())) == sorted(map(tuple, plain.collect()))
    lengths = {r.doc_id: r.n_pieces for r in V.block_lengths(blocks).collect()}
    assert lengths == {r.doc_id: r.n for r in df.select("doc_id", piece_count("text").alias("n")).collect()}
    few = vocab.where("cnt <> 1")  # a token that the vocabulary lacks is unknown both ways
    for words in (vocab, few):
        got = {r.doc_id: r.ids for r in V.tokenize_corpus(df, words, blocks=blocks).collect()}
        assert got == {r.doc_id: r.ids for r in V.tokenize_corpus(df, words).collect()}


def test_long_lists_reach_the_function_in_slices_and_come_out_whole(spark):
    made = "transform(sequence(1, cast((id * 37) % 400 as int) + 1), x -> concat('w', (id * x) % 61))"
    df = spark.range(0, 120, numPartitions=2).select(
        F.col("id").alias("doc_id"),
        F.expr(f"case when id % 9 = 0 then null when id % 9 = 1 then cast(array() as array<string>) else {made} end").alias("a"),
        F.expr("case when id % 4 > 0 then transform(sequence(1, cast(id % 3 as int) + 1), x -> if(x = 2, null, concat('v', x))) end").alias("b"),
    )
    sliced = B.sliced_lists(df, ["a", "b"], 16)
    assert sliced.agg(F.max(F.size("a"))).first()[0] == 16  # a batch is bounded, whatever the lists
    at = B.coded_blocks(df, {"a": F.col("a"), "b": F.col("b")}, ["doc_id"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode" in at[at.index("MapInArrow") :]
    expected = {r.doc_id: (r.a, r.b) for r in df.collect()}
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    kept = spark.conf.get(name)
    try:
        for batch in ("3", "10000"):  # rows over several batches, several rows in one
            spark.conf.set(name, batch)
            got = B.coded_blocks(df, {"a": F.col("a"), "b": F.col("b")}, ["doc_id"], values=700).collect()
            entries = {r.block: r.entries for r in got if r.entries is not None}
            assert len(entries) > 8
            named = lambda r, n: None if r[n] is None else [None if c is None else entries[r.block][c] for c in r[n]]
            assert sorted(r["__0"] for r in got) == sorted(expected)
            assert {r["__0"]: (named(r, "__1"), named(r, "__2")) for r in got} == expected
    finally:
        spark.conf.set(name, kept)
