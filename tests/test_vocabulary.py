import re

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import vocabulary as V

def words(text):
    return re.findall(r"[^\W\d_]+|\d+|[^\s\w]+", text)


DOCS = [(0, "b a b"), (1, ""), (2, "c a, d"), (3, "zzz")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string")


def test_ranking_ties_and_cap(docs):
    vocab = {r.token: (r.id, r.cnt) for r in V.build_vocab(docs, 3).collect()}
    assert vocab == {
        "[PAD]": (0, 0), "<|endoftext|>": (1, 0), "[UNK]": (2, 0), "a": (3, 2), "b": (4, 2), "c": (5, 1),
    }  # equal counts go by the digest of the token


def test_all_words_without_a_cap_and_no_top_k_in_one_task(spark, docs):
    import hashlib
    from collections import Counter

    text = " ".join(f"w{i % 37}" for i in range(400)) + " " + " ".join(f"x{i}" for i in range(300))
    many = docs.unionByName(spark.createDataFrame([(9, text)], "doc_id long, text string"))
    count = Counter(words(text) + words("b a b c a , d zzz"))
    order = sorted(count, key=lambda t: (-count[t], hashlib.md5(t.encode()).hexdigest(), t))
    for cap in (None, 50):
        vocab = V.build_vocab(many, cap)
        got = {r.token: r.id for r in vocab.where("cnt > 0").collect()}
        assert got == {t: i + 3 for i, t in enumerate(order[:cap])}
        assert "TakeOrdered" not in plan_of(vocab) and "Limit" not in plan_of(vocab)


@pytest.mark.parametrize("limit", [1 << 18, 3, 0])
def test_both_ways_agree_on_repeated_keys_rows_and_tokens(spark, limit):
    rows = [(0, "a b"), (0, "c"), (0, "c"), (1, ""), (1, None), (1, ""), (2, "a zz a")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    listed = [("a", 9, 1), ("a", 3, 5), ("b", 4, 2), ("b", 4, 2), ("c", 70000, 1), (None, 1, 1)]
    vocab = spark.createDataFrame(listed, "token string, id int, cnt long")
    got = sorted((r.doc_id, r.ids) for r in V.tokenize_corpus(df, vocab, limit=limit).collect())
    assert got == [(0, [3, 4]), (0, [70000]), (0, [70000]), (1, []), (1, []), (1, []), (2, [3, 2, 3])]
    names = spark.createDataFrame([("b", 4, 0), ("x", 4, 0), ("c", 5, 0)], "token string, id int, cnt long")
    ids = spark.createDataFrame([(0, [4, 5]), (0, [5]), (0, [5]), (1, [])], "doc_id long, ids array<int>")
    back = sorted((r.doc_id, r.text) for r in V.decode_tokens(ids, names, limit=limit).collect())
    assert back == [(0, "b c"), (0, "c"), (0, "c"), (1, "")]


@pytest.mark.parametrize("limit", [1 << 18, 6, 5, 4, 0])  # shared with the tasks up to 6 rows, else joined
def test_codes_unknown_and_empty(docs, limit):
    vocab = V.build_vocab(docs, 3)
    missing = docs.where("doc_id = 1").selectExpr("CAST(9 AS bigint) AS doc_id", "CAST(null AS string) AS text")
    got = V.tokenize_corpus(docs.unionByName(missing), vocab, limit=limit)
    assert {r.doc_id: r.ids for r in got.collect()} == {9: [], 0: [4, 3, 4], 1: [], 2: [5, 3, 2, 2], 3: [2]}


def test_a_vocabulary_too_large_to_share_is_not_fetched(docs, monkeypatch):
    vocab = V.build_vocab(docs, 3)
    monkeypatch.setattr(type(vocab), "toArrow", lambda *_: pytest.fail("fetched"))
    assert V.vocab_column(vocab, "token", "id", V.UNK, 5) is None


@pytest.mark.parametrize("limit", [1 << 18, 4])
def test_two_columns_and_leading_ids(spark, docs, limit):
    vocab = V.build_vocab(docs, 3)
    pairs = docs.withColumn("other", F.lit("a b"))
    got = V.tokenize(pairs, vocab, {"x": F.col("text"), "y": F.col("other")}, keep=["other"], limit=limit, first={"x": 2})
    assert {r.doc_id: (r.x, r.y, r.other) for r in got.collect()} == {
        0: ([4, 3], [3, 4], "a b"), 1: ([], [3, 4], "a b"), 2: ([5, 3], [3, 4], "a b"), 3: ([2], [3, 4], "a b"),
    }


@pytest.mark.parametrize("limit", [1 << 18, 4])
def test_decode(spark, docs, limit):
    vocab = V.build_vocab(docs, 3)
    ids = spark.createDataFrame([(0, [4, 3, 99]), (1, []), (2, [5])], "doc_id long, ids array<int>")
    got = V.decode_tokens(ids, vocab, limit=limit)
    assert {r.doc_id: r.text for r in got.collect()} == {0: "b a [UNK]", 1: "", 2: "c"}


def test_special_names_in_order_of_preference(spark):
    vocab = spark.createDataFrame([("</s>", 7, 0), ("<eos>", 8, 0)], "token string, id int, cnt long")
    assert V.resolve_special(vocab, V.TARGET_END_NAMES, 50256).first().id == 8
    assert V.resolve_special(vocab, V.DOCUMENT_END_NAMES, 0).first().id == 7
    assert V.resolve_special(vocab.limit(0), V.TARGET_END_NAMES, 50256).first().id == 50256


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_shuffle_with_a_bounded_vocabulary(docs):
    vocab = V.build_vocab(docs, 3)
    assert "Exchange" not in plan_of(V.tokenize_corpus(docs, vocab))


def test_many_batches_and_slices(spark):
    docs = spark.range(500).selectExpr("id AS doc_id", "repeat('a b c ', CAST(id % 5 AS int)) AS text").coalesce(1)
    vocab = V.build_vocab(docs, 2)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r.doc_id: r.ids for r in V.tokenize_corpus(docs, vocab).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {i: [3, 2, 4] * (i % 5) for i in range(500)}  # of equal counts, the digest of a, then of c
