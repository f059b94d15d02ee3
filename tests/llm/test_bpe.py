import hashlib
import random

import numpy as np
import pytest

from corpusloom.llm import bpe, chunks

public_tokenizers = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")
RANKS = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
PATTERN = public_tokenizers.PATTERN
OTHER = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})


def texts():
    rng = random.Random(1)
    alphabet = "aaabcdetheing  \n\t.,'sñ日本😀 \u0000012"
    made = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 400))) for _ in range(80)]
    return [None, "", " ", "\n\n", "it's don't <|endoftext|>", "the " * 5000, "x" * 3000, "é" * 500, *made, *made[:5]]


def test_merge_equals_the_library():
    for text in texts():
        for piece in bpe.regex.findall(PATTERN, text or ""):
            expected = OTHER._encode_single_piece(piece)
            assert bpe.merge(piece.encode(), RANKS) == expected
            if len(expected) > 1:
                assert bpe._merge_long(piece.encode(), RANKS) == bpe._merge_short(piece.encode(), RANKS) == expected


def test_segments_have_the_pre_tokens_of_the_text(monkeypatch):
    rng = random.Random(3)
    marks = [" ", "  ", "\n", "\t ", " \u00a0", "\u3000", "\x1c", "\x85", "'s", "'", "ab", "é1", "9", "...", "日本", "\n\n a"]
    for size in (1 << 20, 5):
        monkeypatch.setattr(bpe, "LONG_TEXT", size)
        for _ in range(1500):
            text = "".join(rng.choice(marks) for _ in range(rng.randrange(14)))
            got = [w for s in bpe.segments(text.encode()) for w in bpe.pre_tokens(PATTERN)(s)]
            assert got == [w.encode() for w in bpe.regex.findall(PATTERN, text)], repr(text)
            assert [i for w in got for i in bpe.merge(w, RANKS)] == OTHER.encode_ordinary(text), repr(text)


def check(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "0 AS ids", "'x' AS chunk")
    made = bpe.encode(docs, RANKS, PATTERN, bpe.digests(RANKS), f"doc_id long, ids array<int>, {bpe.DIGESTS}")
    got = sorted((r.doc_id or -1, tuple(r.ids), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in made.collect())
    expected = []
    for i, text in rows:
        ids = OTHER.encode_ordinary(text or "")
        packed = np.array(ids, "<u4").tobytes()
        digest = hashlib.sha256((text or "").encode()).hexdigest()
        expected.append((i or -1, tuple(ids), len(ids), hashlib.sha256(packed).hexdigest(), digest))
    assert got == sorted(expected)


def test_ids_decode_to_the_texts(spark):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    back = bpe.encode(docs, RANKS, PATTERN).select("doc_id", bpe.decoded(RANKS)("ids").alias("data"))
    assert {r.doc_id: bytes(r.data).decode() for r in back.collect()} == {i: t or "" for i, t in rows}


def test_round_trip_equals_the_library(spark):
    rows = list(enumerate(texts()))
    check(spark, rows + [rows[5], (None, "no id"), (None, "no id")])


def test_many_chunks_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(bpe, "chunked", lambda *a: chunks.chunked(*a, chunk_bytes=300))
    monkeypatch.setattr(bpe, "LONG_TEXT", 1000)
    monkeypatch.setattr(bpe, "TOKENS_AT_ONCE", 50)
    monkeypatch.setattr(bpe, "ROWS_PER_BUCKET", 1)  # a bucket for each row
    check(spark, list(enumerate(texts())))


def test_only_empty_texts_and_no_rows(spark):
    check(spark, [(1, None), (2, "")])
    check(spark, [])


def test_codes_survive_packing():
    codes = np.array([0, 1, 70000, 2**32 - 1, 5], np.uint32)
    assert chunks.unpack(chunks.pack(codes)).tolist() == codes.tolist()
    assert len(chunks.unpack(chunks.pack(codes[:0]))) == 0
    words = [b"a", b"", b"\x00\xff", b"long" * 99]
    assert chunks.word_array(chunks.pack_words(words)).to_pylist() == words
    assert chunks.word_array(chunks.pack_words([])).to_pylist() == []


def test_unknown_id_ends_the_job(spark):
    with pytest.raises(Exception, match="token table"):
        spark.createDataFrame([([60000],)], "ids array<int>").select(bpe.decoded({b"a": 0, b"b": 60001})("ids")).collect()
