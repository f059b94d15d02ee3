import json

import numpy as np
import pandas as pd
import pytest

from corpusloom.functions import python as PY
from corpusloom.operators import classifier as ML


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(0, "low lower lowest"), (1, ""), (2, "new <|endoftext|> wide")], "doc_id long, text string")


def test_tokenizer_json(spark, texts, tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    tokenizer = Tokenizer(models.WordLevel({"[UNK]": 0, "low": 1, "new": 2, "wide": 3}, unk_token="[UNK]"))
    tokenizer.pre_tokenizer = pre_tokenizers.Whitespace()
    path = str(tmp_path / "tokenizer.json")
    tokenizer.save(path)
    encode = PY.encoder(PY.tokenizer_json(spark, path))
    got = {r.doc_id: r.ids for r in texts.repartition(2).select("doc_id", encode("text").alias("ids")).collect()}
    assert got == {r.doc_id: tokenizer.encode(r.text).ids for r in texts.collect()}
    assert got[0] == [1, 0, 0] and got[1] == []


def test_rank_file_matches_direct_encoding(spark, texts):
    files = pytest.importorskip("public_tokenizers")
    import base64

    import tiktoken

    path = files.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    direct = tiktoken.Encoding("direct", pat_str=files.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encode = PY.encoder(PY.tiktoken_ranks(spark, path, files.PATTERN))
    got = {r.doc_id: r.ids for r in texts.select("doc_id", encode("text").alias("ids")).collect()}
    assert got == {r.doc_id: direct.encode_ordinary(r.text) for r in texts.collect()}


def test_size_of_the_file_is_checked(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"a": 1}))
    with pytest.raises(ValueError, match="too large"):
        PY.tokenizer_json(spark, str(tmp_path / "t.json"), most=3)


@pytest.mark.parametrize("batch", [2, 256])
def test_scorer(spark, batch):
    def load():
        return lambda m: np.stack([m.sum(axis=1), m.max(axis=1)], axis=1)

    df = spark.createDataFrame([(i, [i, 2 * i, 1]) for i in range(7)], "k long, ids array<int>").repartition(2)
    got = {r.k: r.s for r in df.select("k", PY.scorer(load, batch)("ids").alias("s")).collect()}
    assert got == {i: [3.0 * i + 1, float(max(2 * i, 1))] for i in range(7)}


def test_map_batches(spark):
    df = spark.createDataFrame([(0, 1), (0, 5), (1, 2)], "batch_id long, n long")

    def widest(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.assign(width=pdf["n"].max())

    got = PY.map_batches(df, widest, "batch_id long, n long, width long")
    assert sorted(tuple(r) for r in got.collect()) == [(0, 1, 5), (0, 5, 5), (1, 2, 2)]


def test_classifier_learns_a_rare_class(spark):
    data = [(i, "good fine nice" if i % 10 else "bad awful", 0 if i % 10 else 1) for i in range(100)]
    df = spark.createDataFrame(data, "doc_id long, text string, label long")
    got = ML.classify(ML.fit_classifier(df, 2, 64, 10), df)
    assert {r.doc_id: r.pred for r in got.collect()} == {i: l for i, _, l in data}
