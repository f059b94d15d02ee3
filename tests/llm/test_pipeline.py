"""The pipeline on the smallest tables, stage by stage, against plain versions over all pairs and rows."""

import os
from collections import Counter

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
pytest.importorskip("public_tokenizers")
TABLES = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The rows that go into and come out of each stage."""
    docs, seen = spark.read.parquet(f"{TABLES}/documents.parquet"), []
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, TABLES).write.parquet(path)
        made = spark.read.parquet(path)
        seen.append((docs.collect(), made.collect()))
        assert name == "tokens" or made.columns == columns
        docs = made
    return dict(zip([n for n, _ in corpus_pipeline.STAGES], seen))


def test_documents_with_letters_stay(stages):
    before, after = stages["language"]
    assert sorted(before) == sorted(after)  # every given document has letters


def test_one_document_of_each_group_stays(stages):
    from corpusloom.llm.simhash import fingerprint

    before, after = stages["near_duplicates"]
    prints = {r.doc_id: fingerprint((r.text or "").encode()) for r in before}
    label = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for i, a in prints.items():
            for j, b in prints.items():
                if (a ^ b).bit_count() <= 3 and label[j] > label[i]:
                    label[j], changed = label[i], True
    assert sorted(after) == sorted(r for r in before if label[r.doc_id] == r.doc_id)


def test_personal_data_is_masked_and_all_else_stays(stages):
    from corpusloom.llm import privacy

    before, after = stages["personal_data"]
    hidden = {r.doc_id: r for r in after}
    assert len(hidden) == len(before)
    for r in before:
        spans, text = privacy.base_spans(r.text or ""), hidden[r.doc_id].text
        assert not privacy.base_spans(text)
        if not spans:
            assert text == r.text or "[" in text
        for kind, start, end in spans:
            assert r.text[start:end] not in text
        assert r[2:] == hidden[r.doc_id][2:]


def test_documents_repeat_as_the_mixture_says(stages, spark):
    from corpusloom.llm import mixing

    before, after = stages["mixture"]
    docs = spark.createDataFrame(before)
    taken = {r.doc_id: r.taken // r["size"] for r in mixing.mix_report(docs).collect() if r["size"]}
    assert Counter(r.doc_id for r in after) == {i: n for i, n in taken.items() if n}
    assert {r.doc_id: r for r in after}.items() <= {r.doc_id: r for r in before}.items()


def test_tokens_equal_the_library(stages):
    import hashlib

    import public_tokenizers
    import tiktoken

    from corpusloom.llm import bpe

    before, after = stages["tokens"]
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    expected = sorted((r.doc_id, other.encode_ordinary(r.text), hashlib.sha256(r.text.encode()).hexdigest()) for r in before)
    assert sorted((r.doc_id, r.ids, r.decoded_sha256) for r in after) == expected


def test_run_gives_the_last_stage(spark, stages):
    got = sorted(corpus_pipeline.run(spark, TABLES).collect())
    assert got == sorted(stages["tokens"][1])


ODD = [
    (1, "the river under the old bridge in the morning light", "en", "a", 9),
    (1, "the river under the old bridge in the morning light", "en", "a", 9),
    (2, None, "en", None, None),
    (3, "", None, "a", 0),
    (4, "123 456 +++", "de", "b", 11),
    (None, "a text without a number that stays", "en", "b", 1),
    (None, "a text without a number that stays", "en", None, 1),
    (5, "der alte fluss unter der brücke call (582) 555-9616 heute", "de", "b", 1),
    (6, "word " * 50_000, "en", "c", 250_000),
]


@pytest.mark.parametrize("rows", [ODD, ODD[:1], []])
def test_every_stage_with_odd_rows_and_clashing_columns(spark, rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    extra = {"ids": "1", "size": "'x'", "place": "2", "fp": "'y'", "root": "3", "chunk": "4", "score": "5", "rank": "6", "v": "7"}
    docs = spark.createDataFrame(rows, schema).selectExpr("*", *[f"{v} AS {k}" for k, v in extra.items()])
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, TABLES)
        if name == "tokens":
            assert len(made.collect()) == docs.count()
        else:
            assert made.columns == docs.columns
            docs = spark.createDataFrame(made.collect(), made.schema)
            kept = sorted((r.doc_id or 0, len(r.text)) for r in docs.collect() if r.text)
            if name == "language":
                assert len(kept) == len([r for r in rows if r[1] and r[1][:3] != "123"]) and docs.count() == len(kept)
            if name == "near_duplicates" and len(rows) > 1:
                assert [k for k, _ in kept] == [0, 1, 5, 6]
            if name == "personal_data" and len(rows) > 1:
                assert "[phone]" in next(r.text for r in docs.collect() if r.doc_id == 5)


def test_without_labels_documents_with_letters_stay(spark):
    rows = [(1, "the old bridge", None), (2, "123 +", None), (3, None, None), (4, "", None), (None, "über", None), (5, "河", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    made = corpus_pipeline.identify_language(spark, docs, TABLES)
    assert made.columns == docs.columns
    assert sorted(r.text for r in made.collect()) == ["the old bridge", "über", "河"]
