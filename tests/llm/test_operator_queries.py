"""Every registered query of the subpackage on the smallest tables: columns, rows and what its contract fixes."""

import os
import re
import zlib

import pytest

from corpusloom.llm.queries import operator_queries

TABLES = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables")

COLUMNS = {
    "op1": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op2": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op3": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
    "op4": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op5": {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint",
            "base_score": "double", "score": "double"},
    "op6": {"page_id": "bigint", "host": "string", "path": "string", "rule": "string", "verdict": "string"},
    "op7": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint",
            "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
    "op8": {"doc_id": "bigint", "n_email": "bigint", "n_ip": "bigint", "n_card": "bigint", "n_phone": "bigint",
            "base_sha256": "string", "spans": "string"},
    "op9": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op10": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op11": {"doc_id": "bigint", "n": "bigint", "form": "string", "prefix_chars": "bigint", "middle_chars": "bigint",
             "output_sha256": "string", "restored_sha256": "string"},
    "op12": {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"},
    "op13": {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"},
}
QUERIES = {name.split("_")[0]: query for name, query in operator_queries().items()}


@pytest.fixture(scope="module")
def answers(spark):
    made = {}

    def get(name):
        if name not in made:
            frame = QUERIES[name](spark, TABLES)
            made[name] = (dict(frame.dtypes), frame.collect())
        return made[name]

    return get


def rest(doc_id, divisor):
    return zlib.crc32(str(doc_id).encode()) % divisor


@pytest.mark.parametrize("name", list(COLUMNS))
def test_columns_and_one_row_per_document(spark, answers, name):
    kinds, rows = answers(name)
    assert kinds == COLUMNS[name]
    if name in ("op3", "op12"):
        return
    table, key = {"op6": ("pages", "page_id"), "op13": ("embeddings", "vec_id")}.get(name, ("documents", "doc_id"))
    assert sorted(r[key] for r in rows) == sorted(r[key] for r in spark.read.parquet(f"{TABLES}/{table}.parquet").collect())


def test_held_out_rows(answers):
    for name, divisor, left_out in (("op1", 5, 0), ("op5", 5, 1), ("op9", 4, 2)):
        assert all(r.held_out == (rest(r.doc_id, divisor) == left_out) for r in answers(name)[1])


def test_quality_of_held_out_rows(spark):
    larger = TABLES.replace("sf0.001", "sf0.01")  # a fifth of the labels of the smallest tables are 19 rows
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{larger}/labels.parquet").collect()}
    held = [r for r in QUERIES["op1"](spark, larger).collect() if r.held_out and r.doc_id in quality]
    assert all(r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in held)
    assert sum(r.predicted == quality[r.doc_id] for r in held) >= 0.9 * len(held)


def test_languages_of_held_out_rows(spark, answers):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{TABLES}/documents.parquet").collect()}
    held = [r for r in answers("op9")[1] if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.95 * len(held)


def test_classes_beat_the_base_on_held_out_texts(answers):
    held = [r for r in answers("op5")[1] if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_neighbours_equal_brute_force(spark, answers):
    import numpy as np

    vectors = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{TABLES}/embeddings.parquet").collect()}
    got = {}
    for r in answers("op3")[1]:
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    assert set(got) == {i for i in vectors if i % 20 == 0}
    for q, found in got.items():
        best = sorted((-(vectors[q] * v).sum(), i) for i, v in vectors.items() if i != q)[:20]
        assert [found[k + 1][0] for k in range(20)] == [i for _, i in best]
        assert np.allclose([found[k + 1][1] for k in range(20)], [-s for s, _ in best], atol=1e-12)


def test_personal_data_of_known_form(spark, answers):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{TABLES}/documents.parquet").collect()}
    for r in answers("op8")[1]:
        spans = [s.split(":") for s in r.spans.split(",") if s]
        plain = re.findall(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", texts[r.doc_id])
        assert r.n_email == len(plain)
        assert {texts[r.doc_id][int(a) : int(b)] for kind, a, b in spans if kind == "email"} >= set(plain)


def test_verdicts_follow_the_rules(answers):
    for r in answers("op6")[1]:
        if r.rule in ("org/", "com/fr/"):
            assert r.verdict == "allow"
        elif r.rule:
            assert r.verdict == "block"
        assert r.verdict in ("allow", "block")
