"""A corpus pipeline: language, near-duplicates, personal data, mixture, tokens.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; it is written
as Parquet and read again as the next stage's ``docs``. All but the last return
the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusloom.llm import bpe, language, mixing, privacy, simhash
from corpusloom.llm.common import remainder, table
from corpusloom.llm.queries import rank_file
from corpusloom.session import scratch_folder


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; those without any letter go.

    If no row has a usable label there is no model, and every document with a letter stays.
    """
    model = language.learn(docs, remainder("doc_id", 4) != 2)
    if model is None:
        return language.with_letters(docs)
    found = language.identify(docs, model)
    return found.where(F.col("__language.lang_pred") != language.UNKNOWN).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the least id."""
    return simhash.keep_one(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every span of personal data replaced by its kind."""
    field = privacy.train(privacy.labelled_table())
    return privacy.masked(docs, field)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as many times as the mixture takes it; documents that it does not take go."""
    return mixing.mix(docs)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, ids, n_tokens, ids_sha256, decoded_sha256)`` of every row, copies included."""
    ranks, pattern = rank_file()
    return bpe.encode(docs, ranks, pattern, bpe.digests(ranks), f"doc_id long, ids array<int>, {bpe.DIGESTS}")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", mask_personal_data),
    ("mixture", mix_sources),
    ("tokens", encode_texts),
]

#: Kernel models, fingerprints, Viterbi paths and merges have no SQL form; tests/llm/test_pipeline.py has a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to shared storage and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
