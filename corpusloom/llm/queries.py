"""The registered queries, one per operator, over its whole table with production parameters."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusloom.llm import (
    bpe, cascade, cells, classlm, infill, language, lexical, mixing, neighbours, privacy, quality, simhash, weblinks,
)
from corpusloom.llm.common import remainder, table
from corpusloom.llm.twins import operator_twins

DOC = "doc_id"
LIKELY = 0.3  # quality score from which a text counts as good
QUERY_IDS = 20  # every 20th vector is a query


def op1_byte_convolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), remainder(DOC, 5) == 0
    network = quality.learn(docs, table(spark, sf_dir, "labels"), ~held_out)
    scored = quality.score(docs.select("doc_id", "text"), network)
    predicted = F.when(F.col("__quality") >= LIKELY, 1).otherwise(0)
    return scored.select(
        "doc_id", held_out.alias("held_out"), F.col("__quality").alias("score"), predicted.alias("predicted")
    )


def rank_file() -> tuple[dict[bytes, int], str]:
    """Ranks and pattern of the public vocabulary that the query encodes with."""
    import public_tokenizers

    return bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN


def op2_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = rank_file()
    finish = bpe.digests(ranks, keep=["doc_id"])
    return bpe.encode(table(spark, sf_dir, "documents"), ranks, pattern, finish, f"doc_id long, {bpe.DIGESTS}")


def op3_hilbert_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % QUERY_IDS == 0)


def op4_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def learned_from(doc_id: object) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5 != 1


def op5_class_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = classlm.scored(table(spark, sf_dir, "documents"), learned_from)
    return scored.withColumn("held_out", remainder(DOC, 5) == 1)


def op6_url_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weblinks.judged(table(spark, sf_dir, "pages"))


def op7_rule_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    judged = cascade.judged(docs.select("doc_id", "text"), cascade.plan(docs)).select("doc_id", "__rules.*")
    failed = (F.col("n_words") < cascade.LEAST_WORDS) | (
        100 * F.col("n_repeat_words") > cascade.MOST_REPEATED * F.col("n_words")
    )
    kept = ~F.col("base_failed") & F.col("failed").isNull()
    return judged.withColumn("base_failed", failed).withColumn("kept", kept).drop("failed")


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    field = privacy.train(privacy.labelled_table())
    found = privacy.find(table(spark, sf_dir, "documents").select("doc_id", "text"), field)
    base = F.col("__personal.base")
    counts = [privacy.count_of(base, kind).alias(f"n_{kind}") for kind in privacy.KINDS]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(privacy.listed(base), 256).alias("base_sha256"),
        privacy.listed(F.col("__personal.spans")).alias("spans"),
    )


def op9_language_kernels(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), remainder(DOC, 4) == 2
    model = language.learn(docs, ~held_out)
    found = language.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), "__language.lang_pred", "__language.score")


def op10_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = infill.fill_in_middle(table(spark, sf_dir, "documents"))
    again = infill.restored(F.col("form"), F.col("output"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(again, 256).alias("restored_sha256"),
    )


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_vector_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells.near_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES = (
    op1_byte_convolution, op2_bpe_roundtrip, op3_hilbert_neighbours, op4_mixture, op5_class_model, op6_url_trust,
    op7_rule_cascade, op8_personal_data, op9_language_kernels, op10_simhash_pivots, op11_fill_in_middle, op12_lexical_search,
    op13_vector_cells,
)


def operator_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {query.__name__: query for query in QUERIES}


def operator_sql() -> dict[str, str]:
    return operator_twins()
