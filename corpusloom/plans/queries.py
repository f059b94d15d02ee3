"""One query per operator, over the whole of the given tables."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from corpusloom.functions import arrays as A, numbers as N, python as PY, text as X
from corpusloom.operators import (
    classification as C,
    classifier as ML,
    examples as E,
    losses as L,
    overlap as O,
    packing as P,
    planning as PL,
    runs as R,
    sampling as S,
    vocabulary as V,
)
from corpusloom.operators.ordering import row_index, shuffled_index
from corpusloom.plans import fixtures as fx, jobs as J
from corpusloom.plans.fixtures import LANGUAGES, NUM_CLASSES, SEED, table, texts
from corpusloom.session import scratch_folder, staged
from corpusloom.sources import datasets as DS, examples as EX, logs as LG, shards as SH
from corpusloom.streaming import streams as ST

TOP_WORDS = 50_000
SHARD_SIZE = 50_000
BATCH_LENGTH, WORLD = 512, 4
SEQUENCE = 4096
PART_SIZE = SEQUENCE * 64
WINDOW_BLOCKS = 8
CONTEXT, TARGET_MAX, MAX_NEW = 256, 32, 96
WIDTH = 128
EPOCHS, TOKENS_PER_ITER = 3, 8192
FRACTION, HEAD_ROWS, BATCH_SIZE = 0.3, 20, 16
EVAL_BATCHES, EVAL_ROWS = 40, 100
FILE_ROWS = 64

Query = Callable[[SparkSession, str], DataFrame]


def rounded(column: Column) -> Column:
    return F.round(column.cast("double"), 6)


# --- corpus -----------------------------------------------------------------


def vocabulary(spark: SparkSession, sf_dir: str, blocks: DataFrame | None = None) -> DataFrame:
    """All pieces of all documents, counted once."""
    return staged(V.build_vocab(texts(spark, sf_dir), blocks=blocks), "vocabulary")


def encoded(spark: SparkSession, sf_dir: str, blocks: DataFrame | None = None) -> DataFrame:
    """``(doc_id, ids)``, the document mark first, ids checked to fit in 31 bits. Texts are split once."""
    docs = texts(spark, sf_dir)
    blocks = V.text_blocks(docs) if blocks is None else blocks
    ids = V.tokenize_corpus(docs, vocabulary(spark, sf_dir, blocks), blocks=blocks)
    return ids.select("doc_id", A.checked_ids(A.prepend(F.col("ids"), V.EOT), 31, F.col("doc_id")).alias("ids"))


def lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, n_ids)``. A word-level code has one id per piece, so no lookup is needed.

    Stored once, because the running total reads it several times.
    """
    counted = texts(spark, sf_dir).select("doc_id", (X.piece_count("text") + 1).cast("long").alias("n_ids"))
    return staged(counted, "lengths")


def offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.token_offsets(lengths(spark, sf_dir))


def parts(spark: SparkSession, sf_dir: str, size: int) -> DataFrame:
    """The stream in parts of ``size`` ids, each in one task."""
    blocks = V.text_blocks(texts(spark, sf_dir))
    counted = staged(V.block_lengths(blocks).select("doc_id", (F.col("n_pieces") + 1).alias("n_ids")), "lengths")
    placed = staged(P.token_offsets(counted), "offsets")
    return P.gathered_parts(P.slices_by_part(encoded(spark, sf_dir, blocks), placed, size))


def shard_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    shard = F.col("part")
    return parts(spark, sf_dir, SHARD_SIZE).select(
        "part", P.split_name(shard).alias("split"), P.shard_file(shard).alias("file"), "doc_id", "lo", "hi", "ids"
    )


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream in sequences of 4,096 ids: ``(part, seq, ids)``."""
    return P.sequences_of_parts(parts(spark, sf_dir, PART_SIZE), PART_SIZE, SEQUENCE)


def vocab_top(spark, sf_dir):
    return V.build_vocab(texts(spark, sf_dir), TOP_WORDS)


def vocab_all(spark, sf_dir):
    return V.build_vocab(texts(spark, sf_dir))


def doc_token_stats(spark, sf_dir):
    return V.doc_token_stats(texts(spark, sf_dir), "lang", X.piece_count("text")).withColumn(
        "mean_tokens", rounded(F.col("mean_tokens"))
    )


def encoded_docs(spark, sf_dir):
    return encoded(spark, sf_dir).select(
        "doc_id", F.size("ids").cast("long").alias("n_ids"), A.id_digest(F.col("ids")).alias("ids_md5")
    )


def decoded_docs(spark, sf_dir):
    docs = texts(spark, sf_dir)
    blocks = V.text_blocks(docs)
    vocab = vocabulary(spark, sf_dir, blocks)
    ids = V.tokenize_corpus(docs, vocab, blocks=blocks)
    return V.decode_tokens(ids, vocab).select("doc_id", F.md5("text").alias("text_md5"))


def special_ids(spark, sf_dir):
    """Ids of names that are words of the corpus, so that they follow from its counts; the last names are not there."""
    vocab = vocabulary(spark, sf_dir)
    rules = {
        "first_name": (("the", "de"), V.DOCUMENT_END_DEFAULT),
        "second_name": (("[none]", "und", "que"), V.TARGET_END_DEFAULT),
        "absent_name": (("[none]", "[neither]"), V.TARGET_END_DEFAULT),
    }
    parts = [V.resolve_special(vocab, *rule).withColumn("rule", F.lit(name)) for name, rule in rules.items()]
    return S.concat(parts).select("rule", "id")


def token_offsets(spark, sf_dir):
    return offsets(spark, sf_dir).select("doc_id", "start_pos", "end_pos")


def shard_pieces(spark, sf_dir):
    cut = P.cut_shards(offsets(spark, sf_dir), SHARD_SIZE)
    return cut.select("shard", "split", "doc_id", "lo", "hi")


def shard_sizes(spark, sf_dir):
    cut = P.cut_shards(offsets(spark, sf_dir), SHARD_SIZE)
    return cut.groupBy(P.shard_file(F.col("shard")).alias("file")).agg(F.sum(F.col("hi") - F.col("lo")).alias("tokens"))


def shard_counts(spark, sf_dir):
    return PL.count_tokens(shard_sizes(spark, sf_dir))


def shard_summary(spark, sf_dir):
    """Documents to shards in one plan: content check per shard."""
    slices = shard_slices(spark, sf_dir)
    unknown = F.size(F.filter("ids", lambda x: x == V.UNK))
    weighted = F.aggregate(
        F.transform("ids", lambda x, i: x.cast("long") * ((F.col("lo") + i) % 1009)), F.lit(0).cast("long"), lambda a, x: a + x
    )
    return slices.groupBy("part", "file", "split").agg(
        F.count(F.lit(1)).alias("docs"),
        F.sum(F.size("ids")).alias("tokens"),
        F.sum(unknown).alias("unknown"),
        F.sum(weighted).alias("checksum"),
    ).drop("part")


def iteration_plan(spark, sf_dir):
    return PL.plan_iterations(PL.train_files(shard_sizes(spark, sf_dir)), EPOCHS, TOKENS_PER_ITER)


def train_batches(spark, sf_dir):
    batches = P.train_batches(shard_slices(spark, sf_dir), BATCH_LENGTH, WORLD, "part")
    return batches.select(
        "file",
        "batch",
        "rank",
        "first_pos",
        A.id_digest(A.next_token_inputs(F.col("ids"))).alias("inputs_md5"),
        A.id_digest(A.next_token_targets(F.col("ids"))).alias("targets_md5"),
    )


def doc_segments(spark, sf_dir):
    return P.segment_docs(sequences(spark, sf_dir), V.EOT)


def block_ranges(spark, sf_dir):
    ranges = P.block_ranges(sequences(spark, sf_dir), V.EOT)
    return ranges.select("seq", "block", F.col("doc_low").cast("long"), F.col("doc_high").cast("long"))


def block_overlap(spark, sf_dir):
    overlap = P.block_overlap(P.block_ranges(sequences(spark, sf_dir), V.EOT), WINDOW_BLOCKS)
    return overlap.select(
        "seq",
        "q_block",
        "partial_n",
        "full_n",
        *[F.col(c).cast("long").alias(c) for c in ("partial_from", "partial_to", "full_from")],
        F.col("partial_kept").cast("long").alias("partial_kept"),
        F.col("full_kept").cast("long").alias("full_kept"),
    )


def file_plan(spark, sf_dir):
    return P.file_order(shard_sizes(spark, sf_dir).select("file"), EPOCHS, SEED)


def batch_schedule(spark, sf_dir):
    """The steps of all passes with the rows they take: files long enough for a batch, in seeded order."""
    batches = staged(train_batches(spark, sf_dir), "batches")
    needed = F.col("tokens") > BATCH_LENGTH * WORLD
    files = staged(PL.train_files(shard_sizes(spark, sf_dir)).where(needed), "files")
    steps = P.batch_schedule(files, EPOCHS, BATCH_LENGTH, WORLD, SEED)
    return steps.join(batches, ["file", "batch", "rank"]).select("step", "epoch", "file", "batch", "rank", "inputs_md5")


def written_shards(spark: SparkSession, sf_dir: str) -> str:
    """Folder of shards of all documents; texts are encoded once."""
    path = scratch_folder(spark, "shards")
    vocab = vocabulary(spark, sf_dir)
    J.corpus_to_shards(texts(spark, sf_dir), J.vocabulary_coder(vocab), path, V.EOT, vocab.count(), shard_size=SHARD_SIZE)
    return path


def shard_slice(spark, sf_dir):
    """One split and a range of shards; the source plans tasks for these files alone."""
    chunks = SH.read_token_shards(spark, written_shards(spark, sf_dir))
    some = chunks.where((F.col("split") == "train") & F.col("shard_index").between(2, 4))
    total = F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a + x)
    return some.groupBy("shard_index").agg(F.sum(F.size("ids")).alias("tokens"), F.sum(total).alias("id_sum"))


def shard_roundtrip(spark, sf_dir):
    path = written_shards(spark, sf_dir)
    chunks = SH.read_token_shards(spark, path)
    total = F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a + x)
    content = chunks.groupBy("file").agg(
        F.min_by(F.get("ids", F.lit(0)), "lo").alias("first_id"),
        F.max_by(F.element_at("ids", -1), "lo").alias("last_id"),
        F.sum(total).alias("id_sum"),
    )
    return SH.scan_shard_headers(spark, path).join(content, "file").select(
        "file", "split", "tokens", "first_id", "last_id", "id_sum"
    )


# --- classification -----------------------------------------------------------


def joined_text(spark, sf_dir):
    pairs = fx.text_pairs(spark, sf_dir)
    return pairs.select("conv_id", "turn", F.md5(X.join_text("premise", "hypothesis")).alias("text_md5"))


def class_examples(spark, sf_dir):
    rows = fx.classified(spark, sf_dir)
    vocab = vocabulary(spark, sf_dir)
    ids = V.tokenize_corpus(rows, vocab, keep=["label"], first=WIDTH)
    return E.classification_examples(ids, WIDTH)


def fixed_width(spark, sf_dir):
    return class_examples(spark, sf_dir).select(
        "doc_id",
        A.id_digest(F.col("input_ids")).alias("ids_md5"),
        F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).cast("long").alias("mask_sum"),
        F.col("last_index").cast("long").alias("last_idx"),
    )


def example_files(spark, sf_dir):
    path = scratch_folder(spark, "examples")
    DS.write_examples(class_examples(spark, sf_dir).select("doc_id", "label", "input_ids"), path)
    saved = DS.read_examples(spark, path)
    DS.write_examples(saved.where("label = 1"), path)  # changes nothing: the folder exists
    return DS.read_examples(spark, path).select("doc_id", "label", A.id_digest(F.col("input_ids")).alias("ids_md5"))


def class_weights(spark, sf_dir):
    weights = C.class_weights(fx.classified(spark, sf_dir), 3)
    return weights.select("label", "n", rounded(F.col("pct")).alias("pct"), rounded(F.col("weight")).alias("weight"))


def class_distribution(spark, sf_dir):
    shares = C.class_distribution(fx.scored_examples(spark, sf_dir))
    return shares.select("label", "n", rounded(F.col("pct")).alias("pct"))


def example_plan(spark, sf_dir):
    return PL.example_iterations(fx.classified(spark, sf_dir), WIDTH, BATCH_SIZE, 2, EPOCHS)


def predicted(spark, sf_dir):
    return fx.scored_examples(spark, sf_dir).select("ex_id", "label", A.argmax_class(F.col("logits")).alias("pred"), "logits")


def confusion(spark, sf_dir):
    return C.confusion_matrix(predicted(spark, sf_dir), classes=range(NUM_CLASSES))


def class_universe(spark, sf_dir):
    return C.class_universe(predicted(spark, sf_dir))


def class_report(spark, sf_dir):
    report = C.class_report(predicted(spark, sf_dir))
    scores = ("precision", "recall", "f1", "f2", "accuracy")
    return report.select("label", "support", *[rounded(F.col(s)).alias(s) for s in scores])


def overall_report(spark, sf_dir):
    return C.overall_report(predicted(spark, sf_dir)).select("metric", rounded(F.col("value")).alias("value"))


def overall_accuracy(spark, sf_dir):
    """Predictions that come without labels, joined to these by example."""
    labels = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("ex_id"), F.col("label").cast("long").alias("label"))
    aligned = C.align_predictions(predicted(spark, sf_dir).select("ex_id", "pred"), labels)
    return C.accuracy(aligned, ["label"]).select("label", rounded(F.col("accuracy")).alias("accuracy"))


def argmax_topk(spark, sf_dir):
    scored = fx.scored_examples(spark, sf_dir)
    best = A.top_classes(A.mask_vocab_tail(F.col("logits"), 8), 3)
    rows = scored.select("ex_id", A.argmax_class(F.col("logits")).alias("pred"), F.posexplode(best).alias("k", "best"))
    return rows.select(
        "ex_id",
        "pred",
        F.col("k").cast("long").alias("k"),
        F.col("best.cls").alias("cls"),
        rounded(F.col("best.logp")).alias("logp"),
    )


def batch_metrics(spark, sf_dir):
    drawn = C.draw_batches(predicted(spark, sf_dir), "ex_id", EVAL_BATCHES, BATCH_SIZE, SEED)
    means = C.batch_mean_metrics(drawn)
    return means.select("batches", *[rounded(F.col(m)).alias(m) for m in ("mean_loss", "mean_accuracy", "mean_f2")])


def weighted_ce(spark, sf_dir):
    scored = fx.scored_examples(spark, sf_dir)
    loss = C.weighted_cross_entropy(scored, C.class_weights(scored, NUM_CLASSES))
    return loss.select(rounded(F.col("loss")).alias("loss"))


def usable_datasets(spark, sf_dir):
    names = ("documents", "conversations", "benchmark", "pages")
    usable, lacking = E.require_columns({n: table(spark, sf_dir, n) for n in names}, ["text"])
    counted = [
        df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("dataset"), "rows", F.lit("").alias("lacking"))
        for name, df in usable.items()
    ]
    skipped = [(name, 0, ",".join(columns)) for name, columns in lacking.items()]
    reported = spark.createDataFrame(skipped, "dataset string, rows long, lacking string")
    return S.concat([*counted, reported]).drop("part")


def _salted_scorer():
    """Scores from a function a caller might supply: ids of a row to one value per class."""

    def load():
        salts = np.arange(1, 4, dtype=np.int64)

        def run(matrix):
            return (matrix.astype(np.int64).sum(axis=1)[:, None] * salts) % 97

        return run

    return PY.scorer(load)


def scored(spark, sf_dir):
    logits = _salted_scorer()("input_ids")
    return class_examples(spark, sf_dir).select("doc_id", logits.alias("logits")).select(
        "doc_id", A.argmax_class(F.col("logits")).alias("pred")
    )


def ml_classifier(spark, sf_dir):
    """Test rows, and whether the classifier chosen on validation rows is right on more of them than their most frequent label."""
    rows = staged(ML.split_rows(fx.classified(spark, sf_dir), SEED), "classified")
    model, _ = ML.choose_classifier(rows, 2)
    test = rows.where("part = 'test'")
    found = C.align_predictions(ML.classify(model, test), test.select("doc_id", "label"), "doc_id")
    counts = staged(C.confusion_counts(found), "cells")
    most = counts.groupBy("label").agg(F.sum("n").alias("n")).agg(F.max("n").alias("most"))
    right = counts.agg(F.sum("n").alias("rows"), F.sum(F.when(F.col("label") == F.col("pred"), F.col("n"))).alias("right"))
    share = right.join(most, F.col("right") > F.col("most"), "left")  # one row each
    return share.select("rows", F.col("most").isNotNull().alias("beats_majority"))


def chosen_rows(spark, sf_dir):
    """Documents that a Python test keeps: those with an even number of different characters."""
    even = PY.predicate(lambda text: text is not None and len(set(text)) % 2 == 0)
    return table(spark, sf_dir, "documents").where(even("text")).select("doc_id", "n_chars")


def _centred(batch):
    return batch.assign(offset=batch["n_chars"] - batch["n_chars"].min())


def batch_function(spark, sf_dir):
    """A pandas function over batches of rows: how much longer each text is than the shortest of its batch."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("long").alias("n_chars"))
    batched = row_index(docs, "doc_id").withColumn("batch_id", N.whole(F.col("row_index"), BATCH_SIZE)).drop("row_index")
    made = PY.map_batches(batched, _centred, "doc_id long, n_chars long, batch_id long, offset long")
    return made.select("doc_id", "batch_id", "offset")


def binary_examples(spark, sf_dir):
    """Example files in dataset order: position over files and rows, and what is there."""
    path = scratch_folder(spark, "binary")
    rows = class_examples(spark, sf_dir).select("doc_id", "label", "input_ids")
    EX.write_example_files(rows, path, WIDTH, "doc_id", FILE_ROWS)
    EX.write_example_files(rows.limit(0), path, WIDTH, "doc_id")  # changes nothing: files are there
    saved = EX.read_example_files(spark, path, WIDTH)
    before = F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = saved.groupBy("file").agg(F.count(F.lit(1)).alias("n")).select("file", before.alias("start"))
    return saved.join(starts, "file").select(
        (F.col("start") + F.col("row")).alias("position"), "label", A.id_digest(F.col("input_ids")).alias("ids_md5")
    )


def numbered_docs(spark, sf_dir):
    """Documents written to several files and read back with their position in them."""
    path = scratch_folder(spark, "numbered")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs.repartitionByRange(7, "doc_id").sortWithinPartitions("doc_id").write.parquet(path)
    return DS.read_numbered(spark, path, "position").select("position", "doc_id", F.md5("text").alias("text_md5"))


def classifier_document(spark, sf_dir):
    """The evaluation document, read back: metrics of a dataset that is there, and the ones that are not."""
    path = scratch_folder(spark, "evaluation")
    rows = predicted(spark, sf_dir)
    folders = {"kept/all": rows, "kept/bare": rows.drop("pred")}
    for name, df in folders.items():
        df.write.parquet(f"{path}/{name}")
    loaders = {f"{path}/{n}": (lambda n=n: spark.read.parquet(f"{path}/{n}")) for n in (*folders, "kept/absent")}
    J.evaluate_predictions(loaders, f"{path}/out")
    document = DS.read_document(spark, f"{path}/out/evaluation.json")
    if sorted(document["skipped"]) != ["absent", "bare"]:
        raise RuntimeError(f"unexpected skips: {document['skipped']}")
    measured = document["datasets"]["all"]
    names = ("examples", "loss", "accuracy", "macro_f1", "macro_f2", "macro_recall")
    values = [(n, round(float(measured[n]), 6)) for n in names]
    values += [(f"confusion_{a}_{b}", float(n)) for a, b, n in measured["confusion"]]
    return spark.createDataFrame(values, "metric string, value double")


# --- languages, sampling ------------------------------------------------------


def mix_natural(spark, sf_dir):
    rows = fx.summaries(table(spark, sf_dir, "documents")).select("doc_id", "language")
    return S.mix_languages(rows, "natural", LANGUAGES, "doc_id", SEED).select("out_pos", "language", "doc_id")


def mix_balanced(spark, sf_dir):
    rows = fx.summaries(table(spark, sf_dir, "documents")).select("doc_id", "language")
    return S.mix_languages(rows, "balanced", LANGUAGES, "doc_id", SEED).select("out_pos", "language", "draw", "doc_id")


def language_sample(spark, sf_dir):
    rows = fx.summaries(table(spark, sf_dir, "documents")).select("doc_id", "language")
    kept = S.sample_per_language(rows, LANGUAGES, ["doc_id"], FRACTION, SEED)
    return shuffled_index(kept, SEED, ["doc_id"]).select("out_pos", "language", "doc_id")


def language_head(spark, sf_dir):
    return S.head_per_language(fx.summaries(table(spark, sf_dir, "documents")).select("doc_id", "language"), "doc_id", HEAD_ROWS)


def language_index(spark, sf_dir):
    rows = fx.summaries(table(spark, sf_dir, "documents")).select("doc_id", "language")
    return row_index(rows, "doc_id", ["language"])


def seeded_order(spark, sf_dir):
    return S.seeded_order(table(spark, sf_dir, "orders").select("o_orderkey"), SEED, "o_orderkey")


def drawn_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return S.draw_with_replacement(rows, "doc_id", 5000, SEED)


def concat_datasets(spark, sf_dir):
    names = ("documents", "conversations", "benchmark")
    joined = S.concat([table(spark, sf_dir, n).select("text") for n in names])
    return joined.groupBy("part").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.length("text")).alias("chars"))


def dataset_split(spark, sf_dir):
    path = scratch_folder(spark, "dataset")
    rows = fx.summaries(table(spark, sf_dir, "documents")).select("doc_id", "text", "split", F.col("language").alias("config"))
    DS.write_partitioned(rows, path, ["config", "split"])
    return DS.read_dataset(spark, path, "en", "validation").select("doc_id", F.length("text").cast("long").alias("chars"))


def language_scan(spark, sf_dir):
    path = scratch_folder(spark, "languages")
    rows = fx.summaries(table(spark, sf_dir, "documents")).select("doc_id", "summary", "language", "split")
    DS.write_partitioned(rows, path, ["language", "split"])
    read = DS.read_languages(spark, path, ("de", "fr"), "train")
    return read.groupBy("language").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.length("summary")).alias("chars"))


# --- prompt and target packs ----------------------------------------------------


def prompts(spark, sf_dir):
    parts, rows = [], fx.summaries(texts(spark, sf_dir))
    for form in E.REPRESENTATIONS:
        chosen = E.select_representation(rows, form, ["doc_id", "language"])
        parts.append(E.prompts(chosen).select(F.lit(form).alias("form"), "doc_id", F.md5("prompt").alias("prompt_md5")))
    return S.concat(parts).drop("part")


def prompt_ids(
    spark: SparkSession, sf_dir: str, first: dict[str, int] | None = None, vocab: DataFrame | None = None
) -> DataFrame:
    """Prompts and summaries as ids, one row per document."""
    docs = fx.summaries(texts(spark, sf_dir))
    rows = E.prompts(E.select_representation(docs, "text", ["doc_id", "language", "split"]))
    return V.tokenize(
        rows,
        vocabulary(spark, sf_dir) if vocab is None else vocab,
        {"prompt_ids": F.col("prompt"), "target_ids": X.as_text("target")},
        keep=["language", "split"],
        first=first,
    )


PACK_IDS = {"prompt_ids": CONTEXT, "target_ids": TARGET_MAX}  # a pack has no room for later ids


def encoded_packs(spark: SparkSession, sf_dir: str, vocab: DataFrame | None = None) -> DataFrame:
    return E.drop_skipped(E.encode_packs(prompt_ids(spark, sf_dir, PACK_IDS, vocab), CONTEXT, TARGET_MAX, V.EOT))


def numbered_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries with keys that count from 0 in each language, as datasets of one language have them."""
    rows = fx.summaries(texts(spark, sf_dir))
    return rows.join(row_index(rows.select("doc_id", "language"), "doc_id", ["language"], "number"), ["doc_id", "language"])


def packs(spark, sf_dir):
    return encoded_packs(spark, sf_dir).select(
        "doc_id",
        "prompt_len",
        "target_len",
        A.id_digest(F.col("input_ids")).alias("ids_md5"),
        A.id_digest(F.col("labels")).alias("labels_md5"),
    )


def tight_packs(spark, sf_dir):
    """A context so small that long targets leave no room, and the closing cue is kept."""
    made = E.encode_packs(prompt_ids(spark, sf_dir), 24, TARGET_MAX, V.EOT, suffix_len=2)
    return made.select("doc_id", "skip", "prompt_len", A.id_digest(F.col("input_ids")).alias("ids_md5"))


def pack_counts(spark, sf_dir):
    return E.require_nonempty(E.split_counts(encoded_packs(spark, sf_dir)))


def pack_files(spark, sf_dir):
    path = scratch_folder(spark, "packs")
    DS.write_packs(encoded_packs(spark, sf_dir), path, {"context_len": CONTEXT, "languages": LANGUAGES}, E.SPLITS)
    if not DS.packs_complete(spark, path):
        raise RuntimeError("packs are incomplete")
    read = DS.read_packs(spark, path)
    return read.groupBy("split", "language").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("prompt_len").alias("prompt_ids"), F.sum("target_len").alias("target_ids")
    )


def pack_build(spark, sf_dir):
    """Training packs of a balanced mix, with keys that repeat over languages: encoded once, then drawn and sampled."""
    rows = numbered_summaries(spark, sf_dir).where("split = 'train'")
    chosen = E.prompts(E.select_representation(rows, "text", ["number", "language"]))
    ids = {"prompt_ids": F.col("prompt"), "target_ids": X.as_text("target")}
    coded = V.tokenize(chosen, vocabulary(spark, sf_dir), ids, ["number"], ["language"], first=PACK_IDS)
    train = staged(E.drop_skipped(E.encode_packs(coded, CONTEXT, TARGET_MAX, V.EOT)), "train")
    built = J.mixed_rows(train, "balanced", LANGUAGES, FRACTION, SEED, "number")
    return built.groupBy("language").agg(
        F.count(F.lit(1)).alias("rows"),
        F.countDistinct("number").alias("docs"),
        F.sum(F.col("out_pos") * (F.col("number") + 1)).alias("order_sum"),
        F.sum("prompt_len").alias("prompt_ids"),
        F.sum("target_len").alias("target_ids"),
    )


def padded_batches(spark, sf_dir):
    batched = E.number_batches(staged(encoded_packs(spark, sf_dir), "packs"), "doc_id", BATCH_SIZE)
    padded = E.pad_batch(batched)
    mask = F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x)
    return padded.groupBy("batch_id").agg(
        F.max("width").cast("long").alias("width"),
        F.sum("pad_cells").alias("pad_cells"),
        F.sum(mask).alias("mask_sum"),
        F.sum(F.size(F.filter("labels", lambda x: x == A.IGNORE))).alias("ignored"),
    )


def gen_prompts(spark, sf_dir):
    frequent = V.FIRST_WORD_ID + 1
    kept = A.generation_prompt(F.col("prompt_ids"), CONTEXT, MAX_NEW)
    return prompt_ids(spark, sf_dir).select(
        "doc_id",
        F.size(kept).alias("prompt_len"),
        F.size(A.cut_at(F.col("target_ids"), frequent)).alias("cut_len"),
        A.id_digest(A.last_n(F.col("prompt_ids"), 64)).alias("tail_md5"),
    )


def token_loss_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocab = vocabulary(spark, sf_dir)
    scores = staged(L.unigram_scores(vocab), "scores")
    return L.token_loss(L.score_labels(encoded_packs(spark, sf_dir, vocab), scores))


def token_loss(spark, sf_dir):
    report = L.summarise_groups(token_loss_rows(spark, sf_dir), ["loss"], "num_tokens")
    return report.select("language", "num_tokens", rounded(F.col("loss")).alias("loss"))


# --- generated text -------------------------------------------------------------


def rouge_n(spark, sf_dir):
    scores = O.rouge_n(fx.generations(spark, sf_dir))
    return scores.select("language", *[rounded(F.col(m)).alias(m) for m in ("rouge1", "rouge2")])


def rouge_n_ascii(spark, sf_dir):
    scores = O.rouge_n(fx.generations(spark, sf_dir), sizes=(1, 2, 3), ascii_only=True)
    return scores.select("language", *[rounded(F.col(m)).alias(m) for m in ("rouge1", "rouge2", "rouge3")])


def rouge_l(spark, sf_dir):
    return O.rouge_l(fx.generations(spark, sf_dir)).select("language", rounded(F.col("rougeL")).alias("rougeL"))


def bleu(spark, sf_dir):
    return O.corpus_bleu(fx.generations(spark, sf_dir)).select("language", rounded(F.col("bleu")).alias("bleu"))


GENERATION_METRICS = ("rouge1", "rouge2", "rougeL", "bleu")


def generation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.generations(spark, sf_dir)
    counted = rows.groupBy("language").agg(F.count(F.lit(1)).alias("num_examples"))
    scored_rows = (
        counted.join(O.rouge_n(rows), "language").join(O.rouge_l(rows), "language").join(O.corpus_bleu(rows), "language")
    )
    return L.summarise_groups(scored_rows, GENERATION_METRICS, "num_examples")


def language_report(spark, sf_dir):
    """The report as it is read back from its CSV file."""
    path = scratch_folder(spark, "report")
    DS.write_report(generation_report(spark, sf_dir), path, ["position", "language"], "csv")
    schema = "language string, num_examples long, rouge1 double, rouge2 double, rougeL double, bleu double, position int"
    saved = spark.read.schema(schema).option("header", True).csv(path)
    return saved.select("language", "num_examples", *[rounded(F.col(m)).alias(m) for m in GENERATION_METRICS])


# --- runs -------------------------------------------------------------------------


def parsed_logs(spark, sf_dir):
    path = scratch_folder(spark, "logs")
    fx.training_runs(spark, sf_dir).select("run", "line").write.partitionBy("run").text(path)
    logs = LG.read_run_logs(spark, path, r"run=(\d+)")
    return logs.select(
        F.col("run").cast("long").alias("run"), "step", "total_steps", "train_loss", "val_loss", "train_time", "step_avg"
    )


def run_summary(spark, sf_dir):
    logs = R.parse_log_lines(fx.training_runs(spark, sf_dir).select("run", "line"))
    step_time = rounded(F.col("mean_step_ms")).alias("mean_step_ms")
    return R.run_summary(logs).select("run", "best_val", "last_step", "last_val", step_time)


def loss_windows(spark, sf_dir):
    means = R.train_loss_since_eval(staged(fx.training_runs(spark, sf_dir).drop("line", "path"), "runs"))
    return means.select("run", "eval_no", "eval_step", "steps", rounded(F.col("mean_train_loss")).alias("mean_train_loss"))


def _touch(root: str):
    """Writes a file of one byte for each path, in the task that has the row."""

    def write(batches):
        for batch in batches:
            fs, folder = SH._filesystem(root)
            for path in batch.column("path").to_pylist():
                fs.create_dir(f"{folder}/{path}".rsplit("/", 1)[0], recursive=True)
                with fs.open_output_stream(f"{folder}/{path}") as out:
                    out.write(b"0")
            yield batch

    return write


def checkpoint_files(spark, sf_dir):
    """The best checkpoint of each form and size from the names of files in folders."""
    root = scratch_folder(spark, "checkpoints")
    rows = fx.training_runs(spark, sf_dir).where("val_loss IS NOT NULL")
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    placed = rows.select(F.concat_ws("/", F.lit("models"), "representation", "size", name).alias("path"))
    placed.mapInArrow(_touch(root), "path string").write.format("noop").mode("overwrite").save()
    best = R.best_per_group(LG.list_checkpoints(spark, root))
    return best.select("representation", "size", "step", "val_loss")


def best_checkpoint(spark, sf_dir):
    rows = fx.training_runs(spark, sf_dir).select("representation", "size", "path")
    found = R.parse_checkpoints(rows)
    wanted = rows.select("representation", "size").distinct()
    return R.require_found(R.best_per_group(found), wanted).select("representation", "size", "step", "val_loss", "path")


def evaluations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.training_runs(spark, sf_dir).where("val_loss is not null").select("run", "step", "val_loss")


def best_so_far(spark, sf_dir):
    rows = staged(evaluations(spark, sf_dir), "evaluations")
    return R.best_so_far(rows).select("run", "step", "val_loss", "prev_best")


# --- scalar rules -----------------------------------------------------------------


def width_rules(spark, sf_dir):
    n = F.col("n_chars")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        N.round_up(n, 128).alias("up"),
        N.round_up_from(n, 1000).alias("up_from"),
        N.context_width(n).alias("context"),
        X.file_label(F.concat(F.lit("hub/Set "), "source")).alias("label"),
    )


# --- streams ----------------------------------------------------------------------


def arriving(spark: SparkSession, sf_dir: str, name: str, schema) -> DataFrame:
    """A table as a stream: the files in its folder or, where it is a single file, that one in the folder of the tables."""
    files = table(spark, sf_dir, name).inputFiles()
    if len(files) == 1 and files[0].endswith(f"/{name}.parquet"):
        return ST.read_stream(spark, sf_dir, schema, f"{name}.parquet")
    return ST.read_stream(spark, f"{sf_dir}/{name}.parquet", schema)


def stream_tokens(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    vocab = vocabulary(spark, sf_dir)
    out = scratch_folder(spark, "tokens")
    stream = arriving(spark, sf_dir, "documents", docs.schema)
    ST.drain(ST.stream_tokenize(stream, vocab, f"{out}/rows", f"{out}/state"))
    weighted = F.transform("ids", lambda x, i: x.cast("long") * (i + 1))
    checksum = F.aggregate(weighted, F.lit(0).cast("long"), lambda a, x: a + x)
    return spark.read.parquet(f"{out}/rows").select("doc_id", F.size("ids").cast("long").alias("tokens"), checksum.alias("checksum"))


def stream_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("lang", "text")
    out = scratch_folder(spark, "counts")
    stream = arriving(spark, sf_dir, "documents", docs.schema)
    ST.drain(ST.stream_count_tokens(stream, f"{out}/totals", f"{out}/state"))
    return ST.latest_totals(spark, f"{out}/totals")


def stream_windows(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("ts", "event_type", "value")
    out = scratch_folder(spark, "windows")
    stream = arriving(spark, sf_dir, "events", events.schema).select(
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("value").alias("loss"),
        F.col("event_type").isin("purchase", "signup").alias("correct"),
    )
    ST.drain(ST.stream_windowed_metrics(stream, f"{out}/rows", f"{out}/state"))
    return spark.read.parquet(f"{out}/rows").select(
        F.unix_micros("window_start").alias("window_us"),
        "n",
        rounded(F.col("mean_loss")).alias("mean_loss"),
        rounded(F.col("accuracy")).alias("accuracy"),
    )


def stream_best(spark, sf_dir):
    out = scratch_folder(spark, "best")
    rows = evaluations(spark, sf_dir)
    rows.write.parquet(f"{out}/evaluations")
    stream = ST.read_stream(spark, f"{out}/evaluations", rows.schema)
    ST.drain(ST.stream_best_so_far(stream, f"{out}/result", f"{out}/state"))
    return spark.read.parquet(f"{out}/result/improvements").select("run", "step", "val_loss", "prev_best")


def stream_best_keyed(spark, sf_dir):
    out = scratch_folder(spark, "best-keyed")
    rows = evaluations(spark, sf_dir)
    rows.write.parquet(f"{out}/evaluations")
    stream = ST.read_stream(spark, f"{out}/evaluations", rows.schema)
    ST.drain(ST.stream_best_by_key(stream, f"{out}/rows", f"{out}/state"))
    return spark.read.parquet(f"{out}/rows").select("run", "step", "val_loss", "prev_best")


def stream_shards(spark, sf_dir):
    """Shards of all documents, counted by a stream of their headers."""
    out = scratch_folder(spark, "shard-counts")
    ST.drain(ST.stream_shard_counts(spark, written_shards(spark, sf_dir), f"{out}/totals", f"{out}/state"))
    return ST.latest_by_key(spark, f"{out}/totals", ["split"])


# --- complete jobs ------------------------------------------------------------------


def corpus_job(spark, sf_dir):
    """Shards from whole documents, then the step plan of their training files."""
    return J.count_training_tokens(spark, written_shards(spark, sf_dir), EPOCHS, TOKENS_PER_ITER)[0]


def pack_job(spark, sf_dir):
    """Packs of datasets whose keys repeat over languages."""
    path = scratch_folder(spark, "packs")
    built = J.build_packs(
        numbered_summaries(spark, sf_dir), J.vocabulary_coder(vocabulary(spark, sf_dir)), path, "text",
        LANGUAGES, V.EOT, "natural", CONTEXT, TARGET_MAX, FRACTION, SEED, key="number",
    )
    return built.groupBy("split", "language").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("prompt_len").alias("prompt_ids"), F.sum("target_len").alias("target_ids")
    )


def classifier_job(spark, sf_dir):
    """Two usable datasets and one without a label, scored by a caller-supplied function."""
    rows = fx.classified(spark, sf_dir)
    vocab = vocabulary(spark, sf_dir)
    datasets = {
        "quality": rows.drop("label2"),
        "toxic": rows.drop("label").withColumnRenamed("label2", "label"),
        "bare": table(spark, sf_dir, "documents"),
    }
    _, report, skipped = J.evaluate_classifier(
        datasets, J.vocabulary_coder(vocab), _salted_scorer(), ["text"], "label", WIDTH
    )
    if skipped != {"bare": ["label"]}:
        raise RuntimeError(f"unexpected skips: {skipped}")
    return report.select("dataset", "label", "support", *[rounded(F.col(s)).alias(s) for s in ("precision", "f2")])


def generation_job(spark, sf_dir):
    """Overlap and token loss of the first rows of each language, the same rows for both."""
    vocab = vocabulary(spark, sf_dir)
    scores = staged(L.unigram_scores(vocab), "scores")
    labels = L.score_labels(encoded_packs(spark, sf_dir, vocab), scores, keep=("doc_id", "language"))
    path = scratch_folder(spark, "generation")
    report = J.evaluate_generation(fx.generations(spark, sf_dir), labels, EVAL_ROWS, path=path)
    metrics = (*GENERATION_METRICS, "token_loss")
    return report.select("language", "split", "num_examples", *[rounded(F.col(m)).alias(m) for m in metrics])


def all_queries() -> dict[str, Query]:
    listed = [
        vocab_top, vocab_all, doc_token_stats, encoded_docs, decoded_docs, special_ids, token_offsets, shard_pieces,
        shard_counts, shard_summary, iteration_plan, train_batches, doc_segments, block_ranges, block_overlap,
        file_plan, batch_schedule, shard_roundtrip, shard_slice, numbered_docs, joined_text, fixed_width, example_files, class_weights, class_distribution,
        example_plan, confusion, class_universe, class_report, overall_report, overall_accuracy, argmax_topk, batch_metrics,
        weighted_ce, usable_datasets, scored, ml_classifier, chosen_rows, batch_function, binary_examples, classifier_document, mix_natural, mix_balanced, language_sample,
        language_head, language_index, seeded_order, drawn_rows, concat_datasets, dataset_split, language_scan,
        prompts, packs, tight_packs, pack_counts, pack_files, pack_build, padded_batches, gen_prompts, token_loss,
        rouge_n, rouge_n_ascii, rouge_l, bleu, language_report, parsed_logs, run_summary, loss_windows,
        best_checkpoint, checkpoint_files, best_so_far, width_rules, stream_tokens, stream_counts, stream_windows, stream_best, stream_best_keyed, stream_shards,
        corpus_job, pack_job, classifier_job, generation_job,
    ]
    return {query.__name__: query for query in listed}
