"""The complete jobs: corpus to shards, pack building, both evaluations.

A job takes DataFrames and a coder, which turns text columns into id arrays:
``vocabulary_coder`` joins with a vocabulary table, ``column_coder`` wraps a
tokenizer file. Costly results are stored once in the checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corpusloom.functions import arrays as A
from corpusloom.functions.text import as_text, join_text
from corpusloom.operators import classification as C
from corpusloom.operators import examples as E
from corpusloom.operators import losses as L
from corpusloom.operators import overlap as O
from corpusloom.operators import packing as P
from corpusloom.operators import planning as PL
from corpusloom.operators import sampling as S
from corpusloom.operators import vocabulary as V
from corpusloom.operators.ordering import shuffled_index
from corpusloom.session import Scratch, staged
from corpusloom.sources import datasets as DS
from corpusloom.sources import shards as SH

Coder = Callable[..., DataFrame]
TASK_IDS = 2 << 20  # ids that one task writes, or one shard's if it has more
DOCUMENT_CELLS = 1 << 16  # label and prediction pairs that one evaluation document lists itself; tables have them all


def vocabulary_coder(vocab: DataFrame) -> Coder:
    """Code pieces by a vocabulary table."""

    def code(df: DataFrame, texts: Mapping[str, Column], key: Sequence[str], keep: Sequence[str] = (), first=None):
        return V.tokenize(df, vocab, texts, key, keep, first=first)

    return code


def column_coder(encode: Callable[[Column], Column]) -> Coder:
    """Code texts by a column function such as :func:`corpusloom.functions.python.encoder`."""

    def code(df: DataFrame, texts: Mapping[str, Column], key: Sequence[str], keep: Sequence[str] = (), first=None):
        # the whole text is encoded: only then is it known which ids come first
        coded = df.select(*key, *keep, *[encode(t).alias(n) for n, t in texts.items()])
        cut = [A.head(F.col(n), first[n]).alias(n) if first and n in first else F.col(n) for n in texts]
        return coded.select(*key, *keep, *cut)

    return code


def corpus_to_shards(
    docs: DataFrame,
    code: Coder,
    path: str,
    eot: int,
    vocab_size: int,
    key: str = "doc_id",
    text: str = "text",
    shard_size: int = 10**8,
    tasks: int | None = None,
) -> DataFrame:
    """Encode documents, cut the stream into shard files, return their headers.

    Encoded documents are stored with their length next to the ids, so that the
    offsets are computed from two thin columns; that table goes when the shards
    are written. Ids move once, to the task that writes their shard. A task writes shards of some
    ``TASK_IDS`` ids one after the other, one shard if that is larger, unless ``tasks`` says how many tasks there are.
    """
    spark = docs.sparkSession
    version = SH.shard_version(vocab_size)
    ids = A.checked_ids(A.prepend(F.col("ids"), eot), 16 if version == 1 else 31, F.col(key))
    coded = code(docs, {"ids": as_text(text)}, [key]).select(key, ids.alias("ids"))
    with Scratch(spark) as scratch:
        stored = staged(coded.withColumn("n_ids", F.size("ids").cast("long")), "encoded", scratch)
        total = stored.agg(F.sum("n_ids")).first()[0] or 0
        if tasks is None:
            tasks = max(1, -(-total // max(shard_size, TASK_IDS)))
        offsets = staged(P.token_offsets(stored.select(key, "n_ids"), key), "offsets", scratch)
        slices = P.slices_by_part(stored.select(key, "ids"), offsets, shard_size, key)
        due = F.least(F.lit(shard_size), F.lit(total) - F.col("part") * shard_size)
        rows = slices.select(F.col("part").alias("shard"), F.col(key).alias("lo"), "ids", due.cast("long").alias("tokens"))
        SH.write_token_shards(rows, path, version, tasks)
    return SH.scan_shard_headers(spark, path)


def count_training_tokens(
    spark: SparkSession, path: str, epochs: int = 1, tokens_per_iter: int = PL.TOKENS_PER_ITER
) -> tuple[DataFrame, DataFrame]:
    """Tokens per training shard with their total, and the steps they give."""
    headers = SH.scan_shard_headers(spark, path, "train")
    return PL.count_tokens(headers), PL.plan_iterations(headers, epochs, tokens_per_iter)


def build_packs(
    rows: DataFrame,
    code: Coder,
    path: str,
    representation: str,
    languages: Sequence[str],
    eos: int,
    mix_mode: str = "balanced",
    context: int = 2048,
    target_max: int = 256,
    fraction: float = 1.0,
    seed: int = 42,
    key: str = "doc_id",
    suffix_len: int = 0,
    force: bool = False,
    source: Mapping[str, str | None] | None = None,
) -> DataFrame:
    """Prompt and target packs of all splits; an earlier complete build is used again.

    ``rows`` has ``key``, ``language``, ``split`` and the text columns. A key is
    unique inside its language and split. Each row is encoded once. The training
    split is then mixed, sampled and shuffled anew, so a row drawn several times
    is not encoded several times. ``source`` goes into the metadata: where rows
    and tokenizer came from.
    """
    spark = rows.sparkSession
    if not force and DS.packs_complete(spark, path):
        return DS.read_packs(spark, path)
    listed = rows.where(F.col("language").isin(*languages))
    chosen = E.prompts(E.select_representation(listed, representation, [key, "language", "split"]))
    first = {"target_ids": target_max} if suffix_len else {"prompt_ids": context, "target_ids": target_max}
    texts = {"prompt_ids": F.col("prompt"), "target_ids": as_text("target")}
    coded = code(chosen, texts, [key], ["language", "split"], first)
    with Scratch(spark) as scratch:
        packs = staged(E.encode_packs(coded, context, target_max, eos, suffix_len), "packs", scratch)
        train = mixed_rows(packs.where("split = 'train'"), mix_mode, languages, fraction, seed, key)
        rest = packs.where("split <> 'train'").withColumn("out_pos", F.lit(None).cast("long"))
        built = E.drop_skipped(train.unionByName(rest)).drop("skip")
        DS.write_packs(built, path, _pack_metadata(representation, mix_mode, context, target_max, fraction, eos, languages, source), E.SPLITS)
    return DS.read_packs(spark, path)


def mixed_rows(rows: DataFrame, mix_mode: str, languages: Sequence[str], fraction: float, seed: int, key: str) -> DataFrame:
    """``rows`` mixed and sampled by language, with their place ``out_pos`` in a new shuffle, from 0 without gaps.

    Keys alone are mixed; full rows are fetched once, by language and key, as keys may repeat over languages.
    """
    drawn = S.mix_languages(rows.select(key, "language"), mix_mode, languages, key, seed)
    unit = ["language", "draw"] if mix_mode == "balanced" else ["language", key]
    kept = S.sample_per_language(drawn, languages, unit, fraction, seed)
    placed = shuffled_index(kept.drop("out_pos"), seed, unit)
    return placed.select("language", key, "out_pos").join(rows, ["language", key])


def _pack_metadata(representation, mix_mode, context, target_max, fraction, eos, languages, source) -> dict:
    # The names that readers of packs look for.
    return {
        "representation": representation,
        "mix_mode": mix_mode,
        "context_len": context,
        "target_max_tokens": target_max,
        "train_sample_frac": fraction,
        "eos_id": eos,
        "languages": list(languages),
        "dataset_repo": (source or {}).get("dataset_repo"),
        "tokenizer_json": (source or {}).get("tokenizer_json"),
    }


def evaluate_classifier(
    datasets: Mapping[str, DataFrame],
    code: Coder,
    score: Callable[[Column], Column],
    text_columns: Sequence[str],
    label_column: str,
    width: int,
    path: str | None = None,
    key: str = "doc_id",
    owner: Scratch | None = None,
) -> tuple[DataFrame, DataFrame, dict[str, list[str]]]:
    """Predictions and class report of each dataset, all in one plan.

    Returns ``(predictions, report, skipped)``. A dataset without the needed
    columns is left out and named in ``skipped`` with what it lacks. The stored
    predictions go with ``owner``, if there is one.
    """
    usable, skipped = E.require_columns(datasets, [key, label_column, *text_columns])
    if not usable:
        raise ValueError(f"no usable dataset: {skipped}")
    named = [
        df.select(
            F.lit(name).alias("dataset"),
            key,
            F.col(label_column).cast("long").alias("label"),
            join_text(*text_columns).alias("text"),
        )
        for name, df in usable.items()
    ]
    rows = S.concat(named).drop("part")
    coded = code(rows, {"ids": F.col("text")}, ["dataset", key], ["label"], {"ids": width})
    inputs = E.classification_examples(coded, width)
    scored = inputs.select("dataset", key, "label", score(F.col("input_ids")).alias("logits"))
    predictions = staged(
        scored.select("dataset", key, "label", A.argmax_class(F.col("logits")).alias("pred"), "logits"), "predictions", owner
    )
    report = C.class_report(predictions, ["dataset"])
    if path:
        predictions.write.mode("overwrite").parquet(f"{path}/predictions")
        DS.write_report(report, f"{path}/classes", ["dataset", "label"])
        DS.write_report(C.macro_and_weighted(report, ["dataset"]), f"{path}/summary", ["dataset"])
        DS.write_report(C.confusion_matrix(predictions, ["dataset"]), f"{path}/confusion", ["dataset", "label", "pred"])
    return predictions, report, skipped


def evaluate_generation(
    generated: DataFrame,
    token_scores: DataFrame | None = None,
    rows_per_language: int = 0,
    split: str = "test",
    path: str | None = None,
    key: str = "doc_id",
    ascii_only: bool = False,
) -> DataFrame:
    """ROUGE, BLEU and token loss per language, then the ``macro`` and ``weighted`` lines.

    ``generated`` has ``key``, ``language``, ``prediction``, ``reference``;
    ``token_scores`` has ``key``, ``language``, ``label``, ``logp`` per scored
    token. With ``rows_per_language`` both count the same rows. With ``path``
    the report is also written as CSV, as JSON lines and as one JSON document.
    """
    rows = S.head_per_language(generated, key, rows_per_language)
    counted = rows.groupBy("language").agg(F.count(F.lit(1)).alias("num_examples"))
    metrics = ["rouge1", "rouge2", "rougeL", "bleu"]
    parts = [
        O.rouge_n(rows, key=key, ascii_only=ascii_only),
        O.rouge_l(rows, ascii_only=ascii_only),
        O.corpus_bleu(rows, key=key),
    ]
    if token_scores is not None:
        metrics.append("token_loss")
        if rows_per_language > 0:
            token_scores = token_scores.join(rows.select("language", key), ["language", key], "left_semi")
        parts.append(L.token_loss(token_scores).select("language", F.col("loss").alias("token_loss")))
    table = counted
    for part in parts:
        table = table.join(part, "language", "left")
    report = L.summarise_groups(table, metrics, "num_examples").withColumn("split", F.lit(split))
    if path:
        stored = staged(report, "report")
        ordered = stored.select("language", "split", "num_examples", *metrics, "position")
        DS.write_report(ordered, f"{path}/csv", ["position", "language"], "csv")
        DS.write_report(ordered, f"{path}/json", ["position", "language"], "json")
        parameters = {"split": split, "rows_per_language": rows_per_language, "ascii_only": ascii_only}
        DS.write_document(generated.sparkSession, f"{path}/report.json", generation_document(ordered, metrics, parameters))
        return ordered
    return report


def generation_document(report: DataFrame, metrics: Sequence[str], parameters: Mapping) -> dict:
    """The report as one document: parameters, ``per_language``, ``macro`` and ``weighted``; one row per language is read."""
    lines = {(r["position"], r["language"]): {c: r[c] for c in ("num_examples", *metrics)} for r in report.collect()}
    return {
        "parameters": dict(parameters),
        "per_language": {name: line for (place, name), line in sorted(lines.items()) if place == 0},
        "macro": next((line for (place, _), line in lines.items() if place == 1), None),
        "weighted": next((line for (place, _), line in lines.items() if place == 2), None),
    }


def loaded_datasets(
    datasets: Mapping[str, Callable[[], DataFrame]], labels: Sequence[str] = ()
) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """Datasets by display name, and why others cannot be read."""
    from pyspark.errors import PySparkException

    loaded, skipped = {}, {}
    for name, shown in E.pair_with_labels(list(datasets), labels):
        try:
            loaded[shown] = datasets[name]()
        except (PySparkException, OSError, ValueError) as error:
            skipped[shown] = f"cannot be read: {str(error).splitlines()[0][:200]}"
    return loaded, skipped


def evaluate_scored(
    datasets: Mapping[str, Callable[[], DataFrame]],
    code: Coder,
    score: Callable[[Column], Column],
    text_columns: Sequence[str],
    label_column: str,
    width: int,
    path: str,
    labels: Sequence[str] = (),
    key: str = "doc_id",
) -> dict:
    """Encode and score several datasets, then evaluate the predictions as :func:`evaluate_predictions` does.

    Each dataset is loaded by its function; one that cannot be loaded or lacks a
    text, label or key column is skipped and named with the reason. All others
    are scored in one plan.
    """
    loaded, skipped = loaded_datasets(datasets, labels)
    usable, lacking = E.require_columns(loaded, [key, label_column, *text_columns])
    skipped |= {name: "lacks " + ", ".join(columns) for name, columns in lacking.items()}
    if not usable:
        raise ValueError(f"no usable dataset: {skipped}")
    with Scratch(next(iter(usable.values())).sparkSession) as scratch:
        predictions, _, _ = evaluate_classifier(usable, code, score, text_columns, label_column, width, key=key, owner=scratch)
        parts = {name: lambda name=name: predictions.where(F.col("dataset") == name) for name in usable}
        return evaluate_predictions(parts, path, list(usable), skipped=skipped)


def evaluate_predictions(
    datasets: Mapping[str, Callable[[], DataFrame]],
    path: str,
    labels: Sequence[str] = (),
    label_column: str = "label",
    pred_column: str = "pred",
    logits_column: str = "logits",
    classes: Sequence[int] | None = None,
    skipped: Mapping[str, str] | None = None,
) -> dict:
    """Evaluate stored predictions of several datasets; writes and returns one JSON document.

    Each dataset is loaded by its function. One that cannot be loaded, or lacks
    the label or prediction column, is skipped and named with the reason. The
    rows of the others, with logits where they have them, go to
    ``path``/predictions, per-class report and confusion matrix to tables beside
    it. The document has the counts and metrics by display name, and these two as
    well if there are at most ``DOCUMENT_CELLS`` pairs of classes. ``skipped``
    names datasets that the caller has left out already.
    """
    loaded, unread = loaded_datasets(datasets, labels)
    usable, lacking = E.require_columns(loaded, [label_column, pred_column])
    skipped = dict(skipped or {}) | unread | {name: "lacks " + ", ".join(columns) for name, columns in lacking.items()}
    if not usable:
        raise ValueError(f"no usable dataset: {skipped}")
    spark = next(iter(usable.values())).sparkSession
    parts = []
    for name, df in usable.items():
        logits = F.col(logits_column).cast("array<double>") if logits_column in df.columns else F.lit(None).cast("array<double>")
        columns = [F.col(c).cast("long").alias(n) for c, n in ((label_column, "label"), (pred_column, "pred"))]
        parts.append(df.select(F.lit(name).alias("dataset"), *columns, logits.alias("logits")))
    S.concat(parts).drop("part").write.mode("overwrite").parquet(f"{path}/predictions")
    rows = spark.read.parquet(f"{path}/predictions")

    with Scratch(spark) as scratch:
        counts = staged(C.confusion_matrix(rows, ["dataset"], classes), "cells", scratch)
        repeated = C.class_report_of_counts(counts, ["dataset"])
        report = staged(repeated, "classes", scratch)
        means = C.macro_and_weighted(report, ["dataset"]).collect()
        losses = {r["dataset"]: r["loss"] for r in C.mean_loss(rows, ["dataset"]).collect()}
        document: dict = {"datasets": {}, "skipped": skipped, "predictions": f"{path}/predictions"}
        for r in means:
            values = {c: r[c] for c in means[0].asDict() if c not in ("dataset", "support")}
            document["datasets"][r["dataset"]] = {"examples": r["support"], "loss": losses.get(r["dataset"]), **values}
        document["skipped"] |= {name: "has no rows" for name in usable if name not in document["datasets"]}
        report.write.mode("overwrite").json(f"{path}/classes")
        counts.write.mode("overwrite").json(f"{path}/confusion")
        document["tables"] = {"classes": f"{path}/classes", "confusion": f"{path}/confusion"}
        if counts.count() <= DOCUMENT_CELLS:  # a class has at least one cell
            for r in report.orderBy("dataset", "label").collect():
                own = document["datasets"][r["dataset"]].setdefault("classes", {})
                own[str(r["label"])] = {c: r[c] for c in ("precision", "recall", "f1", "f2", "support")}
            for r in counts.orderBy("dataset", "label", "pred").collect():
                document["datasets"][r["dataset"]].setdefault("confusion", []).append([r["label"], r["pred"], r["n"]])
    DS.write_document(spark, f"{path}/evaluation.json", document)
    return document
