"""Command line: ``python -m corpusloom <job> ...``. See the README for examples."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession, functions as F

from corpusloom.functions import python as PY
from corpusloom.functions.text import as_text
from corpusloom.operators import examples as E, vocabulary as V
from corpusloom.operators.planning import SETUPS
from corpusloom.operators.runs import best_per_group
from corpusloom.plans import jobs
from corpusloom.plans.display import evaluation_text
from corpusloom.session import build_session, staged
from corpusloom.sources import datasets as DS
from corpusloom.sources import logs as LG


def _coder(spark: SparkSession, args, docs, text: str, names, default: int):
    """Coder, end mark and vocabulary size from a tokenizer file, or from a vocabulary counted on column ``text``."""
    if args.tokenizer:
        mark, size = PY.tokenizer_specials(spark, args.tokenizer, names, default)
        return jobs.column_coder(PY.encoder(PY.tokenizer_json(spark, args.tokenizer))), mark, size
    vocab = staged(V.build_vocab(docs, args.vocab_words, text), "vocabulary")
    return jobs.vocabulary_coder(vocab), V.EOT, vocab.count()


def preprocess(spark: SparkSession, args) -> None:
    docs = DS.read_dataset(spark, args.dataset, args.dataset_config, args.split, args.format)
    if args.key is None:
        if args.format != "parquet":
            raise SystemExit(f"{args.format} rows have no position of their own: name an integer column with --key")
        docs = DS.number_rows(docs)
    code, eot, size = _coder(spark, args, docs, args.text_field, V.DOCUMENT_END_NAMES, V.DOCUMENT_END_DEFAULT)
    eot = eot if args.eot_token is None else args.eot_token
    headers = jobs.corpus_to_shards(
        docs, code, args.output_dir, eot, size, args.key or "doc_id", args.text_field, args.shard_size, args.tasks
    )
    headers.select("file", "tokens").orderBy("shard_index").show(50, truncate=False)


def count_tokens(spark: SparkSession, args) -> None:
    tokens = args.tokens_per_iter or SETUPS[args.setup]
    per_file, plan = jobs.count_training_tokens(spark, args.data_dir, args.epochs, tokens)
    per_file.orderBy(F.col("file").asc_nulls_last()).show(50, truncate=False)
    plan.show()


def build_packs(spark: SparkSession, args) -> None:
    rows = spark.read.parquet(args.dataset)
    shown = E.prompts(E.select_representation(rows, args.representation, ["language"]))
    seen = shown.select(F.explode(F.array("prompt", as_text("target"))).alias("text"))  # what the packs will hold
    code, eos, _ = _coder(spark, args, seen, "text", V.TARGET_END_NAMES, V.TARGET_END_DEFAULT)
    built = jobs.build_packs(
        rows, code, args.output_dir, args.representation, args.languages.split(","), eos, args.mix_mode,
        args.context_len, args.target_max_tokens, args.train_sample_frac, args.seed, args.key, force=args.force,
        source={"dataset_repo": args.dataset, "tokenizer_json": args.tokenizer},
    )
    built.groupBy("split").count().show()


def evaluate_generation(spark: SparkSession, args) -> None:
    rows = spark.read.parquet(args.generated)
    scores = spark.read.parquet(args.token_scores) if args.token_scores else None
    jobs.evaluate_generation(
        rows, scores, args.max_eval_samples_per_lang, args.split, args.output_dir, args.key, args.ascii_only
    ).show(1000, truncate=False)


def evaluate(spark: SparkSession, args) -> None:
    """One or more datasets, scored by ``--scorer``, or with stored predictions (``label``, ``pred`` and, if there are, ``logits``)."""
    names = args.datasets.split(",")
    labels = args.labels.split(",") if args.labels else []
    if not args.scorer:
        loaders = {name: lambda name=name: spark.read.format(args.format).load(name) for name in names}
        document = jobs.evaluate_predictions(loaders, args.output_dir, labels, args.label_column, args.pred_column)
    else:
        if not args.tokenizer:
            raise SystemExit("--scorer needs the --tokenizer of its model")
        if args.key is None and args.format != "parquet":
            raise SystemExit(f"{args.format} rows have no position of their own: name an integer column with --key")

        def load(name: str):
            rows = DS.read_dataset(spark, name, args.dataset_config, args.split, args.format)
            return rows if args.key else DS.number_rows(rows)

        document = jobs.evaluate_scored(
            {name: lambda name=name: load(name) for name in names},
            jobs.column_coder(PY.encoder(PY.tokenizer_json(spark, args.tokenizer))),
            PY.scorer(PY.named_loader(args.scorer), args.batch_size), args.text_columns.split(","), args.label_column,
            args.context_window, args.output_dir, labels, args.key or "doc_id",
        )
    print(evaluation_text(document))


def best_checkpoint(spark: SparkSession, args) -> None:
    best_per_group(LG.list_checkpoints(spark, args.root)).show(truncate=False)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="corpusloom")
    subs = top.add_subparsers(required=True)

    def job(run, **options):
        sub = subs.add_parser(run.__name__.replace("_", "-"))
        sub.set_defaults(run=run)
        for name, value in options.items():
            flag = "--" + name
            if value is str:
                sub.add_argument(flag, required=True)
            elif isinstance(value, type(None)):
                sub.add_argument(flag)
            elif isinstance(value, bool):
                sub.add_argument(flag, action="store_true")
            else:
                sub.add_argument(flag, type=type(value), default=value)
        return sub

    sub = job(
        preprocess, dataset=str, dataset_config=None, split="train", format="parquet", text_field="text", output_dir=str,
        key=None, tokenizer=None, shard_size=10**8,
    )
    sub.add_argument("--vocab_words", type=int, help="default: all words")
    sub.add_argument("--eot_token", type=int)
    sub.add_argument("--tasks", type=int)
    sub = job(count_tokens, data_dir=str, epochs=1)
    sub.add_argument("--setup", choices=list(SETUPS), default="large")
    sub.add_argument("--tokens_per_iter", type=int, help="instead of a set-up's")
    sub = job(
        build_packs, dataset=str, output_dir=str, representation=str, languages=str, mix_mode="balanced",
        context_len=2048, target_max_tokens=256, train_sample_frac=1.0, seed=42, key="doc_id", tokenizer=None,
        force=False,
    )
    sub.add_argument("--vocab_words", type=int, help="default: all words")
    sub = job(
        evaluate, datasets=str, labels=None, output_dir=str, format="parquet", label_column="label", pred_column="pred",
        tokenizer=None, text_columns="text", context_window=1024, batch_size=256, key=None, dataset_config=None, split="test",
    )
    sub.add_argument("--scorer", help="module:function that returns a function from an id matrix to a score matrix")
    sub = job(
        evaluate_generation, generated=str, output_dir=str, split="test", max_eval_samples_per_lang=0, key="doc_id", ascii_only=False,
    )
    sub.add_argument("--token_scores", help="parquet with key, language, label, logp: one row per scored token")
    job(best_checkpoint, root=str)
    return top


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    args.run(build_session(), args)


if __name__ == "__main__":
    main()
