"""Model inputs: classification rows, prompt/target packs, padded batches."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusloom.functions.arrays import IGNORE, attention_mask, fixed_width, head, last_non_pad
from corpusloom.functions.numbers import whole
from corpusloom.functions.text import render_prompt
from corpusloom.operators.ordering import row_index

# Column pair (source, target) of each parallel text form.
REPRESENTATIONS: Mapping[str, tuple[str, str]] = {
    "text": ("text", "summary"),
    "ipa_stripped": ("text_ipa_stripped", "summary_ipa_stripped"),
    "romanized": ("text_romanized", "summary_romanized"),
}
SPLITS = ("train", "validation", "test")


def representation_columns(representation: str) -> tuple[str, str]:
    if representation not in REPRESENTATIONS:
        raise ValueError(f"unknown representation: {representation}")
    return REPRESENTATIONS[representation]


def select_representation(df: DataFrame, representation: str, keep: Sequence[str]) -> DataFrame:
    """``keep`` columns with the chosen pair as ``source`` and ``target``; nothing else is read."""
    source, target = representation_columns(representation)
    return df.select(*keep, F.col(source).alias("source"), F.col(target).alias("target"))


def prompts(df: DataFrame) -> DataFrame:
    """Add ``prompt`` from ``language`` and ``source``."""
    return df.withColumn("prompt", render_prompt("language", "source"))


def missing_columns(df: DataFrame, needed: Sequence[str]) -> list[str]:
    return [c for c in needed if c not in df.columns]


def require_columns(
    datasets: Mapping[str, DataFrame], needed: Sequence[str]
) -> tuple[dict[str, DataFrame], dict[str, list[str]]]:
    """Split datasets into usable ones and a report of what the others lack."""
    report = {name: missing_columns(df, needed) for name, df in datasets.items()}
    usable = {name: df for name, df in datasets.items() if not report[name]}
    return usable, {name: lacking for name, lacking in report.items() if lacking}


def pair_with_labels(names: Sequence[str], labels: Sequence[str]) -> list[tuple[str, str]]:
    """Datasets with their display labels; the last path part serves if none are given."""
    labels = list(labels) or [n.split("/")[-1] for n in names]
    if len(labels) != len(names):
        raise ValueError(f"{len(names)} datasets but {len(labels)} labels")
    return list(zip(names, labels))


def classification_examples(df: DataFrame, width: int, pad: int = 0, ids: str = "ids") -> DataFrame:
    """Replace ``ids`` by fixed-width ``input_ids``, ``attention_mask`` and ``last_index``."""
    padded = df.withColumn("input_ids", fixed_width(F.col(ids), width, pad)).drop(ids)
    return padded.withColumn("attention_mask", attention_mask(F.col("input_ids"), pad)).withColumn(
        "last_index", last_non_pad(F.col("input_ids"), pad)
    )


def encode_packs(
    df: DataFrame,
    context: int,
    target_max: int,
    eos: int | Column | None,
    suffix_len: int = 0,
    prompt: str = "prompt_ids",
    target: str = "target_ids",
) -> DataFrame:
    """Prompt and target ids to ``input_ids``, ``labels``, ``attention_mask``.

    The target keeps ``target_max`` ids plus the end mark, the prompt what is
    left of the context, cut on the right. With ``suffix_len`` that many ids at
    the end of the prompt (its closing cue) survive the cut. A row without room
    for any prompt id, or without target, is marked ``skip``.
    """
    goal = head(F.col(target), target_max)
    if eos is not None:
        mark = (F.lit(eos) if isinstance(eos, int) else eos).cast("int")
        goal = F.concat(goal, F.array(mark))
    staged = df.withColumn("__goal", goal).withColumn("__room", F.lit(context) - F.size("__goal"))
    skip = (F.size("__goal") == 0) | (F.col("__room") <= 0)
    whole_prompt = F.col(prompt)
    cut = F.slice(whole_prompt, F.lit(1), F.greatest(F.col("__room"), F.lit(0)))
    if suffix_len:
        body = F.slice(whole_prompt, F.lit(1), F.greatest(F.col("__room") - suffix_len, F.lit(0)))
        tail_len = F.least(F.lit(suffix_len), F.greatest(F.col("__room"), F.lit(0)))
        tail = F.slice(whole_prompt, F.size(whole_prompt) - tail_len + 1, tail_len)
        fits = F.size(whole_prompt) <= F.col("__room")
        cut = F.when(fits, whole_prompt).otherwise(F.concat(body, tail))
    staged = staged.withColumn("__prompt", cut)
    input_ids = F.concat("__prompt", "__goal")
    ignored = F.array_repeat(F.lit(IGNORE), F.size("__prompt"))
    rest = [c for c in df.columns if c not in (prompt, target)]

    def kept(value: Column) -> Column:
        return F.when(~skip, value)

    return staged.select(
        *rest,
        kept(input_ids).alias("input_ids"),
        kept(F.concat(ignored, F.col("__goal"))).alias("labels"),
        kept(F.array_repeat(F.lit(1), F.size("__prompt") + F.size("__goal"))).alias("attention_mask"),
        kept(F.size("__prompt")).alias("prompt_len"),
        kept(F.size("__goal")).alias("target_len"),
        skip.alias("skip"),
    )


def drop_skipped(packs: DataFrame) -> DataFrame:
    return packs.where(~F.col("skip"))


def split_counts(df: DataFrame, splits: Sequence[str] = SPLITS) -> DataFrame:
    """``(split, rows)`` for every expected split, 0 where there are none."""
    names = df.sparkSession.createDataFrame([(s,) for s in splits], "split string")
    counted = df.groupBy("split").agg(F.count(F.lit(1)).alias("rows"))
    return names.join(counted, "split", "left").select("split", F.coalesce("rows", F.lit(0)).alias("rows"))


def require_nonempty(counts: DataFrame) -> DataFrame:
    """``counts`` unchanged; an empty split fails the job and is named."""
    message = F.concat(F.lit("no rows left in split "), F.col("split"))
    return counts.withColumn(
        "rows", F.when(F.col("rows") > 0, F.col("rows")).otherwise(F.raise_error(message).cast("long"))
    )


def number_batches(df: DataFrame, key: str, batch_size: int, ids: str = "input_ids") -> DataFrame:
    """Consecutive rows by ``key`` form a batch: adds ``batch_id`` and ``width``, its longest row.

    Both come from keys and lengths alone; full rows are moved once, to take
    their number. The input is read twice: stage it if it is costly.
    """
    index = row_index(df.select(key, F.size(ids).alias("__size")), key, name="__index")
    numbered = index.withColumn("batch_id", whole(F.col("__index"), batch_size))
    width = F.max("__size").over(Window.partitionBy("batch_id"))
    return df.join(numbered.select(key, "batch_id", width.alias("width")), key)


def pad_batch(df: DataFrame, pad: int = 0) -> DataFrame:
    """Pad ids, labels and mask of each batch to the ``width`` of the batch."""
    return (
        df.withColumn("pad_cells", F.col("width") - F.size("input_ids"))
        .withColumn("input_ids", fixed_width(F.col("input_ids"), F.col("width"), pad))
        .withColumn("labels", fixed_width(F.col("labels"), F.col("width"), IGNORE))
        .withColumn("attention_mask", fixed_width(F.col("attention_mask"), F.col("width"), 0))
    )
