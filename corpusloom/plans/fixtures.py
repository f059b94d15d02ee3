"""Views that shape the given tables like the inputs of the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corpusloom.functions.text import pieces, seeded_draw
from corpusloom.operators.ordering import id_buckets, running, time_buckets

SEED = 42
LANGUAGES = ("de", "en", "es", "fr")
NUM_CLASSES = 10
RUNS = 6
EVAL_EVERY = 25
ACCENTS = ("àáâäçèéêëíñóôöùúûü", "aaaaceeeeinooouuuu")  # fixed values: letter by letter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with a class: ``(doc_id, language, text, label, label2)``."""
    docs, labels = texts(spark, sf_dir), table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id").select(
        "doc_id",
        F.col("lang").alias("language"),
        "text",
        F.col("quality").cast("long").alias("label"),
        F.col("toxic").cast("long").alias("label2"),
    )


def text_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user turn and the turn that follows, which may be missing.

    The next turn is the least one among those that come later, a running
    minimum from the end; a window per conversation would not split a long one.
    Only numbers pass through it; one join fetches the text.
    """
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    from_end = F.lit((1 << 62) - 1) - F.col("turn")
    placed = running(
        turns.select("conv_id", "turn"), "next", F.col("turn"), [from_end], id_buckets(from_end), ["conv_id"], op="min"
    )
    following = placed.where("next IS NOT NULL").select("conv_id", "turn", "next")
    after = turns.select("conv_id", F.col("turn").alias("next"), F.col("text").alias("hypothesis"))
    fetched = following.join(after, ["conv_id", "next"]).select("conv_id", "turn", "hypothesis")
    users = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("premise"))
    return users.join(fetched, ["conv_id", "turn"], "left")


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\p{L}\s]", "")


def _romanize(text: Column) -> Column:
    return F.translate(text, *ACCENTS)


def summaries(docs: DataFrame) -> DataFrame:
    """Text and summary in three forms, with language and split."""
    bucket = seeded_draw(SEED, F.lit("split"), F.col("doc_id")) % 10
    split = F.when(bucket == 0, "test").when(bucket == 1, "validation").otherwise("train")
    text, summary = F.col("text"), F.split_part("text", F.lit("\n"), F.lit(1))
    return docs.select(
        "doc_id",
        F.col("lang").alias("language"),
        split.alias("split"),
        text,
        summary.alias("summary"),
        _strip(text).alias("text_ipa_stripped"),
        _strip(summary).alias("summary_ipa_stripped"),
        _romanize(text).alias("text_romanized"),
        _romanize(summary).alias("summary_romanized"),
    )


def scored_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(ex_id, label, logits)`` with one logit per class."""
    classes = F.sequence(F.lit(0).cast("long"), F.lit(NUM_CLASSES - 1).cast("long"))

    def logit(cls: Column) -> Column:
        noise = seeded_draw(SEED, F.lit("logit"), F.col("vec_id"), cls) % 1000
        return noise.cast("double") / 100.0 + F.when(cls == F.col("label"), 4.0).otherwise(0.0)

    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("ex_id"),
        F.col("label").cast("long").alias("label"),
        F.transform(classes, logit).alias("logits"),
    )


def generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text as reference, and the text without each fifth piece as what a model made of it.

    The pieces are bound by an explode: as a column of their own they would be split once for each use.
    """
    split = texts(spark, sf_dir).select(
        "doc_id", F.col("lang").alias("language"), F.explode(F.array(F.struct(pieces("text").alias("p")))).alias("s")
    )
    kept = F.filter("s.p", lambda x, i: (i + F.col("doc_id")) % 5 != 0)
    return split.select(
        "doc_id", "language", F.array_join(kept, " ").alias("prediction"), F.array_join("s.p", " ").alias("reference")
    )


def training_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as the log of six training runs, evaluated every 25 steps.

    A run holds a sixth of all events, so its steps are numbered by the bucketed
    running count and not by one window per run.
    """
    events = table(spark, sf_dir, "events").select(
        (F.col("user_id") % RUNS).alias("run"), F.col("ts").cast("timestamp").alias("ts"), "event_id", "value"
    )
    placed = running(
        events,
        "before",
        F.lit(1).cast("long"),
        [F.col("ts"), F.col("event_id")],
        time_buckets(F.col("ts"), F.col("event_id")),
        ["run"],
    ).withColumn("step", F.col("before") + 1)
    evaluated = F.col("step") % EVAL_EVERY == 0
    amount = F.col("value").cast("decimal(10,4)").cast("string")
    step = F.col("step").cast("string")
    line = F.concat(
        F.lit("step:"),
        step,
        F.lit("/10000 train_loss:"),
        amount,
        F.when(evaluated, F.concat(F.lit(" val_loss:"), amount)).otherwise(""),
        F.lit(" train_time:"),
        (F.col("step") * 150).cast("string"),
        F.lit("ms step_avg:150.00ms"),
    )
    path = F.concat(
        F.format_string("models/r%d/best_state_step%06d_val", F.col("run"), F.col("step")), amount, F.lit(".pt")
    )
    form = F.when(F.col("run") % 3 == 0, "text").when(F.col("run") % 3 == 1, "ipa_stripped").otherwise("romanized")
    return placed.select(
        "run",
        form.alias("representation"),
        F.when(F.col("run") < 3, "small").otherwise("medium").alias("size"),
        "step",
        F.col("value").alias("train_loss"),
        F.when(evaluated, F.col("value")).alias("val_loss"),
        line.alias("line"),
        F.when(evaluated, path).alias("path"),
    )
