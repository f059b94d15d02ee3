"""A text classifier with class weights on Spark ML, and the choice of its penalty on held-out rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, Normalizer, SQLTransformer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from corpusloom.functions.text import PIECE_PATTERN, seeded_draw
from corpusloom.operators.classification import attach_weights, class_weights
from corpusloom.session import Scratch, staged

PENALTIES = (1e-6, 1e-5, 1e-4, 1e-3, 1e-2)
PARTS = ("train", "validation", "test")
TASK_VALUES = 1 << 22  # values of feature vectors, of some 12 bytes, that a task of a fit holds
LEAST_PROBABILITY = 1e-15  # so that a sure and wrong prediction has a finite loss


def split_rows(df: DataFrame, seed: int, key: str = "doc_id", shares: Sequence[int] = (50, 25, 25)) -> DataFrame:
    """``df`` with ``part``: train, validation or test, in per cent of the keys, fixed by a digest of the key."""
    draw = seeded_draw(seed, F.lit("part"), F.col(key)) % 100
    part = F.when(draw < shares[0], PARTS[0]).when(draw < shares[0] + shares[1], PARTS[1]).otherwise(PARTS[2])
    return df.withColumn("part", part)


def _features(text: str, features: int) -> list:
    """Shares of words (lower case) and of word shapes: runs of capitals, small letters and digits as one A, a and 0.

    Shapes are few and frequent, so that they say something about texts whose words were never seen.
    """
    pieces = f"regexp_extract_all(`{text}`, r'{PIECE_PATTERN}', 0)"
    shape = "w"
    for runs, sign in ((r"\p{Lu}+", "A"), (r"\p{Ll}+", "a"), (r"\p{N}+", "0")):
        shape = f"regexp_replace({shape}, r'{runs}', '{sign}')"
    words = f"concat(transform({pieces}, w -> lower(w)), transform({pieces}, w -> concat('shape ', {shape})))"
    return [
        SQLTransformer(statement=f"SELECT *, coalesce({words}, array()) AS words FROM __THIS__"),
        HashingTF(inputCol="words", outputCol="counts", numFeatures=features),
        Normalizer(inputCol="counts", outputCol="features", p=1.0),
    ]


def fit_classifier(
    df: DataFrame, num_classes: int, features: int = 1 << 12, iterations: int = 50, text: str = "text", penalty: float = 1e-4
) -> PipelineModel:
    """Fit on ``text`` and ``label``; rare classes weigh more."""
    weighted = attach_weights(df.select(text, "label"), class_weights(df, num_classes))
    stages = _features(text, features)
    for stage in stages:
        weighted = stage.transform(weighted)
    with Scratch(df.sparkSession) as scratch:
        rows = staged(weighted.select("features", "label", "weight", _most_values(features)), "features", scratch)
        return PipelineModel([*stages, _fit(dealt_rows(rows), penalty, iterations)])


def _most_values(features: int):
    """No fewer than the values of a row's vector: one for each word that differs."""
    return F.least(F.size("words"), F.lit(features)).alias("n_values")


def dealt_rows(rows: DataFrame, most: int | None = None) -> DataFrame:
    """``rows`` without ``n_values``, over as many tasks as these ask for.

    A fit keeps the vectors in memory and reads them for each step, in the
    partitions that it is given. Those of a stored table follow its files, and
    one of them may expand to any size.
    """
    total = rows.agg(F.sum("n_values")).first()[0] or 0
    return rows.drop("n_values").repartition(max(1, -(-total // (most or TASK_VALUES))))


def _fit(weighted: DataFrame, penalty: float, iterations: int):
    rows = weighted.withColumn("label", F.col("label").cast("double"))
    # without standardisation a rare word stays as small as it is, and the penalty keeps it from deciding alone
    return LogisticRegression(weightCol="weight", maxIter=iterations, regParam=penalty, standardization=False).fit(rows)


def weighted_loss(scored: DataFrame) -> DataFrame:
    """One row ``(rows, loss)``: mean negative log probability of the label, each row counting with its ``weight``.

    A label that the model has no probability for counts as one of ``LEAST_PROBABILITY``.
    """
    given = F.get(vector_to_array("probability"), F.col("label").cast("int"))
    loss = -F.log(F.greatest(F.coalesce(given, F.lit(0.0)), F.lit(LEAST_PROBABILITY)))
    return scored.agg(F.count(F.lit(1)).alias("rows"), (F.sum(loss * F.col("weight")) / F.sum("weight")).alias("loss"))


def choose_classifier(
    df: DataFrame,
    num_classes: int,
    penalties: Sequence[float] = PENALTIES,
    features: int = 1 << 12,
    iterations: int = 50,
    text: str = "text",
) -> tuple[PipelineModel, list[tuple[float, float]]]:
    """The model with the least weighted loss on validation rows, and ``(penalty, loss)`` of all that were tried.

    ``df`` has ``label`` and ``part`` (see :func:`split_rows`). Class weights
    come from the training rows alone; words are counted once for all fits. Of
    equal losses the greater penalty wins. Test rows play no part.
    """
    weights = class_weights(df.where(F.col("part") == PARTS[0]), num_classes)
    stages = _features(text, features)
    counted = df.where(F.col("part").isin(*PARTS[:2])).select(text, "label", "part")
    for stage in stages:
        counted = stage.transform(counted)
    tried = []
    with Scratch(df.sparkSession) as scratch:
        rows = staged(attach_weights(counted.select("features", "label", "part", _most_values(features)), weights), "features", scratch)
        train, validation = (rows.where(F.col("part") == p) for p in PARTS[:2])
        train = dealt_rows(train)
        for penalty in sorted(penalties, reverse=True):
            model = _fit(train, penalty, iterations)
            loss = weighted_loss(model.transform(validation)).first()["loss"]
            if loss is None:
                raise ValueError("no validation rows")
            tried.append((loss, penalty, model))
    best = min(tried, key=lambda t: t[0])
    return PipelineModel([*stages, best[2]]), [(penalty, loss) for loss, penalty, _ in tried]


def classify(model: PipelineModel, df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return model.transform(df.select(key, text)).select(key, F.col("prediction").cast("long").alias("pred"))
