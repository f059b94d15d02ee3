"""Reproducible sampling and mixing of languages.

All draws come from digests of a seed and a key, and shuffled places from a
keyed permutation: no state, no order of execution, and a lost executor
recomputes the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from corpusloom.functions.numbers import whole
from corpusloom.functions.text import seeded_draw
from corpusloom.operators.ordering import head_rows, row_index, shuffled_index
from corpusloom.operators.permutation import permuted

DRAW_CHUNK = 1 << 16
ROW_REPEATS = 1 << 12
SALT_CHUNK = 1 << 12


def concat(parts: Sequence[DataFrame]) -> DataFrame:
    """All rows of all parts, duplicates kept; ``part`` is the position of the source."""
    numbered = [df.withColumn("part", F.lit(i)) for i, df in enumerate(parts)]
    return reduce(DataFrame.unionByName, numbered)


def language_sizes(df: DataFrame, languages: Sequence[str]) -> DataFrame:
    """``(language, position, n, max_n)``, one row per listed language, also for empty ones.

    The list is given by the caller, so this table may always be broadcast.
    """
    spark = df.sparkSession
    listed = spark.createDataFrame([(g, i) for i, g in enumerate(languages)], "language string, position int")
    counted = df.where(F.col("language").isin(*languages)).groupBy("language").agg(F.count(F.lit(1)).alias("n"))
    sizes = listed.join(F.broadcast(counted), "language", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return sizes.withColumn("max_n", F.max("n").over(Window.partitionBy(F.lit(0))))


def draw_numbers(counts: DataFrame, how_many: str, by: Sequence[str] = ()) -> DataFrame:
    """``by`` and ``draw`` = 0 .. ``how_many`` - 1 for each row of a small table.

    Numbers are made in chunks that are spread over the tasks first, so a large
    group is not produced by one of them. The number of tasks is given, as Spark
    would put the few rows of the chunks together again in one.
    """
    tasks = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = whole(F.col(how_many) - 1, DRAW_CHUNK)
    spread = (
        counts.where(F.col(how_many) > 0)
        .select(*counts.columns, F.explode(F.sequence(F.lit(0).cast("long"), chunks)).alias("__chunk"))
        .repartition(tasks, *by, "__chunk")
    )
    low = F.col("__chunk") * DRAW_CHUNK
    high = F.least(low + (DRAW_CHUNK - 1), F.col(how_many) - 1)
    return spread.select(*counts.columns, F.explode(F.sequence(low, high)).alias("draw"))


def draw_with_replacement(df: DataFrame, key: str, draws: int, seed: int) -> DataFrame:
    """``draws`` uniform picks: ``draw`` and the columns of the picked row."""
    whole_table = df.withColumn("__all", F.lit(0))
    sizes = whole_table.groupBy("__all").agg(F.count(F.lit(1)).alias("n"), F.lit(draws).cast("long").alias("max_n"))
    numbers = draw_numbers(sizes, "max_n").withColumn(
        "row_index", seeded_draw(seed, F.lit("draw"), F.col("draw")) % F.col("n")
    )
    return _gather(numbers, whole_table, key, ["__all"], sizes, draws).select("draw", *df.columns)


def _gather(
    numbers: DataFrame, df: DataFrame, key: str, by: Sequence[str], sizes: DataFrame, draws: int | None = None
) -> DataFrame:
    """Rows of ``df`` at the drawn positions ``(by, row_index)``.

    Only keys are numbered and drawn; full rows are fetched by key at the end.
    Where few rows take many draws, each row is copied so often that a copy
    serves some ``ROW_REPEATS`` draws: no task gets all draws of one row.
    ``sizes`` has one row per listed group, so it may be broadcast.

    Numbers are made from chunks, and the size of these few rows is all that
    Spark knows of them: it would broadcast any number of draws. So a merge join
    is asked for, unless ``draws`` says that there are few.
    """
    by = list(by)
    salts = (whole(F.col("max_n"), ROW_REPEATS) / F.greatest(F.col("n"), F.lit(1))).cast("long") + 1
    salted = numbers.withColumn("__salt", F.col("draw") % salts).drop("n", "max_n", "position")
    copies = F.broadcast(sizes.select(*by, salts.alias("__salts")))  # one number per listed group

    def copied(rows: DataFrame) -> DataFrame:
        """Each row with the salts 0 .. ``__salts`` - 1, made in chunks on different tasks."""
        counted = rows.join(copies, by)
        chunk = F.explode(F.sequence(F.lit(0).cast("long"), whole(F.col("__salts") - 1, SALT_CHUNK))).alias("__chunk")
        low = F.col("__chunk") * SALT_CHUNK
        salt = F.explode(F.sequence(low, F.least(low + (SALT_CHUNK - 1), F.col("__salts") - 1))).alias("__salt")
        return counted.select(*counted.columns, chunk).select(*rows.columns, salt)

    index = row_index(df.select(*by, key), key, by)
    if draws is None or draws > DRAW_CHUNK:
        salted = salted.hint("merge")
    chosen = salted.join(copied(index), [*by, "row_index", "__salt"]).drop("row_index")
    if set(df.columns) <= {*by, key}:
        return chosen.drop("__salt")
    return chosen.join(copied(df), [*by, key, "__salt"]).drop("__salt")


def mix_natural(df: DataFrame, languages: Sequence[str], key: str, seed: int) -> DataFrame:
    """All rows of the listed languages in shuffled order (``out_pos``). Keys may repeat over languages.

    A row's number is its place in its language behind the languages listed
    before; its place in the shuffle is computed from that number.
    """
    sizes = language_sizes(df, languages)
    earlier = Window.partitionBy(F.lit(0)).orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    starts = sizes.select("language", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__start"), total.alias("__total"))
    listed = df.where(F.col("language").isin(*languages))
    numbered = row_index(listed, key, ["language"], "__row").join(F.broadcast(starts), "language")
    place = permuted(F.col("__start") + F.col("__row"), F.col("__total"), seed)
    return numbered.select(*df.columns, place.alias("out_pos"))


def mix_balanced(df: DataFrame, languages: Sequence[str], key: str, seed: int) -> DataFrame:
    """Every language redrawn with replacement to the size of the largest.

    A language of that size is kept as it is; the others lose some rows and
    repeat others. A listed language without rows is an error. ``draw`` numbers
    the rows of a language; ``out_pos`` is the shuffled position, computed from
    language and draw alone.
    """
    sizes = language_sizes(df, languages)
    message = F.concat(F.lit("no rows for language "), F.col("language"))
    checked = sizes.withColumn(
        "n", F.when(F.col("n") > 0, F.col("n")).otherwise(F.raise_error(message).cast("long"))
    )
    number = F.col("position") * F.col("max_n") + F.col("draw")
    place = permuted(number, F.col("max_n") * len(languages), seed)
    numbers = draw_numbers(checked, "max_n", ["language"]).withColumn("out_pos", place)
    picked = seeded_draw(seed, F.lit("draw"), F.col("language"), F.col("draw")) % F.col("n")
    plan = numbers.withColumn("row_index", F.when(F.col("n") == F.col("max_n"), F.col("draw")).otherwise(picked))
    return _gather(plan, df.where(F.col("language").isin(*languages)), key, ["language"], checked)


def mix_languages(df: DataFrame, mode: str, languages: Sequence[str], key: str, seed: int) -> DataFrame:
    if mode == "natural":
        return mix_natural(df, languages, key, seed)
    if mode == "balanced":
        return mix_balanced(df, languages, key, seed)
    raise ValueError(f"unknown mix mode: {mode}")


def sample_per_language(
    df: DataFrame, languages: Sequence[str], key: Sequence[str], fraction: float, seed: int
) -> DataFrame:
    """Exactly ``max(1, int(n * fraction))`` rows of each language, picked by a seeded shuffle."""
    if fraction <= 0:
        raise ValueError("fraction must be above 0")
    if fraction >= 1:
        return df
    sizes = language_sizes(df, languages)
    quota = sizes.select("language", F.greatest(F.lit(1), F.floor(F.col("n") * F.lit(float(fraction)))).alias("quota"))
    ranked = shuffled_index(df.where(F.col("language").isin(*languages)), seed, key, ["language"], "__rank")
    kept = ranked.join(F.broadcast(quota), "language").where(F.col("__rank") < F.col("quota"))
    return kept.select(*df.columns)


def head_per_language(df: DataFrame, key: str, n: int) -> DataFrame:
    """The first ``n`` rows of each language by ``key``; 0 keeps all."""
    if n <= 0:
        return df
    return head_rows(df, ["language"], [F.col(key)], n)


def seeded_order(df: DataFrame, seed: int, key: str) -> DataFrame:
    """A reproducible shuffle by a unique integer key; ``out_pos`` is the position, computed from the key's rank."""
    numbered = row_index(df, key, name="__row")
    return numbered.select(*df.columns, permuted(F.col("__row"), df.count(), seed).alias("out_pos"))
