"""Functions that need Python: tokenizer files and model scoring.

They are narrow Arrow functions: Spark splits the rows, a task loads its
tokenizer or model once, and no row is shuffled.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

FILE_BYTES = 256 << 20  # default bound of a tokenizer file, which is shared with every task


def _file_bytes(spark: SparkSession, path: str, most: int):
    """A small file as a broadcast value; its size is checked first."""
    row = spark.read.format("binaryFile").load(path)
    length = row.select("length").first()["length"]
    if length > most:
        raise ValueError(f"{path}: {length} bytes is too large for a tokenizer file")
    return spark.sparkContext.broadcast(bytes(row.select("content").first()["content"]))


def tokenizer_json(spark: SparkSession, path: str, most: int = FILE_BYTES) -> Callable:
    """Loader for a ``tokenizers`` JSON file."""
    content = _file_bytes(spark, path, most)

    def load() -> Callable[[list[str]], list[list[int]]]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core per task
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_buffer(content.value)
        return lambda texts: [e.ids for e in tokenizer.encode_batch(texts)]

    return load


def tokenizer_specials(spark: SparkSession, path: str, names, default: int, most: int = FILE_BYTES) -> tuple[int, int]:
    """Id of the first special name a ``tokenizers`` JSON file has (else ``default``), and its vocabulary size."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_buffer(_file_bytes(spark, path, most).value)
    found = (tokenizer.token_to_id(n) for n in names)
    return next((i for i in found if i is not None), default), tokenizer.get_vocab_size()


def tiktoken_ranks(spark: SparkSession, path: str, pattern: str, most: int = FILE_BYTES) -> Callable:
    """Loader for a ``tiktoken`` rank file; special marks in a text are plain text."""
    content = _file_bytes(spark, path, most)

    def load() -> Callable[[list[str]], list[list[int]]]:
        import tiktoken

        ranks = {}
        for line in content.value.splitlines():
            token, rank = line.split()
            ranks[base64.b64decode(token)] = int(rank)
        encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [encoding.encode_ordinary(t) for t in texts]

    return load


def encoder(load: Callable) -> Callable[[Column | str], Column]:
    """Column function ``text -> array<int>`` for a tokenizer loader."""

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        run = load()
        for batch in batches:
            yield pa.array(run(batch.to_pylist()), pa.list_(pa.int32()))

    return encode


def scorer(load: Callable, batch: int = 256) -> Callable[[Column | str], Column]:
    """Column function ``ids -> array<double>`` for fixed-width rows.

    ``load()`` returns a function from an integer matrix (rows x width) to a
    score matrix (rows x classes); it is called on at most ``batch`` rows.
    """

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        run = load()
        for rows in batches:
            for low in range(0, max(len(rows), 1), batch):
                part = rows.slice(low, batch)
                matrix = part.flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1)
                yield pa.array(list(np.asarray(run(matrix), dtype=np.float64)), pa.list_(pa.float64()))

    return score


def named_loader(name: str) -> Callable:
    """Loader ``module:function`` for :func:`scorer`, imported by the tasks alone; ship the module with ``--py-files``."""
    module, _, function = name.partition(":")
    if not (module and function):
        raise ValueError(f"not module:function: {name}")

    def load() -> Callable:
        from importlib import import_module

        return getattr(import_module(module), function)()

    return load


def predicate(keep: Callable) -> Callable[..., Column]:
    """Boolean column from a Python test of one or more columns, for what no expression can say."""

    @F.arrow_udf(T.BooleanType())
    def test(*columns: pa.Array) -> pa.Array:
        return pa.array([bool(keep(*row)) for row in zip(*[c.to_pylist() for c in columns])], pa.bool_())

    return test


def map_batches(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """Apply a pandas function to each batch (rows of one ``batch_id``)."""
    return df.groupBy("batch_id").applyInPandas(fn, schema)
