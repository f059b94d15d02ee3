"""Fixed-width classification files: row count, id matrix, labels.

Such a file holds an int32 count ``n``, then ``n`` rows of ``width`` int32 ids,
then ``n`` int64 labels. Parquet is the better store (see ``datasets``); this
source reads existing files in parallel and writes one file per task; the names
of the files, and the rows in them, follow the order of the dataset.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    InputPartition,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

from corpusloom.sources.shards import _filesystem

ROWS_PER_TASK = 1 << 16
ROWS_PER_BATCH = 1 << 12
COUNT_BYTES, ID_BYTES, LABEL_BYTES = 4, 4, 8  # fixed values of the file format


@dataclass
class RowRange(InputPartition):
    path: str = ""
    rows: int = 0
    low: int = 0
    high: int = 0


class ExampleReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"]
        self.width = int(options["width"])

    def partitions(self) -> list[RowRange]:
        fs, root = _filesystem(self.root)
        info = fs.get_file_info(root)
        found = [info] if info.is_file else fs.get_file_info(pafs.FileSelector(root))
        row_bytes = self.width * ID_BYTES + LABEL_BYTES
        ranges = []
        for entry in sorted((f for f in found if f.path.endswith(".bin")), key=lambda f: f.path):
            rows, rest = divmod(entry.size - COUNT_BYTES, row_bytes)
            if rest:
                raise ValueError(f"{entry.path}: size does not fit rows of {self.width} ids")
            cuts = range(0, rows, ROWS_PER_TASK)
            ranges.extend(RowRange(entry.path, rows, low, min(low + ROWS_PER_TASK, rows)) for low in cuts)
        return ranges or [RowRange()]

    def read(self, partition: RowRange) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        fs, _ = _filesystem(self.root)
        with fs.open_input_file(partition.path) as f:
            if int(np.frombuffer(f.read(COUNT_BYTES), "<i4")[0]) != partition.rows:
                raise ValueError(f"{partition.path}: row count does not match its size")
            for low in range(partition.low, partition.high, ROWS_PER_BATCH):
                n = min(ROWS_PER_BATCH, partition.high - low)
                f.seek(COUNT_BYTES + low * self.width * ID_BYTES)
                ids = np.frombuffer(f.read(n * self.width * ID_BYTES), "<i4")
                f.seek(COUNT_BYTES + partition.rows * self.width * ID_BYTES + low * LABEL_BYTES)
                labels = np.frombuffer(f.read(n * LABEL_BYTES), "<i8")
                offsets = pa.array(np.arange(n + 1, dtype=np.int32) * self.width)
                columns = [
                    pa.repeat(pa.scalar(partition.path), n),
                    pa.array(np.arange(low, low + n, dtype=np.int64)),
                    pa.ListArray.from_arrays(offsets, pa.array(ids)),
                    pa.array(labels),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["file", "row", "input_ids", "label"])


@dataclass
class WrittenExamples(WriterCommitMessage):
    staged: str
    name: str


class ExampleWriter(DataSourceArrowWriter):
    """Writes the rows of a task to one file; the count comes first, so the rows are held until then."""

    def __init__(self, options: dict):
        self.root = options["path"]
        self.width = int(options["width"])
        self.job = uuid.uuid4().hex

    def _staging(self, root: str) -> str:
        return f"{root.rstrip('/')}/_staging-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WrittenExamples:
        fs, root = _filesystem(self.root)
        folder = self._staging(root)
        fs.create_dir(folder, recursive=True)
        path = f"{folder}/{uuid.uuid4().hex}"
        name = f"part-{TaskContext.get().partitionId():06d}.bin"
        ids, labels = [], []
        for batch in iterator:
            rows = batch.column(batch.schema.get_field_index("input_ids"))
            if any(n != self.width for n in rows.value_lengths().to_pylist()):
                raise ValueError(f"rows must have {self.width} ids")
            ids.append(rows.flatten().to_numpy(zero_copy_only=False).astype("<i4"))
            labels.append(batch.column(batch.schema.get_field_index("label")).to_numpy(zero_copy_only=False).astype("<i8"))
        if not labels:
            return WrittenExamples("", "")
        with fs.open_output_stream(path) as out:
            out.write(np.array([sum(len(part) for part in labels)], "<i4").tobytes())
            for part in (*ids, *labels):
                out.write(part.tobytes())
        return WrittenExamples(path, name)

    def commit(self, messages: list) -> None:
        fs, root = _filesystem(self.root)
        for message in messages:
            if message and message.staged:
                fs.move(message.staged, f"{root.rstrip('/')}/{message.name}")
        self.abort(messages)

    def abort(self, messages: list) -> None:
        fs, root = _filesystem(self.root)
        if fs.get_file_info(self._staging(root)).type == pafs.FileType.Directory:
            fs.delete_dir(self._staging(root))


class ExampleFiles(DataSource):
    """Format ``example_files``; option ``width`` is the number of ids in a row."""

    @classmethod
    def name(cls) -> str:
        return "example_files"

    def _options(self) -> dict:
        return {k.lower(): v for k, v in self.options.items()}

    def schema(self) -> str:
        return "file string, row long, input_ids array<int>, label long"

    def reader(self, schema: StructType) -> DataSourceReader:
        return ExampleReader(self._options())

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return ExampleWriter(self._options())


def read_example_files(spark: SparkSession, path: str, width: int) -> DataFrame:
    """Rows ``(file, row, input_ids, label)`` of one file or of all ``.bin`` files in a folder."""
    spark.dataSource.register(ExampleFiles)
    return spark.read.format("example_files").option("width", width).load(path)


def write_example_files(
    examples: DataFrame, path: str, width: int, key: str, rows_per_file: int = 1 << 18, force: bool = False
) -> None:
    """Files of about ``rows_per_file`` rows each, which hold the rows in the order of ``key`` over names and rows.

    Files that are there already are kept and nothing is written, unless ``force``.
    """
    spark = examples.sparkSession
    spark.dataSource.register(ExampleFiles)
    fs, root = _filesystem(path)
    selector = pafs.FileSelector(root, allow_not_found=True)
    present = [f.path for f in fs.get_file_info(selector) if f.path.endswith(".bin")]
    if present and not force:
        return
    for old in present:
        fs.delete_file(old)
    narrow = examples.select(key, "input_ids", examples["label"].cast("long").alias("label"))
    parts = max(1, -(-narrow.count() // rows_per_file))
    ordered = narrow.repartitionByRange(parts, key).sortWithinPartitions(key).drop(key)
    writer = ordered.write.format("example_files").mode("append")
    writer.option("path", path).option("width", width).save()
