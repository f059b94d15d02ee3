"""Token shard files as a Spark data source.

A shard is a header of 256 little-endian 32-bit integers followed by the token
ids. The source reads parts of a file in parallel tasks and skips files that
filters on ``split``, ``shard_index`` or ``file`` rule out.

A write puts its files into a folder of its own below the given one, each moved
to its final name by the task that wrote it. The small file ``_current`` then
names that folder, and the one before it is removed. So a reader sees the old
shards or the new ones, never both; a task that is lost or runs twice leaves
nothing half-written; and the driver moves no file. A folder that has no
``_current`` is read as it is.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    DataSourceStreamReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

from corpusloom.operators.packing import shard_file

# Fixed values of the file format.
MAGIC = 20240520
HEADER_INTS = 256
HEADER_BYTES = HEADER_INTS * 4
MAX_TOKENS = 2**31 - 1
FILE_PATTERN = r"^data_(val|train)_(\d{6,})\.bin$"

CHUNK_TOKENS = 8192  # tokens per row
TASK_BYTES = 32 << 20  # payload per read task
LEAST_TASKS = 64  # small files share a task only if there are that many tasks without it
HEADERS_PER_TASK = 64
CURRENT = "_current"
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"

_CHUNK_SCHEMA = "file string, shard_index int, split string, n_tokens long, lo long, ids array<long>"
_HEADER_SCHEMA = "file string, shard_index int, split string, version int, bits int, tokens long"


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    if re.match(r"^[A-Za-z][A-Za-z0-9+.-]*:/", path):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def shard_folder(fs: pafs.FileSystem, root: str) -> str:
    """The folder that holds the shards below ``root``."""
    pointer = f"{root.rstrip('/')}/{CURRENT}"
    if fs.get_file_info(pointer).type != pafs.FileType.File:
        return root
    with fs.open_input_stream(pointer) as f:
        return f"{root.rstrip('/')}/{f.read().decode()}"


@dataclass
class ShardHeader:
    version: int
    bits: int
    tokens: int

    @property
    def width(self) -> int:
        return self.bits // 8

    @classmethod
    def parse(cls, raw: bytes, name: str) -> "ShardHeader":
        if len(raw) < HEADER_BYTES:
            raise ValueError(f"{name}: header is cut off")
        fields = np.frombuffer(raw, dtype="<i4", count=HEADER_INTS)
        magic, version, tokens, bits = (int(x) for x in fields[:4])
        if magic != MAGIC:
            raise ValueError(f"{name}: not a token shard")
        if version == 1:
            bits = 16
        elif version == 2:
            bits = bits or 32
        else:
            raise ValueError(f"{name}: unknown version {version}")
        if bits not in (16, 32):
            raise ValueError(f"{name}: unknown token width {bits}")
        return cls(version, bits, tokens)

    def encode(self) -> bytes:
        fields = np.zeros(HEADER_INTS, dtype="<i4")
        fields[:3] = (MAGIC, self.version, self.tokens)
        if self.version == 2:
            fields[3] = self.bits
        return fields.tobytes()


@dataclass
class ShardPart(InputPartition):
    """Part ``part`` of ``parts`` of each listed ``(path, name, size)``; small files share a task."""

    files: list
    part: int = 0
    parts: int = 1


_TESTS = {
    EqualTo: lambda a, b: a == b,
    In: lambda a, b: a in b,
    GreaterThan: lambda a, b: a > b,
    GreaterThanOrEqual: lambda a, b: a >= b,
    LessThan: lambda a, b: a < b,
    LessThanOrEqual: lambda a, b: a <= b,
}
_PLACE = ("file", "shard_index", "split")


class ShardReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"]
        self.headers_only = options.get("mode", "chunks") == "header"
        self.split = options.get("split")
        self.chunk = int(options.get("chunk", CHUNK_TOKENS))
        self.task_bytes = int(options.get("taskbytes", TASK_BYTES))
        self.columns = _columns(options)
        self.filters: list[tuple[type, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Filters on a file's name and place are decided from the listing; the others go back to Spark."""
        for f in filters:
            if type(f) in _TESTS and len(f.attribute) == 1 and f.attribute[0] in _PLACE:
                self.filters.append((type(f), f.attribute[0], f.value))
            else:
                yield f

    def _wanted(self, name: str) -> bool:
        match = re.match(FILE_PATTERN, name)
        if not match:
            return False
        place = {"file": name, "shard_index": int(match.group(2)), "split": match.group(1)}
        if self.split is not None and place["split"] != self.split:
            return False
        return all(_TESTS[kind](place[column], value) for kind, column, value in self.filters)

    def shards(self) -> list[tuple[str, str, int]]:
        """``(path, name, size)`` of every shard that is there, wanted or not."""
        fs, root = _filesystem(self.root)
        listed = fs.get_file_info(pafs.FileSelector(shard_folder(fs, root)))
        return sorted((i.path, i.base_name, i.size) for i in listed if re.match(FILE_PATTERN, i.base_name))

    def partitions(self) -> list[ShardPart]:
        return self.tasks([entry for entry in self.shards() if self._wanted(entry[1])]) or [ShardPart([])]

    def tasks(self, found: list[tuple[str, str, int]]) -> list[ShardPart]:
        if self.headers_only:
            return [ShardPart(found[i : i + HEADERS_PER_TASK]) for i in range(0, len(found), HEADERS_PER_TASK)]
        shared = min(self.task_bytes, sum(e[2] - HEADER_BYTES for e in found) // LEAST_TASKS)
        tasks, small, held = [], [], 0
        for entry in found:
            size = entry[2] - HEADER_BYTES
            parts = max(1, -(-size // self.task_bytes))
            if parts > 1:
                tasks.extend(ShardPart([entry], i, parts) for i in range(parts))
                continue
            if small and held + size > shared:
                tasks.append(ShardPart(small))
                small, held = [], 0
            small.append(entry)
            held += size
        return [*tasks, ShardPart(small)] if small else tasks

    def read(self, partition: ShardPart) -> Iterator[pa.RecordBatch]:
        fs, _ = _filesystem(self.root)
        if self.headers_only:
            yield from self._headers(fs, partition.files)
            return
        for path, name, size in partition.files:
            yield from self._chunks(fs, path, name, size, partition.part, partition.parts)

    @staticmethod
    def _place(name: str) -> tuple[str, int]:
        match = re.match(FILE_PATTERN, name)
        return match.group(1), int(match.group(2))

    def _headers(self, fs, files) -> Iterator[pa.RecordBatch]:
        rows = []
        for path, name, _ in files:
            with fs.open_input_file(path) as f:
                header = ShardHeader.parse(f.read(HEADER_BYTES), name)
            split, index = self._place(name)
            rows.append((name, index, split, header.version, header.bits, header.tokens))
        if not rows:
            return
        types = [pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int64()]
        names = ["file", "shard_index", "split", "version", "bits", "tokens"]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    def _chunks(self, fs, path, name, size, part, parts) -> Iterator[pa.RecordBatch]:
        with fs.open_input_file(path) as f:
            header = ShardHeader.parse(f.read(HEADER_BYTES), name)
            if size != HEADER_BYTES + header.width * header.tokens:
                raise ValueError(f"{name}: payload does not match its header")
            chunks = -(-header.tokens // self.chunk)
            first, last = chunks * part // parts, chunks * (part + 1) // parts
            low, high = first * self.chunk, min(last * self.chunk, header.tokens)
            if low >= high:
                return
            ids = None
            if "ids" in self.columns:
                f.seek(HEADER_BYTES + low * header.width)
                ids = np.frombuffer(f.read((high - low) * header.width), dtype=f"<u{header.width}")
        split, index = self._place(name)
        starts = np.arange(low, high, self.chunk, dtype=np.int64)
        n = len(starts)
        offsets = np.append(starts - low, high - low).astype(np.int32)
        columns = {
            "file": lambda: pa.repeat(pa.scalar(name), n),
            "shard_index": lambda: pa.repeat(pa.scalar(index, pa.int32()), n),
            "split": lambda: pa.repeat(pa.scalar(split), n),
            "n_tokens": lambda: pa.repeat(pa.scalar(header.tokens, pa.int64()), n),
            "lo": lambda: pa.array(starts),
            "ids": lambda: pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int64))),
        }
        yield pa.RecordBatch.from_arrays([columns[c]() for c in self.columns], self.columns)


class ShardStreamReader(DataSourceStreamReader):
    """Shards as they arrive. An offset is the first shard index that has not been read.

    Indices count from 0 without gaps, so a shard behind a gap waits until the
    gap is filled, and none is read twice or missed, whatever the order of
    arrival. Files have their final name only when they are whole.
    """

    def __init__(self, options: dict):
        self.reader = ShardReader(options)

    def initialOffset(self) -> dict:
        return {"next": 0}

    def latestOffset(self) -> dict:
        there = {ShardReader._place(name)[1] for _, name, _ in self.reader.shards()}
        following = 0
        while following in there:
            following += 1
        return {"next": following}

    def partitions(self, start: dict, end: dict) -> list[ShardPart]:
        new = range(start["next"], end["next"])
        found = [e for e in self.reader.shards() if ShardReader._place(e[1])[1] in new and self.reader._wanted(e[1])]
        return self.reader.tasks(found) or [ShardPart([])]

    def read(self, partition: ShardPart) -> Iterator[pa.RecordBatch]:
        yield from self.reader.read(partition)


def _columns(options: dict) -> list[str]:
    """The columns asked for, in the order of the schema; all if none are named."""
    names = [c.split()[0] for c in _CHUNK_SCHEMA.split(", ")]
    wanted = options.get("columns")
    return [n for n in names if not wanted or n in wanted.replace(" ", "").split(",")]


@dataclass
class WrittenShards(WriterCommitMessage):
    names: list


class ShardWriter(DataSourceArrowWriter):
    """Writes one file per run of equal ``file`` values; rows must be ordered by (file, lo).

    ``lo`` is the place of a slice in its shard or, if there is a column
    ``tokens`` with the shard's size, any number that puts the slices in order.
    """

    def __init__(self, options: dict, overwrite: bool):
        self.root = options["path"]
        self.version = int(options.get("version", 1))
        fs, root = _filesystem(self.root)
        before = shard_folder(fs, root)
        self.replaced = before if overwrite and before != root else None
        added_to = before if not overwrite and before != root else None
        self.folder = added_to or f"{root.rstrip('/')}/job-{uuid.uuid4().hex}"
        self.is_new = added_to is None

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WrittenShards:
        fs, _ = _filesystem(self.root)
        fs.create_dir(self.folder, recursive=True)
        written, name, slices, end, due = [], None, [], 0, None

        def flush():
            if name is not None and due is not None and due != end:
                raise ValueError(f"{name}: {end} ids for a shard of {due}")
            if name is not None:
                self._write_file(fs, name, slices)
                written.append(name)

        for batch in iterator:
            names = batch.column(batch.schema.get_field_index("file")).to_pylist()
            starts = batch.column(batch.schema.get_field_index("lo")).to_pylist()
            ids = batch.column(batch.schema.get_field_index("ids"))
            sizes = batch.column("tokens").to_pylist() if "tokens" in batch.schema.names else None
            for row, (file, lo) in enumerate(zip(names, starts)):
                if file != name:
                    flush()
                    name, slices, end, due = file, [], 0, sizes[row] if sizes else None
                if due is None and lo != end:
                    raise ValueError(f"{file}: ids missing or doubled at position {min(lo, end)}")
                values = ids[row].values.to_numpy(zero_copy_only=False)
                slices.append(self._narrow(values, file))
                end += len(values)
        flush()
        return WrittenShards(written)

    def _narrow(self, values: np.ndarray, name: str) -> np.ndarray:
        kind = np.dtype("<u2") if self.version == 1 else np.dtype("<u4")
        if values.size and (int(values.min()) < 0 or int(values.max()) > np.iinfo(kind).max):
            raise ValueError(f"{name}: id does not fit in {kind.itemsize * 8} bits")
        return values.astype(kind)

    def _write_file(self, fs, name: str, slices: list) -> None:
        """Under a passing name first: the final one only ever names a whole file, whichever attempt wrote it."""
        tokens = sum(len(s) for s in slices)
        if tokens > MAX_TOKENS:
            raise ValueError(f"{name}: more than {MAX_TOKENS} tokens")
        passing = f"{self.folder}/_writing-{uuid.uuid4().hex}"
        with fs.open_output_stream(passing) as out:
            out.write(ShardHeader(self.version, 16 if self.version == 1 else 32, tokens).encode())
            for part in slices:
                out.write(part.tobytes())
        fs.move(passing, f"{self.folder}/{name}")

    def commit(self, messages: list) -> None:
        fs, root = _filesystem(self.root)
        names = [name for message in messages if message for name in message.names]
        if len(names) != len(set(names)):
            self.abort(messages)
            raise ValueError("a shard was written by two tasks; rows must be grouped by file")
        fs.create_dir(self.folder, recursive=True)
        for info in fs.get_file_info(pafs.FileSelector(self.folder)):
            if info.base_name.startswith("_writing-"):  # left by an attempt that was lost
                fs.delete_file(info.path)
        with fs.open_output_stream(f"{root.rstrip('/')}/{CURRENT}") as out:
            out.write(self.folder.rsplit("/", 1)[1].encode())
        if self.replaced and fs.get_file_info(self.replaced).type == pafs.FileType.Directory:
            fs.delete_dir(self.replaced)

    def abort(self, messages: list) -> None:
        fs, _ = _filesystem(self.root)
        if self.is_new and fs.get_file_info(self.folder).type == pafs.FileType.Directory:
            fs.delete_dir(self.folder)


class TokenShards(DataSource):
    """Format ``token_shards``. Options: ``mode`` (chunks, header), ``split``, ``columns``, ``chunk``, ``taskBytes``, ``version``."""

    @classmethod
    def name(cls) -> str:
        return "token_shards"

    def _options(self) -> dict:
        return {k.lower(): v for k, v in self.options.items()}

    def schema(self) -> str:
        if self._options().get("mode") == "header":
            return _HEADER_SCHEMA
        kept = _columns(self._options())
        return ", ".join(c for c in _CHUNK_SCHEMA.split(", ") if c.split()[0] in kept)

    def reader(self, schema: StructType) -> DataSourceReader:
        return ShardReader(self._options())

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return ShardStreamReader(self._options())

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return ShardWriter(self._options(), overwrite)


def read_token_shards(
    spark: SparkSession, path: str, split: str | None = None, columns: Sequence[str] | None = None
) -> DataFrame:
    """Chunks of ids: ``(file, shard_index, split, n_tokens, lo, ids)``, or only the ``columns`` that are named.

    Filters on ``file``, ``shard_index`` and ``split`` reach the source, which then plans no task for other files.
    """
    reader = _reader(spark, split)
    return (reader.option("columns", ",".join(columns)) if columns else reader).load(path)


def stream_token_shards(spark: SparkSession, path: str, split: str | None = None, headers: bool = False) -> DataFrame:
    """A stream of the shards that are added to ``path``: chunks of ids, or ``headers``."""
    spark.dataSource.register(TokenShards)
    reader = spark.readStream.format("token_shards").option("mode", "header" if headers else "chunks")
    return (reader.option("split", split) if split else reader).load(path)


def scan_shard_headers(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """Headers only, 1 KB per file: ``(file, shard_index, split, version, bits, tokens)``.

    A folder without shards gives an empty table.
    """
    return _reader(spark, split).option("mode", "header").load(path)


def _reader(spark: SparkSession, split: str | None):
    spark.dataSource.register(TokenShards)
    spark.conf.set(PUSHDOWN, "true")  # Spark refuses a source that takes filters unless this is set
    reader = spark.read.format("token_shards")
    return reader.option("split", split) if split else reader


def shard_version(vocab_size: int) -> int:
    """Version 1 stores 16-bit ids; a larger vocabulary needs version 2."""
    return 1 if vocab_size <= 1 << 16 else 2


def write_token_shards(
    pieces: DataFrame, path: str, version: int = 1, tasks: int | None = None, mode: str = "overwrite"
) -> None:
    """Write slices ``(shard, lo, ids)`` as one file per shard.

    ``lo`` is where a slice begins in its shard, as :func:`cut_shards` gives it;
    slices that do not know it have their order in ``lo`` and the size of their
    shard in ``tokens``. A shard goes to one task, which holds ``shard_size`` ids of 2 or 4 bytes;
    ordering inside it is Spark's sort, which spills. With ``tasks`` at the
    number of shards, each task has exactly one.
    """
    pieces.sparkSession.dataSource.register(TokenShards)
    sizes = ["tokens"] if "tokens" in pieces.columns else []
    named = pieces.select("shard", shard_file(F.col("shard")).alias("file"), "lo", "ids", *sizes)
    dealt = named.repartitionById(tasks, F.col("shard").cast("int")) if tasks else named.repartition("file")
    ordered = dealt.drop("shard").sortWithinPartitions("file", "lo")
    ordered.write.format("token_shards").mode(mode).option("path", path).option("version", version).save()
