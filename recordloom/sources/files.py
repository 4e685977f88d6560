"""A Spark data source that lists the files below a folder: metadata, no content.

It differs from Spark's ``binaryFile`` in that zero-byte files and names with a leading dot or
underscore are listed and times keep their microseconds. Folders are listed by the tasks, one
partition for each folder found in the first levels, through pyarrow's file systems, so object
stores work as local folders do. Symbolic links are skipped, reserved directories are never
entered, and what cannot be read becomes a row with an ``error``. ``snapshot_of_files`` makes the same
rows by rounds of tasks that share the folders found.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator
from datetime import datetime, timezone
from functools import reduce

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from recordloom.functions.columns import classify, extension
from recordloom.functions.fingerprints import MIB, MIDDLE
from recordloom.operators.storage import materialize
from recordloom.sources.inventory import COLUMNS, RESERVED_DIRECTORIES

SCHEMA = "full_path string, size_bytes long, last_write_utc timestamp, error string"
#: Levels of folders that are listed while planning; each folder at that depth is a partition with all below it.
PLANNED_LEVELS = 2
#: Folders that a task enters in one round of a snapshot, and rows that it holds before it sends them.
ENTERED = 1000
SENT_ROWS = 10_000
FOUND = f"{SCHEMA}, folder string"


class _Folder(InputPartition):
    def __init__(self, path: str, deep: bool) -> None:
        self.path, self.deep = path, deep


def list_folder(fs: pyarrow.fs.FileSystem, path: str, reserved: set[str]) -> tuple[list[str], list[tuple]]:
    """Folders to enter, and rows for the files and failures of one folder."""
    folders, rows = [], []
    try:
        found = fs.get_file_info(pyarrow.fs.FileSelector(path))
    except OSError as failed:
        return [], [(path, None, None, f"List failed (path='{path}'): {failed}")]
    local = isinstance(fs, pyarrow.fs.LocalFileSystem)
    for info in found:
        if local and os.path.islink(info.path):
            continue
        if info.type == pyarrow.fs.FileType.Directory:
            if info.base_name.lower() not in reserved:
                folders.append(info.path)
        elif info.type == pyarrow.fs.FileType.File:
            if info.mtime_ns is None:
                rows.append((info.path, info.size, None, f"No time (path='{info.path}')"))
            else:
                time = datetime.fromtimestamp(info.mtime_ns // 1_000_000_000, tz=timezone.utc).replace(microsecond=info.mtime_ns // 1000 % 1_000_000)
                rows.append((info.path, info.size, time, None))
        else:
            rows.append((info.path, None, None, f"Cannot be read (path='{info.path}')"))
    return folders, rows


class FileListReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root = options["path"]
        self.reserved = {n.lower() for n in options.get("reserved", ",".join(RESERVED_DIRECTORIES)).split(",")}
        self.levels = int(options.get("levels", PLANNED_LEVELS))

    def partitions(self) -> list[InputPartition]:
        fs, root = pyarrow.fs.FileSystem.from_uri(self.root)
        out, level = [], [root]
        for depth in range(self.levels + 1):
            deep = depth == self.levels
            out += [_Folder(p, deep) for p in level]
            if deep:
                break
            level = [f for p in level for f in list_folder(fs, p, self.reserved)[0]]
        return out

    def read(self, partition: _Folder) -> Iterator[tuple]:
        fs, _ = pyarrow.fs.FileSystem.from_uri(self.root)
        waiting = [partition.path]
        while waiting:
            folders, rows = list_folder(fs, waiting.pop(), self.reserved)
            yield from rows
            if partition.deep:
                waiting += folders


class FileListSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "file_list"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FileListReader:
        return FileListReader(self.options)


def inventory_from_files(spark: SparkSession, root: str, **options: str) -> DataFrame:
    """Inventory of the files below ``root`` (a URI or an absolute path), with an ``error`` column."""
    spark.dataSource.register(FileListSource)
    return _typed(spark.read.format("file_list").options(**options).load(root))


def _typed(rows: DataFrame) -> DataFrame:
    rows = rows.withColumn("extension", extension(rows["full_path"]))
    rows = rows.withColumn("category", classify(rows["extension"]))
    return rows.select(*COLUMNS, "error")


def snapshot_of_files(spark: SparkSession, root: str, reserved: tuple[str, ...] = RESERVED_DIRECTORIES, entered: int = ENTERED) -> DataFrame:
    """As ``inventory_from_files``, listed now and by rounds; the result is a table, and the driver lists nothing.

    A round is a table of folders, dealt out evenly. A task lists those it is dealt and goes on into
    what they hold until it has entered ``entered`` folders; what is left is the next round's table. A deep chain
    so takes a round for every ``entered`` levels, and one heavy branch is shared out among all tasks from the next round on.
    """
    names = {n.lower() for n in reserved}
    _, base = pyarrow.fs.FileSystem.from_uri(root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pyarrow.fs.FileSystem.from_uri(root)
        budget, rows = entered, []
        for batch in batches:
            for given in batch["folder"].to_pylist():
                waiting = [given]
                while waiting and (waiting[0] is given or budget > 0):
                    folders, files = list_folder(fs, waiting.pop(), names)
                    budget -= 1
                    waiting += folders
                    rows += [(*f, None) for f in files]
                    if len(rows) >= SENT_ROWS:
                        yield _listed(rows)
                        rows = []
                rows += [(None, None, None, None, f) for f in waiting]
        yield _listed(rows)

    frontier, found = spark.createDataFrame([(base,)], "folder string"), []
    while not frontier.isEmpty():
        listed = materialize(frontier.mapInArrow(run, FOUND), "listed")
        found.append(listed.filter("folder is null").drop("folder"))
        frontier = listed.filter("folder is not null").select("folder").repartition(spark.sparkContext.defaultParallelism)
    return _typed(reduce(lambda a, b: a.unionByName(b), found))


def _listed(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 5
    types = [pa.string(), pa.int64(), pa.timestamp("us", tz="UTC"), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["full_path", "size_bytes", "last_write_utc", "error", "folder"])


def _each(listed: DataFrame, root: str, name: str, value: Callable[[pyarrow.fs.FileSystem, str, int], str]) -> DataFrame:
    """Add ``name``, made of each file by a task that reads it, and ``read_error`` where that fails."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pyarrow.fs.FileSystem.from_uri(root)
        for batch in batches:
            made: list[str | None] = []
            errors: list[str | None] = []
            for path, size in zip(batch["full_path"].to_pylist(), batch["size_bytes"].to_pylist(), strict=True):
                try:
                    made.append(value(fs, path, size))
                    errors.append(None)
                except OSError as failed:
                    made.append(None)
                    errors.append(f"Read failed (path='{path}'): {failed}")
            arrays = [*batch.columns, pa.array(made, pa.string()), pa.array(errors, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names, name, "read_error"])

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in listed.schema.fields)
    return listed.mapInArrow(run, f"{kept}, {name} string, read_error string")


def file_signatures(listed: DataFrame, root: str) -> DataFrame:
    """Add ``quick_signature`` to files listed below ``root``: a hash of the size and of the slices that ``quick_signature`` of content takes; only these are read."""

    def sign(fs: pyarrow.fs.FileSystem, path: str, size: int) -> str:
        if size == 0:
            return "empty"
        slices = [(0, min(size, MIB))]
        if size > 2 * MIB:
            slices.append((size // 2 - MIDDLE // 2, MIDDLE))
        if size > MIB:
            slices.append((size - MIB, MIB))
        held = hashlib.sha256(str(size).encode())
        with fs.open_input_file(path) as file:
            for begin, n in slices:
                held.update(file.read_at(n, begin))
        return held.hexdigest()[:32]

    return _each(listed, root, "quick_signature", sign)


def file_digests(listed: DataFrame, root: str, chunk: int = MIB) -> DataFrame:
    """Add ``sha256_hash`` of each whole file, read in chunks."""

    def digest(fs: pyarrow.fs.FileSystem, path: str, size: int) -> str:
        held = hashlib.sha256()
        with fs.open_input_stream(path) as stream:
            while data := stream.read(chunk):
                held.update(data)
        return held.hexdigest()

    return _each(listed, root, "sha256_hash", digest)


def write_files(rows: DataFrame, folder: str) -> DataFrame:
    """Write ``content`` of each row to ``folder`` + full_path, and return (full_path, write_error) of what was written; repeated writes leave the same files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pyarrow.fs.FileSystem.from_uri(folder)
        for batch in batches:
            errors: list[str | None] = []
            for path, content in zip(batch["full_path"].to_pylist(), batch["content"].to_pylist(), strict=True):
                own = base + path
                try:
                    fs.create_dir(own.rsplit("/", 1)[0])
                    with fs.open_output_stream(own) as out:
                        out.write(content.encode() if isinstance(content, str) else content or b"")
                    errors.append(None)
                except OSError as failed:
                    errors.append(f"Write failed (path='{path}'): {failed}")
            yield pa.RecordBatch.from_arrays([batch["full_path"], pa.array(errors, pa.string())], ["full_path", "write_error"])

    return rows.select("full_path", "content").mapInArrow(run, "full_path string, write_error string")
