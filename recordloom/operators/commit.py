"""Datasets that become visible by a commit: drafts first, then one manifest that names them all.

Phase one (``prepare``): tasks write Parquet drafts through a data source writer, each attempt of a
task under a name of its own. When all tasks have ended, the driver notes the files of those that
counted; if one fails, the drafts are deleted. Phase two (``publish``): one small manifest, put in
place by a rename, names the drafts of all datasets of a stage, so readers see all of them or none.
A stage that is published stays as it is: preparing and publishing it again changes nothing,
whatever a repeated or broken attempt has left behind.

Below a folder: ``data`` has the files, ``prepared`` and ``commits`` the notes. The driver handles
file names and no rows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage


#: Rows that a task's Python is sent at once, and bytes that it gathers for one row group of a file (a longer row is one alone): its memory doesn't grow with the number of rows.
BATCH_ROWS, GROUP_BYTES = 1_000, 8 << 20
_BATCHES = "spark.sql.execution.arrow.maxRecordsPerBatch"


@dataclass
class Written(WriterCommitMessage):
    """The files that one task has written, below the folder, and their rows."""

    files: list[str]
    rows: int


def _files(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    fs, root = pyarrow.fs.FileSystem.from_uri(folder)
    return fs, root.rstrip("/")


def _put(fs: pyarrow.fs.FileSystem, path: str, value: dict) -> None:
    """Write a note whole, then rename it into place."""
    fs.create_dir(path.rsplit("/", 1)[0])
    draft = f"{path}.{uuid.uuid4().hex}.draft"
    with fs.open_output_stream(draft) as out:
        out.write(json.dumps(value).encode())
    fs.move(draft, path)


def _get(fs: pyarrow.fs.FileSystem, path: str) -> dict | None:
    if fs.get_file_info(path).type != pyarrow.fs.FileType.File:
        return None
    with fs.open_input_stream(path) as held:
        return json.loads(held.read())


def _delete(fs: pyarrow.fs.FileSystem, root: str, files: list[str]) -> None:
    for name in files:
        if fs.get_file_info(f"{root}/{name}").type == pyarrow.fs.FileType.File:
            fs.delete_file(f"{root}/{name}")


def _directory(key: str, value: object) -> str:
    """``key=value`` as Spark reads it back from a path."""
    text = "__HIVE_DEFAULT_PARTITION__" if value is None else str(value)
    return f"{key}=" + "".join(f"%{ord(c):02X}" if c < " " or c in _ESCAPED else c for c in text)


#: Characters that Spark escapes in the names of partitions.
_ESCAPED = "\"#%'*/:=?\\\x7f{[]^"


class CommittedWriter(DataSourceArrowWriter):
    """Drafts of one dataset of one stage; rows come sorted by the partition columns, so that one file is open at a time."""

    def __init__(self, options: dict) -> None:
        self.folder, self.base, self.note = options["path"], options["base"], options["note"]
        self.keys = [k for k in options["keys"].split(",") if k]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = _files(self.folder)
        out, key, files, rows = None, None, [], 0
        waiting, size = [], 0

        def flush() -> None:
            nonlocal size
            if waiting:
                out.write_table(pa.concat_tables(waiting))
            waiting.clear()
            size = 0

        for batch in iterator:
            table = pa.Table.from_batches([batch])
            held = [table[k].to_pylist() for k in self.keys]
            begin = 0
            for end in range(1, len(table) + 1):
                own = tuple(column[begin] for column in held)
                if end < len(table) and all(column[end] == value for column, value in zip(held, own, strict=True)):
                    continue
                part = table.slice(begin, end - begin).drop_columns(self.keys)
                if out is None or own != key:
                    if out is not None:
                        flush()
                        out.close()
                    place = "".join(f"/{_directory(k, v)}" for k, v in zip(self.keys, own, strict=True))
                    files.append(f"{self.base}{place}/part-{uuid.uuid4().hex}.parquet")
                    fs.create_dir(f"{root}/{files[-1]}".rsplit("/", 1)[0])
                    out, key = pq.ParquetWriter(f"{root}/{files[-1]}", part.schema, filesystem=fs), own
                step = max(1, len(part) * GROUP_BYTES // max(part.nbytes, 1))
                for at in range(0, len(part), step):
                    some = part.slice(at, step)
                    if size + some.nbytes > GROUP_BYTES:
                        flush()
                    waiting.append(some)
                    size += some.nbytes
                rows, begin = rows + len(part), end
        if out is not None:
            flush()
            out.close()
        pa.default_memory_pool().release_unused()  # the worker lives on
        return Written(files, rows)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = _files(self.folder)
        before = _get(fs, f"{root}/{self.note}")
        done = [m for m in messages if m is not None]
        _put(fs, f"{root}/{self.note}", {"files": sorted(f for m in done for f in m.files), "rows": sum(m.rows for m in done)})
        if before is not None:
            _delete(fs, root, before["files"])

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = _files(self.folder)
        _delete(fs, root, [f for m in messages if m is not None for f in m.files])


class CommittedSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "committed"

    def writer(self, schema: T.StructType, overwrite: bool) -> CommittedWriter:
        return CommittedWriter(self.options)


def _note(transaction_id: str, stage: str, name: str) -> str:
    return f"prepared/{quote(transaction_id, safe='')}/{stage}/{name}.json"


def _manifest(transaction_id: str, stage: str) -> str:
    return f"commits/{quote(transaction_id, safe='')}/{stage}.json"


def prepare(rows: DataFrame, folder: str, transaction_id: str, stage: str, name: str, keys: tuple[str, ...] = ()) -> None:
    """Write ``rows`` as drafts of a dataset, split by ``keys``; what an earlier attempt prepared is replaced. Nothing is visible yet."""
    spark = rows.sparkSession
    spark.dataSource.register(CommittedSink)
    if keys:
        rows = rows.sortWithinPartitions(*keys)
    base = f"data/{name}/{_directory('transaction_id', transaction_id)}"
    options = {"path": folder, "base": base, "keys": ",".join(keys), "note": _note(transaction_id, stage, name)}
    before = spark.conf.get(_BATCHES)
    spark.conf.set(_BATCHES, str(BATCH_ROWS))
    try:
        rows.write.format("committed").mode("append").options(**options).save()
    finally:
        spark.conf.set(_BATCHES, before)


def is_published(folder: str, transaction_id: str, stage: str) -> bool:
    fs, root = _files(folder)
    return fs.get_file_info(f"{root}/{_manifest(transaction_id, stage)}").type == pyarrow.fs.FileType.File


def publish(folder: str, transaction_id: str, stage: str, names: list[str], replace: bool = False) -> bool:
    """Make the prepared datasets of a stage visible at once; False, and the drafts are deleted, if the stage is published already.

    ``replace`` puts the new ones in the place of those published before, which are deleted afterwards.
    """
    fs, root = _files(folder)
    notes = {name: _get(fs, f"{root}/{_note(transaction_id, stage, name)}") for name in names}
    if missing := [name for name, note in notes.items() if note is None]:
        raise ValueError(f"stage {stage} of {transaction_id} is not prepared: {', '.join(missing)}")
    path = f"{root}/{_manifest(transaction_id, stage)}"
    before = _get(fs, path)
    new = before is None or replace
    if new:
        _put(fs, path, {"transaction_id": transaction_id, "stage": stage, "datasets": notes})
    old = {f for note in (before["datasets"].values() if before and replace else () if new else notes.values()) for f in note["files"]}
    kept = {f for note in (notes if new else before["datasets"]).values() for f in note["files"]}
    _delete(fs, root, sorted(old - kept))
    for name in names:
        fs.delete_file(f"{root}/{_note(transaction_id, stage, name)}")
    return new


def published_files(folder: str, name: str) -> list[str]:
    """The visible files of a dataset."""
    fs, root = _files(folder)
    if fs.get_file_info(f"{root}/commits").type != pyarrow.fs.FileType.Directory:
        return []
    found = fs.get_file_info(pyarrow.fs.FileSelector(f"{root}/commits", recursive=True))
    manifests = [_get(fs, i.path) for i in found if i.path.endswith(".json")]
    return sorted(f for m in manifests for f in m["datasets"].get(name, {"files": []})["files"])


def read_published(spark: SparkSession, folder: str, name: str, schema: str, given: bool = True) -> DataFrame:
    """The rows of all published stages of a dataset, ``transaction_id`` and partition columns among them; empty, of this ``schema``, if there are none.

    Without ``given``, the schema is that of the files, all columns that any has.
    """
    files = published_files(folder, name)
    if not files:
        return spark.createDataFrame([], schema)
    at = folder.rstrip("/")
    read = spark.read.schema(schema) if given else spark.read.option("mergeSchema", True)
    return read.option("basePath", f"{at}/data/{name}").parquet(*(f"{at}/{f}" for f in files))


def sweep(folder: str) -> int:
    """Delete the drafts that neither a manifest nor a prepared dataset names, as lost attempts leave them; how many there were. Only while no run is writing."""
    fs, root = _files(folder)
    named = set()
    for place in ("commits", "prepared"):
        if fs.get_file_info(f"{root}/{place}").type == pyarrow.fs.FileType.Directory:
            for info in fs.get_file_info(pyarrow.fs.FileSelector(f"{root}/{place}", recursive=True)):
                if info.path.endswith(".json"):
                    note = _get(fs, info.path)
                    named.update(f for own in note.get("datasets", {"": note}).values() for f in own["files"])
    if fs.get_file_info(f"{root}/data").type != pyarrow.fs.FileType.Directory:
        return 0
    there = [i.path.removeprefix(f"{root}/") for i in fs.get_file_info(pyarrow.fs.FileSelector(f"{root}/data", recursive=True)) if i.is_file]
    lost = [f for f in there if f not in named]
    _delete(fs, root, lost)
    return len(lost)
