"""A log-structured table in hash buckets: batches add deltas, and buckets are merged one by one.

Rows lie by bucket of their key, level and batch. A batch writes the buckets of its own keys (level 0)
and reads no others; a bucket with MERGE_AFTER deltas is merged into one level-1 table of its newest
rows, noted only when it is whole, so an unfinished merge is never read. Reads are as of a batch:
the last merge noted before it and the deltas since. Writing a batch again replaces its deltas, so a
batch that is repeated reads and leaves the same. ``vacuum`` deletes what no read as of a later batch needs.

Each of a bucket's keys is dealt to SPLITS files, so that a hot key does not make one task write its bucket.
"""

from __future__ import annotations

import uuid

import pyarrow.fs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS, SPLITS, MERGE_AFTER = 64, 4, 8
DELTA, MERGED = 0, 1


def bucket(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def buckets_of(rows: DataFrame, key: str) -> list[int]:
    """The buckets of the rows' keys: at most BUCKETS numbers."""
    return sorted(r[0] for r in rows.select(bucket(key)).distinct().collect())


def _folders(folder: str) -> list[str]:
    """The names of the folders in a folder, of which there are at most as many as buckets, or batches of a bucket since it was vacuumed."""
    fs, root = pyarrow.fs.FileSystem.from_uri(folder)
    if fs.get_file_info(root).type != pyarrow.fs.FileType.Directory:
        return []
    return [i.base_name for i in fs.get_file_info(pyarrow.fs.FileSelector(root)) if i.type == pyarrow.fs.FileType.Directory]


def _numbers(names: list[str], key: str) -> list[int]:
    return sorted(int(n.removeprefix(f"{key}=")) for n in names if n.startswith(f"{key}="))


def _merges(spark: SparkSession, folder: str, before: int) -> dict[int, int]:
    """The last merge of each bucket noted before a batch."""
    try:
        notes = spark.read.schema("bucket int, upto long").parquet(f"{folder}/merges")
    except AnalysisException:
        return {}
    return {r["bucket"]: r["upto"] for r in notes.filter(F.col("upto") < before).groupBy("bucket").agg(F.max("upto").alias("upto")).collect()}


def _write(rows: DataFrame, folder: str, key: str, level: int, batch: int) -> None:
    placed = rows.withColumn("bucket", bucket(key)).withColumn("level", F.lit(level)).withColumn("batch", F.lit(batch).cast("long"))
    spread = placed.repartition("bucket", F.pmod(F.xxhash64(*rows.columns), F.lit(SPLITS)))
    spread.write.partitionBy("bucket", "level", "batch").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{folder}/rows")


def write_delta(rows: DataFrame, folder: str, key: str, batch: int) -> None:
    """Add a batch's rows, or replace those that it has written before."""
    _write(rows, folder, key, DELTA, batch)


def read_buckets(spark: SparkSession, folder: str, schema: str, buckets: list[int], before: int) -> DataFrame:
    """The rows of some buckets as the batches before ``before`` left them, with their ``batch``; a key may have several."""
    there = set(_numbers(_folders(f"{folder}/rows"), "bucket"))
    paths = [f"{folder}/rows/bucket={b}" for b in buckets if b in there]
    whole = f"{schema}, bucket int, level int, batch long"
    if not paths:
        return spark.createDataFrame([], whole).drop("bucket", "level")
    merged = {b: n for b, n in _merges(spark, folder, before).items() if b in there}
    upto = F.coalesce(F.create_map(*(F.lit(v) for pair in merged.items() for v in pair))[F.col("bucket")], F.lit(-1)) if merged else F.lit(-1)
    rows = spark.read.schema(whole).option("basePath", f"{folder}/rows").parquet(*paths)
    # on partition columns alone: other files are not opened
    since = (F.col("level") == DELTA) & (F.col("batch") > upto) & (F.col("batch") < before)
    return rows.filter(since | ((F.col("level") == MERGED) & (F.col("batch") == upto))).drop("bucket", "level")


def newest(rows: DataFrame, key: list[str]) -> DataFrame:
    """The row of the last batch for each key."""
    rest = [c for c in rows.columns if c not in (*key, "batch")]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), "batch").alias("v")).select(*key, "v.*")


def merge(spark: SparkSession, folder: str, schema: str, key: list[str], buckets: list[int], batch: int, kept: Column | None = None) -> list[int]:
    """Merge those of the buckets that have MERGE_AFTER deltas or more up to ``batch``; returns them. Rows that are not ``kept`` need not be remembered."""
    merged = _merges(spark, folder, batch + 1)
    full = []
    for b in buckets:
        deltas = [n for n in _numbers(_folders(f"{folder}/rows/bucket={b}/level={DELTA}"), "batch") if merged.get(b, -1) < n <= batch]
        if len(deltas) >= MERGE_AFTER:
            full.append(b)
    if full:
        rows = newest(read_buckets(spark, folder, schema, full, batch + 1), key)
        _write(rows if kept is None else rows.filter(kept), folder, key[0], MERGED, batch)
        notes = spark.createDataFrame([(b, batch) for b in full], "bucket int, upto long")
        notes.coalesce(1).write.mode("append").parquet(f"{folder}/merges")
    return full


def last_batch(folder: str) -> int:
    """The highest batch that has left rows, -1 if there is none."""
    found = [-1]
    for b in _numbers(_folders(f"{folder}/rows"), "bucket"):
        for level in (DELTA, MERGED):
            found += _numbers(_folders(f"{folder}/rows/bucket={b}/level={level}"), "batch")
    return max(found)


def vacuum(spark: SparkSession, folder: str, batch: int) -> int:
    """Delete deltas and merges that reads as of ``batch`` and later ones don't need; how many folders went. Batches before it can no longer be repeated."""
    fs, root = pyarrow.fs.FileSystem.from_uri(folder)
    merged, gone = _merges(spark, folder, batch), 0
    for b, upto in merged.items():
        old = [(DELTA, n) for n in _numbers(_folders(f"{folder}/rows/bucket={b}/level={DELTA}"), "batch") if n <= upto]
        old += [(MERGED, n) for n in _numbers(_folders(f"{folder}/rows/bucket={b}/level={MERGED}"), "batch") if n < upto]
        for level, n in old:
            trash = f"{root}/trash-{uuid.uuid4().hex}"
            fs.move(f"{root}/rows/bucket={b}/level={level}/batch={n}", trash)
            fs.delete_dir(trash)
            gone += 1
    return gone
