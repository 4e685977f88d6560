"""Files below a folder as a stream: each run of it takes in what is new or has changed since the last.

``note_arrivals`` lists the folder by rounds of tasks and appends the versions (path, size, time) that
no earlier listing held to a table; that table is what Structured Streaming reads, so its checkpoint
says which arrivals a query has seen, and offsets need no listing of their own. A listing that broke
off leaves some versions noted; the next one notes the others, so each is noted once. One
listing of a folder runs at a time.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from recordloom.operators.storage import materialize
from recordloom.sources.files import file_digests, snapshot_of_files
from recordloom.sources.inventory import RESERVED_DIRECTORIES, SCHEMA

VERSION = ["full_path", "size_bytes", "last_write_utc"]
DIGESTS = f"{SCHEMA}, sha256_hash string, read_error string, batch long"


def note_arrivals(spark: SparkSession, root: str, arrivals: str, reserved: tuple[str, ...] = RESERVED_DIRECTORIES) -> int:
    """Append the readable files whose version is not in ``arrivals`` yet, and return how many; a version that comes back is no arrival."""
    listed = snapshot_of_files(spark, root, reserved).filter("error is null").drop("error")
    try:
        known = spark.read.schema(SCHEMA).parquet(arrivals)
        listed = listed.join(known.select(*VERSION), VERSION, "left_anti")
    except AnalysisException:
        pass  # the first listing
    new = materialize(listed, "arrivals")
    count = new.count()
    if count:
        new.write.mode("append").parquet(arrivals)
    return count


def digest_arrivals(spark: SparkSession, root: str, arrivals: str, out: str, checkpoint: str) -> StreamingQuery:
    """Read and hash the files that have arrived since the last run with this checkpoint, and no others; a batch that is repeated replaces what it wrote.

    A file that is gone or unreadable by then has a ``read_error`` and no digest.
    """
    stream = file_digests(spark.readStream.schema(SCHEMA).parquet(arrivals), root)
    return (
        stream.writeStream.foreachBatch(lambda rows, batch_id: rows.write.mode("overwrite").parquet(f"{out}/batch={batch_id}"))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_digests(spark: SparkSession, out: str) -> DataFrame:
    """What the batches wrote, all versions with their batch."""
    return spark.read.schema(DIGESTS).option("basePath", out).parquet(out)


def current_digests(spark: SparkSession, out: str) -> DataFrame:
    """The digest of the last version of each path."""
    found = read_digests(spark, out)
    last = found.groupBy("full_path").agg(F.max_by(F.struct("size_bytes", "last_write_utc", "sha256_hash", "read_error", "batch"), F.struct("batch", "last_write_utc", "size_bytes")).alias("v"))
    return last.select("full_path", "v.*")
