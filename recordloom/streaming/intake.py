"""Streams of records: stateless filtering, and intake with fingerprint reuse across batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from recordloom.functions.columns import destination_folder
from recordloom.functions.filters import ScanFilter
from recordloom.functions.fingerprints import sha256
from recordloom.operators import levels
from recordloom.operators.dedupe import member_order
from recordloom.operators.narrow import narrowed
from recordloom.operators.reuse import SCHEMA, latest_versions, with_fingerprints
from recordloom.operators.storage import materialize
from recordloom.sources.inventory import scan

HOLDERS = "sha256 string, full_path string, alive boolean"
SEEN = "full_path string, size_bytes long, last_write_utc timestamp, sha256 string, is_duplicate boolean, reused boolean, batch long"


def filter_stream(inventory: DataFrame, options: ScanFilter, target: str) -> DataFrame:
    """Accepted rows of a batch or a stream with their destination folder; no state is kept."""
    kept = scan(inventory, options)
    return kept.withColumn("destination", destination_folder(target, F.col("category"), F.col("last_write_utc")))


def intake_batch(batch: DataFrame, batch_id: int, store: str, out: str, compute: Callable[[Column], Column] = sha256) -> None:
    """Mark each record of a batch as new or as a copy of an earlier one, then add the batch to the store.

    Digests are computed only where the store has no value for the record's version. The first
    of equal records inside a batch (oldest, then by path) is new if no earlier batch had it.
    A batch is judged against the batches before it alone, and what it has written is replaced when
    it is written again, so a batch that is repeated, after a crash at any point or later, gives
    the same rows.

    The store is two log-structured tables (``operators/levels``), of versions by path and of paths by
    digest. A batch reads the buckets of its own paths and digests, keeps the rows of these alone, and
    merges only buckets that it has written.
    """
    spark, paths, contents = batch.sparkSession, f"{store}/paths", f"{store}/contents"
    asked = materialize(batch.select("full_path").distinct(), "asked")
    path_buckets = levels.buckets_of(asked, "full_path")
    known = narrowed(levels.read_buckets(spark, paths, SCHEMA, path_buckets, batch_id), asked, ["full_path"])
    known = materialize(levels.newest(known, ["full_path"]), "known")
    rows = with_fingerprints(batch, known, compute).select("full_path", "size_bytes", "mtime_us", "last_write_utc", "sha256", "reused")
    rows = materialize(rows, "batch")
    first = materialize(rows.groupBy("sha256").agg(F.min_by("full_path", F.struct(*member_order())).alias("first_path")), "firsts")
    digests = first.select("sha256")
    holders = narrowed(levels.read_buckets(spark, contents, HOLDERS, levels.buckets_of(digests, "sha256"), batch_id), digests, ["sha256"])
    holders = materialize(levels.newest(holders, ["sha256", "full_path"]).filter("alive").select("sha256", "full_path"), "holders")
    earlier = holders.groupBy("sha256").agg(F.count("*").alias("known"))  # a path is known once
    told = materialize(first.join(earlier, "sha256", "left"), "told")
    own = holders.withColumn("own", F.lit(1))
    marked = rows.join(told, "sha256").join(own, ["sha256", "full_path"], "left")
    others = F.coalesce("known", F.lit(0)) - F.coalesce("own", F.lit(0))  # earlier records with this content at other paths
    duplicate = (others > 0) | (F.col("full_path") != F.col("first_path"))
    marked = marked.select("full_path", "size_bytes", "last_write_utc", "sha256", duplicate.alias("is_duplicate"), "reused")
    marked.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
    used = rows.select("full_path", "size_bytes", "mtime_us", "sha256", F.lit(None).cast("string").alias("quick_signature"), F.current_timestamp().alias("last_used"))
    used = materialize(latest_versions(used), "used")
    left = known.select("full_path", F.col("sha256").alias("old")).join(used.select("full_path", "sha256"), "full_path").filter("old <> sha256")
    changed = used.select("sha256", "full_path", F.lit(True).alias("alive")).unionByName(left.select(F.col("old").alias("sha256"), "full_path", F.lit(False).alias("alive")))
    changed = materialize(changed, "changed")
    levels.write_delta(used, paths, "full_path", batch_id)
    levels.write_delta(changed, contents, "sha256", batch_id)
    levels.merge(spark, paths, SCHEMA, ["full_path"], path_buckets, batch_id)
    levels.merge(spark, contents, HOLDERS, ["sha256", "full_path"], levels.buckets_of(changed, "sha256"), batch_id, F.col("alive"))


def incremental_intake(stream: DataFrame, store: str, out: str, checkpoint: str) -> StreamingQuery:
    """Run ``intake_batch`` over all that a stream of inventory rows (with content) has now."""
    return (
        stream.writeStream.foreachBatch(lambda batch, batch_id: intake_batch(batch, batch_id, store, out))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_intake(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(SEEN).option("basePath", out).parquet(out)
