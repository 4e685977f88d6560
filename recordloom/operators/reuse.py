"""Fingerprint reuse: computed values kept by (path, size, time) and joined back on the next run.

The store is a Parquet snapshot: full_path, size_bytes, mtime_us, sha256, quick_signature,
last_used. A snapshot is written whole into a folder of its version, then a row names the version
as complete, so a reader sees the old or the new one. Streams and repeated runs keep theirs in hash
buckets instead (``levels``), of which each reads and writes only its own keys'.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recordloom.operators import levels
from recordloom.operators.narrow import BROADCAST_KEYS, narrowed
from recordloom.operators.ordering import largest
from recordloom.operators.storage import materialize

SCHEMA = "full_path string, size_bytes long, mtime_us long, sha256 string, quick_signature string, last_used timestamp"
_COLUMNS = [f.split()[0] for f in SCHEMA.split(", ")]
KEY = ["full_path", "size_bytes", "mtime_us"]
#: Fixed value: fingerprints kept by default.
RETAINED = 200_000


def _version(spark: SparkSession, folder: str, before: int | None) -> int | None:
    try:
        done = spark.read.schema("version long").parquet(f"{folder}/complete")
    except AnalysisException:
        return None
    return (done if before is None else done.filter(F.col("version") < before)).agg(F.max("version")).first()[0]


def read_fingerprints(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame:
    """The last complete snapshot (of a version below ``before``); empty if there is none or it cannot be read, rows without a path or value dropped."""
    version = _version(spark, folder, before)
    try:
        rows = spark.createDataFrame([], SCHEMA) if version is None else spark.read.schema(SCHEMA).parquet(f"{folder}/snapshot-{version}")
    except AnalysisException:
        rows = spark.createDataFrame([], SCHEMA)
    return rows.filter("full_path is not null and (sha256 is not null or quick_signature is not null)")


def write_fingerprints(rows: DataFrame, folder: str, version: int) -> None:
    """Write a snapshot whole, then a row that says so; an unfinished one is never read, and is replaced when written again."""
    spark = rows.sparkSession
    rows.select(*_COLUMNS).write.mode("overwrite").parquet(f"{folder}/snapshot-{version}")
    spark.range(1).select(F.lit(version).cast("long").alias("version")).coalesce(1).write.mode("append").parquet(f"{folder}/complete")


def _keyed(inventory: DataFrame) -> DataFrame:
    return inventory.withColumn("mtime_us", F.unix_micros("last_write_utc"))


def fingerprint_hits(inventory: DataFrame, store: DataFrame, refresh: bool = False) -> DataFrame:
    """Rows whose version has a stored digest, with it; ``refresh`` trusts none."""
    known = store.filter(F.col("sha256").isNotNull() & F.lit(not refresh)).select(*KEY, "sha256")
    return _keyed(inventory).join(known, KEY)


def fingerprint_misses(inventory: DataFrame, store: DataFrame, refresh: bool = False) -> DataFrame:
    """Rows to compute, found without reading content."""
    known = store.filter(F.col("sha256").isNotNull() & F.lit(not refresh)).select(*KEY)
    return _keyed(inventory).join(known, KEY, "left_anti")


def missing_digests(inventory: DataFrame, missing: DataFrame, compute: Callable[[Column], Column], limit: int = BROADCAST_KEYS) -> DataFrame:
    """KEY and sha256 of the rows whose keys are in the written table ``missing`` (and of a few more beyond ``limit``): content is read and hashed where it lies."""
    return narrowed(_keyed(inventory), missing, KEY, limit).select(*KEY, compute(F.col("content")).alias("sha256"))


def with_fingerprints(inventory: DataFrame, store: DataFrame, compute: Callable[[Column], Column], refresh: bool = False) -> DataFrame:
    """``sha256`` and ``reused`` for every row, in place of content: the stored digest, or ``compute(content)`` for misses alone. Any column expression or pandas UDF will do.

    Which rows miss is decided on keys, in one join of rows without content; content crosses no exchange, and is read once for
    the rows' sizes and once for the digests that miss.
    """
    known = store.filter(F.col("sha256").isNotNull() & F.lit(not refresh)).select(*KEY, "sha256")
    looked = materialize(_keyed(inventory.drop("content")).join(known, KEY, "left"), "looked")
    hits = looked.filter("sha256 is not null").withColumn("reused", F.lit(True))
    missed = looked.filter("sha256 is null").drop("sha256")
    # a row of the same path, size and time twice has one content; the first is as good as the other
    computed = missing_digests(inventory, missed, compute).dropDuplicates(KEY)
    return hits.unionByName(missed.join(computed, KEY).withColumn("reused", F.lit(False)))


def latest_versions(rows: DataFrame) -> DataFrame:
    """The newest version of each path."""
    newest = Window.partitionBy("full_path").orderBy(F.desc("mtime_us"), F.desc("last_used"), F.desc("size_bytes"))
    return rows.withColumn("__n", F.row_number().over(newest)).filter("__n = 1").drop("__n")


def retain(rows: DataFrame, limit: int = RETAINED) -> DataFrame:
    """The ``limit`` most recently used fingerprints, by path among equals; 0 or less keeps all."""
    return rows if limit <= 0 else largest(rows, limit, F.unix_micros("last_used"), [F.col("full_path")])


def fingerprint_upsert(store: DataFrame, computed: DataFrame, now: Column, limit: int = RETAINED) -> DataFrame:
    """The store after a run: versions used or computed replace all older ones of their path."""
    used = computed.select(*KEY, "sha256", (F.col("quick_signature") if "quick_signature" in computed.columns else F.lit(None).cast("string")).alias("quick_signature"), now.alias("last_used"))
    untouched = store.join(used.select("full_path"), "full_path", "left_anti")
    return retain(latest_versions(untouched.unionByName(used)), limit)


def fingerprint_stats(inventory: DataFrame, store: DataFrame, limit: int = RETAINED) -> DataFrame:
    """hits, computes, invalidations (stored versions that a new one replaces), evictions, entries after the run."""
    rows = _keyed(inventory).select(*KEY)
    known = store.select(*KEY).withColumn("stored", F.lit(True))
    joined = rows.join(known, KEY, "left").agg(F.count_if("stored").alias("hits"), F.count_if(F.col("stored").isNull()).alias("computes"))
    stale = store.select(*KEY).join(rows.select("full_path"), "full_path", "left_semi").join(rows, KEY, "left_anti").agg(F.count("*").alias("invalidations"))
    paths = rows.select("full_path").union(store.select("full_path")).agg(F.count_distinct("full_path").alias("paths"))
    one = joined.withColumn("k", F.lit(1)).join(stale.withColumn("k", F.lit(1)), "k").join(paths.withColumn("k", F.lit(1)), "k")  # one row each
    kept = F.col("paths") if limit <= 0 else F.least("paths", F.lit(limit))
    return one.select("hits", "computes", "invalidations", (F.col("paths") - kept).alias("evictions"), kept.cast("long").alias("entries"))


def known_versions(spark: SparkSession, folder: str, inventory: DataFrame) -> DataFrame:
    """The stored versions of an inventory's paths, from a store in buckets: buckets of other paths are not read, and their rows are left where they lie."""
    asked = materialize(inventory.select("full_path").distinct(), "asked")
    held = levels.read_buckets(spark, folder, SCHEMA, levels.buckets_of(asked, "full_path"), levels.last_batch(folder) + 1)
    return levels.newest(narrowed(held, asked, ["full_path"]), ["full_path"])


def remember(computed: DataFrame, folder: str, now: Column) -> None:
    """Add the versions that a run has used or computed to a store in buckets, and merge the buckets that need it."""
    spark, batch = computed.sparkSession, levels.last_batch(folder) + 1
    keyed = computed if "mtime_us" in computed.columns else _keyed(computed)
    used = materialize(latest_versions(keyed.select(*KEY, "sha256", F.lit(None).cast("string").alias("quick_signature"), now.alias("last_used"))), "used")
    levels.write_delta(used, folder, "full_path", batch)
    levels.merge(spark, folder, SCHEMA, ["full_path"], levels.buckets_of(used, "full_path"), batch)
