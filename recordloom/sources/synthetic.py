"""A synthetic inventory of any size, for scale tests: exact pairs, same-size variants and unique records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sizes in bytes that records have.
SIZES = (1024, 2048, 4096, 8192, 16384, 32768, 65536, 262144, 1048576)
SHELVES = 12


def synthetic_inventory(spark: SparkSession, n: int, dup: float = 0.2, same_size: float = 0.1, seed: int = 42, root: str = "/synthetic") -> DataFrame:
    """n records with content: floor(n dup / 2) exact pairs, floor(n same_size) variants, the rest unique.

    Everything follows from the record's number and the seed, so partitions do not matter.
    """
    if n <= 0:
        raise ValueError("n must be positive")
    if not (0 <= dup <= 1 and 0 <= same_size <= 1 and dup + same_size <= 1):
        raise ValueError("ratios must be from 0 to 1, and their sum at most 1")
    paired = int(n * dup) // 2 * 2
    variants = min(int(n * same_size), n - paired)
    unique = n - paired - variants
    i = F.col("id")
    shared = F.when((i >= unique) & (i < unique + paired), F.floor((i - unique) / 2))
    # what a record's content is made from; the two of a pair have the same
    rows = spark.range(n).select("id", F.sha2(F.concat_ws("/", F.lit(seed), F.coalesce(F.concat(F.lit("pair "), shared), F.concat(F.lit("own "), i))), 256).alias("grain"))
    size = F.element_at(F.array(*map(F.lit, SIZES)), (F.pmod(F.xxhash64("grain"), F.lit(len(SIZES))) + 1).cast("int"))
    rows = rows.withColumn("size_bytes", size.cast("long"))
    shelf = F.format_string("shelf%02d/box%d", F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(SHELVES)), F.pmod(F.col("id"), F.lit(7)))
    name = F.format_string("record-%d.bin", F.col("id"))
    return rows.select(
        F.concat_ws("/", F.lit(root), shelf, name).alias("full_path"),
        F.lit(".bin").alias("extension"),
        "size_bytes",
        F.timestamp_seconds(1704067200 + F.pmod(F.xxhash64("id"), F.lit(86400 * 365))).alias("last_write_utc"),
        F.lit("other").alias("category"),
        F.expr("repeat(grain, cast(ceil(size_bytes / 64) as int))").alias("content"),
    )
