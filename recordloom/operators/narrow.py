"""Leave rows whose keys are wanted where they lie: no exchange of the rows, whatever they carry.

Few wanted keys are broadcast. More are put into a Bloom filter of fixed size: BITS bits in buckets of
BUCKET_BITS, a bucket for each key and PROBES bits in it, built by Spark's mergeable bitmap
aggregate, so every task sends at most the filter itself. The filter lets some other rows through
(few, up to about BITS / 16 keys), so what follows checks exactly on keys alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Wanted keys that are broadcast themselves, at most.
BROADCAST_KEYS = 200_000
#: Bits of the filter (16 MiB are broadcast) and bits set for a key.
BITS, PROBES = 1 << 27, 4
#: Fixed value: bits of a bitmap of Spark's aggregate.
BUCKET_BITS = 1 << 15


def _bucket(keys: list[str], bits: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(max(1, bits // BUCKET_BITS))).cast("int")


def _positions(keys: list[str]) -> list[Column]:
    """The bits of a key in its bucket."""
    return [F.pmod(F.xxhash64(F.lit(k), *keys), F.lit(BUCKET_BITS)).cast("int") for k in range(1, PROBES + 1)]


def bloom_filter(wanted: DataFrame, keys: list[str], bits: int = BITS) -> DataFrame:
    """(bucket, bitmap) of the filter: at most ``bits`` / BUCKET_BITS rows."""
    spread = wanted.select(_bucket(keys, bits).alias("bucket"), F.explode(F.array(*_positions(keys))).alias("bit"))
    return spread.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bitmap"))


def maybe_wanted(rows: DataFrame, bitmaps: DataFrame, keys: list[str], bits: int = BITS) -> DataFrame:
    """Rows that the filter lets through: all whose keys are in it, and a few more."""
    probed = rows.withColumn("__bucket", _bucket(keys, bits)).join(F.broadcast(bitmaps.withColumnRenamed("bucket", "__bucket").withColumnRenamed("bitmap", "__bitmap")), "__bucket")

    def is_set(position: Column) -> Column:
        byte = F.conv(F.hex(F.substring(F.col("__bitmap"), F.floor(position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        return F.call_function("getbit", byte, position % 8) == 1

    return probed.filter(reduce(Column.__and__, map(is_set, _positions(keys)))).drop("__bucket", "__bitmap")


def narrowed(rows: DataFrame, wanted: DataFrame, keys: list[str], limit: int = BROADCAST_KEYS, bits: int = BITS) -> DataFrame:
    """The rows whose ``keys`` are among the written table ``wanted``, and beyond ``limit`` wanted ones a few more. Null keys are not wanted."""
    wanted = wanted.select(*keys)
    if wanted.limit(limit + 1).count() <= limit:
        return rows.join(F.broadcast(wanted), keys, "left_semi")
    there = reduce(Column.__and__, (F.col(k).isNotNull() for k in keys))
    return maybe_wanted(rows.filter(there), bloom_filter(wanted.filter(there), keys, bits), keys, bits)
