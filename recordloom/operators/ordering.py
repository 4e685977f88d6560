"""Row numbers over a whole table without gathering it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.operators.storage import materialize

#: Parts into which a range of values is cut, and values of it that reach the driver at most.
RANGES, HELD = 1024, 10_000


def numbered(rows: DataFrame, order: list[Column], name: str = "seq") -> DataFrame:
    """Add ``name``: 1, 2, ... in order. A range sort spreads any key over tasks; one count a partition reaches the driver."""
    spark = rows.sparkSession
    ordered = rows.orderBy(*order).withColumn("__part", F.spark_partition_id()).withColumn("__row", F.monotonically_increasing_id())
    ordered = materialize(ordered, "ordered")
    sizes = ordered.groupBy("__part").agg(F.count("*").alias("n"), F.min("__row").alias("first")).orderBy("__part").collect()
    begins, total = [], 0
    for r in sizes:
        begins.append((r["__part"], r["first"], total))
        total += r["n"]
    begun = spark.createDataFrame(begins, "__part int, __first long, __before long")
    out = ordered.join(F.broadcast(begun), "__part")  # one row a partition
    return out.withColumn(name, F.col("__row") - F.col("__first") + F.col("__before") + 1).drop("__part", "__row", "__first", "__before")


def ranked(rows: DataFrame, keys: list[str], order: list[Column], name: str, size: str | None = None) -> DataFrame:
    """Add ``name``: 1, 2, ... in order within equal ``keys``, and their number as ``size``.

    A range sort deals out a hot key's rows, and one row a key is joined back on tables that Spark can split.
    """
    placed = numbered(rows, [*map(F.col, keys), *order], "__at")
    groups = placed.groupBy(*keys).agg(F.min("__at").alias("__first"), F.count("*").alias(size or "__size"))
    out = placed.join(materialize(groups, "groups"), keys).withColumn(name, F.col("__at") - F.col("__first") + 1)
    return out.drop("__at", "__first", "__size")


#: What a quantile sketch may be off by, as a share of all rows; a selection sorts about this share twice.
SKETCH_ERROR = 1 / 2000


def largest(rows: DataFrame, limit: int, value: Column, ties: list[Column]) -> DataFrame:
    """The ``limit`` rows of largest ``value`` (a long; null is smallest), the first in order of ``ties`` among equals.

    A quantile sketch brackets the last value to keep, an exact count says how many rows lie above the
    bracket and in it, and only rows of the bracket are sorted, by a range sort. Should the bracket
    miss, it is widened, at last to everything. No task holds the selection, whatever its size, and one
    value may be that of any share of the rows.
    """
    if limit <= 0:
        return rows.limit(0)
    held = materialize(rows.withColumn("__value", F.coalesce(value.cast("long"), F.lit(-(1 << 63)))), "selection")
    total = held.count()
    if limit >= total:
        return held.drop("__value")
    margin = SKETCH_ERROR
    while True:
        at = 1 - limit / total
        ends = [max(at - 2 * margin, 0.0), min(at + 2 * margin, 1.0)]
        low, high = held.agg(F.percentile_approx("__value", ends, F.lit(round(1 / SKETCH_ERROR))).alias("ends")).first()["ends"]
        if ends[0] == 0.0:
            low = -(1 << 63)
        if ends[1] == 1.0:
            high = (1 << 63) - 1
        over, inside = held.agg(F.count_if(F.col("__value") > high), F.count_if(F.col("__value").between(low, high))).first()
        if over <= limit <= over + inside:
            break
        margin *= 8
    above = held.filter(F.col("__value") > high)
    within = numbered(held.filter(F.col("__value").between(low, high)), [F.desc("__value"), *ties], "__place")
    return above.unionByName(within.filter(F.col("__place") <= limit - over).drop("__place")).drop("__value")


def percentile(rows: DataFrame, name: str, share: float, held: int = HELD) -> float | None:
    """The exact percentile of a column of written ``rows``, as Spark's ``percentile`` gives it, but no task holds all values.

    The range in which the wanted place lies is cut into RANGES equal parts, which are counted, until at most ``held`` values are in it.
    """
    values = rows.select(F.col(name).cast("double").alias("v")).filter("v is not null")
    inside, low, high = values.agg(F.count("*"), F.min("v"), F.max("v")).first()
    if not inside:
        return None
    at = share * (inside - 1)
    k, below = int(at), 0
    while inside > held and low < high and (step := (high - low) / RANGES) > 0:
        part = F.least(F.floor((F.col("v") - low) / step), F.lit(RANGES - 1))
        parts = values.filter(F.col("v").between(low, high)).groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect()
        for r in sorted(parts, key=lambda r: r["part"]):
            if below + r["n"] > k:
                inside, low, high = r["n"], r["low"], r["high"]
                break
            below += r["n"]
    # equal values are one row here
    found = values.filter(F.col("v").between(low, high)).groupBy("v").agg(F.count("*").alias("n")).orderBy("v").collect()
    own = None
    for r in found:
        below += r["n"]
        if own is None and below > k:
            own = r["v"]
        if below > k + 1:
            return own if own == r["v"] else (k + 1 - at) * own + (at - k) * r["v"]
    after = values.filter(F.col("v") > high).agg(F.min("v")).first()[0]
    return own if after is None else (k + 1 - at) * own + (at - k) * after
