"""Counts of a corpus for its documents: the frequent ones are broadcast, only the rest is joined.

At most FREQUENT rows are frequent, whatever the corpus: that is the proven size of what is
broadcast. Most of a text's tokens are among them, so what is left for the join are rare keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Counts broadcast at most.
FREQUENT = 1 << 18


def split(counts: DataFrame, limit: int = FREQUENT) -> tuple[DataFrame, DataFrame]:
    """(frequent, rare) rows of ``counts`` (n): the largest, at most ``limit``, and the others.

    Both are told apart by one least count, found in a histogram of eighths of powers of two, of which
    a few hundred rows at most reach the driver.
    """
    level = F.when(F.col("n") > 0, F.floor(8 * F.log2("n"))).otherwise(-1)
    sizes = counts.groupBy(level.alias("level")).agg(F.count("*").alias("rows"), F.min("n").alias("least")).collect()
    held, least = 0, None
    for r in sorted(sizes, key=lambda r: -r["level"]):
        held += r["rows"]
        if held > limit:
            break
        least = r["least"]
    often = F.lit(False) if least is None else F.col("n") >= least
    return counts.filter(often), counts.filter(~often)
