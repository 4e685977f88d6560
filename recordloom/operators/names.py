"""Names free of collisions inside each folder, as if records were placed one after another, in no task's turn.

The first of equal names keeps it where it is free, the others take the next free numbers. Where no number
can meet a name that another record wants or the target has, a record's number is its rank among equal names.
Elsewhere a wanted or existing ``x (5)`` is a claim on number 5 of ``x``. It stands unless the records that
want ``x`` have got that far before. With s claims on smaller numbers standing, number k is reached by the
(k - s)-th of them, so a claim made after r of them stands if s < k - r. Claims are dealt out in chunks by
number; a chunk is a function of the s it meets, s + the number of its stops that are not below s, and its
sorted stops are all that the next chunk needs. Numbers then follow from one sort: a standing claim on k
lies after the first k - 1 - s records, and a record's number is its place among records and standing claims.
Who loses a claim is one more for the name claimed, so names are settled by how many numbers they end in.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.functions.columns import file_name, numbered_name, parent, stem, suffix
from recordloom.operators.ordering import numbered, ranked
from recordloom.operators.storage import materialize

#: Rows of the sorted plan in which equal names are ranked by one task, and numbers of a name whose claims one task weighs.
RUN, CHUNK = 1 << 20, 1 << 14
_LONGS = T.ArrayType(T.LongType())
_NUMBER = r" \(([1-9][0-9]{0,17})\)\z"
_NUMBERS = r"((?: \([1-9][0-9]{0,17}\))+)\z"


def claim_of(name: Column) -> tuple[Column, Column]:
    """(base, number) of a name that is a numbered form of another; nulls otherwise."""
    own = stem(name)
    number = F.regexp_extract(own, _NUMBER, 1).try_cast("long")
    base = F.concat(F.regexp_replace(own, _NUMBER, ""), suffix(name))
    return F.when(number.isNotNull() & (numbered_name(base, number) == name), base), number


def stops(limits: list[int]) -> list[int]:
    """Sorted values v such that of claims with these limits one more stands if v claims stand before than if v + 1 do."""
    held: list[int] = []
    for limit in limits:
        nth = limit - len(held)  # the nth of 0, 1, 2, ... that is not held joins it
        if nth > 0:
            at = bisect_left(range(len(held)), nth, key=lambda i: held[i] - i)
            held.insert(at, nth - 1 + at)
    return held


def standing(limits: list[int], before: int) -> list[int]:
    """For each claim how many stand before it, or -1 if it doesn't stand."""
    out = []
    for limit in limits:
        out.append(before if before < limit else -1)
        before += before < limit
    return out


@F.pandas_udf(_LONGS)
def _stops(limits: pd.Series) -> pd.Series:
    return limits.map(lambda own: stops(own.tolist()))


@F.pandas_udf(_LONGS)
def _standing(limits: pd.Series, before: pd.Series) -> pd.Series:
    return pd.Series([standing(own.tolist(), s) for own, s in zip(limits, before, strict=True)])


def _carried(keys: list[str]):
    """A function over batches of chunks sorted by keys and chunk: how many claims stand before each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, before = None, 0
        for batch in batches:
            out = []
            for key, held in zip(zip(*(batch[k] for k in keys), strict=True), batch["__stops"], strict=True):
                if key != last:
                    last, before = key, 0
                out.append(before)
                before += len(held) - bisect_left(held, before)
            yield batch[[*keys, "__chunk"]].assign(__before=out)

    return run


def _settled(asked: DataFrame, claims: DataFrame, keys: list[str], chunk: int) -> tuple[DataFrame, DataFrame]:
    """(seq, number) of the records that don't get the very name they want, and the claims that don't stand.

    ``asked`` has the records that want a name on which there are claims, with ``__give``: 0 for the one that gets
    it, 1, 2, ... in order for the others; ``claims`` has ``__number``, ``__child``, ``__first`` (when) and ``__taken``.
    """
    events = asked.select(*keys, F.col("seq").alias("__time")).unionByName(claims.withColumnRenamed("__first", "__time"), allowMissingColumns=True)
    events = ranked(events, keys, [F.col("__time"), F.col("__number")], "__position").filter("__number is not null")
    met = ranked(events, keys, [F.col("__position")], "__place")
    reached = F.greatest(F.col("__position") - F.col("__place") + F.col("__taken") - 1, F.lit(0))
    weighed = met.withColumn("__limit", F.col("__number") - reached)
    weighed = weighed.withColumn("__chunk", F.expr(f"__number div {chunk}"))  # numbers differ, so a chunk has at most this many claims
    held = weighed.groupBy(*keys, "__chunk").agg(F.array_sort(F.collect_list(F.struct("__number", "__limit", "__child"))).alias("__held"))
    held = materialize(held, "claims-by-chunk")
    limits = F.transform("__held", lambda c: c["__limit"])
    stopped = held.select(*keys, "__chunk", _stops(limits).alias("__stops")).repartition(*keys).sortWithinPartitions(*keys, "__chunk")
    types = dict(held.dtypes)
    carried = stopped.mapInPandas(_carried(keys), ", ".join(f"`{k}` {types[k]}" for k in [*keys, "__chunk"]) + ", __before long")
    judged = held.join(materialize(carried, "claims-before"), [*keys, "__chunk"]).withColumn("__s", _standing(limits, F.col("__before")))
    judged = materialize(judged.select(*keys, F.inline(F.arrays_zip("__held", "__s"))).select(*keys, "__held.*", "__s"), "claims-judged")
    kept = judged.filter("__s >= 0").select(*keys, (F.col("__number") - 1 - F.col("__s")).alias("__give"), F.lit(1).alias("__kind"))
    both = asked.filter("__give > 0").withColumn("__kind", F.lit(0)).unionByName(kept, allowMissingColumns=True)
    placed = ranked(both, keys, [F.col("__give"), F.col("__kind")], "__given").filter("seq is not null")
    return materialize(placed.select("seq", "__given"), "given-numbers"), judged.filter("__s < 0")


def free_names(rows: DataFrame, folder: str, name: str, order: list[Column], existing: DataFrame | None, chunk: int = CHUNK) -> DataFrame:
    """Add ``seq`` and ``destination_path``: names free of collisions inside each folder, as if placed one after another in ``order``.

    ``existing`` (full_path) is what the target has. Ranks come from the one range sort that numbers the rows:
    equal names are counted by runs of RUN rows of it, and only rows of one run are ranked in one task. Claims
    on numbers are settled in as many rounds as names end in numbers, whatever the number of records; the
    largest share of a round that one task sees is a chunk of claims, and the stops of one name's chunks in turn.
    """
    keys = [folder, name]
    placed = numbered(rows, order).withColumn("__run", F.floor(F.col("seq") / RUN))
    runs = placed.groupBy(*keys, "__run").agg(F.count("*").alias("__n"), F.min("seq").alias("__first"))
    earlier = Window.partitionBy(*keys).orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)
    runs = materialize(runs.select(*keys, "__run", "__first", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before")), "name-runs")
    within = F.row_number().over(Window.partitionBy(*keys, "__run").orderBy("seq")) - 1
    wants = placed.withColumn("__rank", within).join(runs.drop("__first"), [*keys, "__run"])
    wants = wants.withColumn("__rank", F.col("__rank") + F.col("__before")).drop("__run", "__before")
    names = runs.groupBy(*keys).agg(F.min("__first").alias("__first"))
    wanted, taken = names.select(*keys), None
    if existing is not None:
        there = existing.select(parent(F.col("full_path")).alias(folder), file_name(F.col("full_path")).alias(name)).distinct()
        names = names.unionByName(there.withColumn("__first", F.lit(0).cast("long"))).groupBy(*keys).agg(F.min("__first").alias("__first"))
        taken = materialize(there.join(wanted, keys, "left_semi").withColumn("__taken", F.lit(1)), "taken-names")
    base, number = claim_of(F.col(name))
    claims = names.select(folder, base.alias("__base"), number.alias("__number"), F.col(name).alias("__child"), "__first").filter("__base is not null")
    claims = claims.withColumnRenamed("__base", name).join(wanted, keys, "left_semi")
    depth = F.regexp_count(F.regexp_extract(stem(F.col(name)), _NUMBERS, 1), F.lit(r" \("))
    claims = materialize(claims.withColumn("__depth", depth), "claims")
    depths = sorted(r["__depth"] for r in claims.select("__depth").distinct().collect())  # few, names being short

    def with_taken(some: DataFrame) -> DataFrame:
        if taken is None:
            return some.withColumn("__taken", F.lit(0))
        return some.join(taken, keys, "left").withColumn("__taken", F.coalesce("__taken", F.lit(0)))

    given = None
    for d in depths:
        here = claims.filter(F.col("__depth") == d).drop("__depth")
        asked = wants.select(*keys, "seq", "__rank").join(here.select(*keys).distinct(), keys, "left_semi")
        asked = materialize(with_taken(asked).select(*keys, "seq", (F.col("__rank") + F.col("__taken")).alias("__give")), "asked")
        own, lost = _settled(asked, with_taken(here), keys, chunk)
        lost = lost.select(folder, F.col("__child").alias(name), F.lit(1).alias("__taken"))
        given = own if given is None else given.unionByName(own)
        taken = materialize(lost if taken is None else taken.unionByName(lost), "taken-names")
    out = with_taken(wants).withColumn("__number", F.col("__rank") + F.col("__taken"))
    if given is not None:
        out = out.join(given, "seq", "left").withColumn("__number", F.coalesce("__given", "__number")).drop("__given")
    place = F.concat_ws("/", folder, numbered_name(F.col(name), F.col("__number")))
    return out.withColumn("destination_path", place).drop("__rank", "__taken", "__number")
