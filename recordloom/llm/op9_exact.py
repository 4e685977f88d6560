"""Exact deduplication by deterministic block naming.

Every text is cut into fixed-size blocks of bytes. Equal blocks get one integer name by
sorting, then adjacent names are paired and the pairs are named in turn, until one name is
left for each document. Two documents share (levels, name) exactly when their bytes are equal.

Blocks are sorted by (hash, bytes): the hash decides unless two blocks share it, and such
blocks (found by counting the distinct blocks of each hash) are ranked by their bytes. So only
the step that finds distinct blocks shuffles text, pre-aggregated in each task, and names join
on the 8-byte hash. Names don't rely on hashes being free of collisions; rows that repeat a doc_id are told
apart by their SHA-256.

Nulls: a null text is empty; a null doc_id is an id like any other (it never beats another id).
An empty text is one empty block, a very long one as many blocks as it has, each a row. Repeated
rows (same doc_id, same text) all come back, with the same decision; ``kept_documents`` leaves one
of them. Of ties (equal texts with the largest id) all rows of that id stay in the decisions. Other
columns are ignored, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recordloom.operators.storage import materialize

BLOCK_BYTES = 4096
#: Names are bucket * 2**40 + rank in the bucket; buckets keep the sort of names spread out.
BUCKETS = 1 << 16


def _sha256(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def fresh_names(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until ``df`` has no such columns."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def _ranked(keys: DataFrame, columns: list[str]) -> DataFrame:
    """Add ``name``: a distinct positive integer for each row of the distinct ``keys``, by sorting inside buckets."""
    keys = keys.withColumn("bucket", F.pmod(F.xxhash64(*columns), F.lit(BUCKETS)))
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy(*columns))
    return keys.select(*columns, (F.col("bucket") * F.lit(1 << 40) + rank).alias("name"))


def _blocks(docs: DataFrame, block_bytes: int, block_hash: Callable[[Column], Column]) -> DataFrame:
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    docs = docs.select("doc_id", data.alias("data"))
    docs = docs.select("doc_id", "data", F.sha2("data", 256).alias("text_sha256"))
    last = F.greatest(F.floor((F.octet_length("data") - 1) / block_bytes), F.lit(0)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(F.col("data"), i * block_bytes + 1, F.lit(block_bytes)))
    rows = docs.select("doc_id", "text_sha256", last.alias("last"), F.posexplode(cut).alias("pos", "block"))
    return rows.withColumn("h", block_hash(F.col("block")))


def block_identities(
    docs: DataFrame,
    block_bytes: int = BLOCK_BYTES,
    block_hash: Callable[[Column], Column] = F.xxhash64,
) -> DataFrame:
    """(doc_id, text_sha256, copies, levels, name) for each distinct (doc_id, text); copies counts its rows."""
    blocks = _blocks(docs, block_bytes, block_hash)
    distinct = materialize(blocks.groupBy("h", "block").count().groupBy("h").agg(F.count("*").alias("n")), "block-hashes")
    shared = distinct.filter("n > 1").select("h")
    rows = blocks.groupBy("doc_id", "text_sha256", "last", "pos", "h")
    if shared.isEmpty():
        keys = ["h"]
        named = _ranked(distinct.select("h"), keys)
        rows = rows.agg(F.count("*").alias("copies"))
    else:  # tell blocks that share a hash apart by their bytes
        clashing = blocks.join(shared, "h", "left_semi").select("h", "block").distinct()
        order = F.row_number().over(Window.partitionBy("h").orderBy("block"))
        order = materialize(clashing.select("h", "block", order.alias("rank")), "block-ranks")
        blocks = blocks.join(order, ["h", "block"], "left").withColumn("rank", F.coalesce("rank", F.lit(0)))
        keys = ["h", "rank"]
        whole = distinct.filter("n = 1").select("h", F.lit(0).alias("rank")).unionByName(order.select("h", "rank"))
        named = _ranked(whole, keys)
        rows = blocks.groupBy("doc_id", "text_sha256", "last", "pos", "h", "rank").agg(F.count("*").alias("copies"))
    rows = materialize(rows, "block-rows")
    named = materialize(named, "block-names")
    level = materialize(rows.join(named, keys).select("doc_id", "text_sha256", "copies", "last", "pos", "name"), "level-0")
    levels, done = 0, []
    while True:
        done.append(level.filter("last = 0").select("doc_id", "text_sha256", "copies", F.lit(levels).alias("levels"), "name"))
        level = level.filter("last > 0")
        if level.isEmpty():
            break
        levels += 1
        half = F.shiftright("pos", 1)
        pairs = level.groupBy("doc_id", "text_sha256", "copies", F.shiftright("last", 1).alias("last"), half.alias("pos")).agg(
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"),
            F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(0)).alias("b"),
        )
        pairs = materialize(pairs, f"pairs-{levels}")
        named = materialize(_ranked(pairs.select("a", "b").distinct(), ["a", "b"]), f"names-{levels}")
        level = materialize(pairs.join(named, ["a", "b"]).drop("a", "b"), f"level-{levels}")
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return materialize(out, "identities")


def exact_groups(docs: DataFrame, **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    The largest doc_id of equal texts stays. A group of any size is counted from partial sums,
    and its decision joins back on a table that Spark can split by a hot key. So does the decision
    on rows that repeat both id and text, if there are any.
    """
    names = block_identities(docs, **options)
    groups = names.groupBy("levels", "name").agg(F.max("doc_id").alias("keep_id"), F.sum("copies").alias("group_size"))
    out = names.join(materialize(groups, "groups"), ["levels", "name"])
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    decided = materialize(out.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256", "copies"), "decided")
    once, repeated = decided.filter("copies = 1").drop("copies"), decided.filter("copies > 1").drop("copies")
    if repeated.isEmpty():
        return once
    rows = docs.select(F.col("doc_id").alias("own_id"), _sha256(F.col("text")).alias("own_sha256"))
    again = rows.join(repeated, F.col("own_id").eqNullSafe(F.col("doc_id")) & (F.col("own_sha256") == F.col("text_sha256")))
    return once.unionByName(again.drop("own_id", "own_sha256"))


def kept_documents(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without exact copies, one row for each distinct text, all columns kept.

    The ids to keep grow with the corpus and are never broadcast. Only rows that repeat both id
    and text, if there are any, are shuffled once more to leave one of them.
    """
    names = block_identities(docs, **options)
    groups = materialize(names.groupBy("levels", "name").agg(F.max("doc_id").alias("keep_id")), "groups")
    kept = names.join(groups, ["levels", "name"]).filter(F.col("doc_id").eqNullSafe(F.col("keep_id")))
    own_id, own_sha, kept_sha, more = fresh_names(docs, "id", "sha", "kept_sha", "more")
    kept = materialize(kept.select(F.col("doc_id").alias(own_id), F.col("text_sha256").alias(kept_sha), (F.col("copies") > 1).alias(more)), "kept")
    rows = docs.withColumn(own_sha, _sha256(F.col("text")))

    def among(ids: DataFrame) -> DataFrame:
        same = F.col("doc_id").eqNullSafe(F.col(own_id)) & (F.col(own_sha) == F.col(kept_sha))
        return rows.join(ids.hint("merge"), same, "left_semi")

    repeated = kept.filter(more)
    if repeated.isEmpty():
        return among(kept).drop(own_sha)
    once = among(repeated).dropDuplicates(["doc_id", own_sha])
    return among(kept.filter(f"not {more}")).unionAll(once).drop(own_sha)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP9_SQL = """
with d as (select doc_id, coalesce(text, '') as t from documents),
g as (select t, max(doc_id) as keep_id, count(*) as group_size from d group by t)
select d.doc_id, g.keep_id, cast(g.group_size as bigint) as group_size, d.doc_id = g.keep_id as kept,
       sha256(d.t) as text_sha256
from d join g on d.t = g.t
"""
