"""Exact duplicates, cheapest key first: size, partial signature, SHA-256, bytes.

Records of a table: one pass over content computes both digests of the rows whose size another
row has, where they lie; content is not shuffled, and only keys and paths are grouped. Files: the
listing decides on sizes, then slices of the rows left are read, then whole files of what is left
after that. A group of any size is counted from partial sums; its members join back on tables that
Spark can split by a hot key, and are ranked by a range sort, so no group has to fit one task.
Only the optional verification of bytes shuffles content, of rows that share a digest: others are left
where they lie by ``narrow``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.functions.fingerprints import quick_signature, sha256
from recordloom.operators.narrow import BROADCAST_KEYS, narrowed
from recordloom.operators.ordering import ranked
from recordloom.operators.reuse import known_versions, remember, with_fingerprints
from recordloom.operators.storage import materialize
from recordloom.sources.files import file_digests, file_signatures

#: Sizes that several records have, up to which their list is broadcast (8 bytes each); beyond it a Bloom filter narrows.
BROADCAST_SIZES = 500_000


def member_order() -> list:
    """The oldest copy first; the path decides between equals."""
    return [F.col("last_write_utc"), F.lower("full_path"), F.col("full_path")]


def _sharing(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys another row has too."""
    shared = rows.groupBy(*keys).agg(F.count("*").alias("__n")).filter("__n > 1").drop("__n")
    return rows.join(materialize(shared, "shared-keys"), keys, "left_semi")


def size_collisions(inventory: DataFrame) -> DataFrame:
    """(size_bytes, n) of sizes that several records have."""
    return inventory.groupBy("size_bytes").agg(F.count("*").alias("n")).filter("n > 1")


def colliding(inventory: DataFrame, limit: int = BROADCAST_SIZES) -> DataFrame:
    """Rows whose size another row has (and beyond ``limit`` such sizes a few more), with no exchange of the rows."""
    sizes = materialize(size_collisions(inventory).select("size_bytes"), "sizes")
    return narrowed(inventory, sizes, ["size_bytes"], limit)


def digests(inventory: DataFrame) -> DataFrame:
    """The rows whose size another row has, with ``quick_signature`` and ``sha256_hash`` in place of content, kept as a table."""
    hashed = colliding(inventory).withColumn("quick_signature", quick_signature(F.col("content"))).withColumn("sha256_hash", sha256(F.col("content")))
    return materialize(hashed.drop("content"), "digests")


def reused_digests(inventory: DataFrame, store: str, refresh: bool = False) -> DataFrame:
    """``digests`` with a store of earlier runs: content is read of rows alone whose version it does not hold. What was used or computed is remembered.

    There is no partial signature to reuse, and none is needed beside a digest that is known.
    """
    spark = inventory.sparkSession
    rows = colliding(inventory)
    known = materialize(known_versions(spark, store, rows.drop("content")), "known")
    found = materialize(with_fingerprints(rows, known, sha256, refresh).withColumn("quick_signature", F.lit("")).withColumnRenamed("sha256", "sha256_hash"), "digests")
    remember(found.withColumnRenamed("sha256_hash", "sha256"), store, F.current_timestamp())
    return found.drop("mtime_us")


def hashed_candidates(inventory: DataFrame, store: str | None = None, refresh: bool = False) -> DataFrame:
    """Rows that share size, partial signature and digest with another row; a ``store`` (a folder) keeps digests from run to run."""
    hashed = digests(inventory) if store is None else reused_digests(inventory, store, refresh).drop("reused")
    return _sharing(hashed, ["size_bytes", "quick_signature", "sha256_hash"])


def hashed_file_candidates(listed: DataFrame, root: str) -> DataFrame:
    """The same for a listing of files without content: each step reads only what the one before left."""
    same_size = materialize(_sharing(listed.filter("error is null"), ["size_bytes"]), "same-size")
    signed = materialize(file_signatures(same_size, root), "signatures").filter("read_error is null").drop("read_error")
    same_slices = materialize(_sharing(signed, ["size_bytes", "quick_signature"]), "same-slices")
    hashed = materialize(file_digests(same_slices, root), "digests").filter("read_error is null").drop("read_error")
    return _sharing(hashed, ["size_bytes", "quick_signature", "sha256_hash"])


def quick_collisions(inventory: DataFrame) -> DataFrame:
    """(size_bytes, n) for each partial signature that several records of a size share; the signature stays internal."""
    rows = colliding(inventory).select("size_bytes", quick_signature(F.col("content")).alias("quick"))
    return rows.groupBy("size_bytes", "quick").agg(F.count("*").alias("n")).filter("n > 1").drop("quick")


def sha_collisions(inventory: DataFrame) -> DataFrame:
    """(size_bytes, sha256_hash, n) for each digest that several records share; only records whose size another has are hashed."""
    rows = colliding(inventory).select("size_bytes", quick_signature(F.col("content")).alias("quick"), sha256(F.col("content")).alias("sha256_hash"))
    return rows.groupBy("size_bytes", "quick", "sha256_hash").agg(F.count("*").alias("n")).filter("n > 1").drop("quick")


def sharing_content(inventory: DataFrame, shared: DataFrame, limit: int = BROADCAST_KEYS) -> DataFrame:
    """full_path, size_bytes, content, sha256_hash of the rows in ``shared`` (full_path, sha256_hash)."""
    rows = inventory.select("full_path", "size_bytes", "content")
    return narrowed(rows, shared, ["full_path"], limit).join(shared, "full_path")


def byte_verified(inventory: DataFrame) -> DataFrame:
    """Rows with a byte-identical copy: full_path, size_bytes, sha256_hash, class_size.

    Every row that shares a digest is compared with one row of that digest. Content is a grouping key only for rows that
    differ from it, which equal digests all but rule out. Content of rows that share no digest is read where it lies, and
    goes no further.
    """
    shared = materialize(hashed_candidates(inventory).select("full_path", "sha256_hash"), "same-digest")
    rows = sharing_content(inventory, shared)
    least = materialize(shared.groupBy("sha256_hash").agg(F.min("full_path").alias("full_path")), "models")
    model = sharing_content(inventory, least).select("sha256_hash", F.col("content").alias("model"))
    compared = rows.join(model, "sha256_hash").withColumn("own", F.when(F.col("content") != F.col("model"), F.col("content")))
    compared = materialize(compared.select("full_path", "size_bytes", "sha256_hash", "own"), "compared")
    same = compared.filter("own is null").drop("own")
    sizes = materialize(same.groupBy("sha256_hash").agg(F.count("*").alias("class_size")).filter("class_size > 1"), "classes")
    out = ["full_path", "size_bytes", "sha256_hash", "class_size"]
    found = same.join(sizes, "sha256_hash").select(*out)
    other = compared.filter("own is not null")
    if other.isEmpty():
        return found
    more = other.groupBy("sha256_hash", "own").agg(F.count("*").alias("class_size")).filter("class_size > 1")
    return found.unionByName(other.join(materialize(more, "more-classes"), ["sha256_hash", "own"]).select(*out))


def _members(candidates: DataFrame) -> DataFrame:
    rows = candidates.select("sha256_hash", "size_bytes", "full_path", "last_write_utc")
    placed = ranked(rows, ["sha256_hash", "size_bytes"], member_order(), "group_rank", "group_size")
    return placed.select("sha256_hash", "size_bytes", "full_path", "last_write_utc", "group_size", F.col("group_rank").cast("int").alias("group_rank"))


def duplicate_members(inventory: DataFrame, store: str | None = None, refresh: bool = False) -> DataFrame:
    """One row per member of a group: sha256_hash, size_bytes, full_path, last_write_utc, group_size, group_rank."""
    return _members(hashed_candidates(inventory, store, refresh))


def duplicate_file_members(listed: DataFrame, root: str) -> DataFrame:
    """``duplicate_members`` of a listing that ``inventory_from_files`` made of ``root``; files that cannot be read are left out."""
    return _members(hashed_file_candidates(listed, root))


def duplicate_groups(inventory: DataFrame) -> DataFrame:
    """One row per group with its members in order, largest group first: for groups that fit a row. The flat form suits any size."""
    member = F.struct("last_write_utc", F.lower("full_path").alias("lower_path"), "full_path", "extension", "category")
    groups = hashed_candidates(inventory).groupBy("sha256_hash", "size_bytes").agg(F.array_sort(F.collect_list(member)).alias("files"))
    return group_order(groups.withColumn("n", F.size("files").cast("long")))


def group_summary(members: DataFrame) -> DataFrame:
    """(sha256_hash, size_bytes, n, first_path) from the flat members."""
    return members.groupBy("sha256_hash", "size_bytes").agg(F.count("*").alias("n"), F.max(F.when(F.col("group_rank") == 1, F.col("full_path"))).alias("first_path"))


def group_order(groups: DataFrame) -> DataFrame:
    return groups.orderBy(F.desc("n"), F.desc("size_bytes"), "sha256_hash")


def top_groups(members: DataFrame, k: int = 10) -> DataFrame:
    return group_order(group_summary(members)).limit(k)


def dedupe_summary(members: DataFrame) -> DataFrame:
    groups = members.groupBy("sha256_hash", "size_bytes").agg(F.count("*").alias("n"))
    removable = F.col("n") - 1
    return groups.agg(
        F.count("*").alias("duplicate_group_count"),
        F.coalesce(F.sum(removable), F.lit(0)).alias("duplicate_files_found"),
        F.coalesce(F.sum(F.col("size_bytes") * removable), F.lit(0)).alias("duplicate_bytes_reclaimable"),
    )
