"""The record inventory: one row per content-bearing record of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.functions.columns import classify, extension, file_name
from recordloom.functions.filters import ScanFilter

COLUMNS = ["full_path", "extension", "size_bytes", "last_write_utc", "category"]
SCHEMA = "full_path string, extension string, size_bytes long, last_write_utc timestamp, category string"
#: Directories that hold a run's own state; a scan never enters them, whatever their case.
RESERVED_DIRECTORIES = (".recordloom", ".recordloom_quarantine", "duplicates_quarantine")


def inventory_from_table(df: DataFrame, path: Column, content: Column, mtime: Column, *extra: Column) -> DataFrame:
    """Inventory of records whose content is in a table; the content column follows, and is read only where it is used."""
    rows = df.select(path.alias("full_path"), F.octet_length(content).cast("long").alias("size_bytes"), mtime.cast("timestamp").alias("last_write_utc"), content.alias("content"), *extra)
    rows = rows.withColumn("extension", extension(F.col("full_path")))
    rows = rows.withColumn("category", classify(F.col("extension")))
    return rows.select(*COLUMNS, *(c for c in rows.columns if c not in COLUMNS))


def outside_reserved(names: tuple[str, ...] = RESERVED_DIRECTORIES) -> Column:
    """Whether no directory of ``full_path`` is reserved."""
    segments = F.split("full_path", "/")
    directories = F.slice(segments, 1, F.greatest(F.size(segments) - 1, F.lit(0)))
    return ~F.exists(directories, lambda d: F.lower(d).isin(*(n.lower() for n in names)))


def scan(inventory: DataFrame, options: ScanFilter | None = None, reserved: tuple[str, ...] = RESERVED_DIRECTORIES) -> DataFrame:
    """Accepted rows."""
    accepted = (options or ScanFilter()).predicate() & outside_reserved(reserved)
    return inventory.filter(accepted & F.col("error").isNull() if "error" in inventory.columns else accepted)


def rejected_rows(inventory: DataFrame, options: ScanFilter | None = None, reserved: tuple[str, ...] = RESERVED_DIRECTORIES) -> DataFrame:
    """full_path, reject_reason, error of the rows that a scan leaves out; rows in reserved directories were never met."""
    error = F.col("error") if "error" in inventory.columns else F.lit(None).cast("string")
    reason = F.when(error.isNotNull(), F.lit("unreadable")).otherwise((options or ScanFilter()).reject_reason())
    met = inventory.filter(outside_reserved(reserved))
    return met.select("full_path", reason.alias("reject_reason"), error.alias("error")).filter("reject_reason is not null")


def scan_order(inventory: DataFrame) -> DataFrame:
    """Category, then time, then path without case; the exact path decides between equals."""
    return inventory.orderBy("category", "last_write_utc", F.lower("full_path"), "full_path")


def scan_summary(inventory: DataFrame) -> DataFrame:
    return inventory.agg(F.count("*").alias("total_files_scanned"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total_bytes_scanned"))
