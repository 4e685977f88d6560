"""Which copies to keep, and where everything should go: plans as tables, nothing written."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.functions.columns import destination_folder, file_name, format_size, parent, relative_path
from recordloom.operators.dedupe import member_order
from recordloom.operators.names import free_names
from recordloom.operators.ordering import numbered
from recordloom.operators.storage import materialize

DEDUPE_MODES = ("off", "quarantine", "delete")
ORGANIZE_MODES = {"copy": "copied", "move": "moved"}
SCOPES = {"group_and_dedupe": (True, True), "group_only": (True, False), "dedupe_only": (False, True)}
PLAN = "seq long, action string, source_path string, destination_path string, reversible boolean"


def _one_of(value: str, known) -> str:
    if value not in known:
        raise ValueError(f"{value!r} is none of {', '.join(known)}")
    return value


def keepers(members: DataFrame, protected: DataFrame | None = None) -> DataFrame:
    """Members with ``is_protected`` and ``keep``: every protected member of a group, or else its oldest.

    ``protected`` has a ``full_path`` column; paths are compared exactly.
    """
    if protected is None:
        flagged = members.withColumn("is_protected", F.lit(False))
    else:
        marks = protected.select("full_path").distinct().withColumn("is_protected", F.lit(True))
        flagged = members.join(marks, "full_path", "left").withColumn("is_protected", F.coalesce("is_protected", F.lit(False)))
    counted = flagged.groupBy("sha256_hash", "size_bytes").agg(F.max("is_protected").alias("any_protected"))
    flagged = flagged.join(materialize(counted, "protected-groups"), ["sha256_hash", "size_bytes"])
    return flagged.withColumn("keep", F.when(F.col("any_protected"), F.col("is_protected")).otherwise(F.col("group_rank") == 1)).drop("any_protected")


def removals(members: DataFrame, protected: DataFrame | None = None) -> DataFrame:
    return keepers(members, protected).filter(~F.col("keep"))


def survivors(inventory: DataFrame, removed: DataFrame) -> DataFrame:
    """The inventory without the removed paths, whether or not their removal succeeded."""
    return inventory.join(removed.select("full_path"), "full_path", "left_anti")


def still_there(planned: DataFrame, current: DataFrame, path: str = "source_path") -> tuple[DataFrame, DataFrame]:
    """Planned rows whose record still exists, and those to skip."""
    there = current.select(F.col("full_path").alias(path))
    return planned.join(there, path, "left_semi"), planned.join(there, path, "left_anti")


def dedupe_plan(members: DataFrame, mode: str, source_root: str, quarantine_root: str = "/quarantine", protected: DataFrame | None = None) -> DataFrame:
    """Removals of a mode as plan rows, in the order of groups and members."""
    _one_of(mode, DEDUPE_MODES)
    spark = members.sparkSession
    if mode == "off":
        return spark.createDataFrame([], PLAN)
    removed = removals(members, protected)
    order = [F.desc("group_size"), F.desc("size_bytes"), F.col("sha256_hash"), F.col("group_rank")]
    if mode == "delete":
        planned = removed.withColumn("destination_path", F.lit(None).cast("string"))
    else:
        moved = F.concat_ws("/", F.lit(quarantine_root), relative_path(F.col("full_path"), source_root))
        rows = removed.withColumn("__folder", parent(moved)).withColumn("__name", file_name(moved))
        planned = free_names(rows, "__folder", "__name", order, None)
    planned = numbered(planned, order) if mode == "delete" else planned
    action = "deleted_duplicate" if mode == "delete" else "quarantined_duplicate"
    return planned.select("seq", F.lit(action).alias("action"), F.col("full_path").alias("source_path"), "destination_path", F.lit(mode != "delete").alias("reversible"))


def organize_plan(inventory: DataFrame, mode: str, target: str, zone: str = "UTC", existing: DataFrame | None = None) -> DataFrame:
    """Every record to ``target/folder/year/month`` under a free name, in scan order; ``existing`` has the target's full_path column."""
    action = ORGANIZE_MODES[_one_of(mode, ORGANIZE_MODES)]
    order = [F.col("category"), *member_order()]
    rows = inventory.select("full_path", "category", "last_write_utc", destination_folder(target, F.col("category"), F.col("last_write_utc"), zone).alias("__folder"), file_name(F.col("full_path")).alias("__name"))
    planned = free_names(rows, "__folder", "__name", order, existing)
    return planned.select("seq", F.lit(action).alias("action"), F.col("full_path").alias("source_path"), "destination_path", F.lit(True).alias("reversible"))


def action_summary(plan: DataFrame) -> DataFrame:
    """Counters by action; a dry run counts its plan in the same way."""
    names = {"files_copied": "copied", "files_moved": "moved", "duplicates_quarantined": "quarantined_duplicate", "duplicates_deleted": "deleted_duplicate"}
    return plan.agg(*(F.count_if(F.col("action") == action).alias(name) for name, action in names.items()))


def group_keep_summary(members: DataFrame, protected: DataFrame | None = None) -> DataFrame:
    """Per group: hash prefix, removable copies, size text, and the kept path or how many are protected."""
    flagged = keepers(members, protected)
    groups = flagged.groupBy("sha256_hash", "size_bytes").agg(F.count("*").alias("n"), F.count_if("is_protected").alias("n_protected"), F.min_by("full_path", F.when(F.col("keep"), F.col("group_rank"))).alias("kept_path"))
    kept = F.greatest(F.col("n_protected"), F.lit(1))
    return groups.select(
        F.substring("sha256_hash", 1, 12).alias("hash12"),
        (F.col("n") - kept).alias("removable"),
        format_size(F.col("size_bytes")).alias("size_text"),
        F.when(kept > 1, F.concat(kept.cast("string"), F.lit(" protected"))).otherwise(F.col("kept_path")).alias("keep_text"),
    )


def preview_estimates(scanned: DataFrame, deduped: DataFrame, scope: str = "group_and_dedupe", mode: str = "quarantine") -> DataFrame:
    """How many records a run would quarantine and organize, from the one-row scan and dedupe summaries."""
    grouping, deduping = SCOPES[_one_of(scope, SCOPES)]
    removed = F.col("duplicate_files_found") if deduping and _one_of(mode, DEDUPE_MODES) != "off" else F.lit(0).cast("long")
    both = scanned.withColumn("__k", F.lit(1)).join(deduped.withColumn("__k", F.lit(1)), "__k")  # one row each
    organized = F.greatest(F.lit(0), F.col("total_files_scanned") - removed) if grouping else F.lit(0)
    return both.select(removed.alias("would_quarantine"), organized.cast("long").alias("would_organize"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
