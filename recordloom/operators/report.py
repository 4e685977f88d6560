"""Reports of a run: metrics, members, a JSON head with datasets of rows, and a text digest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.functions.columns import format_size
from recordloom.operators.dedupe import group_order, group_summary

#: Metrics of the tabular report and the summary columns they show, in order.
METRICS = {
    "GeneratedAtUtc": "generated_at_utc",
    "TransactionId": "transaction_id",
    "SourcePath": "source_path",
    "TargetPath": "target_path",
    "TotalFiles": "total_files_scanned",
    "TotalBytes": "total_bytes_scanned",
    "DuplicateGroups": "duplicate_group_count",
    "DuplicateFiles": "duplicate_files_found",
    "SimilarImageGroups": "similar_group_count",
    "SkippedFiles": "skipped_count",
    "ReclaimableBytes": "duplicate_bytes_reclaimable",
    "FilesCopied": "files_copied",
    "FilesMoved": "files_moved",
    "DuplicatesQuarantined": "duplicates_quarantined",
    "DuplicatesDeleted": "duplicates_deleted",
    "Errors": "error_count",
}


def run_summary(parts: list[DataFrame], generated_at: str, source: str, target: str, transaction_id: str | None = None, similar: int = 0, skipped: int = 0, errors: int = 0) -> DataFrame:
    """One row from one-row summaries (scan, dedupe, actions) and what the caller knows of the run."""
    row = parts[0].withColumn("__k", F.lit(1))
    for part in parts[1:]:
        row = row.join(part.withColumn("__k", F.lit(1)), "__k")  # one row each
    given = {"generated_at_utc": generated_at, "transaction_id": transaction_id or "", "source_path": source, "target_path": target}
    counts = {"similar_group_count": similar, "skipped_count": skipped, "error_count": errors}
    return row.drop("__k").withColumns({k: F.lit(v) for k, v in given.items()} | {k: F.lit(v).cast("long") for k, v in counts.items()})


def report_metrics(summary: DataFrame) -> DataFrame:
    """(position, metric, value): the tabular report as rows."""
    pairs = [F.struct(F.lit(i).alias("position"), F.lit(m).alias("metric"), F.col(c).cast("string").alias("value")) for i, (m, c) in enumerate(METRICS.items(), start=1)]
    return summary.select(F.inline(F.array(*pairs)))


def report_members(members: DataFrame) -> DataFrame:
    """(sha256_hash, size_bytes, full_path) of every member, in the order of groups and members."""
    ordered = members.orderBy(F.desc("group_size"), F.desc("size_bytes"), "sha256_hash", "group_rank")
    return ordered.select("sha256_hash", "size_bytes", "full_path")


def report_document(summary: DataFrame) -> DataFrame:
    """The head of the JSON report: one row with the run, its counters and nothing that grows. Groups follow as rows of their own datasets."""
    counters = [c for c in summary.columns if c not in ("generated_at_utc", "transaction_id", "source_path", "target_path")]
    return summary.select("generated_at_utc", "transaction_id", "source_path", "target_path", F.struct(*counters).alias("summary"))


def report_digest(summary: DataFrame, members: DataFrame, similar: DataFrame | None = None, k: int = 10) -> DataFrame:
    """(line_no, line) of a text report: headlines, then the largest groups."""

    def line(label: str, value: Column) -> Column:
        return F.concat(F.lit(f"{label}: "), value)

    lines = [
        F.lit("Run Report"),
        line("Generated", F.col("generated_at_utc")),
        line("Transaction ID", F.when(F.col("transaction_id") == "", "-").otherwise(F.col("transaction_id"))),
        line("Source", F.col("source_path")),
        line("Target", F.col("target_path")),
        line("Total Files", F.col("total_files_scanned").cast("string")),
        line("Total Size", format_size(F.col("total_bytes_scanned"))),
        line("Duplicate Groups", F.col("duplicate_group_count").cast("string")),
        line("Duplicate Files", F.col("duplicate_files_found").cast("string")),
        line("Similar Image Groups", F.col("similar_group_count").cast("string")),
        line("Skipped Files", F.col("skipped_count").cast("string")),
        line("Reclaimable", format_size(F.col("duplicate_bytes_reclaimable"))),
        line("Copied", F.col("files_copied").cast("string")),
        line("Moved", F.col("files_moved").cast("string")),
        line("Quarantined", F.col("duplicates_quarantined").cast("string")),
        line("Deleted", F.col("duplicates_deleted").cast("string")),
        line("Errors", F.col("error_count").cast("string")),
        F.lit(""),
        F.lit("Top Duplicate Groups:"),
    ]
    head = summary.select(F.posexplode(F.array(*lines)).alias("line_no", "line"))
    top = group_order(group_summary(members)).limit(k)
    listed = F.transform(
        F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("a"), (-F.col("size_bytes")).alias("b"), "sha256_hash"))),
        lambda g: F.concat(F.lit("- "), F.substring(g["sha256_hash"], 1, 12), F.lit("... ("), (-g["a"]).cast("string"), F.lit(" files, "), format_size(-g["b"]), F.lit(")")),
    )
    rows = top.agg(listed.alias("lines")).select(F.posexplode("lines").alias("line_no", "line"))
    out = head.unionByName(rows.select((F.col("line_no") + len(lines)).alias("line_no"), "line"))
    if similar is None:
        return out
    anchors = similar.select("anchor_path", (F.col("group_size") - 1).alias("others")).distinct().orderBy(F.desc("others"), "anchor_path").limit(k)
    named = F.transform(
        F.array_sort(F.collect_list(F.struct((-F.col("others")).alias("a"), "anchor_path"))),
        lambda g: F.concat(F.lit("- "), g["anchor_path"], F.lit(" (+"), (-g["a"]).cast("string"), F.lit(" similar)")),
    )
    some = anchors.agg(named.alias("lines"))
    some = some.filter(F.size("lines") > 0).select(F.posexplode(F.concat(F.array(F.lit(""), F.lit("Similar Image Groups:")), F.col("lines"))).alias("line_no", "line"))
    return out.unionByName(some.select((F.col("line_no") + len(lines) + k).alias("line_no"), "line"))


def write_report(folder: str, summary: DataFrame, members: DataFrame, similar: DataFrame, skipped: DataFrame | None = None, errors: DataFrame | None = None) -> None:
    """JSON (head, duplicate members, similar members), CSV (metrics, members and, where given, skipped paths and error messages) and a text digest, each a dataset of its own.

    ``similar`` has anchor_path, full_path and group_size, one row a member; ``skipped`` has full_path, ``errors`` has message.
    """
    report_document(summary).coalesce(1).write.mode("overwrite").json(f"{folder}/document")
    members.write.mode("overwrite").json(f"{folder}/duplicate_groups")
    similar.write.mode("overwrite").json(f"{folder}/similar_groups")
    report_metrics(summary).orderBy("position").select("metric", "value").coalesce(1).write.mode("overwrite").csv(f"{folder}/metrics", header=True)
    report_members(members).write.mode("overwrite").csv(f"{folder}/members", header=True)
    if skipped is not None:
        skipped.select("full_path").write.mode("overwrite").csv(f"{folder}/skipped", header=True)
    if errors is not None:
        errors.select("message").write.mode("overwrite").csv(f"{folder}/errors", header=True, escape='"')
    report_digest(summary, members, similar).coalesce(1).sortWithinPartitions("line_no").select("line").write.mode("overwrite").text(f"{folder}/digest")
