"""A whole run: preview builds lazy tables, apply writes them under a journal, undo reverts them.

What a stage writes (records, journal entries, skipped records, errors) becomes visible at once, by one commit
(``operators/commit``): a run that breaks leaves its intent and nothing half done, and a run that is
repeated under its id does what is left and nothing twice.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.functions.columns import error_message
from recordloom.functions.filters import ScanFilter
from recordloom.operators import commit, journal
from recordloom.operators.dedupe import dedupe_summary, duplicate_members
from recordloom.operators.plan import SCOPES, action_summary, dedupe_plan, organize_plan, removals, still_there, survivors
from recordloom.operators.storage import materialize
from recordloom.sources.inventory import scan, scan_summary


@dataclass(frozen=True)
class RunOptions:
    source_root: str
    target_root: str
    scope: str = "group_and_dedupe"
    organize_mode: str = "copy"
    dedupe_mode: str = "quarantine"
    filters: ScanFilter = field(default_factory=ScanFilter)
    protected: DataFrame | None = None
    zone: str = "UTC"
    #: A folder of digests kept from run to run, and whether to compute them anew all the same.
    store: str | None = None
    refresh: bool = False


@dataclass(frozen=True)
class RunResult:
    """Lazy tables; what a scope leaves out is None. The plans number their rows, which runs a job, so they are made on demand."""

    options: RunOptions
    scanned: DataFrame
    summary: DataFrame
    members: DataFrame | None
    removed: DataFrame | None
    to_organize: DataFrame | None

    def dedupe_actions(self) -> DataFrame | None:
        o = self.options
        return None if self.members is None else dedupe_plan(self.members, o.dedupe_mode, o.source_root, f"{o.target_root}/quarantine", o.protected)

    def organize_actions(self) -> DataFrame | None:
        o = self.options
        return None if self.to_organize is None else organize_plan(self.to_organize.drop("content"), o.organize_mode, o.target_root, o.zone)


def preview(inventory: DataFrame, options: RunOptions) -> RunResult:
    """What a run would do; nothing is written but, where ``store`` names one, the store of digests, from which the next run takes them."""
    if options.scope not in SCOPES:
        raise ValueError(f"{options.scope!r} is none of {', '.join(SCOPES)}")
    grouping, deduping = SCOPES[options.scope]
    scanned = scan(inventory, options.filters)
    summary = scan_summary(scanned)
    members = removed = None
    if deduping:
        members = duplicate_members(scanned, options.store, options.refresh)
        summary = summary.withColumn("k", F.lit(1)).join(dedupe_summary(members).withColumn("k", F.lit(1)), "k").drop("k")  # one row each
        removed = removals(members, options.protected).filter(F.lit(options.dedupe_mode != "off"))
    left = survivors(scanned, removed) if deduping and options.dedupe_mode != "off" else scanned
    return RunResult(options, scanned, summary, members, removed, left if grouping else None)


#: States of a run and its stages.
RUNNING, COMPLETED, CANCELLED, FAILED = "running", "completed", "cancelled", "failed"
STAGES = ("dedupe", "organize")
SKIPPED = "transaction_id string, full_path string"
ERRORS = "transaction_id string, full_path string, message string"
QUARANTINED = "seq long, action string, source_path string, destination_path string, reversible boolean, extension string, size_bytes long, last_write_utc timestamp, category string, content string, name string, transaction_id string"
ORGANIZED = f"{QUARANTINED}, folder string, year string, month string"


class Cancelled(Exception):
    """A run was asked to stop between two stages."""


#: The datasets of a stage.
DATASETS = {"organize": "organized", "dedupe": "quarantine"}
PARTITIONS = {"organize": ("folder", "year", "month"), "dedupe": ()}


def read_issues(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The rows ``skipped`` or ``errors`` of all runs; empty if there are none."""
    return commit.read_published(spark, folder, name, {"skipped": SKIPPED, "errors": ERRORS}[name])


def read_records(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The records ``organized`` or ``quarantine`` of all runs with all their columns; a run's records are there when its stage is done."""
    return commit.read_published(spark, folder, name, ORGANIZED if name == "organized" else QUARANTINED, given=False)


def apply(inventory: DataFrame, options: RunOptions, folder: str, transaction_id: str, current: DataFrame | None = None, stop: Callable[[], bool] | None = None) -> DataFrame:
    """Do what ``preview`` plans, and return one row of counters of what was done.

    Below ``folder``: the journal, ``organized`` and ``quarantine`` (records by transaction), and
    the run's ``skipped`` and ``errors`` rows, all Parquet. ``current`` (full_path, and where it has
    one, error) is what exists when the run acts: a planned record that is not there is skipped, and
    one with an error ends as failed; the others go on. Intent is journaled before data is written.
    ``stop`` is asked before each stage. A run that is stopped or breaks is marked so, and raises.

    A ``transaction_id`` that has completed changes nothing and returns its counters. One that was
    interrupted is taken up where its last stage ended. One that was undone is refused.
    """
    spark = inventory.sparkSession
    known = journal.current_transactions(journal.read_table(spark, folder, "transactions")).filter(F.col("transaction_id") == transaction_id).first()
    if known is not None and known["lifecycle_status"] == journal.ROLLED_BACK:
        raise ValueError(f"run {transaction_id} was undone; a new run needs a new id")
    if known is not None and known["lifecycle_status"] == COMPLETED:
        return run_counters(spark, folder, transaction_id)
    result = preview(inventory, options)
    made = {"dedupe": result.dedupe_actions(), "organize": result.organize_actions()}
    steps, total = {}, 0
    for stage in STAGES:
        if made[stage] is not None:
            steps[stage] = materialize(made[stage].withColumn("seq", F.col("seq") + total), "plan")
            total += steps[stage].count()
    created = F.lit(datetime.now(timezone.utc) if known is None else known["created_at_utc"])
    processed = 0

    def state(status: str, stage: str, message: str, reason: str | None = None) -> None:
        row = journal.header(spark, transaction_id, options.source_root, options.target_root, status, stage, processed, total, message, created, F.current_timestamp(), reason)
        journal.append(row, folder, "transactions")

    state(RUNNING, "created", "Run planned.")
    try:
        for stage, plan in steps.items():
            if stop is not None and stop():
                raise Cancelled(f"stopped before {stage}")
            state(RUNNING, stage, f"Stage {stage} begins.")
            if not commit.is_published(folder, transaction_id, stage):
                _act(plan, result.scanned, folder, transaction_id, stage, current)
            processed += plan.count()
        state(COMPLETED, COMPLETED, "Run completed.")
    except Cancelled as why:
        state(CANCELLED, CANCELLED, "Run cancelled.", str(why))
        raise
    except Exception as failed:
        state(FAILED, FAILED, "Run failed.", str(failed))
        raise
    return run_counters(spark, folder, transaction_id)


def _act(plan: DataFrame, scanned: DataFrame, folder: str, transaction_id: str, stage: str, current: DataFrame | None) -> None:
    """One stage: the intent, committed on its own, then its records with how each action ended, and what was skipped or went wrong, in one commit."""
    acted, gone = plan.withColumn("read_error", F.lit(None).cast("string")), None
    if current is not None:
        seen = current.select(F.col("full_path").alias("source_path"), (F.col("error") if "error" in current.columns else F.lit(None).cast("string")).alias("read_error"))
        acted = materialize(plan.join(seen, "source_path"), "acted")
        _, gone = still_there(plan, current)

    def prepared(rows: DataFrame, part: str, name: str, keys: tuple[str, ...] = ()) -> str:
        commit.prepare(rows.drop("transaction_id"), folder, transaction_id, part, name, keys)
        return name

    intent = f"{stage}-intent"
    pending = journal.journal_events(acted, transaction_id, "pending", 0, F.current_timestamp())
    commit.publish(folder, transaction_id, intent, [prepared(pending, intent, "journal_entries")], replace=True)
    good = acted.filter("read_error is null").drop("read_error")
    content = journal.placed_rows(good.filter("destination_path is not null"), scanned, transaction_id)
    if stage == "dedupe":
        content = content.drop("folder", "year", "month")
    names = [prepared(content, stage, DATASETS[stage], PARTITIONS[stage])]
    status = F.when(F.col("read_error").isNull(), "done").otherwise("failed")
    names.append(prepared(journal.journal_events(acted, transaction_id, status, 1, F.current_timestamp(), F.col("read_error")), stage, "journal_entries"))
    if gone is not None:
        names.append(prepared(gone.select(F.col("source_path").alias("full_path")), stage, "skipped"))
        message = error_message(f"Could not {stage}", F.col("source_path"), None, F.col("read_error"))
        names.append(prepared(acted.filter("read_error is not null").select(F.col("source_path").alias("full_path"), message.alias("message")), stage, "errors"))
    commit.publish(folder, transaction_id, stage, names)


def run_counters(spark: SparkSession, folder: str, transaction_id: str) -> DataFrame:
    """What a run has done by action, and how many records it skipped or failed on."""

    def own(rows: DataFrame) -> DataFrame:
        return rows.filter(F.col("transaction_id") == transaction_id)

    done = journal.current_entries(own(journal.read_table(spark, folder, "journal_entries"))).filter("status = 'done'")
    out = action_summary(done).withColumn("k", F.lit(1))
    for name, count in (("skipped", "skipped_count"), ("errors", "error_count")):
        out = out.join(own(read_issues(spark, folder, name)).agg(F.count("*").alias(count), F.lit(1).alias("k")), "k")  # one row each
    return out.drop("k")


def _undo(spark: SparkSession, folder: str, chosen: DataFrame, inventory: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Mark the ``chosen`` runs as rolled back; the undo plan and (transaction_id, message) of all that could not be undone."""
    chosen = materialize(chosen.select("transaction_id").distinct(), "chosen")
    entries, states = journal.read_table(spark, folder, "journal_entries"), journal.read_table(spark, folder, "transactions")
    own, heads = (rows.join(chosen, "transaction_id", "left_semi") for rows in (entries, states))
    undone = materialize(journal.undo_plan(own), "undone")
    errors = undone.filter("error is not null").select("transaction_id", F.col("error").alias("message"))
    if inventory is not None:
        after = journal.rolled_back(heads, own, errors, F.current_timestamp())
        there = journal.locations(inventory, entries, states.unionByName(after))
        errors = errors.unionByName(journal.verify_rollback(own, there).select("transaction_id", F.col("issue").alias("message")))
    errors = materialize(errors, "undo-errors")
    journal.append(materialize(journal.rolled_back(heads, own, errors, F.current_timestamp()), "rolled-back"), folder, "transactions")
    return undone, errors


def undo(spark: SparkSession, folder: str, transaction_id: str, inventory: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Mark a run as rolled back: its counters in one row, and the errors as rows; the live set is the journal's fold.

    With the ``inventory``, what should be there again and what should be gone is checked too.
    """
    known = journal.read_table(spark, folder, "transactions").filter(F.col("transaction_id") == transaction_id)
    if known.isEmpty():
        raise ValueError(f"no run {transaction_id}")
    undone, errors = _undo(spark, folder, known, inventory)
    counted = journal.undo_summary(undone).drop("n_errors").withColumn("k", F.lit(1))
    return counted.join(errors.agg(F.count("*").alias("n_errors"), F.lit(1).alias("k")), "k").drop("k"), errors


def undo_last(spark: SparkSession, folder: str, inventory: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    latest = journal.latest_transaction(journal.read_table(spark, folder, "transactions")).first()
    if latest is None:
        raise ValueError(f"no run to undo in {folder}")
    return undo(spark, folder, latest["transaction_id"], inventory)


def recover(spark: SparkSession, folder: str, inventory: DataFrame | None = None) -> DataFrame:
    """Undo every recoverable run in one job and mark each as rolled back; returns what each restores."""
    states, entries = journal.read_table(spark, folder, "transactions"), journal.read_table(spark, folder, "journal_entries")
    found = materialize(journal.recover_all(states, entries), "recovered")
    _undo(spark, folder, found, inventory)
    return found
