"""Journal, undo and recovery: an append-only log folded into the current state.

``journal_entries`` has one row per event of a planned action (pending, then done or failed);
the status of an action is that of its last event. ``transactions`` has one row per state of a
run; the last one counts. Intent is written before any data, so a run that dies in between
stays recoverable.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.functions.columns import file_name
from recordloom.operators import commit
from recordloom.operators.ordering import ranked

ENTRIES = (
    "transaction_id string, seq long, event_no long, action string, source_path string, destination_path string, "
    "timestamp_utc timestamp, status string, error_message string, reversible boolean"
)
TRANSACTIONS = (
    "transaction_id string, created_at_utc timestamp, source_root string, target_root string, lifecycle_status string, "
    "checkpoint_stage string, checkpoint_processed long, checkpoint_total long, checkpoint_message string, "
    "updated_at_utc timestamp, interruption_reason string"
)
#: States of a run that leave it recoverable whatever its entries say.
INTERRUPTED = ("running", "cancelled", "failed")
ROLLED_BACK = "rolled_back"
COUNTERS = ("files_copied", "files_moved", "duplicates_quarantined", "n_errors")

_JSON_ENTRY = "struct<action:string,source_path:string,destination_path:string,timestamp_utc:string,status:string,error_message:string,reversible:boolean>"


def read_json_journal(spark: SparkSession, path: str, multi_line: bool = True) -> tuple[DataFrame, DataFrame]:
    """(transactions, journal_entries) of journals kept as JSON documents, one a file or (without ``multi_line``) one a line; absent keys get their defaults, unreadable ones are left out."""
    schema = T._parse_datatype_string(
        "transaction_id string, created_at_utc string, source_root string, target_root string, lifecycle_status string, checkpoint_stage string, "
        "checkpoint_processed_files long, checkpoint_total_files long, checkpoint_message string, updated_at_utc string, "
        f"interruption_reason string, entries array<{_JSON_ENTRY}>"
    )
    docs = spark.read.schema(schema).option("multiLine", multi_line).option("mode", "PERMISSIVE").json(path).filter("transaction_id is not null")
    header = docs.select(
        "transaction_id",
        F.to_timestamp("created_at_utc").alias("created_at_utc"),
        "source_root",
        "target_root",
        F.coalesce("lifecycle_status", F.lit("completed")).alias("lifecycle_status"),
        F.coalesce("checkpoint_stage", F.lit("legacy")).alias("checkpoint_stage"),
        F.coalesce("checkpoint_processed_files", F.lit(0)).alias("checkpoint_processed"),
        F.coalesce("checkpoint_total_files", F.lit(0)).alias("checkpoint_total"),
        "checkpoint_message",
        F.to_timestamp("updated_at_utc").alias("updated_at_utc"),
        "interruption_reason",
    )
    entries = docs.select("transaction_id", F.posexplode("entries").alias("seq", "e")).select(
        "transaction_id",
        (F.col("seq") + 1).cast("long").alias("seq"),
        F.lit(0).cast("long").alias("event_no"),
        "e.action",
        "e.source_path",
        "e.destination_path",
        F.to_timestamp("e.timestamp_utc").alias("timestamp_utc"),
        F.coalesce("e.status", F.lit("done")).alias("status"),
        "e.error_message",
        F.coalesce("e.reversible", F.lit(True)).alias("reversible"),
    )
    return header, entries


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The journal table ``name`` below a folder: what was appended and what stages have committed; empty if nothing was written yet."""
    schema = {"journal_entries": ENTRIES, "transactions": TRANSACTIONS}[name]
    committed = commit.read_published(spark, folder, name, schema)
    try:
        return spark.read.schema(schema).parquet(f"{folder}/{name}").unionByName(committed)
    except AnalysisException:
        return committed


def append(rows: DataFrame, folder: str, name: str) -> None:
    rows.write.mode("append").partitionBy("transaction_id").parquet(f"{folder}/{name}")


def journal_events(plan: DataFrame, transaction_id: str, status: str | Column, event_no: int, now: Column, error: Column | None = None) -> DataFrame:
    """Events of a plan's actions."""
    state = F.lit(status) if isinstance(status, str) else status
    return plan.select(
        F.lit(transaction_id).alias("transaction_id"),
        "seq",
        F.lit(event_no).cast("long").alias("event_no"),
        "action",
        "source_path",
        "destination_path",
        now.cast("timestamp").alias("timestamp_utc"),
        state.alias("status"),
        (F.lit(None).cast("string") if error is None else error).alias("error_message"),
        "reversible",
    )


def current_entries(entries: DataFrame) -> DataFrame:
    """The last event of each action."""
    rest = [c for c in entries.columns if c not in ("transaction_id", "seq")]
    last = entries.groupBy("transaction_id", "seq").agg(F.max_by(F.struct(*rest), "event_no").alias("e"))
    return last.select("transaction_id", "seq", "e.*")


def current_transactions(transactions: DataFrame) -> DataFrame:
    """The last state of each run."""
    rest = [c for c in transactions.columns if c != "transaction_id"]
    return transactions.groupBy("transaction_id").agg(F.max_by(F.struct(*rest), "updated_at_utc").alias("t")).select("transaction_id", "t.*")


def header(spark: SparkSession, transaction_id: str, source_root: str, target_root: str, status: str, stage: str, processed: int, total: int, message: str, created: Column, now: Column, reason: str | None = None) -> DataFrame:
    """One state of a run."""
    return spark.range(1).select(
        F.lit(transaction_id).alias("transaction_id"),
        created.cast("timestamp").alias("created_at_utc"),
        F.lit(source_root).alias("source_root"),
        F.lit(target_root).alias("target_root"),
        F.lit(status).alias("lifecycle_status"),
        F.lit(stage).alias("checkpoint_stage"),
        F.lit(processed).cast("long").alias("checkpoint_processed"),
        F.lit(total).cast("long").alias("checkpoint_total"),
        F.lit(message).alias("checkpoint_message"),
        now.cast("timestamp").alias("updated_at_utc"),
        F.lit(reason).cast("string").alias("interruption_reason"),
    )


def latest_transaction(transactions: DataFrame) -> DataFrame:
    """The newest run, one row or none."""
    return current_transactions(transactions).orderBy(F.desc("updated_at_utc"), F.desc("transaction_id")).limit(1)


def recoverable_transactions(transactions: DataFrame, entries: DataFrame) -> DataFrame:
    """Runs that are not rolled back and were interrupted or have an action that is not done; newest first."""
    open_entries = current_entries(entries).groupBy("transaction_id").agg(F.count_if(F.expr("status <> 'done'")).alias("open_entries"))
    joined = current_transactions(transactions).join(open_entries, "transaction_id", "left")
    left = F.col("lifecycle_status").isin(*INTERRUPTED) | (F.coalesce("open_entries", F.lit(0)) > 0)
    found = joined.filter((F.col("lifecycle_status") != ROLLED_BACK) & left)
    return found.select("transaction_id", "lifecycle_status", F.coalesce("open_entries", F.lit(0)).alias("open_entries"), "updated_at_utc").orderBy(F.desc("updated_at_utc"), F.desc("transaction_id"))


#: What undoes each action.
INVERSE = {"copied": "remove_destination", "moved": "restore_source", "quarantined_duplicate": "restore_source", "deleted_duplicate": "cannot_restore"}


def undo_plan(entries: DataFrame, transactions: DataFrame | None = None, locations: DataFrame | None = None) -> DataFrame:
    """The inverse of every done action, last one first: transaction_id, step, seq, undo_action, action, source_path, destination_path, error.

    ``transactions`` (ids) limits it to some runs. With ``locations`` (full_path), an action whose
    destination is gone has nothing to undo and is left out.
    """
    done = current_entries(entries).filter("status = 'done'")
    if transactions is not None:
        done = done.join(transactions.select("transaction_id"), "transaction_id", "left_semi")
    if locations is not None:
        there = locations.select(F.col("full_path").alias("destination_path"), F.lit(True).alias("there"))
        done = done.join(there, "destination_path", "left").filter("there or action = 'deleted_duplicate'")
    undo = F.coalesce(*(F.when(F.col("action") == a, F.lit(u)) for a, u in INVERSE.items()))
    lost = F.concat(F.lit("Deleted record cannot be restored ("), F.col("source_path"), F.lit(")."))
    inverse = done.select(
        "transaction_id",
        "seq",
        undo.alias("undo_action"),
        "action",
        "source_path",
        "destination_path",
        F.when(undo == "cannot_restore", lost).alias("error"),
    )
    return ranked(inverse, ["transaction_id"], [F.desc("seq")], "step")


def _restored() -> list[Column]:
    kinds = {"files_copied": "copied", "files_moved": "moved", "duplicates_quarantined": "quarantined_duplicate"}
    return [*(F.count_if(F.col("action") == a).alias(c) for c, a in kinds.items()), F.count_if(F.col("error").isNotNull()).alias("n_errors")]


def undo_summary(undone: DataFrame) -> DataFrame:
    """Counters over an undo plan; the errors themselves are its rows with ``error``."""
    return undone.agg(*_restored())


def recover_all(transactions: DataFrame, entries: DataFrame) -> DataFrame:
    """Per recoverable run, what undoing it restores, all in one job; ``recovery_summary`` adds them up."""
    found = recoverable_transactions(transactions, entries).select("transaction_id")
    done = current_entries(entries).filter("status = 'done'").join(found, "transaction_id", "left_semi")
    sums = done.withColumn("error", F.when(F.col("action") == "deleted_duplicate", F.lit("cannot restore"))).groupBy("transaction_id").agg(*_restored())
    return found.join(sums, "transaction_id", "left").fillna({c: 0 for c in COUNTERS})


def recovery_summary(recovered: DataFrame) -> DataFrame:
    return recovered.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTERS))


def rolled_back(transactions: DataFrame, entries: DataFrame, errors: DataFrame, now: Column) -> DataFrame:
    """The state of each of ``transactions`` after it is undone; ``errors`` has a row (transaction_id) for each thing that could not be."""
    known = current_transactions(transactions).select("transaction_id", "created_at_utc", "source_root", "target_root")
    sizes = current_entries(entries).groupBy("transaction_id").agg(F.count("*").alias("n"))
    wrong = errors.groupBy("transaction_id").agg(F.count("*").alias("n_errors"))
    rows = known.join(sizes, "transaction_id", "left").join(wrong, "transaction_id", "left").fillna({"n": 0, "n_errors": 0})
    text = F.when(F.col("n_errors") > 0, F.concat(F.lit("Undone; "), F.col("n_errors").cast("string"), F.lit(" could not be."))).otherwise(F.lit("Undone."))
    return rows.select(
        "transaction_id",
        "created_at_utc",
        "source_root",
        "target_root",
        F.lit(ROLLED_BACK).alias("lifecycle_status"),
        F.lit("undo_completed").alias("checkpoint_stage"),
        F.col("n").alias("checkpoint_processed"),
        F.col("n").alias("checkpoint_total"),
        text.alias("checkpoint_message"),
        now.cast("timestamp").alias("updated_at_utc"),
        F.lit(None).cast("string").alias("interruption_reason"),
    )


def verify_rollback(entries: DataFrame, locations: DataFrame) -> DataFrame:
    """(transaction_id, seq, issue) for done actions whose undoing is not visible in ``locations`` (full_path)."""
    there = locations.select("full_path").distinct()
    done = current_entries(entries).filter("status = 'done'").select("transaction_id", "seq", "action", "source_path", "destination_path")
    done = done.join(there.select(F.col("full_path").alias("source_path"), F.lit(True).alias("source_there")), "source_path", "left")
    done = done.join(there.select(F.col("full_path").alias("destination_path"), F.lit(True).alias("destination_there")), "destination_path", "left")
    moved = F.col("action").isin("moved", "quarantined_duplicate")

    def issue(text: str, path: str) -> Column:
        return F.concat(F.lit(f"After undo {text}: "), F.col(path))

    issues = F.array_compact(
        F.array(
            F.when((F.col("action") == "copied") & F.col("destination_there"), issue("a copy is left", "destination_path")),
            F.when(moved & F.col("source_there").isNull(), issue("a record is missing", "source_path")),
            F.when(moved & F.col("destination_there"), issue("a moved record is left", "destination_path")),
        )
    )
    return done.select("transaction_id", "seq", F.explode(issues).alias("issue"))


def live_set(inventory: DataFrame, entries: DataFrame, transactions: DataFrame) -> DataFrame:
    """The inventory without records that a run still in force has removed or moved away."""
    back = current_transactions(transactions).filter(F.col("lifecycle_status") == ROLLED_BACK).select("transaction_id")
    gone = current_entries(entries).filter("status = 'done' and action <> 'copied'").join(back, "transaction_id", "left_anti")
    return inventory.join(gone.select(F.col("source_path").alias("full_path")), "full_path", "left_anti")


def locations(inventory: DataFrame, entries: DataFrame, transactions: DataFrame) -> DataFrame:
    """(full_path) of all that is there now: the live records, and what runs still in force have put somewhere."""
    back = current_transactions(transactions).filter(F.col("lifecycle_status") == ROLLED_BACK).select("transaction_id")
    put = current_entries(entries).filter("status = 'done' and destination_path is not null").join(back, "transaction_id", "left_anti")
    return live_set(inventory, entries, transactions).select("full_path").union(put.select("destination_path")).distinct()


def placed_rows(plan: DataFrame, inventory: DataFrame, transaction_id: str) -> DataFrame:
    """Records of a plan with the folder, year and month of their destination, ready to be written by partition."""
    rows = plan.join(inventory, plan["source_path"] == inventory["full_path"]).drop("full_path")
    segments = F.split("destination_path", "/")
    return rows.select(
        "*",
        F.lit(transaction_id).alias("transaction_id"),
        F.element_at(segments, -4).alias("folder"),
        F.element_at(segments, -3).alias("year"),
        F.element_at(segments, -2).alias("month"),
        file_name(F.col("destination_path")).alias("name"),
    )
