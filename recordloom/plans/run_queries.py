"""Queries that write: runs, journals, stores, files and batches, read back and checked by SQL over the tables."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.functions.filters import ScanFilter
from recordloom.functions.fingerprints import hex16, image_fingerprints, sha256
from recordloom.functions.pictures import gray_bitmap
from recordloom.operators import commit, dedupe, journal, reuse
from recordloom.operators.storage import materialize, new_path
from recordloom.plans import registry as R
from recordloom.plans.run import Cancelled, RunOptions, apply, preview, read_issues, read_records, recover, run_counters, undo_last
from recordloom.sources.files import inventory_from_files, snapshot_of_files, write_files
from recordloom.streaming import arrivals, intake, stateful

QUERIES: dict = {}
SQL: dict[str, str] = {}
_OPTIONS = RunOptions(R.ROOT, R.TARGET, filters=ScanFilter(exclude_hidden=False))


def query(name: str, sql: str):
    def add(run):
        QUERIES[name], SQL[name] = run, sql
        return run

    return add


# ---- a run: what is gone is skipped, what cannot be read fails --------------------------

_GONE, _DENIED = "doc_id % 17 = 0", "doc_id % 19 = 0"


def _current(inventory: DataFrame) -> DataFrame:
    """What is still there when the run acts."""
    return inventory.filter(f"not ({_GONE})").select("full_path", F.when(F.expr(_DENIED), "denied").alias("error"))


def _run(spark: SparkSession, sf_dir: str, options: RunOptions = _OPTIONS) -> str:
    folder = new_path(spark, "run")
    rows = R.inventory(spark, sf_dir)
    apply(rows, options, folder, "run1", _current(rows))
    return folder


def _run_sql(action: str) -> str:
    """planned: the whole plan of the run above, in order; acted: its rows that are not skipped, with how they end."""
    order = "category, last_write_utc, lower(full_path), full_path"
    return f"""{R._MEM}, gone as (select * from members where group_rank > 1),
rel as (select *, concat('{R.TARGET}/quarantine/', case when starts_with(full_path, '{R.ROOT}/') then substr(full_path, {len(R.ROOT) + 2}) else name end) as path from gone),
qn as (select *, row_number() over (partition by path order by group_size desc, size_bytes desc, sha256_hash, group_rank) - 1 as n from rel),
q as (select {R._SEQ}, 'quarantined_duplicate' as action, full_path as source_path, concat(regexp_replace(path, '/[^/]*$', ''), '/', {R._NUM}) as destination_path, doc_id, size_bytes, folder, last_write_utc from qn),
slot as (select *, concat('{R.TARGET}/', folder, '/', strftime(last_write_utc, '%Y/%m')) as place from inv where full_path not in (select full_path from gone)),
og as (select *, row_number() over (partition by place, name order by {order}) - 1 as n from slot),
o as (select (select count(*) from q) + row_number() over (order by {order}) as seq, '{action}' as action, full_path as source_path, concat(place, '/', {R._NUM}) as destination_path, doc_id, size_bytes, folder, last_write_utc from og),
planned as (select * from q union all select * from o),
acted as (select *, case when {_DENIED} then 'failed' else 'done' end as status from planned where not ({_GONE}))
"""


_COPY = _run_sql("copied")
query("run_journal", _COPY + "select 'run1' as transaction_id, seq, action, source_path, destination_path, status, case when status = 'failed' then 'denied' end as error_message from acted")(
    lambda s, d: journal.current_entries(journal.read_table(s, _run(s, d), "journal_entries")).select("transaction_id", "seq", "action", "source_path", "destination_path", "status", "error_message")
)
query("run_counters", _COPY + f"select count(*) filter (where action = 'copied' and status = 'done') as files_copied, cast(0 as bigint) as files_moved, count(*) filter (where action <> 'copied' and status = 'done') as duplicates_quarantined, cast(0 as bigint) as duplicates_deleted, (select count(*) from planned where {_GONE}) as skipped_count, count(*) filter (where status = 'failed') as error_count from acted")(
    lambda s, d: run_counters(s, _run(s, d), "run1")
)
query("organized_dataset", _COPY + "select source_path, destination_path, size_bytes, folder, cast(year(last_write_utc) as int) as year, cast(month(last_write_utc) as int) as month from acted where action = 'copied' and status = 'done'")(
    lambda s, d: read_records(s, _run(s, d), "organized").select("source_path", "destination_path", F.octet_length("content").cast("long").alias("size_bytes"), "folder", F.col("year").cast("int").alias("year"), F.col("month").cast("int").alias("month"))
)
query("quarantine_dataset", _COPY + "select source_path, destination_path, size_bytes from acted where action <> 'copied' and status = 'done'")(
    lambda s, d: read_records(s, _run(s, d), "quarantine").select("source_path", "destination_path", F.octet_length("content").cast("long").alias("size_bytes"))
)


def _issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run skipped and failed on, as one table."""
    folder = _run(spark, sf_dir)
    skipped = read_issues(spark, folder, "skipped").select("full_path", F.lit("skipped").alias("kind"), F.lit(None).cast("string").alias("message"))
    return skipped.unionByName(read_issues(spark, folder, "errors").select("full_path", F.lit("error").alias("kind"), "message"))


query("run_issues", _COPY + f"select source_path as full_path, 'skipped' as kind, cast(null as varchar) as message from planned where {_GONE} union all select source_path, 'error', concat('Could not ', case when action = 'copied' then 'organize' else 'dedupe' end, ' (path=''', source_path, '''): denied') from acted where status = 'failed'")(_issues)


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The states of a run that ends and of one that is stopped before its second stage."""
    folder, asked = new_path(spark, "states"), iter([False, True])
    rows = R.inventory(spark, sf_dir)
    apply(rows, _OPTIONS, folder, "run1")
    try:
        apply(rows, _OPTIONS, folder, "run2", stop=lambda: next(asked))
    except Cancelled:
        pass  # its state is what the query shows
    return journal.read_table(spark, folder, "transactions").select("transaction_id", "lifecycle_status", "checkpoint_stage", "checkpoint_processed", "checkpoint_total", "interruption_reason")


query(
    "run_states",
    _COPY
    + """, n as (select (select count(*) from q) as q, (select count(*) from planned) as t)
select t.transaction_id, t.lifecycle_status, t.checkpoint_stage, cast(case t.done when 0 then 0 when 1 then n.q else n.t end as bigint) as checkpoint_processed, n.t as checkpoint_total, t.interruption_reason
from n, (values ('run1', 'running', 'created', 0, null), ('run1', 'running', 'dedupe', 0, null), ('run1', 'running', 'organize', 1, null), ('run1', 'completed', 'completed', 2, null),
 ('run2', 'running', 'created', 0, null), ('run2', 'running', 'dedupe', 0, null), ('run2', 'cancelled', 'cancelled', 1, 'stopped before organize')) t(transaction_id, lifecycle_status, checkpoint_stage, done, interruption_reason)""",
)(_states)

# ---- a run that is broken, repeated, or deletes ------------------------------------------


def _repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run whose first attempts die, one while its drafts are written and one before they are committed, and that is then applied twice: how often each record and each event is there."""
    folder, rows = new_path(spark, "repeated"), R.inventory(spark, sf_dir)
    broken = rows.select("full_path", F.when(F.col("doc_id") % 7 == 3, F.raise_error(F.lit("lost"))).otherwise(F.lit("x")).cast("string").alias("name"))
    try:
        commit.prepare(broken, folder, "run1", "organize", "organized")
    except PySparkException:
        pass  # as meant: its drafts are gone
    commit.prepare(rows.select(F.col("full_path").alias("source_path"), "content"), folder, "run1", "dedupe", "quarantine")
    for _ in range(2):
        apply(rows, _OPTIONS, folder, "run1", _current(rows))
    there = [read_records(spark, folder, name).select("source_path", F.lit(name).alias("dataset")) for name in ("organized", "quarantine")]
    events = journal.read_table(spark, folder, "journal_entries").select("source_path", F.concat(F.lit("journal "), "status").alias("dataset"))
    return there[0].unionByName(there[1]).unionByName(events).groupBy("source_path", "dataset").agg(F.count("*").alias("times"))


query("run_repeated", _COPY + """select source_path, case when action = 'copied' then 'organized' else 'quarantine' end as dataset, cast(1 as bigint) as times from acted where status = 'done'
union all select source_path, 'journal pending', 1 from acted union all select source_path, concat('journal ', status), 1 from acted""")(_repeated)

_DELETE = RunOptions(R.ROOT, R.TARGET, scope="dedupe_only", dedupe_mode="delete", filters=ScanFilter(exclude_hidden=False))


def _deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run that deletes, and what undoing it says: every deleted record's entry, whether it is live, and whether it is kept anywhere."""
    folder, rows = _run(spark, sf_dir, _DELETE), R.inventory(spark, sf_dir)
    entries, states = (journal.read_table(spark, folder, name) for name in ("journal_entries", "transactions"))
    live = materialize(journal.live_set(rows, entries, states).select(F.col("full_path").alias("source_path"), F.lit(True).alias("live")), "live")
    kept = read_records(spark, folder, "quarantine").groupBy("source_path").agg(F.count("*").alias("kept"))
    undone = journal.undo_plan(entries).select("source_path", "undo_action", "error")
    own = journal.current_entries(entries).select("source_path", "action", "destination_path", "status", "reversible")
    return own.join(live, "source_path", "left").join(kept, "source_path", "left").join(undone, "source_path", "left").fillna({"live": False, "kept": 0})


query(
    "run_deleted",
    R._MEM
    + f"""select full_path as source_path, 'deleted_duplicate' as action, cast(null as varchar) as destination_path, case when {_DENIED} then 'failed' else 'done' end as status, false as reversible,
 {_DENIED} as live, cast(0 as bigint) as kept, case when not ({_DENIED}) then 'cannot_restore' end as undo_action, case when not ({_DENIED}) then concat('Deleted record cannot be restored (', full_path, ').') end as error
from members where group_rank > 1 and not ({_GONE})""",
)(_deleted)

# ---- undo and recovery of runs ------------------------------------------------------------

_MOVE = RunOptions(R.ROOT, R.TARGET, organize_mode="move", filters=ScanFilter(exclude_hidden=False))
_MOVED = _run_sql("moved")
_LOST = "doc_id % 23 = 0"


def _live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which records are live after a run, and after it is undone."""
    folder, rows = _run(spark, sf_dir, _MOVE), R.inventory(spark, sf_dir)

    def live(name: str) -> DataFrame:
        found = journal.live_set(rows, journal.read_table(spark, folder, "journal_entries"), journal.read_table(spark, folder, "transactions"))
        return materialize(found.select("full_path", F.lit(True).alias(name)), name)

    before = live("live_before")
    undo_last(spark, folder, rows)
    out = rows.select("full_path").join(before, "full_path", "left").join(live("live_after"), "full_path", "left")
    return out.fillna(False)


query("undo_run", _MOVED + "select full_path, full_path not in (select source_path from acted where status = 'done') as live_before, true as live_after from inv")(_live)
query("undo_run_counters", _MOVED + f"select cast(0 as bigint) as files_copied, count(*) filter (where action = 'moved') as files_moved, count(*) filter (where action <> 'moved') as duplicates_quarantined, count(*) filter (where {_LOST}) as n_errors from acted where status = 'done'")(
    lambda s, d: undo_last(s, _run(s, d, _MOVE), R.inventory(s, d).filter(f"not ({_LOST})"))[0]
)


def _recovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Journals of seven runs, written and recovered: the state of each run afterwards."""
    folder = new_path(spark, "recover")
    for name, rows in zip(("transactions", "journal_entries"), R.journal_tables(spark, sf_dir), strict=True):
        journal.append(rows, folder, name)
    recover(spark, folder)
    return journal.current_transactions(journal.read_table(spark, folder, "transactions")).select("transaction_id", "lifecycle_status", "checkpoint_stage", "checkpoint_message")


query(
    "recover_runs",
    R._JOURNAL
    + """, e as (select transaction_id, count(error) as n from undo group by 1)
select t.transaction_id, case when r.transaction_id is null then t.lifecycle_status else 'rolled_back' end as lifecycle_status, case when r.transaction_id is null then 'organize' else 'undo_completed' end as checkpoint_stage,
 case when r.transaction_id is null then null when coalesce(e.n, 0) > 0 then concat('Undone; ', e.n, ' could not be.') else 'Undone.' end as checkpoint_message
from tx t left join rec r using (transaction_id) left join e using (transaction_id)""",
)(_recovered)


def _json_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Journals of at most 100 actions, written as JSON with some keys left out, and read again."""
    folder = new_path(spark, "json-journal")
    entry = F.struct("doc_id", F.expr(R._KIND).alias("action"), F.col("full_path").alias("source_path"), F.when(F.expr("doc_id % 10 = 0"), F.lit("failed")).alias("status"), F.when(F.expr("doc_id % 4 = 3"), F.lit(False)).alias("reversible"))
    journal_of = F.concat(F.lit("j"), F.floor(F.col("doc_id") / 100).cast("string"))
    grouped = R.inventory(spark, sf_dir).groupBy(journal_of.alias("transaction_id")).agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    grouped.select("transaction_id", F.lit("/lake").alias("source_root"), "entries").write.json(folder)
    _, entries = journal.read_json_journal(spark, folder, multi_line=False)
    return entries.select("transaction_id", "seq", "action", "source_path", "status", "reversible")


query("json_journal", R._INV + f"select concat('j', doc_id // 100) as transaction_id, row_number() over (partition by doc_id // 100 order by doc_id) as seq, {R._KIND} as action, full_path as source_path, case when doc_id % 10 = 0 then 'failed' else 'done' end as status, doc_id % 4 <> 3 as reversible from inv")(_json_journal)

# ---- the fingerprint store, and batches that are repeated ------------------------------------


def _store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two snapshots and a third that was never finished, read back."""
    folder = new_path(spark, "store")
    reuse.write_fingerprints(R.prior_snapshot(spark, sf_dir), folder, 1)
    known = reuse.read_fingerprints(spark, folder)
    computed = reuse.with_fingerprints(R.inventory(spark, sf_dir).filter("doc_id % 4 <> 3"), known, sha256)
    reuse.write_fingerprints(reuse.fingerprint_upsert(known, computed, F.timestamp_seconds(F.lit(1800000000)), 0), folder, 2)
    R.prior_snapshot(spark, sf_dir).filter("size_bytes < 500").write.parquet(f"{folder}/snapshot-3")
    return reuse.read_fingerprints(spark, folder).select("full_path", "mtime_us", "sha256")


query("fingerprint_store", R.SQL["fingerprint_upsert"])(_store)


def _batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches, of which the last brings some records again, and the last two are repeated."""
    folder, rows = new_path(spark, "batches"), R.inventory(spark, sf_dir)

    def feed(batch_id: int, some: Column) -> None:
        intake.intake_batch(rows.filter(some), batch_id, f"{folder}/store", f"{folder}/out")

    own = [F.expr("doc_id % 3 = 0"), F.expr("doc_id % 3 = 1"), F.expr("doc_id % 3 = 2 or doc_id % 12 = 0")]
    for batch_id in (0, 1, 2, 1, 2):
        feed(batch_id, own[batch_id])
    return intake.read_intake(spark, f"{folder}/out").select("batch", "full_path", "sha256", "is_duplicate", "reused")


query(
    "intake_batches",
    R._INV
    + """, b as (select doc_id % 3 as batch, full_path, last_write_utc, sha256(content) as sha256 from inv union all select 2, full_path, last_write_utc, sha256(content) from inv where doc_id % 12 = 0),
w as (select *, row_number() over (partition by batch, sha256 order by last_write_utc, lower(full_path), full_path) as r, min(batch) over (partition by full_path) as met from b),
k as (select x.batch, x.full_path, count(*) filter (where y.full_path <> x.full_path) as others from w x join w y on x.sha256 = y.sha256 and y.batch < x.batch and y.batch = y.met group by 1, 2)
select cast(w.batch as bigint) as batch, w.full_path, w.sha256, coalesce(k.others, 0) > 0 or w.r > 1 as is_duplicate, w.met < w.batch as reused from w left join k on w.batch = k.batch and w.full_path = k.full_path""",
)(_batches)


def _stateful(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same batches as a stream of files through one stateful operator that is started anew for each."""
    folder, rows = new_path(spark, "stateful"), R.inventory(spark, sf_dir)
    schema = rows.drop("doc_id").schema
    for some in ("doc_id % 3 = 0", "doc_id % 3 = 1", "doc_id % 3 = 2 or doc_id % 12 = 0"):
        rows.filter(some).drop("doc_id").write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(schema).parquet(f"{folder}/in")
        stateful.stateful_intake(stream, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return stateful.read_marked(spark, f"{folder}/out").select("batch", "full_path", "sha256", "is_duplicate")


query("intake_stateful", f"select batch, full_path, sha256, is_duplicate from ({SQL['intake_batches']})")(_stateful)


def _warm(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """A preview of the whole inventory with the digests of an earlier one of three quarters of it: what it plans, and where each digest came from."""
    rows, store = R.inventory(spark, sf_dir), folder or new_path(spark, "warm")
    dedupe.reused_digests(rows.filter("doc_id % 4 <> 3"), store)
    older = F.when(F.col("doc_id") % 5 == 0, F.col("last_write_utc") + F.expr("interval 1 hour")).otherwise(F.col("last_write_utc"))
    touched = rows.withColumn("last_write_utc", older)  # these have a new time, so their old digest is not theirs
    sources = dedupe.reused_digests(touched, store).select("full_path", "reused")
    again = preview(touched, RunOptions(R.ROOT, R.TARGET, filters=ScanFilter(exclude_hidden=False), store=store))
    members = again.members.select("full_path", "sha256_hash", "group_size")
    return members.join(sources, "full_path", "left")


query(
    "warm_preview",
    R._INV
    + """, t as (select doc_id, full_path, size_bytes, content from inv), shared as (select size_bytes from t where doc_id % 4 <> 3 group by 1 having count(*) > 1),
m as (select *, sha256(content) as sha256_hash, count(*) over (partition by content) as group_size from t)
select full_path, sha256_hash, group_size, doc_id % 4 <> 3 and doc_id % 5 <> 0 and size_bytes in (select size_bytes from shared) as reused from m where group_size > 1""",
)(_warm)

# ---- files ---------------------------------------------------------------------------------


def _files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str, Column]:
    """The records written as files and listed again: the listing, its root, and a column of paths below the root."""
    folder = new_path(spark, "files")
    uri = folder if "://" in folder else "file://" + folder.removeprefix("file:")
    written = write_files(R.inventory(spark, sf_dir), uri)
    if not written.filter("write_error is not null").isEmpty():
        raise OSError(f"some files could not be written below {uri}")
    listed = inventory_from_files(spark, uri, reserved=".state")
    return listed, uri, F.regexp_extract("full_path", "(/lake/.*)$", 1)


def _file_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed, _, path = _files(spark, sf_dir)
    return listed.filter("error is null").select(path.alias("full_path"), "extension", "size_bytes", "category")


def _file_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed, uri, path = _files(spark, sf_dir)
    return dedupe.duplicate_file_members(listed, uri).select("sha256_hash", "size_bytes", path.alias("full_path"), "group_size")


query("files_inventory", R._INV + f"select full_path, extension, size_bytes, category from inv where {R._UNRESERVED}")(_file_inventory)
query("files_duplicates", R._INV + f"select * from (select sha256(content) as sha256_hash, size_bytes, full_path, count(*) over (partition by sha256(content), size_bytes) as group_size from inv where {R._UNRESERVED}) where group_size > 1")(_file_members)


def _snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records as files in a lopsided tree, one source of them twelve folders deeper than the others, listed by rounds of few folders."""
    folder = new_path(spark, "tree")
    uri = folder if "://" in folder else "file://" + folder.removeprefix("file:")
    deep = F.concat(F.lit("/down" * 12), "full_path")
    rows = R.inventory(spark, sf_dir).withColumn("full_path", F.when(F.col("full_path").startswith("/lake/src0/"), deep).otherwise(F.col("full_path")))
    if not write_files(rows, uri).filter("write_error is not null").isEmpty():
        raise OSError(f"some files could not be written below {uri}")
    listed = snapshot_of_files(spark, uri, (".state",), entered=20)
    return listed.filter("error is null").select(F.regexp_extract("full_path", "((/down)*/lake/.*)$", 1).alias("full_path"), "extension", "size_bytes", "category")


query("files_snapshot", R._INV + f"select concat(case when starts_with(full_path, '/lake/src0/') then repeat('/down', 12) else '' end, full_path) as full_path, extension, size_bytes, category from inv where {R._UNRESERVED}")(_snapshot)


def _arrived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files written in two rounds, the second of which also changes some of the first, and streamed after each: what each batch read."""
    folder, rows = new_path(spark, "arrived"), R.inventory(spark, sf_dir)
    uri = folder if "://" in folder else "file://" + folder.removeprefix("file:")
    changed = F.when(F.col("doc_id") % 12 == 0, F.concat(F.lit("changed "), F.coalesce("content", F.lit("")))).otherwise(F.col("content"))
    for own in (rows.filter("doc_id % 3 = 0"), rows.filter("doc_id % 3 <> 0 or doc_id % 12 = 0").withColumn("content", changed)):
        if not write_files(own, f"{uri}/tree").filter("write_error is not null").isEmpty():
            raise OSError(f"some files could not be written below {uri}")
        for _ in range(2):  # the second listing finds nothing new
            arrivals.note_arrivals(spark, f"{uri}/tree", f"{folder}/arrivals", (".state",))
            arrivals.digest_arrivals(spark, f"{uri}/tree", f"{folder}/arrivals", f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    found = arrivals.read_digests(spark, f"{folder}/out").filter("read_error is null")
    return found.select("batch", F.regexp_extract("full_path", "/tree(/lake/.*)$", 1).alias("full_path"), "size_bytes", "sha256_hash")


query(
    "files_arrived",
    R._INV
    + f"""select batch, full_path, cast(strlen(body) as bigint) as size_bytes, sha256(body) as sha256_hash from (
 select cast(0 as bigint) as batch, full_path, content as body from inv where doc_id % 3 = 0 and {R._UNRESERVED}
 union all select 1, full_path, case when doc_id % 12 = 0 then concat('changed ', content) else content end from inv where (doc_id % 3 <> 0 or doc_id % 12 = 0) and {R._UNRESERVED})""",
)(_arrived)

# ---- pictures ------------------------------------------------------------------------------

_PIXEL = "cast(least(255, greatest(0, floor((cast(embedding[{at} % {n} + {first}] as double) + 1) * 127.5))) as int)"


def _pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector as the file of a gray picture of 9 by 8 pixels, read by Spark's image source and fingerprinted."""
    folder = new_path(spark, "pictures")
    uri = folder if "://" in folder else "file://" + folder.removeprefix("file:")
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").repartition(spark.sparkContext.defaultParallelism)
    pixels = F.transform(F.sequence(F.lit(0), F.lit(71)), lambda i: F.floor((F.get("embedding", i % F.size("embedding")).cast("double") + 1) * 127.5))
    pixels = F.transform(pixels, lambda v: F.least(F.lit(255), F.greatest(F.lit(0), v)).cast("int"))
    rows = vectors.select(F.concat(F.lit("/v"), F.col("vec_id").cast("string"), F.lit(".bmp")).alias("full_path"), gray_bitmap(pixels, 9, 8).alias("content"))
    if not write_files(rows, uri).filter("write_error is not null").isEmpty():
        raise OSError(f"some pictures could not be written below {uri}")
    found = image_fingerprints(spark.read.format("image").load(uri))
    return found.select(F.regexp_extract("full_path", r"/v(\d+)\.bmp$", 1).cast("long").alias("vec_id"), hex16(F.col("h")).alias("fp"))


query(
    "picture_fingerprints",
    f"""with cells as (select vec_id, b // 8 * 9 + b % 8 as p, b, embedding, len(embedding) as n from embeddings, range(64) t(b)),
 lit as (select vec_id, b, {_PIXEL.format(at="p", n="n", first=1)} as here, {_PIXEL.format(at="(p + 1)", n="n", first=1)} as beside from cells)
select vec_id, lower(lpad(to_hex(bit_or(case when here > beside then 1::UBIGINT << b::UBIGINT else 0::UBIGINT end)), 16, '0')) as fp from lit group by 1""",
)(_pictures)
