"""Intake as one stateful operator: what each digest has been brought by is kept in the state store.

The state of a digest is at most two paths, however many records share it: two suffice to say
whether another path than a record's own has brought its content. Unlike ``intake_batch`` it
computes every digest anew and does not free the old content of a path that changes; in return a
batch writes no table of its own, and with a time to live the state forgets what has not come
again for so long.

Copies inside a partition are told apart before the shuffle: of each digest's rows in an Arrow
batch, the first alone is sent to the digest's task, and all others, which are copies of it, are
dealt out evenly. A digest of a third of all rows so costs its task one row for every Arrow batch.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from recordloom.functions.fingerprints import sha256

ROWS = "full_path string, size_bytes long, at long, low string, sha256 string"
#: What the stage before the shuffle adds: the group, another path of the digest, and the answer where it is known already.
SENT = f"{ROWS}, slot string, other string, known boolean"
MARKED = "full_path string, size_bytes long, at long, sha256 string, is_duplicate boolean"
SEEN = "full_path string, size_bytes long, last_write_utc timestamp, sha256 string, is_duplicate boolean, batch long"
#: Settings of such a query: the store that its operator needs, and no batches without data, which a time to live would ask for without end.
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}
#: Groups over which rows with a known answer are dealt.
DEALT = 1024


def _first_of_each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of a batch in their order, with the first of each digest marked as open."""
    for rows in batches:
        rows = rows.astype({"size_bytes": "Int64"}).sort_values(["at", "low", "full_path"], kind="stable")
        open_ = rows["sha256"].notna() & ~rows.duplicated("sha256")
        firsts = rows[open_].set_index("sha256")["full_path"]
        own = rows["sha256"].map(firsts)
        others = rows[rows["sha256"].notna() & (own != rows["full_path"])].drop_duplicates("sha256").set_index("sha256")["full_path"]
        dealt = rows["full_path"].fillna("").map(lambda p: f"#{zlib.crc32(p.encode()) % DEALT}")
        known = rows["sha256"].notna().astype(object)  # a row without content is no copy, any other that isn't open is one
        yield _plain(rows.assign(slot=rows["sha256"].where(open_, dealt), other=rows["sha256"].map(others).where(open_, None), known=known.where(~open_, None)))


class Holders(StatefulProcessor):
    """Marks the first record of a digest, and keeps up to two paths that have brought it.

    A table has about as many digests as rows, so a digest costs one call for its state, one to
    change it, and no frame of its own.
    """

    def __init__(self, ttl_ms: int | None) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "first string, second string", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        if key[0].startswith("#"):
            for row in rows:
                yield _marked(row, row.known)
            return
        held = self.held.get() or ()
        earlier = [p for p in held if p is not None]
        best, paths = None, list(earlier)
        for row in rows:
            for path in (row.full_path, row.other):
                if len(paths) < 2 and path is not None and path not in paths:
                    paths.append(path)
            if best is None:
                best = row
                continue
            best, later = (best, row) if _place(best) <= _place(row) else (row, best)
            yield _marked(later, True)
        yield _marked(best, any(p != best.full_path for p in earlier))
        if self.ttl_ms is not None or paths != earlier or not held:  # a time to live begins anew
            self.held.update((paths[0] if paths else None, paths[1] if len(paths) > 1 else None))

    def close(self) -> None:
        pass


def _place(row: Row) -> tuple:
    """The order of a batch's rows; a null path comes last."""
    return row.at, row.full_path is None, row.low, row.full_path


def _marked(row: Row, is_duplicate: bool) -> Row:
    return Row(full_path=row.full_path, size_bytes=row.size_bytes, at=row.at, sha256=row.sha256, is_duplicate=is_duplicate)


def _plain(rows: pd.DataFrame) -> pd.DataFrame:
    """Texts as Python objects: joined or masked columns of Arrow strings come in chunks, which Spark doesn't take."""
    texts = [c for c in ("full_path", "low", "sha256", "slot", "other") if c in rows.columns]
    return rows.assign(**{c: pd.Series([v if isinstance(v, str) else None for v in rows[c]], index=rows.index, dtype=object) for c in texts})


def mark_copies(stream: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """Rows of a stream of inventory rows with content, with ``is_duplicate``: whether another path, or an earlier row of the batch, has the same content.

    The first row of a batch is the oldest, then the first by path. A null content is never a copy.
    ``ttl_ms`` forgets a digest that long after its last record.
    """
    at = F.coalesce(F.unix_micros("last_write_utc"), F.lit(-(1 << 63)))
    rows = stream.select("full_path", F.col("size_bytes").cast("long").alias("size_bytes"), at.alias("at"), F.lower("full_path").alias("low"), sha256(F.col("content")).alias("sha256"))
    sent = rows.mapInPandas(_first_of_each, SENT)
    marked = sent.groupBy("slot").transformWithState(Holders(ttl_ms), MARKED, "Append", "None" if ttl_ms is None else "ProcessingTime")
    time = F.when(F.col("at") > -(1 << 63), F.timestamp_micros("at"))
    return marked.select("full_path", "size_bytes", time.alias("last_write_utc"), "sha256", "is_duplicate")


def stateful_intake(stream: DataFrame, out: str, checkpoint: str, ttl_ms: int | None = None) -> StreamingQuery:
    """Run ``mark_copies`` over all that a stream has now; a batch that is repeated replaces what it wrote. State is in the checkpoint's folder."""
    spark = stream.sparkSession
    before = {name: spark.conf.get(name) for name in SETTINGS}
    for name, value in SETTINGS.items():  # a query keeps the settings that it starts with
        spark.conf.set(name, value)
    try:
        return (
            mark_copies(stream, ttl_ms)
            .writeStream.foreachBatch(lambda rows, batch_id: rows.write.mode("overwrite").parquet(f"{out}/batch={batch_id}"))
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def read_marked(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(SEEN).option("basePath", out).parquet(out)
