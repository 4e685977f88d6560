"""Token-ID files: an adaptive context-mixing range coder in independent, checksummed blocks.

Documents are dealt by ranges of doc_id (and a hash of the text, so that no task gets all rows
of one id) and sorted, so file after file and document after
document are in ascending doc_id order. Each task encodes its texts and writes one file of
blocks (see ``rangecoder``) through pyarrow's file systems: first under a name of its own
attempt, then renamed, so a repeated task leaves the same file. Before each block's code words
stands the list of its documents: doc_id and number of ids. A document may span blocks.

The manifest has one row per block: file, place, size and ids. Reading deals out the blocks of
the manifest, checks both checksums of each, and joins the parts of documents that span blocks
by their lengths and CRCs alone.

Nulls: a null text is empty and has the end id only. Rows with a null doc_id come first, as
Spark sorts them. Rows that repeat a doc_id are separate documents, next to each other in the
order of their hashes. A very long text is encoded by one task and fills as many blocks as it
needs. Other columns are ignored. An empty table writes no file and reads back no row.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from recordloom.llm.encoding import crc32, crc32_join, encoder
from recordloom.llm.rangecoder import BLOCK_IDS, decode_block, encode_block
from recordloom.operators.storage import materialize, new_path

END_ID = 1
#: Parts that a worker keeps, and bytes of text encoded at once.
KEPT_PARTS, SLICE_BYTES = 600_000, 1 << 20
#: Ids read by a task, and the most tasks that read.
TASK_IDS, MAX_TASKS = 1 << 25, 50_000
#: Files whose lengths are summed in one group.
_FILES = 1024
#: Fixed layout before each block: documents, bytes of their compressed list.
_LIST = "<2I"
_NULL_ID = -(1 << 63)

MANIFEST = "part int, block int, file string, begin long, bytes long, ids long"
READ = "part int, block int, item int, doc_id long, at long, n_tokens long, ids_crc32 long, whole boolean"


class _Writer:
    """Fills blocks with documents and writes them to one file."""

    def __init__(self, folder: str, part: int) -> None:
        self.fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        self.fs.create_dir(root)
        self.path, self.part = f"{root}/part-{part:06d}.ids", part
        self.draft = f"{root}/draft-{part:06d}-{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.draft)
        self.docs: list[tuple[int, int]] = []
        self.ids: list[bytes] = []
        self.held = 0
        self.rows: list[tuple] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        first = 0
        while True:
            n = min(len(ids) // 4 - first, BLOCK_IDS - self.held)
            last = first + n == len(ids) // 4
            # the sign of the count says whether the document goes on in the next block
            self.docs.append((_NULL_ID if doc_id is None else doc_id, n if last else -n))
            self.ids.append(ids[4 * first : 4 * (first + n)])
            self.held += n
            first += n
            if self.held == BLOCK_IDS:
                self.flush()
            if last:
                return

    def flush(self) -> None:
        if not self.docs:
            return
        block = encode_block(np.frombuffer(b"".join(self.ids), dtype="<u4").astype(np.int64))
        listed = zlib.compress(np.array(self.docs, dtype="<i8").T.tobytes(), 1)
        begin = self.out.tell()
        self.out.write(struct.pack(_LIST, len(self.docs), len(listed)) + listed + block)
        self.rows.append((self.part, len(self.rows), self.path, begin, self.out.tell() - begin, self.held))
        self.docs, self.ids, self.held = [], [], 0

    def close(self) -> list[tuple]:
        self.flush()
        self.out.close()
        if self.rows:
            self.fs.move(self.draft, self.path)
        else:
            self.fs.delete_file(self.draft)
        return self.rows


def write_ids(docs: DataFrame, path: str, folder: str, blanks: bool = False, end_id: int = END_ID) -> DataFrame:
    """Write the ids of every document into ``folder`` (a URI) and return the manifest, stored beside the files."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoded, writer = encoder(path, blanks, KEPT_PARTS, SLICE_BYTES).encoded, None
        for batch in batches:
            doc_ids = batch["doc_id"].to_pylist()
            if doc_ids and writer is None:
                writer = _Writer(f"{folder}/files", TaskContext.get().partitionId())
            for first, last, some in encoded(batch["text"]):
                for doc_id, ids in zip(doc_ids[first:last], some, strict=True):
                    writer.add(doc_id, ids + end)
        if writer is not None:
            kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            columns = zip(*writer.close(), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["part", "block", "file", "begin", "bytes", "ids"])

    key = ["doc_id", F.xxhash64("text")]  # the hash deals out the rows of one id
    ordered = docs.select("doc_id", "text").repartitionByRange(*key).sortWithinPartitions(*key)
    ordered.mapInArrow(write, MANIFEST).write.parquet(f"{folder}/manifest")
    return docs.sparkSession.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def _earlier(window: WindowSpec) -> Column:
    """Ids of all earlier rows."""
    return F.coalesce(F.sum("ids").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def read_blocks(manifest: DataFrame, folder: str, with_ids: bool = False) -> DataFrame:
    """Parts of documents as the blocks hold them; ``at`` counts the ids before each in its file."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pyarrow.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with fs.open_input_file(row["file"]) as file:
                    held = file.read_at(row["bytes"], row["begin"])
                n, size = struct.unpack_from(_LIST, held)
                head = struct.calcsize(_LIST)
                doc_ids, counts = np.frombuffer(zlib.decompress(held[head : head + size]), dtype="<i8").reshape(2, n)
                ids = memoryview(decode_block(memoryview(held)[head + size :]).astype("<u4").tobytes())
                ends = np.cumsum(np.abs(counts))
                begins = ends - np.abs(counts)
                own = [ids[4 * b : 4 * e] for b, e in zip(begins.tolist(), ends.tolist(), strict=True)]
                arrays = [
                    pa.array(np.full(n, row["part"], dtype=np.int32)),
                    pa.array(np.full(n, row["block"], dtype=np.int32)),
                    pa.array(np.arange(n, dtype=np.int32)),
                    pa.array(doc_ids, mask=doc_ids == _NULL_ID),
                    pa.array(begins + row["before"]),
                    pa.array(ends - begins),
                    pa.array([crc32(v) for v in own], pa.int64()),
                    pa.array(counts >= 0),
                ]
                names = ["part", "block", "item", "doc_id", "at", "n_tokens", "ids_crc32", "whole"]
                if with_ids:
                    arrays, names = [*arrays, pa.array([bytes(v) for v in own], pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(arrays, names)

    blocks = manifest.withColumn("before", _earlier(Window.partitionBy("part").orderBy("block")))
    held = manifest.agg(F.coalesce(F.sum("ids"), F.lit(0)), F.count("*")).first()
    # Spark would put the blocks together by the few bytes of their manifest rows
    tasks = max(held[0] // TASK_IDS, min(held[1], 4 * manifest.sparkSession.sparkContext.defaultParallelism), 1)
    spread = blocks.repartition(min(tasks, MAX_TASKS), "file", "block")
    return spread.mapInArrow(read, READ + (", ids binary" if with_ids else ""))


def read_documents(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    total = manifest.groupBy("part").agg(F.sum("ids").alias("ids")).withColumn("group", F.floor(F.col("part") / _FILES))  # one row a file
    sums = total.groupBy("group").agg(F.sum("ids").alias("ids"))  # one row for each _FILES files
    sums = sums.select("group", _earlier(Window.orderBy("group")).alias("group_start"))
    within = total.select("part", "group", _earlier(Window.partitionBy("group").orderBy("part")).alias("at"))
    starts = within.join(sums, "group").select("part", (F.col("group_start") + F.col("at")).alias("file_start"))
    parts = materialize(read_blocks(manifest, folder), "id-parts")
    # A document that spans blocks is the last of its first one, alone in further ones, and the first of its last.
    follows = (F.col("block") > 0) & (F.col("item") == 0)

    def join(group: pd.DataFrame) -> pd.DataFrame:
        """Chain the parts at the edges of one file's blocks."""
        group = group.sort_values(["block", "item"])
        out: list[list] = []
        goes_on = False
        for r in group.itertuples():
            if goes_on:
                out[-1][2] = crc32_join(out[-1][2], r.ids_crc32, 4 * r.n_tokens)
                out[-1][1] += r.n_tokens
            else:
                out.append([r.at, r.n_tokens, r.ids_crc32, None if r.doc_id is None else int(r.doc_id)])
            goes_on = not r.whole
        columns = list(zip(*out, strict=True))
        return pd.DataFrame({"part": group["part"].iloc[0], "doc_id": pd.array(columns[3], dtype="Int64"), "at": columns[0], "n_tokens": columns[1], "ids_crc32": columns[2]})

    edge = ~F.col("whole") | follows
    columns = ["part", "doc_id", "at", "n_tokens", "ids_crc32"]
    inner = parts.filter(~edge).select(*columns)
    edges = parts.filter(edge).withColumn("doc_id", F.col("doc_id").cast("string"))  # a null would make numbers floats
    chained = edges.groupBy("part").applyInPandas(join, "part int, doc_id long, at long, n_tokens long, ids_crc32 long")
    found = inner.unionAll(chained).join(starts, "part")
    return found.select("doc_id", (F.col("file_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def op4_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = new_path(spark, "token-ids")
    manifest = write_ids(docs, public_tokenizers.path("word_bpe_49k.json"), folder)
    return read_documents(manifest, folder)
