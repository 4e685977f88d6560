"""Best-fit packing by patterns: non-negative least squares on the histogram of lengths.

Every document becomes its token ids and an end id; one longer than the sequence length is cut
into full pieces, the first of which may be shorter. Only the histogram of piece lengths (at
most as many rows as the sequence length) reaches the driver. There, patterns of one to three
lengths that fill a sequence exactly are enumerated, non-negative repeat counts are fitted to
the histogram by least squares, rounded within what is left, and the residual lengths are
packed best-fit into the tightest space, longest first, by counts and not piece by piece.

The plan has, for each length, ranges of ranks that go to a place in a run of equal sequences.
Pieces are ranked within their length from partial counts (PARTS parts of each length, so a
length that a third of all pieces have is ranked by many tasks), and each piece finds its range.

Nulls: a null text is empty; an empty text is one piece, the end id. A null doc_id is an id
like any other. Repeated rows are separate pieces. Other columns are ignored. An empty table
gives no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recordloom.llm.encoding import KEPT_PARTS, crc32, encoder
from recordloom.operators.storage import materialize

CAPACITY = 2048
END_ID = 0
PARTS = 1024
#: Short lengths that patterns of three are built on.
ANCHORS = 24
ROUNDS = 400

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False, kept: int = KEPT_PARTS) -> DataFrame:
    """One row per piece of every document; ``with_ids`` adds the ids themselves (little-endian, 32 bits).

    A Python worker keeps the ids of ``kept`` parts of texts: fewer take less memory and more time, the rows are the same.
    """
    end = np.array([end_id], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoded = encoder(path, True, kept).encoded
        for batch in batches:
            doc_ids = batch["doc_id"].to_pylist()
            for first, last, some in encoded(batch["text"]):
                rows: list[tuple] = []
                for doc_id, ids in zip(doc_ids[first:last], some, strict=True):
                    ids += end
                    at, n = 0, len(ids) // 4
                    size = n if n <= capacity else n % capacity or capacity
                    for piece in range(-(-n // capacity)):
                        own = memoryview(ids)[4 * at : 4 * (at + size)]
                        rows.append((doc_id, piece, at, size, crc32(own), bytes(own) if with_ids else None))
                        at, size = at + size, capacity
                columns = list(zip(*rows, strict=True))[: 6 if with_ids else 5]
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=False)], names[: len(columns)])

    return docs.select("doc_id", "text").mapInArrow(cut, PIECES + (", ids binary" if with_ids else ""))


def patterns(histogram: np.ndarray) -> np.ndarray:
    """Rows of up to three lengths (0: none) that fill a sequence, all of which occur; histogram[k] counts length k."""
    capacity = len(histogram) - 1
    there = histogram > 0
    found = [(capacity, 0, 0)] if there[capacity] else []
    half = np.arange(1, capacity // 2 + 1)
    found += [(int(a), int(capacity - a), 0) for a in half if there[a] and there[capacity - a]]
    short = np.flatnonzero(there[: capacity // 3 + 1])
    if len(short):
        weight = np.cumsum(histogram[short])
        anchors = np.unique(short[np.searchsorted(weight, np.linspace(0, weight[-1] - 1, ANCHORS))])
        for a in anchors:
            b = np.arange(a, (capacity - a) // 2 + 1)
            c = capacity - a - b
            ok = there[b] & there[c]
            found += [(int(a), int(x), int(y)) for x, y in zip(b[ok], c[ok], strict=True)]
    return np.array(found, dtype=np.int64).reshape(-1, 3)


def fit_repeats(some: np.ndarray, histogram: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Non-negative x that minimizes |A x - histogram|^2, A the counts of lengths in the patterns, by multiplicative updates."""
    if not len(some):
        return np.zeros(0)
    target = histogram.astype(np.float64)
    target[0] = 0.0
    slots = [some[:, j] for j in range(3)]
    use = np.bincount(some.ravel(), minlength=len(target)).astype(np.float64)
    x = np.min([np.where(s > 0, target[s] / np.maximum(use[s], 1), np.inf) for s in slots], axis=0)
    toward = sum(target[s] for s in slots)
    for _ in range(rounds):
        made = sum(np.bincount(s, weights=x, minlength=len(target)) for s in slots)
        made[0] = 0.0
        x *= toward / np.maximum(sum(made[s] for s in slots), 1e-12)
    return x


class Plan:
    """Runs of equal sequences, as segments: the next ``count`` pieces of a length go to ``offset`` in sequences first, first+1, ..."""

    def __init__(self) -> None:
        self.sequences = 0
        self.used: dict[int, int] = defaultdict(int)
        self.segments: list[tuple[int, int, int, int]] = []  # length, first rank, first sequence, offset

    def add(self, lengths: tuple[int, ...], count: int) -> None:
        offset = 0
        for length in lengths:
            self.segments.append((length, self.used[length], self.sequences, offset))
            self.used[length] += count
            offset += length
        self.sequences += count

    def table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted keys (length and first rank), first sequences, offsets."""
        rows = np.array(sorted(self.segments), dtype=np.int64).reshape(-1, 4)
        return rows[:, 0] << 48 | rows[:, 1], rows[:, 2], rows[:, 3]


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Pack counted lengths, longest first, each into the tightest space left; runs of (lengths, repeats)."""
    spaces: dict[int, list[list]] = defaultdict(list)  # space left: [lengths, repeats]
    open_spaces = np.zeros(capacity + 1, dtype=np.int64)
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            tight = np.flatnonzero(open_spaces[length:])
            if len(tight):
                space = length + int(tight[0])
                lengths, repeats = spaces[space].pop()
                take = min(repeats, left)
                open_spaces[space] -= take
                if repeats > take:
                    spaces[space].append([lengths, repeats - take])
            else:
                fill = min(capacity // length, left)
                take = left // fill
                space, lengths, left = capacity - (fill - 1) * length, (length,) * (fill - 1), left - take * (fill - 1)
            spaces[space - length].append([(*lengths, length), take])
            open_spaces[space - length] += take
            left -= take
    return [(lengths, repeats) for runs in spaces.values() for lengths, repeats in runs]


def packing_plan(histogram: np.ndarray) -> Plan:
    """histogram[k] counts the pieces of length k, up to the capacity."""
    plan, left = Plan(), histogram.astype(np.int64).copy()
    some = patterns(histogram)
    repeats = fit_repeats(some, histogram)
    for k in np.argsort(-repeats, kind="stable"):
        count = round(repeats[k])
        if not count:
            break
        lengths = tuple(int(v) for v in some[k] if v)
        count = min(count, *(int(left[v]) // lengths.count(v) for v in lengths))
        if count:
            plan.add(lengths, count)
            for v in lengths:
                left[v] -= count
    for lengths, count in best_fit({int(k): int(left[k]) for k in np.flatnonzero(left)}, len(histogram) - 1):
        plan.add(lengths, count)
    return plan


def place(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to a table of pieces with ``length``, ``doc_id``, ``piece`` and ``ids_crc32``."""
    histogram = np.zeros(capacity + 1, dtype=np.int64)
    for r in cut.groupBy("length").count().collect():
        histogram[r["length"]] = r["count"]
    keys, firsts, offsets = packing_plan(histogram).table()

    part = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(PARTS)).cast("int")
    cut = cut.withColumn("part", part)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counted = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    counted = counted.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")
    ranked = cut.withColumn("rank", F.row_number().over(within) - 1).join(counted, ["length", "part"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("rank")).drop("part", "before")

    def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = batch["rank"].to_numpy()
            at = np.searchsorted(keys, batch["length"].to_numpy() << 48 | rank, side="right") - 1
            sequence = firsts[at] + rank - (keys[at] & ((1 << 48) - 1))
            rest = [n for n in batch.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch[n] for n in rest), pa.array(sequence), pa.array(offsets[at])], [*rest, "sequence_id", "offset"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema.fields if f.name != "rank")
    return ranked.mapInArrow(seat, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False, kept: int = KEPT_PARTS) -> DataFrame:
    """Every piece of every document with its place: doc_id, piece, start, length, ids_crc32, sequence_id, offset [, ids]."""
    cut = materialize(pieces(docs, path, capacity, with_ids=with_ids, kept=kept), "pieces")
    placed = place(cut, capacity)
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if with_ids else []))


def packed_sequences(placed: DataFrame) -> DataFrame:
    """(sequence_id, ids) of pieces placed with their ids: at most the capacity in a group."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit("").cast("binary"), lambda held, p: F.concat(held, p["ids"]))
    return placed.groupBy("sequence_id").agg(joined.alias("ids"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
