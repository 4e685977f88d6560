"""N-gram Jaccard join by MinHash banding.

Every document is the set of its distinct five-word shingles (64-bit hashes; a document of one
to four words is one shingle). Documents with equal sets are collapsed to one member at once,
so a group of copies of any size is one set with a count. Band and row counts follow from the
target recall at the threshold: with r rows and b bands a pair of similarity s meets with
probability 1 - (1 - s^r)^b. Only band hashes are shuffled to find who meets.

A bucket is the members with one hash in one band. Buckets with the same members are one, the one
of the lowest band. Each is verified on its own on the full shingle sets, so a chance meeting costs
no more than its bucket, and a set is copied at most once a band. A pair that meets in several bands
counts in the lowest, which the members' band hashes tell. A bucket of more than BLOCK members is cut
into blocks, a task gets two of them, and blocks grow with the bucket up to MAX_BLOCK: nothing is
capped or sampled, pairs of different texts are compared all, and what a task returns is each
member's number of links and a spanning forest, never the pairs.

The result has one row per document: its class (the least doc_id of the connected documents)
and its number of links (other documents with similarity at or above the threshold, equal
sets included).

Nulls: a null text has no shingles. A document without shingles, or with a null doc_id, is its
own class with no links. Rows that share a doc_id are one document: their texts' classes are
joined, and each row counts as a link of the other if their sets are equal. Other columns are
ignored. A very long text is compared by all its shingles, 8 bytes each, of which a task holds those of two
blocks at once. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.llm.textops import mix, ngram_sets, utf8_slices
from recordloom.operators.components import connected_components
from recordloom.operators.storage import materialize

SHINGLE = 5
THRESHOLD = 0.8
RECALL = 0.9999
MAX_HASHES = 128
#: Members of a block of a large bucket, and the most; a bucket has BLOCKS blocks or so in between.
BLOCK, MAX_BLOCK, BLOCKS = 128, 1024, 8
#: Elements of the 0/1 matrix of members by shingles that a task holds at once.
_CELLS = 1 << 24


def band_plan(threshold: float = THRESHOLD, recall: float = RECALL, max_hashes: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows for which MAX_HASHES allow enough bands for the recall at the threshold."""
    best = None
    for rows in range(1, max_hashes + 1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands * rows <= max_hashes:
            best = bands, rows
    if best is None:
        raise ValueError("too few hashes for this recall")
    return best


def _set_keys(grams: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that name each set; 0 for an empty one."""
    full = np.flatnonzero(np.diff(bounds))
    low, high = (np.zeros(len(bounds) - 1, dtype=np.uint64) for _ in range(2))
    if len(full):
        low[full] = np.add.reduceat(mix(grams ^ np.uint64(0x5851F42D4C957F2D)), bounds[full])
        high[full] = np.add.reduceat(mix(grams * np.uint64(0x2545F4914F6CDD1D)), bounds[full])
    return low.view(np.int64), high.view(np.int64)


def signatures(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """doc_id, n_grams, low, high, bands of every row."""
    seeds = mix(np.arange(1, bands * rows + 1, dtype=np.uint64))
    odd = mix(seeds) | np.uint64(1)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in utf8_slices(batch["text"]):
                grams, bounds = ngram_sets(data, offsets, SHINGLE)
                sizes = np.diff(bounds)
                full = np.flatnonzero(sizes)
                hashes = np.zeros((end - row, bands), dtype=np.uint64)
                if len(full):
                    for k in range(bands * rows):
                        least = np.minimum.reduceat((grams ^ seeds[k]) * odd[k], bounds[full])
                        hashes[full, k // rows] = mix(hashes[full, k // rows] * np.uint64(31) + least)
                low, high = _set_keys(grams, bounds)
                lists = pa.ListArray.from_arrays(np.arange(0, hashes.size + 1, bands, dtype=np.int32), pa.array(hashes.view(np.int64).ravel()))
                ids = batch["doc_id"].slice(row, end - row).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([ids, pa.array(sizes), pa.array(low), pa.array(high), lists], ["doc_id", "n_grams", "low", "high", "bands"])

    return docs.select("doc_id", "text").mapInArrow(sign, "doc_id long, n_grams long, low long, high long, bands array<long>")


def _with_sets(rows: DataFrame) -> DataFrame:
    """Replace ``text`` by the shingle set, and leave rows whose set is the wanted one (low, high)."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            others = batch.select([n for n in batch.schema.names if n != "text"])
            for row, end, data, offsets in utf8_slices(batch["text"]):
                grams, bounds = ngram_sets(data, offsets, SHINGLE)
                low, high = _set_keys(grams, bounds)
                part = others.slice(row, end - row)
                same = (part["low"].to_numpy() == low) & (part["high"].to_numpy() == high)
                sets = pa.array([grams[bounds[i] : bounds[i + 1]].tobytes() for i in range(end - row)], pa.binary())
                whole = pa.RecordBatch.from_arrays([*part.columns, sets], [*part.schema.names, "grams"])
                yield whole.filter(pa.array(same))

    kept = [f for f in rows.schema.fields if f.name != "text"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept) + ", grams binary"
    return rows.select(*(f.name for f in kept), "text").mapInArrow(build, schema)


def _shared(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the pairs (left, right)."""
    if len(left) * 4 < len(sets) or len(left) < 8:
        return np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(left, right, strict=True)], dtype=np.int64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = count[column] > 1
    owner, column = owner[often], (np.cumsum(count > 1) - 1)[column[often]]
    width = max(1, _CELLS // len(sets))
    total = np.zeros((len(sets), len(sets)), dtype=np.float64)
    for begin in range(0, int(column.max(initial=-1)) + 1, width):
        own = (column >= begin) & (column < begin + width)
        part = np.zeros((len(sets), min(width, int(column.max()) + 1 - begin)), dtype=np.float32)
        part[owner[own], column[own] - begin] = 1
        total += part @ part.T
    return total[left, right].astype(np.int64)


def verify_blocks(table: pa.Table, threshold: float) -> pa.Table:
    """Links and spanning forest of the pairs of a bucket that share no lower band, within one block or across two."""
    columns = {n: table[n].combine_chunks() for n in table.schema.names}
    nodes, copies, block, sizes, low, high = (columns[n].to_numpy(zero_copy_only=False) for n in ("rep", "copies", "block", "n_grams", "low", "high"))
    order = np.lexsort((high, low, nodes))
    nodes, copies, block, sizes, low, high = (v[order] for v in (nodes, copies, block, sizes, low, high))
    bands = columns["bands"].flatten().to_numpy().reshape(len(nodes), -1)[order]
    sets = [np.frombuffer(v, dtype=np.uint64) for v in columns["grams"].take(pa.array(order)).to_pylist()]
    two = table["first"][0].as_py() != table["second"][0].as_py()
    meet = np.minimum(sizes[:, None], sizes[None, :]) >= threshold * np.maximum(sizes[:, None], sizes[None, :]) - 1e-9
    for k in range(table["band"][0].as_py()):  # such a pair is counted in the bucket of that band
        meet &= bands[:, k][:, None] != bands[:, k][None, :]
    if two:
        meet &= block[:, None] != block[None, :]
    left, right = np.nonzero(np.triu(meet, 1))
    shared = _shared(sets, left, right)
    near = shared >= threshold * (sizes[left] + sizes[right] - shared) - 1e-9
    left, right = left[near], right[near]
    links = np.bincount(left, weights=copies[right], minlength=len(nodes)) + np.bincount(right, weights=copies[left], minlength=len(nodes))
    least = np.arange(len(nodes))  # index of the least member reached so far; nodes are sorted
    while True:
        before = least.copy()
        np.minimum.at(least, left, before[right])
        np.minimum.at(least, right, before[left])
        least = least[least]
        if (least == before).all():
            break
    return pa.table({"node": nodes, "low": low, "high": high, "links": links.astype(np.int64), "other": nodes[least]})


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id, n_links, n_grams."""
    bands, rows = band_plan(threshold, recall)
    signed = materialize(signatures(docs, bands, rows), "signatures")
    judged = signed.filter("n_grams > 0 and doc_id is not null")
    sets = judged.groupBy("low", "high", "n_grams").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("bands").alias("bands"))
    sets = materialize(sets, "sets")
    met = sets.select("rep", "low", "high", "n_grams", "copies", "bands", F.posexplode("bands").alias("band", "hash"))
    named = F.xxhash64("rep", "low", "high")
    buckets = met.groupBy("band", "hash").agg(F.count("*").alias("n"), F.bit_xor(named).alias("x"), F.bit_xor(F.xxhash64(named)).alias("y")).filter("n > 1")
    once = buckets.groupBy("n", "x", "y").agg(F.min(F.struct("band", "hash")).alias("b")).select("n", "b.band", "b.hash")
    size = F.least(F.greatest(F.lit(block), F.ceil(F.col("n") / BLOCKS)), F.lit(max(block, MAX_BLOCK)))
    members = met.join(materialize(once, "buckets"), ["band", "hash"]).withColumn("cuts", F.ceil(F.col("n") / size).cast("int")).drop("n")
    members = materialize(members.withColumn("block", F.pmod(named, F.col("cuts")).cast("int")), "members")
    wanted = docs.select("doc_id", "text").filter("doc_id is not null and text is not null")
    keys = materialize(members.select("rep", "low", "high").distinct(), "wanted")  # grows with the corpus: never broadcast
    wanted = wanted.join(keys.hint("merge"), F.col("doc_id") == F.col("rep")).drop("doc_id")
    grams = _with_sets(wanted).dropDuplicates(["rep", "low", "high"])  # of repeated rows, one
    dealt = members.withColumn("to", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    dealt = dealt.withColumn("first", F.least("block", "to")).withColumn("second", F.greatest("block", "to")).drop("to", "cuts")
    dealt = dealt.join(materialize(grams, "grams"), ["rep", "low", "high"])
    found = dealt.groupBy("band", "hash", "first", "second").applyInArrow(lambda t: verify_blocks(t, threshold), "node long, low long, high long, links long, other long")
    found = materialize(found, "verified")
    links = found.groupBy(F.col("node").alias("rep"), "low", "high").agg(F.sum("links").alias("links"))
    classes = connected_components(found.select("node", "other"), "node", "other").withColumnRenamed("node", "rep")
    decided = sets.select("low", "high", "n_grams", "rep", "copies").join(links, ["rep", "low", "high"], "left").join(classes, "rep", "left")
    decided = decided.select("low", "high", "n_grams", F.coalesce("component", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    whole = signed.drop("bands")
    joined = whole.filter("n_grams > 0 and doc_id is not null").join(materialize(decided, "decided"), ["low", "high", "n_grams"])
    alone = whole.filter("not (n_grams > 0 and doc_id is not null)").withColumn("class_id", F.col("doc_id")).withColumn("n_links", F.lit(0).cast("long"))
    out = ["doc_id", "class_id", "n_links", "n_grams"]
    return joined.select(*out).unionAll(alone.select(*out))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
