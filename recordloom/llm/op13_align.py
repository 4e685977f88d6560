"""Cross-tokenizer alignment: which ids of two tokenizers cover the same bytes of a text.

Tokenizer A is a byte-level BPE of the tokenizers library and encodes a space and the text, B is a
SentencePiece model, which adds that space itself. A text is cut into parts at places where both
always cut (before white space after something else, and between an ASCII letter and a punctuation
mark), and each distinct part is aligned once: the cumulative ends of A's tokens and those of B's
go into end-to-index dictionaries, the intersection of their key sets, sorted, slices both id lists
into groups, and the links of a slice are its A ids by its B ids. A part's end is an end of both, so
a text's groups are those of its parts in order. Parts of more than LONGEST bytes are aligned each
time.

A pair of ids counts the documents that hold it linked. The documents' distinct pairs are counted
by Spark; frequent pairs (``frequent``) are broadcast, the others are joined back by document.

Nulls: null and empty texts, and those whose bytes B does not give back (a blank mark U+2581 in the
text), have no tokens: zeros and an empty groups_sha256. A very long text is aligned whole. Repeated
rows are documents of their own, each counts, and a null doc_id is an id like any other. Pairs that tie for
their A id's highest count are all best. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.llm.encoding import LONGEST, PartEncoder, byte_entries, gathered
from recordloom.llm.frequent import FREQUENT, split
from recordloom.llm.textops import span_hashes, utf8_slices
from recordloom.operators.storage import materialize

#: Parts a worker keeps; beyond them it begins anew.
KEPT_PARTS = 200_000
SLICE_BYTES = 1 << 19
_PARTS_A_CALL = 2048
#: Links of a slice that are listed one by one.
_LISTED = 64
#: Bits of a B id in a pair: pair = A id << PAIR_BITS | B id.
PAIR_BITS = 20

ALIGNED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"


class PieceParts:
    """Parts of texts to the ids of a SentencePiece model, as they have them inside a text."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.spelled: list[bytes] = []
        pieces = []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            if self.model.is_byte(i):
                self.spelled.append(bytes([int(piece[3:5], 16)]))
            else:
                self.spelled.append(piece.replace("▁", " ").encode())
                if not (self.model.is_control(i) or self.model.is_unknown(i)):  # no text is encoded as these
                    pieces.append(piece)
        self.line = self.spelled.index(b"\n")
        crossing = any("\n" in p or "▁" in p.lstrip("▁") for p in pieces)
        if crossing or any(a.isascii() and a.isalpha() and b.isascii() and not b.isalnum() for p in pieces for a, b in zip(p, p[1:], strict=False)):
            raise ValueError("a piece reaches over a place where texts are cut")

    def encode(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all parts, joined, and how many each has: many in one call, between line breaks, over which no piece reaches."""
        ids, counts = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for at in range(0, len(parts), _PARTS_A_CALL):
            some = parts[at : at + _PARTS_A_CALL]
            found = np.array(self.model.encode("\n" + "\n".join(some) + "\n", num_threads=1), dtype=np.int64)
            breaks = np.flatnonzero(found == self.line)
            between = breaks[np.cumsum([0, *(1 + p.count("\n") for p in some)])]
            inside = np.ones(len(found), dtype=bool)
            inside[: between[0]] = False  # the mark that the library puts before every text
            inside[between] = False
            ids.append(found[inside])
            counts.append(np.diff(between) - 1)
        return np.concatenate(ids), np.concatenate(counts)


def align(a_sizes: np.ndarray, b_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where tokens of two tokenizations of the same bytes, given by their sizes, end together: the end, and how many tokens of each there are by then."""
    a_index = dict(zip(np.cumsum(a_sizes).tolist(), range(1, len(a_sizes) + 1), strict=True))
    b_index = dict(zip(np.cumsum(b_sizes).tolist(), range(1, len(b_sizes) + 1), strict=True))
    common = sorted(a_index.keys() & b_index.keys())
    return np.array(common, dtype=np.int64), *(np.fromiter(map(index.__getitem__, common), dtype=np.int64, count=len(common)) for index in (a_index, b_index))


def links(a: np.ndarray, b: np.ndarray, a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The links of slices that end at these indices: group, pair, times. A large slice's repeated ids are multiplied, not listed."""
    a_begins, b_begins = (np.concatenate([[0], e[:-1]]) if len(e) else e for e in (a_ends, b_ends))
    n_a, n_b = a_ends - a_begins, b_ends - b_begins
    small = np.flatnonzero(n_a * n_b <= _LISTED)
    owner = np.repeat(small, (n_a * n_b)[small])
    within = np.arange(len(owner)) - np.repeat(np.cumsum((n_a * n_b)[small]) - (n_a * n_b)[small], (n_a * n_b)[small])
    pairs = a[a_begins[owner] + within // n_b[owner]] << PAIR_BITS | b[b_begins[owner] + within % n_b[owner]]
    groups, found, times = [owner], [pairs], [np.ones(len(pairs), dtype=np.int64)]
    for k in np.flatnonzero(n_a * n_b > _LISTED).tolist():
        (x, n), (y, m) = (np.unique(v, return_counts=True) for v in (a[a_begins[k] : a_ends[k]], b[b_begins[k] : b_ends[k]]))
        found.append((x[:, None] << PAIR_BITS | y).ravel())
        times.append((n[:, None] * m).ravel())
        groups.append(np.full(len(found[-1]), k))
    return np.concatenate(groups), np.concatenate(found), np.concatenate(times)


class Aligner:
    """Alignments of texts; those of distinct parts are kept."""

    def __init__(self, a_path: str, b_path: str, kept: int = KEPT_PARTS) -> None:
        self.a, self.b = PartEncoder(a_path, True, spelled=True), PieceParts(b_path)
        self.a_spelled = byte_entries(self.a.tokenizer)
        self.a_sizes, self.b_sizes = (np.array([len(t) for t in v], dtype=np.int64) for v in (self.a_spelled, self.b.spelled))
        if len(self.b_sizes) > 1 << PAIR_BITS:
            raise ValueError("the second vocabulary is too large for packed pairs")
        self.kept = kept
        self._forget()

    def _forget(self) -> None:
        self.known: dict[int, int] = {}
        self.n = self.n_pairs = 0
        self.heads = np.zeros((1 << 14, 4), dtype=np.int64)  # n_a, n_b, n_groups, n_links; -1: B's bytes differ
        self.starts, self.counts = (np.zeros(1 << 14, dtype=np.int64) for _ in range(2))
        self.texts = np.empty(1 << 14, dtype=object)
        self.pairs, self.times = (np.zeros(1 << 16, dtype=np.int64) for _ in range(2))

    def _learn(self, parts: list[bytes]) -> None:
        """Align new parts, all at once: their joined bytes are one text, of which every part's end is a common end."""
        texts = [p.decode() for p in parts]
        own = self.a.found(texts)
        a, a_counts = np.concatenate([np.zeros(0, dtype=np.int64), *own]).astype(np.int64), np.fromiter(map(len, own), dtype=np.int64, count=len(own))
        b, b_counts = self.b.encode(texts)
        good = np.ones(len(parts), dtype=bool)
        for ids, counts, spelled in ((a, a_counts, self.a_spelled), (b, b_counts, self.b.spelled)):
            said = [spelled[i] for i in ids.tolist()]
            if b"".join(said) != b"".join(parts):
                edges = np.concatenate([[0], np.cumsum(counts)]).tolist()
                good &= np.array([b"".join(said[x:y]) == p for x, y, p in zip(edges[:-1], edges[1:], parts, strict=True)])
        if not good.all():
            a, b = a[np.repeat(good, a_counts)], b[np.repeat(good, b_counts)]
        sizes = np.array([len(p) for p in parts], dtype=np.int64) * good
        ends, a_ends, b_ends = align(self.a_sizes[a], self.b_sizes[b])
        owner = np.searchsorted(np.cumsum(sizes), ends)  # a bad part has no byte, so no end falls on it
        group, pairs, times = links(a, b, a_ends, b_ends)
        order = np.argsort(owner[group], kind="stable")
        group, pairs, times = group[order], pairs[order], times[order]
        n, k = len(parts), self.n
        n_links = np.bincount(owner[group], weights=times, minlength=n).astype(np.int64)
        heads = np.stack([a_counts, b_counts, np.bincount(owner, minlength=n), n_links], axis=1)
        heads[~good] = -1
        self._reserve(n, len(pairs))
        self.heads[k : k + n] = heads
        self.counts[k : k + n] = np.bincount(owner[group], minlength=n)
        self.starts[k : k + n] = self.n_pairs + np.cumsum(self.counts[k : k + n]) - self.counts[k : k + n]
        self.pairs[self.n_pairs : self.n_pairs + len(pairs)], self.times[self.n_pairs : self.n_pairs + len(pairs)] = pairs, times
        self.texts[k : k + n] = self._spelled_groups(a, b, a_ends, b_ends, np.cumsum(np.bincount(owner, minlength=n)))
        self.n, self.n_pairs = k + n, self.n_pairs + len(pairs)

    def _spelled_groups(self, a: np.ndarray, b: np.ndarray, a_ends: np.ndarray, b_ends: np.ndarray, part_ends: np.ndarray) -> list[bytes]:
        x, y, said = 0, 0, []
        a_said, b_said = [str(i) for i in a.tolist()], [str(i) for i in b.tolist()]
        for i, j in zip(a_ends.tolist(), b_ends.tolist(), strict=True):
            said.append(f"{a_said[x]}|{b_said[y]}" if i == x + 1 and j == y + 1 else f"{','.join(a_said[x:i])}|{','.join(b_said[y:j])}")
            x, y = i, j
        edges = [0, *part_ends.tolist()]
        return [";".join(said[e:f]).encode() for e, f in zip(edges[:-1], edges[1:], strict=True)]

    def _reserve(self, parts: int, pairs: int) -> None:
        while self.n + parts > len(self.starts):
            self.heads, self.starts, self.counts, self.texts = (np.concatenate([v, np.empty_like(v)]) for v in (self.heads, self.starts, self.counts, self.texts))
        while self.n_pairs + pairs > len(self.pairs):
            self.pairs, self.times = (np.concatenate([v, np.empty_like(v)]) for v in (self.pairs, self.times))

    def _numbers(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, int]:
        """The number of each part, and how many numbers are kept; those from there on are of long parts."""
        hashes = span_hashes(data, starts, ends)
        distinct, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        if self.n + len(distinct) > self.kept:
            self._forget()
        long = ends[first] - starts[first] > LONGEST
        get = self.known.get
        found = np.fromiter((get(h, -1) for h in distinct.tolist()), dtype=np.int64, count=len(distinct))
        held, kept = data.tobytes(), self.n
        for some, stay in ((np.flatnonzero((found < 0) & ~long), True), (np.flatnonzero(long), False)):
            begin = self.n
            at = first[some]
            self._learn([held[x:y] for x, y in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])
            found[some] = np.arange(begin, self.n)
            if stay:
                self.known.update(zip(distinct[some].tolist(), range(begin, self.n), strict=True))
                kept = self.n
        return found[back], kept

    def slice(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: n_a, n_b, n_groups, n_links; the digest; and the distinct pairs, their times, and the bounds of each text's."""
        n = len(offsets) - 1
        sizes = np.diff(offsets)
        data = np.insert(data, offsets[:-1][sizes > 0], 32)
        offsets = offsets + np.concatenate([[0], np.cumsum(sizes > 0)])
        if not len(data):
            return np.zeros((n, 4), dtype=np.int64), [""] * n, *(np.zeros(0, dtype=np.int64),) * 2, np.zeros(n + 1, dtype=np.int64)
        starts, ends, rows = self.a.parts(data, offsets)
        numbers, kept = self._numbers(data, starts, ends)
        heads = self.heads[numbers]
        bad = np.unique(rows[heads[:, 0] < 0])
        good = ~np.isin(rows, bad)
        numbers, rows, heads = numbers[good], rows[good], heads[good]
        bounds = np.searchsorted(rows, np.arange(n + 1))
        sums = np.concatenate([np.zeros((1, 4), dtype=np.int64), np.cumsum(heads, axis=0)])
        texts = self.texts[numbers].tolist()
        digests = [hashlib.sha256(b";".join(texts[x:y])).hexdigest() if y > x else "" for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        counts = self.counts[numbers]
        pairs, times = (gathered(self.starts[numbers], counts, v) for v in (self.pairs, self.times))
        owners = np.repeat(rows, counts)
        order = np.lexsort((pairs, owners))
        pairs, times, owners = pairs[order], times[order], owners[order]
        first = np.flatnonzero(np.concatenate([[True], (pairs[1:] != pairs[:-1]) | (owners[1:] != owners[:-1])])) if len(pairs) else np.zeros(0, dtype=np.int64)
        merged = np.add.reduceat(times, first) if len(first) else times
        if self.n > kept:  # long parts stay for this slice only
            self.n, self.n_pairs = kept, int(self.starts[kept])
        return sums[bounds[1:]] - sums[bounds[:-1]], digests, pairs[first], merged, np.searchsorted(owners[first], np.arange(n + 1))


@functools.lru_cache(maxsize=2)
def aligner(a_path: str, b_path: str) -> Aligner:
    """One for each Python worker."""
    return Aligner(a_path, b_path)


def aligned(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Every row's alignment, with its distinct pairs and how often each is linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, row = aligner(a_path, b_path), TaskContext.get().partitionId() << 40
        for batch in batches:
            for begin, end, data, offsets in utf8_slices(batch["text"], SLICE_BYTES):
                heads, digests, pairs, times, bounds = one.slice(data, offsets)
                lists = [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(v)) for v in (pairs, times)]
                rows = pa.array(np.arange(row, row + end - begin))
                row += end - begin
                yield pa.RecordBatch.from_arrays([rows, batch["doc_id"].slice(begin, end - begin).cast(pa.int64()), *map(pa.array, heads.T.copy()), pa.array(digests, pa.string()), *lists], [f.split()[0] for f in ALIGNED.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, ALIGNED)


def pair_counts(found: DataFrame) -> DataFrame:
    """(pair, n, best): the documents that hold each pair linked, and whether no pair of its A id has more."""
    counts = materialize(found.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")), "pair-counts")
    own = F.shiftright("pair", PAIR_BITS)
    most = counts.groupBy(own.alias("a")).agg(F.max("n").alias("most"))
    return counts.withColumn("a", own).join(materialize(most, "most"), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def scored(found: DataFrame, counts: DataFrame, limit: int = FREQUENT) -> DataFrame:
    """Add n_best and count_sum to ``found``: from broadcast counts for frequent pairs, by a join for the others."""
    often, rare = split(counts, limit)
    table = often.orderBy("pair").toPandas()  # at most ``limit`` rows
    keys, values, bests = table["pair"].to_numpy(np.int64), table["n"].to_numpy(np.int64), table["best"].to_numpy(bool)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs, times = batch["pairs"].flatten().to_numpy(), batch["times"].flatten().to_numpy()
            n = np.diff(np.asarray(batch["pairs"].offsets))
            at = np.minimum(np.searchsorted(keys, pairs), max(len(keys) - 1, 0))
            hit = keys[at] == pairs if len(keys) else np.zeros(len(pairs), dtype=bool)
            edges = np.concatenate([[0], np.cumsum(n)])

            def summed(v: np.ndarray, edges: np.ndarray = edges) -> np.ndarray:
                sums = np.concatenate([[0], np.cumsum(v)])
                return sums[edges[1:]] - sums[edges[:-1]]

            whole, best = np.zeros(len(pairs), dtype=np.int64), np.zeros(len(pairs), dtype=np.int64)
            whole[hit], best[hit] = times[hit] * values[at[hit]], times[hit] * bests[at[hit]]
            left = np.concatenate([[0], np.cumsum(summed(~hit))]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(left), pa.array(v[~hit])) for v in (pairs, times)]
            yield pa.RecordBatch.from_arrays([batch["row"], pa.array(summed(whole)), pa.array(summed(best)), *lists], ["row", "sum", "best", "pairs", "times"])

    some = found.filter("n_links > 0").select("row", "pairs", "times")
    some = materialize(some.mapInArrow(look, "row long, sum long, best long, pairs array<long>, times array<long>"), "frequent-sums")
    rest = some.filter(F.size("pairs") > 0).select("row", F.explode(F.arrays_zip("pairs", "times")).alias("v")).select("row", F.col("v.pairs").alias("pair"), F.col("v.times").alias("times"))
    joined = rest.join(materialize(rare, "rare-counts"), "pair")
    sums = joined.groupBy("row").agg(F.sum(F.col("times") * F.col("n")).alias("rare_sum"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("rare_best"))
    out = found.drop("pairs", "times").join(some.select("row", "sum", "best"), "row", "left").join(sums, "row", "left")

    def both(one: str, other: str):
        return F.coalesce(one, F.lit(0)) + F.coalesce(other, F.lit(0))

    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", both("best", "rare_best").alias("n_best"), both("sum", "rare_sum").alias("count_sum"), "groups_sha256")


def align_documents(docs: DataFrame, a_path: str, b_path: str, limit: int = FREQUENT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    found = materialize(aligned(docs, a_path, b_path), "aligned")
    return scored(found, materialize(pair_counts(found), "pairs"), limit)


def op13_cross_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return align_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), *paths)
