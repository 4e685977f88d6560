"""Spelling variants by dense prefix-suffix tiling.

Words are the letter runs of all texts, A-Z lower-cased, one letter of a few runs deleted by a rule
on document and run. Those of MIN_LENGTH code points and MIN_COUNT occurrences are compared: two are
near if one letter inserted, deleted or replaced makes one the other, which leaves the first half
or the rest of the shorter word in place. So each word is a member of the groups of its halves (for
its own length, and as the longer word of the length below), and only members of a group are
compared. A group becomes a padded matrix of code points from the left and one from the right.
Comparing them column by column gives every pair's common prefix and suffix, and a pair is near if
both together reach the longer length minus one. A pair that shares both halves counts in the
group of its prefix.

A group of more than BLOCK members is cut into blocks by a hash of the word, and a task compares
two of them; small groups are put together by a hash. Each task returns its members' numbers of
near words and their best one, never pairs. Nothing is capped: a group's tiles grow with the square
of its blocks.

A word's form is its near word of the largest count (ties: the first in code-point order) if that
count is FACTOR times its own or more. Counts grow along forms, so following them ends; the last
is the word's root, found by doubling steps.

Nulls: a null or empty text has no words, and in rows with a null doc_id no letter is deleted.
Repeated rows count again. A very long text is read whole. Other columns are ignored. An empty
table gives no rows.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.llm.encoding import crc32_join, crc32_shifts
from recordloom.llm.textops import LOWER, byte_set, span_hashes, utf8_slices, word_spans
from recordloom.operators.storage import materialize

MIN_LENGTH, MIN_COUNT, FACTOR = 6, 5, 5
#: Fixed value: a letter is deleted where it divides the CRC-32 of document and run.
DELETE_EVERY = 199
#: Members of a block, rows of small groups in a task's call, and bytes of text taken at once.
BLOCK, CALL_ROWS = 1024, 8192
SLICE_BYTES = 1 << 20

_LETTERS = byte_set(range(0x41, 0x5B), range(0x61, 0x7B))
#: U+00C0 to U+00FF are this byte and one more.
_LATIN_LEAD = 0xC3


def letter_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every run of letters."""
    inside = _LETTERS[data] | (data == _LATIN_LEAD)
    inside[1:] |= data[:-1] == _LATIN_LEAD
    return word_spans(inside.view(np.uint8), offsets, _OUTSIDE)


#: Separators among flags that say whether a byte is inside a run.
_OUTSIDE = byte_set(range(0, 1))


@functools.lru_cache(maxsize=1)
def _shift_table() -> np.ndarray:
    return crc32_shifts(64)


def joined_crcs(first: np.ndarray, second: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The CRC-32 of pairs of joined strings, from those of the parts and the second's bytes."""
    table = _shift_table()
    out = np.zeros(len(first), dtype=np.int64)
    short = sizes < len(table)
    a, b, n = first[short], second[short], sizes[short]
    moved = table[n, 0, a & 255] ^ table[n, 1, a >> 8 & 255] ^ table[n, 2, a >> 16 & 255] ^ table[n, 3, a >> 24]
    out[short] = moved ^ b
    rest = np.flatnonzero(~short)
    out[rest] = [crc32_join(x, y, k) for x, y, k in zip(first[rest].tolist(), second[rest].tolist(), sizes[rest].tolist(), strict=True)]
    return out


def counted_words(ids: list[int | None], data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], list[int]]:
    """The words of a slice of texts, long enough, and how often each stands there; a word may come twice."""
    data = LOWER[data]
    starts, ends, rows = letter_runs(data, offsets)
    _, first, run = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
    held = data.tobytes()
    runs = [held[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
    crcs = np.array([zlib.crc32(r) for r in runs], dtype=np.int64)
    sizes = ends[first] - starts[first]
    length = np.array([len(r) - r.count(b"\xc3") for r in runs], dtype=np.int64)
    keys, times = np.unique(rows << 32 | run, return_counts=True)
    row, run = keys >> 32, keys & 0xFFFFFFFF
    named = np.array([0 if i is None else zlib.crc32(f"{i}:".encode()) for i in ids], dtype=np.int64)
    there = np.array([i is not None for i in ids], dtype=bool)
    crc = joined_crcs(named[row], crcs[run], sizes[run])
    cut = (crc % DELETE_EVERY == 0) & there[row]
    counts = np.bincount(run[~cut], weights=times[~cut], minlength=len(runs)).astype(np.int64)
    kept = np.flatnonzero((counts > 0) & (length >= MIN_LENGTH))
    words, n = [runs[k].decode() for k in kept.tolist()], counts[kept].tolist()
    for k in np.flatnonzero(cut & (length[run] > MIN_LENGTH)).tolist():
        word = runs[run[k]].decode()
        at = int(crc[k]) % len(word)
        words.append(word[:at] + word[at + 1 :])
        n.append(int(times[k]))
    return words, n


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of all words of at least MIN_LENGTH code points and MIN_COUNT occurrences."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch["doc_id"].to_pylist()
            for begin, end, data, offsets in utf8_slices(batch["text"], SLICE_BYTES):
                words, n = counted_words(ids[begin:end], data, offsets)
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(n, pa.int64())], ["word", "n"])

    sums = docs.select("doc_id", "text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return sums.filter(F.col("n") >= MIN_COUNT)


def _half_keys(words: DataFrame) -> DataFrame:
    """(word, n, len, least, side, key): the groups of each word; ``least`` is the shorter length of the pairs there."""
    size = F.length("word")
    sized = words.withColumn("len", size).withColumn("least", F.explode(F.filter(F.array(size, size - 1), lambda m: m >= MIN_LENGTH)))
    half = F.floor(F.col("least") / 2).cast("int")
    halves = F.array(
        F.struct(F.lit("P").alias("side"), F.substring(F.col("word"), F.lit(1), half).alias("key")),
        F.struct(F.lit("S").alias("side"), F.substring(F.col("word"), F.col("len") - F.col("least") + half + 1, F.col("least") - half).alias("key")),
    )
    return sized.select("word", "n", "len", "least", F.inline(halves))


def _common(left: np.ndarray, right: np.ndarray, columns: range) -> np.ndarray:
    """How many of the columns, from the first on, each row of ``left`` shares with each of ``right``."""
    alive = np.ones((len(left), len(right)), dtype=bool)
    shared = np.zeros(alive.shape, dtype=np.int16)
    for c in columns:
        alive &= left[:, c][:, None] == right[:, c][None, :]
        shared += alive
    return shared


class _Tile:
    """Members of one group in one or two blocks."""

    def __init__(self, words: list[str], n: np.ndarray, least: int, side: str) -> None:
        self.n, self.least, self.side = n, least, side
        self.size = np.array(list(map(len, words)), dtype=np.int64)
        width = least + 1
        self.left = np.array(words, dtype=f"U{width}").view(np.uint32).reshape(len(words), width)
        at = np.arange(width) - (width - self.size)[:, None]
        self.right = np.where(at < 0, 0, np.take_along_axis(self.left, np.maximum(at, 0), axis=1))
        order = sorted(range(len(words)), key=lambda i: (-n[i], words[i]))
        self.order = np.array(order, dtype=np.int64)
        self.rank = np.empty(len(words), dtype=np.int64)
        self.rank[self.order] = np.arange(len(words))
        self.near = np.zeros(len(words), dtype=np.int64)
        self.best = np.full(len(words), len(words), dtype=np.int64)

    def compare(self, rows: np.ndarray, columns: np.ndarray, both: bool) -> None:
        """Note the near pairs of ``rows`` (of the shorter length) and ``columns``, for the columns too if ``both``."""
        if not len(rows) or not len(columns):
            return
        m = self.least
        prefix = _common(self.left[rows], self.left[columns], range(m))
        suffix = _common(self.right[rows], self.right[columns], range(m, 0, -1))
        near = prefix + suffix >= np.maximum(m, self.size[columns]) - 1
        near &= rows[:, None] != columns[None, :]
        if self.side == "S":
            near &= prefix < m // 2  # else it is a pair of the prefix's group
        i, j = np.nonzero(near)
        i, j = rows[i], columns[j]
        for one, other in ((i, j), (j, i))[: 1 + both]:
            self.near += np.bincount(one, minlength=len(self.near))
            np.minimum.at(self.best, one, self.rank[other])


def compare_tiles(table: pa.Table) -> pa.Table:
    """Of each member with a near word in its tile: word, n_near, minus the best one's count, and the best one."""
    two = table["first"][0].as_py() != table["second"][0].as_py()
    words = table["word"].to_pylist()
    n, least, block = (table[c].to_numpy() for c in ("n", "least", "block"))
    named: dict[tuple, list[int]] = {}
    for k, key in enumerate(zip(least.tolist(), table["side"].to_pylist(), table["key"].to_pylist(), strict=True)):
        named.setdefault(key, []).append(k)
    out: list[tuple] = []
    for (m, side, _), own in named.items():
        at = np.array(own)
        tile = _Tile([words[k] for k in own], n[at], m, side)
        short, every = tile.size == m, np.arange(len(own))
        if two:
            one = block[at] == table["first"][0].as_py()
            tile.compare(every[short & one], every[~one], both=True)
            tile.compare(every[short & ~one], every[one & ~short], both=True)
        else:
            tile.compare(every[short], every[short], both=False)
            tile.compare(every[short], every[~short], both=True)
        for k in np.flatnonzero(tile.near).tolist():
            best = own[tile.order[tile.best[k]]]
            out.append((words[own[k]], int(tile.near[k]), -int(n[best]), words[best]))
    columns = list(zip(*out, strict=True)) or [()] * 4
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["word", "n_near", "minus_n", "best"])


def near_words(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """(word, n_near, form, form_n) of the words with a near one; ``form`` is its best near word, whatever its count."""
    keyed = materialize(_half_keys(words), "half-keys")
    sizes = keyed.groupBy("least", "side", "key").agg(F.count("*").alias("members"), F.count_if(F.col("len") == F.col("least")).alias("short"))
    sizes = sizes.filter("members > 1 and short > 0").select("least", "side", "key", F.ceil(F.col("members") / block).cast("int").alias("cuts"))
    members = keyed.join(materialize(sizes, "groups"), ["least", "side", "key"])
    members = materialize(members.withColumn("block", F.pmod(F.xxhash64("word"), F.col("cuts")).cast("int")), "members")
    own = F.xxhash64("least", "side", "key")
    calls = max(1, members.count() // CALL_ROWS)
    dealt = members.withColumn("to", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    dealt = dealt.select(
        "word", "n", "least", "side", "key", "block",
        F.when(F.col("cuts") == 1, F.pmod(own, F.lit(calls))).otherwise(own).alias("call"),
        F.least("block", "to").alias("first"),
        F.greatest("block", "to").alias("second"),
    )
    found = dealt.groupBy("call", "first", "second").applyInArrow(compare_tiles, "word string, n_near long, minus_n long, best string")
    best = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct("minus_n", "best")).alias("b"))
    return best.select("word", "n_near", F.col("b.best").alias("form"), (-F.col("b.minus_n")).alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of rows (word, form): forms followed to the last, two steps, then four, then eight ..."""
    steps = materialize(forms.select("word", F.col("form").alias("root")), "steps")
    while True:
        on = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = materialize(steps.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "steps")
        steps = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return steps


def spelling_variants(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n."""
    words = materialize(word_counts(docs), "words")
    near = words.join(near_words(words, block), "word", "left")
    kept = F.col("form_n") >= FACTOR * F.col("n")
    formed = near.select("word", F.when(kept, F.col("form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(kept, F.col("form_n")).alias("form_n"))
    formed = materialize(formed, "forms")
    found = roots(formed.filter("form is not null"))
    return formed.join(found, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))
