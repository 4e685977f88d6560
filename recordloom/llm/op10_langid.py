"""Language ID by rank-order profiles.

A profile is the PROFILE most frequent n-grams (1 to 3 bytes of lower-cased words, with a blank
for each word end) in order. A document's own profile, from its whole text, is compared with
each language's: the out-of-place distance sums the differences of ranks, PROFILE for an n-gram
that the language's profile lacks. The nearest language wins, ties go to the smaller name. The
score is the gap to the second nearest, as a share of it.

Language profiles are fitted on a bounded sample: about SAMPLE documents of each language, taken
by a hash of their ids out of all that may be learned from.

Nulls: documents with a null lang, doc_id or text are not learned from. A text that is null or
has no letter is ``und`` with score 0, and so is every text if nothing was learned. Equally frequent
n-grams are ranked by their bytes. A very long text is profiled whole. Repeated rows are judged
alike; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recordloom.llm.textops import utf8_slices
from recordloom.operators.ordering import percentile
from recordloom.operators.storage import materialize

PROFILE = 300
SAMPLE = 2000
UNKNOWN = "und"
#: Share of learned documents that fixes how far a text of a known language may be, and how much farther others may.
NEAR_SHARE, MARGIN = 0.999, 1.15
#: A mean distance up to this is never too far: related languages and few words are nearer.
NEVER_FAR = 200.0
#: Bytes of words: ASCII letters and everything beyond ASCII; a blank stands for the others.
_LETTERS = np.full(256, 32, dtype=np.uint8)
_LETTERS[97:123] = np.arange(97, 123)
_LETTERS[128:] = np.arange(128, 256)


def ngrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams of each row as (row, n-gram, count), sorted by row and n-gram."""
    n = len(offsets) - 1
    padded = np.full(len(data) + 2 * (n + 1), 32, dtype=np.int64)
    rows = np.repeat(np.arange(n), np.diff(offsets))
    padded[np.arange(len(data)) + 2 * (rows + 1)] = _LETTERS[data]
    owner = np.repeat(np.arange(n), np.diff(offsets) + 2)
    owner = np.concatenate([owner, [n, n]])
    word = padded != 32
    pairs, ends = padded[:-1] | padded[1:] << 8, word[:-1] | word[1:]
    grams = [padded[word], pairs[ends], (pairs[:-1] | padded[2:] << 16)[word[1:-1]]]
    owners = [owner[word], owner[1:][ends], owner[1:-1][word[1:-1]]]  # every n-gram counted here has a letter of its row there
    owners[1] = np.where(word[:-1][ends], owner[:-1][ends], owners[1])
    keys = np.sort(np.concatenate([g | o << 24 for g, o in zip(grams, owners, strict=True)]))
    edges = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[edges] >> 24, keys[edges] & 0xFFFFFF, np.diff(edges, append=len(keys))


def learnable(doc_id: Column) -> Column:
    return (F.crc32(doc_id.cast("string")) % 3 != 1) & doc_id.isNotNull()


def _learned(docs: DataFrame) -> DataFrame:
    return docs.filter(learnable(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")


def _sampled(docs: DataFrame, sample: int) -> DataFrame:
    """lang and text of about ``sample`` documents of each language; the languages' sizes are joined, whatever their number."""
    docs = _learned(docs)
    shares = docs.groupBy("lang").agg((1_000_003 * F.least(F.lit(1.0), sample / F.count("*"))).alias("share"))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003))
    return docs.join(materialize(shares, "shares"), "lang").filter(place < F.col("share")).select("lang", "text")


def profiles(docs: DataFrame, sample: int = SAMPLE) -> dict[str, np.ndarray]:
    """Language to its n-grams, most frequent first: PROFILE rows for each language reach the driver."""
    some = _sampled(docs, sample)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch["lang"].to_pylist(), dtype=object)
            for row, end, data, offsets in utf8_slices(pc.utf8_lower(batch["text"])):
                rows, grams, counts = ngrams(data, offsets)
                for lang in set(langs[row:end]):
                    own = np.flatnonzero(langs[row:end][rows] == lang)
                    distinct, at = np.unique(grams[own], return_inverse=True)
                    sums = np.bincount(at, weights=counts[own]).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(distinct), pa.string()), pa.array(distinct), pa.array(sums)], ["lang", "gram", "n"])

    counted = some.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = counted.withColumn("rank", rank).filter(F.col("rank") <= PROFILE).collect()
    found: dict[str, list] = {}
    for r in sorted(top, key=lambda r: (r["lang"], r["rank"])):
        found.setdefault(r["lang"], []).append(r["gram"])
    return {lang: np.array(grams, dtype=np.int64) for lang, grams in found.items()}


def distances(data: np.ndarray, offsets: np.ndarray, known: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Rows by languages: the out-of-place distance divided by the row's profile length."""
    n = len(offsets) - 1
    rows, grams, counts = ngrams(data, offsets)
    order = np.lexsort((grams, -counts, rows))
    rows, grams = rows[order], grams[order]
    sizes = np.bincount(rows, minlength=n)
    rank = np.arange(len(rows)) - np.concatenate([[0], np.cumsum(sizes)[:-1]])[rows]
    near = rank < PROFILE
    rows, grams, rank = rows[near], grams[near], rank[near]
    at = np.minimum(np.searchsorted(known, grams), len(known) - 1)
    held = known[at] == grams
    out = np.empty((n, places.shape[1]))
    for k in range(places.shape[1]):
        place = places[at, k]
        apart = np.where(held & (place >= 0), np.abs(place - rank), PROFILE)
        out[:, k] = np.bincount(rows, weights=apart, minlength=n)
    return out / np.maximum(np.minimum(sizes, PROFILE), 1)[:, None]


def _judge(texts: pa.Array, langs: list[str], known: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the nearest language (len(langs): unknown), score, and distance of each text to it, a mean over its n-grams."""
    lowered = pc.fill_null(pc.utf8_lower(texts), "")
    best, score, least = np.full(len(texts), len(langs), dtype=np.int64), np.zeros(len(texts)), np.full(len(texts), float(PROFILE))
    for row, end, data, offsets in utf8_slices(lowered):
        if not langs:
            break
        apart = distances(data, offsets, known, places)
        best[row:end] = apart.argmin(axis=1)
        two = np.sort(np.column_stack([apart, np.full(len(apart), float(PROFILE))]), axis=1)[:, :2]
        least[row:end] = two[:, 0]
        score[row:end] = 1 - two[:, 0] / np.maximum(two[:, 1], 1e-9)
    lettered = pc.match_substring_regex(lowered, r"\p{L}").to_numpy(zero_copy_only=False)
    best[~lettered] = len(langs)
    score[best == len(langs)] = 0
    return best, np.clip(score, 0, 1), least


def _table(found: dict[str, np.ndarray]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, all their n-grams sorted, and the rank of each n-gram in each language (-1: none)."""
    langs = sorted(found)
    known = np.unique(np.concatenate([*found.values(), np.zeros(1, dtype=np.int64)]))
    places = np.full((len(known), len(langs)), -1, dtype=np.int64)
    for k, lang in enumerate(langs):
        places[np.searchsorted(known, found[lang]), k] = np.arange(len(found[lang]))
    return langs, known, places


def identify(docs: DataFrame, found: dict[str, np.ndarray]) -> DataFrame:
    """``doc_id``, ``lang_pred`` and ``score`` for each row of ``docs``; reads the text only."""
    langs, known, places = _table(found)
    names = np.array([*langs, UNKNOWN], dtype=object)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, score, _ = _judge(batch["text"], langs, known, places)
            arrays = [batch["doc_id"].cast(pa.int64()), pa.array(names[best], pa.string()), pa.array(score)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(judge, "doc_id long, lang_pred string, score double")


def farthest(docs: DataFrame, found: dict[str, np.ndarray]) -> float:
    """The distance beyond which a text is in none of the languages: NEAR_SHARE of all documents that may be learned from are nearer, by 1 / MARGIN; NEVER_FAR at least."""
    langs, known, places = _table(found)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_judge(batch["text"], langs, known, places)[2])], ["apart"])

    apart = materialize(_learned(docs).select("text").mapInArrow(measure, "apart double"), "apart")
    limit = percentile(apart, "apart", NEAR_SHARE)
    return float(PROFILE) if limit is None else min(max(MARGIN * limit, NEVER_FAR), float(PROFILE))


def kept_documents(docs: DataFrame, found: dict[str, np.ndarray], limit: float = float(PROFILE), languages: list[str] | None = None) -> DataFrame:
    """The rows of ``docs`` in a learned language (one of ``languages``, if given), with all their columns, without a shuffle.

    A text without a letter goes, and so does one farther than ``limit`` from every profile: one in a
    language or script never learned, or no language at all. No row stays without profiles.
    """
    langs, known, places = _table(found)
    wanted = np.array([languages is None or lang in languages for lang in langs] + [False])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, _, apart = _judge(batch["text"], langs, known, places)
            yield batch.filter(pa.array(wanted[best] & (apart <= limit)))

    return docs.mapInArrow(keep, docs.schema)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    judged = identify(docs, profiles(docs))
    return judged.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
