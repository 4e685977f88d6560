"""Quality rules: base rules, and a log-likelihood ratio between trusted and raw n-grams.

Word unigrams and bigrams are hashed into BUCKETS features. Two smoothed multinomials are
counted over them: one over every document of the corpus, one over all trusted ones (labelled
quality 1). A document's score is the mean of log p_trusted - log p_raw over
its n-grams. It is kept if the score reaches a threshold that all but TRUSTED_LOSS of the
trusted documents that pass the base rules reach, less SLACK / sqrt(number of n-grams), the
spread that a short document's mean has. The same corpus gives the same decisions.

Nulls: a null text has no words. Empty and null texts fail the base rules. A null doc_id is
never trusted. Repeated rows are judged alike, and so are texts that tie: a score at the threshold is
kept. A very long text is counted whole. Other columns are ignored. Without labels, or with an empty table, the two multinomials are equal and only the base rules decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.llm.textops import BLANKS, byte_set, mix, ngram_hashes, span_hashes, utf8_slices, word_spans
from recordloom.operators.narrow import BROADCAST_KEYS, narrowed
from recordloom.operators.ordering import percentile
from recordloom.operators.storage import materialize

BUCKETS = 1 << 16
TRUSTED_LOSS = 0.001
SLACK = 1.0

WINDOW = 8
MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30
SYMBOLS = byte_set("#*$%&|<>")
_NOT_BREAK = byte_set("\n")

STATS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_grams long, score double"


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _repeats(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For keys of rows: whether each stands twice or more in its row, and whether it stood there earlier."""
    own = mix(keys ^ mix(rows.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(own, kind="stable")
    same = own[order][1:] == own[order][:-1]
    later = np.zeros(len(keys), dtype=bool)
    later[order[1:]] = same
    twice = later.copy()
    twice[order[:-1]] |= same
    return twice, later


def base_counts(data: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each row; the words' hashes and rows."""
    n = len(offsets) - 1
    starts, ends, rows = word_spans(data, offsets, BLANKS)
    hashes = span_hashes(data, starts, ends)
    n_words = np.bincount(rows, minlength=n)
    chars = _per_row(((data & 0xC0) != 0x80) & ~BLANKS[data], offsets)
    symbols = _per_row(SYMBOLS[data], offsets)
    line_starts, line_ends, line_rows = word_spans(data, offsets, _NOT_BREAK)
    worded = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_starts, line_ends, line_rows = line_starts[worded], line_ends[worded], line_rows[worded]
    _, later = _repeats(span_hashes(data, line_starts, line_ends), line_rows)
    dup_lines = np.bincount(line_rows[later], minlength=n)
    repeated = np.zeros(n, dtype=np.int64)
    windows = np.flatnonzero(rows[: max(0, len(rows) - WINDOW + 1)] == rows[WINDOW - 1 :]) if len(rows) >= WINDOW else np.zeros(0, dtype=np.int64)
    if len(windows):
        keys, owners = ngram_hashes(hashes, rows, WINDOW)
        twice, _ = _repeats(keys, owners)
        cover = np.zeros(len(rows) + 1, dtype=np.int64)
        np.add.at(cover, windows[twice], 1)
        np.add.at(cover, windows[twice] + WINDOW, -1)
        repeated = np.bincount(rows[np.cumsum(cover)[:-1] > 0], minlength=n)
    return [n_words, chars, symbols, dup_lines, repeated], hashes, rows


def features(hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of every word and pair of adjacent words."""
    pairs, owners = ngram_hashes(hashes, rows, 2)
    grams = np.concatenate([hashes, pairs])
    return (grams >> np.uint64(48)).astype(np.int64) % BUCKETS, np.concatenate([rows, owners])


def trusted_ids(labels: DataFrame) -> DataFrame:
    """All ids labelled quality 1."""
    return materialize(labels.filter("quality = 1 and doc_id is not null").select("doc_id").distinct(), "trusted")


def trusted_rows(docs: DataFrame, ids: DataFrame, limit: int = BROADCAST_KEYS) -> DataFrame:
    """The rows of ``docs`` with one of the ids; beyond what may be broadcast, rows that a filter of fixed size lets through are shuffled."""
    rows = narrowed(docs, ids, ["doc_id"], limit)
    return rows if ids.limit(limit + 1).count() <= limit else rows.join(ids, "doc_id", "left_semi")


def trusted_counts(docs: DataFrame, ids: DataFrame, limit: int = BROADCAST_KEYS) -> np.ndarray:
    """``feature_counts`` of the rows with one of the ids, without a shuffle of their texts: what the filter lets through, less the few rows that it should not have."""
    rows = narrowed(docs, ids, ["doc_id"], limit)
    if ids.limit(limit + 1).count() <= limit:
        return feature_counts(rows)
    strangers = materialize(rows.select("doc_id").distinct().join(ids, "doc_id", "left_anti"), "strangers")
    return feature_counts(rows) - feature_counts(trusted_rows(docs, strangers))


def feature_counts(docs: DataFrame) -> np.ndarray:
    """Counts of each bucket over all rows; BUCKETS sums at most reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            for _, _, data, offsets in utf8_slices(batch["text"]):
                starts, ends, rows = word_spans(data, offsets, BLANKS)
                sums += np.bincount(features(span_hashes(data, starts, ends), rows)[0], minlength=BUCKETS)
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sums[some])], ["bucket", "n"])

    sums = docs.select("text").mapInArrow(count, "bucket long, n long")
    rows = sums.groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(BUCKETS)
    out[rows["bucket"]] = rows["n"]
    return out


def log_ratios(raw: np.ndarray, good: np.ndarray) -> np.ndarray:
    if good.sum() == 0:
        return np.zeros(BUCKETS)
    return np.log((good + 0.5) / (good.sum() + 0.5 * BUCKETS)) - np.log((raw + 0.5) / (raw.sum() + 0.5 * BUCKETS))


def _stats(texts: pa.Array, ratios: np.ndarray) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_grams and score of each text."""
    parts: list[list[np.ndarray]] = [[np.zeros(0, dtype=np.int64)] for _ in range(6)] + [[np.zeros(0)]]
    for row, end, data, offsets in utf8_slices(texts):
        counts, hashes, rows = base_counts(data, offsets)
        buckets, owners = features(hashes, rows)
        n_grams = np.bincount(owners, minlength=end - row)
        sums = np.bincount(owners, weights=ratios[buckets], minlength=end - row)
        for part, values in zip(parts, [*counts, n_grams, sums / np.maximum(n_grams, 1)], strict=True):
            part.append(values)
    return [np.concatenate(p) for p in parts]


def _scored(docs: DataFrame, ratios: np.ndarray) -> DataFrame:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrays = [batch["doc_id"].cast(pa.int64()), *map(pa.array, _stats(batch["text"], ratios))]
            yield pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in STATS.split(", ")])

    scored = docs.select("doc_id", "text").mapInArrow(score, STATS)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    fair = F.col("score") + SLACK / F.sqrt(F.greatest("n_grams", F.lit(1)))
    return scored.withColumn("base_failed", failed).withColumn("fair", fair)


def _least(trusted: DataFrame) -> float:
    """The score that all but TRUSTED_LOSS of the trusted documents reach, exactly. Any score will do without them."""
    found = percentile(materialize(trusted.filter("not base_failed").select("fair"), "fair"), "fair", TRUSTED_LOSS)
    return -1e300 if found is None else found


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the base counts, n_grams, score, base_failed and kept for each row of ``docs``."""
    ids = trusted_ids(labels)
    scored = materialize(_scored(docs, log_ratios(feature_counts(docs), trusted_counts(docs, ids))), "quality")
    kept = ~F.col("base_failed") & (F.col("fair") >= F.lit(_least(scored.join(ids, "doc_id", "left_semi"))))
    return scored.withColumn("kept", kept).drop("fair")


def kept_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``quality`` keeps, with all their columns, without a shuffle of texts."""
    ids = trusted_ids(labels)
    ratios = log_ratios(feature_counts(docs), trusted_counts(docs, ids))
    scored = materialize(_scored(narrowed(docs, ids, ["doc_id"]), ratios), "trusted-scores")
    least = _least(scored.join(ids, "doc_id", "left_semi"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, _, _, _, n_repeated, n_grams, score = _stats(batch["text"], ratios)
            failed = (n_words < MIN_WORDS) | (100 * n_repeated > MAX_REPEATED_PERCENT * n_words)
            yield batch.filter(pa.array(~failed & (score + SLACK / np.sqrt(np.maximum(n_grams, 1)) >= least)))

    return docs.mapInArrow(keep, docs.schema)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
