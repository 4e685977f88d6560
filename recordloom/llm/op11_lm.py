"""Language-model scores by online logistic context mixing (see ``bitmodel``).

A text, A-Z lower-cased, is cut into units: a word and the blanks after it. The corpus's distinct
units with their counts in the training documents are gathered by a shuffle; from this table, which
grows with the corpus, come both the base's word counts and the model: hashed tables of bit counts
(each task adds up its units, and the tables are added slot range by slot range), then the mixing
weights, which every task learns online over its units with each observation left out of its own
prediction, and which are averaged by what their gates have seen. Each distinct unit is scored once.

A document refines the model as it goes. The corpus as a whole, and each of at most CLASSES groups of
its training documents (by ``group``, the language unless told otherwise; never an input of a score), backs
its own counts of whole units with the bit model: (n + T p) / (N + T), where T distinct units make N. Beside
it there is the document's own past, which gives a unit that has come k times among t units
k / (t + MEMORY). Each of these corpora, mixed with the past by each of the weights MEMORIES, is one
predictor, and a document starts with equal belief in each and moves its belief with every unit by how
well each did (a Bayesian mixture, so the text's probability is the mean over them). The score is the
log10 probability of all bytes and of the text's end, and bits_per_byte follows.

Scores come back to the documents by ``frequent``: the values of frequent units are broadcast,
those of rare ones joined by document and unit.

Nulls: a document with a null group belongs to the corpus as a whole alone. A null or empty text is the end alone. A row with a null doc_id counts as held out. Repeated rows
count again and score alike. A very long text is read whole, and so is a word of any length. Without
training documents every count is 0 and the model has even odds. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recordloom.llm.bitmodel import END, GATES, INPUTS, REFINE, SLOTS, Events, Mixer, coded, count
from recordloom.llm.frequent import FREQUENT, split
from recordloom.llm.textops import BLANKS, LOWER, span_hashes, utf8_slices, word_spans
from recordloom.operators.storage import materialize

#: Folds of documents by the CRC-32 of their id, and the one that is not learned from.
FOLDS, HELD_OUT = 5, 1
MEMORY = 10.0
MEMORIES = (0.02, 0.1, 0.25, 0.5)
#: Groups of training documents with counts of their own: the largest, so that a unit's counts fit a row.
CLASSES = 8
#: Units whose values are broadcast at most.
BROADCAST = FREQUENT // 2
SLICE_BYTES = 1 << 20
#: Bytes of units modelled at once, and slots of the tables in a row of partial sums.
BATCH_BYTES, CHUNK = 1 << 14, 1 << 14
#: Units that one learner of weights follows.
LEARNER_UNITS = 1 << 18
_BLANK_CHARS = " \t\n\v\f\r"


def _predictors(n_classes: int) -> list[str]:
    """Columns of sums: one for each corpus (all, then the classes) and weight of the past."""
    return [f"s{e}_{k}" for e in range(n_classes + 1) for k in range(len(MEMORIES))]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(True))


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, row of every unit in order, and whether it has a word. A text's own blanks at its start and its bare end have none."""
    starts, ends, rows = word_spans(data, offsets, BLANKS)
    n = len(offsets) - 1
    first = np.searchsorted(rows, np.arange(n + 1))
    begins, stops = offsets[:-1], offsets[1:]
    # a unit reaches to the next word of its text or the text's end
    reach = np.append(starts[1:], 0)[: len(starts)]
    last = first[1:][first[1:] > first[:-1]] - 1
    reach[last] = stops[rows[last]]
    some = first[1:] > first[:-1]
    leading = np.full(n, -1)
    leading[some] = starts[first[:-1][some]]
    leading[~some] = stops[~some]
    lead = np.flatnonzero(leading > begins)
    bare = np.ones(n, dtype=bool)  # the end follows a blank, or is all there is
    bare[some] = ends[last] < stops[some]
    bare = np.flatnonzero(bare)
    starts = np.concatenate([starts, begins[lead], stops[bare]])
    reach = np.concatenate([reach, leading[lead], stops[bare]])
    word = np.concatenate([np.ones(len(rows), dtype=bool), np.zeros(len(lead) + len(bare), dtype=bool)])
    rows = np.concatenate([rows, lead, bare])
    order = np.lexsort((reach, starts, rows))
    return starts[order], reach[order], rows[order], word[order]


def _distinct(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The distinct spans, and the number of each span's."""
    _, first, number = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
    held = data.tobytes()
    return [held[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)], number


def classes_of(docs: DataFrame, group: Column) -> list:
    """At most CLASSES values of ``group``: those of the most training documents."""
    sizes = docs.filter(~held_out(F.col("doc_id"))).groupBy(group.cast("string").alias("group")).agg(F.count("*").alias("n")).filter("group is not null")
    return [r["group"] for r in sizes.orderBy(F.desc("n"), "group").limit(CLASSES).collect()]


def unit_counts(docs: DataFrame, group: Column | None = None, classes: list | None = None) -> DataFrame:
    """(unit, n, c, n0, n1, ...) of all documents' units: n in training documents (and in those of each class), c its word there (with any blanks); "" is a bare end."""
    classes = classes or []
    names = ["n", *(f"n{e}" for e in range(len(classes)))]
    number = F.array_position(F.array(*map(F.lit, classes)), group.cast("string")) if classes else F.lit(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            train = ~batch["held_out"].to_numpy(zero_copy_only=False)
            own = batch["class"].to_numpy(zero_copy_only=False)
            for row, end, data, offsets in utf8_slices(batch["text"], SLICE_BYTES):
                data = LOWER[data]
                starts, ends, rows, _ = units(data, offsets)
                found, number = _distinct(data, starts, ends)
                learned = train[row:end][rows]
                kind = own[row:end][rows][learned]
                n = np.bincount(number[learned] * (len(classes) + 1) + kind, minlength=len(found) * (len(classes) + 1)).reshape(len(found), -1)
                yield pa.RecordBatch.from_arrays([pa.array([u.decode() for u in found], pa.string()), pa.array(n.sum(axis=1)), *(pa.array(n[:, e + 1].copy()) for e in range(len(classes)))], ["unit", *names])

    rows = docs.select("text", held_out(F.col("doc_id")).alias("held_out"), F.coalesce(number, F.lit(0)).cast("long").alias("class"))
    sums = rows.mapInArrow(run, f"unit string, {', '.join(f'{c} long' for c in names)}")
    sums = sums.groupBy("unit").agg(*(F.sum(c).alias(c) for c in names)).withColumn("word", F.rtrim("unit", F.lit(_BLANK_CHARS)))
    return sums.select("unit", "n", F.when(F.col("word") != "", F.sum("n").over(Window.partitionBy("word"))).alias("c"), *names[1:])


def _batches(columns: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices of units as the model's bytes: END follows where no blank ends the unit."""
    for row, end, data, offsets in utf8_slices(columns["unit"], BATCH_BYTES):
        sizes = np.diff(offsets)
        bare = np.ones(len(sizes), dtype=bool)
        bare[sizes > 0] = ~BLANKS[data[offsets[1:][sizes > 0] - 1]]
        yield row, end, np.insert(data, offsets[1:][bare], END), offsets + np.concatenate([[0], np.cumsum(bare)])


def bit_tables(found: DataFrame) -> np.ndarray:
    """The coded counts of all slots: at most SLOTS of two bytes reach the driver, whatever the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(2 * SLOTS, dtype=np.int64)
        for batch in batches:
            n = batch["n"].to_numpy()
            for row, end, data, offsets in _batches(batch):
                count(Events(data, offsets), n[row:end], table)
        for k in range(0, SLOTS, CHUNK):
            part = table[2 * k : 2 * (k + CHUNK)]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([pa.compress(part.tobytes(), "zstd", asbytes=True)], pa.binary())], ["slot", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for slot, held in zip(batch["slot"].to_pylist(), batch["counts"].to_pylist(), strict=True):
                part = np.frombuffer(pa.decompress(held, 16 * min(CHUNK, SLOTS - slot), "zstd"), dtype=np.int64)
                sums[slot] = sums[slot] + part if slot in sums else part
        for slot, part in sums.items():
            codes = coded(part[0::2], part[1::2])
            yield pa.RecordBatch.from_arrays([pa.array([slot]), pa.array([codes.tobytes()], pa.binary())], ["slot", "codes"])

    parts = found.filter("n > 0").select("unit", "n").mapInArrow(run, "slot long, counts binary").repartition("slot")
    codes = np.zeros(SLOTS, dtype=np.uint16)
    for r in parts.mapInArrow(add, "slot long, codes binary").collect():
        codes[r["slot"] : r["slot"] + CHUNK] = np.frombuffer(r["codes"], dtype=np.uint16)
    return codes


def mixing_weights(found: DataFrame, codes) -> tuple[np.ndarray, np.ndarray]:
    """Weights by gate and the refining counts; ``codes`` is a broadcast of ``bit_tables``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def some():
            for batch in batches:
                n = batch["n"].to_numpy()
                for row, end, data, offsets in _batches(batch):
                    yield Events(data, offsets), n[row:end]

        mean, seen, refining = Mixer(codes.value).learn(some())
        gates = np.arange(GATES)
        lists = [pa.array((mean * seen[:, None]).tolist(), pa.list_(pa.float64())), pa.array(refining.reshape(GATES, -1).tolist(), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([pa.array(gates), pa.array(seen), *lists], ["gate", "seen", "weights", "refining"])

    # dealt and ordered by a hash alone, so that the same units give the same weights on any cluster
    learning = found.filter("n > 0").select("unit", "n")
    shards = max(1, learning.count() // LEARNER_UNITS)
    learning = learning.repartition(shards, "unit").sortWithinPartitions(F.xxhash64("unit"), "unit")
    learned = learning.mapInArrow(run, "gate long, seen double, weights array<double>, refining array<long>")
    sums = [F.sum("seen").alias("seen"), *(F.sum(F.col("weights")[i]).alias(f"w{i}") for i in range(INPUTS)), *(F.sum(F.col("refining")[i]).alias(f"r{i}") for i in range(2 * (REFINE + 1)))]
    weights, refining = Mixer(codes.value).weights, np.zeros((GATES, 2 * (REFINE + 1)), dtype=np.int64)
    for r in learned.groupBy("gate").agg(*sums).collect():
        if r["seen"] > 0:
            weights[r["gate"]] = [r[f"w{i}"] / r["seen"] for i in range(INPUTS)]
            refining[r["gate"]] = [r[f"r{i}"] for i in range(2 * (REFINE + 1))]
    return weights, refining.reshape(-1, 2)


def unit_logs(found: DataFrame, codes, weights: np.ndarray, refining: np.ndarray, totals: list[tuple[int, int]]) -> DataFrame:
    """(unit, n, c, logs): the natural log of each unit's probability in each corpus, whose (N, T) are ``totals``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixer = Mixer(codes.value)
        mixer.settle(weights, refining)
        for batch in batches:
            costs = [mixer.cost(Events(data, offsets), end - row) for row, end, data, offsets in _batches(batch)]
            spelled = -math.log(2) * np.concatenate([np.zeros(0), *costs])
            logs = np.empty((len(spelled), len(totals)))
            for e, (total, distinct) in enumerate(totals):
                n = batch["n" if e == 0 else f"n{e - 1}"].to_numpy()
                logs[:, e] = spelled
                if total:
                    with np.errstate(divide="ignore"):
                        logs[:, e] = np.logaddexp(np.log(n), spelled + math.log(distinct)) - math.log(total + distinct)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, logs.size + 1, len(totals)), pa.int32()), pa.array(logs.ravel()))
            yield pa.RecordBatch.from_arrays([batch["unit"], batch["n"], batch["c"], lists], ["unit", "n", "c", "logs"])

    return found.mapInArrow(run, "unit string, n long, c long, logs array<double>")


def _summed(logs: np.ndarray, memory: np.ndarray, rows: np.ndarray, n: int, fresh: np.ndarray) -> Iterator[np.ndarray]:
    """Sums by row of the log probabilities of units, for each corpus and weight of the past; logs[unit, corpus].

    ``fresh`` counts each row's units, these and all others, that the past doesn't know.
    """
    met = np.flatnonzero(memory > 0)
    again, own = rows[met], memory[met]
    for e in range(logs.shape[1]):
        mine = logs[:, e]
        plain = np.bincount(rows, weights=mine, minlength=n) - np.bincount(again, weights=mine[met], minlength=n)
        p = np.exp(mine[met])
        for share in MEMORIES:
            yield plain + fresh * math.log1p(-share) + np.bincount(again, weights=np.log((1 - share) * p + share * own), minlength=n)


def _memory(rows: np.ndarray, number: np.ndarray) -> np.ndarray:
    """k / (t + MEMORY) of each unit: how often it came before in its row, of t units."""
    order = np.argsort(rows.astype(np.int64) << 32 | number, kind="stable")
    key = (rows.astype(np.int64) << 32 | number)[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, dtype=np.int64)
    k = np.empty(len(key), dtype=np.float64)
    k[order] = np.arange(len(key)) - np.repeat(first, np.diff(np.append(first, len(key))))
    t = np.arange(len(rows)) - np.searchsorted(rows, rows)
    return k / (t + MEMORY)


def _row_schema(n_classes: int) -> str:
    sums = ", ".join(f"{s} double" for s in _predictors(n_classes))
    return f"row long, doc_id long, held_out boolean, n_bytes long, n_tokens long, known long, base double, {sums}, units array<string>, times array<long>, ratios array<array<double>>"


def document_sums(docs: DataFrame, often, norm: float, end_count: int, n_classes: int) -> DataFrame:
    """Per document: sums over its frequent units (``often``: a broadcast of them), and its rare units with how often each comes and its memories above 0."""
    schema = _row_schema(n_classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, c_of, logs_of = often.value
        at_row = TaskContext.get().partitionId() << 40
        end_base = math.log10((end_count + 0.5) / norm)
        for batch in batches:
            for row, end, data, offsets in utf8_slices(batch["text"], SLICE_BYTES):
                n = end - row
                data = LOWER[data]
                starts, ends, rows, word = units(data, offsets)
                found, number = _distinct(data, starts, ends)
                at = np.fromiter((index.get(u, -1) for u in found), dtype=np.int64, count=len(found))[number]
                memory = _memory(rows, number)
                hit = np.flatnonzero(at >= 0)
                tokens = hit[word[hit]]
                c = c_of[at[tokens]]
                base = np.bincount(rows[tokens], weights=np.log10((c + 0.5) / norm), minlength=n) + end_base
                known = np.bincount(rows[tokens], weights=c > 0, minlength=n).astype(np.int64) + (end_count > 0)
                fresh = np.bincount(rows[memory == 0], minlength=n)
                sums = _summed(logs_of[at[hit]], memory[hit], rows[hit], n, fresh)
                rare = np.flatnonzero(at < 0)
                key = rows[rare].astype(np.int64) << 32 | number[rare]
                order = np.argsort(key, kind="stable")
                key, own = key[order], rare[order]
                first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, dtype=np.int64)
                again = memory[own] > 0
                bounds = np.concatenate([[0], np.cumsum(again)])[np.append(first, len(key))]
                ratios = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(memory[own[again]]))
                times = pa.array(np.diff(np.append(first, len(key))))
                per_row = pa.array(np.searchsorted(rows[own[first]], np.arange(n + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(per_row, pa.array([found[k].decode() for k in number[own[first]].tolist()], pa.string())), pa.ListArray.from_arrays(per_row, times), pa.ListArray.from_arrays(per_row, ratios)]
                counts = np.bincount(rows[word], minlength=n) + 1
                plain = [pa.array(np.arange(at_row, at_row + n)), batch["doc_id"].slice(row, n).cast(pa.int64()), batch["held_out"].slice(row, n), *map(pa.array, (np.diff(offsets), counts, known, base, *sums))]
                at_row += n
                yield pa.RecordBatch.from_arrays([*plain, *lists], [f.split()[0] for f in schema.split(", ")])

    return docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")).mapInArrow(run, schema)


def _rare_sums(sums: DataFrame, rare: DataFrame, norm: float, n_classes: int) -> DataFrame:
    """What the rare units of each document add: to known, to base, to each corpus's sum of logs of units that the past doesn't know, and, of those that it knows, to each predictor."""
    held = sums.filter(F.size("units") > 0).select("row", F.explode(F.arrays_zip("units", "times", "ratios")).alias("u"))
    held = held.select("row", F.col("u.units").alias("unit"), F.col("u.times").alias("times"), F.col("u.ratios").alias("ratios"))
    rare = materialize(rare.select("unit", "c", "logs"), "rare-logs")
    corpora = range(n_classes + 1)
    joined = held.select("row", "unit", "times", (F.col("times") - F.size("ratios")).alias("fresh")).join(rare, "unit")
    known = F.when(F.col("c") > 0, F.col("times")).otherwise(0)
    base = F.when(F.col("c").isNotNull(), F.col("times") * F.log10((F.col("c") + 0.5) / norm)).otherwise(0.0)
    plain = joined.groupBy("row").agg(F.sum(known).alias("rare_known"), F.sum(base).alias("rare_base"), *(F.sum(F.col("fresh") * F.col("logs")[e]).alias(f"fresh{e}") for e in corpora))

    def mixture(e: int, share: float) -> Column:
        p = F.exp(F.col("logs")[e])
        return F.sum(F.aggregate("ratios", F.lit(0.0), lambda held, r: held + F.log((1 - share) * p + share * r)))

    # few rare units come twice in a document, so these sums, one for each predictor, are of few rows
    again = held.filter(F.size("ratios") > 0).join(rare, "unit").groupBy("row")
    again = again.agg(*(mixture(e, share).alias(f"again{e}_{k}") for e in corpora for k, share in enumerate(MEMORIES)))
    return plain.join(again, "row", "left")


def score_documents(docs: DataFrame, group: Column | None = None, limit: int = BROADCAST) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte."""
    context = docs.sparkSession.sparkContext
    classes = [] if group is None else classes_of(docs, group)
    found = materialize(unit_counts(docs, group, classes), "units")
    ends = docs.filter(~held_out(F.col("doc_id"))).count()
    words = found.filter("c is not null").select(F.rtrim("unit", F.lit(_BLANK_CHARS)).alias("word"), "n")
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_distinct(F.when(F.col("n") > 0, F.col("word")))).first()
    train_tokens, distinct = total[0] + ends, total[1] + (ends > 0)
    norm = train_tokens + 0.5 * (distinct + 1)
    names = ["n", *(f"n{e}" for e in range(len(classes)))]
    sizes = found.agg(*(f(c) for c in names for f in (lambda c: F.coalesce(F.sum(c), F.lit(0)), lambda c: F.count_if(F.col(c) > 0)))).first()
    totals = [(sizes[2 * e], sizes[2 * e + 1]) for e in range(len(names))]
    codes = context.broadcast(bit_tables(found))
    weights, refining = mixing_weights(found, codes)
    logs = materialize(unit_logs(found, codes, weights, refining, totals), "unit-logs")
    often, rare = split(logs, limit)
    table = often.select("unit", F.coalesce("c", F.lit(0)).alias("c"), "logs").toArrow()  # at most ``limit`` rows
    held = table["logs"].combine_chunks().flatten().to_numpy().reshape(-1, len(totals))
    values = {u.encode(): k for k, u in enumerate(table["unit"].to_pylist())}, table["c"].to_numpy(), held
    sums = materialize(document_sums(docs, context.broadcast(values), norm, ends, len(classes)), "document-sums")
    more = _rare_sums(sums, rare, norm, len(classes))
    whole = sums.drop("units", "times", "ratios").join(more, "row", "left")

    def both(name: str) -> Column:
        return F.col(name) + F.coalesce(f"rare_{name}", F.lit(0))

    def all_three(e: int, k: int) -> Column:
        return F.col(f"s{e}_{k}") + F.coalesce(f"fresh{e}", F.lit(0.0)) + F.coalesce(f"again{e}_{k}", F.lit(0.0))

    parts = F.array(*(all_three(e, k) for e in range(len(totals)) for k in range(len(MEMORIES))))
    most = F.array_max(parts)
    mean = F.aggregate(parts, F.lit(0.0), lambda held, s: held + F.exp(s - most)) / F.size(parts)
    score = (most + F.log(mean)) / math.log(10)
    out = whole.select("doc_id", "held_out", "n_tokens", both("known").alias("n_known"), F.lit(train_tokens).cast("long").alias("train_tokens"), both("base").alias("base_score"), score.alias("score"), "n_bytes")
    return out.withColumn("bits_per_byte", F.col("score") * -math.log2(10) / F.greatest("n_bytes", F.lit(1)))


def op11_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), F.col("lang"))
