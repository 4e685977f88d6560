"""Toxicity by a weighted finite-state pattern grammar over clauses.

Five transducers read a clause's words as symbols (which of the grammar's lists a word is in), each
passing on what it reads with marks of its own: negation marks what follows it closely, reported
speech marks all that follows, target and threat keep what they have met, and insult writes out how
much an insult counts where it stands. They are composed into one machine, whose states are
the reachable combinations of theirs and whose tables are built once. Running it over a clause
gives its final state and the insults with their levels, and from these the clause's weight. A
document's score combines its clauses: 1 - product of (1 - p), where p is the logistic of a
clause's weight. So an isolated listed word is only one input of its clause.

Insults are learned from labels: words that stand in at least MIN_TOXIC toxic documents and
whose share of toxic documents is MIN_SHARE or more; the weight is the log odds of that share.
One insult in a whole document may be there by chance, so it weighs LONE less. The fit uses a
bounded sample, at most FIT_ROWS labelled documents in the order of a hash of their ids. The
weight of a threat against a target is learned alike, from the documents with such a clause; a
negated or reported one without an insult is no threat.
The words learned are as many as the sample holds, which FIT_ROWS bounds. Targets, threats, negations and verbs of reporting are short fixed lists for four languages,
without words that are common in another of them (such as the article "die").

Nulls: a null or empty text has no clause and gets the score of one without a match. A null
doc_id or label is not learned from. Repeated rows are scored alike; other columns are
ignored. A very long text is scored whole, clause by clause. Where two labels of one id differ, the
higher counts; of equally weighty insults none is preferred, as only their weights count. Without
labels, or with an empty table, nothing is an insult.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Hashable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.llm.textops import NON_ALNUM, byte_set, span_hashes, utf8_slices, word_hash, word_spans

FIT_ROWS = 20_000
MIN_TOXIC = 4
MIN_SHARE = 0.8
NO_MATCH = 0.02
THRESHOLD = 0.3

#: Words of the grammar's other parts, in four languages.
TARGETS = frozenset("you your yours they them she him her toi vous votre elle dich dir euch usted ustedes tú ella ellos".split())
THREATS = frozenset("kill hurt destroy strangle tuer frapper étrangler töten schlagen vernichten matar golpear estrangular".split())
NEGATIONS = frozenset("not never isn't aren't pas jamais nicht kein keine nunca jamás".split())
REPORTS = frozenset("said says claimed wrote called reported dit écrit sagte schrieb dijo escribió".split())

NEGATION_REACH = 3
NEGATED, REPORTED = 0.4, 0.7
LONE = 3.5
TARGETED, THREATENED, FURTHER = 0.5, 1.0, 0.5
#: Counts the documents with a threat beside the words; no word is spelled so.
_THREAT = "\n"

_CLAUSE = re.compile(r"[.!?;:\n]+")
_WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)?")
_PIECE = re.compile("[a-z0-9]+")
#: Separators of pieces: all bytes but ASCII letters and digits.
_NO_PIECE = NON_ALNUM | byte_set(range(0x80, 0x100))


def learnable(doc_id: Column) -> Column:
    return (F.crc32(doc_id.cast("string")) % 4 != 2) & doc_id.isNotNull()


def _log_odds(n: int, n_toxic: int) -> float:
    return math.log((n_toxic + 0.5) / (n - n_toxic + 0.5))


def learn(docs: DataFrame, labels: DataFrame, limit: int = FIT_ROWS) -> tuple[dict[str, float], float]:
    """Insult words with their weights, and the weight of a threat (0 without labels): words of at most ``limit`` documents reach the driver."""
    labelled = labels.filter(learnable(F.col("doc_id")) & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    labelled = labelled.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    rows = docs.select("doc_id", "text").join(F.broadcast(labelled), "doc_id").select("text", "toxic")

    plain = Grammar({})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: Counter = Counter()
            toxic: Counter = Counter()
            for text, label in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist(), strict=True):
                own = set(_WORD.findall((text or "").lower()))
                if not THREATS.isdisjoint(own) and plain.has_threat(text):
                    own.add(_THREAT)
                total.update(own)
                if label == 1:
                    toxic.update(own)
            names = list(total)
            arrays = [pa.array(names, pa.string()), pa.array([total[w] for w in names], pa.int64()), pa.array([toxic[w] for w in names], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["word", "n", "n_toxic"])

    sums = rows.mapInArrow(count, "word string, n long, n_toxic long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("n_toxic").alias("n_toxic"))
    is_threat = F.col("word") == _THREAT
    sums = sums.filter(is_threat | ((F.col("n_toxic") >= MIN_TOXIC) & (F.col("n_toxic") >= MIN_SHARE * F.col("n"))))
    weights = {r["word"]: _log_odds(r["n"], r["n_toxic"]) for r in sums.collect()}
    threat = weights.pop(_THREAT, 0.0)
    return weights, threat


def learn_insults(docs: DataFrame, labels: DataFrame, limit: int = FIT_ROWS) -> dict[str, float]:
    return learn(docs, labels, limit)[0]


# Symbols: the lists that a word is in, and the marks that transducers add.
_NEGATION, _REPORT, _TARGET, _THREATENS, _INSULT, _NEGATED, _REPORTED = (1 << k for k in range(7))
#: What an insult or threat counts under each combination of marks.
FACTORS = {0: 1.0, _REPORTED: REPORTED, _NEGATED: NEGATED, _NEGATED | _REPORTED: NEGATED * REPORTED}


@dataclass(frozen=True)
class Transducer:
    """A start state, and the arcs as a function: (state, symbol read) to (next state, symbol written)."""

    start: Hashable
    arc: Callable[[Hashable, int], tuple[Hashable, int]]

    def then(self, other: Transducer) -> Transducer:
        """The composition: ``other`` reads what this one writes."""

        def arc(state: tuple[Hashable, Hashable], symbol: int) -> tuple[Hashable, int]:
            first, passed = self.arc(state[0], symbol)
            second, written = other.arc(state[1], passed)
            return (first, second), written

        return Transducer((self.start, other.start), arc)

    def tables(self, symbols: range) -> tuple[list[Hashable], list[list[int]], list[list[int]]]:
        """Reachable states, and for each state and symbol the number of the next one and the symbol written."""
        states, number, following, written = [self.start], {self.start: 0}, [], []
        for state in states:  # grows
            arcs = [self.arc(state, symbol) for symbol in symbols]
            for target, _ in arcs:
                if target not in number:
                    number[target] = len(states)
                    states.append(target)
            following.append([number[target] for target, _ in arcs])
            written.append([out for _, out in arcs])
        return states, following, written


def _negate(since: int, symbol: int) -> tuple[int, int]:
    """State: words since a negation. The negation itself is not passed on."""
    if symbol & _NEGATION:
        return 0, 0
    return min(since + 1, NEGATION_REACH), symbol | (_NEGATED if since < NEGATION_REACH else 0)


def _report(reported: bool, symbol: int) -> tuple[bool, int]:
    reported = reported or bool(symbol & _REPORT)
    return reported, symbol | (_REPORTED if reported else 0)


def _target(met: bool, symbol: int) -> tuple[bool, int]:
    return met or bool(symbol & _TARGET), symbol


def _threaten(most: float, symbol: int) -> tuple[float, int]:
    """State: the most that a threat has counted."""
    return max(most, FACTORS[symbol & (_NEGATED | _REPORTED)]) if symbol & _THREATENS else most, symbol


def _insult(state: None, symbol: int) -> tuple[None, int]:
    """Writes an insult with its marks, and nothing else."""
    return None, symbol & (_INSULT | _NEGATED | _REPORTED) if symbol & _INSULT else 0


#: Words since a negation, reported speech, target, threat, insult, in the order in which they read.
GRAMMAR = Transducer(NEGATION_REACH, _negate).then(Transducer(False, _report)).then(Transducer(False, _target)).then(Transducer(0.0, _threaten)).then(Transducer(None, _insult))
_LISTS = ((NEGATIONS, _NEGATION), (REPORTS, _REPORT), (TARGETS, _TARGET), (THREATS, _THREATENS))


class Grammar:
    """The composed machine over words; ``insults`` maps words to weights, ``threat`` is the weight of a threat against a target."""

    def __init__(self, insults: dict[str, float], threat: float = 0.0) -> None:
        self.insults, self.threat = insults, threat
        self.symbol = {w: sum(mark for own, mark in (*_LISTS, (insults, _INSULT)) if w in own) for w in {*insults, *TARGETS, *THREATS, *NEGATIONS, *REPORTS}}
        states, self.following, self.written = GRAMMAR.tables(range(2 * _INSULT))
        self.targeted = [state[0][0][1] for state in states]
        self.threatened = [state[0][1] for state in states]

    def clause_weight(self, words: list[str]) -> tuple[float, int] | None:
        """Weight and number of insults of a clause, None if it has neither an insult nor a plain threat against a target."""
        state, weights = 0, []
        for word in words:
            symbol = self.symbol.get(word, 0)
            out = self.written[state][symbol]
            state = self.following[state][symbol]
            if out:
                weights.append(self.insults[word] * FACTORS[out & ~_INSULT])
        targeted, threat = self.targeted[state], self.threatened[state]
        if not weights:
            return (self.threat, 0) if threat == 1 and targeted else None
        best = max(weights)
        return best + FURTHER * min(sum(weights) - best, 4.0) + TARGETED * targeted + THREATENED * threat, len(weights)

    def has_threat(self, text: str) -> bool:
        return any((w := self.clause_weight(_WORD.findall(clause))) and not w[1] for clause in _CLAUSE.split(text.lower()))

    def score(self, text: str) -> float:
        found = [w for clause in _CLAUSE.split(text.lower()) if (w := self.clause_weight(_WORD.findall(clause)))]
        lone = LONE * (sum(n for _, n in found) == 1)
        clean = 1 - NO_MATCH
        for weight, n in found:
            clean *= 1 / (1 + math.exp(weight - lone * (n > 0)))
        return 1 - clean


def _contains(known: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(hashes), dtype=bool)
    return known[np.minimum(np.searchsorted(known, hashes), len(known) - 1)] == hashes


def score_texts(docs: DataFrame, insults: dict[str, float], threat: float = 0.0) -> DataFrame:
    """``doc_id`` and ``score`` of every whole text: hashes find the rows that may have a match, the grammar reads those.

    Whatever ends a word for the grammar also ends its runs of ASCII letters and digits, so a row with the word has its
    longest run as a piece. Where a word has no such run, the grammar reads every row with a byte beyond ASCII.
    """
    grammar = Grammar(insults, threat)
    pieces = {max(_PIECE.findall(word), key=len, default="") for word in {*insults, *THREATS}}
    known = np.sort(word_hash(sorted(pieces - {""})))
    beyond_ascii = "" in pieces

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Python lower-cases this letter to two characters, Arrow to one
            lowered = pc.utf8_lower(pc.replace_substring(batch["text"], "\u0130", "i\u0307"))
            scores = np.full(len(batch), NO_MATCH)
            for row, _, data, offsets in utf8_slices(lowered):
                starts, ends, rows = word_spans(data, offsets, _NO_PIECE)
                wanted = rows[_contains(known, span_hashes(data, starts, ends))]
                if beyond_ascii:
                    wanted = np.append(wanted, np.searchsorted(offsets, np.flatnonzero(data >= 0x80), side="right") - 1)
                for r in np.unique(wanted):
                    scores[row + r] = grammar.score(batch["text"][int(row + r)].as_py())
            yield pa.RecordBatch.from_arrays([batch["doc_id"].cast(pa.int64()), pa.array(scores)], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    insults, threat = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    predicted = F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).cast("int")
    return score_texts(docs, insults, threat).select("doc_id", held_out.alias("held_out"), "score", predicted.alias("predicted"))
