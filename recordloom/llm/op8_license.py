"""License scans: an exact set-similarity join of text blocks with license notices and whole license texts.

Tokens of the notices are ordered by their frequency in the whole corpus, rarest first. The block
of a notice of one sentence is a window of REACH times its words, in which tokens count in any order
within a line and in the notice's order over line breaks (a wrapped notice). That of a text of
more than SENTENCE words is a passage of TEXT_REACH times its words, over lines and paragraphs,
in any order. A block can reach the containment
threshold |block & notice| / |notice| >= t only if it holds one of the first
|notice| - ceil(t |notice|) + 1 tokens of that order (prefix filter) and enough notice words
around that token (length and positional filter). What passes is verified on the full token
sets, so the join finds every pair above the threshold and no other. Each pair gives a label,
unless most of its words belong to a pair that fits better (gpl inside lgpl). The notices are a
bounded list and travel with the tasks. Of passages that overlap, the one with most tokens counts,
of equal ones the shortest, then the first.

The base phrases are searched beside it: places where their words stand consecutively.

Nulls: a null text is empty; an empty text has no words, labels or places, and score 0. Every
row is scanned on its own and whole, however long, so repeated rows, null ids and other columns
change nothing; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.llm.license_texts import TEXTS
from recordloom.llm.textops import LOWER, NON_ALNUM, span_hashes, utf8_slices, word_hash, word_spans

#: The base phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: The notices that the method looks for: usual one-sentence license statements.
NOTICES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted",
    "cc-by-4.0": "Licensed under CC BY 4.0",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3",
    "lgpl-3.0": "This work is licensed under the GNU Lesser General Public License, version 3",
    "mit": "Released under the MIT License",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "public-domain": "This work is dedicated to the public domain",
}
THRESHOLD = 0.8
#: Fixed value: a notice's shared tokens stand in a window of so many times its words.
REACH = 3
#: Words of the longest notice that is searched as a sentence, and the reach of longer ones.
SENTENCE, TEXT_REACH = 24, 1.25

SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def _words(text: str) -> list[str]:
    lowered = LOWER[np.frombuffer(text.encode(), dtype=np.uint8)]
    starts, ends, _ = word_spans(lowered, np.array([0, len(lowered)]), NON_ALNUM)
    return [lowered[s:e].tobytes().decode() for s, e in zip(starts, ends, strict=True)]


def notice_tokens(notices: dict[str, str]) -> list[str]:
    return sorted({w for text in notices.values() for w in _words(text)})


def token_frequencies(docs: DataFrame, tokens: list[str]) -> dict[str, int]:
    """Occurrences of each token over all texts; one partial sum a task and token is shuffled."""
    order = np.argsort(hashes := word_hash(tokens))
    known = hashes[order]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(len(known), dtype=np.int64)
        for batch in batches:
            for _, _, data, offsets in utf8_slices(batch["text"]):
                data = LOWER[data]
                starts, ends, _ = word_spans(data, offsets, NON_ALNUM)
                found = span_hashes(data, starts, ends)
                at = np.minimum(np.searchsorted(known, found), len(known) - 1)
                sums += np.bincount(at[known[at] == found], minlength=len(known))
        yield pa.RecordBatch.from_arrays([pa.array(order), pa.array(sums)], ["token", "n"])

    rows = docs.select("text").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    return {t: 0 for t in tokens} | {tokens[r["token"]]: r["n"] for r in rows}


class Match(NamedTuple):
    """One place of a notice: its number, the share and number of its tokens held, the words that hold them,
    and whether these stand in the notice's order or as close as in it."""

    notice: int
    share: float
    shared: int
    words: list[int]
    firm: bool


class NoticeIndex:
    """Notices as sets of token numbers, numbered by frequency, with their prefixes."""

    def __init__(self, notices: dict[str, str], frequencies: dict[str, int], threshold: float) -> None:
        tokens = sorted(frequencies, key=lambda t: (frequencies[t], t))
        number = {t: i for i, t in enumerate(tokens)}
        hashes = word_hash(tokens)
        self.order = np.argsort(hashes)
        self.known = hashes[self.order]
        self.labels = [name.split("/")[0] for name in notices]
        texts = [[number[w] for w in _words(text)] for text in notices.values()]
        self.rank = [{token: r for r, token in enumerate(dict.fromkeys(text))} for text in texts]
        self.long = [len(text) > SENTENCE for text in texts]
        self.reach = [math.ceil((TEXT_REACH if long else REACH) * len(text)) for text, long in zip(texts, self.long, strict=True)]
        self.least = [math.ceil(threshold * len(own) - 1e-9) for own in self.rank]
        self.held = np.zeros((len(texts), len(tokens)), dtype=bool)
        self.prefix = np.zeros((len(texts), len(tokens)), dtype=bool)
        for k, own in enumerate(self.rank):
            self.held[k, list(own)] = True
            self.prefix[k, sorted(own)[: len(own) - self.least[k] + 1]] = True
        self.is_prefix = self.prefix.any(axis=0)

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The token number of each word, -1 for a word of no notice."""
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        return np.where(self.known[at] == hashes, self.order[at], -1)

    def matches(self, at: np.ndarray, tokens: np.ndarray, rows: np.ndarray, lines: np.ndarray) -> dict[int, list[Match]]:
        """The places of all notices by row; at: the words that are notice tokens, with their tokens, rows and lines."""
        out: dict[int, list[Match]] = {}
        wanted = self.is_prefix[tokens]
        for k in np.flatnonzero(self.prefix[:, np.unique(tokens[wanted])].any(axis=1)):
            own = np.flatnonzero(self.held[k, tokens])
            words, owners = at[own], rows[own]
            hits = np.flatnonzero(self.prefix[k, tokens[own]])
            first = np.maximum(np.searchsorted(words, words[hits] - self.reach[k] + 1), np.searchsorted(owners, owners[hits]))
            end = np.minimum(np.searchsorted(words, words[hits] + self.reach[k]), np.searchsorted(owners, owners[hits], side="right"))
            near = end - first >= self.least[k]  # too few notice words around the prefix token
            first, end = first[near], end[near]
            new = np.flatnonzero(first >= np.concatenate([[0], end[:-1]]))  # runs that no other run overlaps
            for f, e in zip(first[new].tolist(), end[np.append(new[1:], len(end)) - 1].tolist() if len(new) else [], strict=True):
                if self.long[k]:
                    found = self.passages(int(k), words[f:e].tolist(), tokens[own[f:e]].tolist())
                else:
                    found = self.places(int(k), words[f:e].tolist(), tokens[own[f:e]].tolist(), lines[own[f:e]].tolist())
                if found:
                    out.setdefault(int(owners[f]), []).extend(found)
        return out

    def passages(self, k: int, words: list[int], tokens: list[int]) -> list[Match]:
        """Where a run of a text's words holds it to the threshold within its reach, in any order: one window slides over it."""
        least, reach = self.least[k], self.reach[k]
        out: list[Match] = []
        held: Counter = Counter()
        start, best = 0, None  # best: (tokens, -length, first, end) of the passages met since the last one that is done
        for end, (word, token) in enumerate(zip(words, tokens, strict=True), start=1):
            held[token] += 1
            while words[start] <= word - reach or held[tokens[start]] > 1:
                held[tokens[start]] -= 1
                if not held[tokens[start]]:
                    del held[tokens[start]]
                start += 1
            if len(held) < least:
                continue
            fit = (len(held), words[start] - word, start, end)
            if best is not None and start >= best[3]:
                out.append(self._passage(k, words, best))
                best = None
            if best is None or fit[:2] > best[:2]:
                best = fit
        return [*out, self._passage(k, words, best)] if best else out

    def _passage(self, k: int, words: list[int], best: tuple[int, int, int, int]) -> Match:
        return Match(k, best[0] / len(self.rank[k]), best[0], words[best[2] : best[3]], True)

    def places(self, k: int, words: list[int], tokens: list[int], lines: list[int]) -> list[Match]:
        """Where a run of a notice's words holds it to the threshold within its reach: in any order in a line, in its own over lines."""
        rank, least, reach = self.rank[k], self.least[k], self.reach[k]
        found, stop, end = [], 0, 0
        for i, word in enumerate(words):
            stop = max(stop, i)
            while end < len(words) and words[end] < word + reach:
                end += 1
            while stop < end and lines[stop] == lines[i]:
                stop += 1
            if len(set(tokens[i:end])) < least:
                continue
            held = len(set(tokens[i:stop]))
            any_order: dict[int, int] = {}
            for t, w in zip(tokens[i:stop], words[i:stop], strict=True):
                any_order[t] = w  # the last of each token up to where all are there
                if len(any_order) == held:
                    break
            chains = _chains([rank[t] for t in tokens[i:end]], words[i:end])
            found.extend(Match(k, len(c) / len(rank), len(c), c, True) for c in chains if len(c) >= least)
            if held > len(chains[0]) and held >= least:
                own = sorted(any_order.values())
                found.append(Match(k, held / len(rank), held, own, REACH * (own[-1] - own[0] + 1) <= reach))
        return found


def _chains(ranks: list[int], words: list[int]) -> list[list[int]]:
    """The words of longest runs of rising ranks: the one that ends first and the one whose words stand last."""
    best: dict[int, tuple[int, int, list[int]]] = {}
    first: tuple[int, int, list[int]] = (0, 0, [])
    for rank, word in zip(ranks, words, strict=True):
        length, start, before = max((b for r, b in best.items() if r < rank), key=lambda b: b[:2], default=(0, word, []))
        if (length + 1, start) >= best.get(rank, (0, 0))[:2]:
            best[rank] = (length + 1, start, [*before, word])
            if length + 1 > first[0]:
                first = best[rank]
    return [first[2], max(best.values(), key=lambda b: b[:2])[2]]


def closest(matches: list[Match]) -> list[Match]:
    """Matches of one notice without those that hold another of at least as many tokens."""
    out: list[Match] = []
    for m in sorted(matches, key=lambda m: (m.words[-1], -m.words[0], -m.shared)):
        inner = itertools.takewhile(lambda c, m=m: c.words[-1] >= m.words[0], reversed(out))
        if not any(c.words[0] >= m.words[0] and c.shared >= m.shared for c in inner):
            out.append(m)
    return out


def not_nested(matches: list[Match]) -> set[int]:
    """The notices that have a match at most half of whose words are words of a notice that fits better there (not gpl inside lgpl)."""
    owners: dict[int, list[Match]] = {}  # of each word
    for k in {m.notice for m in matches}:
        for m in closest([m for m in matches if m.notice == k and m.firm]):
            for w in m.words:
                owners.setdefault(w, []).append(m)
    out = set()
    for m in matches:
        if m.notice not in out:
            fit = (m.share, m.shared)
            taken = Counter(k for w in m.words for k in {o.notice for o in owners.get(w, ()) if (o.share, o.shared) > fit})
            if 2 * max(taken.values(), default=0) <= len(m.words):
                out.add(m.notice)
    return out


def notice_matches(docs: DataFrame, notices: dict[str, str] = NOTICES | TEXTS, phrases: dict[str, str] = PHRASES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document; labels hold every notice that it contains to the threshold and that no better one nests."""
    index = NoticeIndex(notices, token_frequencies(docs, notice_tokens(notices)), threshold)
    searched = [(label, word_hash(p.split())) for p, label in phrases.items()]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [_scan(data, offsets, index, searched) for _, _, data, offsets in utf8_slices(batch["text"])]
            columns = [[v for part in parts for v in part[c]] for c in range(7)]
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            arrays = [batch["doc_id"].cast(pa.int64()), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    return docs.select("doc_id", "text").mapInArrow(scan, SCHEMA)


def _scan(data: np.ndarray, offsets: np.ndarray, index: NoticeIndex, phrases: list[tuple[str, np.ndarray]]) -> list[list]:
    n = len(offsets) - 1
    data = LOWER[data]
    starts, ends, rows = word_spans(data, offsets, NON_ALNUM)
    hashes = span_hashes(data, starts, ends)
    first_of_row = np.searchsorted(rows, np.arange(n + 1))
    n_words = np.diff(first_of_row)
    places: list[list[int]] = [[] for _ in range(n)]
    base: list[set[str]] = [set() for _ in range(n)]
    for label, words in phrases:
        if len(hashes) < len(words):
            continue
        last = len(hashes) - len(words) + 1
        hit = rows[:last] == rows[len(words) - 1 :]
        for k, h in enumerate(words):
            hit &= hashes[k : last + k] == h
        for i in np.flatnonzero(hit):
            places[rows[i]].append(int(i - first_of_row[rows[i]]))
            base[rows[i]].add(label)
    labels = [set(b) for b in base]
    scores = [0.0] * n
    numbers = index.numbers(hashes)
    of_notice = np.flatnonzero(numbers >= 0)
    breaks = np.flatnonzero(data == 10)
    line = np.searchsorted(breaks, starts[of_notice]) + rows[of_notice]  # new at a line break and at a new row
    for row, found in index.matches(of_notice, numbers[of_notice], rows[of_notice], line).items():
        scores[row] = max(m.share for m in found)
        labels[row].update(index.labels[k] for k in not_nested(found))
    joined = [",".join(sorted(x)) for x in base], [",".join(sorted(x)) for x in labels]
    scores = [1.0 if b else s for b, s in zip(base, scores, strict=True)]
    return [n_words.tolist(), [len(p) for p in places], [min(p, default=None) for p in places], [max(p, default=None) for p in places], *joined, scores]


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notice_matches(spark.read.parquet(f"{sf_dir}/documents.parquet"))
