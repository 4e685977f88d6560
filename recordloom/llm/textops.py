"""Word spans, word hashes and n-gram sets of whole Arrow batches, with numpy.

Texts stay UTF-8 bytes: no Python string or per-word object is made, so a task's memory
is a small multiple of its Arrow batch. A null text has no words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text taken from an Arrow batch at once (a longer text is taken alone).
SLICE_BYTES = 1 << 18


def byte_set(*parts: str | range) -> np.ndarray:
    """A table of 256 flags, set for the given characters or byte ranges."""
    flags = np.zeros(256, dtype=bool)
    for part in parts:
        flags[list(part.encode("latin-1")) if isinstance(part, str) else list(part)] = True
    return flags


#: Separators of words that are any run without ASCII white space.
BLANKS = byte_set(" ", range(0x09, 0x0E))
#: Separators of words made of letters, digits and everything beyond ASCII.
NON_ALNUM = byte_set(range(0x00, 0x30), range(0x3A, 0x41), range(0x5B, 0x61), range(0x7B, 0x80))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def utf8_slices(texts: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, end row, bytes, offsets) with about ``limit`` bytes each; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if len(texts) == 0:
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    held = texts.buffers()[2]
    data = np.frombuffer(held, dtype=np.uint8) if held is not None else np.zeros(0, dtype=np.uint8)
    row = 0
    while row < len(texts):
        end = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        end = min(max(end, row + 1), len(texts))
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def word_spans(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every maximal run without separators; a word never crosses rows."""
    n = len(data)
    if n == 0:
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, empty
    inside = ~separators[data]
    breaks = np.zeros(n + 1, dtype=bool)
    breaks[offsets] = True
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | breaks[:-1]))
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | breaks[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit bijection that spreads every input bit over the word."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


_BASE = 0x9E3779B97F4A7C15


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every span, the same wherever the span stands.

    A span is read as words of 8 bytes. Each is mixed with its number and the span's length by a
    bijection that is not linear, so no arrangement of equal letters cancels out in their sum.
    """
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        at = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, at + SLICE_BYTES, side="right")))
        out[i:j] = _hashed(np.append(data[at : ends[j - 1]], np.zeros(8, dtype=np.uint8)), starts[i:j] - at, ends[i:j] - starts[i:j])
        i = j
    return out


def _hashed(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    eights = np.ndarray(max(len(data) - 7, 0), dtype="<u8", buffer=data.tobytes(), strides=(1,))  # the 8 bytes from each place on
    words = np.maximum((sizes + 7) >> 3, 1)
    lengths = sizes.astype(np.uint64) * np.uint64(_BASE)
    if int(words.max(initial=1)) == 1:
        return mix(mix(_low(eights.take(starts), sizes) ^ lengths))
    firsts = np.cumsum(words) - words
    number = np.arange(int(words.sum())) - np.repeat(firsts, words)
    held = _low(eights.take(np.repeat(starts, words) + 8 * number), np.minimum(np.repeat(sizes, words) - 8 * number, 8))
    mixed = mix(held ^ np.repeat(lengths, words) ^ mix(number.astype(np.uint64)))
    return mix(np.add.reduceat(mixed, firsts))


def _low(words: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The low n bytes of each word, n from 0 to 8."""
    return words & _MASKS[n]


_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)


def word_hash(words: list[str]) -> np.ndarray:
    """The hash that each word has where it stands in a text."""
    data = "\n".join(words).encode()
    ends = np.cumsum([len(w.encode()) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1]).astype(np.int64)
    return span_hashes(np.frombuffer(data, dtype=np.uint8), starts, ends.astype(np.int64))


def ngram_hashes(hashes: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every window of n words inside one row."""
    if len(hashes) < n:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    out = np.zeros(len(hashes) - n + 1, dtype=np.uint64)
    for k in range(n):
        out = out * np.uint64(_BASE) + hashes[k : len(hashes) - n + 1 + k]
    same = rows[: len(rows) - n + 1] == rows[n - 1 :]
    return mix(out[same]), rows[: len(rows) - n + 1][same]


def ngram_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct word n-grams of every row as (hashes, bounds): row i owns bounds[i]:bounds[i+1], sorted.

    Words are lower-cased runs of letters, digits and characters beyond ASCII. A row of 1 to
    n-1 words has one n-gram, all its words; a row without words has none.
    """
    data = LOWER[data]
    starts, ends, rows = word_spans(data, offsets, NON_ALNUM)
    hashes = span_hashes(data, starts, ends)
    grams, owners = ngram_hashes(hashes, rows, n)
    n_rows = len(offsets) - 1
    per_row = np.bincount(rows, minlength=n_rows)
    short = np.flatnonzero((per_row > 0) & (per_row < n))
    if len(short):
        first = np.searchsorted(rows, short)
        extra = np.array([_folded(hashes[f : f + per_row[r]]) for f, r in zip(first, short, strict=True)], dtype=np.uint64)
        grams, owners = np.concatenate([grams, extra]), np.concatenate([owners, short])
        order = np.argsort(owners, kind="stable")
        grams, owners = grams[order], owners[order]
    counts = np.bincount(owners, minlength=n_rows)
    bounds = np.concatenate([[0], np.cumsum(counts)])
    pieces = [np.unique(grams[bounds[i] : bounds[i + 1]]) for i in range(n_rows)]
    sizes = np.array([len(p) for p in pieces], dtype=np.int64)
    return np.concatenate(pieces) if pieces else grams, np.concatenate([[0], np.cumsum(sizes)])


def _folded(hashes: np.ndarray) -> np.uint64:
    out = np.uint64(len(hashes))
    with np.errstate(over="ignore"):
        for h in hashes:
            out = mix(np.array([out * np.uint64(_BASE) + h], dtype=np.uint64))[0]
    return out
