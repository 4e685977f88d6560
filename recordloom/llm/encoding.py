"""Whole texts to token ids with the tokenizers library, each distinct part encoded once.

A text is cut where the tokenizer's own pre-tokenizer always cuts (before white space that
follows something else, and between an ASCII letter and a punctuation mark), so the ids of the
parts, joined, are the ids of the whole. Parts are found, hashed and looked up with numpy, a
slice of texts at a time; only parts that the worker does not know go to the library. Parts of
more than LONGEST bytes are not kept. Two parts are taken as equal if their 64-bit hashes are.
"""

from __future__ import annotations

import functools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from recordloom.llm.textops import LOWER, byte_set, span_hashes, utf8_slices

#: Parts a worker keeps; beyond them, the half that was used last stays.
KEPT_PARTS = 400_000
#: Bytes of the longest part that is kept.
LONGEST = 64
#: Bytes of text encoded at once (a longer text is taken alone).
SLICE_BYTES = 1 << 19
_PARTS_A_CALL = 2048
_SLOT_BITS = 22

_BREAKS = byte_set(" \n")
_ASCII_BLANKS = byte_set(range(0x09, 0x0E), range(0x1C, 0x21))
_LETTERS = byte_set(range(0x41, 0x5B), range(0x61, 0x7B))
#: Marks that are neither letters, digits nor white space; an apostrophe may belong to what follows.
_MARKS = byte_set("!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")
#: First bytes of white space beyond ASCII, and all of it.
_FAR_BLANK_BEGINS = byte_set(range(0xC2, 0xC3), range(0xE1, 0xE4))
_FAR_BLANKS = [c.encode() for c in map(chr, range(0x80, 0x3001)) if c.isspace()]


#: Letters before this one are composed, and but for one lower-cased to one letter.
_PLAIN_END = "\u0180"


def _spelling() -> dict[int, str]:
    """How byte-level vocabularies spell bytes: printable ones as themselves, the others in order from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (chr(256 + k) for k in range(256))
    return {b: chr(b) if b in plain else next(others) for b in range(256)}


_OF_BYTES = _spelling()
_OF_PLAIN = {c: "".join(_OF_BYTES[b] for b in chr(c).encode()) for c in range(ord(_PLAIN_END))}


def byte_entries(tokenizer: Tokenizer) -> list[bytes]:
    """The bytes of every id of a byte-level vocabulary; those of added tokens are their letters."""
    of = {c: b for b, c in _OF_BYTES.items()}
    added = tokenizer.get_added_tokens_decoder()
    return [tokenizer.id_to_token(i).encode() if i in added else bytes(of[c] for c in tokenizer.id_to_token(i)) for i in range(tokenizer.get_vocab_size())]


def _spelled(text: str) -> str:
    if max(text) < _PLAIN_END:
        return text.translate(_OF_PLAIN)
    return text.encode().decode("latin-1").translate(_OF_BYTES)


def _lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, but for those before a character beyond ASCII: a mark may compose with the small letter only."""
    low = LOWER[data]
    before = np.flatnonzero((data[:-1] != low[:-1]) & (data[1:] >= 0x80))
    low[before] = data[before]
    return low


def _after_blank(data: np.ndarray) -> np.ndarray:
    """Whether the character before each byte is white space."""
    after = np.zeros(len(data) + 1, dtype=bool)
    after[1:] = _ASCII_BLANKS[data]
    begins = np.flatnonzero(_FAR_BLANK_BEGINS[data])
    if len(begins):
        held = data.tobytes()
        for blank in _FAR_BLANKS:
            some = begins[data[begins] == blank[0]]
            for at in some[[held.startswith(blank, at) for at in some.tolist()]] if len(some) else some:
                after[at + len(blank)] = True
    return after[:-1]


def gathered(starts: np.ndarray, counts: np.ndarray, held: np.ndarray) -> np.ndarray:
    """The joined runs held[start : start + count]."""
    ends = np.cumsum(counts)
    return held[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)]


class PartEncoder:
    """``blanks``: whether the vocabulary spells the blank before a word (byte-level) or drops white space and case.

    Added tokens (``<|endoftext|>``) that a text holds become their ids, as the library does by default; ``spelled`` takes
    them as other text.
    """

    def __init__(self, path: str, blanks: bool, kept: int = KEPT_PARTS, slice_bytes: int = SLICE_BYTES, spelled: bool = False) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = spelled
        # a text that may hold an added token goes to the library whole, as what stands around it is then encoded apart
        self.added = [] if spelled else [t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.blanks, self.kept, self.slice_bytes = blanks, kept, slice_bytes
        self._forget()

    def _forget(self) -> None:
        self.known: dict[int, int] = {}  # hash: number
        self.slots = np.zeros(1 << _SLOT_BITS, dtype=np.int32)  # number of the part with these last bits of its hash, if it is this one
        self.hashes = np.zeros(1 << 16, dtype=np.uint64)  # of each number, as are the next three
        self.starts, self.counts, self.used = (np.zeros(1 << 16, dtype=np.int64) for _ in range(3))
        self.ids = np.zeros(1 << 18, dtype=np.uint32)
        self.n, self.n_ids, self.time = 1, 0, 0  # number 0 is no part

    def parts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and row of the parts of a slice of texts."""
        n = len(data)
        breaks = _BREAKS[data]
        cut = np.zeros(n + 1, dtype=bool)
        cut[1:n] = _LETTERS[data[:-1]] & _MARKS[data[1:]]
        if self.blanks:
            cut[:-1] |= breaks & ~_after_blank(data)
        else:
            cut[1:n] |= breaks[:-1] | breaks[1:]
        cut[offsets] = True
        edges = np.flatnonzero(cut)
        starts, ends = edges[:-1], edges[1:]
        if not self.blanks:
            words = ~breaks[starts]
            starts, ends = starts[words], ends[words]
        return starts, ends, np.searchsorted(offsets, starts, side="right") - 1

    def _with_added(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Rows that hold the letters of an added token, in any case."""
        held, at = LOWER[data].tobytes(), []
        for token in self.added:
            found = held.find(token)
            while found >= 0:
                at.append(found)
                found = held.find(token, found + 1)
        return np.unique(np.searchsorted(offsets, np.array(at, dtype=np.int64), side="right") - 1)

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def found(self, parts: list[str]) -> list[np.ndarray | list[int]]:
        """The ids of new parts: a word of letters is one pre-token for the model, others go through the whole tokenizer, many in one call."""
        out: list[np.ndarray | list[int]] = [[] for _ in parts]
        tokenize, blank = self.tokenizer.model.tokenize, _OF_BYTES[32]
        rest = []
        for k, part in enumerate(parts):
            if self.blanks and (part.isalpha() or (part[0] == " " and part[1:].isalpha())):
                out[k] = [t.id for t in tokenize(part.replace(" ", blank) if part.isascii() else _spelled(part))]
            elif not self.blanks and part.isalpha() and max(part) < _PLAIN_END and "\u0130" not in part:  # it becomes a letter and a mark
                low = part.lower()
                out[k] = [t.id for t in tokenize(low if low.isascii() else _spelled(low))]
            elif self.blanks and (part[0] not in " \n" or part[-1].isspace()):
                out[k] = self._whole(part)
            else:
                rest.append(k)
        for at in range(0, len(rest), _PARTS_A_CALL):
            some = rest[at : at + _PARTS_A_CALL]
            spelled = [parts[k] if self.blanks else " " + parts[k] for k in some]
            starts = np.cumsum([0, *map(len, spelled)])
            found = self.tokenizer.encode("".join(spelled), add_special_tokens=False)
            last = np.fromiter((end for _, end in found.offsets), dtype=np.int64) - 1
            bounds, ids = np.searchsorted(last, starts).tolist(), found.ids
            for i, k in enumerate(some):
                out[k] = ids[bounds[i] : bounds[i + 1]]
        return out

    def _learn(self, hashes: np.ndarray, parts: list[str]) -> None:
        found = self.found(parts)
        counts = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        n, n_ids = self.n + len(found), self.n_ids + int(counts.sum())
        for name in ("hashes", "starts", "counts", "used"):
            if len(getattr(self, name)) < n:
                setattr(self, name, np.resize(getattr(self, name), 2 * n))
        if len(self.ids) < n_ids:
            self.ids = np.resize(self.ids, 2 * n_ids)
        self.hashes[self.n : n], self.counts[self.n : n] = hashes, counts
        self.starts[self.n : n] = self.n_ids + np.cumsum(counts) - counts
        self.ids[self.n_ids : n_ids] = np.concatenate(found) if found else []
        self.known.update(zip(hashes.tolist(), range(self.n, n), strict=True))
        self.slots[hashes & np.uint64(len(self.slots) - 1)] = np.arange(self.n, n)
        self.n, self.n_ids = n, n_ids

    def _thin(self) -> None:
        """Keep the half of the parts that was used last."""
        used = self.used[1 : self.n]
        kept = 1 + np.flatnonzero(used > np.partition(used, len(used) // 2)[len(used) // 2])
        hashes, counts, time = self.hashes[kept], self.counts[kept], used[kept - 1]
        ids = gathered(self.starts[kept], counts, self.ids)
        self._forget()
        n = len(kept) + 1
        self.hashes, self.counts, self.used = (np.concatenate([[0], a]).astype(a.dtype) for a in (hashes, counts, time))
        self.starts = np.concatenate([[0], np.cumsum(counts) - counts])
        self.ids, self.n, self.n_ids, self.time = ids, n, len(ids), int(time.max(initial=0))
        self.known = dict(zip(hashes.tolist(), range(1, n), strict=True))
        self.slots[hashes & np.uint64(len(self.slots) - 1)] = np.arange(1, n)

    def _numbers(self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of every part; new ones are learned."""
        slot = (hashes & np.uint64(len(self.slots) - 1)).astype(np.int64)
        numbers = self.slots[slot].astype(np.int64)
        other = np.flatnonzero(self.hashes[numbers] != hashes)
        if len(other):
            distinct, first, back = np.unique(hashes[other], return_index=True, return_inverse=True)
            get = self.known.get
            found = np.fromiter((get(h, 0) for h in distinct.tolist()), dtype=np.int64, count=len(distinct))
            new = np.flatnonzero(found == 0)
            if len(new):
                at = other[first[new]]
                begin = self.n
                held = data.tobytes()
                self._learn(distinct[new], [held[a:b].decode() for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])
                found[new] = np.arange(begin, self.n)
            self.slots[distinct & np.uint64(len(self.slots) - 1)] = found
            numbers[other] = found[back]
        return numbers

    def encode_slice(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a slice of texts, and where those of each text begin and end."""
        n = len(offsets) - 1
        if not len(data):
            return np.zeros(0, dtype=np.uint32), np.zeros(n + 1, dtype=np.int64)
        if self.n > self.kept:
            self._thin()
        self.time += 1
        given, data = data, data if self.blanks else _lowered(data)
        starts, ends, rows = self.parts(data, offsets)
        marked = self._with_added(given, offsets)
        if len(marked):
            others = ~np.isin(rows, marked)
            starts, ends, rows = (np.concatenate([v[others], w]) for v, w in ((starts, offsets[marked]), (ends, offsets[marked + 1]), (rows, marked)))
            order = np.argsort(rows, kind="stable")
            starts, ends, rows = starts[order], ends[order], rows[order]
        whole = np.isin(rows, marked)
        long = np.flatnonzero((ends - starts > LONGEST) | whole)
        hashes = span_hashes(data, starts, ends)
        if len(long):
            short = np.ones(len(starts), dtype=bool)
            short[long] = False
            numbers = np.zeros(len(starts), dtype=np.int64)
            numbers[short] = self._numbers(hashes[short], data, starts[short], ends[short])
        else:
            numbers = self._numbers(hashes, data, starts, ends)
        self.used[numbers] = self.time
        begins, counts, held = self.starts[numbers], self.counts[numbers], self.ids
        if len(long):
            taken = [given if w else data for w in whole[long].tolist()]
            own = [self._whole(d[a:b].tobytes().decode()) for d, a, b in zip(taken, starts[long].tolist(), ends[long].tolist(), strict=True)]
            sizes = np.array(list(map(len, own)), dtype=np.int64)
            begins[long], counts[long] = self.n_ids + np.cumsum(sizes) - sizes, sizes
            held = np.concatenate([held[: self.n_ids], *own])
        sums = np.concatenate([[0], np.cumsum(counts)])
        return gathered(begins, counts, held), sums[np.searchsorted(rows, np.arange(n + 1))]

    def encode(self, texts: pa.Array | list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers; a null is empty."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        return [ids for _, _, some in self.encoded(texts) for ids in some]

    def encoded(self, texts: pa.Array) -> Iterator[tuple[int, int, list[bytes]]]:
        """Yield (first row, end row, ids of each text) of slices of a column."""
        for row, end, data, offsets in utf8_slices(texts, self.slice_bytes):
            ids, bounds = self.encode_slice(data, offsets)
            held, edges = ids.astype("<u4").tobytes(), (4 * bounds).tolist()
            yield row, end, [held[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]


@functools.lru_cache(maxsize=4)
def encoder(path: str, blanks: bool, kept: int = KEPT_PARTS, slice_bytes: int = SLICE_BYTES, spelled: bool = False) -> PartEncoder:
    """One encoder for each Python worker, which keeps its parts from task to task."""
    return PartEncoder(path, blanks, kept, slice_bytes, spelled)


def text_groups(texts: list[str | None], characters: int = 1 << 19):
    """Yield (first, end) of runs of texts with about so many characters."""
    first, held = 0, 0
    for i, text in enumerate(texts):
        held += len(text or "")
        if held >= characters:
            yield first, i + 1
            first, held = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def _times(a: int, b: int) -> int:
    """Product of two polynomials over GF(2) modulo the CRC-32 polynomial, in its reflected form."""
    out = 0
    for bit in range(31, -1, -1):
        if a >> bit & 1:
            out ^= b
        b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
    return out


def crc32_join(first: int, second: int, second_bytes: int) -> int:
    """The CRC-32 of two joined byte strings from those of the parts."""
    shift, power = 1 << 31, 1 << 23  # 1 and x**8
    n = second_bytes
    while n:
        if n & 1:
            shift = _times(shift, power)
        power = _times(power, power)
        n >>= 1
    return _times(shift, first) ^ second


def crc32_shifts(sizes: int) -> np.ndarray:
    """[n, k, v]: what byte k of a CRC-32, of value v, becomes when n further bytes (below ``sizes``) follow."""
    table = np.zeros((sizes, 4, 256), dtype=np.int64)
    shift = 1 << 31
    for n in range(sizes):
        for k in range(4):
            for bit in range(8):
                table[n, k, 1 << bit : 2 << bit] = table[n, k, : 1 << bit] ^ _times(shift, 1 << 8 * k + bit)
        shift = _times(shift, 1 << 23)
    return table


def crc32(ids: bytes | memoryview) -> int:
    return zlib.crc32(ids)
