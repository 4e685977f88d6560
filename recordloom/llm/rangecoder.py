"""A context-mixing range coder for token ids, with numpy over many lanes at once.

A block of ids is cut into lanes of up to LANE ids, coded side by side with one shared model
that starts empty. For the next id of a lane, order 2 (the two ids before) and order 1 (the id
before) each predict the id that followed there lately, and order 0 gives every id a
probability from its count. The three are mixed with weights that are learned for each pair of
confidences (how often a prediction has held in a row) from how often each order was right, so
p(id) = w2 [id = order 2's] + w1 [id = order 1's] + w0 p0(id). A first decision by the weights
says whose prediction holds, and only where none does a second one codes the id by order 0. The
model is renewed after each generation of steps from the ids coded so far; both sides do the
same with integers only, so decoding repeats encoding exactly.

Each block stands alone: header, lane sizes and code words, with a checksum of the ids and one
of the payload.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

LANE = 256
MAX_LANES = 4096
BLOCK_IDS = LANE * MAX_LANES
#: Steps after which the model is renewed; on from the last one every GENERATION steps.
EARLY = (1, 4, 12, 32)
GENERATION = 64
MAGIC = 0x32534449  # "IDS2"
#: Fixed layout: magic, ids, lanes, alphabet, payload bytes, checksum of ids, checksum of payload.
HEADER = struct.Struct("<7I")

_SLOTS = 1 << 16
_CONFIDENCE = 4
#: Pairs of confidences, with and without agreement.
_PACK = 2 * _CONFIDENCE * _CONFIDENCE
_MIX_BITS, _ID_BITS = 16, 20
#: Spans stay at or above it; code words have so many bits.
_FULL, _WORD = 1 << 32, 16


def _slots(before: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Table places of the order-2 and order-1 contexts."""
    two = (before.astype(np.uint32) * np.uint32(0x85EBCA6B)) ^ (last.astype(np.uint32) * np.uint32(0xC2B2AE35))
    return (two >> np.uint32(16)).astype(np.intp), last & (_SLOTS - 1)


class _Order:
    """For each context: the id that followed lately, times _PACK, and how far to trust it, times ``unit``."""

    def __init__(self, none: int, unit: int) -> None:
        self.unit = unit
        self.guess = np.full(_SLOTS, none, dtype=np.int64)
        self.trust = np.zeros(_SLOTS, dtype=np.int64)
        self.held = self.guess * _PACK

    def renew(self, slots: np.ndarray, ids: np.ndarray, right: np.ndarray) -> None:
        change = np.bincount(slots, weights=np.where(right, 1.0, -2.0), minlength=_SLOTS)
        self.trust = np.clip(self.trust + change.astype(np.int64), 0, _CONFIDENCE - 1)
        new = np.flatnonzero((self.trust.take(slots) == 0) & ~right)
        self.guess[slots.take(new)] = ids.take(new)  # of several, the last stays
        self.held = self.guess * _PACK + self.trust * self.unit


class _Model:
    """``alphabet`` is also the guess of a context that has not been met, which no id equals."""

    def __init__(self, alphabet: int) -> None:
        self.alphabet = alphabet
        self.two, self.one = _Order(alphabet, 2 * _CONFIDENCE), _Order(alphabet, 2)
        self.counts = np.zeros(alphabet, dtype=np.int64)
        self.mixed = np.tile(np.array([1, 1, 2], dtype=np.int64), (_PACK, 1))
        self._settle()

    def _settle(self) -> None:
        """Turn counts into cumulative frequencies; ``edges`` bounds order 2's and order 1's shares of the first decision."""
        total = int(self.counts.sum())
        free = (1 << _ID_BITS) - self.alphabet
        self.own = 1 + (self.counts * free // total if total else np.full(self.alphabet, free // self.alphabet))
        self.cum = np.concatenate([[0], np.cumsum(self.own)]).astype(np.int64)
        share = 1 + self.mixed * ((1 << _MIX_BITS) - 3) // self.mixed.sum(axis=1, keepdims=True)
        self.edges = share[:, 0].astype(np.int64), (share[:, 0] + share[:, 1]).astype(np.int64)

    def symbols(self) -> np.ndarray:
        """The id of every point of order 0's range."""
        return np.repeat(np.arange(self.alphabet, dtype=np.int32), self.own)

    def look(self, before: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Order 2's and order 1's ids times _PACK (and less than it more), and the row of mixing weights: both trusts, and whether the ids agree."""
        two, one = _slots(before, last)
        x, y = self.two.held.take(two), self.one.held.take(one)
        return x, y, ((x | y) & (_PACK - 2)) + ((x ^ y) < _PACK)

    def renew(self, before: np.ndarray, last: np.ndarray, ids: np.ndarray, row: np.ndarray, kind: np.ndarray) -> None:
        """Learn from coded ids; kind 0: order 2 was right, 1: order 1 was, 2: neither."""
        seen = np.bincount(row * 3 + kind, minlength=self.mixed.size)
        self.mixed += 8 * seen.reshape(self.mixed.shape)
        two, one = _slots(before, last)
        self.two.renew(two, ids, kind == 0)
        self.one.renew(one, ids, (kind == 1) | ((kind == 0) & (row & 1 == 1)))
        self.counts += np.bincount(ids, minlength=self.alphabet)
        self._settle()


def _generations(steps: int) -> list[tuple[int, int]]:
    edges = [0, *EARLY, *range(GENERATION, steps, GENERATION)]
    edges = [e for e in edges if e < steps] + [steps]
    return list(zip(edges[:-1], edges[1:], strict=True))


def _grid(n: int) -> tuple[int, int, int]:
    """Lanes, steps, and lanes with an id in the last step: those come first and hold ``steps`` ids each, the others one less."""
    lanes = max(1, min(MAX_LANES, -(-n // LANE)))
    steps = -(-n // lanes)
    return lanes, steps, n - lanes * (steps - 1)


def encode_block(ids: np.ndarray) -> bytes:
    """One block of at most BLOCK_IDS ids below 2**19."""
    n = len(ids)
    raw = zlib.crc32(ids.astype("<u4").tobytes())
    if not n:
        return HEADER.pack(MAGIC, 0, 0, 0, 0, raw, 0)
    lanes, steps, full = _grid(n)
    alphabet = int(ids.max()) + 1
    grid = np.zeros((steps + 2, lanes), dtype=np.int64)  # two steps of zeros before the first
    grid[2:, :full] = ids[: full * steps].reshape(full, steps).T
    grid[2 : steps + 1, full:] = ids[full * steps :].reshape(lanes - full, steps - 1).T
    low, span = np.zeros(lanes, dtype=np.int64), np.full(lanes, 1 << 48, dtype=np.int64)
    width = 3 * steps + 8
    words = np.zeros(lanes * width, dtype=np.uint32)
    at = np.arange(lanes) * width
    begins = at.copy()

    def emit(short: np.ndarray) -> None:
        held = low.take(short)
        place = at.take(short)
        words[place] = held >> 32
        at[short] = place + 1
        low[short] = (held & 0xFFFFFFFF) << _WORD
        span[short] <<= _WORD

    model = _Model(alphabet)
    for first, last in _generations(steps):
        two, one, now = grid[first:last], grid[first + 1 : last + 1], grid[first + 2 : last + 2]
        x, y, row = model.look(two, one)
        kind = np.where(x // _PACK == now, 0, np.where(y // _PACK == now, 1, 2))
        left, right = model.edges[0].take(row), model.edges[1].take(row)
        begin = np.where(kind == 2, right, np.where(kind == 1, left, 0))
        size = np.where(kind == 2, 1 << _MIX_BITS, np.where(kind == 1, right, left)) - begin
        for t in range(last - first):
            live = full if first + t == steps - 1 else lanes
            unit = span[:live] >> _MIX_BITS
            low[:live] += unit * begin[t, :live]
            span[:live] = unit * size[t, :live]
            emit(np.flatnonzero(span < _FULL))
            coded = np.flatnonzero(kind[t, :live] == 2)
            own = now[t].take(coded)
            unit = span.take(coded) >> _ID_BITS
            start = model.cum.take(own)
            low[coded] += unit * start
            span[coded] = unit * (model.cum.take(own + 1) - start)
            while len(coded):
                coded = coded[span.take(coded) < _FULL]
                emit(coded)
        if last < steps:
            model.renew(two.ravel(), one.ravel(), now.ravel(), row.ravel(), kind.ravel())
    for shift in (32, 16, 0):
        words[at] = low >> 32 if shift == 32 else (low >> shift) & 0xFFFF
        at += 1
    used = at - begins
    words = words.reshape(lanes, width)
    for column in range(int(used.max()) - 1, 0, -1):  # carries
        words[:, column - 1] += words[:, column] >> np.uint32(16)
    filled = np.arange(width) < used[:, None]
    payload = used.astype("<u2").tobytes() + words[filled].astype("<u2").tobytes()
    return HEADER.pack(MAGIC, n, lanes, alphabet, len(payload), raw, zlib.crc32(payload)) + payload


def decode_block(block: bytes | memoryview) -> np.ndarray:
    """The ids of a block; raises ValueError if a checksum fails."""
    magic, n, lanes, alphabet, size, ids_sum, payload_sum = HEADER.unpack_from(block)
    payload = memoryview(block)[HEADER.size : HEADER.size + size]
    if magic != MAGIC or len(payload) != size or zlib.crc32(payload) != payload_sum:
        raise ValueError("a block of ids is damaged")
    ids = _decode(payload, n, lanes, alphabet) if n else np.zeros(0, dtype=np.int64)
    if zlib.crc32(ids.astype("<u4").tobytes()) != ids_sum:
        raise ValueError("the ids of a block do not match their checksum")
    return ids


def _decode(payload: memoryview, n: int, lanes: int, alphabet: int) -> np.ndarray:
    _, steps, full = _grid(n)
    used = np.frombuffer(payload[: 2 * lanes], dtype="<u2").astype(np.int64)
    words = np.frombuffer(payload[2 * lanes :], dtype="<u2").astype(np.int64)
    at = np.cumsum(used) - used
    code = words[at] << 32 | words[at + 1] << _WORD | words[at + 2]
    at += 3
    span = np.full(lanes, 1 << 48, dtype=np.int64)
    grid = np.zeros((steps + 2, lanes), dtype=np.int64)
    rows, kinds = (np.zeros((steps, lanes), dtype=np.int64) for _ in range(2))

    def refill(short: np.ndarray) -> None:
        place = at.take(short)
        code[short] = code.take(short) << _WORD | words.take(place)
        at[short] = place + 1
        span[short] <<= _WORD

    model = _Model(alphabet)
    for first, last in _generations(steps):
        symbols, cum = model.symbols(), model.cum
        for t in range(first, last):
            live = full if t == steps - 1 else lanes
            x, y, row = model.look(grid[t, :live], grid[t + 1, :live])
            unit = span[:live] >> _MIX_BITS
            left, right = unit * model.edges[0].take(row), unit * model.edges[1].take(row)
            held = code[:live]
            not_two, neither = held >= left, held >= right
            begin = np.where(neither, right, left * not_two)
            span[:live] = np.where(neither, unit << _MIX_BITS, np.where(not_two, right, left)) - begin
            rows[t, :live] = row
            np.add(not_two, neither, out=kinds[t, :live], dtype=np.int64)
            held -= begin
            refill(np.flatnonzero(span < _FULL))
            coded = np.flatnonzero(neither)
            now = np.where(not_two, y, x) // _PACK
            unit = span.take(coded) >> _ID_BITS
            rest = code.take(coded)
            # both are below 2**53, so the quotient of floats has the right whole part
            found = symbols.take((rest.astype(np.float64) / unit.astype(np.float64)).astype(np.int64), mode="clip").astype(np.int64)
            start = cum.take(found)
            code[coded] = rest - unit * start
            span[coded] = unit * (cum.take(found + 1) - start)
            now[coded] = found
            while len(coded):
                coded = coded[span.take(coded) < _FULL]
                refill(coded)
            grid[t + 2, :live] = now
        if last < steps:
            some = (grid[first:last], grid[first + 1 : last + 1], grid[first + 2 : last + 2], rows[first:last], kinds[first:last])
            model.renew(*(a.ravel() for a in some))
    return np.concatenate([grid[2:, :full].T.ravel(), grid[2 : steps + 1, full:].T.ravel()])
