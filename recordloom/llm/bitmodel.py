"""Online logistic mixing of hashed-context bit predictors over the bytes of text units, with numpy.

A unit is a run of bytes that is coded on its own: its contexts look back inside it only. Each byte
is eight binary decisions, and each predictor has, for its context (the last 1, 2, 3 or 5 bytes, or
all of the unit so far) and the bits of the byte so far, a hashed slot with the counts of zeros and
ones. The mixer adds the predictors' log-odds with a set of weights that is gated by how often the
two longest contexts have been met; weights follow the gradient of the coding cost batch by batch.
A refining table turns each gate's mixed log-odds, in steps, into what was observed at them, and
the average of both is used. All probabilities are of one binary decision, so they add up to one.

After a blank one more decision tells whether the unit goes on with a further blank. A unit that
ends a text without a blank ends with END.
"""

from __future__ import annotations

import numpy as np

from recordloom.llm.textops import BLANKS, mix

#: A byte that no UTF-8 text has.
END = 0xFF
#: Bytes each predictor looks back (0: to the start of the unit), and the bits of its table.
LOOKS = (1, 2, 3, 5, 0)
TABLE_BITS = (16, 19, 20, 21, 21)
STARTS = np.concatenate([[0], np.cumsum([1 << b for b in TABLE_BITS])])
SLOTS = int(STARTS[-1])
#: Counts up to EXACT are kept as they are, larger ones in steps of an eighth of a power of two.
EXACT = 31
GATES = 25
INPUTS = len(LOOKS) + 1
#: Steps of mixed log-odds in the refining table: halves between these bounds.
REFINE = 24
_RATE = 0.3
_LIMIT = 14.0
_NODE = np.uint32(0x9E3779B1)


def _levels() -> tuple[np.ndarray, np.ndarray]:
    """The count that each of 256 codes stands for, and the least count of each."""
    exact = np.arange(EXACT + 1, dtype=np.float64)
    steps = 2.0 ** (5 + np.arange(1, 256 - len(exact) + 1) / 8)
    least = np.concatenate([exact, np.ceil(steps / 2 ** (1 / 16))])
    least[EXACT + 1] = EXACT + 1
    return np.concatenate([exact, steps]), np.maximum.accumulate(least)


COUNT_OF, LEAST_OF = _levels()


def coded(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Both counts of slots in 16 bits."""
    high, low = (np.searchsorted(LEAST_OF, v, side="right") - 1 for v in (zeros, ones))
    return (high << 8 | low).astype(np.uint16)


def _log_odds(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return np.log((ones + 0.05) / (zeros + 0.05)).astype(np.float32)


_ZEROS, _ONES = np.repeat(COUNT_OF, 256), np.tile(COUNT_OF, 256)
#: Log-odds by code: as they are, and without one observed zero or one.
ODDS = _log_odds(_ZEROS, _ONES)
WITHOUT = np.stack([_log_odds(np.where(_ZEROS <= EXACT, np.maximum(_ZEROS - 1, 0), _ZEROS), _ONES), _log_odds(_ZEROS, np.where(_ONES <= EXACT, np.maximum(_ONES - 1, 0), _ONES))])
#: How often a slot was met, in five steps; the last two tables leave one observation out.
_TRUST = np.array([1, 3, 8, 32])
MET = np.searchsorted(_TRUST, _ZEROS + _ONES, side="right").astype(np.int8)
MET_WITHOUT = np.searchsorted(_TRUST, np.maximum(_ZEROS + _ONES - 1, 0), side="right").astype(np.int8)


class Events:
    """The decisions of a batch of units: ``data`` their joined bytes, ``offsets`` their bounds."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        n = len(offsets) - 1
        whole = np.insert(data, offsets[1:], 0)  # one place more for each unit: after its last byte
        begins = offsets[:-1] + np.arange(n)
        sizes = np.diff(offsets) + 1
        self.unit = np.repeat(np.arange(n), sizes)
        at = np.arange(len(whole)) - np.repeat(begins, sizes)
        self.byte = whole.astype(np.uint32)
        back = [np.where(at >= k, np.concatenate([np.zeros(k, dtype=np.uint64), whole[:-k].astype(np.uint64) + np.uint64(1)])[: len(whole)], 0).astype(np.uint64) for k in range(1, 6)]
        self.contexts = [self._spread(sum(back[j] << np.uint64(9 * j) for j in range(k)), i) for i, k in enumerate(LOOKS[:-1])]
        powers = np.full(int(sizes.max(initial=1)), 0x9E3779B97F4A7C15, dtype=np.uint64)
        powers[0] = 1
        powers = np.multiply.accumulate(powers)
        sums = np.concatenate([[np.uint64(0)], np.cumsum((whole.astype(np.uint64) + np.uint64(1)) * powers[at])])
        self.contexts.append(self._spread(sums[:-1] - sums[np.repeat(begins, sizes)], len(LOOKS) - 1))
        self.inside = np.flatnonzero(at < np.repeat(sizes, sizes) - 1)
        blank = np.concatenate([[False], BLANKS[whole[:-1]]]) & (at > 0) if len(whole) else np.zeros(0, dtype=bool)
        self.after = np.flatnonzero(blank)
        self.goes_on = (at < np.repeat(sizes, sizes) - 1)[self.after]

    @staticmethod
    def _spread(context: np.ndarray, table: int) -> np.ndarray:
        return (mix(context + np.uint64(table + 1)) >> np.uint64(32)).astype(np.uint32)

    def __iter__(self):
        """Yield (places, slots of each predictor, observed bits) of each of the nine decisions."""
        inside = [c[self.inside] for c in self.contexts]
        byte = self.byte[self.inside]
        for k in range(8):
            node = np.uint32(1 << k) | byte >> np.uint32(8 - k)
            yield self.inside, self._slots(inside, node * _NODE), (byte >> np.uint32(7 - k) & np.uint32(1)).astype(np.int8)
        yield self.after, self._slots([c[self.after] for c in self.contexts], np.uint32(0)), self.goes_on.astype(np.int8)

    @staticmethod
    def _slots(contexts: list[np.ndarray], node: np.ndarray) -> list[np.ndarray]:
        return [((c + node) * np.uint32(0x85EBCA6B) >> np.uint32(32 - b)).astype(np.int64) + s for c, b, s in zip(contexts, TABLE_BITS, STARTS.tolist(), strict=False)]


def count(events: Events, times: np.ndarray, table: np.ndarray) -> None:
    """Add the units' decisions, each ``times`` of its unit, to the counts: table[2 * slot + bit]."""
    for places, slots, bits in events:
        own = times[events.unit[places]]
        for slot in slots:
            np.add.at(table, 2 * slot + bits, own)


def _first_weights() -> np.ndarray:
    """To begin with, the longest context that has been met often counts most."""
    weights = np.zeros((GATES, INPUTS))
    share = np.array([0.0, 0.3, 0.6, 0.8, 0.95])
    for gate in range(GATES):
        whole, five = share[gate // 5], (1 - share[gate // 5]) * share[gate % 5]
        rest = 1 - whole - five
        weights[gate, :5] = 0.1 * rest, 0.2 * rest, 0.7 * rest, five, whole
    return weights


class Mixer:
    """Weights by gate, and the refining table's counts by gate and step."""

    def __init__(self, codes: np.ndarray) -> None:
        self.codes = codes
        self.weights = _first_weights()
        self.refined: np.ndarray | None = None

    def _inputs(self, slots: list[np.ndarray], bits: np.ndarray | None) -> tuple[list[np.ndarray], np.ndarray]:
        """Log-odds of each predictor and the gate of each decision; with ``bits``, each without this observation."""
        codes = [self.codes.take(s) for s in slots]
        if bits is None:
            odds, met = [ODDS.take(c) for c in codes], MET
        else:
            row = bits.astype(np.int64) << 16
            odds, met = [WITHOUT.ravel().take(row + c) for c in codes], MET_WITHOUT
        return odds, 5 * met.take(codes[-1]).astype(np.int64) + met.take(codes[-2])

    def _mixed(self, odds: list[np.ndarray], gate: np.ndarray) -> np.ndarray:
        weights = self.weights.astype(np.float32)
        total = weights[:, -1].take(gate)
        for i, o in enumerate(odds):
            total += weights[:, i].take(gate) * o
        return np.clip(total, -_LIMIT, _LIMIT)

    @staticmethod
    def _step(mixed: np.ndarray) -> np.ndarray:
        return np.clip(np.rint(2 * mixed).astype(np.int64) + REFINE // 2, 0, REFINE)

    def learn(self, batches) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Follow batches of (events, times): the weights' mean over the second half of each gate's steps, how much each gate has seen, and the refining counts."""
        curve = np.ones((GATES, INPUTS))
        mean, seen = self.weights.copy(), np.zeros(GATES)
        steps, refining = np.zeros(GATES, dtype=np.int64), np.zeros((GATES * (REFINE + 1), 2), dtype=np.int64)
        for events, times in batches:
            for places, slots, bits in events:
                if not len(places):
                    continue
                own = times[events.unit[places]]
                odds, gate = self._inputs(slots, bits)
                mixed = self._mixed(odds, gate)
                p = 1 / (1 + np.exp(-mixed))
                refining += np.bincount(2 * (gate * (REFINE + 1) + self._step(mixed)) + bits, weights=own, minlength=refining.size).astype(np.int64).reshape(refining.shape)
                weight = np.bincount(gate, weights=own, minlength=GATES)
                error, slope = own * (bits - p), own * np.maximum(p * (1 - p), 1e-4)
                met = np.flatnonzero(weight)
                for i in range(INPUTS):
                    x = odds[i] if i < len(odds) else np.float32(1)
                    gradient = np.bincount(gate, weights=error * x, minlength=GATES)[met] / weight[met]
                    bend = np.bincount(gate, weights=slope * x * x, minlength=GATES)[met] / weight[met]
                    curve[met, i] = 0.9 * curve[met, i] + 0.1 * bend
                    self.weights[met, i] += np.clip(_RATE / len(LOOKS) * gradient / (curve[met, i] + 1e-3), -0.1, 0.1)
                steps[met] += 1
                seen += weight
                share = (2.0 / (steps[met] + 2))[:, None]
                mean[met] += share * (self.weights[met] - mean[met])
        return mean, seen, refining

    def settle(self, weights: np.ndarray, refining: np.ndarray) -> None:
        """Use learned weights and refining counts."""
        self.weights = weights
        step = (np.arange(REFINE + 1) - REFINE // 2) / 2
        prior = 1 / (1 + np.exp(-np.tile(step, GATES)))
        zeros, ones = refining[:, 0] + 4 * (1 - prior), refining[:, 1] + 4 * prior
        self.refined = np.clip(np.log(ones / zeros), -_LIMIT, _LIMIT).astype(np.float32).reshape(GATES, REFINE + 1)

    def cost(self, events: Events, n: int) -> np.ndarray:
        """Bits that each of the batch's n units takes."""
        out = np.zeros(n)
        for places, slots, bits in events:
            odds, gate = self._inputs(slots, None)
            mixed = self._mixed(odds, gate)
            if self.refined is not None:
                mixed = (mixed + self.refined.ravel().take(gate * (REFINE + 1) + self._step(mixed))) / 2
            # -log2 of the observed side's probability
            bits_taken = np.logaddexp(0, np.where(bits == 1, -mixed, mixed)) / np.log(2)
            out += np.bincount(events.unit[places], weights=bits_taken, minlength=n)
        return out
