"""Logistic mixing of hashed-context bit predictors over the bytes of words, in numpy.

A word is its bytes and a space (the end of a text is the space alone, which no word is); each byte
is eight binary decisions. Predictors look up a hashed context (the last 0 to 4 bytes of the word, or
all of it so far, and the kind of text) together
with the bits of the byte so far, and know how often a 1 and a 0 followed in training. Their log odds
are mixed by weights that a gate chooses: how often the two longest contexts were seen. The
weights are learned online, block after block of words, each word's own last occurrence being
left out of its counts. An adaptive map, by the mixed log odds and the last byte, refines the
result: it learns what share of 1s followed such odds.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Slots of each context's table, as powers of two: no byte, 1, 2, 3 and 4 bytes, the whole word so far.
SLOTS = (8, 16, 18, 20, 20, 21)
CONTEXTS = len(SLOTS)
FIRST = np.concatenate([[0], np.cumsum([1 << s for s in SLOTS])]).astype(np.int64)
#: Words in a block and in one that is only counted, levels of a gate's confidence, steps of the adaptive map.
BLOCK, COUNTED, LEVELS, STEPS = 1024, 1 << 15, 12, 33
GATES = LEVELS * LEVELS
_M = 0x9E3779B97F4A7C15
_INVERSE = np.uint64(pow(_M, -1, 1 << 64))
_SALTS = [np.uint64(0xD1B54A32D192ED03 * (i + 1) & (1 << 64) - 1 | 1) for i in range(CONTEXTS)]
_DOWN = np.arange(7, -1, -1)
_NODES = np.array([[(1 << j) | (b >> (8 - j)) for j in range(8)] for b in range(256)], dtype=np.uint64)
#: What each bit of each byte adds to a context, by context: nodes times the context's salt.
with np.errstate(over="ignore"):
    _SALTED = [_NODES * salt for salt in _SALTS]
_BITS = np.array([[(b >> k) & 1 for k in _DOWN] for b in range(256)], dtype=np.uint8)


@dataclass
class Block:
    slots: np.ndarray  # contexts x bits of all words: places in the tables
    bits: np.ndarray
    last: np.ndarray  # the byte before, for each bit
    word: np.ndarray  # each bit's word


def block(words: list[bytes], kinds: np.ndarray) -> Block:
    data = np.frombuffer(b" ".join(words) + b" ", dtype=np.uint8)
    size = np.array([len(w) + 1 for w in words])
    start = np.repeat(np.cumsum(size) - size, size)
    place = np.arange(len(data)) - start
    wide = data.astype(np.uint64)
    before = np.zeros(len(data), dtype=np.uint64)
    seen = [before]
    for k in range(1, CONTEXTS - 1):
        own = np.zeros(len(data), dtype=np.uint64)
        own[k:] = wide[:-k] + np.uint64(1)
        own[place < k] = 0
        before = (before << np.uint64(9)) | own
        seen.append(before)
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(data), _M, dtype=np.uint64)]))
        back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(data), _INVERSE, dtype=np.uint64)]))
        sums = np.concatenate([[np.uint64(0)], np.cumsum((wide + np.uint64(1)) * powers[:-1])])
        seen.append((sums[np.arange(len(data))] - sums[start]) * back[start])
        kind = np.repeat(kinds, size).astype(np.uint64) * np.uint64(0xA24BAED4963EE407)
        slots = np.empty((CONTEXTS, len(data) * 8), dtype=np.int64)
        for i, (context, power) in enumerate(zip(seen, SLOTS, strict=True)):
            context = (context + kind) * np.uint64(_M)
            context ^= context >> np.uint64(29)
            mixed = _SALTED[i][data]
            mixed += context[:, None]
            mixed *= np.uint64(_M)
            mixed >>= np.uint64(64 - power)
            np.add(mixed.view(np.int64).ravel(), FIRST[i], out=slots[i])
    last = np.repeat(np.where(place > 0, np.concatenate([[0], data[:-1]]), 0), 8).astype(np.int64)
    return Block(slots, _BITS[data].ravel(), last, np.repeat(np.arange(len(words)), size * 8))


def counted(words: list[bytes], kinds: np.ndarray, times: np.ndarray, ones: np.ndarray, every: np.ndarray) -> None:
    """Adds words, each so many times, to the tables of 1s and of all decisions."""
    for at in range(0, len(words), COUNTED):
        b = block(words[at : at + COUNTED], kinds[at : at + COUNTED])
        n = times[at : at + COUNTED][b.word].astype(np.float64)
        for i in range(CONTEXTS):
            low, high = FIRST[i], FIRST[i + 1]
            # zeros at even places, ones at odd ones
            both = np.bincount((b.slots[i] - low) * 2 + b.bits, weights=n, minlength=2 * (high - low))
            ones[low:high] += both[1::2]
            every[low:high] += both[::2]
            every[low:high] += both[1::2]


def _log_odds(ones: np.ndarray, every: np.ndarray) -> np.ndarray:
    return np.log((ones + 0.4) / (every - ones + 0.4))


def _level(every: np.ndarray) -> np.ndarray:
    return np.minimum(LEVELS - 1, np.log2(every + 1)).astype(np.int64)


def _squash(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -20, 20)))


class Weights:
    """Mixing weights by gate (one for each context and a constant), and the adaptive map's counts."""

    def __init__(self) -> None:
        self.mix = np.full((GATES, CONTEXTS + 1), 0.3)
        self.mix[:, -1] = 0
        self.square = np.full_like(self.mix, 1e-6)
        self.map = np.zeros((2, STEPS, 256))

    @staticmethod
    def step(z: np.ndarray) -> np.ndarray:
        return np.clip(np.rint(z * 2) + STEPS // 2, 0, STEPS - 1).astype(np.int64)

    def shifts(self) -> np.ndarray:
        """By step and last byte, how far what followed such odds lies from them, in log odds."""
        centre = _squash((np.arange(STEPS) - STEPS // 2) / 2)[:, None]
        learned = (self.map[0] + 8 * centre) / (self.map[1] + 8)
        return np.log(learned / (1 - learned)) - np.log(centre / (1 - centre))

    def learn(self, words: list[bytes], kinds: np.ndarray, times: np.ndarray, pairs: np.ndarray, rate: float = 0.1) -> None:
        """Online: a block's error corrects the weights before the next block is mixed."""
        for at in range(0, len(words), BLOCK):
            b = block(words[at : at + BLOCK], kinds[at : at + BLOCK])
            n = times[at : at + BLOCK][b.word].astype(np.float32)
            both = pairs.take(b.slots).view(np.float16).reshape(CONTEXTS, -1, 2)
            one, zero = both[:, :, 0].astype(np.float32), both[:, :, 1].astype(np.float32)
            one -= b.bits
            zero -= 1 - b.bits
            np.maximum(one, 0, out=one)
            np.maximum(zero, 0, out=zero)
            gate = _level(one[-1] + zero[-1]) * LEVELS + _level(one[3] + zero[3])
            one += np.float32(0.4)
            zero += np.float32(0.4)
            one /= zero
            inputs = np.log(one, out=one)
            own = self.mix.astype(np.float32)
            z = own[:, -1].take(gate)
            for i in range(CONTEXTS):
                z += inputs[i] * own[:, i].take(gate)
            s = self.step(z) * 256 + b.last
            self.map[0] += np.bincount(s, weights=n * b.bits, minlength=STEPS * 256).reshape(STEPS, 256)
            self.map[1] += np.bincount(s, weights=n, minlength=STEPS * 256).reshape(STEPS, 256)
            miss = n * (1 / (1 + np.exp(-np.clip(z, -20, 20))) - b.bits)
            mass = np.maximum(1e-9, np.bincount(gate, weights=n, minlength=GATES))
            for i in range(CONTEXTS + 1):
                grad = np.bincount(gate, weights=miss * inputs[i] if i < CONTEXTS else miss, minlength=GATES) / mass
                self.square[:, i] += grad**2
                self.mix[:, i] -= rate * grad / np.sqrt(self.square[:, i])


def shrunk(ones: np.ndarray, every: np.ndarray) -> tuple[np.ndarray]:
    """Counts of 1s and of 0s in 16 bits, side by side in one number: large ones lose digits, and those above 60,000 are scaled down in pairs."""
    scale = np.minimum(1, 60_000 / np.maximum(every, 1))
    both = np.empty((len(ones), 2), dtype=np.float16)
    both[:, 0], both[:, 1] = ones * scale, (every - ones) * scale
    return (both.view(np.uint32).ravel(),)


@dataclass
class Model:
    """Tables turned into log odds and levels, for scoring."""

    odds: np.ndarray
    levels: np.ndarray
    mix: np.ndarray
    shift: np.ndarray

    @classmethod
    def of(cls, ones: np.ndarray, every: np.ndarray, weights: Weights) -> Model:
        return cls(_log_odds(ones, every).astype(np.float16), _level(every).astype(np.uint8), weights.mix.astype(np.float32), weights.shifts().astype(np.float32))

    def score(self, words: list[bytes], kinds: np.ndarray) -> np.ndarray:
        """The log10 probability of each word; a bit's is the mean of the mixed and the refined one."""
        out = np.empty(len(words))
        for at in range(0, len(words), BLOCK):
            some = words[at : at + BLOCK]
            b = block(some, kinds[at : at + BLOCK])
            gate = self.levels[b.slots[-1]].astype(np.int64) * LEVELS + self.levels[b.slots[3]]
            z = self.mix[:, -1].take(gate)
            for i in range(CONTEXTS):
                z += self.odds.take(b.slots[i]) * self.mix[:, i].take(gate)
            # the odds of the bit that there is
            refined = z + self.shift[Weights.step(z), b.last]
            sign = np.where(b.bits == 1, np.float32(-1), np.float32(1))
            p = (1 / (1 + np.exp(np.clip(z * sign, -14, 14))) + 1 / (1 + np.exp(np.clip(refined * sign, -14, 14)))) / 2
            out[at : at + len(some)] = np.bincount(b.word, weights=np.log10(p), minlength=len(some))
        return out
