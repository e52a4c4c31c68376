"""Adaptive context-mixing range coder for token ids, in blocks that stand alone.

Ids of a block are dealt to lanes, contiguous runs of STEPS ids. All lanes of a block share one model
and move in step: step t codes the t-th id of every lane, then the model learns these ids. So numpy
does a step for thousands of ids at once, and a decoder that has the ids before step t has the same model.

The model. Order 2 (the two ids before, hashed) and order 1 (the id before) each predict one id, with a
confidence from 0 to 7 that hits raise and misses lower. A first decision says whether the id is the
one predicted by order 2, the one by order 1, or neither. Three experts each have adaptive probabilities of these: order 2 by its
confidence, order 1 by its own, order 0 by how often it has seen either id. They are mixed in the log domain, with weights
that follow the gradient of the code length, and the mixture is what is coded. If neither prediction is right, the id is
coded with the adaptive order-0 counts of the ids that were missed before. All of it is whole numbers, so that
every machine has the same model.

The coder is a carry-less range coder with 64-bit low and range that emits 16-bit words, one per lane.

Block: MAGIC, then little-endian u32 vocab, documents, ids, lanes, length of the index; the index
(zlib: i64 differences of doc_ids, a null mask, i64 numbers of ids); u32 words in each lane; the words
of all lanes; u32 crc32 of the ids; u32 crc32 of all that is before.
"""

from __future__ import annotations

import math
import struct
import zlib

import numpy as np

MAGIC = b"SDTK2\n"
STEPS = 256
_U = np.uint64
_TOP, _BOT, _MASK32 = _U(1 << 48), _U(1 << 32), _U((1 << 32) - 1)
_HASH_BITS = 19


class BlockError(ValueError):
    """A block that isn't whole."""


#: Bits of a mixed probability, of a weight and of a logarithm's fraction.
_PROB, _WEIGHT, _LOG = 16, 16, 12
#: Where an expert's counts are halved, and logarithms (base 2) of all counts below.
_LIMIT = 1 << 14
_LOGS = np.array([0, *(round(math.log2(x) * (1 << _LOG)) for x in range(1, 4 * _LIMIT))], np.int64)
_POWERS = np.array([round(2 ** (24 - x / (1 << _LOG))) for x in range(1 << _LOG)], np.int64)
#: Counts of order 0 from which an id is of the next level.
_LEVELS = (2, 200, 4000)
#: How fast weights follow their gradient.
_RATE = 3
#: Steps after which the mixture is made anew; before the first so many, after 1, 2, 4, 8.
_EVERY = 16
#: The next confidence, by 8 times whether the prediction was right and the last one.
_CONFIDENCE = np.array([*(max(k - 1, 0) for k in range(8)), *(min(k + 1, 7) for k in range(8))], np.int32)
#: States: confidences of order 2 and 1 (8 each), whether they predict the same, levels of both ids (4 each).
_STATES = 8 * 8 * 2 * 4 * 4


class _Model:
    def __init__(self, vocab: int):
        self.zero, self.level = np.ones(vocab, np.int64), np.zeros(vocab, np.int8)
        # predicted ids with their confidences in the lowest three bits
        self.two, self.one = np.zeros(1 << _HASH_BITS, np.int32), np.zeros(vocab + 1, np.int32)
        # of each expert, the axes of the states that it knows
        self.experts = [((1, 3, 4), np.tile(np.array([6, 3, 6], np.int64), (8, 2, 1))), ((0, 3, 4), np.tile(np.array([6, 3, 6], np.int64), (8, 2, 1))), ((0, 1, 2), np.tile(np.array([6, 3, 6], np.int64), (4, 4, 1)))]
        self.weights = [(1 << _WEIGHT) * 5 // 8, (1 << _WEIGHT) * 3 // 8, (1 << _WEIGHT) * 3 // 8]
        self.seen, self.steps = np.zeros(3 * _STATES, np.int64), 0
        self._mix()

    def _mix(self) -> None:
        """The mixture for every state: where the range of each decision begins and its size, of 1 << _PROB."""
        self.logs = []
        total = 0
        for (axes, counts), weight in zip(self.experts, self.weights, strict=True):
            log = np.expand_dims(_LOGS[counts] - _LOGS[counts.sum(axis=-1)][..., None], axes)
            self.logs.append(log)
            total = total + weight * log
        down = -(total >> _WEIGHT)
        power = (_POWERS[down & ((1 << _LOG) - 1)] >> np.minimum(down >> _LOG, 24)).reshape(-1, 3)
        size = 1 + power * ((1 << _PROB) - 3) // (power.sum(axis=1)[:, None] + 1)
        size[:, 2] = (1 << _PROB) - size[:, 0] - size[:, 1]
        self.sizes = size.reshape(-1)
        self.begins = (np.cumsum(size, axis=1) - size).reshape(-1)

    def _weigh(self) -> None:
        """Experts and weights learn what was decided since the last time."""
        seen = self.seen.reshape(8, 8, 2, 4, 4, 3)
        number = seen.sum(axis=-1, keepdims=True)
        error, total = (seen << _PROB) - number * self.sizes.reshape(seen.shape), int(number.sum())
        for k, (axes, counts) in enumerate(self.experts):
            slope = int((error * self.logs[k]).sum()) // total
            self.weights[k] = min(max(self.weights[k] + (slope * _RATE >> (_PROB + _LOG - _WEIGHT + 4)), 0), 2 << _WEIGHT)
            counts += seen.sum(axis=axes)
            while (full := counts.sum(axis=-1) > _LIMIT).any():
                counts[full] = (counts[full] >> 1) + 1
        self.seen[:] = 0
        self._mix()

    def predict(self, before: np.ndarray, before2: np.ndarray) -> None:
        """What orders 1 and 2 say of the next ids. 0 stands for no id, others are moved up by 1."""
        self.at1 = before
        self.at2 = ((before2.astype(np.uint64) * _U(0x9E3779B97F4A7C15) + before.astype(np.uint64) * _U(0xC2B2AE3D27D4EB4F)) >> _U(64 - _HASH_BITS)).astype(np.int64)
        self.said2, self.said1 = self.two[self.at2], self.one[self.at1]
        self.p2, self.k2, self.p1, self.k1 = self.said2 >> 3, self.said2 & 7, self.said1 >> 3, self.said1 & 7
        known = (self.k2 << 4) | (self.k1 << 1) | (self.p1 == self.p2)
        self.state = ((known << 4) | (self.level[self.p2] << 2) | self.level[self.p1]).astype(np.int64)

    def learn(self, ids: np.ndarray, flags: np.ndarray, missed: np.ndarray) -> None:
        self.seen += np.bincount(self.state * 3 + flags, minlength=3 * _STATES)
        self.steps += 1
        if self.steps % _EVERY == 0 or self.steps in (1, 2, 4, 8):
            self._weigh()
        np.add.at(self.zero, missed, 24)
        now = self.zero[missed]
        self.level[missed] = sum((now >= x).view(np.int8) for x in _LEVELS)
        moved = ids.astype(np.int32) << 3
        for table, at, said, p, k in ((self.two, self.at2, self.said2, self.p2, self.k2), (self.one, self.at1, self.said1, self.p1, self.k1)):
            table[at] = np.where(k > 0, said - k, moved) | _CONFIDENCE[((p == ids).view(np.int8) << 3) | k]


class _Writer:
    def __init__(self, lanes: int, steps: int):
        self.low, self.range = np.zeros(lanes, _U), np.full(lanes, ~_U(0), _U)
        self.out, self.n = np.zeros((lanes, 5 * steps + 8), np.uint16), np.zeros(lanes, np.int64)

    def put(self, lanes: np.ndarray | int, start: np.ndarray, size: np.ndarray, total: int | None = None) -> None:
        """lanes: their numbers, or how many of the first. Without a total, it is 1 << _PROB."""
        who = slice(0, lanes) if isinstance(lanes, int) else lanes
        rng = self.range[who] >> _U(_PROB) if total is None else self.range[who] // _U(total)
        low = self.low[who] + rng * start.view(_U)
        rng *= size.view(_U)
        todo = np.flatnonzero(((low ^ (low + rng)) < _TOP) | (rng < _BOT))
        while len(todo):
            a, r = low[todo], rng[todo]
            r = np.where((a ^ (a + r)) < _TOP, r, (~a + _U(1)) & _MASK32)
            own = todo if isinstance(lanes, int) else lanes[todo]
            n = self.n[own]
            self.out[own, n] = (a >> _U(48)).astype(np.uint16)
            self.n[own] = n + 1
            a, r = a << _U(16), r << _U(16)
            low[todo], rng[todo] = a, r
            todo = todo[((a ^ (a + r)) < _TOP) | (r < _BOT)]
        self.low[who], self.range[who] = low, rng

    def end(self) -> tuple[np.ndarray, np.ndarray]:
        """Two words for each lane are enough to name a number in its last range, as that is 2**32 at least."""
        last = (self.low + _MASK32) & ~_MASK32
        lanes = np.arange(len(last))
        for shift in (48, 32):
            self.out[lanes, self.n] = (last >> _U(shift)).astype(np.uint16)
            self.n += 1
        used = np.arange(self.out.shape[1]) < self.n[:, None]
        return self.out[used], self.n


class _Reader:
    def __init__(self, words: np.ndarray, n: np.ndarray):
        self.words = np.concatenate([words, np.zeros(4, np.uint16)]).astype(_U)
        self.end = np.cumsum(n)
        self.at = self.end - n
        self.low, self.range, self.code = np.zeros(len(n), _U), np.full(len(n), ~_U(0), _U), np.zeros(len(n), _U)
        for _ in range(4):
            self.code = (self.code << _U(16)) | self._next(np.arange(len(n)))

    def _next(self, lanes: np.ndarray) -> np.ndarray:
        at, end = self.at[lanes], self.end[lanes]
        got = np.where(at < end, self.words[np.minimum(at, len(self.words) - 1)], _U(0))
        self.at[lanes] += 1
        return got

    def decide(self, lanes: int, second: np.ndarray, third: np.ndarray) -> np.ndarray:
        """Which of three decisions is next, by where the ranges of the second and the third begin, of 1 << _PROB."""
        self.unit = self.range[:lanes] >> _U(_PROB)
        beyond = self.code[:lanes] - self.low[:lanes]
        return (beyond >= self.unit * second.view(_U)).astype(np.int64) + (beyond >= self.unit * third.view(_U))

    def peek(self, lanes: np.ndarray, total: int) -> np.ndarray:
        self.unit = self.range[lanes] // _U(total)
        return np.minimum((self.code[lanes] - self.low[lanes]) // self.unit, _U(total - 1)).view(np.int64)

    def take(self, lanes: np.ndarray | int, start: np.ndarray, size: np.ndarray) -> None:
        who = slice(0, lanes) if isinstance(lanes, int) else lanes
        low, rng, code = self.low[who] + self.unit * start.view(_U), self.unit * size.view(_U), self.code[who].copy()
        todo = np.flatnonzero(((low ^ (low + rng)) < _TOP) | (rng < _BOT))
        while len(todo):
            a, r = low[todo], rng[todo]
            r = np.where((a ^ (a + r)) < _TOP, r, (~a + _U(1)) & _MASK32)
            code[todo] = (code[todo] << _U(16)) | self._next(todo if isinstance(lanes, int) else lanes[todo])
            a, r = a << _U(16), r << _U(16)
            low[todo], rng[todo] = a, r
            todo = todo[((a ^ (a + r)) < _TOP) | (r < _BOT)]
        self.low[who], self.range[who], self.code[who] = low, rng, code


def _place(cdf: np.ndarray, values: np.ndarray) -> np.ndarray:
    """np.searchsorted(cdf, values, side="right"), asked in ascending order, which takes fewer steps through memory."""
    bits = len(values).bit_length()
    order = np.sort((values << bits) | np.arange(len(values)))
    at = np.empty(len(values), np.int64)
    at[order & ((1 << bits) - 1)] = np.searchsorted(cdf, order >> bits, side="right")
    return at


def _shape(n: int) -> tuple[int, int, int]:
    """Lanes, steps, and the steps of the last lane."""
    lanes = max(1, -(-n // STEPS))
    return lanes, min(n, STEPS), n - (lanes - 1) * STEPS


def encode_ids(ids: np.ndarray, vocab: int) -> tuple[np.ndarray, np.ndarray]:
    """Words of all lanes, and the number of words of each lane."""
    lanes, steps, last = _shape(len(ids))
    model, out = _Model(vocab), _Writer(lanes, steps)
    grid = np.zeros(lanes * STEPS, np.int32)
    grid[: len(ids)] = ids
    grid = np.ascontiguousarray(grid.reshape(lanes, STEPS).T)
    before = before2 = np.zeros(lanes, np.int32)
    for t in range(steps):
        if t == last:
            before, before2 = before[:-1], before2[:-1]
        x = grid[t, : len(before)]
        model.predict(before, before2)
        flags = (np.int64(2) - (x == model.p1)) * (x != model.p2)
        at = model.state * 3 + flags
        out.put(len(x), model.begins[at], model.sizes[at])
        miss = np.flatnonzero(flags == 2)
        missed = x[miss]
        if len(miss):
            cdf = np.cumsum(model.zero)
            size = model.zero[missed]
            out.put(miss, cdf[missed] - size, size, int(cdf[-1]))
        model.learn(x, flags, missed)
        before2, before = before, x + 1
    return out.end()


def decode_ids(words: np.ndarray, counts: np.ndarray, n: int, vocab: int) -> np.ndarray:
    lanes, steps, last = _shape(n)
    model, read = _Model(vocab), _Reader(words, counts)
    grid = np.zeros((STEPS, lanes), np.int32)
    before = before2 = np.zeros(lanes, np.int32)
    for t in range(steps):
        if t == last:
            before, before2 = before[:-1], before2[:-1]
        model.predict(before, before2)
        at = model.state * 3
        flags = read.decide(len(before), model.begins[at + 1], model.begins[at + 2])
        at += flags
        read.take(len(before), model.begins[at], model.sizes[at])
        x = np.where(flags == 0, model.p2, model.p1)
        miss = np.flatnonzero(flags == 2)
        missed = np.zeros(0, np.int64)
        if len(miss):
            cdf = np.cumsum(model.zero)
            missed = _place(cdf, read.peek(miss, int(cdf[-1])))
            size = model.zero[missed]
            read.take(miss, cdf[missed] - size, size)
            x[miss] = missed
        grid[t, : len(before)] = x
        model.learn(x, flags, missed)
        before2, before = before, x + 1
    return np.ascontiguousarray(grid.T).reshape(-1)[:n]


def pack_block(doc_ids: np.ndarray, nulls: np.ndarray, counts: np.ndarray, ids: np.ndarray, vocab: int) -> bytes:
    """A block of whole documents."""
    if len(ids) and int(ids.max()) >= vocab or vocab > 1 << 28:
        raise ValueError("an id is outside the vocabulary, or that is too large")
    index = zlib.compress(np.diff(doc_ids.astype("<i8"), prepend=0).tobytes() + nulls.astype(np.uint8).tobytes() + counts.astype("<i8").tobytes(), 6)
    words, n = encode_ids(ids, vocab) if len(ids) else (np.zeros(0, np.uint16), np.zeros(0, np.int64))
    body = MAGIC + struct.pack("<5I", vocab, len(counts), len(ids), len(n), len(index)) + index + n.astype("<u4").tobytes() + words.astype("<u2").tobytes() + struct.pack("<I", zlib.crc32(ids.astype("<u4").tobytes()))
    return body + struct.pack("<I", zlib.crc32(body))


def unpack_block(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids, their nulls, numbers of ids, ids."""
    head = len(MAGIC)
    if block[:head] != MAGIC or len(block) < head + 28 or struct.unpack("<I", block[-4:])[0] != zlib.crc32(memoryview(block)[:-4]):
        raise BlockError("magic or checksum of a block is wrong")
    vocab, docs, n_ids, lanes, size = struct.unpack_from("<5I", block, head)
    at = head + 20
    index = zlib.decompress(block[at : at + size])
    doc_ids = np.cumsum(np.frombuffer(index, "<i8", docs))
    nulls = np.frombuffer(index, np.uint8, docs, 8 * docs).astype(bool)
    counts = np.frombuffer(index, "<i8", docs, 9 * docs)
    at += size
    n = np.frombuffer(block, "<u4", lanes, at).astype(np.int64)
    words = np.frombuffer(block, "<u2", int(n.sum()), at + 4 * lanes)
    ids = decode_ids(words, n, n_ids, vocab) if n_ids else np.zeros(0, np.int32)
    if struct.unpack("<I", block[-8:-4])[0] != zlib.crc32(ids.astype("<u4").tobytes()):
        raise BlockError("the ids of a block are not those that were written")
    return doc_ids, nulls, counts, ids
