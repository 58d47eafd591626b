"""Adaptive context-mixing range coder over token ids, in independently reset, checksummed blocks.

A block is cut into lanes of consecutive ids. All lanes are coded in step, one id each, so that a step is a few
numpy calls; they share the block's models, which start empty in each block and learn from every step:

* order 2: a hash of the two ids before -> the id last seen there, with a confidence of 0 to 7;
* order 1: the id before -> the id last seen there, with a confidence of 0 to 7;
* order 0: how often each id has been coded by this model, every id starting with a small count.

The two confidences, and whether both predictions agree, choose a mixing context. Its learned counts give the
weights of the three orders: the probability of "as order 2 says", "as order 1 says", or "by order 0". That choice,
then (in the last case) the id itself, drives a range coder of 64 bits that emits 16 bits at a time; carries are added
to the word before and settled when the block ends. Models are updated after a step, from all lanes in lane order, on
both sides alike.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BLOCK_IDS = 1 << 20
LANES = 4096
#: Least steps of a lane, so that short blocks do not pay for many lanes' ends.
LEAST_STEPS = 64
_HASH_BITS = 17
_WEIGHT_BITS = 12
_COUNT = 24  # what one id adds to its order-0 count, against 1 that each id starts with
_U = np.uint64
#: A lane's interval is at least this wide when a step begins.
_WIDE = _U(1 << 48)
_HEAD = struct.Struct("<4sIIIIII")
MAGIC = b"QBK1"


#: What a confidence changes by after a miss (first 8: it is halved) and after a hit.
_CHANGE = np.array([0, -1, -1, -2, -2, -3, -3, -4, 1, 1, 1, 1, 1, 1, 1, 0])


class _Model:
    """A row of the tables for orders 1 and 2 holds the id last seen and, in its last three bits, the confidence."""

    def __init__(self, vocab: int, lanes: int):
        self.vocab = vocab
        self.count = np.ones(vocab, np.int64)
        self.cum = np.arange(vocab + 1, dtype=np.int64)
        self.find = self.cum.astype(np.int32)  # for the search: at most (1 + _COUNT) ids of a block, which fits
        self.pending, self.waiting, self.seen = [], 0, 0
        self.last1, self.last2 = np.zeros(vocab, np.int64), np.zeros(1 << _HASH_BITS, np.int64)
        self.hits = np.tile(np.array([1, 1, 2], np.int64), (128, 1))
        self.before1, self.before2 = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
        self.ends = np.zeros((128, 4), _U)
        self.ends[:, 3] = 1 << _WEIGHT_BITS

    def predict(self, n: int) -> np.ndarray:
        """For the first n lanes: both predictions (p2, p1), and the row of `shares` that each lane's choice has."""
        a = self.before1[:n]
        slot = a * 0x9E3779B1
        slot += self.before2[:n] * 0x85EBCA6B
        slot >>= 7
        slot &= (1 << _HASH_BITS) - 1
        self.slot = slot
        self.v2, self.v1 = self.last2.take(slot), self.last1.take(a)
        self.p2, self.p1 = self.v2 >> 3, self.v1 >> 3
        context = self.v2 & 7
        context <<= 3
        context |= self.v1 & 7
        context <<= 1
        context |= self.p1 == self.p2
        self.context = context
        h = self.hits
        total = h.sum(1)
        w2 = np.maximum(h[:, 0] * ((1 << _WEIGHT_BITS) - 3) // total, 1)
        self.ends[:, 1] = w2
        self.ends[:, 2] = w2 + np.maximum(h[:, 1] * ((1 << _WEIGHT_BITS) - 3) // total, 1)
        #: Where the shares of order 2, order 1 and order 0 begin, four values for each context.
        self.shares = self.ends.reshape(-1)
        return context << 2

    def learn(self, ids: np.ndarray, is2: np.ndarray, outcome: np.ndarray, missed: np.ndarray) -> None:
        n = len(ids)
        self.hits += np.bincount(self.context * 3 + outcome, minlength=384).reshape(128, 3) * 2
        fresh = ids << 3
        for v, hit, to, at in ((self.v2, is2, self.last2, self.slot), (self.v1, self.p1 == ids, self.last1, self.before1[:n])):
            sure = hit.astype(np.int64)
            sure <<= 3
            sure |= v & 7
            new = _CHANGE.take(sure)
            new += v
            # A row of no confidence that missed is taken over.
            new += (fresh - v) * (sure == 0)
            to[at] = new
        if len(missed):
            self.pending.append(ids.take(missed))
            self.waiting += len(missed)
            if self.waiting > self.seen // 8:
                self.seen += self.waiting
                self.count += _COUNT * np.bincount(np.concatenate(self.pending), minlength=self.vocab)
                np.cumsum(self.count, out=self.cum[1:])
                self.find[:] = self.cum
                self.pending, self.waiting = [], 0
        self.before2[:n] = self.before1[:n]
        self.before1[:n] = ids


class _Writer:
    """Low end and width of each lane's interval, and the words each lane has settled, but for carries: a row for
    each place, so that lanes, which are at nearly the same place, write near each other."""

    def __init__(self, lanes: int, steps: int):
        self.low, self.span = np.zeros(lanes, _U), np.full(lanes, 2**64 - 1, _U)
        self.lanes = lanes
        self.out = np.zeros(lanes * (steps + 64), np.uint32)
        self.at = np.arange(lanes)

    def narrow(self, at, r: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        """`at`: a slice, or the lanes' numbers."""
        start = r * start
        low = self.low[at] + start
        carry = np.flatnonzero(low < start)
        if len(carry):
            self.out[self.at[at].take(carry) - self.lanes] += 1
        self.low[at], self.span[at] = low, r * size

    def settle(self) -> None:
        lanes = np.flatnonzero(self.span < _WIDE)
        low, span = self.low.take(lanes), self.span.take(lanes)
        while len(lanes):
            at = self.at.take(lanes)
            self.out[at] = low >> _U(48)
            self.at[lanes] = at + self.lanes
            low <<= _U(16)
            span <<= _U(16)
            self.low[lanes], self.span[lanes] = low, span
            go = np.flatnonzero(span < _WIDE)
            lanes, low, span = lanes.take(go), low.take(go), span.take(go)

    def used(self) -> np.ndarray:
        return self.at // self.lanes

    def room(self, words: int) -> None:
        if self.at.max() + words * self.lanes >= len(self.out):
            self.out = np.concatenate([self.out, np.zeros_like(self.out)])

    def words(self) -> np.ndarray:
        """All words, a row for each lane, after the ends are settled."""
        self.room(8)
        for k in range(4):
            self.out[self.at] = (self.low >> _U(48 - 16 * k)) & _U(0xFFFF)
            self.at += self.lanes
        out = self.out.reshape(-1, self.lanes)[: self.used().max()]
        for k in range(len(out) - 1, 0, -1):
            out[k - 1] += out[k] >> 16
        return out.T.astype("<u2")


class _Reader:
    """How far into its interval each lane's code lies, and the interval's width."""

    def __init__(self, stream: np.ndarray, lengths: np.ndarray):
        lanes = self.lanes = len(lengths)
        # A row for each place, as in the writer.
        words = np.zeros((lanes, int(lengths.max()) + 8), np.uint16)
        words[np.arange(words.shape[1]) < lengths[:, None]] = stream
        self.stream = np.ascontiguousarray(words.T).reshape(-1)
        self.at, self.code, self.span = np.arange(lanes), np.zeros(lanes, _U), np.full(lanes, 2**64 - 1, _U)
        for _ in range(4):
            self.code = (self.code << _U(16)) | self.stream[self.at]
            self.at = self.at + lanes

    def narrow(self, at, r: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        self.code[at] -= r * start
        self.span[at] = r * size

    def settle(self) -> None:
        lanes = np.flatnonzero(self.span < _WIDE)
        span, code = self.span.take(lanes), self.code.take(lanes)
        while len(lanes):
            at = self.at.take(lanes)
            code <<= _U(16)
            code |= self.stream.take(at)
            span <<= _U(16)
            self.code[lanes], self.span[lanes], self.at[lanes] = code, span, at + self.lanes
            go = np.flatnonzero(span < _WIDE)
            lanes, span, code = lanes.take(go), span.take(go), code.take(go)


def _lanes(n: int) -> tuple[int, int]:
    """Lanes and steps for n ids: only the last lane can be shorter."""
    steps = max(LEAST_STEPS, -(-n // LANES))
    return -(-n // steps), steps


def encode_block(ids: np.ndarray, vocab: int) -> bytes:
    """One block: header (magic, ids, lanes, vocabulary, payload bytes, crc32 of ids, crc32 of payload), payload."""
    n = len(ids)
    if n == 0:
        return b""
    lanes, steps = _lanes(n)
    model, code = _Model(vocab, lanes), _Writer(lanes, steps)
    grid = np.zeros(lanes * steps, np.int64)
    grid[:n] = ids
    grid = np.ascontiguousarray(grid.reshape(lanes, steps).T)
    short = n - (lanes - 1) * steps
    for t in range(steps):
        k = lanes if t < short else lanes - 1
        if k == 0:
            break
        if t % 8 == 0:
            code.room(64)
        x = grid[t, :k]
        at = model.predict(k)
        is2 = model.p2 == x
        outcome = np.subtract(2, is2 | (model.p1 == x), dtype=np.int64)
        outcome -= is2
        at += outcome
        start = model.shares.take(at)
        at += 1
        code.narrow(slice(k), code.span[:k] >> _U(_WEIGHT_BITS), start, model.shares.take(at) - start)
        missed = np.flatnonzero(outcome == 2)
        if len(missed):
            y = x.take(missed)
            first = model.cum.take(y)
            code.narrow(missed, code.span.take(missed) // _U(model.cum[-1]), first.astype(_U), (model.cum.take(y + 1) - first).astype(_U))
        code.settle()
        model.learn(x, is2, outcome, missed)
    out, used = code.words(), code.used()
    body = used.astype("<u4").tobytes() + out[np.arange(out.shape[1]) < used[:, None]].tobytes()
    return _HEAD.pack(MAGIC, n, lanes, vocab, len(body), zlib.crc32(ids.astype("<u4").tobytes()), zlib.crc32(body)) + body


def decode_block(data: bytes, offset: int = 0) -> tuple[np.ndarray, int]:
    """The ids of the block at `offset`, and where it ends. Raises ValueError where a checksum does not match."""
    magic, n, lanes, vocab, size, ids_crc, body_crc = _HEAD.unpack_from(data, offset)
    body = memoryview(data)[offset + _HEAD.size : offset + _HEAD.size + size]
    if magic != MAGIC or len(body) != size or zlib.crc32(body) != body_crc:
        raise ValueError("damaged block")
    steps = _lanes(n)[1]
    lengths = np.frombuffer(body[: 4 * lanes], "<u4").astype(np.int64)
    model, code = _Model(vocab, lanes), _Reader(np.frombuffer(body[4 * lanes :], "<u2"), lengths)
    grid = np.zeros((steps, lanes), np.int64)
    short = n - (lanes - 1) * steps
    for t in range(steps):
        k = lanes if t < short else lanes - 1
        if k == 0:
            break
        at = model.predict(k)
        r = code.span[:k] >> _U(_WEIGHT_BITS)
        off = code.code[:k]
        is2 = off < r * model.shares.take(at + 1)
        outcome = np.subtract(2, off < r * model.shares.take(at + 2), dtype=np.int64)
        outcome -= is2
        at += outcome
        start = model.shares.take(at)
        at += 1
        code.narrow(slice(k), r, start, model.shares.take(at) - start)
        x = np.where(is2, model.p2, model.p1)
        missed = np.flatnonzero(outcome == 2)
        if len(missed):
            r = code.span.take(missed) // _U(model.cum[-1])
            target = np.minimum(code.code.take(missed) // r, _U(model.cum[-1] - 1)).astype(np.int32)
            y = np.searchsorted(model.find, target, "right") - 1
            first = model.cum.take(y)
            code.narrow(missed, r, first.astype(_U), (model.cum.take(y + 1) - first).astype(_U))
            x[missed] = y
        code.settle()
        model.learn(x, is2, outcome, missed)
        grid[t, :k] = x
    ids = grid.T.reshape(-1)[:n]
    if zlib.crc32(ids.astype("<u4").tobytes()) != ids_crc:
        raise ValueError("damaged block")
    return ids, offset + _HEAD.size + size
