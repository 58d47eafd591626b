"""Ids of byte-level BPE tokenizers: whole batches of texts are cut as the tokenizer cuts them, and each distinct
piece goes through the library's merges once.

The cut is made on arrays of code points. With kinds letter, digit, white space and other, a piece begins where the
kind changes; a single space belongs to the visible run after it; of a longer run of white space before something
visible the last character stands apart; a contraction is a piece where its apostrophe begins one.
"""

from __future__ import annotations

import itertools
import re
import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import PieceEncoder

# What contractions have after the apostrophe, the printable bytes that stand for themselves (the
# others stand as the characters from 256 on, in order), and the code points with the White_Space property.
SHORT, LONG = "stmd", ("re", "ve", "ll")
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
SPACES = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Stands behind every text while it is cut; texts that hold it, or another of CONTROLS, are encoded in one go.
END = "\x1c"
_STOP = END.encode()
#: Controls on which regex engines disagree whether they are white space.
CONTROLS = "\x1c\x1d\x1e\x1f"
OTHER, LETTER, DIGIT, SPACE, STOP, ODD = range(6)


@cache
def kinds() -> np.ndarray:
    """By code point, those above the last as ODD: kinds that differ between versions of Unicode, or on which regex
    engines disagree. Texts with such characters are encoded in one go."""
    out = np.full(0x10001, OTHER, np.uint8)
    for p in range(0x10000):
        kind = unicodedata.category(chr(p))
        if kind != unicodedata.ucd_3_2_0.category(chr(p)) or kind in ("Cn", "Cs", "Co") or 0x1D <= p <= 0x1F or p in (0x180E, 0x200B, 0x2060, 0xFEFF):
            out[p] = ODD
        elif kind[0] in "LN":
            out[p] = LETTER if kind[0] == "L" else DIGIT
    out[SPACES], out[ord(END)], out[0x10000] = SPACE, STOP, ODD
    return out


@cache
def _ascii_kinds() -> bytes:
    """By byte; those of longer characters are set later."""
    return kinds()[:256].tobytes()


@cache
def byte_letters() -> np.ndarray:
    """The code point that stands for each byte."""
    out = np.arange(256, dtype="<u4")
    others = np.setdiff1d(out, PRINTABLE)
    out[others] = 256 + np.arange(len(others))
    return out


def begins(points: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Where a piece begins, in texts that END follows. points: code points, or bytes if no white space has several."""
    before, after = np.concatenate([[np.uint8(STOP)], kind[:-1]]), np.concatenate([kind[1:], [np.uint8(STOP)]])
    new = kind != before
    new[:1] = True
    space, blank = kind == SPACE, points == 32
    # The last of two or more, before something visible.
    new |= space & (before == SPACE) & (after < SPACE)
    # What is visible goes with a single space before it.
    new[1:] &= ~(blank[:-1] & (kind[1:] < SPACE))
    at = np.flatnonzero(points == 39)
    if len(at):
        at = at[new[at]]
        padded = np.concatenate([points, np.zeros(3, points.dtype)])
        one, two = padded[at + 1], padded[at + 2]
        size = np.where(np.isin(one, [ord(c) for c in SHORT]), 2, 0)
        for a, b in LONG:
            size[(one == ord(a)) & (two == ord(b))] = 3
        at, size = at[size > 0], size[size > 0]
        new[at + 1] = False
        new[at + size] = True
    return new


def is_plain(tokenizer) -> bool:
    """Whether the tokenizer is byte-level BPE with the standard pattern and nothing else before it."""
    pre = tokenizer.pre_tokenizer
    return tokenizer.normalizer is None and type(pre).__name__ == "ByteLevel" and pre.use_regex and not pre.add_prefix_space and type(tokenizer.model).__name__ == "BPE" and not tokenizer.model.dropout


class ByteLevelEncoder(PieceEncoder):
    """PieceEncoder for such tokenizers; texts with special strings of the tokenizer are encoded in one go too."""

    def __init__(self, path: str, most: int = 1_000_000, width: str = "<u2", tokenizer=None):
        super().__init__(path, "byte", most, width, tokenizer)
        if not is_plain(self.tokenizer):
            raise ValueError("not a byte-level BPE tokenizer with the standard pattern")
        added = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self._reset()

    def _reset(self) -> None:
        self.number: dict[bytes, int] = {b"": 0}
        self.start, self.size, self.flat, self.used = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, self.width), 0

    def _learn(self, pieces: list[bytes]) -> np.ndarray:
        """The number of each piece in the tables of ids."""
        # Pieces are distinct but for the empty one, which has no ids and is known from the beginning.
        known = self.number
        new = [p for p in pieces if p not in known]
        if len(known) + len(new) > self.most:
            self._reset()
            new = [p for p in pieces if p]
        if new:
            data = np.frombuffer(_STOP.join(new), np.uint8)
            mapped = byte_letters().take(data).tobytes().decode("utf-32-le").split(chr(byte_letters()[ord(END)]))
            ids = [[t.id for t in merged] for merged in map(self.tokenizer.model.tokenize, mapped)]
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            at, total = len(self.number), int(sizes.sum())
            while at + len(new) > len(self.start):
                self.start, self.size = np.resize(self.start, 2 * len(self.start)), np.resize(self.size, 2 * len(self.size))
            while self.used + total > len(self.flat):
                self.flat = np.resize(self.flat, 2 * len(self.flat))
            self.flat[self.used : self.used + total] = np.fromiter(itertools.chain.from_iterable(ids), self.width, total)
            self.start[at : at + len(new)] = self.used + np.cumsum(sizes) - sizes
            self.size[at : at + len(new)] = sizes
            self.used += total
            self.number.update(zip(new, range(at, at + len(new)), strict=True))
        return np.fromiter(map(self.number.__getitem__, pieces), np.int64, len(pieces))

    def _cut(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Where pieces begin, as places in data (UTF-8), and the places of odd characters."""
        units = np.frombuffer(data, np.uint8)
        kind = np.frombuffer(data.translate(_ascii_kinds()), np.uint8)
        lead = np.flatnonzero(units >= 0xC0)
        if not len(lead):
            return np.flatnonzero(begins(units, kind)), lead
        # All bytes of a character get its kind.
        kind = kind.copy()
        size = 2 + (units[lead] >= 0xE0) + (units[lead] >= 0xF0)
        padded = np.concatenate([units, np.zeros(3, np.uint8)])
        one, two, three = (padded[lead + k].astype(np.int64) for k in range(3))
        point = np.where(size == 2, (one & 31) << 6 | two & 63, np.where(size == 3, (one & 15) << 12 | (two & 63) << 6 | three & 63, 0x10000))
        of = kinds().take(point)
        for k in range(4):
            go = size > k
            kind[lead[go] + k] = of[go]
        odd = lead[of == ODD]
        if not (of == SPACE).any():
            return np.flatnonzero(begins(units, kind)), odd
        # White space of several bytes: a run's last character is found among characters, not bytes.
        chars = np.flatnonzero((units & 0xC0) != 0x80)
        return chars[begins(units[chars], kind[chars])], odd

    def encoded(self, texts: list[str], end: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, `end` behind each; and how many each text has."""
        tail = np.array(end or [], self.width)
        data = [x.encode() for x in texts]
        odd = {i for i, x in enumerate(texts) if any(c in x for c in CONTROLS) or (self.added and self.added.search(x))}
        joined = b"".join(x + _STOP for i, x in enumerate(data) if i not in odd)
        new, strange = self._cut(joined)
        if len(strange):
            here = [i for i in range(len(texts)) if i not in odd]
            odd |= {here[k] for k in np.unique(np.searchsorted(np.cumsum([len(data[i]) + 1 for i in here]), strange, "right")).tolist()}
            joined = b"".join(x + _STOP for i, x in enumerate(data) if i not in odd)
            new, _ = self._cut(joined)
        flat, lengths = self._plain(joined, new, tail)
        if not odd:
            return flat, lengths
        # The odd ones go through the library whole, and all come back in their places.
        ends, k, parts = np.cumsum(lengths), 0, []
        for i, x in enumerate(texts):
            if i in odd:
                parts.append(np.concatenate([np.array(self.tokenizer.encode(x, add_special_tokens=False).ids, self.width), tail]))
            else:
                parts.append(flat[ends[k] - lengths[k] : ends[k]])
                k += 1
        return np.concatenate(parts), np.array([len(x) for x in parts], np.int64)

    def _plain(self, joined: bytes, new: np.ndarray, tail: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not joined:
            return np.zeros(0, self.width), np.zeros(0, np.int64)
        pieces = pa.StringArray.from_buffers(len(new), pa.py_buffer(np.append(new, len(joined)).astype(np.int32)), pa.py_buffer(joined))
        coded = pc.dictionary_encode(pieces)
        distinct = coded.dictionary
        at, held = np.frombuffer(distinct.buffers()[1], np.int32, len(distinct) + 1).tolist(), distinct.buffers()[2].to_pybytes()
        words = [held[a:b] for a, b in zip(at, at[1:], strict=False)]
        stops = {i: len(w) for i, w in enumerate(words) if w[:1] == _STOP}
        for i in stops:
            words[i] = b""
        numbers = self._learn(words)
        codes = coded.indices.to_numpy()
        sizes = self.size.take(numbers).take(codes)
        flat = self._spread(self.start.take(numbers).take(codes), sizes)
        # A run of END ends as many texts as it is long.
        runs = np.zeros(len(words), np.int64)
        runs[list(stops)] = list(stops.values())
        runs = runs.take(codes)
        here = np.flatnonzero(runs)
        ends = np.repeat(np.cumsum(sizes)[here], runs[here])
        lengths = np.diff(ends, prepend=0)
        if len(tail):
            flat = np.insert(flat, np.repeat(ends, len(tail)), np.tile(tail, len(ends)))
            lengths = lengths + len(tail)
        return flat, lengths

    def _spread(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """flat[start : start + size] for each, one after the other."""
        ends = np.cumsum(size)
        if not len(ends) or not ends[-1]:
            return np.zeros(0, self.width)
        kind = np.int32 if max(ends[-1], len(self.flat)) < 1 << 31 else np.int64
        at = np.repeat((start - ends + size).astype(kind), size)
        at += np.arange(ends[-1], dtype=kind)
        return self.flat.take(at)

    def ids(self, texts: list[str]) -> list[bytes]:
        flat, lengths = self.encoded(texts)
        ends = np.cumsum(lengths)
        return [flat[b - n : b].tobytes() for b, n in zip(ends.tolist(), lengths.tolist(), strict=True)]

    def lengths(self, texts: list[str]) -> list[int]:
        return self.encoded(texts)[1].tolist()
