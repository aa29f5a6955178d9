"""Token ids of many texts: a tokenizer file of the ``tokenizers`` library behind a table of pieces.

Both supported kinds of tokenizer never join tokens across a cut before white space, or
between a letter and a punctuation mark, so a text's ids are the ids of its pieces one
after the other.  Pieces are hashed with numpy, looked up in a bounded table, and
only pieces not seen before go through the tokenizer.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from briskbi.llm.shared import _BYTE, _LOWER, _PLACE, SPACED, mix, text_bytes, worker_state

#: Pieces a worker remembers at most (about 70 bytes each), and the longest one remembered.
PIECES, PIECE_BYTES = 600_000, 64
_CUT = np.zeros(256, bool)
_CUT[[0x20, 0x09, 0x0A, 0x0D]] = True
_RARE = np.zeros(256, bool)
_RARE[[0x0B, 0x0C, 0x1C, 0x1D, 0x1E, 0x1F]] = True


_LETTER, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_MARK[[*range(0x21, 0x27), *range(0x28, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True


class _Table:
    """Open-addressing table from 64-bit hashes to 0, 1, 2, ..., all operations on arrays."""

    def __init__(self, most: int):
        self.size = 1 << int(2 * most - 1).bit_length()
        self.keys, self.values, self.n = np.zeros(self.size, np.uint64), np.zeros(self.size, np.int32), 0

    def find(self, h: np.ndarray) -> np.ndarray:
        """The number of each hash, or -1."""
        out = np.full(len(h), -1, np.int64)
        slot, left = (h & np.uint64(self.size - 1)).astype(np.int64), np.arange(len(h))
        while len(left):
            there = self.keys[slot]
            hit = there == h[left]
            out[left[hit]] = self.values[slot[hit]]
            on = ~hit & (there != 0)
            left, slot = left[on], (slot[on] + 1) & (self.size - 1)
        return out

    def add(self, h: np.ndarray) -> None:
        """Numbers new, distinct hashes in their order."""
        number = np.arange(self.n, self.n + len(h), dtype=np.int32)
        slot, left = (h & np.uint64(self.size - 1)).astype(np.int64), np.arange(len(h))
        while len(left):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = h[left[free]]
            own = free & (self.keys[slot] == h[left])
            self.values[slot[own]] = number[left[own]]
            left, slot = left[~own], (slot[~own] + 1) & (self.size - 1)
        self.n += len(h)


class Coder:
    """ids of texts as the tokenizer gives them one by one, without special tokens."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            kind = json.load(f)
        pre = json.dumps(kind.get("pre_tokenizer"))
        by_space = '"use_regex": true' in pre and kind.get("normalizer") is None
        dropped = '"Removed"' in pre and "\\\\s" in pre
        #: "kept": white space belongs to the piece after it; "dropped": it has no tokens; else whole texts.
        self.white = "kept" if by_space else "dropped" if dropped else "whole"
        self.lower = '"Lowercase"' in json.dumps(kind.get("normalizer"))
        self.table = _Table(PIECES)
        self.flat, self.starts = np.zeros(1 << 16, np.uint32), np.zeros(1 << 12, np.int64)
        self.used = 0

    def _remember(self, hashes: np.ndarray, ids: list[np.ndarray]) -> None:
        size = np.array([len(x) for x in ids], np.int64)
        n, more = self.table.n, int(size.sum())
        while self.used + more > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n + len(ids) + 1 > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
        self.flat[self.used : self.used + more] = np.concatenate(ids) if ids else 0
        self.starts[n + 1 : n + len(ids) + 1] = self.used + np.cumsum(size)
        self.used += more
        self.table.add(hashes)

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, col) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(bytes, starts, ends, hashes, first piece of each text)."""
        raw, off = text_bytes(col)
        cut = np.zeros(len(raw) + 1, bool)
        table = _BYTE
        if self.white != "whole" and len(raw):
            cut[1:-1] = _MARK[raw[1:]] & _LETTER[raw[:-1]]  # a mark (not an apostrophe) never joins the letter before it
            if self.white == "kept":
                white = _CUT[raw]
                cut[1:-1] |= white[1:] & ~white[:-1]
                for a, b in _odd_texts(raw, off):
                    cut[a:b] = False
            else:
                word = SPACED[raw]
                cut[1:-1] |= word[1:] & ~word[:-1]
                table = np.where(SPACED, _BYTE[_LOWER] if self.lower else _BYTE, np.uint64(0))
        begins = off[:-1][np.diff(off) > 0]
        cut[begins] = True
        starts = np.flatnonzero(cut[:-1])
        ends = np.append(starts[1:], len(raw))[: len(starts)]
        size = ends - starts
        if self.white == "dropped" and len(starts):
            some = np.add.reduceat(word.astype(np.int64), starts)
            lead = ~word[starts]  # a text that begins with white space
            shift = np.zeros(len(starts), np.int64)
            for i in np.flatnonzero(lead & (some > 0)):
                shift[i] = np.argmax(word[starts[i] : ends[i]])
            real, starts = some > 0, starts + shift
            starts, size = starts[real], some[real]
            ends = starts + size
        if not len(starts):
            return raw, starts, ends, np.zeros(0, np.uint64), np.searchsorted(starts, off)
        stop = np.append(starts[1:], len(raw))
        place = np.arange(starts[0], len(raw)) - np.repeat(starts, stop - starts)
        with np.errstate(over="ignore"):
            weight = _PLACE[place & 4095]
            if place.max() > 4095:
                weight = weight + (place >> 12).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C16)
            total = np.add.reduceat(table[raw[starts[0] :]] * weight, starts - starts[0])
            hashes = mix(total + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        return raw, starts, ends, hashes, np.searchsorted(starts, off)

    def encode(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, first id of each text); null counts as empty."""
        raw, starts, ends, hashes, first = self._pieces(col)
        hashes = np.maximum(hashes, np.uint64(1))
        number = self.table.find(hashes)
        new = np.flatnonzero(number < 0)
        flat, at = self.flat, self.starts
        if len(new):
            own, one, back = np.unique(hashes[new], return_index=True, return_inverse=True)
            one = new[one]
            ids = self._encode([raw[a:b].tobytes().decode() for a, b in zip(starts[one], ends[one], strict=True)])
            short = ends[one] - starts[one] <= PIECE_BYTES
            short &= np.cumsum(short) <= PIECES - self.table.n  # the first pieces are the frequent ones; a full table stays
            base, kept = self.table.n, np.flatnonzero(short)
            self._remember(own[kept], [ids[i] for i in kept])
            flat, at = self.flat, self.starts
            place = base + np.cumsum(short) - 1
            if len(kept) < len(own):  # ids of the others are known for this batch only
                rest = np.flatnonzero(~short)
                size = np.array([len(ids[i]) for i in rest], np.int64)
                place[rest] = self.table.n + np.arange(len(rest))
                flat = np.concatenate([self.flat[: self.used], *(ids[i] for i in rest)])
                at = np.concatenate([self.starts[: self.table.n + 1], self.used + np.cumsum(size)])
            number[new] = place[back]
        size = at[number + 1] - at[number]
        end = np.cumsum(size)
        ids = flat[np.arange(int(end[-1]) if len(end) else 0) + np.repeat(at[number] - (end - size), size)]
        return ids, np.concatenate([[0], end])[first]


def _odd_texts(raw: np.ndarray, off: np.ndarray):
    """Ranges of texts with white space other than space, tab, newline and return; they stay whole."""
    odd = np.flatnonzero(_RARE[raw])
    lead = np.flatnonzero((raw == 0xC2) | (raw == 0xE1) | (raw == 0xE2) | (raw == 0xE3))
    if len(lead):
        b = np.concatenate([raw, np.zeros(2, np.uint8)])
        x, y, z = b[lead], b[lead + 1], b[lead + 2]
        white = ((x == 0xC2) & ((y == 0x85) | (y == 0xA0))) | ((x == 0xE1) & (y == 0x9A) & (z == 0x80)) | ((x == 0xE3) & (y == 0x80) & (z == 0x80))
        white |= (x == 0xE2) & (((y == 0x80) & ((z <= 0x8A) | (z == 0xA8) | (z == 0xA9) | (z == 0xAF))) | ((y == 0x81) & (z == 0x9F)))
        odd = np.union1d(odd, lead[white])
    for i in np.unique(np.searchsorted(off, odd, side="right") - 1):
        yield int(off[i]), int(off[i + 1])


def coder(path: str) -> Coder:
    """This worker's coder for a tokenizer file; it and the pieces it remembers outlive a task."""
    coders = worker_state("coders")
    if path not in coders:
        coders[path] = Coder(path)
    return coders[path]

