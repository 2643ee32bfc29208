"""Exact library tokenisation of whole texts through a bounded worker cache, without a Python loop over words.

Plain texts (Latin letters, digits, punctuation, simple white space) are cut into pre-tokens by array operations that follow
the tokenizer's own pattern; a compact hash table gives each pre-token's ids, and those it lacks are encoded by the
library's model, once per worker. A text with any other character or a special token's string goes to the library
whole, so rare scripts cost time but never correctness.

Pre-tokens are told apart by 64-bit hashes of their bytes: two of a worker's (at most a million) cached ones agree by
chance about once in 10^7 full caches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .arrowtext import blocks, span_hashes

#: Pre-tokens one worker's table holds; a full table starts anew (from the frequent ones, where it was given some).
TABLE_ENTRIES = 1_000_000

SPACE, BLANK, LETTER, DIGIT, OTHER, ODD, EDGE = range(7)
_CLASS = np.full(256, ODD, np.uint8)
_CLASS[0x21:0x7F] = OTHER
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = LETTER
_CLASS[0x30:0x3A] = DIGIT
_CLASS[0x20] = SPACE
_CLASS[[0x09, 0x0A, 0x0D]] = BLANK
#: Classes of the characters U+00A1 to U+00FF by their second byte: after 0xC2, and after 0xC3.
_AFTER_C2 = np.full(256, ODD, np.uint8)
_AFTER_C2[0xA1:0xC0] = OTHER
_AFTER_C2[[0xAA, 0xB5, 0xBA]] = LETTER
_AFTER_C2[[0xB2, 0xB3, 0xB9, 0xBC, 0xBD, 0xBE]] = DIGIT
_AFTER_C3 = np.full(256, ODD, np.uint8)
_AFTER_C3[0x80:0xC0] = LETTER
_AFTER_C3[[0x97, 0xB7]] = OTHER

#: The printable stand-in of each byte in byte-level vocabularies: itself where printable, else the next from 256 on.
_SELF = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
STAND_IN = {b: chr(b) for b in _SELF} | {b: chr(256 + i) for i, b in enumerate(sorted({*range(256)} - {*_SELF}))}


def classes(data: np.ndarray) -> np.ndarray:
    """The class of every byte; both bytes of a two-byte character have the character's."""
    out = _CLASS[data]
    wide = np.flatnonzero((data[:-1] == 0xC3) | (data[:-1] == 0xC2)) if len(data) else np.zeros(0, np.int64)
    if len(wide):
        second = data[wide + 1]
        kind = np.where(data[wide] == 0xC3, _AFTER_C3[second], _AFTER_C2[second])
        out[wide] = kind
        out[wide + 1] = kind
    return out


def lowered(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z and the capitals U+00C0 to U+00DE in lower case; other plain characters have no case."""
    out = data.copy()
    out[(data >= 0x41) & (data <= 0x5A)] += 32
    wide = np.flatnonzero(data[:-1] == 0xC3) + 1
    capital = wide[(data[wide] >= 0x80) & (data[wide] <= 0x9E) & (data[wide] != 0x97)]
    out[capital] += 32
    return out


def pretokens(data: np.ndarray, offsets: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the pre-tokens of a block of texts, and which texts are odd (theirs mean nothing)."""
    n = len(data)
    cls = classes(data)
    first = np.zeros(n + 1, bool)
    first[offsets[:-1]] = True
    before = np.empty(n, np.uint8)
    before[0], before[1:] = EDGE, cls[:-1]
    before[first[:n]] = EDGE
    blank = cls <= BLANK
    if kind == "byte":
        after = np.empty(n, bool)  # a character that is not white space follows in the same text
        after[-1], after[:-1] = False, ~blank[1:] & ~first[1:n]
        start = np.where(blank, (before > BLANK) | after, (cls != before) & (before != SPACE))
    else:
        start = ~blank & ((cls != before) | ((cls == DIGIT) & (data & 0xC0 != 0x80)))
    quotes = np.flatnonzero((data == 0x27) & (before != OTHER) & ((before != SPACE) | (kind == "word")))
    if len(quotes):
        padded = np.concatenate([data, np.zeros(3, np.uint8)])
        one, two = padded[quotes + 1], padded[quotes + 2]
        length = np.where(np.isin(one, np.frombuffer(b"stmd", np.uint8)), 1, np.where(((one == 0x72) | (one == 0x76)) & (two == 0x65) | (one == 0x6C) & (two == 0x6C), 2, 0))
        end = np.append(offsets, n)[np.searchsorted(offsets, quotes, "right")]
        good = (length > 0) & (quotes + 1 + length <= end)
        quotes, length, end = quotes[good], length[good], end[good]
        start[quotes + 1] = False
        rest = quotes + 1 + length
        rest = rest[rest < end]
        start[rest[cls[rest] == LETTER]] = True
    starts = np.flatnonzero(start)
    if kind == "byte":
        ends = np.append(starts[1:], n)
    else:
        edge = np.flatnonzero(start | (blank & (before > BLANK)) | first[:n])
        ends = np.append(edge, n)[np.searchsorted(edge, starts, "right")]
    odd = np.zeros(len(offsets) - 1, bool)
    odd[np.searchsorted(offsets, np.flatnonzero(cls == ODD), "right") - 1] = True
    return starts, ends, odd


class HashTable:
    """Open addressing over 64-bit keys in one array of twice the entries; values are 32-bit integers."""

    def __init__(self, entries: int):
        size = 1 << (2 * entries - 1).bit_length()
        self.mask, self.keys, self.values, self.n = np.uint64(size - 1), np.zeros(size, np.uint64), np.zeros(size, np.int32), 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The keys' values, -1 where there is none."""
        out = np.full(len(keys), -1, np.int32)
        at, left = keys & self.mask, None
        while True:
            own = keys if left is None else keys[left]
            there = self.keys[at]
            hit = there == own
            if left is None:
                out[hit] = self.values[at[hit]]
            else:
                out[left[hit]] = self.values[at[hit]]
            on = ~hit & (there != 0)
            if not on.any():
                return out
            left = np.flatnonzero(on) if left is None else left[on]
            at = (at[on] + np.uint64(1)) & self.mask

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Distinct keys that are not in the table."""
        self.n += len(keys)
        at = keys & self.mask
        while len(keys):
            free = self.keys[at] == 0
            self.keys[at[free]] = keys[free]
            placed = free & (self.keys[at] == keys)  # of keys that want one place, the last has it
            self.values[at[placed]] = values[placed]
            keys, values, at = keys[~placed], values[~placed], at[~placed]
            at = (at + np.uint64(1)) & self.mask


class CachedTokenizer:
    """kind: ``byte`` (white space is part of tokens) or ``word`` (lower case; white space only separates)."""

    def __init__(self, file: str, kind: str, entries: int = TABLE_ENTRIES):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(file)
        self.library.no_truncation()
        self.library.no_padding()
        self.kind, self.entries = kind, entries
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.renew()

    def renew(self) -> None:
        self.table = HashTable(self.entries)
        self.starts, self.lengths = np.zeros(self.entries, np.int32), np.zeros(self.entries, np.int32)
        self.ids, self.used = np.zeros(4 * self.entries, np.uint16), 0

    def piece_ids(self, piece: bytes) -> list[int]:
        return [t.id for t in self.library.model.tokenize(piece.decode("latin-1").translate(STAND_IN))]

    def learn(self, data: np.ndarray, keys: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        keys, at = np.unique(keys, return_index=True)
        text = data.tobytes()
        for lo in range(0, len(keys), self.entries // 2):
            part = at[lo : lo + self.entries // 2]
            got = [self.piece_ids(text[s:e]) for s, e in zip(starts[part].tolist(), ends[part].tolist(), strict=True)]
            lengths = np.fromiter(map(len, got), np.int32, len(got))
            flat = np.fromiter((i for x in got for i in x), np.uint16, int(lengths.sum()))
            n = self.table.n
            if self.used + len(flat) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros(max(len(flat), len(self.ids) // 2), np.uint16)])
            self.ids[self.used : self.used + len(flat)] = flat
            self.starts[n : n + len(got)] = self.used + np.cumsum(lengths) - lengths
            self.lengths[n : n + len(got)] = lengths
            self.used += len(flat)
            self.table.add(keys[lo : lo + self.entries // 2], np.arange(n, n + len(got), dtype=np.int32))

    def entries_of(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The table entries of a block's pre-tokens, learning those it lacks."""
        keys = span_hashes(data, starts, ends)
        keys[keys == 0] = 1
        found = self.table.find(keys)
        lacking = found < 0
        if lacking.any():
            if self.table.n + len(np.unique(keys[lacking])) > self.entries:
                self.renew()
                lacking = np.ones(len(keys), bool)
                if (most := len(np.unique(keys))) > self.entries:  # one text with more pre-tokens than the table has room for
                    self.entries = most
                    self.renew()
            self.learn(data, keys[lacking], starts[lacking], ends[lacking])
            found = self.table.find(keys)
        return found

    def whole(self, text: bytes) -> np.ndarray:
        return np.array(self.library.encode(text.decode(), add_special_tokens=False).ids, np.uint32)

    def encode(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, ids, bounds) of runs of whole rows: row first + i has the ids from bounds[i] to bounds[i + 1]; null is empty."""
        for first, last, data, offsets in blocks(column):
            n = last - first
            if not len(data):
                yield first, np.zeros(0, np.uint32), np.zeros(n + 1, np.int64)
                continue
            text = data.tobytes()
            cut = lowered(data) if self.kind == "word" else data
            starts, ends, odd = pretokens(cut, offsets, self.kind)
            for s in self.special:
                at = text.find(mark := s.encode())
                while at >= 0:
                    odd[np.searchsorted(offsets, at, "right") - 1] = True
                    at = text.find(mark, at + 1)
            rows = np.searchsorted(offsets, starts, "right") - 1
            if odd.any():
                plain = ~odd[rows]
                starts, ends, rows = starts[plain], ends[plain], rows[plain]
            entry = self.entries_of(cut, starts, ends)
            lengths = self.lengths[entry]
            counts = np.bincount(rows, lengths, n).astype(np.int64)
            total = int(lengths.sum())
            flat = self.ids[np.repeat(self.starts[entry] - (np.cumsum(lengths) - lengths), lengths) + np.arange(total)].astype(np.uint32)
            bounds = np.concatenate([[0], np.cumsum(counts)])
            if odd.any():
                parts, last_cut = [], 0
                for r in np.flatnonzero(odd):
                    parts += [flat[bounds[last_cut] : bounds[r]], own := self.whole(text[offsets[r] : offsets[r + 1]])]
                    counts[r] = len(own)
                    last_cut = r
                flat = np.concatenate([*parts, flat[bounds[last_cut] :]])
                bounds = np.concatenate([[0], np.cumsum(counts)])
            yield first, flat, bounds


_workers: dict[tuple, CachedTokenizer] = {}


def worker(file: str, kind: str) -> CachedTokenizer:
    """This worker process's tokenizer; its table lives as long as the process."""
    if (file, kind) not in _workers:
        _workers[file, kind] = CachedTokenizer(file, kind)
    return _workers[file, kind]
