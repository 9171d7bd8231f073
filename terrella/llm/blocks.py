"""Vectorised views of text columns: words, lines and spans of whole texts, without a Python object per word.

A block is a run of whole texts from one Arrow batch.  Prefix sums of a polynomial over
the bytes give a 64-bit hash of any span in constant time, the same in every block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
#: What other modules remember in a worker between batches and can let go of: a worker that turns to block work is done with it.
REMEMBERED: list[Callable[[], None]] = []
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_VALUES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


class _Powers:
    """Powers of the base and of its inverse, as long as the longest block so far."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, BLOCK_BYTES + 1)
            for name, b in (("up", _BASE), ("down", _INVERSE)):
                a = np.full(size, b, np.uint64)
                a[0] = 1
                setattr(cls, name, np.multiply.accumulate(a))
        return cls.up[:n], cls.down[:n]


powers = _Powers.get


class Block:
    """Texts ``row`` to ``row + n`` of a batch; offsets are byte positions in ``data``."""

    def __init__(self, row: int, data: np.ndarray, offsets: np.ndarray, lower: bool):
        self.row, self.n, self.offsets = row, len(offsets) - 1, offsets
        self.raw = data
        self.data = LOWER[data] if lower else data
        self._prefix: np.ndarray | None = None
        self._words: tuple | None = None
        self._characters: np.ndarray | None = None

    @property
    def prefix(self) -> np.ndarray:
        if self._prefix is None:
            up, _ = _Powers.get(len(self.data) + 1)
            p = np.empty(len(self.data) + 1, np.uint64)
            p[0] = 0
            v = BYTE_VALUES[self.data]
            v *= up[: len(v)]
            np.add.accumulate(v, out=p[1:])
            self._prefix = p
        return self._prefix

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hashes of spans of ``data``; equal bytes give equal hashes."""
        p = self.prefix
        _, down = _Powers.get(len(p))
        h = (p[end] - p[start]) * down[start]
        return mix64(h + (end - start).astype(np.uint64))

    @property
    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the words, and where each text's words begin (n + 1 numbers)."""
        if self._words is None:
            n = len(self.data)
            ns = ~SPACE[self.data]
            before = np.zeros(n + 1, bool)
            before[1:] = ns
            before[self.offsets] = False
            starts = np.flatnonzero(ns & ~before[:n])
            after = np.zeros(n + 1, bool)
            after[:n] = ns
            after[self.offsets] = False
            ends = np.flatnonzero(ns & ~after[1:]) + 1
            self._words = starts, ends, np.searchsorted(starts, self.offsets)
        return self._words

    @property
    def characters(self) -> np.ndarray:
        """Where each character begins, and the block's end."""
        if self._characters is None:
            self._characters = np.append(np.flatnonzero((self.data & 0xC0) != 0x80), len(self.data))
        return self._characters

    def word_hashes(self) -> tuple[np.ndarray, np.ndarray]:
        s, e, at = self.words
        return self.span_hash(s, e), at

    def text(self, start: int, end: int) -> str:
        return self.raw[start:end].tobytes().decode("utf-8", "replace")


def string_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column; a null has no bytes."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if off else np.zeros(len(column) + 1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets, raw


def blocks(column: pa.Array, lower: bool = False, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Whole texts in runs of about ``limit`` bytes; a longer text is a block by itself."""
    for let_go in REMEMBERED:
        let_go()
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets, raw = string_parts(column)
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        to = min(to, n)
        lo = offsets[at]
        yield Block(at, raw[lo : offsets[to]], offsets[at : to + 1] - lo, lower)
        at = to


def slices(batches, rows: int):
    """Batches of at most ``rows`` rows: what a worker makes of a batch stays small, however many rows Spark puts in it."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def per_text(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of values between the bounds ``at`` of each text, as int64."""
    c = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=c[1:])
    return c[at[1:]] - c[at[:-1]]


def windows(h: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word windows that stay in one text, and each window's first word."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = h[:n].copy()
    for j in range(1, k):
        out = mix64(out * np.uint64(0xC2B2AE3D27D4EB4F) + h[j : n + j])
    last = np.repeat(at[1:], np.diff(at))  # where the text of each word ends
    ok = np.flatnonzero(np.arange(n) + k <= last[:n])
    return out[ok], ok
