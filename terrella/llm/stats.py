"""Statistics of whole texts, computed on Arrow batches in blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .blocks import Block, blocks, mix64, per_text, windows

#: Characters that count as symbols (fixed values of the contract).
SYMBOLS = b"#*$%&|<>"
_KIND = np.zeros(256, np.uint8)
_KIND[list(range(65, 91))] = 1  # upper case
_KIND[list(range(97, 123))] = 2  # lower case
_KIND[list(range(48, 58))] = 3  # digits
_KIND[list(b"!\"'(),-./:;?@[\\]^_`{}~+=")] = 4  # punctuation
_KIND[list(SYMBOLS)] = 5
_CHAR = np.ones(256, bool)
_CHAR[0x80:0xC0] = False  # bytes that continue a character

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
EXTRA = ("n_lines", "upper", "lower", "digits", "punct", "bangs", "distinct_words", "wordless", "longest_word")


def _lines(b: Block) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word, and those of them equal to an earlier line, by text."""
    nl = np.flatnonzero(b.data == 10)
    per = np.searchsorted(nl, b.offsets[1:]) - np.searchsorted(nl, b.offsets[:-1])
    starts = np.sort(np.concatenate([b.offsets[:-1], nl + 1]))
    ends = np.sort(np.concatenate([nl, b.offsets[1:]]))
    doc = np.repeat(np.arange(b.n), per + 1)
    ws = b.words[0]
    has = np.flatnonzero(np.searchsorted(ws, ends) > np.searchsorted(ws, starts))
    key = mix64(b.span_hash(starts[has], ends[has]) + doc[has].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    first = np.unique(key, return_index=True)[1]
    total = np.bincount(doc[has], minlength=b.n)
    return total, total - np.bincount(doc[has][first], minlength=b.n)


def _repeats(b: Block, h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Words in three-word windows that occur twice or more in their text."""
    w, first = windows(h, at, 3)
    doc = np.searchsorted(at, first, "right") - 1
    key = mix64(w + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    k = key[order]
    same = np.zeros(len(k) + 1, bool)
    same[1:-1] = k[1:] == k[:-1]
    twice = first[order[same[1:] | same[:-1]]]
    cover = np.zeros(len(h) + 3, np.int8)
    for j in range(3):
        cover[twice + j] = 1
    return per_text(cover[: len(h)], at)


def text_stats(column: pa.Array, extra: bool = True) -> dict[str, np.ndarray]:
    """The counts named in COUNTS (and EXTRA) of each text, as int64; a null counts as empty."""
    out: dict[str, list[np.ndarray]] = {k: [] for k in (*COUNTS, *(EXTRA if extra else ()))}
    for b in blocks(column):
        h, at = b.word_hashes()
        s, e, _ = b.words
        n = np.diff(at)
        lead = np.zeros(len(b.data) + 1, np.int64)
        np.cumsum(_CHAR[b.data], out=lead[1:])
        size = lead[e] - lead[s]
        kind = _KIND[b.data]
        count = lambda mask: per_text(mask, b.offsets)  # noqa: E731, B023
        lines, dup = _lines(b)
        got = {"n_words": n, "word_chars": per_text(size, at), "n_symbols": count(kind == 5), "n_dup_lines": dup, "n_repeat_words": _repeats(b, h, at)}
        if extra:
            doc = np.repeat(np.arange(b.n), n)
            key = mix64(h + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            first = np.unique(key, return_index=True)[1]
            letter = np.zeros(len(b.data) + 1, np.int64)
            np.cumsum((kind == 1) | (kind == 2) | (b.data >= 0x80), out=letter[1:])
            longest = np.zeros(b.n, np.int64)
            np.maximum.at(longest, doc, size)
            got |= {
                "n_lines": lines, "upper": count(kind == 1), "lower": count(kind == 2), "digits": count(kind == 3), "punct": count(kind == 4),
                "bangs": count(b.data == 33), "distinct_words": np.bincount(doc[first], minlength=b.n), "wordless": per_text(letter[e] == letter[s], at), "longest_word": longest,
            }
        for k, v in got.items():
            out[k].append(v)
    return {k: np.concatenate([*v, np.zeros(0, np.int64)]).astype(np.int64) for k, v in out.items()}
