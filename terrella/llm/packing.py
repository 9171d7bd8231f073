"""Best-fit packing of token sequences into rows of fixed length.

Documents become ids of a byte-level BPE (the ``tokenizers`` library), longer ones are cut,
and the pieces are packed by best-fit decreasing.  The order of pieces of one length cannot
matter, so the packing is made on the histogram of lengths: for each length, longest first, a
segment tree over remaining capacities finds the tightest open bins that still take it, in
logarithmic time for a whole run of equal bins.  This gives the very packing that
best-fit decreasing gives piece by piece, over all pieces at once, while the driver holds
only runs of bins, whose number depends on the row length and not on the input.

Each run of the plan is (length, ranks of pieces, bins, offset); pieces are numbered
within their length without gaps and find their run by rank.

Defined results: null and empty texts are one piece, the end id alone; repeated rows are
packed like any other (a row with a null doc_id too).
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks
from .ranks import gapless
from .scratch import materialize

CAPACITY, END_ID = 1024, 2
#: Words whose ids a worker remembers at most.
REMEMBERED = 600_000


def _loose(part: str) -> bool:
    """Whether white space stands beside the space where a text was cut."""
    return not part or part[0].isspace() or part[-1].isspace()


class Encoder:
    """Whole texts to ids.

    A text is cut before each single space between two characters that are not white space; the
    tokenizer's pattern always begins a new pretoken there, so the parts' ids joined are the text's ids.
    Parts are looked up in a memory of bounded size.  Missing ones are encoded together as one text,
    which is cut again by the tokens' lengths in bytes.  Texts with other white space around a
    space, or with a special token's string, are encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocab = self.tokenizer.get_vocab()
        self.size = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():  # one character of a token's name stands for one byte
            self.size[i] = len(token)
        self.memory: dict[str, bytes | None] = {}  # ids of a part with a space before it; none for a loose part

    def _bytes(self, texts: list[str]) -> list[bytes]:
        got = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in got]

    def _learn(self, words: list[str]) -> None:
        self.memory.update((w, None) for w in words if _loose(w))
        words = [w for w in words if not _loose(w)]
        for lo in range(0, len(words), 4096):
            some = words[lo : lo + 4096]
            ids = np.array(self.tokenizer.encode_batch_fast([" " + " ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.cumsum([1 + len(w.encode()) for w in some])
            cuts = np.searchsorted(np.cumsum(self.size[ids]), ends) + 1
            raw, at = ids.tobytes(), 0
            for w, c in zip(some, (4 * cuts).tolist(), strict=True):
                self.memory[w] = raw[at:c]
                at = c

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if len(self.memory) > REMEMBERED:
            self.memory.clear()
        parts: list[list[str]] = []
        whole: list[int] = []
        seen: set[str] = set()
        for i, t in enumerate(texts):
            p = t.split(" ")
            parts.append(p)
            if _loose(p[0]) or any(s in t for s in self.special):
                whole.append(i)
            else:
                seen.update(p)
        missing = list(seen.difference(self.memory))
        if missing:
            self._learn(missing)
        known, skip = self.memory.__getitem__, set(whole)
        tails: list[bytes | None] = []
        for i, p in enumerate(parts):
            try:
                tails.append(None if i in skip else b"".join(map(known, p[1:])))
            except TypeError:  # a loose part
                tails.append(None)
        heads = self._bytes([t if tail is None else p[0] for t, p, tail in zip(texts, parts, tails, strict=True)])
        return [h + (tail or b"") for h, tail in zip(heads, tails, strict=True)]


_encoders: dict[str, Encoder] = {}
blocks.REMEMBERED.append(_encoders.clear)


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _cutter(path: str, capacity: int, end: int, with_ids: bool):
    tail = np.array([end], "<u4").tobytes()

    def run(batches):
        enc = encoder(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                docs, texts = part.column("doc_id").to_pylist(), [t or "" for t in part.column("text").to_pylist()]
                rows: list[tuple] = []
                for d, ids in zip(docs, enc.encode(texts), strict=True):
                    ids += tail
                    n = len(ids) // 4
                    at, k = 0, 0
                    size = n % capacity or capacity if n > capacity else n
                    while at < n:
                        piece = ids[4 * at : 4 * (at + size)]
                        rows.append((d, k, at, size, zlib.crc32(piece), piece))
                        at, k, size = at + size, k + 1, capacity
                cols = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()][: 5 + with_ids]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=False)], names)

    return run


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end: int = END_ID, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 (and the ids as bytes) of every piece of every document."""
    cols = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return cols.mapInArrow(_cutter(tokenizer or default_tokenizer(), capacity, end, with_ids), PIECES + (", ids binary" if with_ids else ""))


class Capacities:
    """A segment tree over remaining capacities: which of them have open bins."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.any = [False] * (2 * self.size)

    def set(self, at: int, value: bool) -> None:
        at += self.size
        self.any[at] = value
        while at > 1:
            at //= 2
            self.any[at] = self.any[2 * at] or self.any[2 * at + 1]

    def first(self, least: int) -> int:
        """The smallest capacity with open bins that is at least ``least``; -1 if there is none."""
        at = least + self.size
        while not self.any[at]:
            while at & 1:  # right child: go up to where a right sibling exists
                at //= 2
                if at <= 1:
                    return -1
            at += 1
        while at < self.size:
            at = 2 * at if self.any[2 * at] else 2 * at + 1
        return at - self.size


@dataclass
class Run:
    """Pieces of one length by rank from ``rank``: ``each`` of them in every bin from ``bin``, from ``offset`` on."""

    length: int
    rank: int
    count: int
    bin: int
    each: int
    offset: int


def plan(histogram: dict[int, int], capacity: int) -> list[Run]:
    """Best-fit decreasing over a histogram of lengths.

    ``open`` has, for each remaining capacity, runs of bins (first, number).  Of equal
    bins the one filled last is the tightest after it takes a piece, so a bin takes as
    many pieces of a length as fit before the next is begun.
    """
    tree = Capacities(capacity)
    open_: dict[int, list[tuple[int, int]]] = {}
    bins, out = 0, []

    def put(left: int, first: int, number: int) -> None:
        if left > 0 and number > 0:
            open_.setdefault(left, []).append((first, number))
            tree.set(left, True)

    for length in sorted(histogram, reverse=True):
        count, rank = histogram[length], 0
        while rank < count:
            left = tree.first(length)
            if left < 0:
                left, first, number = capacity, bins, -(-(count - rank) // (capacity // length))
                bins += number
            else:
                first, number = open_[left].pop()
                if not open_[left]:
                    tree.set(left, False)
            each, todo = left // length, count - rank
            full = min(number, todo // each)
            if full:
                out.append(Run(length, rank, full * each, first, each, capacity - left))
                rank += full * each
                put(left - each * length, first, full)
            if full < number:
                rest = count - rank
                if rest:  # fewer than ``each``: one bin takes them
                    out.append(Run(length, rank, rest, first + full, each, capacity - left))
                    rank = count
                    put(left - rest * length, first + full, 1)
                    full += 1
                put(left, first + full, number - full)
    return out


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to a materialised table of pieces (doc_id, piece, length up to ``capacity``)."""
    spark = parts.sparkSession
    got = parts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()  # at most ``capacity`` rows
    runs = plan({r["length"]: r["n"] for r in got}, capacity)
    kind = "_length long, _runs array<struct<rank: long, bin: long, each: long, offset: long>>"
    by: dict[int, list] = {}
    for r in runs:
        by.setdefault(r.length, []).append((r.rank, r.bin, r.each, r.offset))
    table = spark.createDataFrame(list(by.items()), kind)  # one row for each length; its size is bounded by the capacity
    ranked = gapless(parts, "length", F.struct("doc_id", "piece", "start"), ["doc_id", "piece", "start"], "_rank")
    held = ranked.join(F.broadcast(table), F.col("length") == F.col("_length"))
    run = F.expr("element_at(filter(_runs, r -> r.rank <= _rank), -1)")
    held = held.withColumn("_run", run).withColumn("_k", F.col("_rank") - F.col("_run.rank"))
    return (
        held.withColumn("sequence_id", F.expr("_run.bin + _k div _run.each"))
        .withColumn("offset", F.expr("_run.offset + (_k % _run.each) * length"))
        .drop("_rank", "_length", "_runs", "_run", "_k")
    )


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Every piece of every document with its sequence and place; one pass over the texts."""
    return pack(materialize(pieces(docs, tokenizer, capacity, end, with_ids), "pieces"), capacity)
