"""SentencePiece encoding and decoding with a batched numpy Viterbi.

The public model is a byte-pair one, whose encoding is not the cheapest path under fixed piece
scores.  It is a Viterbi path all the same, over pieces as states: a sequence of pieces is the
encoding exactly if each piece may follow the one before it, which holds if merging
their joined text by rank would give the two back.  So for every prefix of a
word there is one last piece, the one whose predecessor is the prefix's own last piece and lets it follow.

Words of equal length advance together: for a slab of end positions every piece length is
probed by a hash of the substring in the sorted hashes of all pieces (indexed by their first bits);
then at each end position the pairs of last piece and candidate are tested in one sweep, and the maximum over allowed
lengths is the backpointer.  A few very long words, which would make sweeps of one pair, are tested pair by pair.
Characters that are no piece stand alone and become byte pieces.  The few words with runs of
spaces, whose merges do not rise in rank, are merged from a heap of pairs.  Time is near linear in a word's length.

Defined results: null has the ids of the empty text, none; the space mark U+2581 within a text is
decoded as a space, as the format has it.
"""

from __future__ import annotations

import heapq
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks
from .blocks import mix64, powers

SPACE_MARK = "▁"
REMEMBERED = 400_000
#: Words of one length that advance together at most, and substrings probed at once.
BATCH, PROBES = 8192, 1 << 19
#: Fewer words than this are tested pair by pair.
FEW = 12
#: Bits of a hash that name its slot, in the index of the pieces' hashes and in the memory of tested pairs.
SLOT_BITS = 20


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _codes(texts: list[str]) -> np.ndarray:
    """(texts, characters) of equally long texts."""
    return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).reshape(len(texts), -1).astype(np.uint64)


def _slot(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


class _Spans:
    """64-bit hashes of the substrings of equally long texts."""

    def __init__(self, codes: np.ndarray):
        self.size = codes.shape[1]
        up, self.down = powers(self.size + 1)
        self.sums = np.zeros((len(codes), self.size + 1), np.uint64)
        np.add.accumulate(mix64(codes + np.uint64(1)) * up[: self.size], axis=1, out=self.sums[:, 1:])

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """(texts, spans)"""
        return mix64((self.sums[:, end] - self.sums[:, start]) * self.down[start] + (end - start).astype(np.uint64))


class Pieces:
    """A byte-pair SentencePiece model's vocabulary, read from its file; none of the library's encoding is used."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        self.byte_ids = np.zeros(256, np.uint32)
        ordinary = []
        for i, name in enumerate(names):
            if sp.is_byte(i):
                self.byte_ids[int(name[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                ordinary.append(i)
        self.as_bytes = [bytes([int(x[3:5], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) else x.replace(SPACE_MARK, " ").encode() for i, x in enumerate(names)]
        self.score = {names[i]: sp.get_score(i) for i in ordinary}
        self.id_of = {names[i]: i for i in ordinary}
        self.longest = max(map(len, self.id_of), default=1)
        self.memory: dict[str, bytes] = {}
        self._order(names, ordinary)

    def _order(self, names: list[str], ordinary: list[int]) -> None:
        """Put pieces in order of merging and find how each is made of two earlier ones."""
        single = [i for i in ordinary if len(names[i]) == 1]
        plain = [i for i in ordinary if len(names[i]) > 1 and SPACE_MARK * 2 not in names[i]]
        plain.sort(key=lambda i: -self.score[names[i]])
        order = single + plain
        at = {names[i]: k for k, i in enumerate(order)}
        n = len(order)
        self.left, self.right = np.arange(n), np.arange(n)
        self.n = n
        pairs: dict[tuple[int, int], int] = {}
        made = list(range(len(single)))
        for k in range(len(single), n):
            text = names[order[k]]
            for cut in range(len(text) - 1, 0, -1):
                a, b = at.get(text[:cut], n), at.get(text[cut:], n)
                if a < k and b < k and self._follows(a, b, pairs):
                    pairs[a, b] = k
                    self.left[k], self.right[k] = a, b
                    made.append(k)
                    break
        keys = np.array([a * n + b for a, b in pairs], np.int64)
        o = np.argsort(keys)
        self.pair_keys, self.pair_into = keys[o], np.array(list(pairs.values()), np.int64)[o]
        self.ids = np.array(order, np.uint32)
        made = np.array(made, np.int64)  # a piece that no merges make cannot occur
        h, size = np.zeros(len(made), np.uint64), np.array([len(names[order[k]]) for k in made])
        for length in np.unique(size):
            rows = np.flatnonzero(size == length)
            h[rows] = _Spans(_codes([names[order[made[r]]] for r in rows])).hashes(np.zeros(1, np.int64), np.full(1, length))[:, 0]
        o = np.argsort(h)
        self.hashes, self.hashed = h[o], made[o]
        slot, first, share = np.unique(_slot(self.hashes), return_index=True, return_counts=True)
        self.first_at = np.full(1 << SLOT_BITS, -1, np.int32)
        self.first_at[slot] = first
        self.share = int(share.max(initial=1))  # pieces with the same slot
        self.pairs, self.known = pairs, {}
        self.tested, self.verdict = np.full(1 << SLOT_BITS, -1, np.int64), np.zeros(1 << SLOT_BITS, bool)

    def _follows(self, a: int, b: int, pairs: dict[tuple[int, int], int]) -> bool:
        """Whether merging by rank leaves a bound between two pieces: undo merges from the last on and see that none crosses it."""
        limit = self.n
        while True:
            into = pairs.get((a, b))
            if into is not None and into < limit:
                return False
            if a > b:
                limit, a = a, int(self.right[a])
                if a == limit:
                    limit, b = b + 1, int(self.left[b])
                    if b + 1 == limit:
                        return True
            else:
                limit, b = b + 1, int(self.left[b])
                if b + 1 == limit:
                    limit, a = a, int(self.right[a])
                    if a == limit:
                        return True

    def follows(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The same for arrays of pairs, most of which have been tested before."""
        key = a * self.n + b
        slot = _slot(mix64(key.astype(np.uint64)))
        out = self.verdict[slot]
        new = np.flatnonzero(self.tested[slot] != key)
        if len(new):
            out[new] = found = self._test(a[new], b[new])
            slot = slot[new]
            self.tested[slot] = key[new]
            kept = self.tested[slot] == key[new]  # of several new pairs with one slot one is remembered
            self.verdict[slot[kept]] = found[kept]
        return out

    def _test(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros(len(a), bool)
        rows, limit = np.arange(len(a)), np.full(len(a), self.n)
        a, b = a.copy(), b.copy()
        while len(rows):
            key = a * self.n + b
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            crossed = (self.pair_keys[at] == key) & (self.pair_into[at] < limit)
            undo_a = a > b
            la, lb = self.right[a], self.left[b]
            # undo the later merge; where that piece is a single character, the other's
            end_a, end_b = la == a, lb == b
            use_a = np.where(undo_a, ~end_a, end_b & ~end_a)
            use_b = np.where(undo_a, end_a & ~end_b, ~end_b)
            done = ~use_a & ~use_b
            out[rows[done & ~crossed]] = True
            limit = np.where(use_a, a, np.where(use_b, b + 1, limit))
            a, b = np.where(use_a, la, a), np.where(use_b, lb, b)
            go = ~done & ~crossed
            rows, limit, a, b = rows[go], limit[go], a[go], b[go]
        return out

    def _candidates(self, spans: _Spans, n: int):
        """Slabs of end positions in order: the pieces (word, end, length, piece) that end there, in order of their ends."""
        top = min(self.longest, spans.size)
        step = max(1, PROBES // (n * top))
        for lo in range(1, spans.size + 1, step):
            end = np.repeat(np.arange(lo, min(lo + step, spans.size + 1)), top)
            length = np.tile(np.arange(1, top + 1), len(end) // top)
            fits = length <= end
            end, length = end[fits], length[fits]
            key = spans.hashes(end - length, end).T
            row = self.first_at[_slot(key)]
            at, w = np.nonzero(row >= 0)
            key, row = key[at, w], row[at, w].astype(np.int64)
            hit = self.hashes[row] == key
            for _ in range(1, self.share):
                row = np.where(hit, row, np.minimum(row + 1, len(self.hashes) - 1))
                hit = self.hashes[row] == key
            at, w, row = at[hit], w[hit], row[hit]
            yield w, end[at], length[at], self.hashed[row]

    def viterbi(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of equally long words without runs of spaces, one word after the other, and each word's number of ids.

        A character that is no piece is marked by its code plus 2 ** 32.
        """
        codes = _codes(words)
        n, size = codes.shape
        last = np.full((n, size + 1), -1, np.int64)  # piece that ends here; -1 at the start and after a character that is no piece
        back = np.ones((n, size + 1), np.int64)
        advance = self._advance_few if n < FEW else self._advance
        for w, end, length, piece in self._candidates(_Spans(codes), n):
            advance(last, back, w, end, length, piece)
        ends = np.zeros((n, size + 1), bool)
        at, rows = np.full(n, size), np.arange(n)
        while len(rows):
            ends[rows, at] = True
            at = at - back[rows, at]
            rows, at = rows[at > 0], at[at > 0]
        w, j = np.nonzero(ends)
        piece = last[w, j]
        ids = np.where(piece >= 0, self.ids[piece].astype(np.int64), codes[w, j - 1].astype(np.int64) + (1 << 32))
        return ids, ends.sum(axis=1)

    def _advance(self, last: np.ndarray, back: np.ndarray, w: np.ndarray, end: np.ndarray, length: np.ndarray, piece: np.ndarray) -> None:
        cuts = np.flatnonzero(np.diff(end, prepend=-1))
        for lo, hi in zip(cuts, [*cuts[1:], len(end)], strict=True):
            j, at, size, cand = int(end[lo]), w[lo:hi], length[lo:hi], piece[lo:hi]
            before = last[at, j - size]
            ok = before < 0
            test = np.flatnonzero(~ok)
            ok[test] = self.follows(before[test], cand[test])
            at, size, cand = at[ok], size[ok], cand[ok]
            best = np.ones(len(last), np.int64)
            np.maximum.at(best, at, size)
            back[:, j] = best
            chosen = size == best[at]
            last[at[chosen], j] = cand[chosen]

    def _advance_few(self, last: np.ndarray, back: np.ndarray, w: np.ndarray, end: np.ndarray, length: np.ndarray, piece: np.ndarray) -> None:
        if not len(end):
            return
        if len(self.known) > REMEMBERED // 8:
            self.known.clear()
        lo, hi, known = max(0, int(end[0]) - self.longest), int(end[-1]), self.known
        view, steps = last[:, lo : hi + 1].tolist(), {}
        for r, j, size, cand in zip(w.tolist(), end.tolist(), length.tolist(), piece.tolist(), strict=True):
            before = view[r][j - size - lo]
            if before >= 0:
                ok = known.get((before, cand))
                if ok is None:
                    ok = known[before, cand] = self._follows(before, cand, self.pairs)
                if not ok:
                    continue
            if size >= steps.get((r, j), 0):
                steps[r, j] = size
                view[r][j - lo] = cand
        last[:, lo : hi + 1] = view
        for (r, j), size in steps.items():
            back[r, j] = size

    def merged(self, word: str) -> np.ndarray:
        """Ids by merging the best pair, leftmost first, until none is left: for words with runs of spaces, and for tests."""
        parts: list[str | None] = list(word)
        n = len(parts)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap: list[tuple[float, int, str, str]] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < n:
                a, b = parts[i], parts[after[i]]
                s = self.score.get(a + b)
                if s is not None:
                    heapq.heappush(heap, (-s, i, a, b))

        for i in range(n):
            offer(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            if parts[i] != a or after[i] >= n or parts[after[i]] != b:
                continue  # one of the two has been merged since
            j = after[i]
            parts[i], parts[j] = a + b, None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return np.array([self.id_of[p] if p in self.id_of else ord(p) + (1 << 32) for p in parts if p is not None], np.int64)

    def _finish(self, ids: np.ndarray) -> bytes:
        if len(ids) and ids.max() >= 1 << 32:
            parts = []
            for x in ids.tolist():
                parts += [x] if x < 1 << 32 else self.byte_ids[list(chr(x - (1 << 32)).encode())].tolist()
            ids = np.array(parts, np.int64)
        return ids.astype("<u4").tobytes()

    def _learn(self, words: list[str]) -> None:
        by: dict[int, list[str]] = {}
        for w in words:
            if SPACE_MARK * 2 in w:
                self.memory[w] = self._finish(self.merged(w))
            else:
                by.setdefault(len(w), []).append(w)
        for group in by.values():
            step = max(1, min(BATCH, (1 << 18) // len(group[0])))
            for lo in range(0, len(group), step):
                some = group[lo : lo + step]
                ids, n = self.viterbi(some)
                ends = np.cumsum(n)
                raw = ids.astype("<u4").tobytes()  # wrong for characters that are no piece, whose words are done again
                self.memory.update((x, raw[4 * (e - k) : 4 * e]) for x, e, k in zip(some, ends.tolist(), n.tolist(), strict=True))
                for i in np.unique(np.searchsorted(ends, np.flatnonzero(ids >= 1 << 32), "right")):
                    self.memory[some[i]] = self._finish(ids[ends[i] - n[i] : ends[i]])

    @staticmethod
    def words(text: str) -> list[str]:
        """A text's words, each with the space marks before it; no piece goes on past a word."""
        if not text:
            return []
        if "  " not in text and text[-1] != " " and text[0] != " " and SPACE_MARK not in text:
            return [SPACE_MARK + w for w in text.split(" ")]
        return re.findall(f"{SPACE_MARK}+[^{SPACE_MARK}]*", SPACE_MARK + text.replace(" ", SPACE_MARK))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if len(self.memory) > REMEMBERED:
            self.memory.clear()
        words = [self.words(t) for t in texts]
        missing = {w for ws in words for w in ws if w not in self.memory}
        self._learn(list(missing))
        return [b"".join(map(self.memory.__getitem__, ws)) for ws in words]

    def decode(self, ids: bytes) -> str:
        raw = b"".join(map(self.as_bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return raw[raw.startswith(b" ") :].decode("utf-8", "replace")


_loaded: dict[str, Pieces] = {}
blocks.REMEMBERED.append(_loaded.clear)


def pieces(path: str) -> Pieces:
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def encode_documents(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id and ids (binary, little-endian unsigned 32-bit) of whole texts."""
    path = model or default_model()

    @F.arrow_udf("binary")
    def of(t: pa.Array) -> pa.Array:
        p, texts = pieces(path), t.to_pylist()
        return pa.array([x for lo in range(0, len(texts), 256) for x in p.encode([y or "" for y in texts[lo : lo + 256]])], pa.binary())

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), of(F.col("text").cast("string")).alias("ids"))


def decode_documents(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id and text of encoded documents."""
    path = model or default_model()

    @F.arrow_udf("string")
    def of(x: pa.Array) -> pa.Array:
        p = pieces(path)
        return pa.array([p.decode(b or b"") for b in x.to_pylist()], pa.string())

    return encoded.select("doc_id", of(F.col("ids")).alias("text"))


def round_trip(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, n_pieces, ids_crc32, decoded_crc32 (UTF-8 of the decoded text) and same (decoded equals the text; true for null)."""
    path = model or default_model()

    @F.arrow_udf("struct<n_pieces: long, ids_crc32: long, decoded_crc32: long, same: boolean>")
    def of(t: pa.Array) -> pa.Array:
        p, texts = pieces(path), [x or "" for x in t.to_pylist()]
        n, a, b, same = [], [], [], []
        for lo in range(0, len(texts), 256):
            some = texts[lo : lo + 256]
            for text, ids in zip(some, p.encode(some), strict=True):
                back = p.decode(ids)
                n.append(len(ids) // 4)
                a.append(zlib.crc32(ids))
                b.append(zlib.crc32(back.encode()))
                same.append(back == text)
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(same, pa.bool_())], ["n_pieces", "ids_crc32", "decoded_crc32", "same"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), of(F.col("text").cast("string")).alias("p")).select("doc_id", "p.*")
