"""Byte-level BPE encoding and decoding on padded numpy matrices.

Texts are split by the tokenizer's pattern. The distinct matches of a batch are bucketed by length into padded
matrices of token ids; every round each row merges its leftmost pair of minimum rank, found in a hashed pair
table, and rows close up; finished rows leave the matrix. Matches longer than `LONG` bytes, for which a matrix would cost the square of their
length, are linked lists with a heap of pairs by rank and place: the same merges in the same order, in n log n steps.
Decoding gathers the bytes of each id. Every text is a row of its own from start to end: no shuffle, nothing collected, and memory follows the
batch (about 1 MB of text) or the longest single text.

Defined results: null text counts as empty, which has no ids; doc_id, null or repeated, is carried through; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, small_batches, tidy

RANKS = "byte_bpe_50k.tiktoken"
LONG = 128
NONE = np.int32(1 << 30)
_LOADED: dict = {}
#: The letters, digits and other characters of Latin-1 without control characters, U+0085 and U+00A0.
_LETTER, _DIGIT = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼-¾"
_LATIN = re.compile("[\t-\r\x20-\x7e\xa1-\xff]*")
#: For the pattern of the rank files: the same matches in texts of those characters, found by the faster library.
_LATIN_PATTERN = rf" ?[{_LETTER}]+|'(?:[stmd]|re|ve|ll)| ?[{_DIGIT}]+| ?[^\s{_LETTER}{_DIGIT}]+|\s+(?!\S)|\s+"


def tokenizer_path(name: str) -> str:
    """A name stands for a file of the installed vocabularies, a path for itself."""
    import public_tokenizers

    return name if "/" in name else public_tokenizers.path(name)


class PairTable:
    """(left id, right id) -> id of the joined bytes, as an open-addressing hash table in two arrays."""

    def __init__(self, pairs: np.ndarray, merged: np.ndarray):
        self.bits = int(np.ceil(np.log2(max(len(pairs), 1) * 3)))
        self.key = np.full(1 << self.bits, -1, np.int64)
        self.value = np.full(1 << self.bits, NONE, np.int32)
        slot, todo = self._slot(pairs), np.arange(len(pairs))
        while len(todo):
            free = self.key[slot[todo]] < 0
            at = todo[free]
            self.key[slot[at]] = pairs[at]  # of several for one slot the last stays
            won = self.key[slot[todo]] == pairs[todo]
            self.value[slot[todo[won]]] = merged[todo[won]]
            todo = todo[~won]
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)

    def _slot(self, pairs: np.ndarray) -> np.ndarray:
        return ((pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids, and so ranks, of the pairs; NONE for those that don't merge. Ids below zero are padding."""
        shape = left.shape
        left, right = left.ravel(), right.ravel()
        out = np.full(left.shape, NONE, np.int32)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        pairs = (left[todo].astype(np.int64) << 32) | right[todo].astype(np.int64)
        slot = self._slot(pairs)
        while len(todo):
            key = self.key[slot]
            hit = key == pairs
            out[todo[hit]] = self.value[slot[hit]]
            on = ~hit & (key >= 0)
            todo, pairs, slot = todo[on], pairs[on], (slot[on] + 1) & ((1 << self.bits) - 1)
        return out.reshape(shape)


class Codec:
    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            rows = [line.split() for line in f if line.strip()]
        self.ranks = {base64.b64decode(a): int(b) for a, b in rows}
        n = max(self.ranks.values()) + 1
        tokens = [b""] * n
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.tokens = tokens
        self.byte = np.array([self.ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        pairs, merged = [], []
        for token, rank in self.ranks.items():
            for k in range(1, len(token)):
                left, right = self.ranks.get(token[:k]), self.ranks.get(token[k:])
                if left is not None and right is not None:
                    pairs.append(left << 32 | right)
                    merged.append(rank)
        self.table = PairTable(np.array(pairs, np.int64), np.array(merged, np.int32))
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.at = np.cumsum(self.size) - self.size
        decimal = [f" {k}".encode() for k in range(n)]
        self.decimal_width = max(map(len, decimal))
        self.decimal = np.frombuffer(b"".join(d.ljust(self.decimal_width, b"\0") for d in decimal), np.uint8).reshape(n, -1)
        self.find = self._finder(pattern)
        self.clear()

    @staticmethod
    def _finder(pattern: str):
        import public_tokenizers

        find = regex.compile(pattern).findall
        if pattern != public_tokenizers.PATTERN:
            return find
        latin, simple = re.compile(_LATIN_PATTERN).findall, _LATIN.fullmatch
        return lambda text: latin(text) if simple(text) else find(text)

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, np.int32)
        self.ends = np.zeros(1 << 12, np.int64)

    # encoding of distinct matches

    def _matrix(self, ids: np.ndarray) -> list[np.ndarray]:
        """Merges the rows of a padded matrix; returns each row's ids."""
        out: list[np.ndarray] = [ids[:0, 0]] * len(ids)
        rows = np.arange(len(ids))
        rank = self.table(ids[:, :-1], ids[:, 1:]) if ids.shape[1] > 1 else np.full((len(ids), 1), NONE, np.int32)
        while len(rows):
            at = rank.argmin(1)  # the first of equal ones: the leftmost
            line = np.arange(len(rows))
            low = rank[line, at]
            done = low == NONE
            if done.any():
                for k in np.flatnonzero(done):
                    out[rows[k]] = ids[k][ids[k] >= 0]
                go = ~done
                rows, ids, rank, at, low, line = rows[go], ids[go], rank[go], at[go], low[go], np.arange(go.sum())
                if not len(rows):
                    break
            width = ids.shape[1]
            ids[line, at] = low
            column = np.arange(width - 1)
            source = column + (column > at[:, None])
            ids = np.take_along_axis(ids, source, 1)
            if width == 2:
                rank = np.full((len(rows), 1), NONE, np.int32)
                continue
            column = np.arange(width - 2)
            rank = np.take_along_axis(rank, column + (column >= at[:, None]), 1)
            for side in (at - 1, at):  # the pairs that the new token is in
                ok = np.flatnonzero((side >= 0) & (side < width - 2))
                rank[ok, side[ok]] = self.table(ids[ok, side[ok]], ids[ok, side[ok] + 1])
        return out

    def _long(self, ids: np.ndarray) -> np.ndarray:
        """Merges one long row: the leftmost pair of minimum rank is the least of a heap of rank and place."""
        n, none = len(ids), int(NONE)
        rank = array("i", self.table(ids[:-1], ids[1:]).tolist() + [none])
        heap = [(r << 40) | i for i, r in enumerate(rank) if r != none]
        heapq.heapify(heap)
        ids = array("i", ids.tolist())
        after, before = array("q", range(1, n + 1)), array("q", range(-1, n - 1))
        tokens, ranks = self.tokens, self.ranks
        while heap:
            top = heapq.heappop(heap)
            i, r = top & ((1 << 40) - 1), top >> 40
            if ids[i] < 0 or rank[i] != r:
                continue  # merged meanwhile
            j = after[i]
            ids[i], ids[j] = r, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            for left, right in ((i, k), (before[i], i)):
                if left >= 0:
                    rank[left] = new = none if right >= n else ranks.get(tokens[ids[left]] + tokens[ids[right]], none)
                    if new != none:
                        heapq.heappush(heap, (new << 40) | left)
        ids = np.frombuffer(ids, np.int32)
        return ids[ids >= 0].copy()

    def _learn(self, matches: list[str]) -> None:
        """Adds distinct matches that aren't known."""
        raw = [m.encode() for m in matches]
        length = np.array([len(r) for r in raw])
        found: list[np.ndarray] = [np.zeros(0, np.int32)] * len(raw)
        short = length <= LONG
        for width in (1, 2, 4, 6, 8, 10, 12, 16, 24, 32, 64, LONG):
            rows = np.flatnonzero(short & (length <= width))
            short[rows] = False
            for part in np.array_split(rows, len(rows) * width // 500_000 + 1):
                if len(part):
                    data = np.frombuffer(b"".join(raw[k] for k in part), np.uint8)
                    ids = np.full((len(part), width), -1, np.int32)
                    ids[np.arange(width) < length[part][:, None]] = self.byte[data]
                    for k, row in zip(part, self._matrix(ids)):
                        found[k] = row
        for k in np.flatnonzero(length > LONG):
            found[k] = self._long(self.byte[np.frombuffer(raw[k], np.uint8)])
        n = len(self.known)
        start = self.ends[n - 1] if n else 0
        more = np.concatenate(found)
        while start + len(more) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while n + len(found) > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.ids[start : start + len(more)] = more
        self.ends[n : n + len(found)] = start + np.cumsum([len(f) for f in found])
        self.known.update(zip(matches, range(n, n + len(matches))))

    # whole batches

    def encode(self, texts: list[str], remember: int = 250_000) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the number of ids of each. Known matches are dropped when there are too many."""
        if len(self.known) > remember:
            self.clear()
        matches = [self.find(t) for t in texts]
        flat = [m for part in matches for m in part]
        if fresh := list(set(flat).difference(self.known)):
            self._learn(fresh)
        if not flat:
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        index = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
        end = self.ends[index]
        start = np.where(index > 0, self.ends[index - 1], 0)
        size = end - start
        upto = np.cumsum(size)
        ids = self.ids[np.repeat(start - upto + size, size) + np.arange(upto[-1])]
        last = np.cumsum([len(m) for m in matches])
        total = np.r_[0, upto][last]
        return ids, np.diff(np.r_[0, total])

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the ids, one after the other."""
        size = self.size[ids]
        upto = np.cumsum(size)
        return self.bytes[np.repeat(self.at[ids] - upto + size, size) + np.arange(upto[-1] if len(ids) else 0)]

    def decimals(self, ids: np.ndarray) -> np.ndarray:
        """A space and the decimal digits of each id, as bytes."""
        rows = self.decimal[ids]
        return rows[rows != 0]


def codec(ranks: str, pattern: str | None) -> Codec:
    if (ranks, pattern) not in _LOADED:
        if pattern is None:
            import public_tokenizers

            _LOADED[ranks, pattern] = Codec(tokenizer_path(ranks), public_tokenizers.PATTERN)
        else:
            _LOADED[ranks, pattern] = Codec(tokenizer_path(ranks), pattern)
    return _LOADED[ranks, pattern]


def encoded(docs: DataFrame, ranks: str = RANKS, pattern: str | None = None, with_ids: bool = True, piece: int = 1 << 20) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, token_ids]) of every text. The digests are of the ids and of the bytes decoded from them."""

    small_batches(docs.sparkSession)

    def run(batches):
        c = codec(ranks, pattern)
        for batch in batches:
            for part in slices(batch, "text", piece):
                ids, count = c.encode([t or "" for t in part.column("text").to_pylist()])
                last = np.cumsum(count)
                back, digits = c.decode(ids).tobytes(), c.decimals(ids).tobytes()
                width = np.array([len(f" {k}") for k in (0, 10, 100, 1000, 10_000, 100_000)])
                in_bytes = np.r_[0, np.cumsum(c.size[ids])][last]
                in_digits = np.r_[0, np.cumsum(width[np.searchsorted([10, 100, 1000, 10_000, 100_000], ids, side="right")])][last]
                cuts = lambda data, ends, skip: [hashlib.sha256(data[a + skip : b] if b > a else b"").hexdigest() for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]
                columns = [part.column("doc_id"), pa.array(count), pa.array(cuts(digits, in_digits, 1)), pa.array(cuts(back, in_bytes, 0))]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.r_[0, last].astype(np.int32)), pa.array(ids)))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "token_ids"][: len(columns)])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(run), schema)
