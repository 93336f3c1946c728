"""Substring dedup by level-wise doubling.

A word is removed if a window of `window` words that covers it also starts in a document of smaller id. Windows of
that length are not compared outright. Lengths double up to it (for 13: 7, then 13), and only windows repeated at one
length go on to the next. At the first length it is enough to look at one window in each window of the next
length, that of least hash: equal longer windows pick equal ones, so nothing is lost and three quarters of the windows go nowhere.

Texts are dealt once into pieces of a few megabytes by the hash of their id; all levels read that same exchange. A piece
sends its distinct window hashes, packed as one row for each hash range and piece; a range's task finds those
that several pieces hold and answers the pieces. Shorter windows only choose candidates, so 64 bits are enough for them; windows
of the last length decide, and are compared by 128 bits of two independent hashes. Windows repeated within a piece are found there. So a
passage that a third of all documents share costs one entry a piece, not one a document, and no task sees a group of
unbounded size.

Defined results: null text has no words; documents of an equal id don't remove each other's words; rows with a null id are
neither removed from nor a reason to remove; texts shorter than a window stay whole; an empty table gives no rows. Only
doc_id and text are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, Words, shuffle_width

SENT = "slot long, piece long, keys binary, more binary, firsts binary"
ANSWER = "piece long, keys binary, more binary, firsts binary"


def lengths(window: int, least: int = 7) -> list[int]:
    """Doubling lengths that end at window."""
    out = [window]
    while out[0] > least and (out[0] + 1) // 2 >= 2:
        out.insert(0, (out[0] + 1) // 2)
    return out


class Piece:
    """The texts of a piece as words; windows are numbered by their first word."""

    def __init__(self, table: pa.Table):
        ids = table.column("doc_id").combine_chunks()
        self.known = ~np.asarray(ids.is_null())
        self.ids = ids.fill_null(0).to_numpy()
        self.texts = table.column("text").combine_chunks()
        self.words = Words(self.texts)

    def windows(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash and first word of the windows of documents with an id."""
        keys, at = self.words.grams(length)
        ok = self.known[self.words.text[at]] if len(at) else np.zeros(0, bool)
        return keys[ok], at[ok]

    def anchors(self, short: int, long: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows of the long length: their first words, and hash and first word of the least short window in each."""
        keys, at = self.words.grams(short)
        _, start = self.words.grams(long)
        if not len(start):
            return np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, np.int64)
        place = np.searchsorted(at, start)
        least = place + sliding_window_view(keys, long - short + 1)[place].argmin(1)
        ok = self.known[self.words.text[start]]
        return start[ok], keys[least[ok]], at[least[ok]]

    def pairs(self, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Both hashes and first word of the windows of documents with an id."""
        keys, at = self.windows(length)
        more, all_at = self.words.grams(length, 1)
        return keys, more[np.searchsorted(all_at, at)] if len(at) else np.zeros(0, U), at

    def docs(self, at: np.ndarray) -> np.ndarray:
        return self.ids[self.words.text[at]] if len(at) else np.zeros(0, np.int64)


def _sorted_in(keys: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Which keys are in held, a sorted array."""
    if not len(held):
        return np.zeros(len(keys), bool)
    return held[np.minimum(np.searchsorted(held, keys), len(held) - 1)] == keys


def _joined(table: pa.Table, column: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(column).to_pylist()), kind)


def _read(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The keys, sorted, their second hashes and least ids (where there are any) of a piece's answers."""
    keys, more, firsts = _joined(table, "keys", U), _joined(table, "more", U), _joined(table, "firsts", np.int64)
    if not len(firsts):
        return np.sort(keys), more, firsts
    order = np.lexsort((more, keys))
    return keys[order], more[order], firsts[order]


def _find(keys: np.ndarray, more: np.ndarray, key: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Where each pair of hashes stands in the pairs sorted by key; -1 where it doesn't."""
    at, out, todo = np.searchsorted(keys, key), np.full(len(key), -1), np.arange(len(key))
    while len(todo):
        todo = todo[at[todo] < len(keys)]
        todo = todo[keys[at[todo]] == key[todo]]
        hit = more[at[todo]] == second[todo]
        out[todo[hit]] = at[todo[hit]]
        todo = todo[~hit]
        at[todo] += 1
    return out


def _least(keys: np.ndarray, more: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of hashes, sorted, with their least id."""
    order = np.lexsort((docs, more, keys))
    keys, more, docs = keys[order], more[order], docs[order]
    new = np.r_[True, (keys[1:] != keys[:-1]) | (more[1:] != more[:-1])] if len(keys) else np.zeros(0, bool)
    return keys[new], more[new], docs[new]


def _send(piece: int, slots: int, keys: np.ndarray, more: np.ndarray | None = None, firsts: np.ndarray | None = None) -> pa.Table:
    """Rows for the hash ranges; keys are sorted, so ranges are slices."""
    slot = ((keys >> U(32)) * U(slots)) >> U(32)
    used, at = np.unique(slot, return_index=True)
    ends = np.r_[at[1:], len(keys)]
    cut = lambda x: pa.array([x[a:b].tobytes() if x is not None else b"" for a, b in zip(at, ends)], pa.binary())
    return pa.table({"slot": pa.array(used.astype(np.int64)), "piece": pa.array(np.full(len(used), piece)), "keys": cut(keys), "more": cut(more), "firsts": cut(firsts)})


def _answer(batches):
    """Of the hash ranges of a partition: the keys that several pieces hold, for each of those pieces (with the least id, where
    ids were sent, and then only if it is not the piece's own)."""
    rows = [b for b in batches if b.num_rows]
    if not rows:
        return
    table = pa.Table.from_batches(rows)
    keys, more, firsts = _joined(table, "keys", U), _joined(table, "more", U), _joined(table, "firsts", np.int64)
    piece = np.repeat(table.column("piece").to_numpy(), pc.binary_length(table.column("keys")).to_numpy() // 8)
    del table, rows
    final = len(firsts) > 0
    order = np.lexsort((more, keys)) if final else np.argsort(keys, kind="stable")
    keys = keys[order]
    change = keys[1:] != keys[:-1]
    if final:
        more, firsts = more[order], firsts[order]
        change = change | (more[1:] != more[:-1])
    new = np.flatnonzero(np.r_[True, change])
    count = np.diff(np.r_[new, len(keys)])
    if final:
        least = np.repeat(np.minimum.reduceat(firsts, new), count)
        ok = least < firsts
    else:
        least, ok = None, np.repeat(count > 1, count)
    piece, keys = piece[order[ok]], keys[ok]
    by = np.argsort(piece, kind="stable")
    piece, columns = piece[by], [keys[by], more[ok][by] if final else None, least[ok][by] if final else None]
    used, at = np.unique(piece, return_index=True)
    ends = np.r_[at[1:], len(piece)]
    for k in range(0, len(used), 1000):
        cut = lambda x: pa.array([x[a:b].tobytes() if x is not None else b"" for a, b in zip(at[k : k + 1000], ends[k : k + 1000])], pa.binary())  # noqa: B023, E731
        yield pa.RecordBatch.from_arrays([pa.array(used[k : k + 1000]), *map(cut, columns)], names=["piece", "keys", "more", "firsts"])


def pieces(docs: DataFrame, piece_bytes: int = 4 << 20, range_bytes: int = 128 << 20) -> tuple[DataFrame, int]:
    """(piece, doc_id, text) and the number of hash ranges; rows of an id share a piece."""
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    # a range's task holds the hashes of its range at once: about half as many bytes as that share of the texts
    ranges = max(2 * shuffle_width(docs.sparkSession), -(-size // range_bytes))
    n = max(ranges, -(-size // piece_bytes))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    piece = F.pmod(F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id")), F.lit(n)).alias("piece")
    return rows.select(piece, "doc_id", "text"), ranges


def repeated_elsewhere(dealt: DataFrame, ranges: int, window: int) -> DataFrame:
    """Answers to the pieces: keys of their windows that another piece holds in a document of smaller id, with the least such id."""
    width = max(shuffle_width(dealt.sparkSession), ranges // 2)
    steps = lengths(window)
    ask = lambda sent: sent.repartition(width, "slot").mapInArrow(_answer, ANSWER)
    last = len(steps) - 1

    def first(key, table):
        p = Piece(table)
        if last == 0:
            keys, more, at = p.pairs(window)
            return _send(key[0].as_py(), ranges, *_least(keys, more, p.docs(at)))
        return _send(key[0].as_py(), ranges, np.unique(p.anchors(steps[0], steps[1])[1]))

    def longer(k):
        def extend(key, table, answer):
            p, held = Piece(table), _read(answer)[0]
            if k == 1:
                start, anchor, _ = p.anchors(steps[0], steps[1])
                start = start[_sorted_in(anchor, held)]
            else:  # both ends of a longer window are repeated
                keys, at = p.windows(steps[k - 1])
                repeated = np.zeros(len(p.words.start) + 1, bool)
                repeated[at[_sorted_in(keys, held)]] = True
                start = p.windows(steps[k])[1]
                start = start[repeated[start] & repeated[start + steps[k] - steps[k - 1]]] if len(start) else start
            if k < last:
                keys, at = p.windows(steps[k])
                return _send(key[0].as_py(), ranges, np.unique(keys[np.isin(at, start, assume_unique=True)]))
            keys, more, at = p.pairs(steps[k])
            ok = np.isin(at, start, assume_unique=True)
            return _send(key[0].as_py(), ranges, *_least(keys[ok], more[ok], p.docs(at[ok])))

        return extend

    answers = ask(dealt.groupBy("piece").applyInArrow(first, SENT))
    for k in range(1, last + 1):
        answers = ask(dealt.groupBy("piece").cogroup(answers.groupBy("piece")).applyInArrow(longer(k), SENT))
    return answers


def _covered(p: Piece, window: int, keys: np.ndarray, more: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Of each word, whether it is removed."""
    mine, second, at = p.pairs(window)
    docs = p.docs(at)
    own, own_more, least = _least(mine, second, docs)
    first = least[_find(own, own_more, mine, second)] if len(mine) else docs
    if len(keys):
        j = _find(keys, more, mine, second)
        first = np.where(j >= 0, np.minimum(first, firsts[j]), first)
    gone = at[first < docs]
    cover = np.zeros(len(p.words.start) + window + 1, np.int64)
    np.add.at(cover, gone, 1)
    np.add.at(cover, gone + window, -1)
    return np.cumsum(cover)[: len(p.words.start)] > 0


def without_repeats(docs: DataFrame, window: int = 13, with_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept_text]) of every document."""
    dealt, ranges = pieces(docs)
    answers = repeated_elsewhere(dealt, ranges, window)

    def finish(key, table, answer):
        if not table.num_rows:
            return pa.table({c.split()[0]: pa.array([], t) for c, t in zip(schema.split(", "), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()))})
        p = Piece(table)
        gone = _covered(p, window, *_read(answer))
        w, kept = p.words, []
        removed = np.diff(np.r_[0, np.cumsum(gone)][w.first])
        for k, text in enumerate(p.texts.to_pylist()):
            words = (text or "").encode().split()
            if removed[k]:
                words = [x for x, g in zip(words, gone[w.first[k] : w.first[k + 1]].tolist()) if not g]
            kept.append(b" ".join(words))
        columns = {"doc_id": table.column("doc_id"), "n_words": pa.array(w.count), "n_removed": pa.array(removed), "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept])}
        return pa.table(columns | ({"kept_text": pa.array([x.decode() for x in kept])} if with_text else {}))

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    return dealt.groupBy("piece").cogroup(answers.groupBy("piece")).applyInArrow(finish, schema)
