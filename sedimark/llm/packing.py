"""Packing into sequences by column generation on the histogram of lengths.

A document is its ids and an end mark. Its whole sequences of 1024 stand alone; what is left (1 to 1023 tokens) is packed. The histogram of these rests has at
most 1023 entries whatever the number of documents, so the linear programme is solved on the driver: a column is a pattern, a multiset of lengths that fills a sequence
exactly; a slack for each length stands for documents that are cut, at the chance of a cut. The revised simplex method starts from the slacks, and a knapsack dynamic programme over the
1024 places prices new columns by the dual values until none pays (or at a stated number of rounds: every basis on the way is feasible).
Patterns are rounded down; what rounding leaves is filled with further exact patterns by a bounded knapsack, as often as it goes.
What still isn't covered stands in one line by length and is cut every 1024 tokens; its tail is cut at powers of two, which need no padding. So no sequence is padded.

Documents are ranked within their length: tasks number their own, and offsets by task and length are running sums over tasks, so a length that a third of all documents
have is not sorted anywhere. Rank and a few thousand ranges give a document's sequence and place by arithmetic.

Defined results: null text counts as empty, one token (the end mark); rows that repeat or lack a doc_id are documents of their own; an empty table gives no rows; a very long text is
tokenised in parts at safe places; other columns are ignored. Sequence ids are unique, not dense: sequences of one document lie above 2**40.
"""

from __future__ import annotations

import functools
import itertools
import os
import re
import uuid
import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bpe_codec import tokenizer_path
from .common import shared_folder, slices, small_batches, text_buffer, tidy

MODEL, SIZE, END = "byte_bpe_50k.json", 1024, 0
#: Classes of characters in the tokenizer's pattern, and how its vocabulary writes a space.
OTHER, LETTER, NUMBER, SPACE = range(4)
SPACE_MARK = "Ġ"
#: Bytes that are tokenised at a time, and of a longer text.
PIECE, PART = 1 << 22, 1 << 20
_LOADED: dict[str, "Library"] = {}


@functools.cache
def _classes() -> np.ndarray:
    """The class of every code point in the pattern, by the library that reads the pattern elsewhere."""
    every, out = "".join(map(chr, range(0x110000))), np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            out[m.start() : m.end()] = kind
    return out


def match_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether a match of public_tokenizers.PATTERN starts at each byte of UTF-8 texts, and at their end; offsets: each text's first byte, with the end.

    A match is a run of one class, but for three rules: of white space before another character of its text the last character stands apart; if that is a space it goes with what follows; and
    an apostrophe that starts a match takes the letters of a contraction.
    """
    n, table = len(data), _classes()
    kind = np.r_[table[:128], np.zeros(128, np.uint8)][data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        more = 1 + (data[lead] >= 0xE0).astype(np.int64) + (data[lead] >= 0xF0)
        code = data[lead] & (0x3F >> more)
        for k in (1, 2, 3):
            on = np.flatnonzero(more >= k)
            code[on] = code[on] << 6 | data[lead[on] + k] & 0x3F
        kind[lead] = own = table[code]
        for k in (1, 2, 3):
            on = np.flatnonzero(more >= k)
            kind[lead[on] + k] = own[on]
    text = np.zeros(n + 1, bool)
    text[offsets] = True
    starts = text.copy()
    starts[1:n] |= kind[1:] != kind[:-1]
    space = kind == SPACE
    after = np.flatnonzero(space[:-1] & ~space[1:] & ~text[1:n]) + 1
    last = after - 1
    while (inside := (data[last] & 0xC0) == 0x80).any():
        last = last - inside
    starts[last] = True
    starts[after[data[last] == ord(" ")]] = False
    at = np.flatnonzero(data[:-1] == ord("'"))
    at = at[starts[at] & (kind[at + 1] == LETTER) & ~text[at + 1]]
    if len(at):
        one = data[at + 1]
        # the second letter, if it is of the same text
        two = np.where(text[at + 2], 0, data[np.minimum(at + 2, n - 1)])
        long = (one == ord("r")) & (two == ord("e")) | (one == ord("v")) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
        starts[at[long | short] + 1] = False
        starts[at[short] + 2] = starts[at[long] + 3] = True
    return starts


class Library:
    """A byte-level model of the tokenizers library. Matches of its pattern are encoded by the library, every distinct one once.

    Matches are never objects but for distinct ones: the texts' bytes are an Arrow array of matches as they stand, which Arrow makes a dictionary of, and the ids of a text are taken from those of the dictionary.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallelism
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.width = self.model.get_vocab_size(with_added_tokens=True)
        self.kind = np.dtype("<u2") if self.width <= 1 << 16 else np.dtype("<u4")
        added = sorted((t.content for t in self.model.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.added = re.compile(b"|".join(re.escape(t.encode()) for t in added)) if added else None
        #: ids that start with a space, which a match has only at its start; none if added tokens may hold one
        self.spaced = np.zeros(max(self.model.get_vocab(with_added_tokens=True).values()) + 1, bool)
        if not any(" " in t for t in added):
            self.spaced[[k for t, k in self.model.get_vocab(with_added_tokens=False).items() if t.startswith(SPACE_MARK)]] = True
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.ends = np.zeros(0, self.kind), np.zeros(0, np.int64)
        self.again = np.zeros(0, bool)

    def _ids(self, matches: list[str], together: int = 2_000) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The matches in another order, their ids, one after the other, and how many each has.

        Matches of a space and other characters are encoded as one text, many at a time: the pattern cuts before every such space, and only ids at a match's start start with a space.
        """
        encode = getattr(self.model, "encode_batch_fast", self.model.encode_batch)  # ids are all that is read
        spaced, alone = [], []
        for m in matches:
            (spaced if len(m) > 1 and m[0] == " " and not m[1].isspace() else alone).append(m)
        order, ids, count = [], [], []
        groups = [spaced[k : k + together] for k in range(0, len(spaced), together)]
        for group, e in zip(groups, encode(["".join(g) for g in groups], add_special_tokens=False)):
            got = np.array(e.ids, np.int64)
            first = np.flatnonzero(self.spaced[got])
            if len(first) == len(group) and first[0] == 0:
                order += group
                ids.append(got)
                count.append(np.diff(np.r_[first, len(got)]))
            else:  # never with the usual pattern
                alone += group
        each = [e.ids for e in encode(alone, add_special_tokens=False)]
        ids.append(np.array([x for part in each for x in part], np.int64))
        count.append(np.array([*map(len, each)], np.int64))
        return order + alone, np.concatenate(ids).astype(self.kind), np.concatenate(count)

    def _learn(self, matches: list[str]) -> None:
        matches, more, count = self._ids(matches)
        n, at = len(self.known), len(self.ids)
        self.ids = np.concatenate([self.ids, more])
        self.ends = np.concatenate([self.ends, at + np.cumsum(count)])
        self.again = np.concatenate([self.again, np.zeros(len(matches), bool)])
        self.known.update(zip(matches, range(n, n + len(matches))))

    def _forget(self, most: int) -> None:
        """Keeps the matches that were met again since this was last done, or none if they are too many."""
        keep = np.flatnonzero(self.again)
        if len(keep) > 2 * most // 3:
            return self.clear()
        names = [*self.known]
        self.ids, size = self._of(keep)
        self.ends, self.again = np.cumsum(size), np.zeros(len(keep), bool)
        self.known = {names[k]: n for n, k in enumerate(keep.tolist())}

    def _of(self, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of known matches, one after the other, and how many each has."""
        start = np.where(index > 0, self.ends[index - 1], 0) if len(index) else index
        size = self.ends[index] - start
        upto = np.cumsum(size)
        return self.ids[np.repeat(start - upto + size, size) + np.arange(upto[-1] if len(index) else 0)], size

    def starts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """match_starts, with added tokens as texts of their own that are one match each."""
        spans = []
        if self.added and self.added.search(data):
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                spans += [(a + m.start(), a + m.end()) for m in self.added.finditer(data[a:b])]
        out = match_starts(data, np.concatenate([offsets, *np.array(spans, np.int64)]) if spans else offsets)
        for a, b in spans:
            out[a + 1 : b] = False
        return out

    def encode(self, texts: pa.Array, remember: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the number of ids of each. When too many matches are known, those that were met once are dropped."""
        if len(self.known) > remember:
            self._forget(remember)
        data, offsets = text_buffer(texts)
        if not len(data):
            return np.zeros(0, self.kind), np.zeros(len(texts), np.int64)
        start = np.flatnonzero(self.starts(data, offsets)[:-1])
        matches = _strings(pa.large_string(), np.append(start, len(data)), data).dictionary_encode()
        distinct = matches.dictionary.to_numpy(zero_copy_only=False)
        index = np.fromiter(map(self.known.get, distinct.tolist(), itertools.repeat(-1)), np.int64, len(distinct))
        self.again[index[index >= 0]] = True
        new = np.flatnonzero(index < 0)
        if len(new):
            fresh = distinct[new].tolist()
            self._learn(fresh)
            index[new] = [*map(self.known.__getitem__, fresh)]
        ids, size = self._of(index)
        taken = _strings(pa.large_binary(), np.r_[0, np.cumsum(size)] * self.kind.itemsize, ids).take(matches.indices)
        upto = np.frombuffer(taken.buffers()[1], np.int64, len(taken) + 1) // self.kind.itemsize
        return np.frombuffer(taken.buffers()[2], self.kind, upto[-1]), np.diff(upto[np.searchsorted(start, offsets)])


def _strings(kind: pa.DataType, ends: np.ndarray, data: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(kind, len(ends) - 1, [None, pa.py_buffer(np.ascontiguousarray(ends, np.int64)), pa.py_buffer(data)])


def library(model: str) -> Library:
    if model not in _LOADED:
        _LOADED[model] = Library(tokenizer_path(model))
    return _LOADED[model]


def _parts(text: str, most: int = PART):
    """A text in parts; each but the first starts with a space after another character, where no match crosses."""
    at = 0
    while len(text) - at > most:
        cut = text.find(" ", at + most)
        while cut > 0 and text[cut - 1].isspace():
            cut = text.find(" ", cut + 1)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


ROWS = "doc_id long, part long, tokens long, rest long, local long, whole long, ids binary"


def tokenised(docs: DataFrame, model: str = MODEL, size: int = SIZE, remember: int = 600_000) -> DataFrame:
    """ROWS of every document, a written table: its ids with the end mark, the length of its rest, the number of earlier documents of its task with that rest, and of their whole sequences."""
    spark = docs.sparkSession
    small_batches(spark)

    def run(batches):
        enc, part, seen, whole = library(model), TaskContext.get().partitionId(), np.zeros(size, np.int64), 0
        end = np.array([END], enc.kind).tobytes()
        for batch in batches:
            for piece in slices(batch, "text", PIECE):
                out = []
                texts = piece.column("text")
                if len(texts) == 1 and texts.nbytes > 2 * PART:
                    each = [enc.encode(pa.array([p]), remember) for t in texts.to_pylist() for p in _parts(t or "")]
                    ids, ends = np.concatenate([i for i, _ in each]), np.array([0, sum(len(i) for i, _ in each)])
                else:
                    ids, count = enc.encode(texts, remember)
                    ends = np.cumsum(np.r_[0, count])
                for doc, a, b in zip(piece.column("doc_id").to_pylist(), ends[:-1].tolist(), ends[1:].tolist()):
                    n = b - a + 1
                    rest = n % size
                    out.append((doc, part, n, rest, int(seen[rest]), whole, ids[a:b].tobytes() + end))
                    seen[rest] += 1
                    whole += n // size
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if k == 6 else pa.int64()) for k, c in enumerate(zip(*out))], names=[c.split()[0] for c in ROWS.split(", ")])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    rows.mapInArrow(tidy(run), ROWS).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(ROWS).parquet(path)


# the linear programme, on the histogram


def best_pattern(lengths: np.ndarray, value: np.ndarray, size: int) -> tuple[float, np.ndarray]:
    """The exact filling of `size` places of most value (lengths may repeat), as counts by length; -inf if there is none. Lengths fall."""
    best, last = np.full(size + 1, -np.inf), np.full(size + 1, -1)
    best[0] = 0
    first = np.searchsorted(-lengths, -np.arange(size + 1))  # lengths from here on fit
    for s in range(int(lengths[-1]), size + 1):
        k = first[s]
        got = best[s - lengths[k:]] + value[k:]
        j = int(got.argmax())
        best[s], last[s] = got[j], k + j
    counts, s = np.zeros(len(lengths), np.int64), size
    if best[size] == -np.inf:
        return -np.inf, counts
    while s:
        counts[last[s]] += 1
        s -= int(lengths[last[s]])
    return float(best[size]), counts


def column_generation(lengths: np.ndarray, demand: np.ndarray, size: int, rounds: int = 1_500, gap: float = 0.002) -> tuple[np.ndarray, np.ndarray]:
    """(patterns, how often each): a basis that covers most tokens by exact patterns, not rounded.

    Dual values less `value` times a length's share of a sequence are dual feasible, so what is cut beyond the optimum is at most `value` of all tokens: the method ends at `gap` or below.
    """
    m = len(lengths)
    inverse, columns = np.eye(m), np.eye(m, dtype=np.int64)
    dual, slack = lengths / size, np.ones(m, bool)
    # demands are moved a little, so that no step has length zero and the method can't turn in a circle
    moved = demand + demand.max() * 1e-7 * np.random.default_rng(1).random(m)
    x = moved.copy()
    for k in range(rounds):
        value, pattern = best_pattern(lengths, np.minimum(dual, lengths / size), size)
        if value <= gap:
            break
        on = np.flatnonzero(pattern)
        step = (inverse[:, on] * pattern[on]).sum(1)
        ok = np.flatnonzero(step > 1e-9)
        if not len(ok):
            break
        out = ok[(np.maximum(x[ok], 0) / step[ok]).argmin()]
        by = max(x[out], 0) / step[out]
        x -= by * step
        x[out] = by
        row = inverse[out] / step[out]
        near = np.flatnonzero(row)  # rows of the inverse are sparse at first
        inverse[:, near] -= step[:, None] * row[near]
        inverse[out] = row
        dual = dual - dual[on] @ pattern[on] * row
        columns[out], slack[out] = pattern, False
        if k % 500 == 499:  # rounding errors go
            inverse = np.linalg.inv(columns.T.astype(float))
            x, dual = inverse @ moved, np.where(slack, lengths / size, 0.0) @ inverse
    x = np.linalg.solve(columns.T.astype(float), demand.astype(float))
    return columns[~slack], np.maximum(x[~slack], 0)


def _bounded(lengths: np.ndarray, left: np.ndarray, size: int) -> np.ndarray | None:
    """Counts by length, at most those left, that fill `size` exactly; long ones first."""
    reached = np.full(size + 1, -1)
    reached[0] = len(lengths)
    used = np.zeros(size + 1, np.int64)
    for k in np.flatnonzero(left):
        n = int(lengths[k])
        used[:] = 0
        for s in range(n, size + 1) if left[k] * n >= 2 * n and 2 * n <= size else ():
            if reached[s] < 0 <= reached[s - n] and used[s - n] < left[k]:
                reached[s], used[s] = k, used[s - n] + 1
        if not (left[k] >= 2 and 2 * n <= size):
            new = np.flatnonzero((reached[n:] < 0) & (reached[:-n] >= 0)) + n
            reached[new] = k
        if reached[size] >= 0:
            counts, s = np.zeros(len(lengths), np.int64), size
            while s:
                counts[reached[s]] += 1
                s -= int(lengths[reached[s]])
            return counts
    return None


def rounded(lengths: np.ndarray, demand: np.ndarray, patterns: np.ndarray, times: np.ndarray, size: int) -> list[tuple[np.ndarray, int]]:
    """Whole numbers of patterns within the demand: rounded down, then exact fillings of what is left, each as often as it goes."""
    left, out = demand.copy(), []

    def use(pattern, n):
        nonlocal left
        on = pattern > 0
        n = min(n, int((left[on] // pattern[on]).min()))
        if n > 0:
            left = left - n * pattern
            out.append((pattern, n))
        return n > 0

    for pattern, n in zip(patterns, np.floor(times + 1e-6).astype(np.int64).tolist()):
        use(pattern, n)
    while (pattern := _bounded(lengths, left, size)) is not None and use(pattern, int(left.max())):
        pass
    return out


class Plan:
    """Where the document of each rank within its length stands: ranges of ranks in patterns, then one line that is cut."""

    def __init__(self, histogram: dict[int, int], size: int = SIZE, rounds: int = 1_500):
        self.size = size
        lengths = np.array(sorted(histogram, reverse=True), np.int64)
        demand = np.array([histogram[int(n)] for n in lengths], np.int64)
        used, sequences, self.ranges = np.zeros(len(lengths), np.int64), 0, {int(n): [] for n in lengths}
        if len(lengths):
            patterns, times = column_generation(lengths, demand, size, rounds)
            for pattern, n in rounded(lengths, demand, patterns, times, size):
                at = 0
                for k in np.flatnonzero(pattern):
                    each = int(pattern[k])
                    # ranks from here on: `each` to a sequence, side by side from place `at`
                    self.ranges[int(lengths[k])].append((int(used[k]), each, sequences, at))
                    used[k] += each * n
                    at += each * int(lengths[k])
                sequences += n
        self.first_cut = {int(n): int(u) for n, u in zip(lengths, used)}
        left = demand - used
        upto = np.cumsum(left * lengths)
        self.line = {int(n): int(u - k * n) for n, u, k in zip(lengths, upto, left)}
        self.sequences, total = sequences, int(upto[-1]) if len(lengths) else 0
        #: share of the rests that are cut or may be
        self.in_line, self.rests = int(left.sum()), int(demand.sum())
        # the line's sequences: whole ones, then powers of two
        self.whole, tail = divmod(total, size)
        self.tail = [1 << b for b in range(tail.bit_length() - 1, -1, -1) if tail >> b & 1]
        self.starts = {n: [r[0] for r in ranges] for n, ranges in self.ranges.items()}

    def places(self, length: int, rank: int):
        """(start in the rest, length, sequence, place in it) of the pieces of a document's rest."""
        if rank < self.first_cut[length]:
            lo, each, sequence, at = self.ranges[length][bisect_right(self.starts[length], rank) - 1]
            k = rank - lo
            yield 0, length, sequence + k // each, at + k % each * length
            return
        at, done = self.line[length] + (rank - self.first_cut[length]) * length, 0
        while done < length:
            sequence, place, room = self._line_at(at + done)
            n = min(room, length - done)
            yield done, n, self.sequences + sequence, place
            done += n

    def _line_at(self, at: int) -> tuple[int, int, int]:
        if at < self.whole * self.size:
            return at // self.size, at % self.size, self.size - at % self.size
        at -= self.whole * self.size
        for k, n in enumerate(self.tail):
            if at < n:
                return self.whole + k, at, n - at
            at -= n
        raise IndexError("beyond the line")


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def packed(docs: DataFrame, model: str = MODEL, size: int = SIZE, rounds: int = 1_500, with_ids: bool = False) -> DataFrame:
    """PIECES of all documents (with_ids: and the pieces' ids)."""
    rows = tokenised(docs, model, size)
    wide = library(model).width > 1 << 16
    cells = rows.groupBy("part", "rest").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("rest").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    offsets = cells.select("part", "rest", F.coalesce(before, F.lit(0)).alias("before"))  # a row for each task and length
    plan = Plan({r.rest: r.n for r in cells.where("rest > 0").groupBy("rest").agg(F.sum("n").alias("n")).collect()}, size, rounds)
    schema = PIECES + ", ids array<int>" * with_ids

    def run(batches):
        for batch in batches:
            out, kept = [], []
            for doc, part, n, rest, rank, whole, raw in zip(*(c.to_pylist() for c in batch.columns)):
                ids = np.frombuffer(raw, "<u4" if wide else "<u2").astype("<u4")
                data = memoryview(ids).cast("B")
                places = [(k * size, size, (part + 1 << 40) + whole + k, 0) for k in range(n // size)]
                if rest:
                    places += [(n - rest + s, m, sequence, at) for s, m, sequence, at in plan.places(rest, rank)]
                for start, m, sequence, at in places:
                    out.append((doc, start, m, zlib.crc32(data[4 * start : 4 * (start + m)]), n, sequence, at))
                    if with_ids:
                        kept.append(ids[start : start + m])
            arrays = [pa.array(c, pa.int64()) for c in zip(*out)] if out else [pa.array([], pa.int64())] * 7
            if with_ids:
                ends = np.cumsum([0, *map(len, kept)])
                arrays.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, "<u4"), *kept]).astype(np.int32))))
            yield pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in schema.split(", ")])

    met = rows.join(offsets, ["part", "rest"]).select("doc_id", "part", "tokens", "rest", (F.col("local") + F.col("before")).alias("rank"), "whole", "ids")
    return met.mapInArrow(tidy(run), schema)
