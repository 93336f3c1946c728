"""Quality rules with cross-document line frequency.

Each document's lines are normalised (words joined by one space, A-Z lower-cased) and hashed; a line's frequency is the
number of distinct documents of a host (the source column) that hold it. A line in more than `max_docs` documents of its
host is template text and is removed, unless a group of copies explains it; a document of whose words less than the
share `min_left` then remain is depleted and rejected, as are those failing the base rules.

The limit is a count and no share, so a footer is found in a host of a million documents as in one of ten. What a group
of copies shares is left to near-dedup: near copies share more than the line, so each document has `SKETCHES` min-hashes of the
word triples in its other lines, and where by every one of them more than the share `copy_share` of the line's
documents agree on one value, the line belongs to copies and isn't a template.

One pass over the texts writes counts, line hashes (about 15 bytes a line) and sketches (72 bytes a text); everything after works on that table.
Counting combines before the shuffle, and the join of frequent lines is one that adaptive execution can split.

Defined results: null text counts as empty, and is rejected by the base rules; a null source is a host of its own; rows
that repeat a doc_id are judged one by one but count as one document (rows without an id: one for each text); an empty table
gives no rows. Only doc_id, text and source are read, and columns of any other name are carried through.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, Words, _powers, mix, slices, small_batches, tidy, unused, written


@dataclass(frozen=True)
class Rules:
    min_words: int = 50
    max_repeat_percent: int = 50
    max_docs: int = 5
    min_left: float = 0.5
    copy_share: float = 0.5


#: Fixed values of the contract.
SYMBOLS = b"#*$%&|<>"
SKETCHES = 3
#: Word hashes of sketches: Horner's rule modulo a prime over the first WORD_BYTES bytes and the length, so that SQL can state them.
PRIME, BASE, WORD_BYTES = (1 << 31) - 1, 257, 16
TRIPLE, SALTS = (1_000_003, 998_244, 31), (1, 1_103_515_245, 69_621_017)
SCHEMA = (
    "row long, doc_id long, host long, document long, text_key long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long,"
    " lines array<long>, line_words array<long>, least_line array<long>, least array<long>, second array<long>"
)


def line_table(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each line with a word: its text, first word, byte start and byte end."""
    breaks = np.flatnonzero(w.data == 10)
    before = np.searchsorted(breaks, w.start)
    number = before + w.text
    first = np.flatnonzero(np.r_[True, number[1:] != number[:-1]]) if len(number) else np.zeros(0, np.int64)
    text, k = w.text[first], before[first]
    edge = np.r_[-1, breaks, len(w.data)]
    return text, first, np.maximum(edge[k] + 1, w.offsets[text]), np.minimum(edge[k + 1], w.offsets[text + 1])


def line_hashes(w: Words, first: np.ndarray) -> np.ndarray:
    """Hashes of normalised lines: of their words, lower-cased, in order."""
    if not len(first):
        return np.zeros(0, U)
    words = w.spans(w.start, w.end, lower=True)
    at = np.arange(len(words)) - np.repeat(first, np.diff(np.r_[first, len(words)]))
    return mix(np.add.reduceat(words * _powers(int(at.max()) + 1)[0][at], first))


def word_values(w: Words) -> np.ndarray:
    """Of each word, lower-cased: a hash below PRIME."""
    data = w.data.copy()
    data[(data >= 65) & (data <= 90)] += 32
    size = w.end - w.start
    out = np.zeros(len(size), np.int64)
    for k in range(WORD_BYTES):
        at = np.flatnonzero(size > k)
        if not len(at):
            break
        out[at] = (out[at] * BASE + data[w.start[at] + k]) % PRIME
    return (out * BASE + size) % PRIME


def sketches(w: Words, first: np.ndarray, lines: np.ndarray, text: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By text and sketch: the line of the least triple, that triple's value, and the least value of the other lines.

    at are the distinct lines of the texts, in order of text. Where there is no triple (lines of fewer than three words have none), the value is PRIME.
    """
    n = len(w.count)
    out = np.zeros((n, SKETCHES), np.int64), np.full((n, SKETCHES), PRIME), np.full((n, SKETCHES), PRIME)
    if not len(at):
        return out
    size = np.diff(np.r_[first, len(w.text)])
    words = np.r_[word_values(w), np.zeros(2, np.int64)]
    grams = sum(words[k : len(words) - 2 + k] * m % PRIME for k, m in enumerate(TRIPLE)) % PRIME
    beyond = np.arange(len(w.text)) + 2 >= np.repeat(first + size, size)
    starts = np.searchsorted(text[at], np.arange(n + 1))
    has, more = np.diff(starts) > 0, np.diff(starts) > 1
    for k, salt in enumerate(SALTS):
        values = grams * salt % PRIME
        values[beyond] = PRIME
        low = np.minimum.reduceat(values, first)[at]
        order = np.lexsort((low, text[at]))
        best = order[starts[:-1][has]]
        out[0][has, k], out[1][has, k] = lines[at][best].view(np.int64), low[best]
        out[2][more, k] = low[order[starts[:-1][more] + 1]]
    return out


def measure(w: Words) -> dict[str, np.ndarray]:
    """The contract's counts, and the hashes and words of each distinct normalised line of a text."""
    n, of = len(w.count), w.text
    salt = mix(np.arange(1, n + 1, dtype=U))
    solid = np.r_[0, np.cumsum((w.data & 0xC0) != 0x80)]
    marks = np.r_[0, np.cumsum(np.isin(w.data, np.frombuffer(SYMBOLS, np.uint8)))]
    text, first, start, end = line_table(w)
    raw = np.unique(mix(w.spans(start, end) ^ salt[text]), return_index=True)[1]
    line_count = np.bincount(text, minlength=n)
    grams, at = w.grams(3)
    key = mix(grams ^ salt[of[at]])
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    again = at[order[np.r_[False, same] | np.r_[same, False]]] if len(at) else at
    cover = np.zeros(len(of) + 4, np.int64)
    np.add.at(cover, again, 1)
    np.add.at(cover, again + 3, -1)
    covered = np.cumsum(cover)[: len(of)] > 0
    lines = line_hashes(w, first)
    order = np.lexsort((lines, text))
    words = np.diff(np.r_[first, len(of)])[order]
    new = np.flatnonzero(np.r_[True, (text[order][1:] != text[order][:-1]) | (lines[order][1:] != lines[order][:-1])]) if len(order) else order
    least_line, least, second = sketches(w, first, lines, text, order[new])
    return {
        "n_words": w.count,
        "word_chars": np.bincount(of, weights=solid[w.end] - solid[w.start], minlength=n).astype(np.int64),
        "n_symbols": marks[w.offsets[1:]] - marks[w.offsets[:-1]],
        "n_dup_lines": line_count - np.bincount(text[raw], minlength=n),
        "n_repeat_words": np.bincount(of[covered], minlength=n),
        "line_offsets": np.searchsorted(text[order][new], np.arange(n + 1)),
        "lines": lines[order][new].view(np.int64),
        "line_words": np.add.reduceat(words, new) if len(new) else words,
        "least_line": least_line.ravel(),
        "least": least.ravel(),
        "second": second.ravel(),
    }


def measured(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)

    def run(batches):
        row = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        for batch in batches:
            for part in slices(batch, "text"):
                m = measure(Words(part.column("text")))
                at = pa.array(m["line_offsets"].astype(np.int32))
                each = pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * SKETCHES)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(row, row + part.num_rows)), *(part.column(c) for c in ("doc_id", "host", "document", "text_key")),
                        *(pa.array(m[c].astype(np.int64)) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
                        *(pa.ListArray.from_arrays(at, pa.array(m[c].astype(np.int64))) for c in ("lines", "line_words")),
                        *(pa.ListArray.from_arrays(each, pa.array(m[c])) for c in ("least_line", "least", "second")),
                    ],
                    names=["row", "doc_id", "host", "document", "text_key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines", "line_words", "least_line", "least", "second"],
                )
                row += part.num_rows

    return docs.select(F.col("doc_id").cast("long"), *keys(), F.col("text").cast("string")).mapInArrow(tidy(run), SCHEMA)


def keys() -> list:
    """Hashes that stand for a row's host, document and text in joins."""
    text = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    return [
        F.xxhash64(F.col("source"), F.col("source").isNull()).alias("host"),
        F.xxhash64(F.col("doc_id").isNull(), F.coalesce(F.col("doc_id").cast("long"), text)).alias("document"), text.alias("text_key"),
    ]


def template_lines(table: DataFrame, rules: Rules) -> DataFrame:
    """(host, line) of the template lines."""
    line = F.explode("lines").alias("line")
    often = written(table.select("host", "document", line).distinct().groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") > rules.max_docs))
    # grouped by a struct, so that the groups aren't dealt as the join is and a hot line's rows can be split
    rest = F.zip_with("least_line", F.arrays_zip("least", "second"), lambda x, y: F.when(x == F.col("line"), y["second"]).otherwise(y["least"]))
    held = (
        table.select("host", "document", "least_line", "least", "second", line).join(often.select("host", "line"), ["host", "line"])
        .select(F.struct("host", "line").alias("of"), "document", F.posexplode(rest).alias("k", "value")).distinct()
    )
    top = held.groupBy("of", "k", "value").agg(F.count("*").alias("n")).groupBy("of", "k").agg(F.max("n").alias("top"))
    group = top.groupBy("of").agg(F.min("top").alias("together")).select("of.*", "together")
    return often.join(group, ["host", "line"]).where(F.col("together") <= rules.copy_share * F.col("n")).select("host", "line")


def judge(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """A row for each document: the counts, template lines to remove (their hashes) with their words, and the verdict."""
    table = written(measured(docs))
    common = template_lines(table, rules)
    removed = (
        table.select("row", "host", F.explode(F.arrays_zip("lines", "line_words")).alias("z")).select("row", "host", F.col("z.lines").alias("line"), F.col("z.line_words").alias("words"))
        .join(common, ["host", "line"]).groupBy("row").agg(F.collect_list("line").alias("removed"), F.sum("words").alias("n_removed"))
    )
    failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))
    return (
        table.drop("lines", "line_words", "least_line", "least", "second").join(removed, "row", "left").withColumn("n_removed", F.coalesce("n_removed", F.lit(0)))
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & (F.col("n_words") - F.col("n_removed") >= rules.min_left * F.col("n_words")))
    )


def scores(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    return judge(docs, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.col("n_removed").alias("n_template_words"))


def _without_lines(column: str):
    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for k, hashes in enumerate(batch.column(column).to_pylist()):
                if hashes:
                    lines = texts[k].split("\n")
                    w = Words(pa.array(lines))
                    text, first, _, _ = line_table(w)
                    gone = set(text[np.isin(line_hashes(w, first), np.array(hashes, np.int64).view(U))].tolist())
                    texts[k] = "\n".join(x for j, x in enumerate(lines) if j not in gone)
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, batch.schema.field("text"), pa.array(texts, batch.schema.field("text").type))

    return run


def cleaned(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The documents kept, without their template lines; columns are those of docs (n_chars, where it is there, follows the text).

    Rows that repeat an id and text stay together: all of them are kept or none.
    """
    names = docs.columns
    of, t, kept, gone = unused(names, "of", "key", "kept", "gone")
    verdict = (
        judge(docs, rules).where("not kept or n_removed > 0").groupBy("host", "document", "text_key")
        .agg(F.first("kept").alias(kept), F.first("removed").alias(gone)).select(F.struct("host", "document", "text_key").alias(of), kept, gone)
    )
    host, document, text = keys()
    keyed = docs.select("*", F.struct(host.alias("host"), document.alias("document"), text.alias("text_key")).alias(t))
    met = keyed.join(verdict, F.col(t) == F.col(of), "left").where(F.coalesce(F.col(kept), F.lit(True)))
    same = met.where(F.col(gone).isNull()).select(*names)
    cut = met.where(F.col(gone).isNotNull()).select(*names, gone)
    cut = cut.mapInArrow(tidy(_without_lines(gone)), cut.schema).drop(gone)
    if "n_chars" in names:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return same.unionByName(cut.select(*names))
