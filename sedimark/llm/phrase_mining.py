"""Phrase collocations by pivot partitioning, as in MG-FSM.

Words are counted first. A fixed table of 2**22 slots then says for each word how frequent it is: a slot holds the highest
power of two of the frequent words that hash to it, or 0, so a word in an empty slot is certainly rare and cuts its text. The table has one size whatever the data, and
words that share a slot cost routing only. The pivot of an n-gram is its rarest word by slot and hash (of equal ones the leftmost). Each word's place sends
a rewritten fragment: the word and up to four neighbours on each side, as far as none is rarer, so that all n-grams that the word owns lie in it. Fragments go to the
hash range of their pivot, packed by range; there n-grams are mined level by level, an n-gram going on only if its beginning was frequent, and only n-grams
over the pivot's place are counted. A pivot with more than 2**19 places is dealt over several ranges, whose parts of a count are added up afterwards,
so no task holds all places of a hot word. Words are compared as strings throughout; hashes only route.

Defined results: null text counts as empty, null lang as `und`; repeated rows count as often as they stand there; texts without words add nothing; an empty table
gives no rows; only text and lang are read. A text of more than 2 MB is cut at characters that end a piece. Counts are exact integers; scores are
computed in decimals of 38 digits (1000 * a * n and l * r stay below 10**38 up to 10**17 words).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import U, Words, _MULT, mix, shuffle_width, slices, small_batches, text_buffer, tidy, written

LONGEST, LEAST, TOP = 5, 100, 2000
SLOT_BITS = 22
#: A pivot's places are dealt over ranges, so that a range gets at most about 2**SPLIT_BITS of them.
SPLIT_BITS = 19
UNKNOWN = "und"
#: Fixed values of the contract: what ends a piece, and what else separates words.
_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_SOLID = ~_BREAK
_SOLID[[0x20, 0x09]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

SENT = "slot_range long, lang string, data binary, lengths binary, shapes binary"


def cut_long(texts: pa.Array, langs: pa.Array, most: int = 2 << 20) -> tuple[pa.Array, pa.Array]:
    """Texts and languages, longer texts cut where a piece ends, which no phrase crosses."""
    texts = texts.cast(pa.large_binary())
    if not len(texts) or (pc.max(pc.binary_length(texts)).as_py() or 0) <= most:
        return texts, langs
    parts, row = [], []
    for k, text in enumerate(texts.to_pylist()):
        at, data = 0, text or b""
        ends = np.flatnonzero(_BREAK[np.frombuffer(data, np.uint8)])
        while len(data) - at > most:
            j = int(np.searchsorted(ends, at + most)) - 1
            j = j if j >= 0 and ends[j] > at else j + 1  # no end within reach: the next one
            if j >= len(ends):
                break
            parts.append(data[at : ends[j]])
            row.append(k)
            at = int(ends[j])
        parts.append(data[at:])
        row.append(k)
    return pa.array(parts, pa.large_binary()), langs.take(pa.array(row, pa.int64()))


class Pieces(Words):
    """Lower-cased words of a batch, whether each is followed by a word of its piece, their languages and hashes with these."""

    def __init__(self, texts: pa.Array, langs: pa.Array):
        data, self.offsets = text_buffer(texts)
        self.data = data = _LOWER[data]
        n, solid = len(data), _SOLID[data]
        first = np.zeros(n + 1, bool)
        first[self.offsets] = True
        edge = np.r_[True, ~solid[:-1]] if n else solid
        self.start = np.flatnonzero(solid & (edge | first[:n]))
        edge = np.r_[~solid[1:], True] if n else solid
        self.end = np.flatnonzero(solid & (edge | first[1:])) + 1
        self.first = np.searchsorted(self.start, self.offsets)
        self.count = np.diff(self.first)
        self.lower, self._sums, self._hash = False, {}, None
        coded = langs.fill_null(UNKNOWN).dictionary_encode()
        self.langs = coded.dictionary
        self.lang = coded.indices.to_numpy()[self.text] if len(self.start) else np.zeros(0, np.int32)
        upto = np.r_[0, np.cumsum(_BREAK[data])]
        self.goes_on = np.zeros(len(self.start), bool)
        if len(self.start):
            self.goes_on[:-1] = (upto[self.start[1:]] == upto[self.end[:-1]]) & (self.text[1:] == self.text[:-1])
        # words are the solid bytes, one word after the other
        ends = np.r_[0, np.cumsum(self.end - self.start)]
        self.strings = pa.LargeStringArray.from_buffers(len(self.start), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data[solid]))

    @property
    def keys(self) -> np.ndarray:
        return keyed(self.hash, self.langs, self.lang)


def keyed(words: np.ndarray, langs: pa.Array, lang: np.ndarray) -> np.ndarray:
    """Hashes of words with their language (an index into langs)."""
    if not len(words):
        return words
    own = Words(langs.cast(pa.large_string()))
    of = own.spans(own.offsets[:-1], own.offsets[1:]) if len(own.data) else np.zeros(len(langs), U)
    return mix(words * _MULT + of[lang])


def _pieces(batches):
    for batch in batches:
        for part in slices(batch, "text", 2 << 20):
            texts, langs = cut_long(part.column("text"), part.column("lang"))
            size = np.cumsum(np.r_[0, pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False)])
            at = 0
            while at < len(texts):
                stop = max(at + 1, int(np.searchsorted(size, size[at] + (2 << 20), side="right")) - 1)
                yield Pieces(texts.slice(at, stop - at), langs.slice(at, stop - at))
                at = stop


def _count_words(batches):
    """Counts of words by language; the empty word stands for all words of a language."""
    for p in _pieces(batches):
        coded = p.strings.dictionary_encode()
        distinct = len(coded.dictionary)
        if not distinct:
            continue
        both = np.bincount(p.lang.astype(np.int64) * distinct + coded.indices.to_numpy(), minlength=distinct * len(p.langs))
        at = np.flatnonzero(both)
        lang, word = p.langs.take(pa.array(at // distinct)), coded.dictionary.take(pa.array(at % distinct))
        total = np.bincount(p.lang, minlength=len(p.langs))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.concat_arrays([lang, p.langs.take(pa.array(used))]).cast(pa.string()), pa.concat_arrays([word, pa.array([""] * len(used), pa.large_string())]).cast(pa.string()), pa.array(np.r_[both[at], total[used]].astype(np.int64))],
            names=["lang", "word", "n"],
        )


def word_counts(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, word, n) of words that stand at least so often, and of the empty word, which stands for all of its language; a written table."""
    rows = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    counts = rows.mapInArrow(tidy(_count_words), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    return written(counts.where((F.col("n") >= least) | (F.col("word") == "")))


def slot_levels(words: DataFrame) -> np.ndarray:
    """For each slot the bit length of the count of its most frequent word, 0 where there is none: 2**SLOT_BITS bytes."""

    def slots(batches):
        for batch in batches:
            own = Words(batch.column("word"))
            hashes = own.spans(own.offsets[:-1], own.offsets[1:])
            coded = batch.column("lang").dictionary_encode()
            keys = keyed(hashes, coded.dictionary, coded.indices.to_numpy())
            level = np.frexp(batch.column("n").to_numpy().astype(float))[1]
            yield pa.RecordBatch.from_arrays([pa.array((keys >> U(64 - SLOT_BITS)).astype(np.int64)), pa.array(level.astype(np.int32))], names=["slot", "level"])

    found = words.where("word <> ''").select("lang", "word", "n").mapInArrow(tidy(slots), "slot long, level int").groupBy("slot").agg(F.max("level").alias("level")).toArrow()
    out = np.zeros(1 << SLOT_BITS, np.uint8)
    out[found.column("slot").to_numpy()] = found.column("level").to_numpy()
    return out


def _fragments(levels: np.ndarray, ranges: int, longest: int, split_bits: int):
    def run(batches):
        table = levels.value
        for p in _pieces(batches):
            keys, n = p.keys, len(p.start)
            level = table[(keys >> U(64 - SLOT_BITS)).astype(np.int64)]
            order = (level.astype(U) << U(56)) | (keys >> U(8))  # rare words first
            goes_on = p.goes_on.copy()
            if n:
                goes_on[:-1] &= (level[:-1] > 0) & (level[1:] > 0)
            left, right = np.zeros(n, np.int64), np.zeros(n, np.int64)
            before, after = level > 0, level > 0
            for d in range(1, longest):
                if n <= d:
                    break
                before[:d] = False
                before[d:] &= goes_on[: n - d] & (order[: n - d] > order[d:])
                left += before
                after[n - d :] = False
                after[: n - d] &= goes_on[d - 1 : n - 1] & (order[d:] >= order[: n - d])
                right += after
            at = np.flatnonzero(left + right)
            if not len(at):
                continue
            parts = np.maximum(0, level[at].astype(np.int64) - split_bits)
            salt = (np.arange(len(at)) & ((1 << parts) - 1)).astype(U)
            to = ((mix(keys[at] + salt * _MULT) >> U(32)) * U(ranges) >> U(32)).astype(np.int64)
            group = p.lang[at].astype(np.int64) * ranges + to
            by = np.argsort(group, kind="stable")
            at, group = at[by], group[by]
            shape = (left[at] * longest + right[at] + longest * longest * (parts[by] > 0)).astype(np.uint8)
            size = left[at] + right[at] + 1
            upto = np.cumsum(size)
            words = np.repeat(at - left[at] - upto + size, size) + np.arange(upto[-1])
            sent = p.strings.take(pa.array(words))
            offsets = np.frombuffer(sent.buffers()[1], np.int64, len(sent) + 1)
            data = memoryview(sent.buffers()[2])
            lengths = np.diff(offsets).astype(np.uint32)
            used, first = np.unique(group, return_index=True)
            last = np.r_[first[1:], len(group)]
            word_first, word_last = (upto - size)[first], upto[last - 1]
            cut = lambda x, a, b: pa.array([x[i:j].tobytes() for i, j in zip(a.tolist(), b.tolist())], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(used % ranges), p.langs.take(pa.array(used // ranges)).cast(pa.string()), cut(data, offsets[word_first], offsets[word_last]), cut(lengths, word_first, word_last), cut(shape, first, last)],
                names=["slot_range", "lang", "data", "lengths", "shapes"],
            )

    return run


def mine(data: bytes, lengths: np.ndarray, shapes: np.ndarray, longest: int, least: int):
    """(phrases, counts) of the n-grams over the pivots of fragments, each length at a time.

    Those of pivots that are dealt over several ranges come with any count, the others with `least` or more.
    """
    strings = pa.LargeStringArray.from_buffers(len(lengths), pa.py_buffer(np.r_[0, np.cumsum(lengths, dtype=np.int64)]), pa.py_buffer(data)).dictionary_encode()
    words, names = strings.indices.to_numpy().astype(np.int64), strings.dictionary
    dealt, left = shapes >= longest * longest, shapes % (longest * longest) // longest
    left, right = left.astype(np.int64), (shapes % longest).astype(np.int64)
    size = left + right + 1
    begin = np.cumsum(size) - size
    # n-grams begin at the pivot or left of it
    n = left + 1
    upto = np.cumsum(n)
    at = np.repeat(begin - upto + n, n) + np.arange(upto[-1])
    end, pivot, dealt = np.repeat(begin + size, n), np.repeat(begin + left, n), np.repeat(dealt, n)
    gram = words[at]
    for m in range(2, longest + 1):
        ok = at + m <= end
        at, end, pivot, dealt, gram = at[ok], end[ok], pivot[ok], dealt[ok], gram[ok]
        if not len(at):
            return
        coded = pa.array(gram * len(names) + words[at + m - 1]).dictionary_encode()
        gram, distinct = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)
        over = at + m > pivot
        owned = np.bincount(gram[over], minlength=distinct)
        free = np.zeros(distinct, bool)
        free[gram[over & dealt]] = True
        found = np.flatnonzero((owned >= least) | free)
        if len(found):
            some = np.zeros(distinct, np.int64)
            some[gram] = at
            yield pc.binary_join_element_wise(*(names.take(pa.array(words[some[found] + j])) for j in range(m)), pa.scalar(" ", pa.large_string())), owned[found]
        free[gram[dealt]] = True
        ok = ((np.bincount(gram, minlength=distinct) >= least) | free)[gram]
        at, end, pivot, dealt, gram = at[ok], end[ok], pivot[ok], dealt[ok], gram[ok]


def _mined(longest: int, least: int):
    def run(batches):
        key, held = None, []

        def done():
            lengths, shapes = np.frombuffer(b"".join(h[1] for h in held), np.uint32), np.frombuffer(b"".join(h[2] for h in held), np.uint8)
            for phrases, counts in mine(b"".join(h[0] for h in held), lengths, shapes, longest, least):
                yield pa.RecordBatch.from_arrays([pa.array([key[1]] * len(phrases), pa.string()), phrases.cast(pa.string()), pa.array(counts.astype(np.int64))], names=["lang", "phrase", "a"])

        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if row[:2] != key and held:
                    yield from done()
                    held = []
                key = row[:2]
                held.append(row[2:])
        if held:
            yield from done()

    return run


def phrase_counts(docs: DataFrame, words: DataFrame, longest: int = LONGEST, least: int = LEAST, range_bytes: int = 8 << 20, split_bits: int = SPLIT_BITS) -> DataFrame:
    """(lang, phrase, a) of the phrases of 2 to `longest` words that stand at least so often; a written table."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(2 * shuffle_width(spark), -(-4 * size // range_bytes))  # fragments are some four times the text
    levels = spark.sparkContext.broadcast(slot_levels(words))
    sent = rows.mapInArrow(tidy(_fragments(levels, ranges, longest, split_bits)), SENT)
    parts = sent.repartition(max(shuffle_width(spark), ranges // 2), "slot_range").sortWithinPartitions("slot_range", "lang")
    found = parts.mapInArrow(tidy(_mined(longest, least)), "lang string, phrase string, a long")
    return written(found.groupBy("lang", "phrase").agg(F.sum("a").alias("a")).where(F.col("a") >= least))


def scored(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score): each phrase with its lowest-scoring cut into two parts, of equal ones the first."""
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    known = written(phrases.select("lang", "phrase", "a").unionByName(words.where("word <> ''").select("lang", F.col("word").alias("phrase"), F.col("n").alias("a"))))
    w = F.split("phrase", " ")
    cut = lambda k: F.struct(k.alias("k"), F.array_join(F.slice("w", F.lit(1), k), " ").alias("head"), F.array_join(F.slice("w", k + 1, F.size("w")), " ").alias("rest"))
    cuts = phrases.select("lang", "phrase", "a", w.alias("w")).select("lang", "phrase", "a", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - 1), cut)).alias("c")).select("lang", "phrase", "a", "c.*")
    part = lambda name, count: known.select("lang", F.col("phrase").alias(name), F.col("a").alias(count))
    sizes = words.where("word = ''").select("lang", "n")
    met = cuts.join(part("head", "l"), ["lang", "head"]).join(part("rest", "r"), ["lang", "rest"]).join(sizes, "lang")
    lowest = F.min(F.struct(F.expr("cast(1000 as decimal(4,0)) * (cast(a as decimal(19,0)) * cast(n as decimal(19,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))").alias("score"), "k", "l", "r"))
    return met.groupBy("lang", "phrase", "a", "n").agg(lowest.alias("c")).select("lang", "phrase", "a", "c.l", "c.r", "n", "c.score")


def within_longer(phrases: DataFrame, share: int = 100) -> DataFrame:
    """(lang, phrase) of phrases whose words lie inside a longer one that stands at least `share` percent as often."""
    inner = "flatten(transform(sequence(2, size(w) - 1), m -> transform(sequence(1, size(w) - m + 1), i -> array_join(slice(w, i, m), ' '))))"
    longer = phrases.select("lang", F.col("a").alias("outer_a"), F.split("phrase", " ").alias("w")).where("size(w) > 2").select("lang", "outer_a", F.explode(F.expr(inner)).alias("phrase"))
    most = longer.groupBy("lang", "phrase").agg(F.max("outer_a").alias("outer_a"))
    return phrases.join(most, ["lang", "phrase"]).where(F.col("outer_a") * 100 >= F.col("a") * share).select("lang", "phrase")


def first_of_each(rows: DataFrame, top: int, parts: int = 32) -> DataFrame:
    """Each language's first rows by score, count and phrase, with their rank: the first of every part, then the first of those, so no task ranks a whole language."""
    by = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    some = rows.withColumn("part_", F.pmod(F.xxhash64("phrase"), F.lit(parts))).withColumn("rank", F.row_number().over(W.partitionBy("lang", "part_").orderBy(*by))).where(F.col("rank") <= top).drop("part_")
    return some.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*by)).cast("long")).where(F.col("rank") <= top)


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, top: int = TOP, range_bytes: int = 8 << 20, split_bits: int = SPLIT_BITS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the phrases that stand together most, of each language."""
    small_batches(docs.sparkSession)
    words = word_counts(docs, least)
    phrases = phrase_counts(docs, words, longest, least, range_bytes, split_bits)
    kept = scored(phrases, words).join(within_longer(phrases), ["lang", "phrase"], "left_anti")
    return first_of_each(kept, top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE_SQL = """
with pieces as (select coalesce(lang, 'und') as lang, doc_id, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\n\\x0B\\f\\r]')) as piece from documents),
words as (select lang, regexp_extract_all(piece, '[^ \\t]+') as w from pieces),
sizes as (select lang, sum(len(w))::bigint as n from words group by lang),
grams as (select lang, m, array_to_string(w[i : i + m - 1], ' ') as phrase from (select lang, w, m, unnest(range(1, len(w) - m + 2)) as i from words, (select unnest(range(1, 6)) as m) where len(w) >= m)),
f as (select lang, m, phrase, count(*) as a from grams group by all having count(*) >= 100),
cut as (select lang, m, phrase, a, string_split(phrase, ' ') as w, unnest(range(1, m)) as k from f where m > 1),
met as (select c.lang, c.phrase, c.m, c.a, c.k, x.a as l, y.a as r, n, ((1000 * c.a::hugeint * n) // (x.a::hugeint * y.a))::bigint as score from cut c
    join f x on x.lang = c.lang and x.phrase = array_to_string(w[1 : k], ' ') join f y on y.lang = c.lang and y.phrase = array_to_string(w[k + 1 :], ' ') join sizes s on s.lang = c.lang),
best as (select * from met qualify row_number() over (partition by lang, phrase order by score, k) = 1),
inner_ as (select lang, a, array_to_string(w[i : i + j - 1], ' ') as phrase from (select *, unnest(range(1, m - j + 2)) as i from (select distinct lang, m, a, w, unnest(range(2, m)) as j from cut))),
dropped as (select distinct f.lang, f.phrase from f join inner_ i on f.lang = i.lang and f.phrase = i.phrase where 100 * i.a >= 100 * f.a)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score from best anti join dropped using (lang, phrase)
qualify row_number() over (partition by lang order by score desc, a desc, phrase) <= 2000
"""
