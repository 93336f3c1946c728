"""Toxicity by compression distance.

Two zstandard dictionaries are trained: one on windows of ordinary text, and one on what toxic texts have of their own. A text is cut
into overlapping windows of words; each is compressed with the ordinary dictionary alone and with both, and the bytes
that the toxic one saves are its distance. A logistic curve over a text's largest distances, calibrated on the labelled sample, gives the score.

For the toxic dictionary, words of toxic sample texts serve whose document frequency there is at least `contrast`
times that in ordinary ones and that stand between varying neighbours (copies of one text don't make their words
toxic). Each window is compressed between two copies of a fixed phrase that both
dictionaries hold, so that it is never stored raw, its last word can be matched, and single bytes count.

Labels are learned only from rows whose crc32 of the doc_id's text modulo 3 isn't 1, at most `most_toxic` and
`most_ordinary` of them, those of least id hash and at most `sample_chars` characters. That sample bounds what reaches the
driver and the broadcast of its ids; every text is scored whole, without its labels, lang, source or doc_id.

Defined results: null and empty texts have no window and get the curve's value for none; a null doc_id counts as held out; repeated
doc_ids are scored row by row; labels of one doc_id that differ count as toxic; without sample texts of both kinds every score is 0; an
empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, small_batches, tidy

WIDTH, STEP, LEVEL = 3, 2, 5
PHRASE = b" of the und der que les para con dans avec mit "
ORDINARY_BYTES, TOXIC_BYTES = 4096, 4096


def windows(text: bytes) -> list[bytes]:
    """Overlapping windows of words that cover the text."""
    words = text.split()
    joined = b" ".join(words)
    n = len(words)
    if n <= WIDTH:
        return [joined] if n else []
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    at = np.arange(0, n - WIDTH + STEP, STEP)
    start = np.where(at == 0, 0, gaps[np.maximum(at, 1) - 1] + 1).tolist()
    end = np.where(at + WIDTH >= n, len(joined), gaps[np.minimum(at + WIDTH, n - 1) - 1]).tolist()
    return [joined[a:b] for a, b in zip(start, end)]


def _size_with(content: bytes):
    """The compressed size of a window between phrases, with a dictionary of that content."""
    made = zstandard.ZstdCompressionDict(content + PHRASE, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    params = zstandard.ZstdCompressionParameters.from_level(LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)
    made.precompute_compress(compression_params=params)
    compress = zstandard.ZstdCompressor(dict_data=made, compression_params=params).compress
    return lambda window: len(compress(PHRASE + window + PHRASE))


def toxic_words(toxic: list[bytes], ordinary: list[bytes], share: float = 0.01, contrast: float = 30.0, variety: float = 0.6) -> set[bytes]:
    """Words (lower-cased A-Z) that set the toxic texts apart."""
    plain, own, total = Counter(), Counter(), Counter()
    left, right = defaultdict(set), defaultdict(set)
    for text in ordinary:
        plain.update(set(text.lower().split()))
    for text in toxic:
        words = text.lower().split()
        own.update(set(words))
        total.update(words)
        for a, w, b in zip([b"", *words], words, [*words[1:], b""]):
            left[w].add(a)
            right[w].add(b)
    least = max(3, share * len(toxic))
    return {
        w for w, n in own.items()
        if n >= least and n / len(toxic) >= contrast * (plain[w] + 0.2) / len(ordinary) and min(len(left[w]), len(right[w])) >= variety * min(total[w], 50)
    }


def _trained(size: int, samples: list[bytes]) -> bytes:
    """A dictionary's content; samples too few to train on stand for themselves."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))[-size:]


class Model:
    """The two dictionaries and the calibrated curve; what tasks get is a few kilobytes."""

    def __init__(self, toxic: list[bytes], ordinary: list[bytes], samples: int = 40_000):
        own = toxic_words(toxic, ordinary)
        plain = [w for t in ordinary for w in windows(t)]
        self.ordinary = _trained(ORDINARY_BYTES, plain[:: max(1, len(plain) // samples)])
        self.toxic = _trained(TOXIC_BYTES, [b" " + w + b" " for t in toxic for w in t.split() if w.lower() in own]) if own else b""
        self._sizes = None
        x = np.array([self.features(t) for t in toxic + ordinary])
        y = np.r_[np.ones(len(toxic)), np.zeros(len(ordinary))]
        self.scale = x.std(0) + 1e-9
        x = np.c_[x / self.scale, np.ones(len(x))]
        w = np.zeros(x.shape[1])
        for _ in range(50):  # Newton's method on the penalised likelihood
            p = 1 / (1 + np.exp(-x @ w))
            w += np.linalg.solve((x.T * (p * (1 - p))) @ x + 1e-2 * np.eye(len(w)), x.T @ (y - p) - 1e-2 * w)
        self.weights = w
        self._sizes = None

    def features(self, text: bytes) -> np.ndarray:
        if self._sizes is None:
            self._sizes = _size_with(self.ordinary), _size_with(self.ordinary + self.toxic)
        plain, both = self._sizes
        saved = np.array([plain(w) - both(w) for w in windows(text)])
        top = np.sort(saved)[::-1][:3]
        return np.array([*top, *[0] * (3 - len(top)), *(np.log1p((saved >= k).sum()) for k in (2, 3, 4, 6)), (saved >= 3).mean() if len(saved) else 0.0])

    def score(self, text: bytes) -> float:
        return float(1 / (1 + np.exp(-(self.features(text) / self.scale) @ self.weights[:-1] - self.weights[-1])))


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(True))


def sample(docs: DataFrame, labels: DataFrame, most_toxic: int = 2000, most_ordinary: int = 4000, sample_chars: int = 20_000) -> dict[int, list[bytes]]:
    """Texts of the labelled sample by label. The ids joined by broadcast are at most most_toxic + most_ordinary."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out())
    found: dict[int, list[bytes]] = {0: [], 1: []}
    ids = [known.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for label, most in ((1, most_toxic), (0, most_ordinary))]
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(ids[0].unionByName(ids[1])), "doc_id").where(F.length("text") <= sample_chars)
    for r in texts.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).collect():  # of repeated ids one text, so the bound holds
        found[r.toxic].append(r.text.encode())
    return {label: sorted(x) for label, x in found.items()}


def scored(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **bounds) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every whole text."""
    texts = sample(docs, labels, **bounds)
    model = Model(texts[1], texts[0]) if texts[1] and texts[0] else None

    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                found = [model.score((t or "").encode()) if model else 0.0 for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, pa.float64())], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(run), "doc_id long, score double")
    return rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
