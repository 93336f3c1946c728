"""Token counts in Arrow functions that return lengths only.

Arrow batches are cut into pieces of about equal bytes. Where the tokenizer's vocabulary allows it, each text is split at
safe boundaries: this model writes spaces as a mark at word starts, and none of its pieces has a mark after
another character, so no merge crosses from a character to a following space. The parts between are encoded by the library in one batch
call, every distinct part once, and counts are added up. Whether the vocabulary allows it is tested when the model is loaded; if not,
whole texts go to the library. A part is at most the longest run without a space, so a very long text costs no more memory than others.

Defined results: null text counts as empty, 0 tokens; doc_id, null or repeated, is carried through; an empty table gives no rows;
only doc_id and text are read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe_codec import tokenizer_path
from .common import slices, small_batches, tidy

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
MARK = "▁"
_LOADED: dict[str, Counter] = {}


class Counter:
    """Counts of a sentencepiece model; parts seen before are remembered, at most `remember` of them."""

    def __init__(self, path: str, remember: int = 250_000):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (self.model.id_to_piece(k) for k in range(self.model.get_piece_size()))
        crossing = any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces)
        # spaces stay, and one goes before the text: then a part is encoded alone as it is in its text
        plain = [self.model.encode(t, out_type=str) for t in ("x", " x", "x  x", " ", "x ", "ﬁ 　")]
        self.splits = not crossing and plain == [
            [MARK + "x"], self._of("  x"), self._of(" x") + self._of("  x"), self._of("  "), self._of(" x") + self._of(" "), self._of(" ﬁ 　")
        ]
        # a part: marks, then other characters; the library puts the first mark there itself
        self.parts = re.compile(f"{MARK}({MARK}*[^{MARK}]*)").findall
        self.remember, self.known = remember, {}

    def _of(self, part: str) -> list[str]:
        """The pieces of a part that starts with a space, which the library adds; a lone space has no text to add it to."""
        return self.model.encode(part[1:], out_type=str) if len(part) > 1 else [MARK]

    def counts(self, texts: list[str]) -> np.ndarray:
        if not self.splits:
            return np.array([len(x) for x in self.model.encode(texts, num_threads=1)], np.int64)
        if len(self.known) > self.remember:
            self.known = {}
        parts = [self.parts(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        flat = [p for row in parts for p in row]
        if fresh := list(set(flat).difference(self.known)):
            self.known.update(zip(fresh, [len(x) if p else 1 for p, x in zip(fresh, self.model.encode(fresh, num_threads=1))]))
        upto = np.r_[0, np.cumsum(np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat)))]
        return np.diff(upto[np.r_[0, np.cumsum([len(row) for row in parts], dtype=np.int64)]])


def counter(model: str) -> Counter:
    if model not in _LOADED:
        _LOADED[model] = Counter(tokenizer_path(model))
    return _LOADED[model]


def counted(docs: DataFrame, model: str = MODEL, limit: int = LIMIT, piece: int = 1 << 20) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every whole text."""

    small_batches(docs.sparkSession)

    def run(batches):
        c = counter(model)
        for batch in batches:
            for part in slices(batch, "text", piece):
                n = c.counts([t or "" for t in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"]).append_column(
                    "n_bytes", pc.binary_length(part.column("text")).cast(pa.int64()).fill_null(0)
                )

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(tidy(run), "doc_id long, n_tokens long, n_bytes long").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
