"""From raw documents to training tokens, in five stages of the operators in sedimark.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next stage's
docs. All but the last return the columns of documents; the last has (doc_id, n_tokens, ids_sha256, decoded_sha256, token_ids), a row
for each document of the mix as often as it is taken.

Defined results: a null text counts as empty and goes at the quality rules; rows with a null doc_id pass near-dedup as they are; a null source is one of its
own; of rows that repeat an id and text near-dedup keeps one, while another text under the same id is a document of its own; ties go to the
lesser id; very long texts are processed whole; an empty table gives no rows. Columns beyond those of documents, of any name or type, are carried on by all
stages but the last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sedimark.llm import bpe_codec, quality_lines, secret_crf, simhash_trie, source_mixing
from sedimark.llm.common import documents, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; template lines go from the others."""
    return quality_lines.cleaned(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return simhash_trie.one_of_each_group(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by a mark."""
    return secret_crf.redacted(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay as often as the mix takes them."""
    return source_mixing.taken(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and digests of them and of the text decoded from them."""
    return bpe_codec.encoded(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("SimHash near-dedup", near_dedup),
    ("secret scans", secrets),
    ("mixing sources", mixing),
    ("BPE encoding", encoding),
]

#: SimHash votes, a trained field and a byte-level tokenizer are not SQL; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
