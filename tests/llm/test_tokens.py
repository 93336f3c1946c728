"""Tokenizers against the libraries, and the pipeline as a whole."""

import base64
import hashlib
import random
from collections import Counter

import public_tokenizers as P
import sentencepiece
import tiktoken

from sedimark.llm import bpe_codec, token_counts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_tokens string"


def texts():
    r = random.Random(1)
    odd = " ▁ab\n\té日ﬁ\x00<s> 　.,'1²\U0001f600"
    return [
        None, "", " ", "  \n ", "it's I'LL we'd 'stuff ''s", "<|endoftext|> <s></s><unk> <0x0A>", "a" * 5000, "ab" * 900, " " * 400 + "x", "x" * 129,
        "".join(r.choice("etaoinshr") for _ in range(5000)), "word — dash ’s", "the cat " * 40_000, "the cat " * 40_000,
        *("".join(r.choice(odd) for _ in range(r.randint(0, 30))) for _ in range(400)),
    ]


def frame(spark, rows):
    return spark.createDataFrame([(k if k % 7 else None, t, "en", "s", 1, "x") for k, t in enumerate(rows)], SCHEMA)


def test_bpe_codec(spark):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = bpe_codec.encoded(frame(spark, texts())).collect()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = Counter()
    for k, t in enumerate(texts()):
        ids = library.encode_ordinary(t or "")
        want[k if k % 7 else None, len(ids), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode()), tuple(ids)] += 1
    assert Counter((x.doc_id, x.n_tokens, x.ids_sha256, x.decoded_sha256, tuple(x.token_ids)) for x in got) == want
    assert bpe_codec.encoded(frame(spark, [])).count() == 0


def test_long_rows_equal_short_rule():
    codec = bpe_codec.codec(bpe_codec.RANKS, None)
    r = random.Random(2)
    for _ in range(60):
        raw = "".join(r.choice("abcaabth er") for _ in range(r.randint(2, 120))).replace(" ", "").encode() or b"a"
        import numpy as np

        ids = codec.byte[np.frombuffer(raw, np.uint8)]
        assert codec._long(ids).tolist() == codec._matrix(ids[None, :].copy())[0].tolist()


def test_very_long_match():
    """An unbroken run of letters takes n log n steps, and gives the library's ids."""
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(4)
    text = "".join(r.choice("etaoinshr") for _ in range(150_000))
    ids, _ = bpe_codec.codec(bpe_codec.RANKS, None).encode([text])
    assert ids.tolist() == library.encode_ordinary(text)


def test_token_counts(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    got = token_counts.counted(frame(spark, texts())).collect()
    want = Counter()
    for k, t in enumerate(texts()):
        n = len(model.encode(t or ""))
        want[k if k % 7 else None, len((t or "").encode()), n, n > 4096] += 1
    assert Counter(tuple(x) for x in got) == want
    assert token_counts.counter(token_counts.MODEL).splits
    assert token_counts.counted(frame(spark, [])).count() == 0


def test_whole_texts_where_splitting_isnt_safe():
    c = token_counts.Counter(P.path("piece_bpe_32k.model"))
    c.splits = False
    assert c.counts(["a  b", ""]).tolist() == [3, 0]


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(3)
    words = [f"w{k}" for k in range(500)]
    docs = []
    for k in range(120):
        docs.append((k, " ".join(r.choice(words) for _ in range(r.randint(60, 120))), "en", f"s{k % 4}", 0))
    docs += [(200, docs[0][1], "en", "s0", 0), (201, "short", "en", "s1", 0), (202, docs[1][1] + " password=abcdef123456", "en", "s2", 0), (None, None, None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, schema).write.parquet(str(tmp_path / "documents.parquet"))
    at = spark.read.parquet(str(tmp_path / "documents.parquet"))
    first = at.columns
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        at = corpus_pipeline.written(stage(spark, at, str(tmp_path)))
        seen.append((name, {x.doc_id for x in at.select("doc_id").collect()}))
        assert name == "BPE encoding" or at.columns == first
    assert 201 not in seen[0][1] and 0 in seen[0][1]
    assert 200 in seen[0][1] and 200 not in seen[1][1] and seen[1][1] == seen[2][1]
    assert set(range(2, 120)) <= seen[1][1]
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert Counter(tuple(map(str, x)) for x in whole.collect()) == Counter(tuple(map(str, x)) for x in at.collect())
    assert whole.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "token_ids"]


def test_pipeline_odd_rows(spark, tmp_path):
    """Empty table, nulls, repeated rows, a very long text, and columns with names that stages might use."""
    import corpus_pipeline

    r = random.Random(5)
    some = lambda n: " ".join(f"w{r.randint(0, 900)}" for _ in range(n))
    same = some(80)
    rows = [(1, same, "en", "a", 5), (1, same, "en", "a", 5), (1, some(90), "en", None, None), (2, some(60_000), None, "b", 0), (3, None, "en", "a", 0), (4, "", "en", "a", 0), (None, some(70), "en", "b", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, of map<string, int>, `key` string, removed string, n int, h string, component_id string, __id string"
    full = spark.createDataFrame([(*x, {"a": 1}, "k", "r", 7, "h", "c", "i") for x in rows], schema)
    for docs in (full, full.limit(0)):
        at = docs
        for name, stage in corpus_pipeline.STAGES[:-1]:
            at = corpus_pipeline.written(stage(spark, at, str(tmp_path)))
            assert at.columns == docs.columns, name
            if name == "SimHash near-dedup" and docs is full:
                kept = [(x.doc_id, len(x.text.split()), x.of, x["key"], x["__id"]) for x in at.collect()]
                assert sorted(kept, key=str) == sorted([(i, n, {"a": 1}, "k", "i") for i, n in ((1, 80), (1, 90), (2, 60_000), (None, 70))], key=str)
        assert corpus_pipeline.encoding(spark, at, str(tmp_path)).count() >= (1 if docs is full else 0)
