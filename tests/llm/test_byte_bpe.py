import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from tessella.llm import byte_bpe

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def truth():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    r = random.Random(4)
    words = ["the", " ", "  ", "\n", "don't", "été", "12345", "日本語", "###", "<|endoftext|>", "x" * 50, "\t\n ", "'ll", "🙂"]
    out = [None, "", " ", "a", "a  b", "<|endoftext|>", " \n "]
    out += ["".join(r.choice(words) for _ in range(n)) for n in (5, 300, 12_000, 40_000)]
    out += ["a" * 6_000 + " b", "word " * 20_000, " " * 70_000 + "x", "y" * 40_000 + " tail " + "z" * 5_000]
    out += ["k" * 32_767 + "  q" + " w" * 3_000, "ab'" * 15_000]
    return out


def test_ids_and_digests_equal_the_library(spark, truth):
    rows = [(i % 9, t, "ids") for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    want = sorted((i, truth.encode_ordinary(t or "")) for i, t, _ in rows)
    got = byte_bpe.encode(docs, RANKS, PATTERN).collect()
    assert sorted((x.doc_id, list(x.ids)) for x in got) == want
    assert sorted((x.doc_id, bytes(x.decoded)) for x in got) == sorted((i, (t or "").encode()) for i, t, _ in rows)
    seen = byte_bpe.encode(docs, RANKS, PATTERN, digests=True).collect()
    assert sorted((x.doc_id, x.n_tokens, x.ids_sha256) for x in seen) == sorted((i, len(k), hashlib.sha256(" ".join(map(str, k)).encode()).hexdigest()) for i, k in want)


def test_null_ids_and_clashing_columns(spark, truth):
    long = "word " * 9_000
    docs = spark.createDataFrame([(None, "a b", 1, "x"), (None, long, 2, "y"), (None, None, 3, "z")], "doc_id long, text string, row_id int, chunk string")
    got = byte_bpe.encode(docs, RANKS, PATTERN).collect()
    assert [x.doc_id for x in got] == [None] * 3
    assert sorted(list(x.ids) for x in got) == sorted(truth.encode_ordinary(t) for t in ("a b", long, ""))


def test_chunks_without_common_boundary_are_joined(truth):
    c = byte_bpe.codec(RANKS, PATTERN)
    text = "start " + "a" * 90 + " mid " + "7" * 200 + " end of it"
    for size, lap in ((20, 8), (50, 5), (64, 30)):
        chunks = [c.pieces(text[k : k + size + lap], k) for k in range(0, len(text) - lap, size)]
        assert byte_bpe.stitch(c, chunks).tolist() == truth.encode_ordinary(text)


def test_empty_table(spark):
    assert byte_bpe.encode(spark.createDataFrame([], "doc_id long, text string"), RANKS, PATTERN).count() == 0
