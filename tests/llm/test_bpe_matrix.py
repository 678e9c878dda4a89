import base64

import pytest
from hypothesis import given
from hypothesis import strategies as st

from lectern.llm.bpe_matrix import TOKENIZERS, WORDS, MatrixBpe, encode_column, read_ranks, token_counts
from lectern.llm.queries import p6_ids

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def both():
    raw = read_ranks()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
    return MatrixBpe(raw), tiktoken.Encoding("own", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})


CASES = ["", "a", "  a  b\n\n c", "<|endoftext|>", "x" * 5000, "ab" * 3000, "é" * 700, "中" * 900, "𝔸𝔹" * 50, "x² ½ Ⅳa\x1c b\x85 　x", "don't we'll I'M", "​zero‍width", " \r\n\t "]


def test_cases(both):
    ours, theirs = both
    assert [a.tolist() for a in ours.encode(CASES)] == [theirs.encode_ordinary(c) for c in CASES]
    assert [a.tolist() for a in ours.encode([None, ""])] == [[], []]


@given(st.lists(st.text(max_size=60), max_size=8))
def test_any_text(both, texts):
    ours, theirs = both
    texts = [t.encode("utf-8", "replace").decode() for t in texts]
    assert [a.tolist() for a in ours.encode(texts)] == [theirs.encode_ordinary(t) for t in texts]


def test_rows(spark, both):
    rows = [(1, "hash table", [9], "x"), (1, "hash table", [9], "x"), (2, None, None, None), (3, "", [1], "x"), (None, "a", [1], "x"), (4, "word " * 200_000, [1], "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids array<int>, n_tokens string")
    got = [(r["doc_id"], r["ids"]) for r in encode_column(df).collect()]
    assert len(got) == 6 and (2, []) in got and (3, []) in got and got.count((1, both[1].encode_ordinary("hash table"))) == 2
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts(df, tokenizers=TOKENIZERS).collect()}[4] == 200_001
    assert encode_column(df.where("doc_id > 99")).count() == 0


def test_query(spark, tiny, both):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    got = {r["doc_id"]: r["ids"] for r in p6_ids(spark, tiny).collect()}
    assert got == {k: both[1].encode_ordinary(t or "") for k, t in texts.items()}
