import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm.common import code_points
from lectern.llm.fm_index import FmIndex, WaveletMatrix
from lectern.llm.queries import p8_found
from lectern.llm.shared_spans import anchors_of, shared_shares, shared_spans

SCHEMA = "doc_id bigint, text string, fp string, doc string, t string"


def brute(docs, least):
    where = {}
    for d, t in docs:
        for i in range(len(t) - least + 1):
            where.setdefault(t[i : i + least], set()).add(d)
    out = set()
    for d, t in docs:
        run = None
        for i in range(len(t) - least + 1):
            if len(where[t[i : i + least]]) > 1:
                if run and i <= run[1]:
                    run[1] = i + least
                else:
                    if run:
                        out.add((d, run[0], run[1] - run[0]))
                    run = [i, i + least]
        if run:
            out.add((d, run[0], run[1] - run[0]))
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.text("ab中", min_size=1, max_size=25), st.integers(0, 3), st.booleans()), min_size=1, max_size=6))
def test_matching_statistics(strings):
    points, ends = code_points([s for s, _, _ in strings])
    index = FmIndex(points, ends, np.array([k for _, k, _ in strings]), np.array([m for _, _, m in strings]))
    got = index.matching_statistics(np.arange(len(strings)), np.diff(ends), 0)
    # a string of several labels matches all others, and itself
    expected = [
        max((m for m in range(len(s) - i + 1) if m and any(s[i : i + m] in t for t, other, several in strings if other != k or several)), default=0)
        for s, k, _ in strings for i in range(len(s))]
    assert got.tolist() == expected


def test_wavelet_ranks():
    x = np.random.default_rng(0).integers(0, 37, 500)
    w = WaveletMatrix(x, 37)
    at = np.arange(501)
    for s in (0, 5, 36):
        assert (w.rank(np.full(501, s), at) == np.concatenate(([0], np.cumsum(x == s)))).all()


def test_equal_windows_have_equal_anchors():
    rng = random.Random(5)
    span = "".join(rng.choice("abcd") for _ in range(300))
    a, b = "x" * 77 + span, "".join(rng.choice("abcd") for _ in range(131)) + span + "yy"
    fa, fb = (set(anchors_of(*code_points([t]), 200, 64)[0].tolist()) for t in (a, b))
    assert fa & fb


def documents():
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abcdefgh 中文字") for _ in range(n))
    shared, other = word(260), word(500)
    docs = [(1, word(100) + shared + word(50)), (2, shared), (3, word(300) + shared[:230] + word(100) + other), (4, other + other), (5, other), (6, word(90)), (7, word(400)), (8, other[10:] + "z")]
    twice = word(220)
    return docs + [(9, twice + word(5) + twice)]


def check(spark, docs, **options):
    extra = [(d, t, "x", "y", "z") for d, t in docs] + [(d, t, "x", "y", "z") for d, t in docs[:2]] + [(50, None, None, None, None), (51, "", "x", "y", "z"), (None, docs[0][1], "x", "y", "z")]
    df = spark.createDataFrame(extra, SCHEMA)
    spans = shared_spans(df, **options)
    assert {(r["doc_id"], r["span_start"], r["span_len"]) for r in spans.collect()} == brute(docs, 200)
    return df, spans


def test_spans_and_shares(spark):
    df, spans = check(spark, documents())
    shares = {r["doc_id"]: (r["shared_chars"], r["share"]) for r in shared_shares(df, spans).collect()}
    assert shares[2] == (260, 1.0) and shares[6] == (0, 0.0) and shares[50] == (0, 0.0) and shares[9] == (0, 0.0)


def test_hot_anchors_take_the_exact_way(spark):
    check(spark, documents(), hot_regions=1, shard_chars=500)


def test_windows_by_hash_are_those_of_the_index(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    index, hashes = ({tuple(r) for r in shared_spans(docs, hot_regions=n).collect()} for n in (1 << 30, 0))
    assert index == hashes and index


def test_halves_keep_every_shared_window():
    rng = random.Random(8)
    for k in range(40):
        span = "".join(rng.choice("abcd") for _ in range(40))
        texts = ["".join(rng.choice("abcd") for _ in range(rng.randrange(30))) + span + "".join(rng.choice("abcd") for _ in range(rng.randrange(30))) for _ in range(2)]
        halves = [{x for column in anchors_of(*code_points([t]), 40, 4 + k % 9)[4:] for x in column.tolist() if x} for t in texts]
        assert halves[0] & halves[1]


def test_empty(spark):
    assert shared_spans(spark.createDataFrame([], SCHEMA)).count() == 0


def test_tables(spark, tiny):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{tiny}/documents.parquet").where("text is not null").collect()]
    assert {tuple(r) for r in p8_found(spark, tiny).collect()} == brute(docs, 200)
