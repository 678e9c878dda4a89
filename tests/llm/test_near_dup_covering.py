import itertools
import unicodedata

import numpy as np

from lectern.llm.near_dup_covering import CoveringSketch, cover, near_duplicates, reduce_text, reduced, similarities
from lectern.llm.queries import _recurring, p3_found

SCHEMA = "tbl string, id bigint, text string, rep_a string, at string, bits string"
LONG = "The quick brown fox jumps over the lazy dog while seventeen zebras quietly watch the moon rise above the old harbour wall. "


def test_cover_holds_every_pair_within_the_radius():
    for n, radius in ((6, 1), (7, 2), (9, 2)):
        masks = cover(n, radius)
        for differing in itertools.combinations(range(n), radius):
            assert any(not mask[list(differing)].any() for mask in masks)


def test_sketch_of_one_text_is_the_same_alone_and_among_others():
    s = CoveringSketch(4, 9, 6, 1)
    texts = [reduce_text(LONG), "a" * 100, reduce_text(LONG[::-1])]
    alone = np.concatenate([s.minima(*s.grams(*reduced([t]))) for t in texts])
    assert (s.minima(*s.grams(*reduced(texts))) == alone).all()


def test_reduction_is_that_of_whole_strings():
    texts = ["Straße ΟΔΟΣ, ΣΑΣ!", "", "İstanbul 12 ½ ²", "一二 \u200b三ＡＢ", "𝐀𝒃 _x_", "\0\uffff"]
    whole = ["".join(c for c in t.lower() if unicodedata.category(c)[0] in "LN") for t in texts]
    assert [reduce_text(t) for t in texts] == whole
    points, ends = reduced(texts)
    assert ["".join(map(chr, points[a:b])) for a, b in itertools.pairwise(ends)] == whole


def test_similarities_are_those_of_the_sets():
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("abcd"), n)) for n in (80, 90, 200, 300, 80)]
    texts += [texts[2][:150] + texts[3][:60], texts[3], "x" * 500, "xyxyxyxyxy" * 20]
    a, b = np.array(list(itertools.product(range(len(texts)), repeat=2))).T
    sets = [{t[i : i + 4] for i in range(len(t) - 3)} for t in texts]
    want = [len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i, j in zip(a, b, strict=True)]
    assert np.allclose(similarities(texts, a, b, 4, 0.7), want)


def rows():
    edited = LONG.replace("zebras", "zebra").replace("old ", "")
    out = [("q", 1, LONG), ("q", 1, LONG), ("q", 2, edited), ("q", 3, LONG.upper() + "!"), ("c", 4, LONG), ("q", 5, "short"), ("q", 6, None), ("q", None, LONG), ("q", 7, ""), ("q", 8, LONG[60:] + LONG[:60]), ("q", 9, "x" * 30_000), ("q", 10, "unlike anything else " * 9)]
    return [(*r, "x", "y", "z") for r in out]


def test_pairs_and_records(spark):
    found = near_duplicates(spark.createDataFrame(rows(), SCHEMA))
    pairs = sorted((r["tbl"], r["id_a"], r["id_b"]) for r in found.pairs().collect())
    assert pairs == [("q", 1, 2), ("q", 1, 3), ("q", 1, 8), ("q", 2, 3), ("q", 2, 8), ("q", 3, 8)]
    records = {(r["tbl"], r["id"]): (r["class_id"], r["copies"], r["links"]) for r in found.records().collect()}
    assert records["q", 1] == records["q", 3] == (1, 2, 2) and records["c", 4] == (4, 1, 0) and ("q", 6) not in records


def test_crowded_buckets_give_the_same_pairs(spark):
    edits = [LONG.replace("fox", f"fox{k}") for k in range(30)]
    df = spark.createDataFrame([("q", k, t) for k, t in enumerate(edits)] + [("c", k, t) for k, t in enumerate(edits)], "tbl string, id bigint, text string")
    pairs = [sorted(map(tuple, near_duplicates(df, bucket_rows=n).pairs().collect())) for n in (4_000, 3, 1)]
    assert pairs[0] == pairs[1] == pairs[2] and len(pairs[0]) == 2 * 30 * 29 // 2


def test_filter_of_sketches_can_be_switched_off(spark):
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(400)]
    texts = [" ".join(rng.permutation(words[20 * (k // 8) : 20 * (k // 8) + 40])) for k in range(64)]
    df = spark.createDataFrame([("q", k, t) for k, t in enumerate(texts)], "tbl string, id bigint, text string")
    every = set(map(tuple, near_duplicates(df, similarity=0.25, apart=54).pairs().collect()))
    assert every >= set(map(tuple, near_duplicates(df, similarity=0.25, apart=28).pairs().collect())) and len(every) > 100


def test_empty(spark):
    found = near_duplicates(spark.createDataFrame([], SCHEMA))
    assert found.pairs().count() == 0 and found.records().count() == 0


def test_against_brute_force(spark, tiny):
    got = {(r["tbl"], r["id_a"], r["id_b"]) for r in p3_found(spark, tiny).collect()}
    members = _recurring(spark, tiny).members.collect()
    texts = {("answered_questions", r["qa_id"]): r["question"] for r in spark.read.parquet(f"{tiny}/answered_questions.parquet").collect()}
    texts |= {("refined_document_chunks", r["chunk_id"]): r["content"] for r in spark.read.parquet(f"{tiny}/refined_document_chunks.parquet").collect()}
    sets = {}
    for (tbl, i), t in texts.items():
        t = reduce_text(t or "")
        if len(t) >= 80:
            sets[tbl, i] = {t[j : j + 4] for j in range(len(t) - 3)}
    true = {(a[0], min(a[1], b[1]), max(a[1], b[1])) for a, b in itertools.combinations(sets, 2) if a[0] == b[0] and len(sets[a] & sets[b]) >= 0.7 * len(sets[a] | sets[b])}
    assert {(m["tbl"], m["id"]) for m in members} == set(sets)
    assert got <= true and len(got) >= 0.98 * len(true)
