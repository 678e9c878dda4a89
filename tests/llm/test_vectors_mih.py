import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm.queries import p1_found
from lectern.llm.vectors_mih import Cells, flip_masks, nearest_vectors, neighbour_pairs

SCHEMA = "chunk_id bigint, embedding array<float>, rep string, cell string"


def brute(ids, x, k=5, radius=0.4):
    out = {}
    for i, a in zip(ids, x, strict=True):
        d = np.round(((x.astype(np.float64) - a.astype(np.float64)) ** 2).sum(1), 6)
        out[i] = [b for _, b in sorted((dist, b) for dist, b in zip(d, ids, strict=True) if dist <= radius and b != i)[:k]]
    return out


def test_small_cases(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=96)
    base /= np.linalg.norm(base)
    rows = [(i, (base + 0.02 * i * rng.normal(size=96) / 10).astype(float).tolist(), "x", "y") for i in range(1, 6)]
    rows += [(10 + i, base.tolist(), "x", "y") for i in range(7)]  # equal vectors
    rows += [(10, base.tolist(), "x", "y"), (20, None, None, None), (21, [0.0] * 96, "x", "y"), (22, [1.0] * 5, "x", "y"), (23, [None] * 96, "x", "y"), (24, [float("nan")] * 96, "x", "y"), (None, base.tolist(), "x", "y")]
    got = nearest_vectors(spark.createDataFrame(rows, SCHEMA)).collect()
    found = {}
    for r in sorted(got, key=lambda r: (r["chunk_id"], r["rank"])):
        found.setdefault(r["chunk_id"], []).append(r["neighbour"])
    good = {r[0]: r[1] for r in rows if r[0] is not None and r[1] and len(r[1]) == 96 and None not in r[1] and any(r[1]) and r[1][0] == r[1][0]}
    assert found == {k: v for k, v in brute(list(good), np.array(list(good.values()), np.float32)).items() if v}
    assert found[16] == [10, 11, 12, 13, 14] and found[10] == [11, 12, 13, 14, 15]


def test_empty(spark):
    out = nearest_vectors(spark.createDataFrame([], SCHEMA))
    assert out.columns == ["chunk_id", "neighbour", "dist", "rank"] and out.count() == 0
    assert neighbour_pairs(out).count() == 0


def test_masks():
    assert len(flip_masks(16, 2)) == 1 + 16 + 120


def test_recall_on_tables(spark, tiny):
    tiny = tiny.replace("sf0.001", "sf0.01")
    rows = spark.read.parquet(f"{tiny}/chunk_vectors.parquet").where((F.size("embedding") == 96) & F.exists("embedding", lambda x: x != 0)).dropDuplicates(["chunk_id"]).collect()
    ids, x = [r["chunk_id"] for r in rows], np.array([r["embedding"] for r in rows], np.float32)
    true = {(min(a, b), max(a, b)) for a, bs in brute(ids, x).items() for b in bs}
    got = {(r["chunk_a"], r["chunk_b"]) for r in p1_found(spark, tiny).collect()}
    assert len(got & true) >= 0.95 * len(true) and len(got - true) <= 0.01 * len(got)
    assert got and pytest.approx(1, abs=0.06) == len(got) / len(true)


@pytest.mark.parametrize(("options", "least"), [({"cell_rows": 100}, 0.95), ({"cell_rows": 60, "flat_cells": 4}, 0.95), ({"cell_rows": 200, "flat_cells": 2, "margin": 0.316, "flips": 4}, 1.0)])
def test_recall_with_many_cells(spark, tiny, options, least):
    tiny = tiny.replace("sf0.001", "sf0.01")
    rows = spark.read.parquet(f"{tiny}/chunk_vectors.parquet").where((F.size("embedding") == 96) & F.exists("embedding", lambda x: x != 0)).dropDuplicates(["chunk_id"]).collect()
    ids, x = [r["chunk_id"] for r in rows], np.array([r["embedding"] for r in rows], np.float32)
    true = {(min(a, b), max(a, b)) for a, bs in brute(ids, x).items() for b in bs}
    got = {(r["chunk_a"], r["chunk_b"]) for r in neighbour_pairs(nearest_vectors(spark.read.parquet(f"{tiny}/chunk_vectors.parquet"), **options)).collect()}
    assert len(got & true) >= least * len(true)


def test_cells_of_two_levels_meet_near_pairs():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 8)).astype(np.float32)
    cells = Cells.learn(x, 30, 4)
    row, cell, own = cells.visited(x, 0.5)
    assert len(cells.levels) == 2 and set(row[own]) == set(range(len(x)))
    homes = {(r, c) for r, c in zip(row[own], cell[own], strict=True)}
    every = [set(cell[row == i]) for i in range(len(x))]
    d = ((x[:, None] - x) ** 2).sum(2)
    for i, j in np.argwhere((d < 1.0) & (d > 0)):
        assert any((i, c) in homes or (j, c) in homes for c in every[i] & every[j])


def test_many_centroids_take_little_memory():
    rng = np.random.default_rng(4)
    cells = Cells([rng.normal(size=(5_000, 96)).astype(np.float32)])
    x = rng.normal(size=(4_000, 96)).astype(np.float32)
    tracemalloc.start()
    row, cell, own = cells.visited(x, 0.01)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 300e6 and own.sum() == len(x)
    d = (cells.levels[0] ** 2).sum(1) - 2 * x[:50] @ cells.levels[0].T
    assert (cell[own][:50] == d.argmin(1)).all()
    assert len(Cells.learn(x, 1_000_000, 256).levels[0]) == 1_000
