"""The nearest vectors of every vector, by multi-index hashing of learned rotated binary codes.

On the driver a bounded sample fixes a rotation (iterative quantisation) and centroids of one or two levels of cells.
Each distinct vector goes to the cell of its nearest centroid and visits the other cells whose border is near. In a
cell the codes are split into substrings, each with its own index: by the pigeonhole principle, two codes within
``substrings * (flips + 1) - 1`` bits of each other have a substring with at most ``flips`` differing bits, and all
such substrings are probed. Candidates are then compared by their exact distance in double precision.

Equal vectors are one class: only classes are searched, and members get their neighbours from their class, so
copies cost nothing but rows of the result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.llm.common import cut_lineage, ranges

PAIRS_AT_ONCE = 2_000_000
AT_ONCE = 2_000_000


def usable(vector: Column, dim: int) -> Column:
    """Whether a vector has ``dim`` finite numbers that aren't all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) == dim) & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def learn_rotation(sample: np.ndarray, rounds: int = 30, seed: int = 7) -> np.ndarray:
    """The rotation that brings the signs of the rotated sample near to the sample (iterative quantisation).

    The sample isn't centred: angles are seen from the origin, so that near vectors have near codes also where the
    whole collection is close together.
    """
    x = sample.astype(np.float64)
    # whole-width principal axes: no direction is dropped, the rotation only spreads the variance over the bits
    _, axes = np.linalg.eigh(x.T @ x)
    projected = x @ axes
    turn, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(x.shape[1], x.shape[1])))
    for _ in range(rounds):
        signs = np.where(projected @ turn >= 0, 1.0, -1.0)
        u, _, v = np.linalg.svd(projected.T @ signs)
        turn = u @ v
    return (axes @ turn).astype(np.float32)


def nearest_centre(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """The nearest centroid of each vector, by blocks of ``AT_ONCE`` distances."""
    own = (centre**2).sum(1)
    rows = max(1, AT_ONCE // len(centre))
    return np.concatenate([(own - 2 * x[i : i + rows] @ centre.T).argmin(1) for i in range(0, len(x), rows)])


def learn_centres(sample: np.ndarray, cells: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Centroids of the sample (k-means from sample points)."""
    cells = max(1, min(cells, len(sample)))
    centre = sample[np.random.default_rng(seed).choice(len(sample), cells, replace=False)].astype(np.float32)
    for _ in range(rounds if cells > 1 else 1):
        near = nearest_centre(sample, centre)
        order = np.argsort(near, kind="stable")
        some, first, count = np.unique(near[order], return_index=True, return_counts=True)
        centre[some] = np.add.reduceat(sample[order].astype(np.float64), first) / count[:, None]
    return centre


class Cells:
    """A quantiser of one level, or of two: the cells of the first are parted by centroids of what is left of a vector
    after the first level's centroid is taken off, the same in all cells. So the square root of the number of cells is
    all that has to be learned, sent and compared."""

    def __init__(self, levels: list[np.ndarray]) -> None:
        self.levels = levels

    @classmethod
    def learn(cls, sample: np.ndarray, cells: int, flat: int) -> Cells:
        """About ``cells`` cells; on one level up to ``flat``."""
        if cells <= flat:
            return cls([learn_centres(sample, cells)])
        first = learn_centres(sample, math.ceil(math.sqrt(cells)))
        rest = sample - first[nearest_centre(sample, first)]
        return cls([first, learn_centres(rest, math.ceil(cells / len(first)), seed=8)])

    @property
    def count(self) -> int:
        return math.prod(map(len, self.levels))

    def visited(self, x: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``row, cell, own``: the cells of each vector; ``own`` marks the one it is nearest to on the last level.

        On each level a vector also visits the cells whose border is within ``margin``. Two vectors that a border parts
        are met if one is within half of their distance of it, as one always is.
        """
        row, cell, own = np.arange(len(x)), np.zeros(len(x), np.int64), np.ones(len(x), bool)
        for centre in self.levels:
            parts = [near_cells(x[i : i + n], centre, margin) for n in [max(1, AT_ONCE // len(centre))] for i in range(0, len(x), n)]
            starts = np.cumsum([0] + [p[0][-1] + 1 for p in parts[:-1]]) if parts else []
            at = np.concatenate([p[0] + s for p, s in zip(parts, starts, strict=True)]) if parts else row
            which, own = (np.concatenate([p[k] for p in parts]) if parts else row for k in (1, 2))
            row, cell, x = row[at], cell[at] * len(centre) + which, x[at] - centre[which]
        return row, cell, own.astype(bool)


def near_cells(x: np.ndarray, centre: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``row, cell, own`` of one level for a block of vectors, rows in order."""
    size = (centre**2).sum(1)
    d = size - 2 * x @ centre.T  # less the vector's own length, which is the same for all
    home = d.argmin(1)
    every = np.arange(len(x))
    least = d[every, home][:, None]
    apart = np.maximum(size[home][:, None] + size - 2 * centre[home] @ centre.T, 1e-12)
    near = (d - least) <= 2 * margin * np.sqrt(apart)
    near[every, home] = True
    row, cell = np.nonzero(near)
    return row, cell, cell == home[row]


def flip_masks(bits: int, flips: int) -> np.ndarray:
    """All bit masks with at most ``flips`` of ``bits`` bits set."""
    return np.array([sum(1 << b for b in c) for k in range(flips + 1) for c in combinations(range(bits), k)], np.int64)


def search_cell(
    x: np.ndarray, keys: np.ndarray, home: np.ndarray, rotation: np.ndarray, k: int, radius: float, substrings: int, flips: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Directed candidate pairs (position, position, squared distance) of one cell: the best ``k`` of every vector.

    ``home`` marks the vectors of the cell itself; pairs of two visitors are left to other cells.
    """
    n, dim = x.shape
    signs = x @ rotation >= 0
    edges = np.linspace(0, dim, substrings + 1).astype(int)
    parts = [signs[:, a:b] @ (1 << np.arange(b - a, dtype=np.int64)) for a, b in zip(edges, edges[1:], strict=False)]
    words = np.packbits(np.pad(signs, ((0, 0), (0, -dim % 64))), axis=1).view(np.uint64)
    # a pair at the radius differs in this share of the bits; three deviations more are let through to the floats
    share = math.acos(max(-1.0, 1 - radius / 2)) / math.pi
    most = dim * share + 3 * math.sqrt(dim * share * (1 - share))
    inner = np.flatnonzero(home)
    best: list[np.ndarray] = []
    held = 0

    def prune() -> np.ndarray:
        rows = np.concatenate(best) if best else np.zeros(0, [("a", np.int64), ("b", np.int64), ("d", np.float64)])
        order = np.lexsort((keys[rows["b"]], rows["d"], rows["a"]))
        rows = rows[order]
        start = np.flatnonzero(np.r_[True, rows["a"][1:] != rows["a"][:-1]]) if len(rows) else np.zeros(0, np.int64)
        rank = np.arange(len(rows)) - np.repeat(start, np.diff(np.r_[start, len(rows)]))
        return rows[rank < k]

    for j, part in enumerate(parts):
        bits = edges[j + 1] - edges[j]
        order = inner[np.argsort(part[inner], kind="stable")]
        values, first, count = np.unique(part[order], return_index=True, return_counts=True)
        for mask in flip_masks(int(bits), flips):
            at = np.searchsorted(values, part ^ mask)
            at[at == len(values)] = 0
            size = np.where(values[at] == part ^ mask, count[at], 0) if len(values) else np.zeros(n, np.int64)
            asks = np.flatnonzero(size)
            total = np.cumsum(size[asks])
            done = 0
            while done < len(asks):
                to = max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + PAIRS_AT_ONCE, "right")))
                own = asks[done:to]
                done = to
                b = order[ranges(first[at[own]], size[own])]
                a = np.repeat(own, size[own])
                keep = (a < b) | ~home[a]
                a, b = a[keep], b[keep]
                keep = sum(np.bitwise_count(words[a, w] ^ words[b, w]).astype(np.int16) for w in range(words.shape[1])) <= most
                a, b = a[keep], b[keep]
                for earlier in parts[:j]:  # each pair once: in the first substring that finds it
                    keep = np.bitwise_count((earlier[a] ^ earlier[b]).view(np.uint64)) > flips
                    a, b = a[keep], b[keep]
                for s in range(0, len(a), 200_000):
                    p, q = a[s : s + 200_000], b[s : s + 200_000]
                    near = np.einsum("ij,ij->i", g := x[p] - x[q], g) <= radius + 1e-3
                    p, q = p[near], q[near]
                    d = np.round(((x[p].astype(np.float64) - x[q].astype(np.float64)) ** 2).sum(1), 6)
                    p, q, d = p[d <= radius], q[d <= radius], d[d <= radius]
                    rows = np.zeros(2 * len(p), [("a", np.int64), ("b", np.int64), ("d", np.float64)])
                    rows["a"], rows["b"], rows["d"] = np.r_[p, q], np.r_[q, p], np.r_[d, d]
                    best.append(rows)
                    held += len(rows)
                if held > PAIRS_AT_ONCE:
                    best = [prune()]
                    held = 0
    rows = prune()
    return rows["a"], rows["b"], rows["d"]


def nearest_vectors(
    df: DataFrame, key: str = "chunk_id", vector: str = "embedding", k: int = 5, radius: float = 0.4, dim: int = 96,
    substrings: int = 6, flips: int = 2, margin: float = 0.07, sample_rows: int = 20_000, cell_rows: int = 8_000, flat_cells: int = 256,
) -> DataFrame:
    """``key``, ``neighbour``, ``dist`` and ``rank``: for every key its ``k`` nearest other keys within squared
    distance ``radius``, by (distance rounded to 6 decimals, key).

    Vectors that are null, of another length, all zero or not finite take no part; neither do null keys. A row
    delivered again counts once. A key without a neighbour has no row; an empty table gives an empty result. Columns
    other than the two are not read. The rotation and the centroids are fitted on at most ``2 * sample_rows``
    distinct vectors; every vector is indexed and searched. Beyond ``flat_cells`` cells of ``cell_rows`` vectors there are
    two levels of cells. The result is approximate: recall is measured in the tests (at least 0.9). With ``margin`` at half
    of the radius' root (0.316 for 0.4) no pair is parted by cells, and with four ``flips`` no two codes of up to 29
    differing bits are missed; that is the setting for whole results.
    """
    spark = df.sparkSession
    base = df.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<float>").alias("v")).where(F.col("id").isNotNull() & usable(F.col("v"), dim))
    base = base.withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit("second"), "v")})
    members = base.select("id", "h1", "h2").distinct()
    classes = members.groupBy("h1", "h2").agg(F.min("id").alias("rep"))
    # the smallest ids of a class are all that can be anyone's neighbours
    head = members.withColumn("n", F.row_number().over(Window.partitionBy("h1", "h2").orderBy("id"))).where(F.col("n") <= k + 1).drop("n")
    reps = cut_lineage(base.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.first("v").alias("v")))
    total = reps.count()
    share = min(1.0, sample_rows / max(1, total))
    picked = reps.where(F.pmod(F.xxhash64("h1"), F.lit(1_000_000)) < int(share * 1_000_000) + 1).select("v").limit(2 * sample_rows).toArrow()
    sample = np.array(picked.column(0).combine_chunks().flatten(), np.float32).reshape(-1, dim)
    if not len(sample):
        return spark.createDataFrame([], "id bigint, neighbour bigint, dist double, rank int").withColumnRenamed("id", key)
    rotation = learn_rotation(sample)
    cells = Cells.learn(sample, math.ceil(total / cell_rows), flat_cells)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 4_000):
                part = batch.slice(i, 4_000)
                x = np.array(part.column(1).flatten(), np.float32).reshape(-1, dim)
                row, cell, own = cells.visited(x, margin)
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(own), *(c.take(pa.array(row)) for c in part.columns)], names=["cell", "own", "rep", "v"])

    def search(cell: pa.Table) -> pa.Table:
        x = np.array(cell.column("v").combine_chunks().flatten(), np.float32).reshape(-1, dim)
        keys = np.array(cell.column("rep"), np.int64)
        a, b, d = search_cell(x, keys, np.array(cell.column("own")), rotation, k, radius, substrings, flips)
        return pa.table({"rep": keys[a], "other": keys[b], "d": d})

    placed = reps.select("rep", "v").mapInArrow(place, "cell bigint, own boolean, rep bigint, v array<float>")
    # small data have a task for each cell; with many cells the session's partitions are enough
    spread = placed.repartition(cells.count, "cell") if cells.count <= flat_cells else placed.repartition("cell")
    found = spread.groupBy("cell").applyInArrow(search, "rep bigint, other bigint, d double")
    ranked = Window.partitionBy("rep").orderBy("d", "other")
    found = found.distinct().withColumn("n", F.row_number().over(ranked)).where(F.col("n") <= k).drop("n")
    heads = head.join(classes, ["h1", "h2"]).select("rep", F.col("id").alias("neighbour"))
    near = found.join(heads.withColumnRenamed("rep", "other"), "other").select("rep", "neighbour", "d")
    listed = near.unionByName(heads.withColumn("d", F.lit(0.0)))
    order = Window.partitionBy("rep").orderBy("d", "neighbour")
    listed = listed.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
    lists = listed.groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("d", "neighbour"))).alias("near"))
    own = members.join(classes, ["h1", "h2"]).select("id", "rep").join(lists, "rep")
    others = F.slice(F.filter("near", lambda s: s["neighbour"] != F.col("id")), 1, k)
    out = own.select(F.col("id").alias(key), F.posexplode(others).alias("at", "s"))
    return out.select(key, F.col("s.neighbour").alias("neighbour"), F.col("s.d").alias("dist"), (F.col("at") + 1).alias("rank"))


def neighbour_pairs(nearest: DataFrame, key: str = "chunk_id") -> DataFrame:
    """The unordered pairs of which at least one is a neighbour of the other, each once."""
    return nearest.select(F.least(key, "neighbour").alias("chunk_a"), F.greatest(key, "neighbour").alias("chunk_b")).distinct()
