"""Pairs of near-duplicate texts by covering locality-sensitive hashing.

A text is reduced to its letters and digits in lower case; its set of distinct substrings of ``gram`` characters is
sketched by blocks of minimum hashes. In each block the coordinates carry non-zero vectors of GF(2)^(radius+1),
and there is one table for each non-zero mask vector, which keeps the coordinates with an odd inner product. Any
``radius`` differing coordinates are orthogonal to some mask vector, so two sketches that differ in at most
``radius`` coordinates of a block collide in one of the block's tables for certain. Colliding pairs that a sketch of
a few bits of each minimum does not rule out are compared by the exact Jaccard similarity of their substring sets.

Equal texts are one class; only classes are hashed, joined and compared.
"""

from __future__ import annotations

import hashlib
import math
import unicodedata
from collections.abc import Iterator
from functools import cache, reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import code_points, cut_lineage, list_array, ranges
from lectern.llm.components import components

GRAMS_AT_ONCE = 1 << 16
#: Beyond this code point there are no letters and no digits.
LAST_LETTER = 0x32400
SIZE_BITS = 10
SIZE_STEP = math.log(2) * 31 / (1 << SIZE_BITS)
PAIR_BITS = 11
#: Bits of each minimum in a sketch.
PLANES = 3
SKETCH = [f"s{p}" for p in range(PLANES)]


@cache
def lowered() -> np.ndarray:
    """The lower-case form of every code point that is a letter or a digit, 0 for all others.

    A form of several code points has one letter and marks, which are dropped.
    """
    out = np.zeros(LAST_LETTER, np.uint32)
    for c in range(LAST_LETTER - 1):
        if unicodedata.category(chr(c))[0] in "LN":
            out[c] = next(ord(x) for x in chr(c).lower() if unicodedata.category(x)[0] in "LN")
    return out


def reduced(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The letters and digits of ``texts`` in lower case as code points one after another, and each text's offset."""
    # the one letter whose lower case depends on its neighbours
    points, ends = code_points([t.lower() if "Σ" in t else t for t in texts])
    points = lowered()[np.minimum(points, LAST_LETTER - 1)]
    kept = points != 0
    return points[kept], np.concatenate(([0], np.cumsum(kept)))[ends]


def reduce_text(text: str) -> str:
    """``text`` in lower case, without anything but letters and digits."""
    return "".join(map(chr, reduced([text])[0]))


def cover(coordinates: int, radius: int) -> np.ndarray:
    """The masks (tables x coordinates) of one block: which coordinates each table keeps."""
    masks = np.arange(1, 1 << (radius + 1), dtype=np.uint64)
    carried = masks[np.arange(coordinates) % len(masks)]
    return (np.bitwise_count(masks[:, None] & carried[None]) & 1).astype(bool)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (two multiplications and shifts)."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)


@cache
def hash_name(name: str | None) -> int:
    """64 bits of a table's name."""
    return int.from_bytes(hashlib.sha256((name or "").encode()).digest()[:8], "big")


class CoveringSketch:
    """Minimum hashes of ``blocks * coordinates`` functions, the tables' keys and the bit sketch made of them."""

    def __init__(self, gram: int, blocks: int, coordinates: int, radius: int, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        n = blocks * coordinates
        if n > 64 - SIZE_BITS:
            raise ValueError(f"a sketch has {64 - SIZE_BITS} bits: blocks * coordinates must not exceed that")
        self.gram, self.blocks, self.coordinates = gram, blocks, coordinates
        self.times = rng.integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.plus = rng.integers(0, 1 << 32, n, dtype=np.uint32)
        self.masks = cover(coordinates, radius)
        self.weights = rng.integers(1, 1 << 63, (len(self.masks) * blocks, coordinates), dtype=np.uint64) | np.uint64(1)

    def grams(self, points: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A 32-bit hash of every substring of every text, and each text's number of them (0 if it is too short)."""
        count = np.maximum(np.diff(ends) - self.gram + 1, 0)
        h = gram_hashes(points, self.gram) >> np.uint64(32)
        return h[ranges(ends[:-1], count)].astype(np.uint32), count

    def minima(self, grams: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Minimum hashes (texts x functions) of the hashes of substrings, of which each text must have one."""
        out = np.empty((len(count), len(self.times)), np.uint32)
        ends = np.cumsum(count)
        done = 0
        while done < len(count):  # a block of texts whose hashes stay in the processor's cache
            first = ends[done - 1] if done else 0
            to = max(done + 1, int(np.searchsorted(ends, first + GRAMS_AT_ONCE, "right")))
            part, starts = grams[first : ends[to - 1]], ends[done:to] - count[done:to] - first
            work = np.empty_like(part)
            for k in range(len(self.times)):
                np.multiply(part, self.times[k], out=work)
                np.add(work, self.plus[k], out=work)
                out[done:to, k] = np.minimum.reduceat(work, starts)
            done = to
        return out

    def keys(self, minima: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The key of each text in each table, and its sketch: ``PLANES`` bits of each minimum, one bit of all in a word."""
        values = mixed(minima.astype(np.uint64) + np.uint64(1))
        keys = np.empty((len(minima), len(self.weights)), np.int64)
        tables = len(self.masks)
        for b in range(self.blocks):
            own = values[:, b * self.coordinates : (b + 1) * self.coordinates]
            for t in range(tables):
                kept = self.masks[t]
                keys[:, b * tables + t] = mixed((own[:, kept] * self.weights[b * tables + t][kept]).sum(1, dtype=np.uint64)).view(np.int64)
        places = np.arange(values.shape[1], dtype=np.uint64)
        planes = [(((values >> np.uint64(63 - p)) & np.uint64(1)) << places).sum(1, dtype=np.uint64) for p in range(PLANES)]
        return keys, np.stack(planes, 1)


def size_classes(sizes: np.ndarray) -> np.ndarray:
    """The sizes' logarithms in ``SIZE_STEP``s, as fit into the upper bits of a sketch."""
    return np.minimum(np.log(np.maximum(sizes, 1)) / SIZE_STEP, (1 << SIZE_BITS) - 1).astype(np.uint64)


def sketches(texts: DataFrame, gram: int, least: int, blocks: int, coordinates: int, radius: int) -> DataFrame:
    """``tbl, id, r1, r2, h1, h2``, the words of the sketch and ``keys`` of each text (``tbl, id, r1, r2, text``) with
    ``least`` letters and digits.

    ``h1, h2`` are 128 bits of the reduced text. The upper bits of the first word are the logarithm of the number of
    distinct substrings.
    """
    schema = "tbl string, id bigint, r1 bigint, r2 bigint, h1 bigint, h2 bigint, " + "".join(f"{w} bigint, " for w in SKETCH) + "keys array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = CoveringSketch(gram, blocks, coordinates, radius)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                points, ends = reduced(part.column(4).to_pylist())
                long = np.diff(ends) >= least
                part, size = part.filter(pa.array(long)), np.diff(ends)[long]
                points = points[ranges(ends[:-1][long], size)]
                ends = np.concatenate(([0], np.cumsum(size)))
                if not part.num_rows:
                    continue
                raw = memoryview(points.view(np.uint8))
                digests = b"".join(hashlib.blake2b(raw[4 * a : 4 * b], digest_size=16).digest() for a, b in pairwise(ends.tolist()))
                h = np.frombuffer(digests, np.int64).reshape(-1, 2)
                grams, count = sketch.grams(points, ends)
                keys, words = sketch.keys(sketch.minima(grams, count))
                # one table of keys for each ``tbl``: its hash is part of them
                own = np.array([hash_name(t) for t in part.column(0).to_pylist()], np.uint64)
                keys = mixed(keys.view(np.uint64) ^ own[:, None]).view(np.int64)
                words[:, 0] |= size_classes(distinct_sizes(grams, count)) << np.uint64(64 - SIZE_BITS)
                words = [pa.array(words[:, p].view(np.int64)) for p in range(PLANES)]
                lists = list_array(keys.ravel(), np.arange(len(size) + 1) * keys.shape[1], pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array(h[:, 0]), pa.array(h[:, 1]), *words, lists], names=[f.split()[0] for f in schema.split(", ")])

    return texts.select("tbl", "id", "r1", "r2", "text").mapInArrow(run, schema)


def gram_hashes(points: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of every ``gram`` consecutive code points."""
    n = max(0, len(points) - gram + 1)
    times = np.random.default_rng(gram).integers(1, 1 << 63, gram, dtype=np.uint64) | np.uint64(1)
    x = points.astype(np.uint64)
    h = x[:n] * times[0]
    for i in range(1, gram):
        h += x[i : i + n] * times[i]
    return mixed(h)


def distinct_sizes(hashes: np.ndarray, count: np.ndarray) -> np.ndarray:
    """How many different 32-bit hashes each text has."""
    keyed = np.sort((np.repeat(np.arange(len(count), dtype=np.uint64), count) << np.uint64(32)) | hashes)
    new = np.ones(len(keyed), bool)
    np.not_equal(keyed[1:], keyed[:-1], out=new[1:])
    return np.bincount((keyed[new] >> np.uint64(32)).astype(np.int64), minlength=len(count))


def exact_similarity(a: str, b: str, gram: int) -> float:
    """The Jaccard similarity of the substrings of two reduced texts."""
    left, right = ({t[i : i + gram] for i in range(len(t) - gram + 1)} for t in (a, b))
    return len(left & right) / max(1, len(left | right))


def similarities(texts: list[str], a: np.ndarray, b: np.ndarray, gram: int, least: float) -> np.ndarray:
    """The Jaccard similarity of the pairs of texts (``a[i]``, ``b[i]``), at most 2 ** PAIR_BITS of them.

    Substrings are counted by hashes of ``63 - PAIR_BITS`` bits; where the counts are so near to ``least`` that two equal
    hashes of different substrings could decide, the substrings themselves are compared.
    """
    points, ends = reduced(texts)
    hashes = gram_hashes(points, gram) >> np.uint64(PAIR_BITS + 1) << np.uint64(1)
    count = np.maximum(np.diff(ends) - gram + 1, 0)
    out = np.zeros(len(a), np.float64)
    total = np.cumsum(count[a] + count[b])
    done = 0
    while done < len(a):  # blocks of pairs that stay in the processor's cache
        to = max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + 4 * GRAMS_AT_ONCE, "right")))
        own = np.arange(to - done)
        sides = []
        for side, x in enumerate((a[done:to], b[done:to])):
            pair = np.repeat(own, count[x]).astype(np.uint64) << np.uint64(64 - PAIR_BITS)
            sides.append(hashes[ranges(ends[x], count[x])] | pair | np.uint64(side))
        keyed = np.sort(np.concatenate(sides))
        keyed = keyed[np.concatenate(([True], keyed[1:] != keyed[:-1]))]
        common = (keyed[1:] ^ keyed[:-1]) == 1
        pair = (keyed >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
        shared = np.bincount(pair[1:][common], minlength=len(own))
        union = np.bincount(pair, minlength=len(own)) - shared
        out[done:to] = shared / np.maximum(1, union)
        for k in np.flatnonzero(np.abs(shared - least * union) <= 2):
            i, j = a[done + k], b[done + k]
            one, other = ("".join(map(chr, points[ends[t] : ends[t + 1]])) for t in (i, j))
            out[done + k] = exact_similarity(one, other, gram)
        done = to
    return out


def verified(pairs: DataFrame, gram: int, least: float) -> DataFrame:
    """``tbl, rep_a, rep_b, jaccard`` of the pairs whose exact similarity is at least ``least``; reads ``t_a, t_b``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1 << PAIR_BITS):
                batch = whole.slice(at, 1 << PAIR_BITS)
                texts = pa.concat_arrays([batch.column(3), batch.column(4)]).dictionary_encode()
                which = texts.indices.to_numpy()
                score = similarities(texts.dictionary.to_pylist(), which[: batch.num_rows], which[batch.num_rows :], gram, least)
                keep = pa.array(score >= least)
                yield pa.RecordBatch.from_arrays([*(c.filter(keep) for c in batch.columns[:3]), pa.array(score).filter(keep)], names=["tbl", "rep_a", "rep_b", "jaccard"])

    return pairs.select("tbl", "rep_a", "rep_b", "t_a", "t_b").mapInArrow(run, "tbl string, rep_a bigint, rep_b bigint, jaccard double")


def near_sketches(a: str, b: str, apart: int, similarity: float) -> Column:
    """Whether two sketches (columns after ``a.`` and ``b.``) allow ``similarity``: few differing minima, near sizes."""
    low = (1 << (64 - SIZE_BITS)) - 1
    differ = reduce(Column.bitwiseOR, (F.col(f"{a}.{w}").bitwiseXOR(F.col(f"{b}.{w}")) for w in SKETCH)).bitwiseAND(F.lit(low))
    sizes = [F.shiftrightunsigned(f"{side}.{SKETCH[0]}", 64 - SIZE_BITS) for side in (a, b)]
    return (F.bit_count(differ) <= apart) & (F.abs(sizes[0] - sizes[1]) <= size_steps(similarity))


def size_steps(similarity: float) -> int:
    """How far the size classes of two similar texts can be apart, and one more, as sizes are counted by hashes."""
    return 1 + math.ceil(-math.log(similarity) / SIZE_STEP)


def bucket_pairs(at: np.ndarray, words: list[np.ndarray], apart: int, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The places of the pairs with equal ``at`` (sorted) whose sketches are near, in blocks."""
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1]))) if len(at) else np.zeros(0, np.int64)
    stop = np.repeat(np.append(first[1:], len(at)), np.diff(np.append(first, len(at))))
    partners = stop - np.arange(len(at)) - 1
    total = np.cumsum(partners)
    low, sizes = np.uint64((1 << (64 - SIZE_BITS)) - 1), (words[0] >> np.uint64(64 - SIZE_BITS)).astype(np.int64)
    done = 0
    while done < len(at):
        to = max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + 16 * GRAMS_AT_ONCE, "right")))
        own = np.arange(done, to)
        a, b = np.repeat(own, partners[done:to]), ranges(own + 1, partners[done:to])
        differ = reduce(np.bitwise_or, (w[a] ^ w[b] for w in words)) & low
        near = (np.bitwise_count(differ) <= apart) & (np.abs(sizes[a] - sizes[b]) <= size_steps(similarity))
        yield a[near], b[near]
        done = to


def colliding(rows: DataFrame, apart: int, similarity: float, bucket_rows: int) -> DataFrame:
    """``tbl, rep_a, rep_b``: the pairs of ``rows`` (at, tbl, id and the words of the sketch) that share a key and have near sketches.

    The sorted keys are read once; buckets of up to ``bucket_rows`` are paired as they pass by. The rows of larger ones
    are passed on and joined in cells: a bucket of n rows is dealt to n / ``bucket_rows`` parts, and every two parts
    meet in a task of their own.
    """
    schema = "at bigint, tbl string, rep_a bigint, " + "".join(f"{w} bigint, " for w in SKETCH) + "rep_b bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in schema.split(", ")]
        held: list[pa.RecordBatch] = []
        crowded = None  # the key of a bucket that is being passed on

        def passed(part: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*part.columns, pa.nulls(part.num_rows, pa.int64())], names=names)

        def paired(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            at, ids = part.column(0).to_numpy(), part.column(2).to_numpy()
            first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1]))) if len(at) else np.zeros(0, np.int64)
            n = np.diff(np.append(first, len(at)))
            large = np.repeat(n > bucket_rows, n)
            if large.any():
                yield passed(part.filter(pa.array(large)))
                part = part.filter(pa.array(~large))
                at, ids = at[~large], ids[~large]
            words = [part.column(3 + p).to_numpy().view(np.uint64) for p in range(PLANES)]
            for a, b in bucket_pairs(at, words, apart, similarity):
                i, j, none = ids[a], ids[b], pa.nulls(len(a), pa.int64())
                yield pa.RecordBatch.from_arrays([none, part.column(1).take(pa.array(a)), pa.array(np.minimum(i, j)), *[none] * PLANES, pa.array(np.maximum(i, j))], names=names)

        for batch in batches:
            at = batch.column(0).to_numpy()
            if crowded is not None:
                same = int(np.searchsorted(at, crowded, "right")) if len(at) and at[0] == crowded else 0
                if same:
                    yield passed(batch.slice(0, same))
                    batch, at = batch.slice(same), at[same:]
                crowded = None if len(at) else crowded
            if not len(at):
                continue
            last = int(np.searchsorted(at, at[-1], "left"))
            if last or (held and held[-1].column(0)[0].as_py() != at[0]):
                yield from paired(pa.concat_batches([*held, batch.slice(0, last)]))
                held = []
            held.append(batch.slice(last))
            if sum(b.num_rows for b in held) > bucket_rows:
                yield from map(passed, held)
                held, crowded = [], at[-1]
        if held:
            yield from paired(pa.concat_batches(held))

    met = cut_lineage(rows.select("at", "tbl", "id", *SKETCH).repartition("at").sortWithinPartitions("at").mapInArrow(run, schema))
    light = met.where(F.col("rep_b").isNotNull()).select("tbl", "rep_a", "rep_b")
    heavy = met.where(F.col("rep_b").isNull()).select("at", "tbl", F.col("rep_a").alias("id"), *SKETCH)
    parts = heavy.groupBy("at").agg(F.ceil(F.count("*") / bucket_rows).cast("int").alias("parts"))
    dealt = heavy.join(parts, "at").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    a = dealt.select("at", F.col("part").alias("x"), every.alias("y"), "tbl", "id", *SKETCH).alias("a")
    b = dealt.select("at", every.alias("x"), F.col("part").alias("y"), "id", *SKETCH).alias("b")
    met = (F.col("a.id") < F.col("b.id")) & near_sketches("a", "b", apart, similarity)
    crossed = a.join(b, ["at", "x", "y"]).where(met).select("tbl", F.col("a.id").alias("rep_a"), F.col("b.id").alias("rep_b"))
    return light.unionByName(crossed).distinct()


class NearDuplicates:
    """The links of a collection: ``members`` (tbl, id, rep) and ``links`` (tbl, rep_a, rep_b, jaccard)."""

    def __init__(self, members: DataFrame, links: DataFrame) -> None:
        self.members, self.links = members, links

    def pairs(self) -> DataFrame:
        """Every pair of records, equal texts included: ``tbl, id_a, id_b`` with ``id_a < id_b``."""
        a = self.members.select("tbl", F.col("rep").alias("rep_a"), F.col("id").alias("id_1"))
        b = self.members.select("tbl", F.col("rep").alias("rep_b"), F.col("id").alias("id_2"))
        across = self.links.join(a, ["tbl", "rep_a"]).join(b, ["tbl", "rep_b"]).select("tbl", "id_1", "id_2")
        same = self.members.alias("x").join(self.members.alias("y"), (F.col("x.tbl") == F.col("y.tbl")) & (F.col("x.rep") == F.col("y.rep")) & (F.col("x.id") < F.col("y.id")))
        every = across.unionByName(same.select("x.tbl", F.col("x.id").alias("id_1"), F.col("y.id").alias("id_2")))
        return every.select("tbl", F.least("id_1", "id_2").alias("id_a"), F.greatest("id_1", "id_2").alias("id_b"))

    def records(self) -> DataFrame:
        """One row for each record: its class (the smallest id with an equal text), copies, and links to other texts."""
        both = self.links.select("tbl", F.explode(F.array("rep_a", "rep_b")).alias("rep"))
        links = both.groupBy("tbl", "rep").agg(F.count("*").alias("links"))
        copies = self.members.groupBy("tbl", "rep").agg(F.count("*").alias("copies"))
        per_class = copies.join(links, ["tbl", "rep"], "left")
        return self.members.join(per_class, ["tbl", "rep"]).select("tbl", "id", F.col("rep").alias("class_id"), "copies", F.coalesce("links", F.lit(0)).alias("links"))

    def groups(self) -> DataFrame:
        """One row for each record: its group, named by the smallest id that is connected to it by links."""
        roots = components(self.links.select("tbl", F.col("rep_a").alias("a"), F.col("rep_b").alias("b")))
        own = self.members.join(roots.withColumnRenamed("node", "rep"), ["tbl", "rep"], "left")
        return own.select("tbl", "id", F.coalesce("root", "rep").alias("group_id"))


def near_duplicates(
    df: DataFrame, similarity: float = 0.7, gram: int = 4, least: int = 80, blocks: int = 9, coordinates: int = 6, radius: int = 1, apart: int = 28, bucket_rows: int = 4_000
) -> NearDuplicates:
    """Links between the records of ``df`` (``tbl, id, text``) whose reduced texts have at least ``similarity``.

    Texts with fewer than ``least`` characters left, null texts and null ids take no part. A row delivered again
    counts once; an id with several texts counts with one of them (that of the smallest hash). Only pairs within one ``tbl`` are linked.
    Sketches with more than ``apart`` of the ``blocks * coordinates`` minima differing aren't compared (about two
    pairs in a hundred thousand at the threshold). The defaults lose about three pairs in a thousand at a similarity of
    0.7, none to speak of above 0.8; with ``apart`` at ``blocks * coordinates`` no colliding pair is left out.
    """
    texts = df.select("tbl", "id", "text").where(F.col("id").isNotNull() & (F.char_length("text") >= least))
    texts = texts.withColumns({"r1": F.xxhash64("text"), "r2": F.xxhash64(F.lit("second"), "text")})
    raw = cut_lineage(sketches(texts, gram, least, blocks, coordinates, radius))
    once = raw.groupBy("tbl", "id").agg(F.min(F.struct("h1", "h2", "r1", "r2")).alias("h")).select("tbl", "id", "h.*")
    reps = cut_lineage(once.groupBy("tbl", "h1", "h2").agg(F.min(F.struct("id", "r1", "r2")).alias("o")).select("tbl", "h1", "h2", "o.*"))
    members = once.join(reps.select("tbl", "h1", "h2", F.col("id").alias("rep")), ["tbl", "h1", "h2"]).select("tbl", "id", "rep")
    classes = raw.join(reps, ["tbl", "id", "r1", "r2"], "left_semi").dropDuplicates(["tbl", "id", "r1", "r2"])
    rows = classes.select(F.explode("keys").alias("at"), "tbl", "id", *SKETCH)
    candidates = cut_lineage(colliding(rows, apart, similarity, bucket_rows))
    asked = candidates.select("tbl", F.explode(F.array("rep_a", "rep_b")).alias("id")).distinct().join(reps, ["tbl", "id"])
    wanted = texts.join(asked.select("tbl", "id", "r1", "r2"), ["tbl", "id", "r1", "r2"], "left_semi").dropDuplicates(["tbl", "id"])
    left = wanted.select("tbl", F.col("id").alias("rep_a"), F.col("text").alias("t_a"))
    right = wanted.select("tbl", F.col("id").alias("rep_b"), F.col("text").alias("t_b"))
    texts_of = candidates.join(left, ["tbl", "rep_a"]).join(right, ["tbl", "rep_b"])
    return NearDuplicates(members, verified(texts_of, gram, similarity))
