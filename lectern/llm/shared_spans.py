"""Long stretches that stand letter by letter in more than one document, found with FM-indexes.

Comparing every document with every index shard would grow with the square of the corpus. So places that may be
shared are found first: in every window of ``least`` characters the substring of ``gram`` characters with the
smallest hash is its anchor, chosen by the window's content alone; equal windows have equal anchors, at the same place
in the window. The rest of the window is at least half on one side of it, so equal windows agree in the anchor with
half of that rest before it, or with half behind it. A region of text around each anchor (all windows it stands for)
goes to the shard of the anchor's hash, if another document has the anchor with one of the two halves. A shard builds an FM-index of its distinct regions, and backward search with matching
statistics tells of every character how long a match with another document starts there. Matches of ``least``
characters or more are put together to maximal runs in each document.

Regions that are equal in several documents are one region of the index, whose every occurrence counts as shared; they
are searched like all others. An anchor with more than
``hot_regions`` distinct regions is too much for one index; its windows are compared by 128-bit hashes instead,
which are pre-aggregated before the shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.llm.common import code_points, cut_lineage
from lectern.llm.fm_index import FmIndex
from lectern.llm.near_dup_covering import mixed

BASE = 0x9E3779B97F4A7C15
PLACE_BITS = 23
LONGEST = 1 << 21
AT_ONCE = 1 << 18


@cache
def powers(base: int, n: int) -> np.ndarray:
    """``base ** 0 .. base ** (n - 1)`` modulo 2 ** 64."""
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class WindowHashes:
    """64-bit hashes of windows of any width (a polynomial of mixed values, mixed again), from one pass of sums."""

    def __init__(self, points: np.ndarray, seed: int) -> None:
        size = 1 << max(18, int(len(points)).bit_length())
        self.sums = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(mixed(points.astype(np.uint64) + np.uint64(seed)) * powers(BASE, size)[: len(points)], out=self.sums[1:])
        self.back = powers(pow(BASE, -1, 1 << 64), size)

    def every(self, width: int) -> np.ndarray:
        """The hash of every ``width`` consecutive code points."""
        n = max(0, len(self.sums) - width)
        return mixed((self.sums[width:] - self.sums[:n]) * self.back[:n])

    def at(self, places: np.ndarray, width: int) -> np.ndarray:
        """The hashes of the windows that begin at ``places``; those that reach over the end are of no use."""
        n = len(self.sums) - 1
        places = np.clip(places, 0, n)
        return mixed((self.sums[np.minimum(places + width, n)] - self.sums[places]) * self.back[places])


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` consecutive values, by minima within blocks from both sides."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    forward = np.minimum.accumulate(blocks, 1).ravel()
    backward = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(backward[: n - width + 1], forward[width - 1 : n])


ANCHOR = "fp bigint, doc bigint, first int, last int, before bigint, behind bigint"


def anchors_of(points: np.ndarray, ends: np.ndarray, least: int, gram: int) -> tuple[np.ndarray, ...]:
    """Anchor hash, text number, and the first and last window (offsets in the text) that each anchor stands for; then
    the hashes of the anchor with half of a window's rest before it, and behind it, 0 where no window has so much there.
    """
    none = np.zeros(0, np.int64)
    if len(points) < least:
        return (none,) * 6
    hashes = WindowHashes(points, 1)
    h = hashes.every(gram)
    packed = (h >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)) | np.arange(len(h), dtype=np.uint64)
    place = (sliding_minimum(packed, least - gram + 1) & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
    text = np.repeat(np.arange(len(ends) - 1), np.diff(ends))[: len(place)]
    window = np.flatnonzero(np.arange(len(place)) + least <= ends[text + 1])
    if not len(window):
        return (none,) * 6
    place, text = place[window], text[window]
    new = np.r_[True, (place[1:] != place[:-1]) | (text[1:] != text[:-1])]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(place)] - 1
    own, at = text[first], place[first]
    first, last = window[first], window[last]
    half = (least - gram + 1) // 2  # one side of an anchor has at least so much of a window
    before = np.where(at - half >= first, hashes.at(at - half, gram + half), np.uint64(0)).view(np.int64)
    behind = np.where(at + gram + half <= last + least, hashes.at(at, gram + half) ^ np.uint64(1), np.uint64(0)).view(np.int64)
    return h[at].view(np.int64), own, first - ends[own], last - ends[own], before, behind


def find_anchors(docs: DataFrame, least: int, gram: int) -> DataFrame:
    """``fp, doc, first, last, before, behind`` of every anchor of ``docs`` (doc, t)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            parts: list[tuple[int, int, str]] = []  # row, offset, text; a very long text in overlapping parts
            size = 0
            for i, t in enumerate(texts):
                for at in range(0, max(1, len(t) - least + 1), LONGEST):
                    parts.append((i, at, t[at : at + LONGEST + least - 1]))
                    size += len(parts[-1][2])
                    if size >= AT_ONCE:
                        yield anchored(ids, parts)
                        parts, size = [], 0
            if parts:
                yield anchored(ids, parts)

    def anchored(ids: np.ndarray, parts: list[tuple[int, int, str]]) -> pa.RecordBatch:
        fp, own, first, last, before, behind = anchors_of(*code_points([p[2] for p in parts]), least, gram)
        row, at = np.array([p[0] for p in parts]), np.array([p[1] for p in parts])
        columns = [fp, ids[row[own]], (first + at[own]).astype(np.int32), (last + at[own]).astype(np.int32), before, behind]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[f.split()[0] for f in ANCHOR.split(", ")])

    return docs.mapInArrow(run, ANCHOR)


def shared_anchors(anchors: DataFrame) -> DataFrame:
    """``fp, doc, first, last`` of the anchors that another document has with the same half before or behind."""
    halves = anchors.select("fp", "doc", "first", "last", F.explode(F.array("before", "behind")).alias("half")).where("half <> 0")
    several = halves.groupBy("half").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).where("a <> b").select("half")
    return halves.join(several, "half", "left_semi").select("fp", "doc", "first", "last").distinct()


def cut_regions(shared: DataFrame, docs: DataFrame, least: int) -> DataFrame:
    """``fp, doc, first, t`` of every shared anchor: the text of its region."""
    asked = shared.groupBy("doc").agg(F.collect_list(F.struct("fp", "first", "last")).alias("a"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                batch = whole.slice(at, 200)
                rows = [(a["fp"], doc, a["first"], t[a["first"] : a["last"] + least]) for doc, t, asks in zip(*(c.to_pylist() for c in batch.columns), strict=True) for a in asks]
                fp, doc, first, t = zip(*rows, strict=True) if rows else ((), (), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(fp, pa.int64()), pa.array(doc, pa.int64()), pa.array(first, pa.int32()), pa.array(t, pa.string())], names=["fp", "doc", "first", "t"])

    return docs.join(asked, "doc").select("doc", "t", "a").mapInArrow(run, "fp bigint, doc bigint, first int, t string")


def search_shards(regions: DataFrame, least: int, shard_chars: int) -> DataFrame:
    """``h1, h2, at, n``: the runs of shared window starts of the distinct ``regions`` (fp, h1, h2, t, doc, many)."""
    chars = regions.agg(F.sum(F.char_length("t"))).first()[0] or 0
    shards = max(1, math.ceil(chars / shard_chars))

    def search(shard: pa.Table) -> pa.Table:
        shard = shard.combine_chunks()
        doc, many = np.array(shard.column("doc"), np.int64), np.array(shard.column("many"), bool)
        points, ends = code_points(shard.column("t").to_pylist())
        lengths = np.diff(ends)
        found = FmIndex(points, ends, doc, many).matching_statistics(np.arange(len(doc)), lengths, least) >= least
        own = np.repeat(np.arange(len(doc)), lengths)
        same = own[1:] == own[:-1]
        begins = np.flatnonzero(found & ~np.r_[False, found[:-1] & same]) if len(found) else np.zeros(0, np.int64)
        stops = np.flatnonzero(found & ~np.r_[found[1:] & same, False]) if len(found) else np.zeros(0, np.int64)
        row = own[begins]
        part = shard.select(["h1", "h2"]).take(pa.array(row))
        return part.append_column("at", pa.array((begins - ends[row]).astype(np.int32))).append_column("n", pa.array((stops - begins + 1).astype(np.int32)))

    placed = regions.select(F.pmod(F.xxhash64("fp"), F.lit(shards)).cast("int").alias("shard"), "h1", "h2", "t", "doc", "many")
    return placed.repartition(shards, "shard").groupBy("shard").applyInArrow(search, "h1 bigint, h2 bigint, at int, n int")


def hot_windows(regions: DataFrame, least: int) -> DataFrame:
    """``doc, at``: shared windows of the regions (doc, first, t) of hot anchors, by 128-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 1_000):
                batch = whole.slice(k, 1_000)
                points, ends = code_points(batch.column(2).to_pylist())
                own = np.repeat(np.arange(batch.num_rows), np.maximum(np.diff(ends) - least + 1, 0))
                at = np.arange(len(own)) - np.repeat(np.cumsum(n := np.bincount(own, minlength=batch.num_rows)) - n, n)
                where = ends[own] + at
                h1, h2 = (WindowHashes(points, seed).every(least)[where] for seed in (3, 5))
                doc, first = batch.column(0).to_numpy()[own], batch.column(1).to_numpy()[own]
                yield pa.RecordBatch.from_arrays([pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(doc), pa.array((first + at).astype(np.int32))], names=["w1", "w2", "doc", "at"])

    windows = regions.select("doc", "first", "t").mapInArrow(run, "w1 bigint, w2 bigint, doc bigint, at int")
    shared = windows.groupBy("w1", "w2").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).where("a <> b")
    return windows.join(shared.select("w1", "w2"), ["w1", "w2"]).select("doc", "at")


def merged(spans: DataFrame) -> DataFrame:
    """``doc, span_start, span_len``: the maximal runs that the intervals ``doc, a, b`` cover together."""
    order = Window.partitionBy("doc").orderBy("a", "b")
    reach = F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = spans.withColumn("new", F.coalesce((F.col("a") > reach).cast("int"), F.lit(1)))
    run = new.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    out = run.groupBy("doc", "run").agg(F.min("a").alias("span_start"), F.max("b").alias("e"))
    return out.select("doc", F.col("span_start").cast("bigint"), (F.col("e") - F.col("span_start")).cast("bigint").alias("span_len"))


def shared_spans(
    df: DataFrame, key: str = "doc_id", text: str = "text", least: int = 200, gram: int = 64, shard_chars: int = 1_000_000, hot_regions: int = 2_000
) -> DataFrame:
    """``key, span_start, span_len``: the maximal runs of characters that lie in a stretch of ``least`` characters
    which also occurs in the text of another key.

    Null keys, null texts and texts shorter than ``least`` take no part. A row delivered again counts once; an id
    with several texts is one document with each of them. What recurs only inside one document is not shared. Other
    columns are not read. An empty table gives an empty result.
    """
    docs = df.select(F.col(key).cast("bigint").alias("doc"), F.col(text).alias("t")).where(F.col("doc").isNotNull() & (F.char_length("t") >= least))
    anchors = cut_lineage(find_anchors(docs, least, gram))
    regions = cut_regions(shared_anchors(anchors), docs, least).withColumns({"h1": F.xxhash64("fp", "t"), "h2": F.xxhash64(F.lit("second"), "fp", "t")})
    regions = cut_lineage(regions.where(F.char_length("t") >= least))
    one_each = regions.groupBy("fp", "h1", "h2").agg(F.first("t").alias("t"), F.min("doc").alias("doc"), (F.min("doc") != F.max("doc")).alias("many"))
    one_each = cut_lineage(one_each)
    # as many regions of one anchor as one index can hold several times over
    hot = cut_lineage(one_each.groupBy("fp").agg(F.count("*").alias("n")).where(F.col("n") > hot_regions).select("fp"))
    runs = search_shards(one_each.join(hot, "fp", "left_anti"), least, shard_chars)
    starts = regions.select("h1", "h2", "doc", "first").join(runs, ["h1", "h2"])
    spans = starts.select("doc", (F.col("first") + F.col("at")).alias("a"), (F.col("first") + F.col("at") + F.col("n") + least - 1).alias("b"))
    rest = hot_windows(regions.join(hot, "fp"), least)
    spans = spans.unionByName(rest.select("doc", F.col("at").alias("a"), (F.col("at") + least).alias("b")))
    return merged(spans).withColumnRenamed("doc", key)


def shared_shares(df: DataFrame, spans: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_chars, shared_chars, share`` of every distinct not-null key; a null or empty text has a share of 0."""
    size = df.select(F.col(key).cast("bigint").alias(key), F.coalesce(F.char_length(text), F.lit(0)).alias("n")).where(F.col(key).isNotNull()).groupBy(key).agg(F.max("n").cast("bigint").alias("n_chars"))
    covered = spans.groupBy(key).agg(F.sum("span_len").alias("shared_chars"))
    both = size.join(covered, key, "left").withColumn("shared_chars", F.coalesce("shared_chars", F.lit(0)).cast("bigint"))
    return both.withColumn("share", F.when(F.col("n_chars") > 0, F.round(F.col("shared_chars") / F.col("n_chars"), 6)).otherwise(0.0))
