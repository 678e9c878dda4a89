"""Scores of a stated query set against all documents, in blocks: the documents are dealt to parts, the queries to blocks,
and every part meets every block once. A part adds up the scores of its own documents in a matrix and gives its best
ones on, so that scored pairs are never shuffled.

A part has about ``PART`` documents and a block about ``BLOCK`` queries, whatever the size of the tables. Documents are
shuffled once, to their part; only the blocks, packed and compressed, go to every part.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from copy import copy

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DataType

PART, BLOCK = 12_000, 256
PAIRS_AT_ONCE, TOKENS_AT_ONCE = 2_000_000, 64
#: Additions of a matrix product that take as long as one addition at a listed place.
DENSE = 64


def dealt(docs: DataFrame, count: int, key: str = "id", size: int = PART) -> DataFrame:
    """``docs`` with their ``part``; all rows of a key are in one."""
    return docs.withColumn("part", F.pmod(F.xxhash64(key), F.lit(max(1, math.ceil(count / size)))).cast("int"))


def met(docs: DataFrame, asks: DataFrame, count: int, asked: int, run: Callable[[pa.Table, pa.Table], Callable[[pa.Table], pa.Table]], schema: str, own: DataFrame | None = None, size: int = PART, block: int = BLOCK) -> DataFrame:
    """``run(part of docs, rows of own)(block of asks)`` for every part of the ``count`` docs (with ``part``) and block of
    the ``asked`` queries: what a part needs for all blocks is made once. Rows of ``own`` (with ``part``) go to their part.

    The parts are shuffled as for their statistics, so that Spark does it once."""
    parts, blocks = max(1, math.ceil(count / size)), max(1, math.ceil(asked / block))
    number = F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int")
    packed = asks.withColumn("block", number).groupBy("block").applyInArrow(pack, "packed binary")
    right = packed.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    if own is not None:
        right = right.unionByName(own, allowMissingColumns=True)
    empty = to_arrow_schema(DataType.fromDDL(schema)).empty_table()

    def every(part: pa.Table, rows: pa.Table) -> pa.Table:
        blocks = column(rows, "packed").drop_null()
        if not part.num_rows or not len(blocks):
            return empty
        answer = run(part, rows.filter(pc.is_null(rows.column("packed"))).drop_columns(["packed", "part"]))
        return pa.concat_tables([answer(pa.ipc.open_stream(b.as_buffer()).read_all().combine_chunks()).cast(empty.schema) for b in blocks])

    return docs.groupBy("part").cogroup(right.groupBy("part")).applyInArrow(every, schema)


def pack(block: pa.Table) -> pa.Table:
    """The rows of a block as one compressed value."""
    block, sink = block.drop_columns(["block"]).combine_chunks(), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, block.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(block)
    return pa.table({"packed": pa.array([sink.getvalue().to_pybytes()], pa.binary())})


def joined(tokens: Column) -> Column:
    """A list of tokens as one text, a fraction of the list's size in a shuffle; no token has a space."""
    return F.array_join(tokens, " ")


def lists(part: pa.Table, name: str) -> pa.Array:
    """The lists that ``joined`` made texts of."""
    texts = column(part, name)
    split = pc.split_pattern(texts, " ")
    return pc.if_else(pc.equal(texts, ""), pa.scalar([], split.type), split)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``start, start + 1, ...`` of every range, one after another."""
    if not lengths.sum():
        return np.zeros(0, np.int64)
    return np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) + np.arange(lengths.sum())


def once(table: pa.Table, key: str = "id") -> pa.Table:
    """The rows of a part, each delivery of a row once (whole rows are equal, so their columns are)."""
    columns = [c for c in table.column_names if c not in ("part", "block")]
    seen: dict[tuple, int] = {}
    hashes = [table.column(c).to_pylist() for c in columns if c in (key, "h")]
    for i, row in enumerate(zip(*hashes, strict=True)):
        seen.setdefault(row, i)
    return table.select(columns).take(pa.array(list(seen.values()), pa.int64())).combine_chunks()


def column(table: pa.Table, name: str) -> pa.Array:
    """A column as one array."""
    c = table.column(name)
    return c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c


class Postings:
    """The different tokens of each document of a part and how often each has them, by token; null lists have none."""

    def __init__(self, lists: pa.Array) -> None:
        rows, coded = pc.list_parent_indices(lists).to_numpy().astype(np.int64), pc.list_flatten(lists).dictionary_encode()
        self.docs, self.vocabulary = len(lists), coded.dictionary
        number = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        each, self.count = np.unique(number * max(1, self.docs) + rows, return_counts=True)
        self.tok, self.doc = np.divmod(each, max(1, self.docs))
        self.size = np.bincount(self.tok, minlength=len(self.vocabulary))
        self.first = np.cumsum(self.size) - self.size

    def scores(self, queries: Queries, weight: np.ndarray) -> np.ndarray:
        """The sums of the products of weights of common tokens (queries x documents); ``weight`` has one of each posting.

        A token that many queries and documents have is a column and a row of a matrix product, others are added place
        by place."""
        out = np.zeros((queries.count, self.docs))
        place = pc.index_in(queries.vocabulary, value_set=self.vocabulary)
        word = np.flatnonzero(place.is_valid().to_numpy(zero_copy_only=False))
        tok = pc.fill_null(place, 0).to_numpy()[word]
        many = self.size[tok] * queries.size[word] * DENSE > queries.count * self.docs
        for at in range(0, int(many.sum()), TOKENS_AT_ONCE):
            w, t = word[many][at : at + TOKENS_AT_ONCE], tok[many][at : at + TOKENS_AT_ONCE]
            left, right = np.zeros((queries.count, len(w))), np.zeros((len(w), self.docs))
            e, p = ranges(queries.first[w], queries.size[w]), ranges(self.first[t], self.size[t])
            np.add.at(left, (queries.query[e], np.repeat(np.arange(len(w)), queries.size[w])), queries.weight[e])
            right[np.repeat(np.arange(len(w)), self.size[t]), self.doc[p]] = weight[p]
            out += left @ right
        word, tok = word[~many], tok[~many]
        e, t = ranges(queries.first[word], queries.size[word]), np.repeat(tok, queries.size[word])
        used = queries.weight[e] != 0
        e, t = e[used], t[used]
        order = np.argsort(queries.query[e], kind="stable")
        e, t = e[order], t[order]
        total, done = np.cumsum(self.size[t]), 0
        while done < len(t):
            to = max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + PAIRS_AT_ONCE, "right")))
            n, low, high = self.size[t[done:to]], queries.query[e[done]], queries.query[e[to - 1]] + 1
            p = ranges(self.first[t[done:to]], n)
            at = np.repeat((queries.query[e[done:to]] - low) * self.docs, n) + self.doc[p]
            out[low:high] += np.bincount(at, weights=np.repeat(queries.weight[e[done:to]], n) * weight[p], minlength=(high - low) * self.docs).reshape(high - low, self.docs)
            done = to
        return out

    def shared(self, queries: Queries, score: np.ndarray) -> np.ndarray:
        """Where a query and a document have a token in common; ``score`` is the sum for weights of postings that are
        positive wherever the query's are."""
        if (queries.weight > 0).all():
            return score > 0
        other = copy(queries)
        other.weight = np.ones(len(queries.weight))
        return self.scores(other, np.ones(len(self.tok))) > 0


class Queries:
    """The weighted tokens of a block of queries, by token; only those ``kept``, but all queries."""

    def __init__(self, qid: pa.Array, tok: pa.Array, weight: np.ndarray, kept: np.ndarray | None = None) -> None:
        ids = qid.dictionary_encode()
        self.ids, self.count = ids.dictionary, len(ids.dictionary)
        query = ids.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        if kept is not None:
            query, tok, weight = query[kept], tok.filter(pa.array(kept)), weight[kept]
        words = tok.dictionary_encode()
        self.vocabulary = words.dictionary
        number = words.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(number, kind="stable")
        self.query, self.weight = query[order], weight[order]
        self.size = np.bincount(number, minlength=len(self.vocabulary))
        self.first = np.cumsum(self.size) - self.size


def best(score: np.ndarray, take: np.ndarray, ids: np.ndarray, k: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, document and rounded score of the ``k`` best documents of each query (all for None) among those to ``take``;
    ties go to the smaller id."""
    if k is not None and k < score.shape[1]:
        # a row that rounding brings to the k-th score is at most 1e-6 below it
        some = np.where(take, score, -np.inf)
        take = take & (some >= np.partition(some, -k, 1)[:, -k, None] - 1.1e-6)
    q, d = np.nonzero(take)
    s = np.round(score[q, d], 6)
    order = np.lexsort((ids[d], -s, q))
    q, d, s = q[order], d[order], s[order]
    if k is not None:
        keep = np.arange(len(q)) - np.searchsorted(q, q) < k
        q, d, s = q[keep], d[keep], s[keep]
    return q, d, s


def table_of(queries: Queries, ids: np.ndarray, found: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.Table:
    """``qid, id, score`` of the found places."""
    q, d, s = found
    return pa.table({"qid": queries.ids.take(pa.array(q)), "id": pa.array(ids[d]), "score": pa.array(s)})
