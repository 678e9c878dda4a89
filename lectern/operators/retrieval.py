"""Ranking text and vectors: BM25, TF-IDF cosine, Jaccard, hybrid scores, exact nearest vectors, fusion."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions.text import BANK_STOP_WORDS, jaccard, keywords, tokens
from lectern.operators import scoring as S


def top(df: DataFrame, by: str, k: int | None, score: str = "score", tie: str = "id", ascending: bool = False) -> DataFrame:
    """The ``k`` best rows for each ``by`` with their ``rank``, or all; ties go to the smaller ``tie``."""
    order = F.asc(score) if ascending else F.desc(score)
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(order, F.asc(tie))))
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def postings(docs: DataFrame) -> DataFrame:
    """``id, tok, tf`` of ``docs`` (id, text)."""
    return docs.select("id", F.explode(tokens(F.col("text"))).alias("tok")).groupBy("id", "tok").agg(F.count("*").alias("tf"))


def document_lengths(docs: DataFrame) -> DataFrame:
    """``id, dl``: the number of tokens of each document with a text, 0 included."""
    return docs.where(F.col("text").isNotNull()).select("id", F.size(tokens(F.col("text"))).alias("dl"))


def bm25_idf(docs: DataFrame, epsilon: float = 0.25) -> DataFrame:
    """``tok, df, idf``: ln(N - df + 0.5) - ln(df + 0.5); a negative one becomes ``epsilon`` times the mean of all."""
    df = postings(docs).groupBy("tok").agg(F.count("*").alias("df"))
    n = document_lengths(docs).agg(F.count("*").alias("n"))
    raw = df.crossJoin(F.broadcast(n)).withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw").alias("mean"))
    return raw.crossJoin(F.broadcast(mean)).select("tok", "df", F.when(F.col("raw") < 0, epsilon * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def tokenized(docs: DataFrame, *texts: str) -> DataFrame:
    """``id``, the joined tokens of each text under its name, and ``h``, by which repeated deliveries are told."""
    return docs.select("id", F.xxhash64(*texts).alias("h"), *(S.joined(tokens(F.col(t))).alias(t) for t in texts))


def part_statistics(parts: DataFrame, text: str = "text") -> DataFrame:
    """``part, tok, df``; the null token has the number of documents with a text, and in ``dl`` the number of their tokens."""

    def run(part: pa.Table) -> pa.Table:
        lists = S.lists(S.once(part), text)
        found, rows = S.Postings(lists), len(lists) - lists.null_count
        df, vocabulary = found.size, found.vocabulary.cast(pa.string())
        return pa.table({"part": pa.array([part.column("part")[0].as_py()] * (len(df) + 1), pa.int32()), "tok": pa.concat_arrays([vocabulary, pa.nulls(1, pa.string())]), "df": pa.array(np.append(df, rows)), "dl": pa.array([0] * len(df) + [len(pc.list_flatten(lists))], pa.int64())})

    return parts.groupBy("part").applyInArrow(run, "part int, tok string, df bigint, dl bigint")


def summed(stats: DataFrame) -> DataFrame:
    """The statistics of all parts together."""
    return stats.groupBy("tok").agg(F.sum("df").alias("df"), F.sum("dl").alias("dl"))


def bm25(docs: DataFrame, asks: DataFrame, k: int | None = 10, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> DataFrame:
    """``qid, id, score, rank``: the best ``k`` documents, or all that match, for each query of ``asks`` (qid, query).

    A token that a query repeats counts as often. The documents' tokens are shuffled once, to parts; their statistics
    and their scores are taken there. Null texts take no part; a row delivered again counts once; empty tables give an
    empty result.
    """
    count, asked = docs.count(), asks.count()
    parts = S.dealt(tokenized(docs, "text"), count)
    stats = summed(part_statistics(parts))
    total = stats.where("tok is null").select(F.col("df").alias("n"), (F.col("dl") / F.col("df")).alias("avgdl"))
    raw = stats.where("tok is not null").crossJoin(F.broadcast(total)).withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw").alias("mean"))
    wanted = asks.select("qid", F.explode(tokens(F.col("query"))).alias("tok")).groupBy("qid", "tok").agg(F.count("*").alias("qtf"))
    idf = F.when(F.col("raw") < 0, epsilon * F.col("mean")).otherwise(F.col("raw"))
    weighted = wanted.join(raw, "tok").crossJoin(F.broadcast(mean)).select("qid", "tok", (F.col("qtf") * idf).alias("v"), "avgdl")

    def run(part: pa.Table, _: pa.Table) -> Callable[[pa.Table], pa.Table]:
        part = S.once(part)
        lists, ids = S.lists(part, "text"), S.column(part, "id").to_numpy()
        found, dl = S.Postings(lists), np.nan_to_num(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.float64))

        @cache
        def weights(average: float) -> np.ndarray:
            return found.count * (k1 + 1) / (found.count + k1 * (1 - b + b * dl[found.doc] / average))

        def answer(block: pa.Table) -> pa.Table:
            queries = S.Queries(S.column(block, "qid"), S.column(block, "tok"), S.column(block, "v").to_numpy())
            score = found.scores(queries, weights(block.column("avgdl")[0].as_py()))
            return S.table_of(queries, ids, S.best(score, found.shared(queries, score), ids, k))

        return answer

    return top(S.met(parts, weighted, count, asked, run, scored_schema(docs, asks)), "qid", k)


def scored_schema(docs: DataFrame, asks: DataFrame) -> str:
    """The schema of scores, with the keys' own types."""
    return f"qid {asks.schema['qid'].dataType.simpleString()}, id {docs.schema['id'].dataType.simpleString()}, score double"


def tfidf_idf(docs: DataFrame, least: int = 2) -> DataFrame:
    """``tok, df, idf`` of the words in at least ``least`` documents: ln(N / (df + 1)), negative if in all."""
    n = docs.where(F.col("text").isNotNull()).agg(F.count("*").alias("n"))
    df = postings(docs).groupBy("tok").agg(F.count("*").alias("df")).where(F.col("df") >= least)
    return df.crossJoin(F.broadcast(n)).select("tok", "df", F.log(F.col("n") / (F.col("df") + 1)).alias("idf"))


def query_words(asks: DataFrame) -> DataFrame:
    """``qid, tok, n, keyword``: the tokens of each query with their number, and whether they are keywords."""
    words = asks.select("qid", F.explode(tokens(F.col("query"))).alias("tok")).groupBy("qid", "tok").agg(F.count("*").alias("n"))
    return words.withColumn("keyword", (F.char_length("tok") > 1) & ~F.col("tok").isin(BANK_STOP_WORDS))


def weighted_words(parts: DataFrame, asks: DataFrame, least: int, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The words of the queries with their ``idf`` (null for one outside the vocabulary), and those of each part."""
    stats = part_statistics(parts, text)
    total = summed(stats)
    n = total.where("tok is null").select(F.col("df").alias("n"))
    idf = total.where((F.col("df") >= least) & F.col("tok").isNotNull()).crossJoin(F.broadcast(n)).select("tok", F.log(F.col("n") / (F.col("df") + 1)).alias("idf"))
    own = stats.where("tok is not null").select("part", "tok").join(idf, "tok")
    return query_words(asks).join(idf, "tok", "left"), own


class Cosines:
    """Token lists with the weights of the part's own words."""

    def __init__(self, lists: pa.Array, own: pa.Table) -> None:
        self.found = S.Postings(lists)
        place = pc.index_in(self.found.vocabulary, value_set=S.column(own, "tok"))
        idf = np.append(S.column(own, "idf").to_numpy(), 0.0)[pc.fill_null(place, own.num_rows).to_numpy()]
        self.weight = self.found.count * idf[self.found.tok]
        norm = np.sqrt(np.bincount(self.found.doc, weights=self.weight**2, minlength=len(lists)))
        self.norm = np.where(norm > 0, norm, 1.0)

    def to(self, block: pa.Table) -> tuple[S.Queries, np.ndarray, np.ndarray]:
        """The queries of a block, their cosines with the lists, and where they have a common word of the vocabulary."""
        idf, n = (S.column(block, c).to_numpy(zero_copy_only=False).astype(np.float64) for c in ("idf", "n"))
        queries = S.Queries(S.column(block, "qid"), S.column(block, "tok"), n * idf, ~np.isnan(idf))
        length = np.sqrt(np.bincount(queries.query, weights=queries.weight**2, minlength=queries.count))
        dot = self.found.scores(queries, self.weight)
        shared = self.found.shared(queries, dot) & (length > 0)[:, None]
        return queries, dot / np.where(length > 0, length, 1.0)[:, None] / self.norm, shared


class Overlaps:
    """Token lists by their keywords."""

    def __init__(self, lists: pa.Array) -> None:
        self.found = S.Postings(lists)
        words = self.found.vocabulary
        keyword = pc.and_(pc.greater(pc.utf8_length(words), 1), pc.invert(pc.is_in(words, value_set=pa.array(BANK_STOP_WORDS)))).to_numpy(zero_copy_only=False)
        self.weight = keyword[self.found.tok].astype(np.float64)
        self.size = np.bincount(self.found.doc, weights=self.weight, minlength=len(lists))

    def to(self, block: pa.Table) -> tuple[S.Queries, np.ndarray, np.ndarray]:
        """The queries of a block, the Jaccard similarities of their keywords and of the lists, and where they share one."""
        keyword = S.column(block, "keyword").to_numpy(zero_copy_only=False)
        queries = S.Queries(S.column(block, "qid"), S.column(block, "tok"), np.ones(block.num_rows), keyword)
        both = self.found.scores(queries, self.weight)
        asked = np.bincount(queries.query, minlength=queries.count)
        return queries, both / np.maximum(asked[:, None] + self.size - both, 1), both > 0


def tfidf_cosine(docs: DataFrame, asks: DataFrame, k: int | None = None, least: int = 2) -> DataFrame:
    """``qid, id, score, rank``: the ``k`` documents, or all, that share a word of the vocabulary with the query, by cosine."""
    count, asked = docs.count(), asks.count()
    parts = S.dealt(tokenized(docs, "text"), count)
    words, own = weighted_words(parts, asks, least)

    def run(part: pa.Table, rows: pa.Table) -> Callable[[pa.Table], pa.Table]:
        part = S.once(part)
        ids, near = S.column(part, "id").to_numpy(), Cosines(S.lists(part, "text"), rows)

        def answer(block: pa.Table) -> pa.Table:
            queries, cos, shared = near.to(block)
            return S.table_of(queries, ids, S.best(cos, shared, ids, k))

        return answer

    return top(S.met(parts, words, count, asked, run, scored_schema(docs, asks), own), "qid", k)


def keyword_overlap(docs: DataFrame, asks: DataFrame, k: int | None = None) -> DataFrame:
    """``qid, id, score, rank``: the ``k`` documents, or all, that share a keyword, by the similarity of the keyword sets."""
    count, asked = docs.count(), asks.count()
    parts = S.dealt(tokenized(docs, "text"), count)

    def run(part: pa.Table, _: pa.Table) -> Callable[[pa.Table], pa.Table]:
        part = S.once(part)
        ids, near = S.column(part, "id").to_numpy(), Overlaps(S.lists(part, "text"))

        def answer(block: pa.Table) -> pa.Table:
            queries, score, shared = near.to(block)
            return S.table_of(queries, ids, S.best(score, shared, ids, k))

        return answer

    return top(S.met(parts, query_words(asks), count, asked, run, scored_schema(docs, asks)), "qid", k)


def named_in(chapters: pa.Array, queries: S.Queries) -> np.ndarray:
    """Where a keyword of the query (weight 1) is part of the document's chapter (queries x documents)."""
    coded = chapters.dictionary_encode()
    some, which = coded.dictionary.to_pylist(), coded.indices
    words, hit = queries.vocabulary.to_pylist(), np.zeros((queries.count, len(some) + 1), bool)
    asking = queries.query[queries.weight > 0]
    word = np.repeat(np.arange(len(words)), queries.size)[queries.weight > 0]
    for c, chapter in enumerate(some):
        inside = np.array([w in chapter for w in words], bool)
        hit[asking[inside[word]], c] = True
    return hit[:, pc.fill_null(which, len(some)).to_numpy()]


def hybrid(bank: DataFrame, asks: DataFrame, k: int = 10, floor: float = 0.05) -> DataFrame:
    """``qid, id, score, rank`` over ``bank`` (id, question, chapter, answer): half cosine, 0.3 keyword overlap of the
    question, 0.2 of 0.8 times that of the answer's first 500 characters, 0.05 for a chapter that a keyword names, at
    most 1. All parts of the score are added up where the item is; only the best are shuffled."""
    empty = F.lit("")
    start = F.substring("answer", 1, 500)
    text = F.concat_ws(" ", F.coalesce("question", empty), F.coalesce("chapter", empty), F.coalesce(start, empty))
    count, asked = bank.count(), asks.count()
    whole = bank.select("id", F.xxhash64(text, "question", start).alias("h"), S.joined(tokens(text)).alias("text"), S.joined(tokens(F.col("question"))).alias("question"), S.joined(tokens(start)).alias("answer"), F.col("chapter").alias("name"))
    parts = S.dealt(whole, count)
    words, own = weighted_words(parts, asks, 2)

    def run(part: pa.Table, rows: pa.Table) -> Callable[[pa.Table], pa.Table]:
        part = S.once(part)
        ids, near, name = S.column(part, "id").to_numpy(), Cosines(S.lists(part, "text"), rows), S.column(part, "name")
        keyed = [(Overlaps(S.lists(part, text)), share) for text, share in (("question", 0.3), ("answer", 0.2 * 0.8))]

        def answer(block: pa.Table) -> pa.Table:
            _, cos, shared = near.to(block)
            score = 0.5 * np.where(shared, cos, 0.0)
            for own, share in keyed:
                queries, jaccard_, _ = own.to(block)
                score += share * jaccard_
            score = np.minimum(1.0, score + 0.05 * named_in(name, queries))
            return S.table_of(queries, ids, S.best(score, np.round(score, 6) >= floor, ids, k))

        return answer

    return top(S.met(parts, words, count, asked, run, scored_schema(bank, asks), own), "qid", k)


def contained(short: DataFrame, long: DataFrame) -> DataFrame:
    """``t, name`` of the distinct, non-empty ``t`` and ``name`` where the name contains ``t``.

    Both meet in one pair of neighbouring characters: that of ``t`` which the fewest names have. So no list is sent
    to all others, and the containment is tested on few pairs.
    """
    names = long.select("name").where("name <> ''").distinct()
    gram = "transform(sequence(1, greatest(char_length({0}) - 1, 1)), i -> substring({0}, i, 2))"
    pairs = names.select("name", F.explode(F.array_distinct(F.expr(f"concat({gram.format('name')}, split(name, ''))"))).alias("gram"))
    asked = short.select("t").where("t <> ''").distinct().select("t", F.explode(F.array_distinct(F.expr(gram.format("t")))).alias("gram"))
    counts = pairs.groupBy("gram").agg(F.count("*").alias("n"))
    # a gram that no name has rules the word out
    rare = asked.join(counts, "gram", "left").groupBy("t").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r")).where("r.n > 0").select("t", F.col("r.gram").alias("gram"))
    return rare.join(pairs, "gram").where(F.col("name").contains(F.col("t"))).select("t", "name")


def either_contains(words: DataFrame, names: DataFrame) -> DataFrame:
    """``t, name``, each pair once, where one of the two contains the other."""
    inside = contained(words, names)
    around = contained(names.select(F.col("name").alias("t")), words.select(F.col("t").alias("name")))
    return inside.unionByName(around.select(F.col("name").alias("t"), F.col("t").alias("name"))).distinct()


def suggestions(bank: DataFrame, asks: DataFrame, k: int = 5) -> DataFrame:
    """``qid, tok, n, rank``: the most frequent keywords of the bank that contain a keyword of the query or are part
    of one, without the query's own."""
    counts = bank.select(F.explode(F.filter(tokens(F.col("question")), lambda t: F.char_length(t) > 1)).alias("tok")).groupBy("tok").agg(F.count("*").alias("n"))
    words = asks.select("qid", F.explode(keywords(F.col("query"))).alias("t"))
    near = either_contains(words, counts.select(F.col("tok").alias("name"))).where("t <> name").withColumnRenamed("name", "tok").join(counts, "tok")
    found = words.join(near, "t").select("qid", "tok", "n").distinct()
    own = words.select("qid", F.col("t").alias("tok"))
    return top(found.join(own, ["qid", "tok"], "left_anti"), "qid", k, "n", "tok")


def valid(vectors: DataFrame, dim: int = 96) -> DataFrame:
    """Vectors of the right length that aren't all zero, each id once (``id, v``)."""
    return vectors.where((F.size("v") == dim) & F.exists("v", lambda x: x != 0)).groupBy("id").agg(F.first("v").alias("v"))


def best_of_batch(q: np.ndarray, x: np.ndarray, own: np.ndarray, k: int, cells: int = 2_000_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions in ``q`` and ``x`` and the squared distance of the ``k`` best rows of each query, by (distance rounded
    to 6 decimals, id ``own``).

    The distances by matrix product only bound the search: every row that rounding may bring to the k-th distance or
    below is compared exactly, however many tie there. At most about ``cells`` distances are held at once.
    """
    xx = (x**2).sum(1)
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    step, pairs = max(1, cells // max(1, len(x))), max(1, cells // 10)
    for at in range(0, len(q), step):
        part = q[at : at + step]
        qq = (part**2).sum(1)
        d = qq[:, None] + xx[None] - 2 * part @ x.T
        if k < len(x):
            # a row of the same rounded distance is at most 1e-6 farther; the rest is for the product's rounding
            bound = np.partition(d, k - 1, 1)[:, k - 1] + 2e-6 + 1e-11 * (qq + np.fmax.reduce(xx))
            a, b = np.nonzero(~(d > bound[:, None]))
        else:
            a, b = np.indices(d.shape).reshape(2, -1)
        exact = [((part[a[i : i + pairs]] - x[b[i : i + pairs]]) ** 2).sum(1) for i in range(0, len(a), pairs)]
        e = np.round(np.concatenate([np.zeros(0), *exact]), 6)
        order = np.lexsort((own[b], e, a))
        a, b, e = a[order], b[order], e[order]
        keep = np.arange(len(a)) - np.searchsorted(a, a) < k
        found.append((a[keep] + at, b[keep], e[keep]))
    a, b, e = (np.concatenate(c) for c in zip(*found, strict=True))
    return a, b, e


def nearest(vectors: DataFrame, asks: DataFrame, k: int = 10, size: int = 50_000, block: int = 1_000) -> DataFrame:
    """``qid, id, dist, rank``: exact squared L2 distances of the queries (qid, v) to all ``vectors`` (id, v).

    Every part of about ``size`` vectors meets every block of about ``block`` queries, and gives on its own ``k`` best of
    each query. If ``asks`` has a column ``k``, its largest counts.
    """
    count, asked = vectors.count(), asks.count()
    if "k" in asks.columns:
        k = max(1, asks.agg(F.max("k")).first()[0] or 1)

    def rows(table: pa.Table, key: str) -> tuple[pa.Array, np.ndarray]:
        ids = S.column(table, key)
        return ids, np.array(pc.list_flatten(S.column(table, "v")), np.float64).reshape(len(ids), -1 if len(ids) else 0)

    def run(part: pa.Table, _: pa.Table) -> Callable[[pa.Table], pa.Table]:
        ids, x = rows(part, "id")

        def answer(block: pa.Table) -> pa.Table:
            qids, q = rows(block, "qid")
            row, near, dist = best_of_batch(q, x, ids.to_numpy(), k)
            return pa.table({"qid": qids.take(pa.array(row)), "id": ids.take(pa.array(near)), "dist": pa.array(dist)})

        return answer

    schema = f"qid {asks.schema['qid'].dataType.simpleString()}, id {vectors.schema['id'].dataType.simpleString()}, dist double"
    found = S.met(S.dealt(vectors.select("id", "v"), count, size=size), asks.select("qid", "v"), count, asked, run, schema, size=size, block=block)
    return top(found, "qid", k, "dist", "id", ascending=True)


def fused(first: DataFrame, second: DataFrame) -> DataFrame:
    """``qid, id, number``: both rankings (qid, id, rank) one after the other, each id once at its first place."""
    every = first.select("qid", "id", F.lit(0).alias("s"), "rank").unionByName(second.select("qid", "id", F.lit(1).alias("s"), "rank"))
    once = every.groupBy("qid", "id").agg(F.min(F.struct("s", "rank")).alias("at"))
    return once.select("qid", "id", F.row_number().over(Window.partitionBy("qid").orderBy("at", "id")).alias("number"))


def best_score(first: DataFrame, second: DataFrame) -> DataFrame:
    """``qid, id, score``: the larger score of an id that both rankings have."""
    return first.select("qid", "id", "score").unionByName(second.select("qid", "id", "score")).groupBy("qid", "id").agg(F.max("score").alias("score"))


def overlap(question: Column, text: Column) -> Column:
    """Keyword Jaccard of two text columns of one row."""
    return jaccard(keywords(question), keywords(text))
