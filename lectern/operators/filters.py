"""Boolean keyword filters, edit distance, alignment candidates, summaries of a result."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TERM = re.compile(r'\s*(?:"([^"]*)"|(\()|(\))|([^\s()"]+))')


class BooleanQuery:
    """AND, OR, NOT with parentheses and quoted phrases; AND binds before OR; NOT only behind AND or OR.

    Words side by side without an operator are an error, as are a leading NOT and an empty query.
    """

    def __init__(self, query: str) -> None:
        self.items: list[tuple[str, str]] = []
        at = 0
        while query[at:].strip():
            m = TERM.match(query, at)
            if not m:
                raise ValueError(f"unbalanced quotation in {query!r}")
            at = m.end()
            word = m[4]
            if word in ("AND", "OR", "NOT"):
                self.items.append((word, word))
            elif m[2] or m[3]:
                self.items.append((m[2] or m[3], ""))
            else:
                self.items.append(("term", m[1] if m[1] is not None else word))
        self.at = 0
        self.tree = self._either()
        if self.at < len(self.items):
            raise ValueError(f"an operator is missing in {query!r}")

    def _next(self, *kinds: str) -> bool:
        if self.at < len(self.items) and self.items[self.at][0] in kinds:
            self.at += 1
            return True
        return False

    def _either(self) -> tuple:
        tree = self._both()
        while self._next("OR"):
            tree = ("or", tree, self._negated() if self._next("NOT") else self._both())
        return tree

    def _both(self) -> tuple:
        tree = self._one()
        while self._next("AND"):
            tree = ("and", tree, self._negated() if self._next("NOT") else self._one())
        return tree

    def _negated(self) -> tuple:
        return ("not", self._one())

    def _one(self) -> tuple:
        if self._next("("):
            tree = self._either()
            if not self._next(")"):
                raise ValueError("a parenthesis is open")
            return tree
        if not self._next("term"):
            raise ValueError("a term is missing")
        return ("term", self.items[self.at - 1][1])

    def column(self, text: Column) -> Column:
        """The condition on ``text``, letter case aside; a null text doesn't match."""
        low = F.lower(F.coalesce(text, F.lit("")))

        def build(tree: tuple) -> Column:
            if tree[0] == "term":
                return low.contains(tree[1].lower())
            if tree[0] == "not":
                return ~build(tree[1])
            a, b = build(tree[1]), build(tree[2])
            return a & b if tree[0] == "and" else a | b

        return build(self.tree)


def within_edits(text: Column, word: Column, most: int) -> Column:
    """Whether the edit distance is at most ``most``; lengths that differ by more are ruled out first."""
    return (F.abs(F.char_length(text) - F.char_length(word)) <= most) & (F.levenshtein(text, word) <= most)


def alignment_candidates(names: DataFrame, least: float = 0.6, gram: int = 3) -> DataFrame:
    """``name_a, name_b, jaccard``: pairs of distinct names (name) whose sets of character trigrams are similar.

    Names meet by their trigrams. A pair with the similarity shares one of a name's rarest trigrams: only so many of
    them as could be missing, and one more, are joined (prefix filtering), which keeps frequent trigrams out.
    """
    low = F.lower("name")
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length("name") - gram + 1), lambda i: F.substr(low, i, F.lit(gram))))
    sets = names.select("name").where(F.char_length("name") >= gram).distinct().withColumn("g", grams)
    df = sets.select(F.explode("g").alias("t")).groupBy("t").agg(F.count("*").alias("df"))
    ranked = sets.select("name", F.size("g").alias("n"), F.explode("g").alias("t")).join(df, "t").groupBy("name", "n").agg(F.array_sort(F.collect_list(F.struct("df", "t"))).alias("s"))
    keep = (F.col("n") - F.ceil(F.col("n") * least - F.lit(1e-9)) + 1).cast("int")
    heads = ranked.select("name", F.explode(F.slice("s", F.lit(1), keep)).alias("x")).select("name", "x.t")
    a, b = heads.withColumnRenamed("name", "name_a"), heads.withColumnRenamed("name", "name_b")
    pairs = a.join(b, "t").where("name_a < name_b").select("name_a", "name_b").distinct()
    left, right = sets.select(F.col("name").alias("name_a"), F.col("g").alias("ga")), sets.select(F.col("name").alias("name_b"), F.col("g").alias("gb"))
    both = pairs.join(left, "name_a").join(right, "name_b")
    score = F.size(F.array_intersect("ga", "gb")) / F.size(F.array_union("ga", "gb"))
    return both.withColumn("jaccard", F.round(score, 6)).where(score >= least).select("name_a", "name_b", "jaccard")
