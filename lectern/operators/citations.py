"""Citation marks in answers: extract, validate, renumber, split off references, list sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions.text import is_blank, strip


def cited(text: Column, both_styles: bool = False) -> Column:
    """The distinct numbers in ``[n]`` (and ``【n】``), sorted."""
    pattern = r"[\[【](\d+)[\]】]" if both_styles else r"\[(\d+)\]"
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda x: x.cast("int"))))


def validity(text: Column, declared: Column) -> Column:
    """``valid, missing, extra``: declared numbers that the text doesn't cite, and cited ones that aren't declared."""
    actual, said = cited(text), F.array_sort(F.array_distinct(declared))
    missing, extra = F.array_except(said, actual), F.array_except(actual, said)
    return F.struct(((F.size(missing) == 0) & (F.size(extra) == 0)).alias("valid"), missing.alias("missing"), extra.alias("extra"))


def renumbering(used: Column) -> Column:
    """The new number of every used one: 1, 2, ... in ascending order, as a map."""
    order = F.array_sort(F.array_distinct(used))
    return F.map_from_arrays(order, F.transform(order, lambda _, i: (i + 1).cast("int")))


def renumbered(text: Column, used: Column, both_styles: bool = False) -> Column:
    """``text`` with the used numbers replaced by 1, 2, ... in ascending order; a mark right before a digit stays.

    New numbers are put in behind a mark that no text holds, so that one replacement can't meet another's result.
    """
    order = F.array_sort(F.array_distinct(used))
    mark = "\u0001"

    def put(t: Column, old: Column, open_: str, close: str) -> Column:
        new = F.array_position(order, old).cast("string")
        return F.regexp_replace(t, F.concat(F.lit("\\" + open_), old.cast("string"), F.lit("\\" + close + r"(?!\d)")), F.concat(F.lit(open_ + mark), new, F.lit(close)))

    def step(t: Column, old: Column) -> Column:
        t = put(t, old, "[", "]")
        return put(t, old, "【", "】") if both_styles else t

    return F.replace(F.aggregate(order, text, step), F.lit(mark), F.lit(""))


def body_and_references(text: Column) -> tuple[Column, Column]:
    """What stands between 【正文】 and 【参考文献】, and the non-blank lines behind."""
    body = strip(F.regexp_extract(text, r"(?s)【正文】(.*?)(?:【参考文献】|\z)", 1))
    refs = F.filter(F.transform(F.split(F.regexp_extract(text, r"(?s)【参考文献】(.*)\z", 1), "\n"), strip), lambda s: s != "")
    return F.when(text.contains("【正文】"), body).otherwise(strip(text)), refs


def display_sources(hits: DataFrame, sources: DataFrame) -> DataFrame:
    """``qid, number, old, id, source``: evidence of each query (qid, id, rank) in the order of its first place; the
    old number goes along, so that a renumbered answer still finds its sources (sources: id, book, title)."""
    first = hits.groupBy("qid", "id").agg(F.min("rank").alias("old"))
    numbered = first.withColumn("number", F.row_number().over(Window.partitionBy("qid").orderBy("old", "id")))
    book = F.when(is_blank(F.col("book")), "未知来源").otherwise(F.col("book"))
    return numbered.join(sources, "id").select("qid", "number", "old", "id", F.concat(F.lit("《"), book, F.lit("》-"), F.coalesce("title", F.lit(""))).alias("source"))


def formatted(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """``qid, answer, citations``: answers (qid, answer, used) renumbered in both styles, and the sources (qid, old,
    source) of the used numbers in their new order. Answers that use none, or no known number, have an empty list."""
    both = answers.select("qid", renumbered(F.col("answer"), F.col("used"), both_styles=True).alias("answer"), F.explode_outer(renumbering(F.col("used"))).alias("old", "number"))
    placed = both.join(sources, ["qid", "old"], "left")
    entry = F.when(F.col("source").isNotNull(), F.struct("number", "source"))
    return placed.groupBy("qid", "answer").agg(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["source"]).alias("citations"))
