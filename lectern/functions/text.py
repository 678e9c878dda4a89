"""Text expressions: Unicode stripping, tokens, keywords, prefixes. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no topic, for the question bank and for the knowledge graph.
BANK_STOP_WORDS = ["的", "了", "是", "在", "和", "与", "或", "对", "为", "等", "中", "可以", "将", "具有"]
GRAPH_STOP_WORDS = ["的", "是", "在", "有", "和", "与", "或", "什么", "哪些", "如何", "为什么", "呢", "吗", "啊", "？", "。", "！", "~"]

WORD = "[a-z0-9à-öø-ÿ]+"
HAN = "[一-鿿]"


def strip(text: Column) -> Column:
    """``text`` without Unicode white space at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def is_blank(text: Column) -> Column:
    """Whether ``text`` is null or nothing but Unicode white space."""
    return text.isNull() | (strip(text) == "")


def tokens(text: Column) -> Column:
    """Latin words in lower case, and the bigrams of every run of Chinese characters; repeated ones stay.

    The bigrams are taken in two passes, one from the first character of each run and one from the second.
    """
    low = F.lower(text)
    second = F.regexp_replace(low, f"(^|[^一-鿿]){HAN}", "$1 ")
    pairs = F.lit(f"{HAN}{{2}}")
    return F.concat(F.regexp_extract_all(low, F.lit(WORD), F.lit(0)), F.regexp_extract_all(low, pairs, F.lit(0)), F.regexp_extract_all(second, pairs, F.lit(0)))


def keywords(text: Column, stop: list[str] = BANK_STOP_WORDS) -> Column:
    """Distinct tokens longer than one character that are no stop words."""
    out = F.array(*map(F.lit, stop))
    return F.array_distinct(F.filter(tokens(text), lambda t: (F.char_length(t) > 1) & ~F.array_contains(out, t)))


def prefix(text: Column, most: int, mark: str = "...") -> Column:
    """The first ``most`` characters, and ``mark`` where something was cut."""
    return F.when(F.char_length(text) > most, F.concat(F.substring(text, 1, most), F.lit(mark))).otherwise(text)


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct elements of two arrays; 0 where the first is empty."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when((F.size(a) <= 0) | (either <= 0), 0.0).otherwise(both / either)
