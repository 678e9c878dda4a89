"""All queries of the core, by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lectern.plans import answers, graph, misc, search, textbook

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**search.QUERIES, **graph.QUERIES, **textbook.QUERIES, **misc.QUERIES, **answers.QUERIES}

SQL: dict[str, str] = {**search.SQL, **graph.SQL, **textbook.SQL, **misc.SQL, **answers.SQL}
