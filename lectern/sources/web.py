"""Probing and crawling of addresses through an injected fetcher; the engine itself never opens a connection.

A fetcher is a function ``(method, url) -> Reply`` that is pickled to the executors, and raises where there is no reply.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import NamedTuple
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.operators.status import page_status, probe_status, robots_url


class Reply(NamedTuple):
    """What a fetcher brings; ``text`` and ``markdown`` only for pages."""

    code: int
    url: str = ""
    content_type: str = ""
    text: str = ""
    title: str = ""
    markdown: str = ""


Fetcher = Callable[[str, str], Reply]


def addresses(df: DataFrame, at_once: int) -> DataFrame:
    """The distinct, not-null addresses (url), spread by host, so that one task sees to a host; hosts take ``at_once`` requests."""
    host = F.regexp_extract("url", r"^[a-zA-Z]+://([^/?#]*)", 1)
    return df.select("url").where("url is not null").distinct().repartition(max(1, at_once), host)


def mapped(urls: DataFrame, ask: Callable[[str], tuple], schema: str, at_once: int) -> DataFrame:
    """``ask`` of every address, ``at_once`` of a task's side by side."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(at_once) as pool:
            for batch in batches:
                yield pd.DataFrame(list(pool.map(ask, batch["url"])), columns=names)

    return urls.mapInPandas(run, schema)


def probed(df: DataFrame, fetch: Fetcher, at_once: int = 10) -> DataFrame:
    """``url, final_url, status, http_status, content_type, error`` of every distinct address: HEAD, and GET where that
    brings nothing, 403 or 405."""

    def ask(url: str) -> tuple:
        reply, error = None, None
        for method in ("HEAD", "GET"):
            try:
                reply, error = fetch(method, url), None
            except Exception as e:  # noqa: BLE001
                reply, error = None, str(e) or type(e).__name__
            if reply is not None and reply.code not in (403, 405):
                break
        return (url, reply.url or url, reply.code, reply.content_type, None) if reply else (url, None, None, None, error)

    rows = mapped(addresses(df, at_once), ask, "url string, final_url string, http_status double, content_type string, error string", at_once)
    code = F.when(~F.isnan("http_status"), F.col("http_status")).cast("int")
    return rows.select("url", "final_url", probe_status(code, F.col("content_type")).alias("status"), code.alias("http_status"), "content_type", "error")


def allowed(df: DataFrame, fetch: Fetcher, agent: str = "*", at_once: int = 10) -> DataFrame:
    """The rows of ``df`` (url) that their host's rules allow to ``agent``. The rules of each host are fetched once; where
    they can't be read, nothing of the host is allowed."""
    hosts = df.select(robots_url(F.col("url")).alias("url"))

    def ask(url: str) -> tuple:
        try:
            reply = fetch("GET", url)
        except Exception:  # noqa: BLE001
            return url, None
        return url, reply.text if reply.code < 400 else ""  # no rules, no bans

    rules = mapped(addresses(hosts, at_once), ask, "url string, rules string", at_once).withColumnRenamed("url", "robots").where("rules is not null")

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parsers: dict[str, RobotFileParser] = {}
        for batch in batches:
            marks = []
            for url, robots, text in zip(batch["url"], batch["robots"], batch["rules"], strict=True):
                if robots not in parsers:
                    parsers[robots] = RobotFileParser(robots)
                    parsers[robots].parse(text.splitlines())
                marks.append(parsers[robots].can_fetch(agent, url))
            yield batch.loc[marks, ["url"]]

    asked = df.select("url").distinct().withColumn("robots", robots_url(F.col("url"))).join(rules, "robots").select("url", "robots", "rules")
    return df.join(asked.mapInPandas(keep, "url string"), "url", "left_semi")


def first_pages(df: DataFrame, most: int = 12, order: str = "number") -> DataFrame:
    """The first ``most`` rows in input order: the cap of a crawl, which is its feature."""
    return df.orderBy(order).limit(most)


def crawled(df: DataFrame, fetch: Fetcher, at_once: int = 3) -> DataFrame:
    """``url, status, title, markdown, text, error, elapsed_sec`` of every distinct address; a failure has a row, too."""

    def ask(url: str) -> tuple:
        began = time.monotonic()
        try:
            reply, error = fetch("GET", url), None
        except Exception as e:  # noqa: BLE001
            reply, error = Reply(0), str(e) or type(e).__name__
        return url, reply.title, reply.markdown, reply.text, error, round(time.monotonic() - began, 3)

    rows = mapped(addresses(df, at_once), ask, "url string, title string, markdown string, text string, error string, elapsed_sec double", at_once)
    return rows.select("url", page_status(F.col("markdown"), F.col("text"), F.col("error")).alias("status"), "title", "markdown", "text", "error", "elapsed_sec")


def pages_per_host(df: DataFrame) -> DataFrame:
    """``host, pages, number``: how many addresses each host has, most first."""
    host = F.regexp_extract("url", r"^[a-zA-Z]+://([^/?#]*)", 1)
    counts = df.groupBy(host.alias("host")).agg(F.count_distinct("url").alias("pages"))
    return counts.withColumn("number", F.row_number().over(Window.orderBy(F.desc("pages"), "host")))
