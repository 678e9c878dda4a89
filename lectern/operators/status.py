"""Status tags of evaluations, probes and crawled pages, and the queries built for an evaluation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.text import is_blank


def evaluation_status(answer: Column, hallucinated: Column, failed: Column, tag_hallucination: bool = True) -> Column:
    """``script_error``, ``hallucination_flagged`` (first version only), ``agent_internal_error`` or ``ok``."""
    internal = F.coalesce(answer.contains("抱歉") & answer.contains("错误"), F.lit(False))
    out = F.when(failed, "script_error")
    if tag_hallucination:
        out = out.when(F.coalesce(hallucinated, F.lit(False)), "hallucination_flagged")
    return out.when(internal, "agent_internal_error").otherwise("ok")


def evaluation_query(title: Column, body: Column, most: int = 2000) -> Column:
    """The title, and the body cut to ``most`` characters with a mark where something was cut."""
    cut = F.when(F.char_length(body) > most, F.concat(F.substring(body, 1, most), F.lit("\n\n[...truncated...]"))).otherwise(body)
    return F.when(is_blank(body), title).otherwise(F.concat(title, F.lit("\n\n"), cut))


def probe_status(code: Column, content_type: Column) -> Column:
    """``timeout``, ``blocked``, ``dead``, ``non_html``, ``alive`` or ``error``, in this order."""
    html = F.coalesce(F.lower(content_type).contains("html"), F.lit(False))
    return F.when(code.isNull(), "timeout").when(code.isin(401, 403, 429), "blocked").when(code.isin(404, 410), "dead").when(~html, "non_html").when((code >= 200) & (code < 400), "alive").otherwise("error")


def page_status(markdown: Column, text: Column, error: Column) -> Column:
    """``error``, ``success`` where there is any text, or ``empty_content``."""
    return F.when(error.isNotNull(), "error").when(~is_blank(markdown) | ~is_blank(text), "success").otherwise("empty_content")


def robots_url(url: Column) -> Column:
    """Where the rules of a page's host are."""
    port = F.regexp_extract(url, r"^[a-z]+://[^/?#]*", 0)
    return F.when(port != "", F.concat(port, F.lit("/robots.txt")))
