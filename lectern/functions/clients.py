"""Model calls behind a small interface, with a stand-in that needs no network and always says the same."""

from __future__ import annotations

import hashlib
import json
import os
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.operators.graph import ALGORITHM_CONCEPTS
from lectern.operators.textbook import FAILED


class Client(Protocol):
    """What a provider offers; instances are pickled to the executors, so connections are opened on first use."""

    def complete(self, prompt: str) -> str: ...

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class OfflineClient:
    """Deterministic stand-in: hashed bags of character bigrams as vectors, a plan and answers made of the prompt."""

    def __init__(self, dim: int = 96) -> None:
        self.dim = dim

    def embed(self, texts: list[str]) -> list[list[float]]:
        """Unit vectors; a text without a bigram gets the first axis."""
        out = []
        for t in texts:
            v = np.zeros(self.dim)
            for i in range(len(t) - 1):
                h = int.from_bytes(hashlib.blake2b(t[i : i + 2].lower().encode(), digest_size=4).digest(), "big")
                v[h % self.dim] += 1 if h & (1 << 31) else -1
            n = np.linalg.norm(v)
            out.append((v / n if n else np.eye(1, self.dim)[0]).tolist())
        return out

    def complete(self, prompt: str) -> str:
        """JSON with an answer that cites the first evidence line, if the prompt has one."""
        if prompt.startswith("recommend: "):
            named = [c for c in ALGORITHM_CONCEPTS if c in prompt]
            return json.dumps({"recommend_prerequisite": bool(named), "recommend_qa_bank": len(prompt) > 60, "detected_concepts": named, "reason": "offline"}, ensure_ascii=False)
        cites = [1] if "\n[1]" in prompt else []
        return json.dumps({"answer": "According to the sources" + "".join(f" [{c}]" for c in cites) + ".", "citations": cites, "missing": []}, ensure_ascii=False)


def embedded(text: Column, client: Client, batch: int = 16) -> Column:
    """Vectors of a text column, ``batch`` texts a call."""

    @F.pandas_udf("array<double>")
    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in series:
            texts = s.fillna("").tolist()
            yield pd.Series([v for i in range(0, len(texts), batch) for v in client.embed(texts[i : i + batch])])

    return run(text)


def completed(df: DataFrame, prompt: str, out: str, client: Client, tries: int = 3, fallback: str = "", wait: float = 0.0, pause: float = 0.0) -> DataFrame:
    """``df`` with the client's reply to ``prompt``; after ``tries`` failures the fallback stands there.

    Before the n-th new try ``wait`` times 2 to the power of n seconds go by, and ``pause`` seconds after each row; both are
    off by default.
    """

    @F.pandas_udf("string")
    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def ask(text: str) -> str:
            out = fallback
            for n in range(tries):
                try:
                    out = client.complete(text)
                    break
                except Exception:  # noqa: BLE001
                    if n + 1 < tries:
                        time.sleep(wait * 2**n)
            time.sleep(pause)
            return out

        for s in series:
            yield s.fillna("").map(ask)

    return df.withColumn(out, run(F.col(prompt)))


def answers_to(df: DataFrame, question: str, out: str, client: Client, tries: int = 3, wait: float = 1.0, pause: float = 2.0) -> DataFrame:
    """``df`` with an answer to each question and ``out`` + "_meta", its time; questions without one get the failure mark."""
    asked = completed(df, question, out, client, tries, FAILED, wait, pause)
    return asked.withColumn(f"{out}_meta", F.struct(F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss").alias("generated_at")))


def book_metadata(books: DataFrame, client: Client, most: int = 2000) -> DataFrame:
    """``name, metadata``: title, author, year and extra of each text (name, text), asked of its first ``most`` lines, as is
    the rule; a reply that isn't an object gives blanks."""
    start = F.array_join(F.slice(F.split("text", "\r?\n"), 1, most), "\n")
    asked = completed(books.withColumn("prompt", F.concat(F.lit("metadata: "), start)), "prompt", "reply", client)
    m = parsed(F.col("reply"), "title string, author string, year string, extra string")
    return asked.select("name", F.create_map(*[x for k in ("title", "author", "year", "extra") for x in (F.lit(k), F.coalesce(m[k], F.lit("")))]).alias("metadata"))


def parsed(reply: Column, schema: str) -> Column:
    """The JSON of a reply, with or without a code fence around it; null where it doesn't parse. Nothing is evaluated."""
    bare = F.regexp_replace(reply, r"(?s)^\s*```(?:json)?\s*|\s*```\s*$", "")
    return F.from_json(bare, schema)


def parsed_list(reply: Column) -> Column:
    """A list of strings from a reply; a reply that is no list is its only element."""
    return F.coalesce(parsed(reply, "array<string>"), F.array(reply))


#: Parts of the hosts whose addresses lack the path of the chat endpoint, and the path.
CHAT_HOSTS = ("dmxapi", "siliconflow", "deepseek")
CHAT_PATH = "/chat/completions"


def settings_of(path: str) -> dict:
    """The settings of a JSON file, or of a YAML file where a reader for it is installed; {} where there is no file."""
    if not os.path.exists(path):
        return {}
    with open(path, encoding="utf-8") as f:
        if path.endswith(".json"):
            return json.load(f) or {}
        import yaml

        return yaml.safe_load(f) or {}


def configured(settings: dict, section: str, defaults: dict | None = None, **overrides: object) -> dict:
    """The options of the provider that ``section`` uses: the first of a list of providers, the section's ``use``
    otherwise. Defaults come first, then the settings, then what is given here; empty values are dropped. A known host's
    address gets its path. Keys stay in memory only."""
    part = settings.get(section) or {}
    provider: object = part.get("provider")
    if isinstance(provider, dict) and isinstance(provider.get(part.get("use")), dict | list):
        provider = provider[part["use"]]
    if isinstance(provider, list):
        provider = provider[0] if provider else {}
    merged = {**(defaults or {}), **{k: v for k, v in (provider or {}).items() if v is not None}, **{k: v for k, v in overrides.items() if v is not None}}
    for name in ("url", "api_base"):
        url = merged.get(name)
        if isinstance(url, str) and any(h in url for h in CHAT_HOSTS) and not url.rstrip("/").endswith(CHAT_PATH):
            merged[name] = url.rstrip("/") + CHAT_PATH
    return {k: v for k, v in merged.items() if v is not None}


def decision(reply: Callable | Column) -> Column:
    """A recommendation with defaults for what is missing; a reply that doesn't parse recommends nothing."""
    d = parsed(reply, "recommend_prerequisite boolean, recommend_qa_bank boolean, detected_concepts array<string>, reason string")
    empty = F.expr("cast(array() as array<string>)")
    return F.struct(
        F.coalesce(d["recommend_prerequisite"], F.lit(False)).alias("recommend_prerequisite"), F.coalesce(d["recommend_qa_bank"], F.lit(False)).alias("recommend_qa_bank"),
        F.coalesce(d["detected_concepts"], empty).alias("detected_concepts"), F.coalesce(d["reason"], F.lit("")).alias("reason"),
    )
