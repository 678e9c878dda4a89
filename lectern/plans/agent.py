"""Plan, execute and verify for a batch of queries: every stage is one plan over all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions.clients import Client, completed, embedded, parsed
from lectern.functions.text import is_blank
from lectern.operators.citations import cited, renumbered
from lectern.operators.retrieval import bm25, nearest
from lectern.sources.scratch import cut_lineage

PLAN = "array<struct<step_id:int, action:string, query:string, top_k:int>>"
VERDICT = "is_sufficient boolean, missing_aspects array<string>, has_hallucination boolean, has_citation_error boolean, next_action string"
#: Fixed value: the answer where none could be made.
APOLOGY = "抱歉，暂时无法回答。"


def default_plan(query: Column, top_k: int = 10) -> Column:
    """Vector search, BM25, synthesis."""
    actions = ("vector_search", "bm25_search", "synthesize")
    return F.array(*(F.struct(F.lit(i).alias("step_id"), F.lit(a).alias("action"), query.alias("query"), F.lit(top_k).alias("top_k")) for i, a in enumerate(actions, 1)))


def planned(asks: DataFrame, client: Client) -> DataFrame:
    """``qid, step_id, action, query, top_k``; a reply that is no plan is replaced by the default one."""
    asked = completed(asks.withColumn("prompt", F.concat(F.lit("plan: "), "query")), "prompt", "reply", client)
    plan = F.coalesce(parsed(F.col("reply"), PLAN), default_plan(F.col("query")))
    usable = F.when(F.exists(plan, lambda s: s["action"].isin("vector_search", "bm25_search")), plan).otherwise(default_plan(F.col("query")))
    return asked.select("qid", F.explode(usable).alias("s")).select("qid", "s.*")


def executed(steps: DataFrame, chunks: DataFrame, vectors: DataFrame | None, client: Client) -> DataFrame:
    """``qid, number, id``: the evidence of each query, steps in their order, each chunk at its first place.

    Steps with an unknown action are left out. Vector search needs ``vectors`` (id, v) of the client's dimension.
    """
    search = steps.where(F.col("query").isNotNull()).withColumn("step", F.concat_ws(":", "qid", "step_id"))
    most = F.coalesce("top_k", F.lit(10))
    words = search.where("action = 'bm25_search'")
    deepest = max(1, words.agg(F.max(most)).first()[0] or 1)
    hits = bm25(chunks, words.select(F.col("step").alias("qid"), "query"), k=deepest).withColumnRenamed("qid", "step").join(words.select("step", "qid", "step_id", most.alias("most")), "step")
    found = hits.where(F.col("rank") <= F.col("most")).select("qid", "step_id", "rank", "id")
    if vectors is not None:
        near = search.where("action = 'vector_search'").select("qid", "step_id", most.alias("most"), embedded(F.col("query"), client).alias("v")).withColumn("ask", F.xxhash64("qid", "step_id"))
        close = nearest(vectors, near.select(F.col("ask").alias("qid"), "v", F.col("most").alias("k"))).withColumnRenamed("qid", "ask").join(near.drop("v"), "ask")
        found = found.unionByName(close.where(F.col("rank") <= F.col("most")).select("qid", "step_id", "rank", "id"))
    first = found.groupBy("qid", "id").agg(F.min(F.struct("step_id", "rank")).alias("at"))
    return first.select("qid", "id", F.row_number().over(Window.partitionBy("qid").orderBy("at", "id")).alias("number"))


def synthesized(asks: DataFrame, evidence: DataFrame, chunks: DataFrame, client: Client) -> DataFrame:
    """``qid, answer, used``: replies to the whole text of all evidence, with their citations renumbered; missing citations count as all evidence."""
    lines = evidence.join(chunks, "id").distinct().select("qid", "number", F.concat(F.lit("["), F.col("number").cast("string"), F.lit("] "), "text").alias("line"))
    context = lines.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", "line"))), lambda x: x["line"]), "\n").alias("context"), F.max("number").alias("n"))
    asked = asks.join(context, "qid", "left").withColumn("prompt", F.concat_ws("\n", "query", "context"))
    reply = parsed(F.col("reply"), "answer string, citations array<int>, missing array<string>")
    out = completed(asked, "prompt", "reply", client).withColumn("r", reply)
    answer = F.coalesce("r.answer", F.lit(APOLOGY))
    every = F.when(F.col("n") > 0, F.sequence(F.lit(1), F.col("n"))).otherwise(F.expr("cast(array() as array<int>)"))
    used = F.coalesce(F.when(F.size("r.citations") > 0, F.col("r.citations")), every)
    return out.select("qid", renumbered(answer, used, both_styles=True).alias("answer"), F.array_sort(F.array_distinct(used)).alias("used"))


def verified(answers: DataFrame, client: Client) -> DataFrame:
    """``qid, next_action, missing``: the verdict on every answer; a reply that is no verdict accepts."""
    asked = completed(answers.withColumn("prompt", F.concat(F.lit("verify: "), "answer")), "prompt", "verdict", client)
    v = parsed(F.col("verdict"), VERDICT)
    return asked.select("qid", F.coalesce(v["next_action"], F.lit("accept")).alias("next_action"), F.coalesce(v["missing_aspects"], F.expr("cast(array() as array<string>)")).alias("missing"))


def answered(asks: DataFrame, chunks: DataFrame, vectors: DataFrame | None, client: Client, most: int = 3, evidence: DataFrame | None = None) -> DataFrame:
    """``qid, answer, used, iterations``: queries whose answer isn't accepted go round again with what was missing.

    ``evidence`` is that of the first round, where it is known already."""
    left, done = asks, None
    for turn in range(1, most + 1):
        found = executed(planned(left, client), chunks, vectors, client) if evidence is None or turn > 1 else evidence
        answers = cut_lineage(synthesized(left, found, chunks, client))
        verdict = verified(answers, client)
        # written, so that a turn's model calls are made once and all that follows sees the same verdicts
        judged = cut_lineage(answers.join(verdict, "qid").withColumn("iterations", F.lit(turn)))
        stop = (F.col("next_action") == "accept") | F.lit(turn == most)
        part = judged.where(stop).select("qid", "answer", "used", "iterations")
        done = part if done is None else done.unionByName(part)
        again = judged.where(~stop).select("qid", F.array_join("missing", " ").alias("more"))
        if turn == most or again.isEmpty():
            break
        left = left.join(again, "qid").select("qid", F.concat_ws(" ", "query", "more").alias("query"))
    return done


def prerequisite_cards(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """``qid, rank, prereq, content``: at most five distinct prerequisites of a query (qid, prereq, chunk), 500 characters each."""
    once = hits.groupBy("qid", "prereq").agg(F.min("chunk").alias("chunk"))
    ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("prereq"))).where("rank <= 5")
    texts = chunks.join(ranked.select("chunk").distinct(), chunks["id"] == F.col("chunk"), "left_semi").distinct()
    return ranked.join(texts, ranked["chunk"] == texts["id"], "left").select("qid", "rank", "prereq", F.substring(F.coalesce("text", F.lit("")), 1, 500).alias("content"))


def question_cards(hits: DataFrame, bank: DataFrame) -> DataFrame:
    """``qid, rank, question, answer, score``: at most three items of a query (qid, id, score, rank), 800 characters each."""
    top = hits.where("rank <= 3").join(bank, "id")
    return top.select("qid", "rank", "question", F.substring(F.coalesce("answer", F.lit("")), 1, 800).alias("answer"), F.round("score", 3).alias("score"))


def used_numbers(answer: Column) -> Column:
    """Citations of an answer, in both bracket styles."""
    return F.when(~is_blank(answer), cited(answer, both_styles=True))


def ordered_subproblems(depends: dict[str, list[str]]) -> list[list[str]]:
    """Sub-problems in waves: each only needs ones of earlier waves. A plan is small, so this is the driver's work.

    Unknown names count as solved; a circle raises.
    """
    left = {k: {d for d in v if d in depends} for k, v in depends.items()}
    waves: list[list[str]] = []
    while left:
        wave = sorted(k for k, v in left.items() if not v)
        if not wave:
            raise ValueError(f"circular: {sorted(left)}")
        waves.append(wave)
        left = {k: v - set(wave) for k, v in left.items() if k not in wave}
    return waves
