"""Queries of citations, status tags, filters and summaries with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import tokens
from lectern.operators import citations as C
from lectern.operators import filters as X
from lectern.operators import graph as G
from lectern.operators import status as S
from lectern.operators.retrieval import bm25
from lectern.plans.graph import _EDGES, _ENTITIES, edges
from lectern.plans.search import _BANK, _BM25, _CHUNKS, _SOURCES, _sources, _tok, asks, bank, chunks, delivered
from lectern.plans.textbook import _strip
from lectern.sources.tables import table


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    # each answer cites its own number and the numbers 3 and 5 behind it, so that every row has something to renumber
    b = bank(spark, sf_dir).where(F.col("answer").isNotNull())
    own = (F.col("id") % 9 + 1).cast("int")
    text = F.concat("answer", F.lit(" [5][3]7 [3]【"), own.cast("string"), F.lit("】2【"), own.cast("string"), F.lit("】"))
    return b.select("id", text.alias("text"), F.array(F.lit(3), F.lit(5), own).alias("used"))


def citation_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers that answers cite."""
    return _answers(spark, sf_dir).select("id", F.array_join(C.cited(F.col("text")).cast("array<string>"), ",").alias("cited"))


def citation_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cited against declared numbers."""
    v = C.validity(F.col("text"), F.col("used"))
    out = _answers(spark, sf_dir).select("id", v.alias("v"))
    return out.select("id", "v.valid", F.array_join(F.col("v.missing").cast("array<string>"), ",").alias("missing"), F.array_join(F.col("v.extra").cast("array<string>"), ",").alias("extra"))


def citation_renumber(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with citations renumbered, in both bracket styles."""
    return _answers(spark, sf_dir).select("id", C.renumbered(F.col("text"), F.col("used"), both_styles=True).alias("text"))


def citation_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies and numbers of references of answers laid out in two parts."""
    b = bank(spark, sf_dir).where(F.col("answer").isNotNull() & F.col("question").isNotNull())
    body, refs = C.body_and_references(F.concat(F.lit("【正文】"), "answer", F.lit("\n【参考文献】\n"), "question"))
    return b.select("id", body.alias("body"), F.size(refs).alias("refs"))


def citation_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbered sources of every query's evidence."""
    sources = _sources(spark, sf_dir).drop("snippet").distinct()
    return C.display_sources(bm25(delivered(spark, sf_dir), asks(spark, sf_dir)), sources)


def eval_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both status tags of every answered item; an item without a type counts as flagged, one without a question as failed."""
    raw = table(spark, sf_dir, "answered_questions").select("qa_id", "ex_type", "question", "answer").distinct()
    flagged, failed = F.col("ex_type").isNull(), F.col("question").isNull()
    return raw.select("qa_id", S.evaluation_status(F.col("answer"), flagged, failed).alias("v1"), S.evaluation_status(F.col("answer"), flagged, failed, False).alias("v2"))


def query_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation queries made of document titles and texts."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", S.evaluation_query(F.coalesce("title", F.lit("")), F.col("text")).alias("query"))


def _probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    codes = F.array(*map(F.lit, (200, 301, 403, 404, 410, 429, 500)))
    code = F.when(k % 11 != 0, F.element_at(codes, (k % 7 + 1).cast("int")))
    return table(spark, sf_dir, "events").select("event_id", "event_type", code.alias("code"), F.when(k % 5 == 0, "application/pdf").otherwise("text/html; charset=utf-8").alias("content_type"))


def probe_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of every event taken as a probe (code and content type come from its number)."""
    return _probes(spark, sf_dir).select("event_id", S.probe_status(F.col("code"), F.col("content_type")).alias("status"))


def probe_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probes by type and status."""
    p = _probes(spark, sf_dir)
    return p.groupBy("event_type", S.probe_status(F.col("code"), F.col("content_type")).alias("status")).agg(F.count("*").alias("n"))


def page_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of every document taken as a crawled page; a missing source counts as an error."""
    docs = table(spark, sf_dir, "documents")
    error = F.when(F.col("source").isNull(), "unreachable")
    return docs.select("doc_id", S.page_status(F.col("text"), F.col("title"), error).alias("status"))


def robots_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of the rules of the documents' hosts."""
    docs = table(spark, sf_dir, "documents")
    url = F.concat(F.lit("https://"), F.coalesce("lang", F.lit("xx")), F.lit(".example.org/"), F.coalesce("source", F.lit("")))
    return docs.select(S.robots_url(url).alias("robots")).distinct()


def boolean_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that a keyword formula selects."""
    q = X.BooleanQuery('("hash table" OR 散列表) AND NOT (链表 OR "skip list")')
    return chunks(spark, sf_dir).where(q.column(F.col("text"))).select("id")


def exact_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that hold a phrase letter by letter."""
    return chunks(spark, sf_dir).where(F.col("text").contains("扫描边界顶点")).select("id")


def edit_distance_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities within two edits of a concept's name."""
    names = G.entities(edges(spark, sf_dir)).select("name")
    concepts = table(spark, sf_dir, "concept_mapping").select("concept").distinct()
    return names.join(F.broadcast(concepts), X.within_edits(F.col("name"), F.col("concept"), 2)).select("name", "concept")


def alignment_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of entities with similar names."""
    return X.alignment_candidates(G.entities(edges(spark, sf_dir)).select("name"))


def observation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, sources and length of the documents by language."""
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy("lang").agg(F.count("*").alias("size"), F.count_distinct("source").alias("sources"), F.coalesce(F.sum(F.char_length("text")), F.lit(0)).alias("chars"), F.count_if(F.col("text").isNull()).alias("missing"))


def observation_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most frequent tokens of the documents of each language."""
    docs = table(spark, sf_dir, "documents").where("lang is not null")
    counts = docs.select("lang", F.explode(tokens(F.col("text"))).alias("tok")).where(F.char_length("tok") > 1).groupBy("lang", "tok").agg(F.count("*").alias("n"))
    from lectern.operators.retrieval import top

    return top(counts, "lang", 10, "n", "tok")


def counting_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many distinct titles are about each concept."""
    titles = table(spark, sf_dir, "refined_document_chunks").where(F.col("title").isNotNull()).select(F.trim("title").alias("title")).distinct()
    concepts = table(spark, sf_dir, "concept_mapping").select(F.col("prereq").alias("term")).distinct()
    return titles.join(F.broadcast(concepts), F.col("title").contains(F.col("term"))).groupBy("term").agg(F.count("*").alias("titles"))


def search_result_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of each query."""
    return bm25(delivered(spark, sf_dir), asks(spark, sf_dir)).groupBy("qid").agg(F.count("*").alias("hits"))


def cache_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cache names of the documents' sources: name and the first eight hex digits of its MD5."""
    docs = table(spark, sf_dir, "documents").where(F.col("source").isNotNull())
    return docs.select("source", F.concat_ws("_", F.regexp_replace("source", r"\.[^.]*$", ""), F.substring(F.md5("source"), 1, 8)).alias("name")).distinct()


_ANS = "ans AS (SELECT id, answer || ' [5][3]7 [3]【' || (id % 9 + 1) || '】2【' || (id % 9 + 1) || '】' AS text, list_sort(list_distinct([3, 5, id % 9 + 1])) AS used FROM bank WHERE answer IS NOT NULL)"
_CITED = "list_sort(list_distinct(list_transform(regexp_extract_all(text, '\\[(\\d+)\\]', 1), lambda x: x::BIGINT)))"
_P = "p AS (SELECT event_id, event_type, (props->>'$.k')::INT AS k FROM events), pr AS (SELECT event_id, event_type, CASE WHEN k % 11 <> 0 THEN [200, 301, 403, 404, 410, 429, 500][k % 7 + 1] END AS code, k % 5 <> 0 AS html FROM p)"
_PS = "CASE WHEN code IS NULL THEN 'timeout' WHEN code IN (401, 403, 429) THEN 'blocked' WHEN code IN (404, 410) THEN 'dead' WHEN NOT html THEN 'non_html' WHEN code >= 200 AND code < 400 THEN 'alive' ELSE 'error' END"
_INTERNAL = "CASE WHEN contains(answer, '抱歉') AND contains(answer, '错误') THEN 'agent_internal_error' ELSE 'ok' END"

QUERIES = {
    f.__name__: f
    for f in (
        citation_extract, citation_validate, citation_renumber, citation_body, citation_display, eval_status, query_build, probe_status, probe_counts, page_status, robots_urls, boolean_filter, exact_fetch,
        edit_distance_filter, alignment_candidates, observation_summary, observation_keywords, counting_question, search_result_counts, cache_names,
    )
}

SQL = {
    "citation_extract": f"WITH {_BANK}, {_ANS} SELECT id, array_to_string({_CITED}, ',') AS cited FROM ans",
    "citation_validate": f"""WITH {_BANK}, {_ANS}, c AS (SELECT id, used, {_CITED} AS cited FROM ans), d AS (SELECT id, list_filter(used, lambda x: NOT list_contains(cited, x)) AS missing, list_filter(cited, lambda x: NOT list_contains(used, x)) AS extra FROM c)
SELECT id, len(missing) = 0 AND len(extra) = 0 AS valid, array_to_string(missing, ',') AS missing, array_to_string(extra, ',') AS extra FROM d""",
    # a mark right before a digit stays: such marks are kept apart by characters that no text has
    "citation_renumber": f"""WITH {_BANK}, {_ANS}, apart AS (SELECT id, used, regexp_replace(text, '([\\]】])(\\d)', '\\1' || chr(2) || '\\2', 'g') AS text FROM ans),
r AS (WITH RECURSIVE s AS (SELECT id, text, used, 0 AS k FROM apart UNION ALL SELECT id, replace(replace(replace(replace(text, '[' || used[k + 1] || ']' || chr(2), '[' || used[k + 1] || chr(3) || ']' || chr(2)), '[' || used[k + 1] || ']', '[' || chr(1) || (k + 1) || ']'),
  '【' || used[k + 1] || '】' || chr(2), '【' || used[k + 1] || chr(3) || '】' || chr(2)), '【' || used[k + 1] || '】', '【' || chr(1) || (k + 1) || '】'), used, k + 1 FROM s WHERE k < len(used)) SELECT * FROM s WHERE k = len(used))
SELECT id, replace(replace(replace(text, chr(1), ''), chr(2), ''), chr(3), '') AS text FROM r""",
    "citation_body": f"""WITH {_BANK} SELECT id, {_strip('answer')} AS body, len(list_filter(list_transform(string_split(question, chr(10)), lambda s: {_strip('s')}), lambda s: s <> '')) AS refs FROM bank WHERE answer IS NOT NULL AND question IS NOT NULL""",
    "citation_display": f"""WITH {_BANK}, {_CHUNKS}, {_BM25}, {_SOURCES}, numbered AS (SELECT qid, id, min(rank) AS old, row_number() OVER (PARTITION BY qid ORDER BY min(rank), id) AS number FROM bm25 GROUP BY qid, id)
SELECT qid, number, old, id, '《' || CASE WHEN trim(book) = '' THEN '未知来源' ELSE book END || '》-' || title AS source FROM numbered JOIN sources USING (id)""",
    "eval_status": f"SELECT qa_id, CASE WHEN question IS NULL THEN 'script_error' WHEN ex_type IS NULL THEN 'hallucination_flagged' ELSE {_INTERNAL} END AS v1, CASE WHEN question IS NULL THEN 'script_error' ELSE {_INTERNAL} END AS v2 FROM (SELECT DISTINCT qa_id, ex_type, question, answer FROM answered_questions)",
    "query_build": f"SELECT doc_id, CASE WHEN text IS NULL OR {_strip('text')} = '' THEN coalesce(title, '') ELSE coalesce(title, '') || chr(10) || chr(10) || CASE WHEN length(text) > 2000 THEN substr(text, 1, 2000) || chr(10) || chr(10) || '[...truncated...]' ELSE text END END AS query FROM documents",
    "probe_status": f"WITH {_P} SELECT event_id, {_PS} AS status FROM pr",
    "probe_counts": f"WITH {_P} SELECT event_type, {_PS} AS status, count(*) AS n FROM pr GROUP BY 1, 2",
    "page_status": f"SELECT doc_id, CASE WHEN source IS NULL THEN 'error' WHEN {_strip('text')} <> '' OR {_strip('title')} <> '' THEN 'success' ELSE 'empty_content' END AS status FROM documents",
    "robots_urls": "SELECT DISTINCT 'https://' || coalesce(lang, 'xx') || '.example.org/robots.txt' AS robots FROM documents",
    "boolean_filter": f"WITH {_CHUNKS} SELECT id FROM docs WHERE (contains(lower(text), 'hash table') OR contains(text, '散列表')) AND NOT (contains(text, '链表') OR contains(lower(text), 'skip list'))",
    "exact_fetch": f"WITH {_CHUNKS} SELECT id FROM docs WHERE contains(text, '扫描边界顶点')",
    "edit_distance_filter": f"""WITH {_EDGES}, {_ENTITIES}, chars AS (SELECT DISTINCT concept FROM concept_mapping) SELECT name, concept FROM ents, chars WHERE abs(length(name) - length(concept)) <= 2 AND {{lev}} <= 2""",
    "alignment_candidates": f"""WITH {_EDGES}, {_ENTITIES}, g AS (SELECT name, list_distinct(list_transform(range(1, length(name) - 1), lambda i: substr(lower(name), i, 3))) AS g FROM ents WHERE length(name) >= 3),
pairs AS (SELECT a.name AS name_a, b.name AS name_b, len(list_intersect(a.g, b.g)) AS common, len(a.g) + len(b.g) AS total FROM g AS a, g AS b WHERE a.name < b.name)
SELECT name_a, name_b, round(common / (total - common), 6) AS jaccard FROM pairs WHERE common / (total - common) >= 0.6""",
    "observation_summary": "SELECT lang, count(*) AS size, count(DISTINCT source) AS sources, coalesce(sum(length(text)), 0) AS chars, count(*) FILTER (text IS NULL) AS missing FROM documents GROUP BY lang",
    "observation_keywords": f"WITH c AS (SELECT lang, tok, count(*) AS n FROM (SELECT lang, unnest({_tok('text')}) AS tok FROM documents WHERE lang IS NOT NULL) WHERE length(tok) > 1 GROUP BY lang, tok) SELECT * FROM (SELECT lang, tok, n, row_number() OVER (PARTITION BY lang ORDER BY n DESC, tok) AS rank FROM c) WHERE rank <= 10",
    "counting_question": "SELECT prereq AS term, count(*) AS titles FROM (SELECT DISTINCT trim(title) AS title FROM refined_document_chunks WHERE title IS NOT NULL) JOIN (SELECT DISTINCT prereq FROM concept_mapping) ON contains(title, prereq) GROUP BY prereq",
    "search_result_counts": f"WITH {_BANK}, {_CHUNKS}, {_BM25} SELECT qid, count(*) AS hits FROM bm25 GROUP BY qid",
    "cache_names": "SELECT DISTINCT source, regexp_replace(source, '\\.[^.]*$', '') || '_' || substr(md5(source), 1, 8) AS name FROM documents WHERE source IS NOT NULL",
}
# DuckDB's own levenshtein counts bytes, so the names are mapped to one byte for each character of the concept's alphabet
_ONE = "array_to_string(list_transform(range(1, length({x}) + 1), lambda i: chr(CASE WHEN instr(concept, substr({x}, i, 1)) > 0 THEN (47 + instr(concept, substr({x}, i, 1)))::INT ELSE 35 END)), '')"
SQL["edit_distance_filter"] = SQL["edit_distance_filter"].replace("{lev}", f"levenshtein({_ONE.replace('{x}', 'name')}, {_ONE.replace('{x}', 'concept')})")
