"""Composed answers: numbered contexts of both retrievers, graph answers, extraction, the recommending answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.clients import Client, OfflineClient, completed, decision
from lectern.functions.text import GRAPH_STOP_WORDS
from lectern.operators import citations as C
from lectern.operators import graph as G
from lectern.operators import retrieval as R
from lectern.operators import textbook as T
from lectern.plans import agent as A
from lectern.plans.graph import _EDGES, _ENTITIES, _NAMES, _PRE, _ROUTE, _SN, _TEXT, edges
from lectern.plans.graph import SQL as GRAPH_SQL
from lectern.plans.search import _BANK, _BM25, _CHUNKS, _KNN, _hybrid, _list, _tok, asks, chunks, delivered, items, vectors
from lectern.plans.textbook import _PACK, _clean, _strip
from lectern.plans.textbook import T as _T
from lectern.sources.scratch import cut_lineage
from lectern.sources.tables import table


def _titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``qid, query, v``: the titles of every fiftieth chunk, and its vector as the query's."""
    raw = table(spark, sf_dir, "refined_document_chunks").where((F.col("chunk_id") % 50 == 0) & F.col("title").isNotNull())
    named = raw.groupBy(F.col("chunk_id").alias("qid")).agg(F.min("title").alias("query"))
    return named.join(vectors(spark, sf_dir).where("id % 50 = 0").withColumnRenamed("id", "qid"), "qid", "left")


def fused_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbered context of every query: the hits of vector search, then those of BM25, each chunk once, with its
    book, path and whole text; a query without any hit has no row."""
    asked = _titles(spark, sf_dir)
    near = R.nearest(vectors(spark, sf_dir), asked.where("v is not null").select("qid", "v"))
    words = R.bm25(delivered(spark, sf_dir), asked.select("qid", "query"))
    hits = R.fused(near.select("qid", "id", "rank"), words)
    raw = table(spark, sf_dir, "refined_document_chunks").where(F.col("content").isNotNull())
    book = F.coalesce(F.nullif(F.trim(F.col("metadata")["title"]), F.lit("")), F.lit("未知来源"))
    titles = F.coalesce(F.array_join("path_titles", " > "), F.lit(""))
    sources = raw.select(F.col("chunk_id").alias("id"), book.alias("book"), titles.alias("titles"), "content")
    line = F.concat(F.lit("["), F.col("number").cast("string"), F.lit("] 《"), F.col("book"), F.lit("》 "), F.col("titles"))
    # each delivery once only behind the join, where the rows lie by id, so that the texts are shuffled once
    return hits.join(sources, "id").distinct().select("qid", "id", "number", line.alias("source"), "content")


def kg_rag_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten chunks with the most graph terms of every query, with the first 1,000 characters of their text."""
    hits = G.term_hits(asks(spark, sf_dir), G.term_chunks(edges(spark, sf_dir)))
    return G.chunk_texts(hits, chunks(spark, sf_dir).withColumn("id", F.col("id").cast(hits.schema["chunk"].dataType)))


def kg_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph's answer to every fiftieth question."""
    return G.kg_answer(edges(spark, sf_dir), chunks(spark, sf_dir), asks(spark, sf_dir))


def _extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items of the question bank laid out as chunks, so that there is something to find."""
    raw = table(spark, sf_dir, "answered_questions").where(F.col("question").isNotNull() & F.col("ex_id").isNotNull())
    path = F.array(F.coalesce("chapter", F.lit("")), F.when(F.col("ex_type") == "exercise", "练习").otherwise(F.coalesce("title", F.lit(""))))
    return raw.select(F.col("qa_id").alias("id"), "title", F.concat_ws(" ", "ex_id", "question").alias("content"), path.alias("path"), F.col("answer_meta")["model"].alias("book")).distinct()


def extract_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The questions among the items laid out as chunks, with id, class, source and rewritten text."""
    return T.extracted_questions(_extracted(spark, sf_dir))


def extraction_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items laid out as chunks, detected, extracted and rewritten questions."""
    return T.extraction_statistics(_extracted(spark, sf_dir))


def refined_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of at most 300 characters with their book, numbering and path."""
    raw = table(spark, sf_dir, "refined_document_chunks").where(F.col("content").isNotNull())
    metadata = T.numbered_metadata(F.col("metadata"), F.col("path_numbering"))
    rows = raw.select(F.col("chunk_id").alias("id"), "title", "content", metadata["title"].alias("book"), metadata["chapter_numbering"].alias("numbering"), F.array_join("path_titles", " > ").alias("path")).distinct()
    return T.refine(rows, 300, "book", "numbering", "path")


def smart_answers(questions: DataFrame, chunks: DataFrame, vectors: DataFrame | None, sources: DataFrame, bank: DataFrame, concepts: DataFrame, client: Client) -> DataFrame:
    """``qid, answer, citations, decision, prerequisites, related``: the answer of every query (qid, query) with its sources,
    and what the decision recommends: prerequisites (from ``concepts``, see ``prerequisite_edges``) and items of ``bank``.

    ``sources`` has ``id, book, title`` of the chunks; of ``chunks``, a row delivered again counts once. Lists are empty where nothing is recommended or found.
    """
    plans = cut_lineage(A.executed(A.planned(questions, client), chunks, vectors, client))
    answers = A.answered(questions, chunks, vectors, client, evidence=plans)
    shown = C.display_sources(plans.select("qid", "id", F.col("number").alias("rank")), sources)
    told = C.formatted(answers.select("qid", "answer", "used"), shown.select("qid", F.col("number").alias("old"), "source"))
    decided = completed(questions.withColumn("prompt", F.concat(F.lit("recommend: "), "query")), "prompt", "reply", client).select("qid", "query", decision(F.col("reply")).alias("decision"))
    before = decided.where("decision.recommend_prerequisite").select("qid", "query")
    cards = A.prerequisite_cards(G.prerequisite_search(before, concepts), chunks)
    needs = cards.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "prereq", "content"))).alias("prerequisites"))
    more = decided.where("decision.recommend_qa_bank").select("qid", "query")
    related = A.question_cards(R.hybrid(bank, more, 5), bank).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "question", "answer", "score"))).alias("related"))
    whole = decided.join(told, "qid", "left").join(needs, "qid", "left").join(related, "qid", "left")
    return whole.select("qid", "answer", "citations", "decision", *(F.coalesce(c, F.array().cast(whole.schema[c].dataType)).alias(c) for c in ("prerequisites", "related")))


def smart_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recommending answer to every fiftieth question, with the offline client and word search alone."""
    raw = table(spark, sf_dir, "refined_document_chunks").where(F.col("content").isNotNull())
    sources = raw.select(F.col("chunk_id").alias("id"), F.col("metadata")["title"].alias("book"), "title").groupBy("id").agg(F.min("book").alias("book"), F.min("title").alias("title"))
    concepts = G.prerequisite_edges(table(spark, sf_dir, "concept_mapping"))
    whole = smart_answers(asks(spark, sf_dir), delivered(spark, sf_dir), None, sources, items(spark, sf_dir).distinct(), concepts, OfflineClient())
    return whole.select("qid", "answer", F.array_join("citations", "|").alias("citations"), F.to_json("decision").alias("decision"), F.size("prerequisites").alias("prerequisites"), F.size("related").alias("related"))


QUERIES = {f.__name__: f for f in (fused_context, kg_rag_simple, kg_answer, extract_questions, extraction_statistics, refined_chunks, smart_answer)}

_FOUND = f"""raw AS (SELECT DISTINCT qa_id AS id, title, ex_id || ' ' || question AS content, [coalesce(chapter, ''), CASE WHEN ex_type = 'exercise' THEN '练习' ELSE coalesce(title, '') END] AS path, answer_meta.model AS book FROM answered_questions WHERE question IS NOT NULL AND ex_id IS NOT NULL),
asked AS (SELECT *, coalesce(length(content) >= 20 AND regexp_matches(content, '(?:^|\\n)\\s*(?:{'|'.join(_T.QUESTION_IDS)})') AND (coalesce(len(list_filter(path, lambda p: regexp_matches(p, '{'|'.join(_T.PATH_WORDS)}'))) > 0, false) OR regexp_matches(coalesce(title, ''), '{'|'.join(_T.TITLE_WORDS)}')), false) AS found FROM raw),
told AS (SELECT *, {_clean('content')} AS description, concat_ws(' | ', CASE WHEN len(path) > 0 THEN array_to_string(path[-3:], ' -> ') END, CASE WHEN {_strip('book')} <> '' THEN book END) AS source FROM asked)"""

_TYPES = _list(G.TYPE_WORDS)
_KG_ANSWER = f"""WITH {_EDGES}, {_ENTITIES}, {_TEXT}, {_BANK},
spread AS (SELECT qid, unnest(l) AS tok, generate_subscripts(l, 1) AS i FROM (SELECT qid, {_tok('query')} AS l FROM asks)),
pos AS (SELECT qid, tok, min(i) AS i FROM spread WHERE length(tok) > 1 AND NOT list_contains({_list(GRAPH_STOP_WORDS)}, tok) GROUP BY qid, tok),
touch AS (SELECT qid, name, 0 AS exact FROM pos JOIN ents ON contains(name, tok) OR contains(tok, name) UNION ALL SELECT DISTINCT qid, name, 1 FROM pos JOIN ents ON lower(name) = tok),
cand AS (SELECT * FROM (SELECT qid, name, row_number() OVER (PARTITION BY qid ORDER BY max(exact) DESC, count(*) DESC, name) AS rank FROM touch GROUP BY qid, name) WHERE rank <= 10),
what AS (SELECT name AS entity, name || '（' || coalesce(type, '') || '）' || CASE WHEN attributes <> '' THEN chr(10) || attributes ELSE '' END || CASE WHEN snippet <> '' THEN chr(10) || snippet ELSE '' END AS what FROM ({GRAPH_SQL['kg_what_is']})),
how AS (SELECT name AS entity, steps FROM ({GRAPH_SQL['kg_how_to']})),
several AS (SELECT qid, string_agg(name || '（' || coalesce(type, '') || '）' || CASE WHEN text <> '' THEN chr(10) || '简介：' || replace(substr(text, 1, 100), chr(10), ' ') || '...' ELSE '' END, chr(10) || chr(10) ORDER BY rank) AS several FROM cand JOIN withtext USING (name) GROUP BY qid),
q AS (SELECT asks.qid, {_ROUTE.replace('question', 'query')} AS route, name AS entity FROM asks LEFT JOIN (SELECT qid, name FROM cand WHERE rank = 1) AS c ON c.qid = asks.qid),
word AS (SELECT qid, arg_min(tok, i) AS word FROM q JOIN pos USING (qid) WHERE NOT contains(entity, tok) GROUP BY qid),
kind AS (SELECT qid, arg_min(tok, i) AS kind FROM pos WHERE list_contains({_TYPES}, tok) GROUP BY qid),
said AS (SELECT qid, string_agg(tok, ' ' ORDER BY i) AS said FROM pos GROUP BY qid),
own AS (SELECT DISTINCT {_SN} AS entity, unnest({_NAMES}) AS a FROM edges WHERE relation = 'has_attribute'),
attr AS (SELECT qid, min(a) AS attr FROM q JOIN word USING (qid) JOIN own USING (entity) WHERE contains(a, word) OR contains(word, a) GROUP BY qid),
told AS (SELECT qid, list_filter(list_transform(string_split_regex(text, '[。！？\\n]'), lambda s: {_strip('s')}), lambda s: contains(s, word) AND length(s) > 5)[1] AS told FROM q JOIN word USING (qid) JOIN withtext ON name = entity),
listed AS (SELECT kind, '找到' || count(*) || CASE WHEN count(*) > 20 THEN '个相关项目，前20个：' ELSE '个相关项目：' END || chr(10) || array_to_string(list_transform(list_sort(list(name))[1:20], lambda n: '- ' || n), chr(10)) AS listed
  FROM (SELECT type AS kind, name FROM ents UNION ALL SELECT '', name FROM ents) WHERE kind IS NOT NULL GROUP BY kind)
SELECT q.qid, route, q.entity, CASE WHEN route = 'prompt' THEN '{G.NO_QUESTION}' WHEN route = 'list' THEN coalesce(listed, '{G.NO_ITEMS}') WHEN route = 'entity' THEN coalesce(several, '{G.NOT_UNDERSTOOD}')
  WHEN q.entity IS NULL THEN concat('抱歉，我没有找到关于关键词', chr(39), coalesce(said, ''), chr(39), '的相关信息。') WHEN route = 'what_is' THEN what WHEN route = 'how_to' THEN steps WHEN word IS NULL THEN what
  WHEN attr IS NOT NULL THEN q.entity || '的' || attr || '属性已找到。' WHEN told IS NOT NULL THEN '关于' || q.entity || '的' || word || '：' || told ELSE '抱歉，没有找到关于' || q.entity || '的' || word || '属性的信息。' END AS answer
FROM q LEFT JOIN what ON what.entity = q.entity LEFT JOIN how ON how.entity = q.entity LEFT JOIN several ON several.qid = q.qid LEFT JOIN word ON word.qid = q.qid LEFT JOIN kind ON kind.qid = q.qid LEFT JOIN said ON said.qid = q.qid
LEFT JOIN attr ON attr.qid = q.qid LEFT JOIN told ON told.qid = q.qid LEFT JOIN listed ON listed.kind = coalesce(kind.kind, '')"""
_NAMED = f"list_filter({_list(G.ALGORITHM_CONCEPTS)}, lambda c: contains(query, c))"
_TITLE = "min(metadata['title'])"
# with the offline client: the default plan, an answer that cites the first evidence, a decision by the query's words
_SMART = f"""WITH {_BANK}, {_CHUNKS}, {_BM25}, {_PRE},
source AS (SELECT chunk_id AS id, '《' || CASE WHEN {_TITLE} IS NULL OR {_strip(_TITLE)} = '' THEN '未知来源' ELSE {_TITLE} END || '》-' || coalesce(min(title), '') AS source FROM refined_document_chunks WHERE content IS NOT NULL GROUP BY chunk_id),
best AS (SELECT qid, source FROM bm25 JOIN source USING (id) WHERE rank = 1),
d AS (SELECT qid, query, {_NAMED} AS named, length(query) > 49 AS more FROM asks),
needs AS (SELECT qid, least(5, count(DISTINCT end_name)) AS n FROM d JOIN pre ON contains(query, start_name) WHERE len(named) > 0 AND trim(end_name) <> '' GROUP BY qid),
related AS (SELECT h.qid, count(*) AS n FROM ({_hybrid('')}) AS h JOIN d ON d.qid = h.qid WHERE more AND rank <= 3 GROUP BY h.qid)
SELECT d.qid, 'According to the sources' || CASE WHEN best.qid IS NOT NULL THEN ' [1]' ELSE '' END || '.' AS answer, coalesce(source, '') AS citations,
  '{{"recommend_prerequisite":' || (len(named) > 0) || ',"recommend_qa_bank":' || more || ',"detected_concepts":[' || coalesce(array_to_string(list_transform(named, lambda c: '"' || c || '"'), ','), '') || '],"reason":"offline"}}' AS decision,
  coalesce(needs.n, 0) AS prerequisites, coalesce(related.n, 0) AS related
FROM d LEFT JOIN best ON best.qid = d.qid LEFT JOIN needs ON needs.qid = d.qid LEFT JOIN related ON related.qid = d.qid"""

SQL = {
    "kg_answer": _KG_ANSWER,
    "smart_answer": _SMART,
    "fused_context": f"""WITH q AS (SELECT chunk_id AS qid, min(title) AS query FROM refined_document_chunks WHERE chunk_id % 50 = 0 AND title IS NOT NULL GROUP BY chunk_id), asks AS (SELECT qid, query FROM q), {_CHUNKS}, {_BM25}, {_KNN},
every AS (SELECT qid, id, 0 AS s, rank FROM ranked WHERE rank <= 10 AND qid IN (SELECT qid FROM q) UNION ALL SELECT qid, id, 1, rank FROM bm25),
fused AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY place, id) AS number FROM (SELECT qid, id, min(s * 1000 + rank) AS place FROM every GROUP BY qid, id)),
whole AS (SELECT DISTINCT chunk_id AS id, coalesce(nullif(trim(metadata['title']), ''), '未知来源') AS book, coalesce(array_to_string(path_titles, ' > '), '') AS titles, content FROM refined_document_chunks WHERE content IS NOT NULL)
SELECT qid, id, number, '[' || number || '] 《' || book || '》 ' || titles AS source, content FROM fused JOIN whole USING (id)""",
    "kg_rag_simple": f"SELECT qid, chunk, hits, rank, substr(content, 1, 1000) AS text FROM ({GRAPH_SQL['kg_term_hits']}) AS h JOIN (SELECT DISTINCT chunk_id, content FROM refined_document_chunks WHERE content IS NOT NULL) AS c ON c.chunk_id::VARCHAR = h.chunk::VARCHAR",
    "extract_questions": f"""WITH {_FOUND}, named AS (SELECT *, 'q_' || id || '_' || substr(md5(coalesce(title, '')), 1, 8) AS question_id FROM told WHERE found AND length(description) >= 10)
SELECT id, question_id, 'single' AS class, title, description, source, CASE WHEN length(source) > 50 THEN '背景：' || substr(source, 1, 100) || '...' || chr(10) || chr(10) || description ELSE description END AS rewritten FROM named""",
    "extraction_statistics": f"WITH {_FOUND} SELECT count(*) AS total, count(*) FILTER (found) AS detected, count(*) FILTER (found AND length(description) >= 10) AS extracted, count(*) FILTER (found AND length(description) >= 10 AND length(source) > 50) AS rewritten FROM told",
    "refined_chunks": f"""WITH {_PACK}, extra AS (SELECT DISTINCT chunk_id AS id, title AS old, content AS whole, metadata['title'] AS book, coalesce(list_filter(path_numbering, lambda n: {_strip('n')} <> '')[-1], metadata['chapter_numbering']) AS numbering, array_to_string(path_titles, ' > ') AS path FROM refined_document_chunks WHERE content IS NOT NULL)
SELECT packed.id, part, packed.title, content, book, numbering, path FROM packed JOIN extra ON extra.id = packed.id AND (part = 0) = (length(whole) <= 300)""",
}
