"""Queries of retrieval and ranking with their SQL. Query sets are the rows whose id is divisible by 50."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import BANK_STOP_WORDS, HAN, WORD, keywords, prefix, tokens
from lectern.operators import retrieval as R
from lectern.sources.tables import table


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, text`` of the distinct chunks with a content."""
    return table(spark, sf_dir, "refined_document_chunks").select(F.col("chunk_id").alias("id"), F.col("content").alias("text")).where(F.col("text").isNotNull()).distinct()


def delivered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, text`` of all delivered rows, for searches that tell repeated rows themselves."""
    return table(spark, sf_dir, "refined_document_chunks").select(F.col("chunk_id").alias("id"), F.col("content").alias("text")).where(F.col("text").isNotNull())


def bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, question, chapter, answer`` of the distinct items."""
    return table(spark, sf_dir, "answered_questions").select(F.col("qa_id").alias("id"), "question", "chapter", "answer").distinct()


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of all delivered rows."""
    return table(spark, sf_dir, "answered_questions").select(F.col("qa_id").alias("id"), "question", "chapter", "answer")


def asks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``qid, query`` of every fiftieth question."""
    return bank(spark, sf_dir).where((F.col("id") % 50 == 0) & F.col("question").isNotNull()).select(F.col("id").alias("qid"), F.col("question").alias("query"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, text``: the questions as documents."""
    return bank(spark, sf_dir).where(F.col("question").isNotNull()).select("id", F.col("question").alias("text"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, v`` of the usable vectors."""
    return R.valid(table(spark, sf_dir, "chunk_vectors").select(F.col("chunk_id").alias("id"), F.col("embedding").alias("v")))


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25: ten best chunks for every query."""
    return R.bm25(delivered(spark, sf_dir), asks(spark, sf_dir))


def bm25_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 weights of the chunk corpus."""
    return R.bm25_idf(chunks(spark, sf_dir)).select("tok", "df", F.round("idf", 6).alias("idf"))


def corpus_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document frequency and total count of every token of the chunks."""
    return R.postings(chunks(spark, sf_dir)).groupBy("tok").agg(F.count("*").alias("df"), F.sum("tf").alias("total"))


def term_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of each question."""
    return R.postings(questions(spark, sf_dir))


def doc_length_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number, total and mean length in tokens, by language of the document."""
    docs = table(spark, sf_dir, "documents").where(F.col("text").isNotNull())
    n = docs.select("lang", F.size(tokens(F.col("text"))).alias("dl"))
    return n.groupBy("lang").agg(F.count("*").alias("docs"), F.sum("dl").alias("tokens"), F.round(F.avg("dl"), 6).alias("avgdl"))


def keyword_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of more than one character over all questions, with repetition."""
    return questions(spark, sf_dir).select(F.explode(F.filter(tokens(F.col("text")), lambda t: F.char_length(t) > 1)).alias("tok")).groupBy("tok").agg(F.count("*").alias("n"))


def knn_l2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact nearest vectors of every query vector, itself included."""
    v = vectors(spark, sf_dir)
    return R.nearest(v, v.where("id % 50 = 0").select(F.col("id").alias("qid"), "v"))


def knn_argmin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one nearest other vector of every query vector."""
    v = vectors(spark, sf_dir)
    two = R.nearest(v, v.where("id % 50 = 0").select(F.col("id").alias("qid"), "v"), k=2)
    return two.where("id <> qid").groupBy("qid").agg(F.min_by("id", "rank").alias("id"), F.min("dist").alias("dist"))


def tfidf_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TF-IDF weights of the questions' words in two questions or more."""
    return R.tfidf_idf(questions(spark, sf_dir)).select("tok", "df", F.round("idf", 6).alias("idf"))


def tfidf_cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten most similar questions by TF-IDF cosine."""
    return R.tfidf_cosine(questions(spark, sf_dir), asks(spark, sf_dir), 10)


def jaccard_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten most similar questions by keyword sets."""
    return R.keyword_overlap(questions(spark, sf_dir), asks(spark, sf_dir), 10)


def answer_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much each answer's first 500 characters share with its own question, times 0.8."""
    b = bank(spark, sf_dir).where(F.col("question").isNotNull() & F.col("answer").isNotNull())
    return b.select("id", F.round(0.8 * R.overlap(F.col("question"), F.substring("answer", 1, 500)), 6).alias("score"))


def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten best items of the question bank by the hybrid score."""
    return R.hybrid(items(spark, sf_dir), asks(spark, sf_dir))


def hybrid_search_chapter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same among the items of chapters that contain 图, filtered before scoring."""
    return R.hybrid(items(spark, sf_dir).where(F.lower("chapter").contains("图")), asks(spark, sf_dir))


def suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five suggested keywords for every query."""
    return R.suggestions(bank(spark, sf_dir).where(F.col("question").isNotNull()), asks(spark, sf_dir))


def merge_dedup_retrievers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 and keyword hits in one list, each question once, numbered."""
    q, a = questions(spark, sf_dir), asks(spark, sf_dir)
    return R.fused(R.bm25(q, a), R.keyword_overlap(q, a, 10))


def best_score_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 and keyword hits, each question once with its larger score."""
    q, a = questions(spark, sf_dir), asks(spark, sf_dir)
    return R.best_score(R.bm25(q, a), R.keyword_overlap(q, a, 10))


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, book, chapter, title, snippet, h`` of all delivered rows; ``h`` tells contents apart."""
    raw = table(spark, sf_dir, "refined_document_chunks").where(F.col("content").isNotNull())
    book = F.coalesce(F.nullif(F.trim(F.col("metadata")["title"]), F.lit("")), F.lit("未知来源"))
    chapter = F.when(F.size("path_titles") > 0, F.element_at("path_titles", -1)).otherwise("附加章节")
    return raw.select(F.col("chunk_id").alias("id"), book.alias("book"), chapter.alias("chapter"), F.coalesce("title", F.lit("")).alias("title"), prefix(F.col("content"), 500).alias("snippet"), F.xxhash64("content").alias("h"))


def context_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbered context of every query: source and the first 500 characters of each hit."""
    hits = R.bm25(delivered(spark, sf_dir), asks(spark, sf_dir)).select("qid", "id", "rank")
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] 《"), F.col("book"), F.lit("》-"), F.col("title"))
    # each delivery once only behind the join, where the rows lie by id, so that the texts are shuffled once
    return hits.join(_sources(spark, sf_dir), "id").distinct().select("qid", "id", "rank", line.alias("source"), "snippet")


def context_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbered context of every query, uncut: book, path titles and the whole text of the hits of BM25 and of
    keywords, each chunk once."""
    c, a = delivered(spark, sf_dir), asks(spark, sf_dir)
    hits = R.fused(R.bm25(c, a), R.keyword_overlap(c, a, 10))
    raw = table(spark, sf_dir, "refined_document_chunks").where(F.col("content").isNotNull())
    book = F.coalesce(F.nullif(F.trim(F.col("metadata")["title"]), F.lit("")), F.lit("未知来源"))
    titles = F.coalesce(F.array_join("path_titles", " > "), F.lit(""))
    sources = raw.select(F.col("chunk_id").alias("id"), book.alias("book"), titles.alias("titles"), "content")
    line = F.concat(F.lit("["), F.col("number").cast("string"), F.lit("] 《"), F.col("book"), F.lit("》 "), F.col("titles"))
    return hits.join(sources, "id").distinct().select("qid", "id", "number", line.alias("source"), "content")


def book_first_chapter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The books of every query's hits in order, each with the chapter of its best hit."""
    hits = R.bm25(delivered(spark, sf_dir), asks(spark, sf_dir)).select("qid", "id", "rank").join(_sources(spark, sf_dir).select("id", "book", "chapter"), "id")
    return hits.groupBy("qid", "book").agg(F.min("rank").alias("first_rank"), F.min_by("chapter", "rank").alias("chapter"))


def query_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keywords of every question, in order."""
    return questions(spark, sf_dir).select("id", F.array_join(keywords(F.col("text")), " ").alias("keywords"))


def _tok(x: str) -> str:
    low = f"lower({x})"
    second = f"regexp_replace({low}, '(^|[^一-鿿]){HAN}', '\\1 ', 'g')"
    return f"list_concat(list_concat(regexp_extract_all({low}, '{WORD}'), regexp_extract_all({low}, '{HAN}{{2}}')), regexp_extract_all({second}, '{HAN}{{2}}'))"


def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_STOP = _list(BANK_STOP_WORDS)


def _key(x: str, stop: str = _STOP) -> str:
    return f"list_distinct(list_filter({_tok(x)}, lambda t: length(t) > 1 and not list_contains({stop}, t)))"


_BANK = "bank AS (SELECT DISTINCT qa_id AS id, question, chapter, answer FROM answered_questions), asks AS (SELECT id AS qid, question AS query FROM bank WHERE id % 50 = 0 AND question IS NOT NULL)"
_CHUNKS = "docs AS (SELECT DISTINCT chunk_id AS id, content AS text FROM refined_document_chunks WHERE content IS NOT NULL)"
_QUESTIONS = "docs AS (SELECT id, question AS text FROM bank WHERE question IS NOT NULL)"
_TF = f"tf AS (SELECT id, tok, count(*) AS tf FROM (SELECT id, unnest({_tok('text')}) AS tok FROM docs) GROUP BY id, tok)"
_IDF = f"""{_TF},
dl AS (SELECT id, len({_tok('text')}) AS dl FROM docs), n AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
df AS (SELECT tok, count(*) AS df FROM tf GROUP BY tok),
raw AS (SELECT tok, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM df, n), mean AS (SELECT avg(raw) AS mean FROM raw),
idf AS (SELECT tok, df, CASE WHEN raw < 0 THEN 0.25 * mean ELSE raw END AS idf FROM raw, mean)"""
_BM25 = f"""{_IDF},
qtf AS (SELECT qid, tok, count(*) AS qtf FROM (SELECT qid, unnest({_tok('query')}) AS tok FROM asks) GROUP BY qid, tok),
scored AS (SELECT qid, tf.id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
  FROM qtf JOIN idf USING (tok) JOIN tf USING (tok) JOIN dl ON dl.id = tf.id, n GROUP BY qid, tf.id),
bm25 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM scored) WHERE rank <= 10)"""
_COS = """vocab AS (SELECT tok, ln((SELECT count(*) FROM docs WHERE text IS NOT NULL) / (df + 1)) AS idf, df FROM (SELECT tok, count(*) AS df FROM tf GROUP BY tok) WHERE df >= 2),
w AS (SELECT id, tok, tf * idf AS w FROM tf JOIN vocab USING (tok)), norms AS (SELECT id, sqrt(sum(w * w)) AS norm FROM w GROUP BY id),
v AS (SELECT qid, tok, count(*) * any_value(idf) AS v FROM (SELECT qid, unnest({q}) AS tok FROM asks) JOIN vocab USING (tok) GROUP BY qid, tok),
lengths AS (SELECT qid, sqrt(sum(v * v)) AS length FROM v GROUP BY qid HAVING sqrt(sum(v * v)) > 0),
cos AS (SELECT qid, id, dot / (length * CASE WHEN norm = 0 THEN 1 ELSE norm END) AS cos FROM (SELECT qid, id, sum(v * w) AS dot FROM v JOIN w USING (tok) GROUP BY qid, id) JOIN lengths USING (qid) JOIN norms USING (id))""".replace("{q}", _tok("query"))


def _overlap(name: str, source: str, text: str) -> str:
    return f"""{name}d AS (SELECT id, {_key(text)} AS k FROM {source}), {name}q AS (SELECT qid, {_key('query')} AS k FROM asks),
{name} AS (SELECT qid, id, n / (nq + nd - n) AS {name} FROM (SELECT qid, id, count(*) AS n, any_value(nq) AS nq, any_value(nd) AS nd
  FROM (SELECT qid, len(k) AS nq, unnest(k) AS t FROM {name}q) JOIN (SELECT id, len(k) AS nd, unnest(k) AS t FROM {name}d) USING (t) GROUP BY qid, id))"""


_TOP_J = "topj AS (SELECT * FROM (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM (SELECT qid, id, round(jac, 6) AS score FROM jac)) WHERE rank <= 10)"
_KNN = """v AS (SELECT chunk_id AS id, any_value(embedding) AS v FROM chunk_vectors WHERE len(embedding) = 96 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY chunk_id),
d AS (SELECT q.id AS qid, v.id, round(list_sum(list_transform(list_zip(q.v, v.v), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE))), 6) AS dist FROM v AS q, v WHERE q.id % 50 = 0),
ranked AS (SELECT qid, id, dist, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS rank FROM d)"""
_CHAPTER = f"""words AS (SELECT qid, unnest({_key('query')}) AS t FROM asks),
hit AS (SELECT DISTINCT qid, id, 0.05 AS hit FROM words JOIN cand ON contains(chapter, t))"""


def _hybrid(where: str) -> str:
    return f"""WITH {_BANK}, cand AS (SELECT * FROM bank {where}),
docs AS (SELECT id, coalesce(question, '') || ' ' || coalesce(chapter, '') || ' ' || substr(coalesce(answer, ''), 1, 500) AS text FROM cand), {_TF}, {_COS},
{_overlap('jq', 'cand', 'question')}, {_overlap('ja', 'cand', 'substr(answer, 1, 500)')}, {_CHAPTER},
every AS (SELECT qid, id FROM cos UNION SELECT qid, id FROM jq UNION SELECT qid, id FROM ja UNION SELECT qid, id FROM hit),
scored AS (SELECT qid, id, round(least(1, 0.5 * coalesce(cos, 0) + 0.3 * coalesce(jq, 0) + 0.2 * 0.8 * coalesce(ja, 0) + coalesce(hit, 0)), 6) AS score
  FROM every LEFT JOIN cos USING (qid, id) LEFT JOIN jq USING (qid, id) LEFT JOIN ja USING (qid, id) LEFT JOIN hit USING (qid, id))
SELECT * FROM (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM scored WHERE score >= 0.05) WHERE rank <= 10"""


_SOURCES = """sources AS (SELECT DISTINCT chunk_id AS id, coalesce(nullif(trim(metadata['title']), ''), '未知来源') AS book,
  CASE WHEN len(path_titles) > 0 THEN path_titles[-1] ELSE '附加章节' END AS chapter, coalesce(title, '') AS title, content FROM refined_document_chunks WHERE content IS NOT NULL)"""

QUERIES = {
    f.__name__: f
    for f in (
        bm25_topk, bm25_idf, corpus_df, term_freq, doc_length_stats, keyword_freq, knn_l2_topk, knn_argmin, tfidf_idf, tfidf_cosine_topk, jaccard_topk, answer_relevance, hybrid_search,
        hybrid_search_chapter, suggestions, merge_dedup_retrievers, best_score_merge, context_numbering, context_whole, book_first_chapter, query_keywords,
    )
}

SQL = {
    "bm25_topk": f"WITH {_BANK}, {_CHUNKS}, {_BM25} SELECT qid, id, score, rank FROM bm25",
    "bm25_idf": f"WITH {_CHUNKS}, {_IDF} SELECT tok, df, round(idf, 6) AS idf FROM idf",
    "corpus_df": f"WITH {_CHUNKS}, {_TF} SELECT tok, count(*) AS df, sum(tf) AS total FROM tf GROUP BY tok",
    "term_freq": f"WITH {_BANK}, {_QUESTIONS}, {_TF} SELECT id, tok, tf FROM tf",
    "doc_length_stats": f"SELECT lang, count(*) AS docs, sum(dl) AS tokens, round(avg(dl), 6) AS avgdl FROM (SELECT lang, len({_tok('text')}) AS dl FROM documents WHERE text IS NOT NULL) GROUP BY lang",
    "keyword_freq": f"WITH {_BANK}, {_QUESTIONS} SELECT tok, count(*) AS n FROM (SELECT unnest({_tok('text')}) AS tok FROM docs) WHERE length(tok) > 1 GROUP BY tok",
    "knn_l2_topk": f"WITH {_KNN} SELECT qid, id, dist, rank FROM ranked WHERE rank <= 10",
    "knn_argmin": f"WITH {_KNN} SELECT qid, arg_min(id, rank) AS id, min(dist) AS dist FROM ranked WHERE rank <= 2 AND id <> qid GROUP BY qid",
    "tfidf_idf": f"WITH {_BANK}, {_QUESTIONS}, {_TF}, {_COS} SELECT tok, df, round(idf, 6) AS idf FROM vocab",
    "tfidf_cosine_topk": f"WITH {_BANK}, {_QUESTIONS}, {_TF}, {_COS} SELECT * FROM (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM (SELECT qid, id, round(cos, 6) AS score FROM cos)) WHERE rank <= 10",
    "jaccard_topk": f"WITH {_BANK}, {_QUESTIONS}, {_overlap('jac', 'docs', 'text')}, {_TOP_J} SELECT qid, id, score, rank FROM topj",
    "answer_relevance": f"""WITH {_BANK}, k AS (SELECT id, {_key('question')} AS a, {_key('substr(answer, 1, 500)')} AS b FROM bank WHERE question IS NOT NULL AND answer IS NOT NULL)
SELECT id, round(CASE WHEN len(a) = 0 THEN 0 ELSE 0.8 * len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END, 6) AS score FROM k""",
    "hybrid_search": _hybrid(""),
    "hybrid_search_chapter": _hybrid("WHERE contains(lower(chapter), '图')"),
    "suggestions": f"""WITH {_BANK}, {_QUESTIONS}, counts AS (SELECT tok, count(*) AS n FROM (SELECT unnest({_tok('text')}) AS tok FROM docs) WHERE length(tok) > 1 GROUP BY tok),
words AS (SELECT qid, unnest({_key('query')}) AS t FROM asks),
near AS (SELECT t, tok, n FROM (SELECT DISTINCT t FROM words) JOIN counts ON tok <> t AND (contains(tok, t) OR contains(t, tok))),
found AS (SELECT DISTINCT qid, tok, n FROM words JOIN near USING (t)),
rest AS (SELECT * FROM found ANTI JOIN (SELECT qid, t AS tok FROM words) USING (qid, tok))
SELECT * FROM (SELECT qid, tok, n, row_number() OVER (PARTITION BY qid ORDER BY n DESC, tok) AS rank FROM rest) WHERE rank <= 5""",
    "merge_dedup_retrievers": f"""WITH {_BANK}, {_QUESTIONS}, {_BM25}, {_overlap('jac', 'docs', 'text')}, {_TOP_J},
every AS (SELECT qid, id, 0 AS s, rank FROM bm25 UNION ALL SELECT qid, id, 1, rank FROM topj)
SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY place, id) AS number FROM (SELECT qid, id, min(s * 1000 + rank) AS place FROM every GROUP BY qid, id)""",
    "best_score_merge": f"""WITH {_BANK}, {_QUESTIONS}, {_BM25}, {_overlap('jac', 'docs', 'text')}, {_TOP_J}
SELECT qid, id, max(score) AS score FROM (SELECT qid, id, score FROM bm25 UNION ALL SELECT qid, id, score FROM topj) GROUP BY qid, id""",
    "context_numbering": f"""WITH {_BANK}, {_CHUNKS}, {_BM25}, {_SOURCES}
SELECT qid, id, rank, '[' || rank || '] 《' || book || '》-' || title AS source, CASE WHEN length(content) > 500 THEN substr(content, 1, 500) || '...' ELSE content END AS snippet FROM bm25 JOIN sources USING (id)""",
    "context_whole": f"""WITH {_BANK}, {_CHUNKS}, {_BM25}, {_overlap('jac', 'docs', 'text')}, {_TOP_J},
every AS (SELECT qid, id, 0 AS s, rank FROM bm25 UNION ALL SELECT qid, id, 1, rank FROM topj),
fused AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY place, id) AS number FROM (SELECT qid, id, min(s * 1000 + rank) AS place FROM every GROUP BY qid, id)),
whole AS (SELECT DISTINCT chunk_id AS id, coalesce(nullif(trim(metadata['title']), ''), '未知来源') AS book, coalesce(array_to_string(path_titles, ' > '), '') AS titles, content FROM refined_document_chunks WHERE content IS NOT NULL)
SELECT qid, id, number, '[' || number || '] 《' || book || '》 ' || titles AS source, content FROM fused JOIN whole USING (id)""",
    "book_first_chapter": f"""WITH {_BANK}, {_CHUNKS}, {_BM25}, {_SOURCES}
SELECT qid, book, min(rank) AS first_rank, arg_min(chapter, rank) AS chapter FROM bm25 JOIN sources USING (id) GROUP BY qid, book""",
    "query_keywords": f"""WITH {_BANK}, {_QUESTIONS}, t AS (SELECT id, {_tok('text')} AS l FROM docs),
p AS (SELECT id, unnest(l) AS tok, generate_subscripts(l, 1) AS i FROM t), u AS (SELECT id, tok, min(i) AS i FROM p WHERE length(tok) > 1 AND NOT list_contains({_STOP}, tok) GROUP BY id, tok)
SELECT t.id, coalesce((SELECT string_agg(tok, ' ' ORDER BY i) FROM u WHERE u.id = t.id), '') AS keywords FROM t""",
}
