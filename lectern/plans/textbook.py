"""Queries of chunking, extraction and the question bank with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import prefix
from lectern.operators import textbook as T
from lectern.sources.tables import table


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, text`` of the documents with a text."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text").where(F.col("text").isNotNull())


def chunk_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, title, content`` of the distinct chunks."""
    return table(spark, sf_dir, "refined_document_chunks").select(F.col("chunk_id").alias("id"), "title", "content").where(F.col("content").isNotNull()).distinct()


def bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct items of the question bank."""
    return table(spark, sf_dir, "answered_questions").select("qa_id", "ex_id", "ex_type", "chapter", "title", "content", "question", "answer").distinct()


def problem_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown of the bank's problems: a chapter line, the problem's heading, its content."""
    b = bank(spark, sf_dir).where((F.col("ex_type") == "problem") & F.col("title").isNotNull() & F.col("content").isNotNull())
    return b.select(F.col("qa_id").alias("id"), F.concat(F.lit("# "), F.coalesce("chapter", F.lit("")), F.lit("\n# "), "ex_id", F.lit(" "), "title", F.lit("\n"), "content").alias("text"))


def heading_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings of the documents with their levels."""
    return T.heading_levels(docs(spark, sf_dir))


def heading_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings of the documents with their paths."""
    return T.heading_paths(docs(spark, sf_dir))


def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks of the documents."""
    return T.chunk_documents(docs(spark, sf_dir))


def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentences of every chunk."""
    return chunk_rows(spark, sf_dir).select("id", F.posexplode(T.sentences(F.col("content"))).alias("pos", "sentence"))


def sentence_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk in parts of at most 300 characters, by whole sentences."""
    return T.refine(chunk_rows(spark, sf_dir))


def refined_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of every chunk numbered through."""
    return T.dense_ids(T.refine(chunk_rows(spark, sf_dir)), "id", "part", "content").select("dense_id", "id", "part")


def chunk_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks by length class."""
    return chunk_rows(spark, sf_dir).groupBy(T.length_buckets(F.char_length("content")).alias("bucket")).agg(F.count("*").alias("n"))


def long_chunk_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of more than 1,000 characters."""
    return chunk_rows(spark, sf_dir).agg(F.count_if(F.char_length("content") > 1000).alias("n"))


def exercise_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exercise lines of the documents."""
    return T.exercises(docs(spark, sf_dir))


def exercises_per_chapter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exercises by chapter."""
    return T.exercises(docs(spark, sf_dir)).groupBy("chapter").agg(F.count("*").alias("n"))


def problem_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problems of the markdown made of the bank."""
    return T.problems(problem_docs(spark, sf_dir))


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bank(spark, sf_dir).where(F.col("question").isNotNull() & F.col("ex_id").isNotNull())
    path = F.array(F.coalesce("chapter", F.lit("")), F.when(F.col("ex_type") == "exercise", "练习").otherwise(F.coalesce("title", F.lit(""))))
    return b.select("qa_id", F.concat("ex_id", F.lit(" "), "question").alias("content"), F.coalesce("title", F.lit("")).alias("title"), path.alias("path"), "chapter")


def question_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which items would be taken for a question if they were chunks."""
    a = _asked(spark, sf_dir)
    return a.select("qa_id", T.is_question(F.col("content"), F.col("title"), F.col("path")).alias("found")).distinct()


def description_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned texts of the questions."""
    b = bank(spark, sf_dir).where(F.col("question").isNotNull())
    return b.select("qa_id", T.clean_description(F.col("question")).alias("description")).where(F.char_length("description") >= 10).distinct()


def question_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers made of chunk number and title."""
    return chunk_rows(spark, sf_dir).select("id", T.question_id(F.col("id"), F.col("title")).alias("question_id"))


def question_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source line of every chunk."""
    raw = table(spark, sf_dir, "refined_document_chunks")
    return raw.select(F.col("chunk_id").alias("id"), T.question_source(F.col("path_titles"), F.col("metadata")["title"]).alias("source")).distinct()


def merge_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extracted exercises and problems in one table."""
    return T.merged_questions(T.exercises(docs(spark, sf_dir)), T.problems(problem_docs(spark, sf_dir)))


def summary_csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the summary file: type, id, chapter, difficulty, question cut to 100 characters."""
    b = bank(spark, sf_dir).where(F.col("question").isNotNull())
    return b.select("qa_id", "ex_type", "ex_id", F.coalesce("chapter", F.lit("")).alias("chapter"), F.lit("normal").alias("difficulty"), prefix(F.col("question"), 100).alias("question"))


def kept_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapter, title, content and question, missing ones as empty strings."""
    return bank(spark, sf_dir).select("qa_id", *(F.coalesce(c, F.lit("")).alias(c) for c in ("chapter", "title", "content", "question")))


def pending_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items without an answer; failed ones aren't tried again."""
    return bank(spark, sf_dir).where(F.col("answer").isNull()).select("qa_id", "question")


def answered_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items, answered and failed ones by type."""
    return bank(spark, sf_dir).groupBy("ex_type").agg(F.count("*").alias("total"), F.count_if(F.col("answer").isNotNull() & (F.col("answer") != T.FAILED)).alias("answered"), F.count_if(F.col("answer") == T.FAILED).alias("failed"))


def question_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions behind their chapter and answer as context."""
    b = bank(spark, sf_dir).where(F.col("question").isNotNull())
    context = F.concat_ws(" -> ", "chapter", F.substring("answer", 1, 200))
    r = T.rewritten(F.col("question"), context, F.concat(F.lit("q_"), F.col("qa_id").cast("string")))
    return b.select("qa_id", r.alias("r")).select("qa_id", "r.id", "r.text")


def quality_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that pass the documented quality rule."""
    return bank(spark, sf_dir).where(T.is_good_question(F.col("title"), F.col("question"))).select("qa_id")


def delimited_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles taken back out of a text in which every chunk's title stands marked."""
    text = F.concat(F.lit("x ###`"), F.coalesce("title", F.lit("-")), F.lit("`### y ###`"), F.col("id").cast("string"), F.lit("`###"))
    return chunk_rows(spark, sf_dir).select("id", F.array_join(T.delimited_titles(text), "|").alias("titles"))


_LINES = "lines AS (SELECT id, generate_subscripts(l, 1) - 1 AS line_no, unnest(l) AS line FROM (SELECT doc_id AS id, string_split_regex(text, '\\r?\\n') AS l FROM documents WHERE text IS NOT NULL))"
_WS = "[\\s\\x0b　\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{1680}\\x{a0}\\x{85}]"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


_IGNORED = ", ".join(f"'{t}'" for t in T.IGNORED_TITLES)
_HEADS = f"""{_LINES}, t AS (SELECT id, line_no, {_strip('line')} AS t FROM lines),
heads AS (SELECT * FROM (SELECT id, line_no, regexp_extract(t, '^#{{1,6}}{_WS}*(\\d+(?:\\.\\d+)*)?', 1) AS number, regexp_extract(t, '^#{{1,6}}{_WS}*(?:\\d+(?:\\.\\d+)*)?{_WS}*(.*)$', 1) AS body FROM t WHERE regexp_matches(t, '^#{{1,6}}{_WS}*\\S'))),
parts AS (SELECT id, line_no, number, regexp_extract(body, '第(\\d+)章', 1) AS chapter, regexp_replace(body, '^[\\s　\\x{{a0}}.。，：:、—·-]+', '') AS title FROM heads),
known AS (SELECT id, line_no, CASE WHEN chapter <> '' THEN chapter WHEN number <> '' THEN number END AS numbering, title,
  CASE WHEN chapter <> '' THEN 1 WHEN number <> '' THEN length(number) - length(replace(number, '.', '')) + 1 END AS level0 FROM parts WHERE title NOT IN ({_IGNORED})),
runs AS (SELECT *, count(level0) OVER (PARTITION BY id ORDER BY line_no) AS run FROM known),
levels AS (SELECT id, line_no, (coalesce(first_value(level0) OVER (PARTITION BY id, run ORDER BY line_no), 1) + row_number() OVER (PARTITION BY id, run ORDER BY line_no) - 1)::INT AS level, numbering, title FROM runs),
paths AS (SELECT h.id, h.line_no, h.level, h.numbering, h.title, coalesce((SELECT string_agg(a.title, ' > ' ORDER BY a.line_no) FROM levels AS a WHERE a.id = h.id AND a.line_no < h.line_no AND a.level < h.level
  AND NOT EXISTS (SELECT 1 FROM levels AS b WHERE b.id = h.id AND b.line_no > a.line_no AND b.line_no < h.line_no AND b.level <= a.level)) || ' > ', '') || h.title AS path FROM levels AS h)"""
_ROWS = "rows AS (SELECT DISTINCT chunk_id AS id, title, content FROM refined_document_chunks WHERE content IS NOT NULL)"
_SENT = f"sent AS (SELECT id, title, string_split(regexp_replace(content, '([。！!？?]){_WS}*', '\\1' || chr(1), 'g'), chr(1)) AS l FROM rows)"
_PACK = f"""{_ROWS}, {_SENT}, todo AS (SELECT id, title, l FROM sent WHERE id IN (SELECT id FROM rows WHERE length(content) > 300)),
fold AS (WITH RECURSIVE f AS (SELECT id, title, l, 1 AS k, l[1] AS cur, 1 AS g FROM todo UNION ALL
  SELECT id, title, l, k + 1, CASE WHEN length(cur) + length(l[k + 1]) > 300 THEN l[k + 1] ELSE cur || l[k + 1] END, CASE WHEN length(cur) + length(l[k + 1]) > 300 THEN g + 1 ELSE g END FROM f WHERE k < len(l)) SELECT * FROM f),
groups AS (SELECT id, title, g, {_strip('arg_max(cur, k)')} AS content FROM fold GROUP BY id, title, g),
packed AS (SELECT id, row_number() OVER (PARTITION BY id, title ORDER BY g) AS part, coalesce(title, '') || ' (part ' || row_number() OVER (PARTITION BY id, title ORDER BY g) || ')' AS title, content FROM groups WHERE content <> ''
UNION ALL SELECT id, 0, coalesce(title, ''), content FROM rows WHERE length(content) <= 300)"""
_EX = f"""{_LINES}, t AS (SELECT id, line_no, {_strip('line')} AS t FROM lines),
carried AS (SELECT id, line_no, t, coalesce(last_value(CASE WHEN regexp_matches(t, '^#+ *第') AND contains(t, '章') THEN {_strip("regexp_replace(t, '^#+', '')")} END IGNORE NULLS) OVER (PARTITION BY id ORDER BY line_no), '') AS chapter FROM t),
ex AS (SELECT id, line_no, regexp_extract(t, '^\\*?(\\d+\\.\\d+-\\d+)\\s+([^.\\s].*)$', 1) AS ex_id, chapter, regexp_extract(t, '^\\*?(\\d+\\.\\d+-\\d+)\\s+([^.\\s].*)$', 2) AS question FROM carried WHERE regexp_matches(t, '^\\*?\\d+\\.\\d+-\\d+\\s+[^.\\s].*$'))"""
_BANK = "bank AS (SELECT DISTINCT qa_id, ex_id, ex_type, chapter, title, content, question, answer FROM answered_questions)"
_PROB = f"""{_BANK}, pl AS (SELECT id, generate_subscripts(l, 1) AS line_no, unnest(l) AS line FROM (SELECT qa_id AS id, string_split_regex('# ' || coalesce(chapter, '') || chr(10) || '# ' || ex_id || ' ' || title || chr(10) || content, '\\r?\\n') AS l FROM bank WHERE ex_type = 'problem' AND title IS NOT NULL AND content IS NOT NULL)),
pt AS (SELECT id, line_no, {_strip('line')} AS t FROM pl),
ps AS (SELECT id, line_no, t, coalesce(last_value(CASE WHEN regexp_matches(t, '^#+ *第') AND contains(t, '章') THEN {_strip("regexp_replace(t, '^#+', '')")} END IGNORE NULLS) OVER (PARTITION BY id ORDER BY line_no), '') AS chapter,
  count(*) FILTER (regexp_matches(t, '^#+\\s*\\d+-\\d+')) OVER (PARTITION BY id ORDER BY line_no) AS segment FROM pt),
pg AS (SELECT id, segment, arg_min(t, line_no) AS h, arg_min(chapter, line_no) AS chapter,
  coalesce(string_agg(t, ' ' ORDER BY line_no) FILTER (t <> '' AND NOT starts_with(t, '#') AND NOT starts_with(t, '[') AND NOT starts_with(t, 'Omitted')), '') AS content,
  coalesce(string_agg(t, chr(10) ORDER BY line_no) FILTER (t <> '' AND NOT starts_with(t, '#') AND NOT starts_with(t, '[') AND NOT starts_with(t, 'Omitted')), '') AS full_text FROM ps WHERE segment > 0 GROUP BY id, segment),
prob AS (SELECT id, regexp_extract(h, '(\\d+-\\d+)', 1) AS prob_id, chapter, {_strip("regexp_replace(h, '^#+\\s*\\d+-\\d+', '')")} AS title, content, full_text FROM pg)"""


def _clean(x: str) -> str:
    out = f"regexp_replace({x}, '{_WS}+', ' ', 'g')"
    out = f"regexp_replace({out}, '^[。，！？；：\"《》]+|[。，！？；：\"《》]+$', '', 'g')"
    out = f"regexp_replace({out}, '[#*`_\\[\\]]+', '', 'g')"
    return _strip(f"regexp_replace({out}, 'https?://\\S+', '', 'g')")


_CLEAN = _clean("question")

QUERIES = {
    f.__name__: f
    for f in (
        heading_levels, heading_paths, chunk_documents, sentence_split, sentence_pack, refined_ids, chunk_length_histogram, long_chunk_count, exercise_extract, exercises_per_chapter, problem_extract,
        question_detect, description_clean, question_ids, question_source, merge_questions, summary_csv_rows, kept_fields, pending_rows, answered_stats, question_rewrite, quality_filter, delimited_titles,
    )
}

SQL = {
    "heading_levels": f"WITH {_HEADS} SELECT id, line_no, level, numbering, title FROM levels",
    "heading_paths": f"WITH {_HEADS} SELECT id, line_no, level, numbering, title, path FROM paths",
    "chunk_documents": f"""WITH {_HEADS}, placed AS (SELECT lines.id, lines.line_no, line, level, numbering, title, path, count(level) OVER (PARTITION BY lines.id ORDER BY lines.line_no) AS seq FROM lines LEFT JOIN paths ON lines.id = paths.id AND lines.line_no = paths.line_no),
grouped AS (SELECT id, seq, max(title) AS title, max(numbering) AS numbering, max(level) AS level, max(path) AS path, {_strip("coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (level IS NULL), '')")} AS content FROM placed GROUP BY id, seq)
SELECT id, seq, coalesce(title, '{T.INTRO_TITLE}') AS title, coalesce(numbering, CASE WHEN seq = 0 THEN '0' ELSE title END) AS numbering, coalesce(level, 0) AS level, coalesce(path, '{T.INTRO_TITLE}') AS path, content FROM grouped WHERE seq > 0 OR content <> ''""",
    "sentence_split": f"WITH {_ROWS}, {_SENT} SELECT id, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS sentence FROM sent",
    "sentence_pack": f"WITH {_PACK} SELECT id, part, title, content FROM packed",
    "refined_ids": f"WITH {_PACK} SELECT row_number() OVER (ORDER BY id, part, content) AS dense_id, id, part FROM packed",
    "chunk_length_histogram": f"WITH {_ROWS} SELECT CASE WHEN n < 100 THEN '<100' WHEN n < 500 THEN '100-500' WHEN n < 1000 THEN '500-1000' WHEN n < 2000 THEN '1000-2000' ELSE '>=2000' END AS bucket, count(*) AS n FROM (SELECT length(content) AS n FROM rows) GROUP BY 1",
    "long_chunk_count": f"WITH {_ROWS} SELECT count(*) FILTER (length(content) > 1000) AS n FROM rows",
    "exercise_extract": f"WITH {_EX} SELECT id, line_no, ex_id, chapter, question FROM ex",
    "exercises_per_chapter": f"WITH {_EX} SELECT chapter, count(*) AS n FROM ex GROUP BY chapter",
    "problem_extract": f"WITH {_PROB} SELECT id, prob_id, chapter, title, content, full_text, title || chr(10) || content AS question FROM prob",
    "question_detect": f"""WITH {_BANK} SELECT DISTINCT qa_id, length(content) >= 20 AND regexp_matches(content, '(?:^|\\n)\\s*(?:{'|'.join(T.QUESTION_IDS)})') AND (regexp_matches(path, '{'|'.join(T.PATH_WORDS)}') OR regexp_matches(title, '{'|'.join(T.TITLE_WORDS)}')) AS found
FROM (SELECT qa_id, ex_id || ' ' || question AS content, coalesce(title, '') AS title, coalesce(chapter, '') || chr(10) || CASE WHEN ex_type = 'exercise' THEN '练习' ELSE coalesce(title, '') END AS path FROM bank WHERE question IS NOT NULL AND ex_id IS NOT NULL)""",
    "description_clean": f"WITH {_BANK} SELECT DISTINCT qa_id, d AS description FROM (SELECT qa_id, {_CLEAN} AS d FROM bank WHERE question IS NOT NULL) WHERE length(d) >= 10",
    "question_ids": f"WITH {_ROWS} SELECT id, 'q_' || id || '_' || substr(md5(coalesce(title, '')), 1, 8) AS question_id FROM rows",
    "question_source": f"""SELECT DISTINCT chunk_id AS id, concat_ws(' | ', CASE WHEN len(path_titles) > 0 THEN array_to_string(path_titles[-3:], ' -> ') END, CASE WHEN {_strip("metadata['title']")} <> '' THEN metadata['title'] END) AS source FROM refined_document_chunks""",
    "merge_questions": f"WITH {_EX}, {_PROB} SELECT 'exercise' AS type, ex_id AS id, chapter, question FROM ex UNION ALL SELECT 'problem', prob_id, chapter, title || chr(10) || content FROM prob",
    "summary_csv_rows": f"WITH {_BANK} SELECT qa_id, ex_type, ex_id, coalesce(chapter, '') AS chapter, 'normal' AS difficulty, CASE WHEN length(question) > 100 THEN substr(question, 1, 100) || '...' ELSE question END AS question FROM bank WHERE question IS NOT NULL",
    "kept_fields": f"WITH {_BANK} SELECT qa_id, coalesce(chapter, '') AS chapter, coalesce(title, '') AS title, coalesce(content, '') AS content, coalesce(question, '') AS question FROM bank",
    "pending_rows": f"WITH {_BANK} SELECT qa_id, question FROM bank WHERE answer IS NULL",
    "answered_stats": f"WITH {_BANK} SELECT ex_type, count(*) AS total, count(*) FILTER (answer IS NOT NULL AND answer <> '{T.FAILED}') AS answered, count(*) FILTER (answer = '{T.FAILED}') AS failed FROM bank GROUP BY ex_type",
    "question_rewrite": f"""WITH {_BANK}, c AS (SELECT qa_id, question, concat_ws(' -> ', chapter, substr(answer, 1, 200)) AS context FROM bank WHERE question IS NOT NULL)
SELECT qa_id, 'q_' || qa_id || '_rewritten' AS id, CASE WHEN length(context) > 50 THEN '背景：' || substr(context, 1, 100) || '...' || chr(10) || chr(10) || question ELSE question END AS text FROM c""",
    "quality_filter": f"WITH {_BANK} SELECT qa_id FROM bank WHERE length(question) >= 50 AND NOT regexp_matches(question, '答案|提示|参考') AND NOT regexp_matches(coalesce(title, ''), '^\\s*[0-9.]+\\s*$')",
    "delimited_titles": f"WITH {_ROWS} SELECT id, array_to_string(regexp_extract_all('x ###`' || coalesce(title, '-') || '`### y ###`' || id || '`###', '###`([^`]+)`###', 1), '|') AS titles FROM rows",
}
