"""The queries of this subpackage and their SQL: name -> callable(spark, sf_dir), name -> DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from lectern.llm.bpe_matrix import encode_column, token_counts
from lectern.llm.common import table
from lectern.llm.fill_containers import fill_containers
from lectern.llm.near_dup_covering import NearDuplicates, near_duplicates
from lectern.llm.qa_defects import defective_pairs
from lectern.llm.scan_repair import noise_pieces, repaired, scan_noise
from lectern.llm.shared_spans import shared_shares, shared_spans
from lectern.llm.split_items import split_column
from lectern.llm.vectors_mih import nearest_vectors, neighbour_pairs


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token ids of every document."""
    return encode_column(table(spark, sf_dir, "documents"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of chunks of which one is among the other's five nearest within squared distance 0.4."""
    return neighbour_pairs(nearest_vectors(table(spark, sf_dir, "chunk_vectors")))


def p1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest chunks of every chunk with distance and rank."""
    return nearest_vectors(table(spark, sf_dir, "chunk_vectors"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scanning noise in every chunk."""
    return noise_pieces(scan_noise(table(spark, sf_dir, "refined_document_chunks")))


def p2_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The running text of every chunk."""
    chunks = table(spark, sf_dir, "refined_document_chunks")
    return repaired(chunks, scan_noise(chunks))


def _recurring(spark: SparkSession, sf_dir: str) -> NearDuplicates:
    questions = table(spark, sf_dir, "answered_questions").select(F.lit("answered_questions").alias("tbl"), F.col("qa_id").alias("id"), F.col("question").alias("text"))
    chunks = table(spark, sf_dir, "refined_document_chunks").select(F.lit("refined_document_chunks").alias("tbl"), F.col("chunk_id").alias("id"), F.col("content").alias("text"))
    return near_duplicates(questions.unionByName(chunks))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of questions and pairs of chunks whose substring sets have a similarity of 0.7 or more."""
    return _recurring(spark, sf_dir).pairs()


def p3_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class, copies and links of every question and chunk."""
    return _recurring(spark, sf_dir).records()


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of every question and chunk."""
    return _recurring(spark, sf_dir).groups()


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The defect of every defective item of the question bank."""
    return defective_pairs(table(spark, sf_dir, "answered_questions"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each chunk over 300 characters can be cut at natural boundaries alone."""
    pieces = split_column(table(spark, sf_dir, "refined_document_chunks"), limit=300, overlap=0, longer_only=True)
    return pieces.groupBy("chunk_id").agg(F.when(F.max("forced"), "forced").otherwise("natural").alias("cut"))


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pieces of all chunks, at most 300 characters long, with an overlap of 40."""
    chunks = table(spark, sf_dir, "refined_document_chunks").select("chunk_id", "title", "content").distinct()
    return split_column(chunks, limit=300, overlap=40)


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of 4,096 tokens of every document."""
    return fill_containers(token_counts(table(spark, sf_dir, "documents")), capacity=4096)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of characters of each document that stand in another one too, by stretches of 200."""
    return shared_spans(table(spark, sf_dir, "documents"))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each document is shared with another one."""
    docs = table(spark, sf_dir, "documents")
    return shared_shares(docs, shared_spans(docs))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_nearest": p1_nearest,
    "p2_found": p2_found,
    "p2_repaired": p2_repaired,
    "p3_found": p3_found,
    "p3_groups": p3_groups,
    "p3_records": p3_records,
    "p4_found": p4_found,
    "p5_found": p5_found,
    "p5_pieces": p5_pieces,
    "p6_ids": p6_ids,
    "p7_containers": p7_containers,
    "p8_found": p8_found,
    "p8_shares": p8_shares,
}

_NEAR = """v AS (SELECT chunk_id AS id, any_value(embedding)::FLOAT[96] AS f, any_value(embedding) AS v FROM chunk_vectors WHERE len(embedding) = 96 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY chunk_id),
near AS (SELECT a.id AS a, b.id AS b, round(list_sum(list_transform(list_zip(a.v, b.v), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE))), 6) AS d FROM v AS a JOIN v AS b ON a.id <> b.id AND array_distance(a.f, b.f) < 0.64),
ranked AS (SELECT a, b, d, row_number() OVER (PARTITION BY a ORDER BY d, b) AS n FROM near WHERE d <= 0.4)"""
_SPANS = """d AS (SELECT DISTINCT doc_id, text FROM documents WHERE length(text) >= 200),
w AS (SELECT doc_id, i, md5(substr(text, i + 1, 200)) AS h FROM (SELECT doc_id, text, unnest(range(0, length(text) - 199)) AS i FROM d)),
s AS (SELECT doc_id, i FROM w WHERE h IN (SELECT h FROM w GROUP BY h HAVING min(doc_id) <> max(doc_id))),
r AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 THEN 0 ELSE 1 END AS new FROM s),
g AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM r),
spans AS (SELECT doc_id, min(i) AS span_start, max(i) + 200 - min(i) AS span_len FROM g GROUP BY doc_id, run)"""
# pairs of a similarity of 0.7 or more share one of the rarest three tenths of their substrings
_PAIRS = r"""t AS (SELECT DISTINCT 'answered_questions' AS tbl, qa_id AS id, regexp_replace(lower(question), '[^\p{L}\p{N}]+', '', 'g') AS t FROM answered_questions
  UNION SELECT DISTINCT 'refined_document_chunks', chunk_id, regexp_replace(lower(content), '[^\p{L}\p{N}]+', '', 'g') FROM refined_document_chunks),
g AS (SELECT DISTINCT tbl, id, substr(t, i, 4) AS g FROM (SELECT tbl, id, t, unnest(range(1, length(t) - 2)) AS i FROM t WHERE length(t) >= 80)),
n AS (SELECT tbl, id, count(*) AS n FROM g GROUP BY tbl, id), f AS (SELECT tbl, g, count(*) AS f FROM g GROUP BY tbl, g),
p AS (SELECT * FROM (SELECT g.tbl, g.id, g.g, n, row_number() OVER (PARTITION BY g.tbl, g.id ORDER BY f, g.g) AS r FROM g JOIN f ON f.tbl = g.tbl AND f.g = g.g JOIN n ON n.tbl = g.tbl AND n.id = g.id) WHERE r <= n - ceil(0.7 * n) + 1),
c AS (SELECT DISTINCT a.tbl, a.id AS id_a, b.id AS id_b, a.n AS n_a, b.n AS n_b FROM p AS a JOIN p AS b ON a.tbl = b.tbl AND a.g = b.g AND a.id < b.id AND least(a.n, b.n) >= 0.7 * greatest(a.n, b.n)),
pairs AS (SELECT c.tbl, id_a, id_b FROM c JOIN g AS x ON x.tbl = c.tbl AND x.id = id_a JOIN g AS y ON y.tbl = c.tbl AND y.id = id_b AND x.g = y.g GROUP BY c.tbl, id_a, id_b, n_a, n_b HAVING count(*) >= 0.7 * (n_a + n_b - count(*)))"""

#: Exact counterparts where SQL can take whole tables. The others are tested against brute force or other encoders.
SQL: dict[str, str] = {
    "p1_nearest": f"WITH {_NEAR} SELECT a AS chunk_id, b AS neighbour, d AS dist, n AS rank FROM ranked WHERE n <= 5",
    "p3_found": f"WITH {_PAIRS} SELECT tbl, id_a, id_b FROM pairs",
    "p3_records": f"""WITH {_PAIRS}, l AS (SELECT t.tbl, t.id, min(o.id) AS class_id FROM t JOIN t AS o ON o.tbl = t.tbl AND o.t = t.t WHERE length(t.t) >= 80 GROUP BY t.tbl, t.id),
size AS (SELECT tbl, class_id, count(*) AS copies FROM l GROUP BY tbl, class_id),
twice AS (SELECT tbl, id_a AS a, id_b AS b FROM pairs UNION ALL SELECT tbl, id_b, id_a FROM pairs),
links AS (SELECT twice.tbl, x.class_id, count(DISTINCT y.class_id) AS links FROM twice JOIN l AS x ON x.tbl = twice.tbl AND x.id = a JOIN l AS y ON y.tbl = twice.tbl AND y.id = b WHERE x.class_id <> y.class_id GROUP BY twice.tbl, x.class_id)
SELECT l.tbl, l.id, l.class_id, copies, coalesce(links, 0) AS links FROM l JOIN size ON size.tbl = l.tbl AND size.class_id = l.class_id LEFT JOIN links ON links.tbl = l.tbl AND links.class_id = l.class_id""",
    "p8_shares": f"""WITH {_SPANS}, n AS (SELECT doc_id, max(coalesce(length(text), 0)) AS n_chars FROM documents WHERE doc_id IS NOT NULL GROUP BY doc_id), k AS (SELECT doc_id, sum(span_len)::BIGINT AS k FROM spans GROUP BY doc_id)
SELECT n.doc_id, n_chars, coalesce(k, 0) AS shared_chars, CASE WHEN n_chars > 0 THEN round(coalesce(k, 0) / n_chars, 6) ELSE 0.0 END AS share FROM n LEFT JOIN k ON k.doc_id = n.doc_id""",
    "p1_found": f"WITH {_NEAR} SELECT DISTINCT least(a, b) AS chunk_a, greatest(a, b) AS chunk_b FROM ranked WHERE n <= 5",
    "p5_found": r"""WITH c AS (SELECT DISTINCT chunk_id, content FROM refined_document_chunks WHERE length(content) > 300),
m AS (SELECT chunk_id, regexp_replace(regexp_replace(regexp_replace(content, '([。！？!?])', '\1' || chr(1), 'g'), '\.([\s　\x{a0}\x{2000}-\x{200a}\x{2028}\x{2029}])', '.' || chr(1) || '\1', 'g'), '\r?\n[ \t]*\r?\n', chr(1), 'g') AS t FROM c),
s AS (SELECT chunk_id, length(regexp_replace(unnest(string_split(t, chr(1))), '^[\s　\x{a0}]+|[\s　\x{a0}]+$', '', 'g')) AS n FROM m)
SELECT chunk_id, CASE WHEN max(n) > 300 THEN 'forced' ELSE 'natural' END AS cut FROM s GROUP BY chunk_id""",
    "p8_found": f"WITH {_SPANS} SELECT doc_id, span_start, span_len FROM spans",
}
