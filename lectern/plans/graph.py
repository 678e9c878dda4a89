"""Queries of the knowledge graph with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import GRAPH_STOP_WORDS, keywords
from lectern.operators import graph as G
from lectern.plans.search import _BANK, _key, _list, asks, bank, chunks
from lectern.sources.tables import table


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct flat edges."""
    return G.flat_edges(table(spark, sf_dir, "kg_edges"))


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asks(spark, sf_dir).select("qid", F.explode(keywords(F.col("query"), GRAPH_STOP_WORDS)).alias("t"))


def kg_relation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of each relation."""
    return G.relation_counts(edges(spark, sf_dir))


def kg_label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels at the start, the end and both."""
    return G.label_counts(edges(spark, sf_dir))


def kg_edge_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entity-entity, entity-attribute and other edges."""
    return G.edge_shapes(edges(spark, sf_dir))


def kg_top_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten start names with the most edges."""
    return G.top_degree(edges(spark, sf_dir))


def kg_relation_richness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten start names with the most relations."""
    return G.relation_richness(edges(spark, sf_dir))


def kg_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities, edges, chunks and types."""
    return G.statistics(edges(spark, sf_dir))


def kg_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record for each entity."""
    return G.entities(edges(spark, sf_dir))


def kg_entity_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """End names by start name and relation."""
    return G.entity_index(edges(spark, sf_dir))


def kg_term_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with their chunks."""
    return G.term_chunks(edges(spark, sf_dir))


def kg_exact_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities named exactly like a keyword of the graph's own start names, cut into words."""
    words = edges(spark, sf_dir).where("s_name is not null").select(F.col("s_name").alias("qid"), F.explode(keywords(F.col("s_name"), GRAPH_STOP_WORDS)).alias("t")).distinct()
    return G.exact_matches(words, G.entities(edges(spark, sf_dir)))


def kg_fuzzy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords of every fiftieth question and the entities they touch."""
    return G.fuzzy_matches(_words(spark, sf_dir), G.entities(edges(spark, sf_dir)))


def kg_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The route of every question."""
    return bank(spark, sf_dir).select("id", G.route(F.col("question")).alias("route")).distinct()


def kg_what_is(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is known of every entity."""
    return G.what_is(edges(spark, sf_dir), chunks(spark, sf_dir))


def kg_how_to(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How every entity is used."""
    return G.how_to(edges(spark, sf_dir), chunks(spark, sf_dir))


def kg_attribute_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes that match the keywords of every fiftieth question."""
    return G.attribute_lookup(edges(spark, sf_dir), _words(spark, sf_dir))


def kg_list_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty names of each type."""
    return G.list_by_type(edges(spark, sf_dir))


def kg_term_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten chunks with the most graph terms of every fiftieth question."""
    return G.term_hits(asks(spark, sf_dir), G.term_chunks(edges(spark, sf_dir)))


def prerequisite_graph_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the concept mapping."""
    return G.prerequisite_edges(table(spark, sf_dir, "concept_mapping"))


def prerequisite_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prerequisites of the concepts that a chunk's text names."""
    texts = chunks(spark, sf_dir).select(F.col("id").alias("qid"), F.col("text").alias("query"))
    return G.prerequisite_search(texts, G.prerequisite_edges(table(spark, sf_dir, "concept_mapping")))


_EDGES = """edges AS (SELECT DISTINCT start_node.label AS s_label, start_node.properties.name AS s_name, start_node.properties.schema_type AS s_type, start_node.properties."chunk id" AS s_chunk, relation,
end_node.label AS e_label, end_node.properties.name AS e_name, end_node.properties."chunk id" AS e_chunk, end_node.properties.chunk AS e_text FROM kg_edges)"""
_NAMES = "CASE WHEN starts_with(e_name, '[') THEN json_extract_string(e_name, '$[*]') ELSE [e_name] END"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^[\\s\\u3000\\u00a0]+|[\\s\\u3000\\u00a0]+$', '', 'g')"


_SN = _strip("s_name").replace("\\u3000", "　").replace("\\u00a0", " ")
_ENTITIES = f"""best AS (SELECT {_SN} AS name, max({{'c': coalesce(try_cast(s_chunk AS BIGINT), -1), 't': coalesce(s_type, '')}}) AS r FROM edges WHERE {_SN} <> '' GROUP BY 1),
ents AS (SELECT name, nullif(r.t, '') AS type, CASE WHEN r.c >= 0 THEN r.c END AS chunk FROM best)"""
_INDEX = f"ix AS (SELECT name, relation, string_agg(target, '|' ORDER BY target) AS targets FROM (SELECT DISTINCT {_SN} AS name, relation, unnest({_NAMES}) AS target FROM edges WHERE {_SN} <> '') GROUP BY name, relation)"
_TERMS = f"terms AS (SELECT DISTINCT term, chunk FROM (SELECT s_name AS term, s_chunk AS chunk FROM edges UNION ALL SELECT unnest({_NAMES}), e_chunk FROM edges) WHERE trim(term) <> '' AND chunk IS NOT NULL)"
_WORDS = f"words AS (SELECT qid, unnest({_key('query', _list(GRAPH_STOP_WORDS))}) AS t FROM asks)"
_TEXT = "withtext AS (SELECT name, type, chunk, coalesce(content, '') AS text FROM ents LEFT JOIN (SELECT DISTINCT chunk_id, content FROM refined_document_chunks WHERE content IS NOT NULL) ON chunk = chunk_id)"
_PRE = "pre AS (SELECT DISTINCT concept AS start_name, '前置知识' AS relation, prereq AS end_name, nullif(chunk_key, 'null') AS chunk FROM concept_mapping)"
_ROUTE = "CASE WHEN question IS NULL OR regexp_matches(question, '^[\\s　]*$') THEN 'prompt' " + " ".join(f"WHEN regexp_matches(lower(question), '{w}') THEN '{n}'" for n, w in G.ROUTES) + " ELSE 'entity' END"
_HOW = _list(G.HOW_TO_WORDS)

QUERIES = {
    f.__name__: f
    for f in (
        kg_relation_counts, kg_label_counts, kg_edge_shapes, kg_top_degree, kg_relation_richness, kg_statistics, kg_entities, kg_entity_index, kg_term_chunks, kg_exact_match, kg_fuzzy_match, kg_route,
        kg_what_is, kg_how_to, kg_attribute_lookup, kg_list_by_type, kg_term_hits, prerequisite_graph_build, prerequisite_search,
    )
}

SQL = {
    "kg_relation_counts": f"WITH {_EDGES} SELECT relation, count(*) AS n FROM edges GROUP BY relation",
    "kg_label_counts": f"WITH {_EDGES} SELECT label, sum(s) AS starts, sum(1 - s) AS ends, count(*) AS total FROM (SELECT s_label AS label, 1 AS s FROM edges UNION ALL SELECT e_label, 0 FROM edges) GROUP BY label",
    "kg_edge_shapes": f"""WITH {_EDGES} SELECT count(*) FILTER (s_label = 'entity' AND e_label = 'entity') AS ee, count(*) FILTER (s_label = 'entity' AND e_label = 'attribute') AS ea,
count(*) - count(*) FILTER (s_label = 'entity' AND e_label IN ('entity', 'attribute')) AS other FROM edges""",
    "kg_top_degree": f"WITH {_EDGES} SELECT s_name, count(*) AS n FROM edges WHERE s_name IS NOT NULL GROUP BY s_name ORDER BY n DESC, s_name LIMIT 10",
    "kg_relation_richness": f"WITH {_EDGES} SELECT s_name, count(DISTINCT relation) FILTER (relation <> 'has_attribute') AS n FROM edges WHERE s_name IS NOT NULL GROUP BY s_name ORDER BY n DESC, s_name LIMIT 10",
    "kg_statistics": f"WITH {_EDGES} SELECT count(DISTINCT s_name) AS entities, count(*) AS edges, count(DISTINCT s_chunk) AS chunks, count(DISTINCT s_type) AS types FROM edges",
    "kg_entities": f"WITH {_EDGES}, {_ENTITIES} SELECT name, type, chunk FROM ents",
    "kg_entity_index": f"WITH {_EDGES}, {_INDEX} SELECT name, relation, targets FROM ix",
    "kg_term_chunks": f"WITH {_EDGES}, {_TERMS} SELECT term, chunk FROM terms",
    "kg_exact_match": f"WITH {_EDGES}, {_ENTITIES}, asks AS (SELECT DISTINCT s_name AS qid, s_name AS query FROM edges WHERE s_name IS NOT NULL), {_WORDS} SELECT DISTINCT qid, name FROM words JOIN ents ON lower(name) = t",
    "kg_fuzzy_match": f"WITH {_EDGES}, {_ENTITIES}, {_BANK}, {_WORDS} SELECT t, name FROM (SELECT DISTINCT t FROM words) JOIN ents ON contains(name, t) OR contains(t, name)",
    "kg_route": f"SELECT DISTINCT qa_id AS id, {_ROUTE} AS route FROM answered_questions",
    "kg_what_is": f"""WITH {_EDGES}, {_ENTITIES}, {_INDEX}, {_TEXT} SELECT name, type, coalesce(targets, '') AS attributes, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS snippet
FROM withtext LEFT JOIN (SELECT name, targets FROM ix WHERE relation = 'has_attribute') USING (name)""",
    "kg_how_to": f"""WITH {_EDGES}, {_ENTITIES}, {_TEXT}, parts AS (SELECT name, text, list_filter(list_transform(string_split_regex(text, '[。！？\\n]'), lambda s: trim(s, ' \\t\\r\\n　 ')), lambda s: length(s) > 10 AND len(list_filter({_HOW}, lambda w: contains(s, w))) > 0) AS l FROM withtext)
SELECT name, CASE WHEN len(l) > 0 THEN array_to_string(l[1:3], '|') ELSE substr(text, 1, 300) END AS steps FROM parts""".replace("\\t\\r\\n", "\t\r\n"),
    "kg_attribute_lookup": f"""WITH {_EDGES}, {_BANK}, {_WORDS}, own AS (SELECT DISTINCT {_SN} AS name, unnest({_NAMES}) AS attribute FROM edges WHERE relation = 'has_attribute')
SELECT t, name, attribute FROM (SELECT DISTINCT t FROM words) JOIN own ON contains(attribute, t) OR contains(t, attribute) WHERE name <> '' AND trim(attribute) <> ''""",
    "kg_list_by_type": f"WITH {_EDGES}, {_ENTITIES} SELECT * FROM (SELECT type, name, row_number() OVER (PARTITION BY type ORDER BY name) AS rank FROM ents WHERE type IS NOT NULL) WHERE rank <= 20",
    "kg_term_hits": f"""WITH {_EDGES}, {_BANK}, {_TERMS} SELECT * FROM (SELECT qid, chunk, hits, row_number() OVER (PARTITION BY qid ORDER BY hits DESC, chunk) AS rank
FROM (SELECT qid, chunk, count(*) AS hits FROM asks JOIN terms ON contains(query, term) GROUP BY qid, chunk)) WHERE rank <= 10""",
    "prerequisite_graph_build": f"WITH {_PRE} SELECT * FROM pre",
    "prerequisite_search": f"""WITH {_PRE}, asks AS (SELECT DISTINCT chunk_id AS qid, content AS query FROM refined_document_chunks WHERE content IS NOT NULL)
SELECT qid, start_name AS concept, end_name AS prereq, min(try_cast(chunk AS BIGINT)) AS chunk FROM asks JOIN pre ON contains(query, start_name) WHERE trim(end_name) <> '' GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY qid, start_name, end_name"),
}
