"""Knowledge-graph tables, statistics, lookups and prerequisite search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions.text import GRAPH_STOP_WORDS, is_blank, keywords, strip
from lectern.operators.retrieval import contained, either_contains

#: Question words by which a question is routed, in the order in which they are tried.
ROUTES = [("what_is", "什么是|什么叫|解释"), ("how_to", "如何|怎么|怎样|方法"), ("attribute", "的|有什么|包含|具有"), ("list", "有哪些|列出|列表|所有")]
#: Words of sentences that tell how something is done.
HOW_TO_WORDS = ["如何", "方法", "步骤", "应该", "需要", "可以", "实现", "操作", "进行"]
#: The concepts that a question may name where no table of concepts is given.
ALGORITHM_CONCEPTS = [
    "枚举", "递归", "分治", "二分查找", "归并排序", "快速排序", "堆排序", "插入排序", "冒泡排序", "选择排序", "计数排序", "桶排序", "基数排序", "滑动窗口", "双指针", "前缀和", "贪心算法", "Kruskal", "Prim",
    "最小区间覆盖", "Dijkstra", "Huffman编码", "作业调度", "最小字典序构造", "动态规划", "最长公共子序列", "背包问题", "编辑距离", "最近点对", "DFS", "BFS", "图连通块", "拓扑排序", "最短路径", "最小步数",
    "回溯", "N皇后", "图着色", "剪枝", "最小生成树", "网络流", "KMP", "局部搜索", "模拟退火", "遗传算法",
]


def name_list(name: Column) -> Column:
    """A node's names: a JSON list of strings is taken apart."""
    return F.when(name.startswith("["), F.coalesce(F.from_json(name, "array<string>"), F.array(name))).otherwise(F.array(name))


def flat_edges(kg: DataFrame) -> DataFrame:
    """The distinct edges, flat: ``s_label, s_name, s_type, s_chunk, relation, e_label, e_name, e_chunk, e_text``."""
    s, e = F.col("start_node"), F.col("end_node")
    sp, ep = s.getField("properties"), e.getField("properties")
    return kg.select(
        s.getField("label").alias("s_label"), sp.getField("name").alias("s_name"), sp.getField("schema_type").alias("s_type"), sp.getField("chunk id").alias("s_chunk"), "relation",
        e.getField("label").alias("e_label"), ep.getField("name").alias("e_name"), ep.getField("chunk id").alias("e_chunk"), ep.getField("chunk").alias("e_text"),
    ).distinct()


def relation_counts(edges: DataFrame) -> DataFrame:
    """Edges of each relation."""
    return edges.groupBy("relation").agg(F.count("*").alias("n"))


def label_counts(edges: DataFrame) -> DataFrame:
    """How often each label stands at the start, at the end and at both together."""
    both = edges.select(F.explode(F.array(F.struct(F.col("s_label").alias("label"), F.lit(1).alias("s")), F.struct(F.col("e_label").alias("label"), F.lit(0).alias("s")))).alias("x")).select("x.*")
    return both.groupBy("label").agg(F.sum("s").alias("starts"), F.sum(1 - F.col("s")).alias("ends"), F.count("*").alias("total"))


def edge_shapes(edges: DataFrame) -> DataFrame:
    """One row: edges from entity to entity, from entity to attribute, and other ones."""
    ee = (F.col("s_label") == "entity") & (F.col("e_label") == "entity")
    ea = (F.col("s_label") == "entity") & (F.col("e_label") == "attribute")
    return edges.agg(F.count_if(ee).alias("ee"), F.count_if(ea).alias("ea"), F.count_if(F.coalesce(~ee & ~ea, F.lit(True))).alias("other"))


def top_degree(edges: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` start names with the most edges."""
    return edges.where(F.col("s_name").isNotNull()).groupBy("s_name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "s_name").limit(k)


def relation_richness(edges: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` start names with the most different relations, attributes aside."""
    kinds = F.count_distinct(F.when(F.col("relation") != "has_attribute", F.col("relation")))
    return edges.where(F.col("s_name").isNotNull()).groupBy("s_name").agg(kinds.alias("n")).orderBy(F.desc("n"), "s_name").limit(k)


def statistics(edges: DataFrame) -> DataFrame:
    """One row: entities, relations, chunks and types."""
    return edges.agg(F.count_distinct("s_name").alias("entities"), F.count("*").alias("edges"), F.count_distinct("s_chunk").alias("chunks"), F.count_distinct("s_type").alias("types"))


def entities(edges: DataFrame) -> DataFrame:
    """``name, type, chunk``: one record for each start name.

    A table has no first or last edge, so of several records the one with the greatest (chunk number, type) counts.
    """
    record = F.struct(F.coalesce(F.expr("try_cast(s_chunk as bigint)"), F.lit(-1)).alias("c"), F.coalesce("s_type", F.lit("")).alias("t"))
    best = edges.where(~is_blank(F.col("s_name"))).groupBy(strip(F.col("s_name")).alias("name")).agg(F.max(record).alias("r"))
    return best.select("name", F.nullif("r.t", F.lit("")).alias("type"), F.when(F.col("r.c") >= 0, F.col("r.c")).alias("chunk"))


def entity_index(edges: DataFrame) -> DataFrame:
    """``name, relation, targets``: the sorted distinct end names of each start name and relation."""
    flat = edges.where(~is_blank(F.col("s_name"))).select(strip(F.col("s_name")).alias("name"), "relation", F.explode(name_list(F.col("e_name"))).alias("target"))
    # distinct first, so that a hot start name is reduced before its names meet in one place
    return flat.distinct().groupBy("name", "relation").agg(F.array_join(F.array_sort(F.collect_list("target")), "|").alias("targets"))


def term_chunks(edges: DataFrame) -> DataFrame:
    """``term, chunk``: every name of either end with its chunk."""
    start = edges.select(F.col("s_name").alias("term"), F.col("s_chunk").alias("chunk"))
    end = edges.select(F.explode(name_list(F.col("e_name"))).alias("term"), F.col("e_chunk").alias("chunk"))
    return start.unionByName(end).where(~is_blank(F.col("term")) & F.col("chunk").isNotNull()).distinct()


def exact_matches(words: DataFrame, ents: DataFrame) -> DataFrame:
    """``qid, name``: entities whose name is a keyword (qid, t), letter case aside."""
    return words.join(ents.select("name", F.lower("name").alias("t")), "t").select("qid", "name").distinct()


def fuzzy_matches(words: DataFrame, ents: DataFrame) -> DataFrame:
    """``t, name``: keyword and entity name of which one contains the other."""
    return either_contains(words, ents)


def matches(words: DataFrame, ents: DataFrame) -> DataFrame:
    """``qid, name``: the entities that a keyword (qid, t) names exactly; where there is none, those it touches."""
    exact = exact_matches(words, ents)
    rest = words.join(exact.select("qid").distinct(), "qid", "left_anti")
    return exact.unionByName(rest.join(fuzzy_matches(rest, ents), "t").select("qid", "name").distinct())


def mentioned(asks: DataFrame, terms: DataFrame, most_sent: int = 10_000) -> DataFrame:
    """``qid, term`` where the query contains the term. Up to ``most_sent`` terms, which are counted, are sent to all
    queries; more of them meet the queries by pairs of characters."""
    terms = terms.select("term").where("term is not null").distinct()
    if terms.limit(most_sent + 1).count() <= most_sent:
        return asks.join(F.broadcast(terms), F.col("query").contains(F.col("term"))).select("qid", "term")
    hit = contained(terms.select(F.col("term").alias("t")), asks.select(F.col("query").alias("name")))
    return asks.join(hit.withColumnsRenamed({"name": "query", "t": "term"}), "query").select("qid", "term")


def route(question: Column) -> Column:
    """Which kind of answer a question asks for."""
    out = F.when(is_blank(question), "prompt")
    for name, words in ROUTES:
        out = out.when(F.lower(question).rlike(words), name)
    return out.otherwise("entity")


def with_text(ents: DataFrame, chunks: DataFrame) -> DataFrame:
    """The entities with the text of their chunk, '' where there is none (chunks: id, text)."""
    return ents.join(chunks, ents["chunk"] == chunks["id"], "left").select("name", "type", "chunk", F.coalesce("text", F.lit("")).alias("text"))


def what_is(edges: DataFrame, chunks: DataFrame) -> DataFrame:
    """``name, type, attributes, snippet`` of every entity."""
    own = entity_index(edges).where("relation = 'has_attribute'").select("name", F.col("targets").alias("attributes"))
    text = with_text(entities(edges), chunks)
    snippet = F.when(F.char_length("text") > 200, F.concat(F.substring("text", 1, 200), F.lit("..."))).otherwise(F.col("text"))
    return text.join(own, "name", "left").select("name", "type", F.coalesce("attributes", F.lit("")).alias("attributes"), snippet.alias("snippet"))


def how_to(edges: DataFrame, chunks: DataFrame) -> DataFrame:
    """``name, steps``: the first three sentences of the entity's chunk that tell how; else its first 300 characters."""
    parts = F.transform(F.split("text", "[。！？\\n]"), strip)
    wanted = F.filter(parts, lambda s: (F.char_length(s) > 10) & F.exists(F.array(*map(F.lit, HOW_TO_WORDS)), lambda w: s.contains(w)))
    text = with_text(entities(edges), chunks).withColumn("s", wanted)
    steps = F.when(F.size("s") > 0, F.array_join(F.slice("s", 1, 3), "|")).otherwise(F.substring("text", 1, 300))
    return text.select("name", steps.alias("steps"))


def attribute_lookup(edges: DataFrame, words: DataFrame) -> DataFrame:
    """``t, name, attribute``: attributes that contain a keyword or are part of one."""
    own = edges.where("relation = 'has_attribute'").select(strip(F.col("s_name")).alias("name"), F.explode(name_list(F.col("e_name"))).alias("attribute")).where(~is_blank(F.col("name")) & ~is_blank(F.col("attribute"))).distinct()
    near = either_contains(words, own.select(F.col("attribute").alias("name"))).withColumnRenamed("name", "attribute")
    return near.join(own, "attribute").select("t", "name", "attribute")


def list_by_type(edges: DataFrame, k: int = 20) -> DataFrame:
    """The first ``k`` entity names of each type."""
    ranked = entities(edges).where(F.col("type").isNotNull()).withColumn("rank", F.row_number().over(Window.partitionBy("type").orderBy("name")))
    return ranked.where(F.col("rank") <= k).select("type", "name", "rank")


def prerequisite_edges(mapping: DataFrame) -> DataFrame:
    """Edges of a (concept, prereq, chunk_key) mapping; the text "null" means no chunk."""
    chunk = F.nullif("chunk_key", F.lit("null"))
    # the start node carries the prerequisite's chunk, as the tables of the original do
    return mapping.distinct().select(F.col("concept").alias("start_name"), F.lit("前置知识").alias("relation"), F.col("prereq").alias("end_name"), chunk.alias("chunk"))


def prerequisite_search(asks: DataFrame, edges: DataFrame) -> DataFrame:
    """``qid, concept, prereq, chunk``: prerequisites of the concepts that a query names, each once by its smallest
    chunk number; ``edges`` as made by ``prerequisite_edges``."""
    concepts = edges.select(F.col("start_name").alias("term")).distinct()
    found = mentioned(asks, concepts).withColumnRenamed("term", "start_name").join(edges, "start_name")
    one = found.where(~is_blank(F.col("end_name"))).groupBy("qid", "start_name", "end_name").agg(F.min(F.expr("try_cast(chunk as bigint)")).alias("chunk"))
    return one.select("qid", F.col("start_name").alias("concept"), F.col("end_name").alias("prereq"), "chunk")


def named_concepts(text: Column, concepts: list[str] = ALGORITHM_CONCEPTS) -> Column:
    """The concepts that a text names, in the order of the list."""
    return F.filter(F.array(*map(F.lit, concepts)), lambda c: text.contains(c))


def term_hits(asks: DataFrame, terms: DataFrame, k: int = 10) -> DataFrame:
    """``qid, chunk, hits, rank``: the chunks with the most terms of the query (terms: term, chunk)."""
    names = terms.select("term").distinct()
    hits = mentioned(asks, names).join(terms, "term").groupBy("qid", "chunk").agg(F.count("*").alias("hits"))
    ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("hits"), "chunk")))
    return ranked.where(F.col("rank") <= k)


#: The words that name a type, and the replies where nothing is found.
TYPE_WORDS = ["书籍", "算法", "数据结构", "概念"]
NO_QUESTION, NO_ITEMS = "请输入您的问题。", "抱歉，没有找到相关项目。"
NOT_UNDERSTOOD = "抱歉，我没有理解您的问题。您可以询问关于算法、数据结构、概念等的相关问题。例如：\n- 什么是二分查找？\n- 如何实现快速排序？\n- 有哪些排序算法？"


def candidates(asks: DataFrame, ents: DataFrame, k: int = 10) -> DataFrame:
    """``qid, name, rank``: the entities that a query's keywords name or touch: exact ones first, then those that more
    keywords touch, then by name."""
    words = asks.select("qid", F.explode(keywords(F.col("query"), GRAPH_STOP_WORDS)).alias("t"))
    exact = exact_matches(words, ents).withColumn("exact", F.lit(1))
    touched = words.join(fuzzy_matches(words, ents), "t").select("qid", "name", F.lit(0).alias("exact"))
    every = exact.unionByName(touched).groupBy("qid", "name").agg(F.max("exact").alias("exact"), F.count("*").alias("n"))
    ranked = every.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("exact"), F.desc("n"), "name")))
    return ranked.where(F.col("rank") <= k).select("qid", "name", "rank")


def attribute_answer(name: Column, word: Column, attributes: Column, text: Column) -> Column:
    """The attribute that contains the word or is part of it; else the first sentence of the text with the word."""
    found = F.filter(attributes, lambda a: a.contains(word) | word.contains(a))
    told = F.filter(F.transform(F.split(text, "[。！？\\n]"), strip), lambda s: s.contains(word) & (F.char_length(s) > 5))
    missing = F.concat(F.lit("抱歉，没有找到关于"), name, F.lit("的"), word, F.lit("属性的信息。"))
    return F.when(F.size(found) > 0, F.concat(name, F.lit("的"), F.array_min(found), F.lit("属性已找到。"))).when(F.size(told) > 0, F.concat(F.lit("关于"), name, F.lit("的"), word, F.lit("："), told[0])).otherwise(missing)


def kg_answer(edges: DataFrame, chunks: DataFrame, asks: DataFrame) -> DataFrame:
    """``qid, route, entity, answer`` of every query (qid, query), each by its route.

    The entity is the first candidate. A question for an attribute takes the first keyword that isn't part of the
    entity's name, and tells what the entity is where all are. A list names up to 20 entities of the type that a
    keyword names, of all types otherwise. Any other query is told of up to ten candidates.
    """
    ents = entities(edges).select("name", "type", "chunk")
    routed = asks.withColumn("route", route(F.col("query"))).withColumn("words", keywords(F.col("query"), GRAPH_STOP_WORDS))
    found = candidates(asks, ents)
    first = found.where("rank = 1").select("qid", F.col("name").alias("entity"))
    whatever = what_is(edges, chunks).select(F.col("name").alias("entity"), F.concat_ws("\n", F.concat("name", F.lit("（"), F.coalesce("type", F.lit("")), F.lit("）")), F.nullif("attributes", F.lit("")), F.nullif("snippet", F.lit(""))).alias("what"))
    how = how_to(edges, chunks).select(F.col("name").alias("entity"), F.col("steps").alias("how"))
    own = edges.where("relation = 'has_attribute'").select(strip(F.col("s_name")).alias("entity"), F.explode(name_list(F.col("e_name"))).alias("a")).groupBy("entity").agg(F.collect_set("a").alias("attributes"))
    texts = with_text(entities(edges), chunks).select(F.col("name").alias("entity"), "text")
    intro = F.concat("name", F.lit("（"), F.coalesce("type", F.lit("")), F.lit("）"), F.when(F.col("text") != "", F.concat(F.lit("\n简介："), F.replace(F.substring("text", 1, 100), F.lit("\n"), F.lit(" ")), F.lit("..."))).otherwise(""))
    several = found.join(with_text(ents, chunks), "name").groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", intro.alias("intro")))), lambda x: x["intro"]), "\n\n").alias("several"))

    def listed(by: DataFrame, *key: str) -> DataFrame:
        n = by.groupBy(*key).agg(F.count("*").alias("n"))
        order = Window.partitionBy(*key).orderBy("name") if key else Window.orderBy("name")
        # a first cut by name within a hash part keeps all names out of one task
        some = by.withColumn("p", F.pmod(F.xxhash64("name"), F.lit(64))).withColumn("r", F.row_number().over(Window.partitionBy(*key, "p").orderBy("name"))).where("r <= 20")
        some = some.withColumn("r", F.row_number().over(order)).where("r <= 20").groupBy(*key).agg(F.array_sort(F.collect_list("name")).alias("names"))
        both = some.join(n, list(key)) if key else some.crossJoin(n)
        head = F.concat(F.lit("找到"), F.col("n").cast("string"), F.when(F.col("n") > 20, "个相关项目，前20个：\n").otherwise("个相关项目：\n"))
        return both.select(*key, F.concat(head, F.array_join(F.transform("names", lambda x: F.concat(F.lit("- "), x)), "\n")).alias("listed"))

    by_type = listed(ents.where(F.col("type").isin(TYPE_WORDS)), "type").withColumnsRenamed({"type": "kind", "listed": "typed"})
    every = listed(ents)
    kinds = F.filter("words", lambda w: w.isin(TYPE_WORDS))
    joined = routed.withColumn("kind", F.get(kinds, F.lit(0))).join(first, "qid", "left").join(whatever, "entity", "left").join(how, "entity", "left").join(own, "entity", "left").join(texts, "entity", "left")
    joined = joined.join(several, "qid", "left").join(F.broadcast(by_type), "kind", "left").join(F.broadcast(every), F.lit(True), "left")
    asked = F.get(F.filter("words", lambda w: ~F.col("entity").contains(w)), F.lit(0))
    none = F.concat(F.lit("抱歉，我没有找到关于关键词'"), F.array_join("words", " "), F.lit("'的相关信息。"))
    known = F.col("entity").isNotNull()
    answer = (
        F.when(F.col("route") == "prompt", NO_QUESTION)
        .when(F.col("route") == "list", F.coalesce(F.when(F.col("kind").isNotNull(), F.coalesce("typed", F.lit(NO_ITEMS))), F.col("listed"), F.lit(NO_ITEMS)))
        .when(F.col("route") == "entity", F.coalesce("several", F.lit(NOT_UNDERSTOOD)))
        .when(~known, none)
        .when(F.col("route") == "what_is", F.col("what"))
        .when(F.col("route") == "how_to", F.col("how"))
        .when(asked.isNull(), F.col("what"))
        .otherwise(attribute_answer(F.col("entity"), asked, F.coalesce("attributes", F.array().cast("array<string>")), F.coalesce("text", F.lit(""))))
    )
    return joined.select("qid", "route", "entity", answer.alias("answer"))


def chunk_texts(hits: DataFrame, chunks: DataFrame, most: int = 1000) -> DataFrame:
    """``hits`` with the first ``most`` characters of their chunk's text (chunks: id, text); hits without one are left out."""
    return hits.join(chunks.select(F.col("id").alias("chunk"), F.substring("text", 1, most).alias("text")), "chunk")
