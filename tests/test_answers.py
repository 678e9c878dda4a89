"""Composed answers, crawling, converters and writers on small fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from lectern.functions.clients import OfflineClient, answers_to, book_metadata, completed, configured, settings_of
from lectern.operators import citations as C
from lectern.operators import graph as G
from lectern.operators import retrieval as R
from lectern.operators import scoring as S
from lectern.operators import textbook as T
from lectern.plans.answers import smart_answers
from lectern.sources import readers, web, writers
from lectern.sources.scratch import cut_lineage, discard


def test_formatted_citations(spark):
    answers = spark.createDataFrame([(1, "a[3] b【5】 c[3]7", [5, 3]), (2, "plain", []), (3, "x[9]", [9])], "qid int, answer string, used array<int>")
    sources = spark.createDataFrame([(1, 3, "S3"), (1, 5, "S5"), (1, 4, "S4"), (3, 8, "S8")], "qid int, old int, source string")
    got = {r["qid"]: (r["answer"], r["citations"]) for r in C.formatted(answers, sources).collect()}
    assert got == {1: ("a[1] b【2】 c[3]7", ["S3", "S5"]), 2: ("plain", []), 3: ("x[1]", [])}


def graph(spark):
    rows = [("快速排序", "算法", "1", "has_attribute", "时间复杂度"), ("快速排序", "算法", "1", "uses", "递归"), ("二叉堆", "数据结构", "2", "has_attribute", "高度"), ("归并排序", "算法", None, "uses", "递归")]
    edges = spark.createDataFrame(rows, "s_name string, type string, chunk string, relation string, e_name string")
    nested = edges.select(
        F.struct(F.lit("e").alias("label"), F.struct(F.col("s_name").alias("name"), F.col("type").alias("schema_type"), F.col("chunk").alias("chunk id")).alias("properties")).alias("start_node"), "relation",
        F.struct(F.lit("e").alias("label"), F.struct(F.col("e_name").alias("name"), F.lit(None).cast("string").alias("chunk id"), F.lit(None).cast("string").alias("chunk")).alias("properties")).alias("end_node"))
    return G.flat_edges(nested)


def test_graph_answers(spark):
    chunks = spark.createDataFrame([(1, "快速排序选取主元来划分序列。可以用递归的方法实现它的步骤。稳定性在这里不能保证。")], "id bigint, text string")
    asks = [(1, "什么是快速排序"), (2, "如何实现快速排序"), (3, "快速排序的时间复杂度"), (4, "快速排序的稳定性"), (5, "列出算法"), (6, "快速排序 二叉堆"), (7, " "), (8, "什么是xyz"), (9, "xyz")]
    got = {r["qid"]: r["answer"] for r in G.kg_answer(graph(spark), chunks, spark.createDataFrame(asks, "qid int, query string")).collect()}
    assert len(got) == len(asks)
    assert got[1].startswith("快速排序（算法）") and "时间复杂度" in got[1]
    assert "步骤" in got[2] and got[7] == G.NO_QUESTION and got[9] == G.NOT_UNDERSTOOD and "没有找到" in got[8]
    assert got[5].startswith("找到2个相关项目") and "- 归并排序" in got[5]
    assert "快速排序（算法）" in got[6] and "二叉堆（数据结构）" in got[6]


def test_attribute_answers(spark):
    df = spark.createDataFrame([("堆", "高度", ["高度"], ""), ("堆", "稳定性", [], "一句。稳定性在这里不能保证。"), ("堆", "颜色", [], "无")], "n string, w string, a array<string>, t string")
    got = [r[0] for r in df.select(G.attribute_answer(F.col("n"), F.col("w"), F.col("a"), F.col("t"))).collect()]
    assert got == ["堆的高度属性已找到。", "关于堆的稳定性：稳定性在这里不能保证", "抱歉，没有找到关于堆的颜色属性的信息。"]


def test_containment_is_that_of_a_nested_loop(spark):
    words = ["ab", "b", "abc", "中文", "文", "", "zz"]
    names = ["xabc", "abab", "b", "中文字", "c", None, ""]
    a, b = spark.createDataFrame([(w,) for w in words], "t string"), spark.createDataFrame([(n,) for n in names], "name string")
    assert {tuple(r) for r in R.contained(a, b).collect()} == {(w, n) for w in words for n in names if w and n and w in n}
    assert {tuple(r) for r in R.either_contains(a, b).collect()} == {(w, n) for w in words for n in names if w and n and (w in n or n in w)}
    asks = spark.createDataFrame([(1, "xx abc"), (2, None), (3, "b")], "qid int, query string")
    terms = spark.createDataFrame([("abc",), ("b",), (None,)], "term string")
    assert {tuple(r) for r in G.mentioned(asks, terms).collect()} == {tuple(r) for r in G.mentioned(asks, terms, most_sent=1).collect()} == {(1, "abc"), (1, "b"), (3, "b")}


def test_searches_of_empty_and_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "hash table"), (1, "hash table"), (2, None), (3, "")], "id bigint, text string")
    asks = spark.createDataFrame([(7, "hash hash"), (8, "")], "qid bigint, query string")
    for search in (R.bm25, R.keyword_overlap):
        assert [(r["qid"], r["id"], r["rank"]) for r in search(docs, asks).collect()] == [(7, 1, 1)]
        assert search(docs.limit(0), asks).count() == 0 and search(docs, asks.limit(0)).count() == 0
    assert R.tfidf_cosine(docs, asks).count() == 0 and R.tfidf_cosine(docs.limit(0), asks).count() == 0
    bank = docs.select("id", F.col("text").alias("question"), F.lit(None).cast("string").alias("chapter"), F.lit(None).cast("string").alias("answer"))
    assert [(r["id"], r["score"]) for r in R.hybrid(bank, asks).collect()] == [(1, 0.15)] and R.hybrid(bank.limit(0), asks).count() == 0


def test_parts_and_blocks_give_what_one_part_gives(spark, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * k) % 17}" for k in range(1, 9))) for i in range(60)], "id bigint, text string")
    asks = docs.where("id % 7 = 0").select(F.col("id").alias("qid"), F.col("text").alias("query"))
    whole = [sorted(map(tuple, f(docs, asks, 5).collect())) for f in (R.bm25, R.tfidf_cosine, R.keyword_overlap)]
    met, dealt = S.met, S.dealt
    monkeypatch.setattr(S, "met", lambda d, a, n, m, run, schema, own=None, **_: met(d, a, n, m, run, schema, own, size=11, block=2))
    monkeypatch.setattr(S, "dealt", lambda d, n, key="id", **_: dealt(d, n, key, size=11))
    assert whole == [sorted(map(tuple, f(docs, asks, 5).collect())) for f in (R.bm25, R.tfidf_cosine, R.keyword_overlap)]


def test_extraction(spark):
    rows = [(1, "练习", "练习 1 给出一个真实世界的例子并说明其中包含的计算问题", ["第1章", "练习"], "书"), (2, "x", "练习 1 给出一个真实世界的例子并说明其中包含的计算问题", ["y"], "书"), (3, "练习", "短", None, None)]
    df = spark.createDataFrame(rows, "id int, title string, content string, path array<string>, book string")
    got = T.extracted_questions(df).collect()
    assert [(r["id"], r["class"], r["source"]) for r in got] == [(1, "single", "第1章 -> 练习 | 书")]
    assert tuple(T.extraction_statistics(df).first()) == (3, 1, 1, 0)


def test_numbered_metadata(spark):
    df = spark.createDataFrame([({"title": "B"}, ["1", "1.2"]), ({"title": "B"}, [" "]), (None, ["3"]), (None, None)], "m map<string,string>, n array<string>")
    got = [r[0] for r in df.select(T.numbered_metadata(F.col("m"), F.col("n"))).collect()]
    assert got == [{"title": "B", "chapter_numbering": "1.2"}, {"title": "B"}, {"chapter_numbering": "3"}, None]


def test_smart_answers(spark):
    chunks = spark.createDataFrame([(1, "hash table collisions"), (2, "递归 and 分治")], "id bigint, text string")
    asks = spark.createDataFrame([(7, "hash table"), (8, "快速排序 of a hash table, and its recursion, explained at length for everybody who asks")], "qid bigint, query string")
    sources = spark.createDataFrame([(1, "Book", "Hashing"), (2, None, None)], "id bigint, book string, title string")
    bank = spark.createDataFrame([(1, "recursion, explained at length", "c", "yes")], "id bigint, question string, chapter string, answer string")
    concepts = G.prerequisite_edges(spark.createDataFrame([("快速排序", "递归", "2")], "concept string, prereq string, chunk_key string"))
    got = {r["qid"]: r for r in smart_answers(asks, chunks, None, sources, bank, concepts, OfflineClient()).collect()}
    assert got[7]["answer"] == "According to the sources [1]." and got[7]["citations"] == ["《Book》-Hashing"] and not got[7]["prerequisites"] and not got[7]["related"]
    assert got[8]["prerequisites"][0]["prereq"] == "递归" and got[8]["related"][0]["answer"] == "yes"


def test_web(spark):
    def fetch(method, url):
        if "down" in url:
            raise OSError("no route")
        if url.endswith("/robots.txt"):
            if "closed" in url:
                raise OSError("no rules")
            return web.Reply(200, url, "text/plain", "User-agent: *\nDisallow: /private")
        if method == "HEAD" and "strict" in url:
            return web.Reply(405, url)
        return web.Reply(200, url, "text/html; charset=utf-8", "" if "blank" in url else "text", "T", "")

    urls = ["http://a.org/x", "http://a.org/private/y", "http://closed.org/z", "http://down.org/", "http://strict.org/", "http://a.org/blank", "http://a.org/x", None]
    df = spark.createDataFrame([(u, i) for i, u in enumerate(urls)], "url string, number int")
    got = {r["url"]: (r["status"], r["http_status"], r["error"]) for r in web.probed(df, fetch, 2).collect()}
    assert got["http://strict.org/"] == ("alive", 200, None) and got["http://down.org/"] == ("timeout", None, "no route") and len(got) == 6
    assert {r["url"] for r in web.allowed(df, fetch).collect()} == {"http://a.org/x", "http://a.org/blank", "http://strict.org/"}
    pages = {r["url"]: (r["status"], r["error"]) for r in web.crawled(df, fetch).collect()}
    assert pages["http://a.org/x"] == ("success", None) and pages["http://a.org/blank"] == ("empty_content", None) and pages["http://down.org/"] == ("error", "no route")
    assert web.first_pages(df, 2).count() == 2 and tuple(web.pages_per_host(df.where("url is not null")).first()) == ("a.org", 3, 1)
    assert web.probed(df.limit(0), fetch).count() == 0


def test_clients(spark, tmp_path):
    class Flaky(OfflineClient):
        def complete(self, prompt):
            if "bad" in prompt:
                raise OSError
            return "reply"

    df = spark.createDataFrame([("bad",), ("good",)], "q string")
    assert [r["a"] for r in answers_to(df, "q", "a", Flaky(), wait=0.0, pause=0.0).collect()] == [T.FAILED, "reply"]
    assert [r["a"] for r in completed(df, "q", "a", Flaky(), tries=1).collect()] == ["", "reply"]
    books = spark.createDataFrame([("b", "line\nline")], "name string, text string")
    assert book_metadata(books, OfflineClient()).first()["metadata"] == {"title": "", "author": "", "year": "", "extra": ""}
    (tmp_path / "s.json").write_text(json.dumps({"llm": {"provider": [{"url": "https://api.deepseek.com/v1", "model": None}]}}))
    assert configured(settings_of(str(tmp_path / "s.json")), "llm", {"model": "m", "n": 1}, n=2) == {"url": "https://api.deepseek.com/v1/chat/completions", "model": "m", "n": 2}
    assert settings_of(str(tmp_path / "none.json")) == {}


def test_converters_and_cache(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"abc")
    files = readers.external_file(spark, str(tmp_path / "a.pdf"))
    made = readers.converted(files, lambda content, method: f"{method}:{len(content)}")
    assert [tuple(r) for r in made.collect()] == [("a.pdf", "text:3")]
    with pytest.raises(ValueError):
        readers.converted(files, lambda c, m: "", "none")
    cache = str(tmp_path / "cache")
    assert readers.uncached(files, cache).count() == 1
    made.write.parquet(cache)
    assert readers.uncached(files, cache).count() == 0 and readers.uncached(files, cache, force=True).count() == 1


def test_writers(spark, tmp_path):
    path = str(tmp_path / "qa.json")
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, answer string")
    df.write.json(path)
    read = writers.read_list(spark, path, "id int, answer string")
    writers.swap_json(read.fillna("new"), path)
    assert {tuple(r) for r in spark.read.json(path).select("id", "answer").collect()} == {(1, "a"), (2, "new")}
    (tmp_path / "x.json").write_text("3")
    with pytest.raises(ValueError):
        writers.read_list(spark, str(tmp_path / "x.json"), "id int")
    (tmp_path / "l.json").write_text('[{"id": 5}]')
    assert writers.read_list(spark, str(tmp_path / "l.json"), "id int").first()[0] == 5
    writers.write_excel_csv(df, str(tmp_path / "c"))
    assert next((tmp_path / "c").glob("*.csv")).read_bytes().startswith(b"\xef\xbb\xbf")
    writers.write_object(df, "id", "answer", str(tmp_path / "o"))
    writers.write_prerequisites(spark.createDataFrame([("c", "b"), ("c", "a")], "concept string, prereq string"), str(tmp_path / "p"))
    assert [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "p")).collect()] == [{"c": ["a", "b"]}]


def test_written_results_can_be_discarded(spark):
    before = spark.conf.get("spark.checkpoint.dir", None)
    df = cut_lineage(spark.range(5).toDF("id"))
    assert df.count() == 5
    discard(df)
    with pytest.raises(Exception, match="(?i)exist|not found"):
        df.count()
    assert spark.conf.get("spark.checkpoint.dir", None) == before
