"""Small cases with expectations derived by hand, and properties."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.functions.text import jaccard, keywords, prefix, strip, tokens
from lectern.operators import citations as C
from lectern.operators import filters as X
from lectern.operators import retrieval as R
from lectern.operators import status as S
from lectern.operators import textbook as T


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values()) or (1,)], list(values) or ["x"]).select(column.alias("out")).first()["out"]


def test_strip_and_prefix(spark):
    assert one(spark, strip(F.col("t")), t="　 a b\t\n") == "a b"
    assert one(spark, prefix(F.col("t"), 3), t="abcd") == "abc..."
    assert one(spark, prefix(F.col("t"), 3), t="abc") == "abc"


def test_tokens(spark):
    assert one(spark, tokens(F.col("t")), t="B+ Tree 二叉堆 树") == ["b", "tree", "二叉", "叉堆"]
    assert one(spark, keywords(F.col("t")), t="tree 可以 tree a") == ["tree"]


def test_jaccard(spark):
    assert one(spark, jaccard(F.split("a", " "), F.split("b", " ")), a="aa bb", b="bb cc") == pytest.approx(1 / 3)
    assert one(spark, jaccard(F.array().cast("array<string>"), F.split("b", " ")), b="bb") == 0


def test_sentences_and_packing(spark):
    text = "甲。乙！ 丙？丁 end! next?  tail"
    assert one(spark, T.sentences(F.col("t")), t=text) == ["甲。", "乙！", "丙？", "丁 end!", "next?", "tail"]
    assert one(spark, T.sentences(F.col("t")), t="a。b！") == ["a。", "b！", ""]
    assert one(spark, T.packed(F.col("t"), 8), t=text) == ["甲。乙！丙？", "丁 end!", "next?", "tail"]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text("ab中。！ ", max_size=40), min_size=1, max_size=6))
def test_packing_keeps_order_and_limit(spark, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("t", T.packed(F.col("t"), 8).alias("p"), T.sentences(F.col("t")).alias("s")).collect()
    for r in rows:
        assert "".join("".join(r["p"]).split()) == "".join(r["t"].split())
        assert all(len(p) <= 8 or any(p == s.strip() for s in r["s"]) for p in r["p"])


def test_heading_levels(spark):
    docs = spark.createDataFrame([(1, "# 第1章 A\n# 1.1 B\n# C\n# D\n# 1.2 E"), (2, "# 第1章 A\n# 习题1\n# 1. 算法分析题\n# 2. 算法实现题"), (3, None), (4, "no heading")], "id bigint, text string")
    levels = {(r["id"], r["line_no"]): r["level"] for r in T.heading_levels(docs).collect()}
    assert [levels[1, k] for k in range(5)] == [1, 2, 3, 4, 2]
    paths = sorted((r["id"], r["line_no"], r["level"], r["path"]) for r in T.heading_paths(docs).collect())
    assert [p[2] for p in paths if p[0] == 2] == [1, 2, 3, 3]
    assert paths[3][3] == "第1章 A > B > C > D"
    chunks = T.chunk_documents(docs.where("text is not null")).where("id = 4").collect()
    assert [(c["seq"], c["title"], c["content"]) for c in chunks] == [(0, T.INTRO_TITLE, "no heading")]


def test_exercises_and_problems(spark):
    docs = spark.createDataFrame([(1, "# 第2章 X\n1.1-1 q one\n*1.1-2 q two\n1.1-3 .x"), (2, "# 1-1 P\nbody\n[skip\n# 第2章 B\ntail")], "id bigint, text string")
    assert [(r["ex_id"], r["question"], r["chapter"]) for r in T.exercises(docs).orderBy("line_no").collect()] == [("1.1-1", "q one", "第2章 X"), ("1.1-2", "q two", "第2章 X")]
    p = T.problems(docs).collect()
    assert [(r["prob_id"], r["title"], r["content"], r["question"]) for r in p] == [("1-1", "P", "body tail", "P\nbody tail")]


def test_question_detection(spark):
    text = "练习 1 给出一个真实世界的例子并说明其中包含的计算问题"
    ask = T.is_question(F.col("c"), F.col("t"), F.array("p"))
    assert one(spark, ask, c=text, t="练习", p="y") is True
    assert one(spark, ask, c=text, t="x", p="y") is False
    assert one(spark, ask, c="练习 1 短", t="练习", p="习题") is False


def test_dense_ids(spark):
    rows = spark.createDataFrame([(25, 1), (3, 2), (3, 1), (70_000, 1)], "k bigint, part int")
    got = T.dense_ids(rows, "k", "part").orderBy("dense_id").collect()
    assert [(r["dense_id"], r["k"], r["part"]) for r in got] == [(1, 3, 1), (2, 3, 2), (3, 25, 1), (4, 70_000, 1)]


def test_length_buckets(spark):
    rows = spark.createDataFrame([(n,) for n in (99, 100, 499, 500, 999, 1000, 1999, 2000)], "n int").groupBy(T.length_buckets(F.col("n")).alias("b")).count().collect()
    assert {r["b"]: r["count"] for r in rows} == {"<100": 1, "100-500": 2, "500-1000": 2, "1000-2000": 2, ">=2000": 1}


def test_citations(spark):
    used = F.array(F.lit(5), F.lit(3), F.lit(3))
    assert one(spark, C.renumbered(F.col("t"), used), t="a[3] b[5] c[3]") == "a[1] b[2] c[1]"
    assert one(spark, C.renumbered(F.col("t"), F.expr("cast(array() as array<int>)")), t="a[3]") == "a[3]"
    v = one(spark, C.validity(F.col("t"), F.array(F.lit(2), F.lit(3))), t="x[1][2]")
    assert (v["valid"], v["missing"], v["extra"]) == (False, [3], [1])
    assert one(spark, C.renumbered(F.col("t"), F.array(*map(F.lit, (1, 2, 3)))), t="[1][2][3]") == "[1][2][3]"


def test_display_sources_keep_old_numbers(spark):
    hits = spark.createDataFrame([(1, 7, 3), (1, 3, 5), (1, 7, 6), (1, 5, 9)], "qid int, id int, rank int")
    sources = spark.createDataFrame([(7, "A", "a"), (3, None, "b"), (5, "C", None)], "id int, book string, title string")
    got = [(r["number"], r["old"], r["id"], r["source"]) for r in C.display_sources(hits, sources).orderBy("number").collect()]
    assert got == [(1, 3, 7, "《A》-a"), (2, 5, 3, "《未知来源》-b"), (3, 9, 5, "《C》-")]


def test_statuses(spark):
    probe = S.probe_status(F.col("c"), F.col("k"))
    cases = [(403, "text/html", "blocked"), (404, "text/html", "dead"), (200, "application/pdf", "non_html"), (302, "text/html", "alive"), (500, "text/html", "error"), (None, None, "timeout")]
    rows = spark.createDataFrame(cases, "c int, k string, expected string").select("expected", probe.alias("got")).collect()
    assert all(r["got"] == r["expected"] for r in rows)
    status = S.evaluation_status(F.col("a"), F.lit(True), F.lit(False))
    assert one(spark, status, a="抱歉，错误") == "hallucination_flagged"
    query = one(spark, S.evaluation_query(F.col("t"), F.col("b")), t="T", b="x" * 2001)
    assert query == "T\n\n" + "x" * 2000 + "\n\n[...truncated...]"


def test_boolean_query(spark):
    rows = spark.createDataFrame([("Hash Table here",), ("list",), ("hash table and list",), (None,)], "t string")
    q = X.BooleanQuery('("hash table" OR list) AND NOT list')
    assert [r["t"] for r in rows.where(q.column(F.col("t"))).collect()] == ["Hash Table here"]
    for bad in ("", "NOT a", "a b", "(a", "a AND", 'a "b'):
        with pytest.raises(ValueError):
            X.BooleanQuery(bad)


def test_tfidf_idf(spark):
    docs = spark.createDataFrame([(1, "aa bb"), (2, "aa bb"), (3, "aa cc"), (4, "aa")], "id int, text string")
    idf = {r["tok"]: r["idf"] for r in R.tfidf_idf(docs).collect()}
    assert set(idf) == {"aa", "bb"}
    assert idf["bb"] == pytest.approx(0.28768207) and idf["aa"] < 0


def test_fused_rankings(spark):
    a = spark.createDataFrame([(1, 7, 1), (1, 3, 2)], "qid int, id int, rank int")
    b = spark.createDataFrame([(1, 7, 1), (1, 5, 2)], "qid int, id int, rank int")
    assert [(r["number"], r["id"]) for r in R.fused(a, b).orderBy("number").collect()] == [(1, 7), (2, 3), (3, 5)]


def test_nearest_finds_itself(spark):
    v = spark.createDataFrame([(i, [float(i % 7), float(i % 5), 1.0]) for i in range(40)], "id bigint, v array<float>")
    got = R.nearest(v, v.select(F.col("id").alias("qid"), "v"), k=1).collect()
    assert len(got) == 40 and all(r["dist"] == 0 and r["id"] == r["qid"] % 35 for r in got)
    assert R.nearest(v, v.where("id < 0").select(F.col("id").alias("qid"), "v")).count() == 0


def test_nearest_ties_go_to_the_smaller_ids(spark):
    # 300 equal vectors with falling ids, then 60 whose distances differ by less than the rounding, the farther with the smaller id
    rows = [(1_000 - i, [1.0, 0.0]) for i in range(300)] + [(j, [5.0, 1e-5 * (60 - j)]) for j in range(60)]
    v = spark.createDataFrame(rows, "id bigint, v array<float>").coalesce(1)
    asks = spark.createDataFrame([(1, [1.0, 0.0]), (2, [5.0, 0.0]), (3, [2.0, 0.0])], "qid bigint, v array<float>")
    got = {}
    for r in R.nearest(v, asks, k=4).orderBy("qid", "rank").collect():
        got.setdefault(r["qid"], []).append((r["id"], r["dist"]))
    assert got == {1: [(i, 0.0) for i in range(701, 705)], 2: [(i, 0.0) for i in range(4)], 3: [(i, 1.0) for i in range(701, 705)]}
