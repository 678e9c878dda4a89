"""Readers, writers, streams, and the question loop with the offline client."""

import json

import pytest
from pyspark.sql import functions as F

from lectern.functions.clients import OfflineClient, configured, decision, embedded, parsed_list
from lectern.plans import agent as A
from lectern.sources import readers as R
from lectern.sources import writers as W
from lectern.streaming.resume import drain, event_counts


def test_json_stores(spark, tmp_path):
    chunk = {"chunk_id": 1, "title": "t", "content": "c", "metadata": {"title": "b"}, "path_titles": ["x"], "path_numbering": ["1"]}
    (tmp_path / "d.json").write_text(json.dumps([chunk, chunk | {"content": "d"}]))
    assert [r["content"] for r in R.docstore(spark, str(tmp_path / "d.json")).collect()] == ["d"]
    assert R.knowledge_graph(spark, str(tmp_path / "none.json")).count() == 0
    edge = {"start_node": {"label": "entity", "properties": {"name": "a", "schema_type": None, "chunk id": "1"}}, "relation": "r", "end_node": {"label": "attribute", "properties": {"name": "b"}}}
    (tmp_path / "kg.json").write_text(json.dumps([edge]))
    assert R.knowledge_graph(spark, str(tmp_path / "kg.json")).select(F.col("start_node.properties").getField("chunk id")).first()[0] == "1"
    with pytest.raises(Exception):
        R.question_bank(spark, str(tmp_path / "none.json")).count()


def test_text_files(spark, tmp_path):
    (tmp_path / "ids.txt").write_text("id: a1\tChunk: one\ntwo\nid: b2\tChunk: x\nid: a1\tChunk: last  one\n")
    assert {r["chunk_key"]: r["text"] for r in R.id_to_chunk(spark, str(tmp_path / "ids.txt")).collect()} == {"a1": "last one", "b2": "x"}
    (tmp_path / "m.json").write_text(json.dumps({"c": {"p": "1", "q": "null"}}))
    assert sorted(tuple(r) for r in R.mapping(spark, str(tmp_path / "m.json")).collect()) == [("c", "p", "1"), ("c", "q", "null")]
    (tmp_path / "p.json").write_text(json.dumps({"c": ["p", "q"]}))
    assert R.prerequisites(spark, str(tmp_path / "p.json")).count() == 2
    folder = tmp_path / "md"
    folder.mkdir()
    (folder / "b.md").write_text("# B\nx")
    (folder / "a.md").write_text("# A")
    (folder / "c.txt").write_text("no")
    assert sorted(r["name"] for r in R.markdown_folder(spark, str(folder)).collect()) == ["a.md", "b.md"]
    (tmp_path / "k.json").write_text(json.dumps({"chunks": [{"heading_chain": "h", "content": "c", "html_content": ""}]}))
    assert R.load_file(spark, str(tmp_path / "k.json")).first()["content"] == "\nheading_chain:\nh\ncontent:\nc\nhtml_content:\n\n"
    with pytest.raises(ValueError):
        R.load_file(spark, "x.unknown")


def test_csv_encodings(spark, tmp_path):
    (tmp_path / "u.csv").write_bytes("﻿Title,Body\né,x\n".encode())
    (tmp_path / "l.csv").write_bytes("Title,Body\né,x\n".encode("latin-1"))
    for name in ("u.csv", "l.csv"):
        df = R.csv_any_encoding(spark, str(tmp_path / name), ("Title",))
        assert df.columns == ["Title", "Body"] and df.first()["Title"] == "é"
    with pytest.raises(ValueError):
        R.csv_any_encoding(spark, str(tmp_path / "u.csv"), ("Nothing",))


def test_writers(spark, tmp_path):
    items = spark.createDataFrame([("exercise", "1.1-1", "c", "q" * 120, "a"), ("exercise", "1.1-2", "c", "q", None)], "type string, id string, chapter string, question string, answer string")
    W.write_summary(items, str(tmp_path / "s"))
    assert sorted(len(r["题目内容"]) for r in spark.read.csv(str(tmp_path / "s"), header=True).collect()) == [1, 103]
    assert W.write_answered(items, str(tmp_path / "f"), str(tmp_path / "a")) and spark.read.json(str(tmp_path / "a")).count() == 1
    out = W.split_source(spark.createDataFrame([("ch | book", "x"), ("book", "y")], "source string, content string")).collect()
    assert [(r["book_name"], r["chapter"]) for r in out] == [("book", "ch"), ("book", "")]
    W.write_mapping(spark.createDataFrame([("c", "p", "1"), ("c", "q", "2")], "concept string, prereq string, chunk_key string"), str(tmp_path / "m"))
    assert sorted(r["prereq"] for r in R.mapping(spark, str(tmp_path / "m")).collect()) == ["p", "q"]
    assert W.pending(spark, items, str(tmp_path / "cp"), "id").count() == 2
    W.append_checkpoint(items.where("answer is not null"), str(tmp_path / "cp"))
    assert W.pending(spark, items, str(tmp_path / "cp"), "id").first()["id"] == "1.1-2"


def test_stream_adds_each_key_once(spark, tmp_path):
    rows = spark.range(5).withColumn("q", F.lit("x"))
    for _ in range(2):
        rows.write.mode("append").parquet(str(tmp_path / "in"))
        drain(spark, str(tmp_path / "in"), "id bigint, q string", str(tmp_path / "out"), str(tmp_path / "cp"), lambda d: d.withColumn("a", F.lit(1)), "id").awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5


def test_event_counts(spark, tiny):
    got = event_counts(spark.read.parquet(f"{tiny}/events.parquet"))
    assert got.agg(F.sum("n")).first()[0] == spark.read.parquet(f"{tiny}/events.parquet").count()


def test_question_loop(spark):
    chunks = spark.createDataFrame([(1, "hash table collisions"), (2, "search tree"), (3, "hash function")], "id bigint, text string")
    asks = spark.createDataFrame([(7, "hash table"), (8, "nothing known")], "qid bigint, query string")
    client = OfflineClient()
    vectors = chunks.select("id", embedded(F.col("text"), client).alias("v"))
    got = {r["qid"]: r for r in A.answered(asks, chunks, vectors, client).collect()}
    assert got[7]["answer"] == "According to the sources [1]." and got[7]["used"] == [1] and got[7]["iterations"] == 1
    steps = A.planned(asks, client)
    assert steps.where("action = 'bm25_search'").count() == 2
    numbers = [(r["number"], r["id"]) for r in A.executed(steps, chunks, None, client).where("qid = 7").orderBy("number").collect()]
    assert numbers[0] == (1, 1) and [n for n, _ in numbers] == list(range(1, len(numbers) + 1))


def test_replies(spark):
    df = spark.createDataFrame([('```json\n["a", "b"]\n```', "{}"), ("plain", "broken")], "l string, d string")
    rows = df.select(parsed_list(F.col("l")).alias("l"), decision(F.col("d")).alias("d")).collect()
    assert rows[0]["l"] == ["a", "b"] and rows[1]["l"] == ["plain"]
    assert all(r["d"]["recommend_qa_bank"] is False and r["d"]["detected_concepts"] == [] for r in rows)
    settings = {"llm": {"use": "a", "provider": {"a": [{"model": "m", "x": None}]}}}
    assert configured(settings, "llm", temperature=0.1) == {"model": "m", "temperature": 0.1}


def test_subproblems():
    assert A.ordered_subproblems({"c": ["a", "b"], "a": [], "b": ["a"], "d": ["x"]}) == [["a", "d"], ["b"], ["c"]]
    with pytest.raises(ValueError):
        A.ordered_subproblems({"a": ["b"], "b": ["a"]})


def test_evidence_is_whole(spark):
    class LastWord(OfflineClient):
        def complete(self, prompt: str) -> str:
            return '{"answer": "%s", "citations": [1], "missing": []}' % prompt.split()[-1]

    chunks = spark.createDataFrame([(1, "word " * 400 + "end")], "id bigint, text string")
    asks = spark.createDataFrame([(7, "q")], "qid bigint, query string")
    evidence = spark.createDataFrame([(7, 1, 1)], "qid bigint, number int, id bigint")
    assert A.synthesized(asks, evidence, chunks, LastWord()).first()["answer"] == "end"


def test_steps_get_as_many_as_they_ask_for(spark):
    client = OfflineClient()
    chunks = spark.createDataFrame([(i, f"tree w{i}") for i in range(80)], "id bigint, text string")
    steps = spark.createDataFrame([(1, 1, "bm25_search", "tree", 70), (2, 1, "vector_search", "tree", 60), (3, 1, "vector_search", "tree", None)], "qid bigint, step_id int, action string, query string, top_k int")
    vectors = chunks.select("id", embedded(F.col("text"), client).alias("v"))
    assert {r["qid"]: r["count"] for r in A.executed(steps, chunks, vectors, client).groupBy("qid").count().collect()} == {1: 70, 2: 60, 3: 10}
