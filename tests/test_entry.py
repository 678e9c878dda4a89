"""The driver's functions."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry
from lectern.operators.graph import named_concepts
from lectern.plans import registry

ROOT = Path(__file__).resolve().parent.parent


def test_registered():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(registry.QUERIES) <= set(entry.queries())


def test_flagship(spark, tiny):
    assert entry.entry(spark).columns == ["qid", "id", "score", "rank"]


def test_without_the_training_data_part():
    code = "import sys; sys.modules['lectern.llm'] = None; import __spark_entry__ as e; assert e.llm is None and 'bm25_topk' in e.queries() and not any(q[1:2].isdigit() for q in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_named_concepts(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("比较快速排序与归并排序",)], "t string")
    assert df.select(named_concepts(F.col("t")).alias("c")).first()["c"] == ["归并排序", "快速排序"]
