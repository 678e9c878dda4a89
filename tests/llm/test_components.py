import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm.components import components
from lectern.llm.near_dup_covering import near_duplicates

SCHEMA = "tbl string, a bigint, b bigint"


def plain(links):
    root = {n: n for link in links for n in link}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    return root


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)).filter(lambda x: x[0] != x[1]), min_size=1, max_size=15))
def test_components(spark, links):
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame([("t", *x) for x in links], SCHEMA)).collect()}
    assert got == plain(links)


def test_path_tables_and_dirt(spark):
    rows = [("t", i, i + 1) for i in range(40)] + [("s", 5, 6), ("t", 3, 3), ("t", None, 4), ("t", 1, 0)]
    got = {(r["tbl"], r["node"]): r["root"] for r in components(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {("t", i): 0 for i in range(41)} | {("s", 5): 5, ("s", 6): 5}
    assert components(spark.createDataFrame([], SCHEMA)).count() == 0


def test_groups(spark):
    long = "The quick brown fox jumps over the lazy dog while seventeen zebras quietly watch the moon rise above the old harbour wall. "
    rows = [("q", 1, long), ("q", 2, long.replace("old ", "")), ("q", 3, long), ("q", 4, "entirely different words about hash tables, search trees, priority queues and nothing else in particular at all")]
    got = {r["id"]: r["group_id"] for r in near_duplicates(spark.createDataFrame(rows, "tbl string, id bigint, text string")).groups().collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4}


def test_unsettled_rounds_raise(spark):
    rows = [("t", i, i + 1) for i in range(40)]
    with pytest.raises(RuntimeError):
        components(spark.createDataFrame(rows, SCHEMA), most_rounds=2)
