import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm.fill_containers import best_fit, fill_containers, knapsack, slots, solve_configurations
from lectern.llm.queries import p7_containers

SCHEMA = "doc_id bigint, n_tokens bigint, size string, g int, bucket string"


def whole(rows, got, capacity):
    room, seen = {}, {}
    for r in got:
        room[r["container_id"]] = room.get(r["container_id"], 0) + r["size"]
        seen.setdefault(r["doc_id"], []).append((r["first"], r["size"]))
    assert max(room.values(), default=0) <= capacity
    for key, n in rows.items():
        at = 0
        for first, size in sorted(seen.pop(key)):
            assert first == at
            at += size
        assert at == n and (n > capacity or len(got) >= 1)
    assert not seen
    return room


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(7, 40), min_size=1, max_size=60))
def test_configurations_hold_every_item(items):
    sizes, demand = np.unique(np.array(items), return_counts=True)
    sizes, demand = sizes[::-1].copy(), demand[::-1].copy()
    plan = solve_configurations(sizes, demand, 40)
    assert all((c * sizes).sum() <= 40 for c, _ in plan)
    assert (sum(c * t for c, t in plan) >= demand).all()
    assert len({(g, a) for g, a, *_ in slots(plan)}) == len(slots(plan))


def test_parts():
    value, counts = knapsack(np.array([6, 5]), np.array([0.6, 0.5]), np.array([9, 9]), 11)
    assert (round(value, 6), counts.tolist()) == (1.1, [1, 1])
    place, new = best_fit({0: 5, 1: 3}, [(0, 3), (1, 5), (2, 9)], 10)
    assert (place, new) == ([1, 0, -1], 1)


def test_rows(spark):
    rng = np.random.default_rng(3)
    sizes = {int(i): int(n) for i, n in enumerate(rng.integers(1, 130, 400))} | {1000: 0, 1001: 250, 1002: 100, 1003: 300}
    rows = [(k, n, "x", 1, "y") for k, n in sizes.items()] + [(5, sizes[5], "x", 1, "y"), (None, 3, "x", 1, "y"), (1004, None, "x", 1, "y")]
    got = fill_containers(spark.createDataFrame(rows, SCHEMA), capacity=100, groups=20, small=0.1, shard_rows=120).collect()
    room = whole(sizes | {1004: 0}, got, 100)
    used = [v for v in room.values() if v]
    assert len(used) <= 1.15 * sum(sizes.values()) / 100 + 4
    assert all(len([r for r in got if r["doc_id"] == k]) == 1 for k, n in sizes.items() if n <= 100)


def test_ties_and_empty(spark):
    got = fill_containers(spark.createDataFrame([(i, 50, "x", 1, "y") for i in range(60)], SCHEMA), capacity=100).collect()
    assert len(whole({i: 50 for i in range(60)}, got, 100)) == 30
    assert fill_containers(spark.createDataFrame([], SCHEMA)).count() == 0
    assert fill_containers(spark.createDataFrame([(1, 0, "x", 1, "y"), (2, 3, "x", 1, "y")], SCHEMA)).count() == 2


def test_query(spark, tiny):
    got = p7_containers(spark, tiny)
    assert got.count() == got.select("doc_id", "piece").distinct().count()
    assert got.select("doc_id").distinct().count() == spark.read.parquet(f"{tiny}/documents.parquet").count()


def test_full_pieces_have_containers_of_their_own(spark):
    df = spark.createDataFrame([(i, 10 * (i % 5)) for i in range(400)] + [(500, 9), (501, 0), (502, None)], "doc_id bigint, n_tokens bigint")
    rows = fill_containers(df, capacity=10, shard_rows=7).collect()
    full = [r["container_id"] for r in rows if r["container_id"] < 0]
    assert len(full) == len(set(full)) == sum(i % 5 for i in range(400)) and min(full) == -len(full)
    assert sum(r["size"] for r in rows) == sum(10 * (i % 5) for i in range(400)) + 9
