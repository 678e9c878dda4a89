"""Filling containers of a fixed capacity with items, by linear grouping.

Only the histogram of sizes (at most ``capacity`` rows) comes to the driver. There, the large sizes are cut into
groups of equal cardinality and rounded up to the largest of their group; the few-size problem is solved by its
configuration program (column generation over a knapsack, rounded down, the rest best-fit). Items then take the
slots of their group by rank. What room is left, also by the rounding, is filled with the small items by best fit,
in shards of containers and items, and further containers are opened where none has room.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.llm.common import cut_lineage


def group_sizes(sizes: np.ndarray, counts: np.ndarray, groups: int) -> np.ndarray:
    """The group of each size, largest sizes first (0); groups hold about the same number of items, equal sizes stay together."""
    before = np.cumsum(counts[::-1])[::-1] - counts
    return np.unique((before * groups) // max(1, counts.sum()), return_inverse=True)[1]


def knapsack(sizes: np.ndarray, values: np.ndarray, most: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable configuration: how many of each size (at most ``most``) fit into ``capacity``."""
    best = np.zeros(capacity + 1)
    taken = np.zeros((len(sizes), capacity + 1), np.int16)
    for g, (s, v) in enumerate(zip(sizes, values, strict=True)):
        new = best.copy()
        for t in range(1, min(capacity // s, int(most[g])) + 1):
            with_t = best[: capacity + 1 - t * s] + t * v
            better = with_t > new[t * s :] + 1e-12
            new[t * s :][better] = with_t[better]
            taken[g, t * s :][better] = t
        best = new
    counts, room = np.zeros(len(sizes), np.int64), capacity
    for g in range(len(sizes) - 1, -1, -1):
        counts[g] = taken[g, room]
        room -= counts[g] * sizes[g]
    return float(best[capacity]), counts


def solve_configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 400) -> list[tuple[np.ndarray, int]]:
    """Configurations and how often each is used, so that together they have a slot for every item of every size."""
    n = len(sizes)
    basis = np.diag(np.minimum(capacity // sizes, np.maximum(demand, 1))).astype(float)
    for _ in range(rounds):
        prices = np.linalg.solve(basis.T, np.ones(n))
        value, column = knapsack(sizes, np.maximum(prices, 0), demand, capacity)
        if value <= 1 + 1e-7:
            break
        use, step = np.linalg.solve(basis, demand.astype(float)), np.linalg.solve(basis, column.astype(float))
        ratio = np.where(step > 1e-9, np.maximum(use, 0) / np.where(step > 1e-9, step, 1), np.inf)
        basis[:, int(ratio.argmin())] = column
    use = np.linalg.solve(basis, demand.astype(float))
    out, left = [], demand.astype(np.int64).copy()
    for k in np.argsort(-use):
        column = np.round(basis[:, k]).astype(np.int64)
        times = int(min([math.floor(use[k] + 1e-9), *(left[column > 0] // column[column > 0])])) if column.any() else 0
        if times > 0:
            out.append((column, times))
            left -= column * times
    while left.any():  # a few items for each size: the fullest configuration, again and again
        _, column = knapsack(sizes, sizes.astype(float), left, capacity)
        times = int((left[column > 0] // column[column > 0]).min())
        out.append((column, times))
        left -= column * times
    return out


def slots(configurations: list[tuple[np.ndarray, int]]) -> list[tuple[int, int, int, int, int]]:
    """``group, from rank, to rank, items a container, first container`` of each configuration's slots of a group."""
    out, container = [], 0
    rank = np.zeros(len(configurations[0][0]) if configurations else 0, np.int64)
    for column, times in configurations:
        for g in np.flatnonzero(column):
            out.append((int(g), int(rank[g]), int(rank[g] + column[g] * times), int(column[g]), container))
            rank[g] += column[g] * times
        container += times
    return out


def best_fit(rooms: dict[int, int], items: list[tuple[int, int]], capacity: int) -> tuple[list[int], int]:
    """The container of each item (its index, size), larger ones first, in the container with the least sufficient
    room; new containers are numbered -1, -2, ... Also the number of new ones."""
    by_room: dict[int, list[int]] = {}
    for container in sorted(rooms, reverse=True):
        by_room.setdefault(rooms[container], []).append(container)
    order = sorted(by_room)
    place, new = [0] * len(items), 0
    for index, size in sorted(items, key=lambda x: (-x[1], x[0])):
        k = bisect_left(order, size)
        if k == len(order):
            new += 1
            container, room = -new, capacity
        else:
            room = order[k]
            container = by_room[room].pop()
            if not by_room[room]:
                del by_room[room], order[k]
        place[index] = container
        if (rest := room - size) > 0:
            if rest not in by_room:
                by_room[rest] = []
                insort(order, rest)
            by_room[rest].append(container)
    return place, new


def fill_containers(df: DataFrame, key: str = "doc_id", size: str = "n_tokens", capacity: int = 4096, groups: int = 48, small: float = 1 / 16, shard_rows: int = 50_000) -> DataFrame:
    """``container_id, key, piece, first, size``: the container of every item; ``first`` is the piece's offset.

    An item that fits into a container is never divided. A longer one is cut into pieces of ``capacity``, each a full
    container, and a last piece, which is packed like an item. A null size counts as 0; items of size 0 need no room
    and are put into container 0. A row delivered again counts once, a key with several sizes with the largest; null
    keys take no part. Columns other than the two are not read; an empty table gives an empty result.
    """
    spark = df.sparkSession
    kind = df.schema[key].dataType.simpleString()
    every = cut_lineage(df.select(F.col(key).alias("item"), F.coalesce(F.col(size), F.lit(0)).cast("bigint").alias("n")).where(F.col("item").isNotNull()).groupBy("item").agg(F.max("n").alias("n")))
    rest = every.select("item", F.floor(F.col("n") / capacity).cast("int").alias("piece"), (F.col("n") % capacity).alias("size"))
    histogram = rest.where(F.col("size") > 0).groupBy("size").count().toPandas().sort_values("size")
    sizes, counts = histogram["size"].to_numpy(np.int64), histogram["count"].to_numpy(np.int64)
    large = sizes > capacity * small
    group = group_sizes(sizes[large], counts[large], groups)
    tops = np.array([sizes[large][group == g].max() for g in range(int(group.max(initial=-1)) + 1)], np.int64)
    demand = np.array([counts[large][group == g].sum() for g in range(len(tops))], np.int64)
    configurations = solve_configurations(tops, demand, capacity) if len(tops) else []
    planned = sum(times for _, times in configurations)
    of_size = spark.createDataFrame(pd.DataFrame({"size": sizes[large], "g": group}), "size bigint, g int")
    places = spark.createDataFrame(slots(configurations) or [], "g int, a bigint, b bigint, each bigint, container bigint")
    # ranks in a group: within buckets of items, after the number of items in the buckets before
    total = int(counts.sum())
    buckets = max(1, math.ceil(total / shard_rows))
    grouped = rest.join(F.broadcast(of_size), "size").withColumn("bucket", F.pmod(F.xxhash64("item"), F.lit(buckets)).cast("int"))
    per_bucket = grouped.groupBy("g", "bucket").agg(F.count("*").alias("n"))
    before = per_bucket.withColumn("before", F.sum("n").over(Window.partitionBy("g").orderBy("bucket")) - F.col("n")).drop("n")
    within = F.row_number().over(Window.partitionBy("g", "bucket").orderBy(F.desc("size"), "item"))
    ranked = grouped.withColumn("within", within - 1).join(before, ["g", "bucket"]).withColumn("rank", F.col("before") + F.col("within"))
    # the plan has at most two configurations for each group and a few more, each with few groups: some hundred rows
    fits = (ranked["g"] == places["g"]) & (ranked["rank"] >= places["a"]) & (ranked["rank"] < places["b"])
    number = (F.col("container") + F.floor((F.col("rank") - F.col("a")) / F.col("each"))).cast("bigint")
    packed = cut_lineage(ranked.join(F.broadcast(places), fits).select(number.alias("container_id"), "item", "piece", "size"))
    used = packed.groupBy("container_id").agg(F.sum("size").alias("used"))
    shards = max(1, math.ceil((planned + total - int(counts[large].sum())) / shard_rows))
    rooms = used.select("container_id", F.lit(None).cast(kind).alias("item"), F.lit(0).alias("piece"), (F.lit(capacity) - F.col("used")).alias("size"), F.pmod(F.xxhash64("container_id"), F.lit(shards)).cast("int").alias("shard"))
    little = rest.where((F.col("size") > 0) & (F.col("size") <= capacity * small))
    tiny = little.select(F.lit(None).cast("bigint").alias("container_id"), "item", "piece", "size", F.pmod(F.xxhash64("item"), F.lit(shards)).cast("int").alias("shard"))

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        shard = int(pdf["shard"].iloc[0])
        old = pdf["container_id"].notna()
        rooms = dict(zip(pdf.loc[old, "container_id"].astype("int64").tolist(), pdf.loc[old, "size"].tolist(), strict=True))
        items = pdf[~old].sort_values("item")
        place, _ = best_fit({c: r for c, r in rooms.items() if r > 0}, list(enumerate(items["size"].tolist())), capacity)
        # new containers of shard s are numbered planned + s, planned + shards + s, ...
        ids = [c if c >= 0 else planned + shard + (-c - 1) * shards for c in place]
        return pd.DataFrame({"container_id": np.array(ids, np.int64), "item": items["item"].to_numpy(), "piece": items["piece"].to_numpy(np.int32), "size": items["size"].to_numpy(np.int64)})

    schema = f"container_id bigint, item {kind}, piece int, size bigint"
    filled = rooms.unionByName(tiny).repartition(shards, "shard").groupBy("shard").applyInPandas(fill, schema)
    # a full piece has a container of its own, numbered below zero by its rank: those of the buckets and items before it
    long = every.where(F.col("n") >= capacity).select("item", F.floor(F.col("n") / capacity).cast("bigint").alias("whole"))
    long = long.withColumn("bucket", F.pmod(F.xxhash64("item"), F.lit(max(1, math.ceil(long.count() / shard_rows)))).cast("int"))
    earlier = long.groupBy("bucket").agg(F.sum("whole").alias("n")).select("bucket", (F.sum("n").over(Window.orderBy("bucket")) - F.col("n")).alias("earlier"))
    inside = F.sum("whole").over(Window.partitionBy("bucket").orderBy("item").rowsBetween(Window.unboundedPreceding, 0)) - F.col("whole")
    counted = long.withColumn("inside", inside).join(earlier, "bucket").withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("whole").cast("int") - 1)))
    alone = counted.select((-1 - F.col("earlier") - F.col("inside") - F.col("piece")).cast("bigint").alias("container_id"), "item", "piece", F.lit(capacity).cast("bigint").alias("size"))
    empty = every.where("n = 0").select(F.lit(0).cast("bigint").alias("container_id"), "item", F.lit(0).alias("piece"), F.lit(0).cast("bigint").alias("size"))
    out = packed.unionByName(filled).unionByName(alone).unionByName(empty)
    return out.select("container_id", F.col("item").alias(key), "piece", (F.col("piece") * F.lit(capacity)).cast("bigint").alias("first"), "size")
