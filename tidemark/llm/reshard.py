"""Resharding by minimum-cost flow: old shards supply their bytes, new shards take their capacity, and
the flow that moves the fewest bytes says how many go from which to which. Blocks of documents follow
that flow; only files of shards that give or take are rewritten.

The flow network has a node per shard, never per document. Documents of a shard are laid out along
blocks (hashes of doc_id); a document goes where the middle of its bytes falls in its shard's transfers.

Defined cases: null text: no bytes, size 16; very long texts: placed like others, by the middle of their
bytes; ties: rows of one doc_id are ordered by size and text; repeated rows: places of equal rows are
interchangeable; null doc_id: a value like any other; empty table: no rows; other columns are ignored by
reshard and kept by rewrite, but for shard and slot, which rewrite sets anew.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import store

#: Bytes that a row costs besides its text.
ROW_BYTES = 16


def min_cost_flow(supply: list[int], capacity: list[int], cost: Callable[[int, int], int] = lambda i, j: int(i != j)) -> list[tuple[int, int, int]]:
    """(from, to, amount) that move all supply into the capacity at least cost: successive shortest
    augmenting paths with potentials. Its size is that of the shard lists."""
    n, m = len(supply), len(capacity)
    source, sink, nodes = n + m, n + m + 1, n + m + 2
    graph: list[list[list[int]]] = [[] for _ in range(nodes)]  # to, room, cost, index of the reverse edge

    def edge(a: int, b: int, room: int, price: int) -> None:
        graph[a].append([b, room, price, len(graph[b])])
        graph[b].append([a, 0, -price, len(graph[a]) - 1])

    for i, s in enumerate(supply):
        edge(source, i, s, 0)
        for j in range(m):
            edge(i, n + j, s, cost(i, j))
    for j, c in enumerate(capacity):
        edge(n + j, sink, c, 0)
    height, left = [0] * nodes, sum(supply)
    while left:
        far, back, queue = [float("inf")] * nodes, [None] * nodes, [(0, source)]
        far[source] = 0
        while queue:
            d, a = heapq.heappop(queue)
            if d > far[a]:
                continue
            for k, (b, room, price, _) in enumerate(graph[a]):
                if room and (nd := d + price + height[a] - height[b]) < far[b]:
                    far[b], back[b] = nd, (a, k)
                    heapq.heappush(queue, (nd, b))
        if back[sink] is None:
            raise ValueError("the capacity is less than the supply")
        height = [h + (f if f < float("inf") else 0) for h, f in zip(height, far)]
        push, at = left, sink
        while at != source:
            a, k = back[at]
            push, at = min(push, graph[a][k][1]), a
        at = sink
        while at != source:
            a, k = back[at]
            graph[a][k][1] -= push
            graph[at][graph[a][k][3]][1] += push
            at = a
        left -= push
    return [(i, b - n, graph[b][r][1]) for i in range(n) for b, _, _, r in graph[i] if n <= b < n + m and graph[b][r][1]]


def even_capacity(total: int, shards: int) -> list[int]:
    return [total * (j + 1) // shards - total * j // shards for j in range(shards)]


def reshard(docs: DataFrame, old_shard: Column, shards: int, block_rows: int = 5000, capacity: list[int] | None = None) -> DataFrame:
    """-> doc_id, size, text_crc32, old_shard, block, shard, slot."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        old_shard.cast("int").alias("old_shard"),
    )
    rows = store(rows)  # without texts: what follows reads it three times
    olds = {r["old_shard"]: r for r in rows.groupBy("old_shard").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()}  # a row per shard
    if not olds:
        return rows.select("*", F.lit(0).alias("block"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    ids = sorted(olds, key=lambda x: (x is None, x))
    room = capacity or even_capacity(sum(r["bytes"] for r in olds.values()), shards)
    flow = min_cost_flow([olds[i]["bytes"] for i in ids], room, lambda i, j: int(ids[i] != j))
    parts, ends = [], dict.fromkeys(ids, 0)
    for i, j, n in sorted(flow, key=lambda x: (x[0], ids[x[0]] != x[1], x[1])):
        parts.append((ids[i], ends[ids[i]], ends[ids[i]] + n, j))
        ends[ids[i]] += n
    moves = rows.sparkSession.createDataFrame(parts, "_old int, _lo long, _hi long, shard int")
    blocks = max(1, -(-max(r["n"] for r in olds.values()) // block_rows))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int"))
    # The bytes before each block of a shard: a window over block sums, not over documents.
    sums = rows.groupBy("old_shard", "block").agg(F.sum("size").alias("_bytes"))
    before = Window.partitionBy("old_shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("old_shard").alias("_o"), F.col("block").alias("_b"), F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("old_shard", "block").orderBy("doc_id", "size", "text_crc32")
    placed = (
        rows.withColumn("_end", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .join(sums, F.col("old_shard").eqNullSafe(F.col("_o")) & (F.col("block") == F.col("_b")))
        .withColumn("_mid", F.col("_start") + F.col("_end") - F.floor(F.col("size") / 2) - 1)
        .join(F.broadcast(moves), F.col("old_shard").eqNullSafe(F.col("_old")) & (F.col("_mid") >= F.col("_lo")) & (F.col("_mid") < F.col("_hi")))
        .withColumn("_rank", F.row_number().over(Window.partitionBy("old_shard", "block", "shard").orderBy("doc_id", "size", "text_crc32")))
        .select("doc_id", "size", "text_crc32", "old_shard", "block", "shard", "_rank")
    )
    placed = store(placed)
    counts = placed.groupBy("shard", "old_shard", "block").agg(F.count("*").alias("_n"))
    ahead = Window.partitionBy("shard").orderBy("old_shard", "block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        F.col("shard").alias("_s"), F.col("old_shard").alias("_o"), F.col("block").alias("_b"), F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead")
    )
    return placed.join(offsets, (F.col("shard") == F.col("_s")) & F.col("old_shard").eqNullSafe(F.col("_o")) & (F.col("block") == F.col("_b"))).select(
        "doc_id", "size", "text_crc32", "old_shard", "block", "shard", (F.col("_ahead") + F.col("_rank") - 1).cast("long").alias("slot")
    )


def rewrite(docs: DataFrame, plan: DataFrame, path: str, old_shard: Column | None = None, file_rows: int = 1_000_000) -> list[int]:
    """Writes the files of the shards that give or take documents below path, partitioned by shard, and
    returns their numbers; the other shards' files stay as they are. A shard that only gives is left
    with an empty file. path may be the folder that docs is read from. plan: from reshard; old_shard: as
    given there, or docs' own column shard if there is one; it tells apart rows that are equal in doc_id
    and text. A task writes about file_rows rows of a shard."""
    moved = plan.where(~F.col("old_shard").eqNullSafe(F.col("shard")))
    ends = {x for r in moved.select("old_shard", "shard").distinct().collect() for x in r}  # shard numbers
    touched = sorted(ends - {None})
    if old_shard is None and "shard" in docs.columns:
        old_shard = F.col("shard").cast("int")
    text = F.coalesce(F.col("text"), F.lit(""))
    keys = {"_id": F.col("doc_id"), "_size": (F.octet_length(text) + ROW_BYTES).cast("long"), "_crc": F.crc32(text.cast("binary")), "_old": F.lit(None).cast("int") if old_shard is None else old_shard.cast("int")}
    columns = [c for c in docs.columns if c not in ("shard", "slot")]
    copy = lambda *by: F.row_number().over(Window.partitionBy("_id", "_size", "_crc", "_old").orderBy(*by))
    rows = docs.withColumns(keys).select(*columns, *keys).withColumn("_copy", copy(F.xxhash64(*columns)))
    old = F.lit(None).cast("int") if old_shard is None else F.col("old_shard")
    places = plan.select(F.col("doc_id").alias("_id"), F.col("size").alias("_size"), F.col("text_crc32").alias("_crc"), old.alias("_old"), "shard", "slot").withColumn("_copy", copy("shard", "slot"))
    places = places.where(F.col("shard").isin(touched)).select(*[F.col(c).alias(f"{c}_p") for c in (*keys, "_copy")], "shard", "slot")
    same = [F.col(c).eqNullSafe(F.col(f"{c}_p")) for c in (*keys, "_copy")]
    written = rows.join(places, same).select(*columns, "slot", "shard")
    written.repartition("shard", F.floor(F.col("slot") / file_rows)).write.partitionBy("shard").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    # Dynamic overwriting leaves a shard alone that gets no row.
    taking = {r["shard"] for r in plan.where(F.col("shard").isin(touched)).select("shard").distinct().collect()}
    for shard in ends - taking:
        folder = "__HIVE_DEFAULT_PARTITION__" if shard is None else shard
        docs.sparkSession.createDataFrame([], written.drop("shard").schema).write.mode("overwrite").parquet(f"{path.rstrip('/')}/shard={folder}")
    return touched
