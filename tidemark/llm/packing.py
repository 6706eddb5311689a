"""Best-fit packing by the linear grouping scheme.

Only counts by length (at most `capacity` numbers) are solved for on the driver: large lengths are
rounded up within groups of equal cardinality, configurations of these few sizes are optimised
(column generation over integer knapsacks, rounded down, the rest filled greedily), and small lengths
go to the fullest sequence that still takes them. Documents are then substituted by rank within their
length: the k-th document of a length takes the k-th place planned for it.

Defined cases: null or empty text: the end token alone; very long texts: a document over the capacity is
cut into pieces of that length, the first one shorter; ties: documents of one length take its places by
doc_id and a checksum of their ids; repeated rows: each is packed; null doc_id: a value like any other;
empty table: no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import store
from .tokens import encoder

PIECES = "doc_id long, row_key long, piece int, start long, length long, ids binary"


def pieces(docs: DataFrame, tokenizer: str, end: int, capacity: int) -> DataFrame:
    """Every document's pieces; ids: their token ids, four bytes each, low bytes first."""
    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, stop = encoder(tokenizer), np.uint32(end).tobytes()
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py()) + stop
                key, n = zlib.crc32(ids), len(ids) // 4
                lead = n % capacity or capacity
                for k, at in enumerate([0, *range(lead, n, capacity)]):
                    to = lead if k == 0 else at + capacity
                    for column, value in zip(out, (doc, key, k, at, to - at, ids[4 * at : 4 * to])):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))], ["doc_id", "row_key", "piece", "start", "length", "ids"])

    return columns.mapInArrow(cut, PIECES)


def _knapsack(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most worth that fits into capacity, any number of items of each size, and its counts."""
    order = np.argsort(sizes)
    size, value = sizes[order], worth[order]
    fits = np.searchsorted(size, np.arange(capacity + 1), side="right")
    best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if n := fits[c]:
            got = best[c - size[:n]] + value[:n]
            if got[i := int(got.argmax())] > best[c]:
                best[c], took[c] = got[i], i
    counts, c = np.zeros(len(sizes), np.int64), capacity
    while c > 0:
        if took[c] < 0:
            c -= 1
        else:
            counts[order[took[c]]] += 1
            c -= size[took[c]]
    return float(best[capacity]), counts


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 3000) -> list[tuple[tuple[int, ...], int]]:
    """(count per size, how often) covering the demand exactly: the linear relaxation by column
    generation, rounded down, and longest-first configurations for what remains."""
    k = len(sizes)
    if not k:
        return []
    size, need = np.array(sizes), np.array(demand, float)
    columns = np.diag(np.minimum(capacity // size, np.maximum(need, 1))).astype(float)
    for _ in range(rounds):
        x = np.linalg.solve(columns, need)
        value, column = _knapsack(size, np.linalg.solve(columns.T, np.ones(k)), capacity)
        if value <= 1 + 1e-7:
            break
        step = np.linalg.solve(columns, column.astype(float))
        ratio = np.where(step > 1e-9, np.maximum(x, 0) / np.where(step > 1e-9, step, 1), np.inf)
        columns[:, int(np.argmin(ratio))] = column
    x = np.maximum(np.linalg.solve(columns, need), 0)
    left, plan = np.array(demand, np.int64), []
    for j in np.argsort(-x):
        column = columns[:, j].astype(np.int64)
        uses = column > 0
        often = int(min(np.floor(x[j] + 1e-9), (left[uses] // column[uses]).min()))
        if often > 0:
            plan.append((tuple(column.tolist()), often))
            left -= often * column
    while left.any():
        column, room = np.zeros(k, np.int64), capacity
        for i in np.argsort(-size):
            column[i] = min(left[i], room // size[i])
            room -= column[i] * size[i]
        uses = column > 0
        often = int((left[uses] // column[uses]).min())
        plan.append((tuple(column.tolist()), often))
        left -= often * column
    return plan


def groups(counts: dict[int, int], smallest: int, n_groups: int) -> list[tuple[int, int, int]]:
    """(size, rank from, rank to) of runs of equal cardinality among the lengths >= smallest, longest
    first; size: the longest length in the run, to which the others are rounded up."""
    total = sum(n for length, n in counts.items() if length >= smallest)
    ends = sorted({round(total * (g + 1) / n_groups) for g in range(n_groups)} - {0})
    out, begin = [], 0
    cumulative, lengths = [], sorted((x for x in counts if x >= smallest), reverse=True)
    seen = 0
    for length in lengths:
        seen += counts[length]
        cumulative.append(seen)
    for end in ends:
        at = int(np.searchsorted(cumulative, begin, side="right"))
        out.append((lengths[at], begin, end))
        begin = end
    return out


def plan(counts: dict[int, int], capacity: int, smallest: int, n_groups: int) -> list[tuple[int, int, int, int, int]]:
    """Places for all lengths, as runs: (length, rank from, count, first sequence, offset). Documents
    of one length with ranks from..from+count-1 go to consecutive sequences at one offset."""
    runs: list[tuple[int, int, int, int, int]] = []
    given: dict[int, int] = dict.fromkeys(counts, 0)  # ranks handed out by length
    grouped = groups(counts, smallest, n_groups)
    # A group's members by actual length, longest first, as they will be substituted.
    stock: list[list[list[int]]] = []
    lengths = sorted((x for x in counts if x >= smallest), reverse=True)
    left = {x: counts[x] for x in lengths}
    for _, begin, end in grouped:
        own, want = [], end - begin
        for x in lengths:
            if want and left[x]:
                n = min(want, left[x])
                own.append([x, n])
                left[x] -= n
                want -= n
        stock.append(own)
    # Sequences as runs that are alike: (fill, first sequence, count).
    alike: list[tuple[int, int, int]] = []
    next_sequence = 0
    for column, often in configurations([s for s, _, _ in grouped], [e - b for _, b, e in grouped], capacity):
        open_runs = [(0, next_sequence, often)]
        next_sequence += often
        for g, uses in enumerate(column):
            for _ in range(uses):
                filled = []
                for fill, first, n in open_runs:
                    while n:
                        x, there = stock[g][0]
                        m = min(n, there)
                        runs.append((x, given[x], m, first, fill))
                        given[x] += m
                        filled.append((fill + x, first, m))
                        first, n = first + m, n - m
                        stock[g][0][1] -= m
                        if not stock[g][0][1]:
                            stock[g].pop(0)
                open_runs = filled
        alike += open_runs
    # Small lengths, longest first, to the fullest sequences that still take them.
    space: dict[int, list[tuple[int, int]]] = {}
    for fill, first, n in alike:
        space.setdefault(capacity - fill, []).append((first, n))
    for x in sorted((x for x in counts if x < smallest), reverse=True):
        want = counts[x]
        while want:
            room = min((r for r in space if r >= x), default=None)
            if room is None:
                fresh = -(-want // (capacity // x))
                space.setdefault(capacity, []).append((next_sequence, fresh))
                next_sequence += fresh
                room = capacity
            first, n = space[room].pop()
            if not space[room]:
                del space[room]
            m = min(n, want)
            runs.append((x, given[x], m, first, capacity - room))
            given[x] += m
            want -= m
            if m < n:
                space.setdefault(room, []).append((first + m, n - m))
            if room > x:
                space.setdefault(room - x, []).append((first, m))
    return runs


def pack(docs: DataFrame, tokenizer: str, end: int = 2, capacity: int = 1024, n_groups: int = 96, small: float = 0.1, block_rows: int = 20_000) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids, ids_crc32, sequence_id, offset.

    n_groups: sizes that the configurations know; small: lengths under this share of the capacity are
    left for the best-fit pass. Ranks within a length come from counts by (length, block), so that no
    task orders all pieces of one length."""
    cut = store(pieces(docs, tokenizer, end, capacity), texts=True)
    counted = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # <= capacity rows
    spark = cut.sparkSession
    runs = plan(counted, capacity, max(1, int(small * capacity)), n_groups) if counted else []
    most = max(counted.values(), default=0)
    blocks = max(1, -(-most // block_rows))
    ranked = cut.withColumn("_block", F.pmod(F.xxhash64("doc_id", "row_key", "piece"), F.lit(blocks)).cast("int"))
    sums = ranked.groupBy("length", "_block").agg(F.count("*").alias("_n"))
    ahead = Window.partitionBy("length").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("length").alias("_l"), F.col("_block").alias("_b"), F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead"))
    inside = Window.partitionBy("length", "_block").orderBy("doc_id", "row_key", "piece")
    ranked = ranked.withColumn("_in", F.row_number().over(inside) - 1).join(sums, (F.col("length") == F.col("_l")) & (F.col("_block") == F.col("_b")))
    ranked = ranked.withColumn("_rank", F.col("_ahead") + F.col("_in"))
    # The runs of a length, in order of rank, as one array: their number depends on the lengths and
    # groups, not on the documents.
    by_length: dict[int, list] = {}
    for x, rank, n, first, offset in runs:
        by_length.setdefault(x, []).append((rank, n, first, offset))
    table = spark.createDataFrame(
        [(x, r, n, f, o) for x, own in by_length.items() for r, n, f, o in sorted(own)], "_length long, _from long, _count long, _first long, _offset long"
    )
    return ranked.join(F.broadcast(table), (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_from") + F.col("_count"))).select(
        "doc_id", "piece", "start", "length", "ids", F.crc32("ids").alias("ids_crc32"), (F.col("_first") + F.col("_rank") - F.col("_from")).alias("sequence_id"), F.col("_offset").alias("offset")
    )
