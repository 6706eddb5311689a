"""Ranked lexical search: an index of all documents, read in the order of impact until nothing is open (NRA).

`index` gives one row per chunk of documents: its terms, and for each the documents that hold it with how
often. `search` first counts each asked term over the whole index. A chunk then answers each item with its
own best documents: the lists of the item's terms, highest impact first, are read in step, ever further. What
was read of a document is a lower bound of its score; with the next impact of each list where it was not met
yet, that gives an upper bound. Reading ends when no document outside the best can reach them, ties by doc_id
included, and the bounds of the best agree. The best of all chunks are ranked by Spark; as every document is
in one chunk only, none is missed.

A list never leaves its chunk, so a term in all documents is no hot key. Items are answered in blocks of
BLOCK_BYTES of text at most, which alone go through the driver; every block reads the whole index.

score = sum over the item's distinct terms of w * (10^9 * tf div (1000 * tf + 20 * m)), where
w = floor(1000 * ln((2N + 2) / (2 df + 1))) and m = 50 + (50 * n * N) div L.

Defined cases: null or empty text, or one without a term: no document of N, never found; as an item: no
rows; very long texts: whole; ties: by doc_id, null last; repeated documents: each is ranked; repeated items:
each gets its ranking; empty tables: no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chunks import planes, unplanes
from .common import Scratch

INDEX = "ids array<long>, sizes array<long>, terms binary, holders array<int>, postings binary"
_FIELDS = pa.schema([("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("terms", pa.binary()), ("holders", pa.list_(pa.int32())), ("postings", pa.binary())])
#: Bytes of text in a chunk of the index and in a block of items; entries of a list that are read first.
CHUNK_BYTES, BLOCK_BYTES, FIRST_READ = 4 << 20, 4 << 20, 64

# A-Z in lower case, other ASCII but digits and letters to blanks; bytes of other characters stay.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """Maximal runs of ASCII letters, digits and characters beyond ASCII."""
    return text.translate(_FOLD).split()


def _compress(x: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(x)


def _expand(x: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompressobj().decompress(x)


def _build(chunk_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int | None, list[bytes]]] = []
        size = 0

        def full() -> pa.RecordBatch:
            held.sort(key=lambda x: (x[0] is None, x[0] or 0))
            number: dict[bytes, int] = defaultdict()
            number.default_factory = number.__len__
            sizes = np.array([len(x) for _, x in held], np.int64)
            flat = np.fromiter((number[t] for _, own in held for t in own), np.int64, int(sizes.sum()))
            keys, times = np.unique(flat * len(held) + np.repeat(np.arange(len(held)), sizes), return_counts=True)
            term, doc = np.divmod(keys, max(1, len(held)))
            posts = planes(np.diff(doc, prepend=0).astype(np.int32)) + planes(times.astype(np.int32))
            row = [[x for x, _ in held], sizes, _compress(b" ".join(number)), np.bincount(term, minlength=len(number)).astype(np.int32), _compress(posts)]
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _FIELDS)], schema=_FIELDS)

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                own = terms_of(text or b"")
                if own:
                    held.append((i, own))
                    size += len(text)
                if size >= chunk_bytes:
                    yield full()
                    held, size = [], 0
        if held:
            yield full()

    return run


def index(docs: DataFrame, scratch: Scratch, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """docs (doc_id, text) -> a stored row per chunk; documents without a term are left out."""
    rows = docs.where("text is not null").select(F.col("doc_id").cast("long"), "text")
    return scratch.store(rows.mapInArrow(_build(chunk_bytes), INDEX), packed=True, texts=True)


def _holders(asked: set[bytes]):
    """How many documents of each chunk hold each asked term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for terms, holders in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = [(t, k) for k, t in enumerate(_expand(terms).split(b" ")) if t in asked]
                counts = holders.values.to_numpy()
                yield pa.RecordBatch.from_pydict({"term": pa.array([t for t, _ in found], pa.binary()), "n": pa.array([int(counts[k]) for _, k in found], pa.int64())})

    return run


def best(lists: list[tuple[np.ndarray, np.ndarray]], n: int, k: int, first: int = FIRST_READ) -> tuple[np.ndarray, np.ndarray]:
    """The k documents (0 to n - 1) of highest total impact and their totals, highest first, then by number.
    A list has documents and impacts, highest impact first."""
    lower, met = np.zeros(n, np.int64), np.zeros((n, len(lists)), bool)
    open_, at, step = np.arange(n), 0, first
    while True:
        for t, (docs, impacts) in enumerate(lists):
            own = docs[at : at + step]
            lower[own] += impacts[at : at + step]
            met[own, t] = True
        at, step = at + step, 2 * step
        ahead = np.array([x[at] if at < len(x) else 0 for _, x in lists], np.float64)
        low = lower[open_]
        # Exact: whole numbers far below 2^53.
        high = low + ((~met[open_]) @ ahead).astype(np.int64)
        order = np.lexsort((open_, -low))[:k]
        order = order[low[order] > 0]
        if not ahead.any():
            return open_[order], low[order]
        if len(order) == k:
            least, last = low[order[-1]], open_[order[-1]]
            reach = (high > least) | ((high == least) & (open_ < last))
            reach[order] = True
            if reach.sum() == k and (high[order] == low[order]).all():
                return open_[order], low[order]
            open_ = open_[reach]


def _answer(items: list[tuple[int, list[bytes]]], weights: dict[bytes, int], n_docs: int, n_terms: int, k: int):
    """Each chunk's best documents for each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in range(batch.num_rows):
                ids, sizes, terms, holders, posts = (batch.column(f)[c] for f in ("ids", "sizes", "terms", "holders", "postings"))
                n = len(ids.values)
                m = 50 + 50 * sizes.values.to_numpy() * n_docs // n_terms
                ends = np.concatenate([[0], np.cumsum(holders.values.to_numpy(), dtype=np.int64)])
                raw = _expand(posts.as_py())
                docs, times = np.cumsum(unplanes(raw[: len(raw) // 2], np.int32), dtype=np.int64), unplanes(raw[len(raw) // 2 :], np.int32).astype(np.int64)
                lists: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}
                for t, term in enumerate(_expand(terms.as_py()).split(b" ")):
                    if w := weights.get(term):
                        own, tf = docs[ends[t] : ends[t + 1]], times[ends[t] : ends[t + 1]]
                        impacts = w * (1_000_000_000 * tf // (1000 * tf + 20 * m[own]))
                        order = np.argsort(-impacts, kind="stable")
                        lists[term] = own[order], impacts[order]
                for item, asked in items:
                    if mine := [lists[t] for t in asked if t in lists]:
                        at, scores = best(mine, n, k)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), item)), ids.values.take(pa.array(at)), pa.array(scores)], names=["item", "doc_id", "score"])

    return run


def search(index: DataFrame, items: DataFrame, k: int = 50, item_id: str = "item_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """items (item_id, text) -> item_id, rank, doc_id, score of the k best documents of each."""
    spark = index.sparkSession
    n_docs, n_terms = index.select(F.size("ids").alias("d"), F.expr("aggregate(sizes, 0L, (a, x) -> a + x)").alias("t")).agg(F.sum("d"), F.sum("t")).first()
    asked = items.select(F.col(item_id).alias("item_id"), F.col(text).alias("text")).where("text is not null")
    total = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = 1 + total // block_bytes
    kind = items.schema[item_id].dataType.simpleString()
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    if not n_docs:
        return out
    for b in range(n_blocks):
        block = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == b).collect()
        own = [(i, sorted(set(terms_of(r["text"].encode())))) for i, r in enumerate(block)]
        terms = {t for _, x in own for t in x}
        if not terms:
            continue
        df = index.select("terms", "holders").mapInArrow(_holders(terms), "term binary, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
        weights = {bytes(r["term"]): math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r["n"] + 1))) for r in df}
        found = index.mapInArrow(_answer(own, weights, n_docs, n_terms, k), "item long, doc_id long, score long")
        order = [F.desc("score"), F.asc_nulls_last("doc_id")]
        # The best of many tasks first meet by groups of tasks, so that no item's task sees all.
        found = found.withColumn("part", F.spark_partition_id() % 64)
        for keys in (["item", "part"], ["item"]):
            found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(block)], f"item long, item_id {kind}")
        out = out.unionByName(found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    return out
