"""Benchmark decontamination by spaced-seed hashing.

Tokens are runs of letters, digits and underscores, in lower case. A mask such as 1011111 hashes the
tokens at its ones and ignores the others, so that a substituted token at a zero does no harm. Hashes of
all places of the benchmark items are joined with those of the documents; around every hit, item and
document are laid over each other at that shift, and the overlap counts if some run of `overlap` tokens
(of the whole item, if it is shorter) agrees in at least `percent` of its places. The three MASKS find
every run of 13 tokens with up to two substitutions, SHORT_MASKS every shorter item with as many as 80 in
a hundred allow.

An item of fewer than `shortest` tokens matches where it stands whole: anywhere if it has LONG_TEXT letters
(a sentence without blanks is one token), else only as the whole document, for a word or two are in
every text.

The documents' side of the join is reduced by a bit for every hash of the benchmark (16 MB, whatever its
size), and by the hashes themselves where these are no more than FILTER_SEEDS (8 bytes each, counted
first); the join that follows gives the same result either way.

Defined cases: null or empty text: no tokens, no match; very long texts: whole, like others; null doc_id or
item_id: values like any other; ties: of overlaps of one item that are equally good the longest; repeated
rows and items: one result; empty tables: no rows; other columns, whatever their names, are ignored by
find_overlaps and kept by drop_contaminated.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, row_hash, without
from .shingles import hash_words, mix

MASKS = ("111001011", "11011101", "1011111")
#: For items with fewer tokens than `overlap`; for those with fewer than `shortest`, by their number.
SHORT_MASKS = ("1111", "11011", "10111", "11101")
WHOLE_MASKS = ("1", "11", "111", "1111")
OVERLAP, PERCENT, SHORTEST, LONG_TEXT = 13, 80, 5, 20
FILTER_SEEDS, BROADCAST_SEEDS = 4_000_000, 500_000
#: Bits of the filter, as a power of two.
FILTER_BITS = 27
_ALL = (*MASKS, *SHORT_MASKS, *WHOLE_MASKS)
#: Number of the hash of a whole document or item of fewer than `shortest` tokens.
_WHOLE = len(_ALL)

_TOKEN = re.compile(r"\w+")
_SEEDS = pa.schema([("item_id", pa.int64()), ("item_hash", pa.int64()), ("n", pa.int32()), ("tokens", pa.list_(pa.int64())), ("masks", pa.list_(pa.int32())), ("seeds", pa.list_(pa.struct([("seed", pa.int64()), ("at", pa.int32())])))])
ITEMS = "item_id long, item_hash long, n int, tokens array<long>, masks array<int>, seeds array<struct<seed:long,at:int>>"
_HITS = pa.schema([("doc_id", pa.int64()), ("row_hash", pa.int64()), ("tokens", pa.list_(pa.int64())), ("hits", pa.list_(pa.struct([("seed", pa.int64()), ("at", pa.int32())])))])
HITS = "doc_id long, row_hash long, tokens array<long>, hits array<struct<seed:long,at:int>>"


def tokens(text: str | None) -> list[str]:
    return _TOKEN.findall(text.lower()) if text else []


def seeds(hashes: np.ndarray, mask: str, number: int) -> np.ndarray:
    """A hash per place at which the mask fits."""
    n = len(hashes) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, number + 1, np.uint64)
    for at, bit in enumerate(mask):
        if bit == "1":
            out *= np.uint64(0x9E3779B97F4A7C15)
            out += hashes[at : at + n]
    return mix(out)


def _whole(hashes: np.ndarray) -> np.ndarray:
    return seeds(hashes, "1" * len(hashes), _WHOLE)


def _masks(n: int, letters: int, overlap: int, shortest: int) -> list[int]:
    """Numbers of the masks for an item of n tokens."""
    if n <= len(WHOLE_MASKS):
        return [len(MASKS) + len(SHORT_MASKS) + n - 1] if n >= shortest or letters >= LONG_TEXT else []
    if n < shortest:
        return []
    return [*range(len(MASKS))] if n >= overlap else [*range(len(MASKS), len(MASKS) + len(SHORT_MASKS))]


def _items(benchmark: DataFrame, overlap: int, shortest: int) -> DataFrame:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {f.name: [] for f in _SEEDS}
            for item, own, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                words = tokens(text.as_py())
                if not words:
                    continue
                h = hash_words(words)
                masks = _masks(len(h), sum(map(len, words)), overlap, shortest)
                marks = [(s, at) for k in masks for at, s in enumerate(seeds(h, _ALL[k], k).view(np.int64))]
                if len(h) < shortest:
                    marks += [(s, 0) for s in _whole(h).view(np.int64)]
                for name, value in zip(out, (item, own, len(h), h.view(np.int64), masks, [{"seed": int(s), "at": at} for s, at in marks])):
                    out[name].append(value)
            yield pa.RecordBatch.from_pydict(out, schema=_SEEDS)

    rows = benchmark.select(F.col("item_id").cast("long"), row_hash().alias("item_hash"), "text").dropDuplicates()
    return rows.mapInArrow(read, ITEMS)


def _bits(places: DataFrame) -> np.ndarray:
    """A bit for the high bits of every seed, eight to a byte, low ones first; no more rows come to the driver
    than the filter has blocks of 32768 bits."""
    high = F.shiftrightunsigned("seed", 64 - FILTER_BITS) + 1  # blocks are counted from 1
    rows = places.groupBy(F.bitmap_bucket_number(high).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(high)).alias("bits")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for bucket, bits in zip(rows.column("bucket").to_pylist(), rows.column("bits").to_pylist()):
        out[(bucket - 1) * len(bits) : bucket * len(bits)] = np.frombuffer(bits, np.uint8)
    return out


def _hits(docs: DataFrame, wanted: np.ndarray | None, bits: np.ndarray, masks: list[int], shortest: int) -> DataFrame:
    """Documents with a place whose hash is wanted (sorted; None: whose bit is set), by these masks."""
    shared = docs.sparkSession.sparkContext.broadcast((wanted, bits))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, bits = shared.value

        def asked(s: np.ndarray) -> np.ndarray:
            high = s >> np.uint64(64 - FILTER_BITS)
            at = np.flatnonzero(bits[high >> np.uint64(3)] >> (high & np.uint64(7)).astype(np.uint8) & 1)
            return at[wanted[np.minimum(np.searchsorted(wanted, s[at]), len(wanted) - 1)] == s[at]] if wanted is not None and len(at) else at

        for batch in batches:
            for begin in range(0, batch.num_rows, 1000):
                part = batch.slice(begin, 1000)
                out: dict[str, list] = {f.name: [] for f in _HITS}
                own = [tokens(t.as_py()) for t in part.column(2)]
                flat = hash_words([w for x in own for w in x])
                size = np.array([len(x) for x in own])
                doc, start = np.repeat(np.arange(len(own)), size), np.r_[0, np.cumsum(size)]
                found: list[tuple[np.ndarray, np.ndarray]] = []
                for k in masks:
                    s = seeds(flat, _ALL[k], k)
                    at = asked(s)
                    at = at[doc[at] == doc[at + len(_ALL[k]) - 1]] if len(at) else at
                    found.append((at, s[at]))
                few = [i for i, n in enumerate(size) if 0 < n < shortest]
                if few:
                    s = np.concatenate([_whole(flat[start[i] : start[i + 1]]) for i in few])
                    at = asked(s)
                    found.append((start[np.array(few)[at]], s[at]))
                at, s = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64), np.empty(0, np.uint64))
                order = np.argsort(at, kind="stable")
                at, s = at[order], s[order].view(np.int64)
                for i in np.unique(doc[at]) if len(at) else ():
                    a, b = np.searchsorted(at, [start[i], start[i + 1]])
                    hits = [{"seed": int(x), "at": int(y - start[i])} for x, y in zip(s[a:b], at[a:b])]
                    for name, value in zip(out, (part.column(0)[int(i)].as_py(), part.column(1)[int(i)].as_py(), flat[start[i] : start[i + 1]].view(np.int64), hits)):
                        out[name].append(value)
                yield pa.RecordBatch.from_pydict(out, schema=_HITS)

    return docs.select(F.col("doc_id").cast("long"), row_hash().alias("row_hash"), "text").mapInArrow(scan, HITS)


def _overlaps(docs: DataFrame, benchmark: DataFrame, scratch: Scratch, overlap: int, percent: int, shortest: int) -> DataFrame:
    """doc_id, row_hash, item_id, equal and tokens of the best overlap; reads tables in scratch."""
    items = scratch.store(_items(benchmark, overlap, shortest), texts=True)
    places = items.select("item_id", "item_hash", F.explode("seeds").alias("s")).select("item_id", "item_hash", "s.seed", F.col("s.at").alias("item_at"))
    distinct, total = places.agg(F.count_distinct("seed"), F.count("*")).first()
    masks = sorted(r[0] for r in items.select(F.explode("masks")).distinct().collect())  # at most one row per mask
    wanted = None
    if distinct <= FILTER_SEEDS:  # 8 bytes each: at most 32 MB
        wanted = np.sort(places.select("seed").distinct().toArrow().column(0).to_numpy().view(np.uint64))
        wanted = wanted if len(wanted) else np.zeros(1, np.uint64)
    hits = scratch.store(_hits(docs, wanted, _bits(places), masks, shortest), texts=True)
    spots = hits.select("doc_id", "row_hash", F.explode("hits").alias("h")).select("doc_id", "row_hash", "h.seed", F.col("h.at").alias("doc_at"))
    shifts = (
        spots.join(F.broadcast(places) if total <= BROADCAST_SEEDS else places, "seed")
        .select("doc_id", "row_hash", "item_id", "item_hash", (F.col("doc_at") - F.col("item_at")).alias("shift"))
        .distinct()
    )
    texts = hits.select(F.col("doc_id").alias("_d"), F.col("row_hash").alias("_h"), F.col("tokens").alias("_doc")).dropDuplicates(["_d", "_h"])
    known = items.select(F.col("item_id").alias("_i"), F.col("item_hash").alias("_ih"), F.col("tokens").alias("_item"))
    # Only the tokens that lie over each other go on: no more than the item has.
    laid = (
        shifts.join(texts, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("row_hash") == F.col("_h")))
        .join(known, F.col("item_id").eqNullSafe(F.col("_i")) & (F.col("item_hash") == F.col("_ih")))
        .select(
            "doc_id", "row_hash", "item_id", F.size("_item").alias("n"),
            F.expr("slice(_item, greatest(-shift, 0) + 1, size(_item))").alias("item"),
            F.expr("slice(_doc, greatest(shift, 0) + 1, size(_item) - greatest(-shift, 0))").alias("doc"),
        )
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            equal, length = [], []
            for n, x, y in zip(batch.column(3).to_pylist(), batch.column(4), batch.column(5)):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                m, run = min(len(x), len(y)), min(overlap, n)
                best = 0, 0
                if m >= run:
                    sums = np.r_[0, np.cumsum(x[:m] == y[:m])]
                    good = np.flatnonzero(100 * (sums[run:] - sums[:-run]) >= percent * run)
                    if len(good):
                        best = int(sums[good[-1] + run] - sums[good[0]]), int(good[-1] + run - good[0])
                equal.append(best[0])
                length.append(best[1])
            out = pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(3)), pa.array(equal, pa.int32()), pa.array(length, pa.int32())], ["doc_id", "row_hash", "item_id", "equal", "tokens"])
            yield out.filter(pa.array([e > 0 for e in equal], pa.bool_()))

    found = laid.mapInArrow(compare, "doc_id long, row_hash long, item_id long, equal int, tokens int")
    return found.groupBy("doc_id", "row_hash", "item_id").agg(F.max(F.struct("equal", "tokens")).alias("_b")).select("doc_id", "row_hash", "item_id", "_b.equal", "_b.tokens")


def find_overlaps(docs: DataFrame, benchmark: DataFrame, overlap: int = OVERLAP, percent: int = PERCENT, shortest: int = SHORTEST) -> DataFrame:
    """One row per document and item: doc_id, row_hash, item_id, equal and tokens of the best overlap."""
    return _overlaps(docs, benchmark, Scratch(docs.sparkSession), overlap, percent, shortest)


def contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row per contaminated document: doc_id, row_hash, n_items, item_ids, equal (of the best)."""
    return (
        find_overlaps(docs, benchmark, **options)
        .groupBy("doc_id", "row_hash")
        .agg(F.count("*").alias("n_items"), F.sort_array(F.collect_list("item_id")).alias("item_ids"), F.max("equal").cast("long").alias("equal"))
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, overlap: int = OVERLAP, percent: int = PERCENT, shortest: int = SHORTEST) -> DataFrame:
    """docs without the contaminated ones."""
    scratch = Scratch(docs.sparkSession)
    gone = scratch.store(_overlaps(docs, benchmark, scratch, overlap, percent, shortest).select("doc_id", "row_hash").distinct())
    scratch.keep(gone)
    return without(docs, gone)
