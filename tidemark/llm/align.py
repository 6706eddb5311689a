"""Alignment of two tokenizers by pointer jumping, with corpus-wide counts of linked id pairs.

Tokens of a byte-level vocabulary A and of a sentence-piece vocabulary B cover the same bytes. Every token
points to the farthest-right token that it overlaps; doubling the pointers until none changes takes each
token to the last token of its component, which labels the group. A pair of ids is linked where an
occurrence of one overlaps an occurrence of the other; its count is how many documents of the corpus hold it.

Neither vocabulary has tokens that go on over a blank after another character, so a text falls into units
(a blank before and all up to the next such blank) whose tokens, groups and links don't depend on what
stands around them. Each worker remembers the units it met last; documents are put together from them.

A chunk of documents is a row with the distinct pairs of the chunk, and for every document which of these it
holds how often. Pairs are counted by Spark over chunks; each chunk then gets the counts of its own pairs.
A pair held by all documents meets once per chunk, and no table of pairs is broadcast.

Defined cases: null or empty text, or one whose tokens' bytes differ from it (U+2581, which B reads as a
blank): no tokens, zeros and an empty digest; very long texts: whole, also without any blank; strings of
special tokens: plain text; repeated rows: each a document of its own, counted for itself; ties for the
highest count of an A id: all of them are best; null doc_id: kept; empty table: no rows; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import planes, unplanes
from .common import Scratch
from .tokens import Encoder

#: Entries (document, pair) of a chunk, and units that a worker remembers (twice as many at most).
CHUNK_ENTRIES, REMEMBERED = 1_000_000, 120_000
#: Texts that go to a worker's vocabularies at once.
TEXTS_AT_ONCE = 500
_UNIT = re.compile(r"(?<=\S)(?= )")
_BLANK = "▁"

CHUNK = """chunk string, pairs array<long>, holders array<int>, ids array<long>, n_a array<long>, n_b array<long>,
n_groups array<long>, n_links array<long>, groups_sha256 array<string>, entries array<int>, held binary"""
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def jump(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Labels of A's and of B's tokens: the index of the last A token of their component. Both cover the same
    bytes without gaps; ends are exclusive."""
    n = len(a_ends)
    over = lambda ends, by: np.searchsorted(by, ends, "left")  # noqa: E731  the token that holds the last byte
    b_of_a, a_of_b = over(a_ends, b_ends), over(b_ends, a_ends)
    to = np.concatenate([np.where(b_ends[b_of_a] > a_ends, n + b_of_a, np.arange(n)), a_of_b])
    while not np.array_equal(further := to[to], to):
        to = further
    return to[:n], to[n:]


def links(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of all overlapping pairs of tokens, by A's token."""
    first = np.searchsorted(b_ends, np.concatenate([[0], a_ends[:-1]]), "right")
    times = np.searchsorted(b_ends, a_ends, "left") - first + 1
    a = np.repeat(np.arange(len(a_ends)), times)
    return a, np.arange(len(a)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(first, times)


class Units:
    """Units of text, by number: tokens of both kinds, groups as text, and link pairs a * 65536 + b."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece

        self.a, self.b = Encoder(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        n = self.b.get_piece_size()
        byte = lambda i: bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace(_BLANK, " ").encode()
        self.b_bytes = [byte(i) for i in range(n)]
        self.b_sizes = np.array([len(x) for x in self.b_bytes], np.int64)
        self.a_sizes = np.zeros(self.a.bpe.n_vocab, np.int64)
        for token in self.a.bpe.token_byte_values():
            self.a_sizes[self.a.bpe.encode_single_token(token)] = len(token)
        self.blank = [self.b.piece_to_id(_BLANK)]
        self.old: dict[str, tuple] = {}
        self.new: dict[str, tuple] = {}

    def get(self, asked: list[str]) -> list[tuple | None]:
        """(n_a, n_b, n_groups, groups, pairs) of each unit; None where bytes differ."""
        missing = [u for u in asked if u not in self.new and u not in self.old]
        made = dict(zip(missing, self.align(missing))) if missing else {}
        none = object()
        out = []
        for u in asked:
            found = self.new.get(u, none)
            if found is none:
                found = self.new[u] = made[u] if u in made else self.old[u]
            out.append(found)
        if len(self.new) > REMEMBERED:
            self.old, self.new = self.new, {}
        return out

    def align(self, units: list[str]) -> list[tuple | None]:
        b_ids = self.b.encode([u[1:] for u in units], num_threads=1)
        b_ids = [self.blank if u == " " else own for u, own in zip(units, b_ids)]
        raw = [u.encode() for u in units]
        good = [k for k, (own, x) in enumerate(zip(b_ids, raw)) if b"".join([self.b_bytes[i] for i in own]) == x]
        if not good:
            return [None] * len(units)
        a_ids = [self.a.plain(units[k]) for k in good]
        a_n, b_n = np.array([len(x) for x in a_ids]), np.array([len(b_ids[k]) for k in good])
        a, b = np.concatenate(a_ids).astype(np.int64), np.concatenate([b_ids[k] for k in good]).astype(np.int64)
        a_ends, b_ends = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        if not np.array_equal(a_ends[np.cumsum(a_n) - 1], b_ends[np.cumsum(b_n) - 1]):
            raise ValueError("tokens of a byte-level vocabulary don't give back their text")
        a_to, b_to = jump(a_ends, b_ends)
        i, j = links(a_ends, b_ends)
        pairs = a[i] << 16 | b[j]
        pair_at = np.searchsorted(i, np.concatenate([[0], np.cumsum(a_n)]))
        a_cut, b_cut = np.flatnonzero(a_to == np.arange(len(a))) + 1, np.flatnonzero(np.append(b_to[1:] != b_to[:-1], True)) + 1
        a_text, b_text = list(map(str, a.tolist())), list(map(str, b.tolist()))
        groups = [",".join(a_text[p:q]) + "|" + ",".join(b_text[r:s]) for p, q, r, s in zip([0, *a_cut[:-1].tolist()], a_cut.tolist(), [0, *b_cut[:-1].tolist()], b_cut.tolist())]
        group_at = np.searchsorted(a_cut, np.concatenate([[0], np.cumsum(a_n)]), "right")
        out: list[tuple | None] = [None] * len(units)
        for n, k in enumerate(good):
            g, h = group_at[n], group_at[n + 1]
            out[k] = int(a_n[n]), int(b_n[n]), int(h - g), ";".join(groups[g:h]), pairs[pair_at[n] : pair_at[n + 1]].copy()
        return out


@lru_cache(maxsize=1)
def units_of(a_path: str, b_path: str) -> Units:
    """One per worker process."""
    return Units(a_path, b_path)


def _documents(texts: list[str | None], units: Units) -> tuple[list[tuple], np.ndarray, np.ndarray, np.ndarray]:
    """For each text n_a, n_b, n_groups, n_links and the digest; and the entries (text, pair, times)."""
    number: dict[str, int] = {}
    own = [[number.setdefault(u, len(number)) for u in _UNIT.split(" " + t)] if t else [] for t in texts]
    table = units.get(list(number))
    bad = {k for k, x in enumerate(table) if x is None}
    own = [[] if bad and not bad.isdisjoint(x) else x for x in own]
    sizes = np.array([(0, 0, 0, 0) if x is None else (x[0], x[1], x[2], len(x[4])) for x in table], np.int64).reshape(-1, 4)
    rows = [(*(sizes[x].sum(axis=0).tolist() if x else (0, 0, 0, 0)), hashlib.sha256(";".join([table[u][3] for u in x]).encode()).hexdigest() if x else "") for x in own]
    flat = np.array([u for x in own for u in x], np.int64)
    if not len(flat):
        return rows, flat, flat, flat
    keys, times = np.unique(np.repeat(np.arange(len(own)), [len(x) for x in own]) * len(table) + flat, return_counts=True)
    text, unit = np.divmod(keys, len(table))
    each, at = sizes[:, 3], np.cumsum(sizes[:, 3]) - sizes[:, 3]
    pairs = np.concatenate([np.empty(0, np.int64) if x is None else x[4] for x in table])
    n = each[unit]
    take = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(at[unit], n)
    entry = np.repeat(text, n) << 32 | pairs[take]
    order = np.argsort(entry, kind="stable")
    starts = np.flatnonzero(np.append(True, entry[order][1:] != entry[order][:-1]))
    held = entry[order][starts]
    return rows, held >> 32, held & 0xFFFFFFFF, np.add.reduceat(np.repeat(times, n)[order], starts)


def _chunks(a_path: str, b_path: str, entries: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, made = units_of(a_path, b_path), 0
        ids: list[int | None] = []
        rows: list[tuple] = []
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def full() -> pa.RecordBatch:
            sizes, pairs, times = (np.concatenate([p[k] for p in parts]) for k in range(3))
            distinct, at, holders = np.unique(pairs, return_inverse=True, return_counts=True)
            steps = np.diff(at, prepend=0).astype(np.int32)
            blob = zstandard.ZstdCompressor(level=3).compress(planes(steps) + planes(times.astype(np.int32)))
            columns = [f"{TaskContext.get().partitionId()}-{made}", distinct, holders.astype(np.int32), ids, *map(list, zip(*rows)), sizes.astype(np.int32), blob]
            fields = ["chunk", "pairs", "holders", "ids", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "entries", "held"]
            kinds = [pa.string(), *(pa.list_(x) for x in (pa.int64(), pa.int32(), *[pa.int64()] * 5, pa.string(), pa.int32())), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(columns, kinds)], names=fields)

        for batch in batches:
            for lo in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(lo, TEXTS_AT_ONCE)
                own, text, pairs, times = _documents(part.column(1).to_pylist(), units)
                ids += part.column(0).to_pylist()
                rows += own
                parts.append((np.bincount(text, minlength=part.num_rows), pairs, times))
                if sum(len(p[1]) for p in parts) >= entries:
                    yield full()
                    ids, rows, parts, made = [], [], [], made + 1
        if ids:
            yield full()

    return run


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            row = {c: batch.column(c)[k] for c in batch.schema.names}
            sizes = row["entries"].values.to_numpy()
            raw = zstandard.ZstdDecompressor().decompress(row["held"].as_py(), max_output_size=max(1, 8 * int(sizes.sum())))
            steps, times = unplanes(raw[: len(raw) // 2], np.int32), unplanes(raw[len(raw) // 2 :], np.int32)
            at = np.cumsum(steps, dtype=np.int64)
            found = row["found"].values
            count, best = np.zeros(len(row["pairs"].values), np.int64), np.zeros(len(row["pairs"].values), np.int64)
            if found is not None and len(found):
                place = found.field("place").to_numpy()
                count[place], best[place] = found.field("count").to_numpy(), found.field("best").to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(sizes)])
            added = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[ends])
            columns = [row["ids"].values, *(row[c].values for c in ("n_a", "n_b", "n_groups", "n_links")), pa.array(added(times * best[at])), pa.array(added(times * count[at])), row["groups_sha256"].values]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])


def pair_counts(chunks: DataFrame) -> DataFrame:
    """pair, a, b, count (documents that hold it linked), best (no pair of its A id has a higher count)."""
    pairs = chunks.select(F.explode(F.arrays_zip("pairs", "holders")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.holders").alias("count"))
    pairs = pairs.withColumn("a", F.shiftright("pair", 16))
    top = pairs.groupBy("a").agg(F.max("count").alias("top"))
    return pairs.join(top, "a").select("pair", "a", F.col("pair").bitwiseAND(0xFFFF).alias("b"), "count", (F.col("count") == F.col("top")).alias("best"))


def align(docs: DataFrame, a_path: str, b_path: str, chunk_entries: int = CHUNK_ENTRIES) -> DataFrame:
    """docs (doc_id, text) -> a row per document: tokens of both kinds, groups, links, how many links have the
    highest count of their A id, the sum of the links' counts, and the digest of the groups."""
    scratch = Scratch(docs.sparkSession)
    chunks = scratch.store(docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(_chunks(a_path, b_path, chunk_entries), CHUNK), packed=True, texts=True)
    known = scratch.store(pair_counts(chunks).select("pair", "count", "best"))
    asked = chunks.select("chunk", F.posexplode("pairs").alias("place", "pair"))
    found = asked.join(known, "pair").groupBy("chunk").agg(F.collect_list(F.struct("place", "count", "best")).alias("found"))
    found = scratch.store(found)
    out = scratch.store(chunks.drop("holders").join(found, "chunk", "left").withColumn("found", F.coalesce("found", F.array().cast(found.schema["found"].dataType))).mapInArrow(_finish, RESULT))
    scratch.keep(out)
    return out
