"""Language-model scores: a Katz backoff bigram model, trained and evaluated in three passes over chunks.

Counts are Good-Turing discounted for r <= K. A bigram that training has seen keeps its discounted share
of its context; the rest of a context's mass goes to the words not seen after it, in proportion to their
unigram probability, so that every context sums to one exactly. Unigrams back off to one class of unseen
words. Each token recurses from bigram to unigram to that class.

The model is three tables in the shared folder, each laid out by parts of the key space (see chunks.py):
unigrams (word, id, count), bigrams (context, id, count) and contexts (context, total, factor of the seen
bigrams, backoff weight); words and contexts are 64-bit hashes, ids number the words. evaluate scores any documents by them, with joins.
score_texts counts and scores one corpus: what a part counts it also tells the chunks that asked, so the
corpus needn't meet its own tables again. Contexts that occur more than `hot` times, whatever the corpus,
are spread over all parts by their bigrams; their sums are added up in a table and joined to the chunks.

Defined cases: null or empty text: the end token alone; very long texts: whole, like others (a chunk may
be one text); null doc_id: its text is empty (so training); ties: none, sums only; repeated rows: each
counts and gets its score; no training text: all words are unseen and each has the whole unseen mass;
empty table: no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import chunks as C
from .common import Scratch, row_hash
from .shingles import hash_words, mix, split

#: Counts up to K are discounted; contexts that occur more often than HOT are spread: the bigrams of one
#: that isn't take some MB of a part at most.
K, HOT = 5, 250_000
END, START = hash_words([b" end", b" start"])

_ASK1 = pa.schema([("part", pa.int32()), ("chunk", pa.string()), ("keys", pa.binary()), ("counts", pa.binary())])
_REPLY1 = pa.schema([("chunk", pa.string()), ("part", pa.int32()), ("counts", pa.binary()), ("ids", pa.binary()), ("sums", pa.list_(pa.int64())), ("word", pa.int64()), ("id", pa.int64()), ("count", pa.int64())])
_ASK2 = pa.schema([("part", pa.int32()), ("chunk", pa.string()), ("contexts", pa.binary()), ("spread", pa.binary()), ("sizes", pa.binary()), ("keys", pa.binary()), ("counts", pa.binary()), ("singles", pa.binary())])
_REPLY2 = pa.schema([("chunk", pa.string()), ("part", pa.int32()), ("counts", pa.binary()), ("small", pa.binary()), ("seen", pa.binary()), ("asked", pa.list_(pa.int64())), ("sums", pa.list_(pa.int64())), ("context", pa.int64()), ("id", pa.int64()), ("count", pa.int64()), ("r", pa.list_(pa.int64())), ("mass", pa.float64()), ("spread", pa.bool_())])
_RESULT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
_WEIGHTS = pa.schema([("context", pa.int64()), ("total", pa.int64()), ("factor", pa.float64()), ("weight", pa.float64())])
_TOKENS = pa.schema([("doc_id", pa.int64()), ("row_hash", pa.int64()), ("context", pa.int64()), ("word", pa.int64()), ("times", pa.int64())])
ASK1 = "part int, chunk string, keys binary, counts binary"
REPLY1 = "chunk string, part int, counts binary, ids binary, sums array<long>, word long, id long, count long"
ASK2 = "part int, chunk string, contexts binary, spread binary, sizes binary, keys binary, counts binary, singles binary"
REPLY2 = "chunk string, part int, counts binary, small binary, seen binary, asked array<long>, sums array<long>, context long, id long, count long, r array<long>, mass double, spread boolean"
RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
WEIGHTS = "context long, total long, factor double, weight double"
TOKENS = "doc_id long, row_hash long, context long, word long, times long"


def discounts(n: list[int]) -> np.ndarray:
    """Good-Turing factors d[r] for r = 0..K (d[0] unused) from n[r], the number of types with count r,
    r = 1..K+1. Where the counts give no factor between 0 and 1, r loses an absolute part instead."""
    n = [0, *n]
    plain = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
    plain = min(max(plain, 0.05), 0.95)
    out = np.ones(K + 1)
    tail = (K + 1) * n[K + 1] / n[1] if n[1] else 1.0
    for r in range(1, K + 1):
        d = ((r + 1) * n[r + 1] / (r * n[r]) - tail) / (1 - tail) if n[r] and tail != 1 else -1.0
        out[r] = d if 0 < d < 1 else 1 - plain / r
    return out


def kept(counts: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Discounted counts."""
    return counts * np.where(counts <= K, d[np.minimum(counts, K)], 1.0)


class Unigram:
    """P(w) from a count; the unseen class is count 0."""

    def __init__(self, sums: list[int]):
        self.n, self.v, self.d = sums[0], sums[1], discounts(sums[2:])
        small = sums[2 : 2 + K]
        lost = sum(r * c * (1 - self.d[r]) for r, c in enumerate(small, 1))
        self.factor, self.unseen = 1.0, lost / self.n if self.n else 1.0
        if self.n and not lost:  # all counts are large: one part in n + 1 is unseen
            self.factor, self.unseen = self.n / (self.n + 1), 1 / (self.n + 1)

    def __call__(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 0, self.factor * kept(counts, self.d) / max(self.n, 1), self.unseen)


def context(total: np.ndarray, small: np.ndarray, seen: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(factor of the seen bigrams, backoff weight) of contexts with `total` tokens, small[:, r-1]
    bigram types of count r, and `seen` unigram mass after them."""
    lost = (small * np.arange(1, K + 1) * (1 - d[1:])).sum(axis=1) / np.maximum(total, 1)
    none = lost < 1e-12
    return np.where(none, total / (total + 1), 1.0), np.where(none, 1 / (total + 1), lost) / (1 - seen)


class Layout:
    """A chunk's tokens: distinct keys (sorted), and for every token its place, context and document."""

    def __init__(self, ids: list[int | None], texts: list[bytes]):
        words = [split(t, lower=True) for t in texts]
        size = np.array([len(w) + 1 for w in words], np.int64)
        ends = np.cumsum(size)
        tokens = np.empty(int(ends[-1]) if len(ends) else 0, np.uint64)
        tokens[ends - 1] = END
        for w, end in zip(words, ends):
            tokens[end - 1 - len(w) : end - 1] = hash_words(w)
        self.size, self.doc = size, np.repeat(np.arange(len(ids)), size)
        self.held = np.array([zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1 for i in ids], bool)
        self.keys, self.at = np.unique(tokens, return_inverse=True)
        self.trained = np.bincount(self.at, weights=~self.held[self.doc], minlength=len(self.keys)).astype(np.int64)

    def bigrams(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (context, word) places, len(keys) for the start, with training counts, and for
        every token the place of its bigram among them."""
        start = len(self.keys)
        before = np.r_[start, self.at[:-1]]
        before[np.cumsum(self.size)[:-1]] = start
        codes, mine = np.unique(before * start + self.at, return_inverse=True)
        counts = np.bincount(mine, weights=~self.held[self.doc], minlength=len(codes)).astype(np.uint32)
        return codes // start, codes % start, counts, mine


def _layout(chunk: pa.Table | pa.RecordBatch, row: int) -> tuple[list[int | None], Layout]:
    ids, sizes, texts = (chunk.column(c)[row].as_py() for c in ("ids", "sizes", "texts"))
    ids, texts = C.unpack(ids, sizes, texts)
    return ids, Layout(ids, texts)


def _slices(keys: np.ndarray, parts: int) -> Iterator[tuple[int, int, int]]:
    """(part, from, to) of sorted keys."""
    ends = [0, *np.searchsorted(keys, C.part_bounds(parts), side="left"), len(keys)]
    return ((p, ends[p], ends[p + 1]) for p in range(parts) if ends[p] < ends[p + 1])


def _small(counts: np.ndarray) -> list[int]:
    return [int((counts == r).sum()) for r in range(1, K + 2)]


def _rows(schema: pa.Schema, n: int, **columns) -> pa.Table:
    """n rows; columns that aren't given are null."""
    return pa.table([columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)


@dataclass
class Model:
    """The tables (see above) and what holds for all of them."""

    unigrams: DataFrame
    bigrams: DataFrame
    contexts: DataFrame
    unigram: Unigram
    discounts: np.ndarray


def train(docs: DataFrame, hot: int = HOT) -> Model:
    """The model of the documents that aren't held out."""
    return _model(docs, hot, Scratch(docs.sparkSession))[0]


def score_texts(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """-> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    return _model(docs, hot, Scratch(docs.sparkSession))[1]


def _model(docs: DataFrame, hot: int, scratch: Scratch) -> tuple[Model, DataFrame]:
    chunks = C.chunked(docs, scratch)
    parts, parts2 = C.part_count(chunks, 0.3), C.part_count(chunks, 1.8)

    def ask_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                _, layout = _layout(batch, row)
                for p, a, b in _slices(layout.keys, parts):
                    counts = C.planes(layout.trained[a:b].astype(np.uint32))
                    yield pa.RecordBatch.from_pydict({"part": [p], "chunk": [batch.column("chunk")[row].as_py()], "keys": [layout.keys[a:b].tobytes()], "counts": [counts]}, schema=_ASK1)

    def count_words(asked: pa.Table) -> pa.Table:
        names, n = asked.column("chunk").to_pylist(), asked.num_rows
        blobs = [np.frombuffer(x, np.uint64) for x in asked.column("keys").to_pylist()]
        counts = np.concatenate([C.unplanes(x, np.uint32) for x in asked.column("counts").to_pylist()])
        keys, mine = np.unique(np.concatenate(blobs), return_inverse=True)
        total = np.bincount(mine, weights=counts, minlength=len(keys)).astype(np.uint32)
        part = asked.column("part")[0].as_py()
        ends = np.cumsum([len(b) for b in blobs])[:-1]
        replies, ranks = np.split(total[mine], ends), [np.diff(x, prepend=0).astype(np.uint32) for x in np.split(mine, ends)]
        sums = [int(total.sum(dtype=np.int64)), int((total > 0).sum()), *_small(total)]
        has = total > 0
        return pa.concat_tables(
            [
                _rows(_REPLY1, n, chunk=pa.array(names), part=pa.array([part] * n, pa.int32()), counts=pa.array(map(C.planes, replies), pa.binary()), ids=pa.array(map(C.planes, ranks), pa.binary())),
                _rows(_REPLY1, 1, part=pa.array([part], pa.int32()), sums=pa.array([sums], pa.list_(pa.int64()))),
                _rows(_REPLY1, int(has.sum()), part=pa.array(np.full(has.sum(), part, np.int32)), word=pa.array(keys[has].view(np.int64)), id=pa.array(np.flatnonzero(has) + (part << 32)), count=pa.array(total[has].astype(np.int64))),
            ]
        )

    words = scratch.store(chunks.mapInArrow(ask_words, ASK1).repartition(parts, "part").groupBy("part").applyInArrow(count_words, REPLY1))
    unigram = Unigram(_sums(words, K + 3))

    def known(layout: Layout, replies: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """Training counts and ids of the chunk's keys."""
        by = {p: (c, i) for p, c, i in zip(*(replies.column(x).to_pylist() for x in ("part", "counts", "ids"))) if i is not None}
        counts, ids = zip(*((C.unplanes(by[p][0], np.uint32), np.cumsum(C.unplanes(by[p][1], np.uint32), dtype=np.int64) + (p << 32)) for p, _, _ in _slices(layout.keys, parts)))
        return np.concatenate(counts).astype(np.int64), np.concatenate(ids)

    def pairs(layout: Layout, counts: np.ndarray):
        """Bigrams of contexts that training has seen, ordered by part, context and word: (rows among
        all bigrams, part, context key, total of the context) and all bigrams."""
        h, w, trained, mine = layout.bigrams()
        ends = counts[np.searchsorted(layout.keys, END)] if len(layout.keys) else 0
        keys, totals = np.r_[layout.keys, START], np.r_[counts, ends]
        spread = totals > hot
        spread[-1] = True
        rows = np.flatnonzero(totals[h] > 0)  # ordered by context and word
        part = np.searchsorted(C.part_bounds(parts2), np.where(spread[h[rows]], mix(keys[h[rows]] ^ mix(keys[w[rows]])), keys[h[rows]]), side="right")
        order = np.argsort(part.astype(np.uint16) if parts2 < 1 << 16 else part, kind="stable")
        return h, w, trained, mine, rows[order], part[order], keys, totals, spread

    def heads(part: np.ndarray, h: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.r_[True, (part[1:] != part[:-1]) | (h[1:] != h[:-1])]) if len(h) else np.empty(0, np.int64)

    def ask_pairs(chunk: pa.Table, replies: pa.Table) -> pa.Table:
        out: dict[str, list] = {f.name: [] for f in _ASK2}
        for row in range(chunk.num_rows):
            _, layout = _layout(chunk, row)
            counts, ids = known(layout, replies)
            h, w, trained, _, rows, part, keys, totals, spread = pairs(layout, counts)
            first = heads(part, h[rows])
            sizes = np.diff(np.r_[first, len(rows)]).astype(np.uint32)
            for p in np.unique(part):
                a, b = np.searchsorted(part, [p, p + 1])
                f, t = np.searchsorted(first, [a, b])
                own = rows[a:b]
                values = (int(p), chunk.column("chunk")[row].as_py(), keys[h[rows[first[f:t]]]].tobytes(), spread[h[rows[first[f:t]]]].tobytes(), C.planes(sizes[f:t]), C.planes(ids[w[own]]), C.planes(trained[own]), C.planes(counts[w[own]].astype(np.uint32)))
                for name, value in zip(out, values):
                    out[name].append(value)
        return pa.table(out, schema=_ASK2)

    def count_pairs(asked: pa.Table) -> pa.Table:
        take = lambda name, f: [f(x) for x in asked.column(name).to_pylist()]
        contexts = take("contexts", lambda x: np.frombuffer(x, np.uint64))
        sizes = take("sizes", lambda x: C.unplanes(x, np.uint32))
        words_ = take("keys", lambda x: C.unplanes(x, np.int64))
        hs, h_at = np.unique(np.concatenate(contexts), return_inverse=True)
        h, w = np.repeat(h_at, np.concatenate(sizes)), np.concatenate(words_)
        ends, word_ends = np.cumsum([len(x) for x in contexts])[:-1], np.cumsum([len(x) for x in words_])[:-1]
        order = np.lexsort((w, h))
        new = np.r_[True, (h[order][1:] != h[order][:-1]) | (w[order][1:] != w[order][:-1])]
        group = np.cumsum(new) - 1
        total = np.bincount(group, weights=np.concatenate(take("counts", lambda x: C.unplanes(x, np.uint32)))[order]).astype(np.int64)
        heads_ = order[new]
        gh, gw = h[heads_], w[heads_]
        gp = unigram(np.concatenate(take("singles", lambda x: C.unplanes(x, np.uint32)))[heads_].astype(np.int64))
        small = np.stack([np.bincount(gh[total == r], minlength=len(hs)) for r in range(1, K + 1)], axis=1)
        seen = np.bincount(gh, weights=np.where(total > 0, gp, 0.0), minlength=len(hs))
        sums = np.bincount(gh, weights=total, minlength=len(hs)).astype(np.int64)
        mine = np.empty(len(order), np.uint32)
        mine[order] = total[group]
        flags = take("spread", lambda x: np.frombuffer(x, bool))
        spread = np.bincount(h_at, weights=np.concatenate(flags), minlength=len(hs)) > 0
        n, has, of = asked.num_rows, total > 0, sums > 0
        part = lambda k: pa.array(np.full(k, asked.column("part")[0].as_py(), np.int32))
        replies = _rows(
            _REPLY2, n, chunk=asked.column("chunk"), part=part(n), counts=pa.array(map(C.planes, np.split(mine, word_ends)), pa.binary()),
            small=pa.array([C.planes(small[x].astype(np.uint32).reshape(-1)) for x in np.split(h_at, ends)], pa.binary()), seen=pa.array([seen[x].tobytes() for x in np.split(h_at, ends)], pa.binary()),
            asked=pa.array([c[f].view(np.int64) for c, f in zip(contexts, flags)], pa.list_(pa.int64())),
        )
        counted = _rows(_REPLY2, int(has.sum()), part=part(has.sum()), context=pa.array(hs[gh[has]].view(np.int64)), id=pa.array(gw[has]), count=pa.array(total[has]))
        stats = _rows(_REPLY2, int(of.sum()), part=part(of.sum()), context=pa.array(hs[of].view(np.int64)), count=pa.array(sums[of]), r=pa.array(list(small[of]), pa.list_(pa.int64())), mass=pa.array(seen[of]), spread=pa.array(spread[of]))
        return pa.concat_tables([replies, _rows(_REPLY2, 1, part=part(1), sums=pa.array([_small(total)], pa.list_(pa.int64()))), counted, stats])

    mine = words.where("chunk is not null").select("chunk", "part", "counts", "ids", *[F.lit(None).cast("binary").alias(c) for c in ("small", "seen")], F.lit(None).cast(_HELD).alias("held"))
    asked = chunks.groupBy("chunk").cogroup(mine.groupBy("chunk")).applyInArrow(ask_pairs, ASK2)
    told = scratch.store(asked.repartition(parts2, "part").groupBy("part").applyInArrow(count_pairs, REPLY2))
    d = discounts(_sums(told, K + 1))
    # The sums of spread contexts, one row each; stored, so that adaptive execution can split the join.
    stats = told.where("context is not null and id is null")
    whole = scratch.store(stats.where("spread").groupBy("context").agg(F.sum("count").alias("count"), F.array(*[F.sum(F.get("r", F.lit(i))) for i in range(K)]).alias("r"), F.sum("mass").alias("mass")))
    held = (
        told.where("chunk is not null").select("chunk", F.explode("asked").alias("context")).distinct().join(whole, "context")
        .groupBy("chunk").agg(F.collect_list(F.struct("context", "r", "mass")).alias("held"))
        .select("chunk", F.lit(-1).alias("part"), *[F.lit(None).cast("binary").alias(c) for c in ("counts", "ids", "small", "seen")], "held")
    )

    def finish(chunk: pa.Table, replies: pa.Table) -> pa.Table:
        out: dict[str, list] = {f.name: [] for f in _RESULT}
        for row in range(chunk.num_rows):
            ids, layout = _layout(chunk, row)
            counts, _ = known(layout, replies)
            h, w, _, mine_, rows, part, keys, totals, spread = pairs(layout, counts)
            p1 = np.log10(unigram(counts))
            first = heads(part, h[rows])
            small, seen, total = np.zeros((len(first), K), np.int64), np.zeros(len(first)), np.zeros(len(rows), np.int64)
            got = {p: (c, s, x) for p, c, s, x in zip(*(replies.column(c).to_pylist() for c in ("part", "counts", "small", "seen"))) if s is not None}
            for p in np.unique(part):
                a, b = np.searchsorted(part, [p, p + 1])
                f, t = np.searchsorted(first, [a, b])
                c, s, x = got[int(p)]
                total[a:b] = C.unplanes(c, np.uint32)
                small[f:t] = C.unplanes(s, np.uint32).reshape(-1, K)
                seen[f:t] = np.frombuffer(x, np.float64)
            head = h[rows[first]]
            sums = {x["context"]: (x["r"], x["mass"]) for own in replies.column("held").to_pylist() if own for x in own}
            for i in np.flatnonzero(spread[head]):
                # A context that only held-out texts have is in no sum.
                small[i], seen[i] = sums.get(int(keys[head[i]].view(np.int64)), (np.zeros(K, np.int64), 0.0))
            factor, weight = context(totals[head], small, seen, d)
            each = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(rows)]))
            value = p1[w].copy()
            share = factor[each] * kept(total, d) / totals[h[rows]]
            value[rows] = np.where(total > 0, np.log10(np.where(total > 0, share, 1.0)), np.log10(weight[each]) + p1[w[rows]])
            n = len(ids)
            base = np.log10((counts + 0.5) / (unigram.n + 0.5 * (unigram.v + 1)))
            out["doc_id"] += ids
            out["held_out"] += layout.held.tolist()
            out["n_tokens"] += layout.size.tolist()
            out["n_known"] += np.bincount(layout.doc, weights=counts[layout.at] > 0, minlength=n).astype(np.int64).tolist()
            out["base_score"] += np.bincount(layout.doc, weights=base[layout.at], minlength=n).tolist()
            out["score"] += np.bincount(layout.doc, weights=value[mine_], minlength=n).tolist()
        return pa.table(out, schema=_RESULT)

    both = mine.unionByName(told.where("chunk is not null").select("chunk", "part", "counts", F.lit(None).cast("binary").alias("ids"), "small", "seen", F.lit(None).cast(_HELD).alias("held"))).unionByName(held)
    scored = chunks.groupBy("chunk").cogroup(both.groupBy("chunk")).applyInArrow(finish, RESULT)
    scored = scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(unigram.n).cast("long").alias("train_tokens"), "base_score", "score")
    every = stats.where("not spread").select("context", "count", "r", "mass").unionByName(whole)
    model = Model(
        words.where("word is not null").select("word", "id", "count", "part"),
        told.where("id is not null").select("context", "id", "count", "part"),
        every.mapInArrow(_weights(d), WEIGHTS),
        unigram,
        d,
    )
    return model, scored


_HELD = "array<struct<context:long,r:array<long>,mass:double>>"


def _weights(d: np.ndarray):
    """The factor of the seen bigrams and the backoff weight of contexts."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, mass = (batch.column(c).to_numpy() for c in ("count", "mass"))
            small = np.array(batch.column("r").to_pylist(), np.int64).reshape(-1, K)
            factor, weight = context(total, small, mass, d)
            yield pa.RecordBatch.from_arrays([batch.column("context"), batch.column("count"), pa.array(factor), pa.array(weight)], schema=_WEIGHTS)

    return weigh


def evaluate(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, row_hash, n_tokens, score of any documents by a model's tables, one row for equal rows: each
    token recurses from its bigram to the context's weight and the word's probability."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, own, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                words = np.r_[hash_words(split((text.as_py() or "").encode("utf-8", "surrogatepass"), lower=True)), END]
                both, times = np.unique(np.stack([np.r_[START, words[:-1]], words], axis=1), axis=0, return_counts=True)
                n = len(both)
                yield pa.RecordBatch.from_arrays([pa.array([i] * n, pa.int64()), pa.array([own] * n, pa.int64()), *(pa.array(np.ascontiguousarray(both[:, k]).view(np.int64)) for k in (0, 1)), pa.array(times.astype(np.int64))], schema=_TOKENS)

    u, d = model.unigram, model.discounts
    table = lambda x: F.array(*[F.lit(float(v)) for v in x[1:]])
    held = lambda c, x: c * F.when(c <= K, F.element_at(table(x), F.least(c, F.lit(K)).cast("int"))).otherwise(1.0)
    single: Column = F.when(F.col("single") > 0, F.lit(float(u.factor)) * held(F.col("single"), u.d) / max(u.n, 1)).otherwise(float(u.unseen))
    seen = F.col("factor") * held(F.col("count"), d) / F.col("total")
    p = F.when(F.col("count") > 0, seen).when(F.col("total") > 0, F.col("weight") * single).otherwise(single)
    rows = docs.select(F.col("doc_id").cast("long"), row_hash().alias("row_hash"), "text").dropDuplicates(["doc_id", "row_hash"])
    asked = rows.mapInArrow(read, TOKENS)
    words = model.unigrams.select("word", "id", F.col("count").alias("single"))
    met = asked.join(words, "word", "left").join(model.bigrams.drop("part"), ["context", "id"], "left").join(model.contexts, "context", "left")
    return met.groupBy("doc_id", "row_hash").agg(F.sum("times").alias("n_tokens"), F.sum(F.col("times") * F.log10(p)).alias("score"))


def _sums(replies: DataFrame, n: int) -> list[int]:
    """The parts' sums, added up."""
    row = replies.where("sums is not null").agg(*[F.sum(F.get("sums", F.lit(i))) for i in range(n)]).first()
    return [int(x or 0) for x in row]
