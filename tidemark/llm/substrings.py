"""Substring dedup by level-wise doubling.

Levels double in length up to `window`, the length that decides: 7 and 13 words for 13; 7, 13, 25 and 50
for 50. On each but the last, windows are asked for that start in more than one document; only windows
over such a part go on to the next level, and the levels end early when no candidates survive. A window of
the next level is represented by one of its parts, the one with the least hash: equal windows pick the
same part, so nothing is missed, and a quarter of all parts is asked for instead of each. Where no part
repeats, the text asks nothing on the next level. Lengths over `window` would change no result and are
not asked for.

The last level compares whole windows by 120 bits, two hashes of the words' 64-bit hashes that are
independent; the levels before it compare by 56 bits and can only let too much through. Computed: of the
1e14 windows of 1 PB of text two unlike ones agree with a chance of 1e-8.

A word goes if it is covered by a window whose word sequence also starts in a document with a smaller
doc_id. Windows are judged on the input, not on what is left. Defined cases: null or empty text: no
words; fewer words than a window: nothing removed; very long texts: whole, like others; null doc_id: after
all others; ties: rows with one doc_id don't remove from each other; repeated rows: each gets its own
result; empty table: no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import chunks as C
from .common import Scratch
from .shingles import hash_words, mix, split, windows

LAST = np.iinfo(np.int64).max
#: Lengths over this are halved for one more level before them; bits of a window's hash that early levels
#: use (of which a part of the key space compares the low 56).
SHORT, BITS = 8, 64
ASK = "part int, chunk string, ids binary, counts binary, keys binary, more binary, own boolean"
REPLY = "level int, chunk string, part int, bits binary, some boolean"
RESULT = "doc_id long, n_words long, n_removed long, kept string"
_ASK = pa.schema([("part", pa.int32()), ("chunk", pa.string()), ("ids", pa.binary()), ("counts", pa.binary()), ("keys", pa.binary()), ("more", pa.binary()), ("own", pa.bool_())])
_REPLY = pa.schema([("level", pa.int32()), ("chunk", pa.string()), ("part", pa.int32()), ("bits", pa.binary()), ("some", pa.bool_())])
_RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])
#: Rows of a result that go to the JVM at once.
ROWS = 200


def lengths(window: int) -> list[int]:
    """Words of a window on each level."""
    out = [window]
    while out[0] > SHORT:
        out.insert(0, -(-out[0] // 2))
    return out


def _groups(keys: np.ndarray, more: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal keys stand together, first ones first, and where in it a new key begins."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    new = np.r_[True, ordered[1:] != ordered[:-1]] if len(keys) else np.empty(0, bool)
    if more is not None and len(keys):
        differ = more[order][1:] != more[order][:-1]
        if (differ & ~new[1:]).any():  # keys clash
            order = np.lexsort((more, keys))
            new[1:] = (keys[order][1:] != keys[order][:-1]) | (more[order][1:] != more[order][:-1])
    return order, new


class Question:
    """The distinct keys of a chunk, in the order of their first occurrence, each with the document of
    that occurrence; the occurrences are at `doc`, ordered as the documents are (by doc_id). more: a second
    hash that equal keys must agree in as well."""

    def __init__(self, keys: np.ndarray, doc: np.ndarray, sent: np.ndarray, parts: int, more: np.ndarray | None = None):
        order, new = _groups(keys, more)
        heads = order[new]
        by_place = np.argsort(heads)
        rank = np.empty(len(heads), np.int64)
        rank[by_place] = np.arange(len(heads))
        self.mine = np.empty(len(keys), np.int64)
        self.mine[order] = rank[np.cumsum(new) - 1]
        heads = heads[by_place]
        self.keys, self.doc, self.sent = keys[heads], doc[heads], sent
        self.more = None if more is None else more[heads]
        self.part = np.searchsorted(C.part_bounds(parts), self.keys, side="right")
        #: Occurrences in a greater document than the first one here.
        self.behind = sent[doc] > sent[self.doc[self.mine]]

    def blobs(self, chunk: str) -> Iterator[dict]:
        order = np.argsort(self.part, kind="stable")
        ends = np.searchsorted(self.part[order], np.arange(int(self.part.max(initial=0)) + 2))
        some = bool(self.behind.any())
        for p in np.flatnonzero(np.diff(ends)):
            own = order[ends[p] : ends[p + 1]]
            counts = np.bincount(self.doc[own], minlength=len(self.sent)).astype(np.int32)
            has = np.flatnonzero(counts)
            more = None if self.more is None else self.more[own].tobytes()
            yield {"part": int(p), "chunk": chunk, "ids": C.planes(np.diff(self.sent[has], prepend=0)), "counts": C.planes(counts[has]), "keys": C.pack_keys(self.keys[own]), "more": more, "own": some}

    def told(self, replies: dict[int, bytes]) -> np.ndarray:
        """The replies' bits, by distinct key."""
        out = np.zeros(len(self.keys), bool)
        for p in np.unique(self.part):
            own = np.flatnonzero(self.part == p)
            out[own] = np.unpackbits(np.frombuffer(replies[int(p)], np.uint8), count=len(own)).astype(bool)
        return out


class Texts:
    """A chunk's words and windows; replays the levels that have been answered."""

    def __init__(self, ids: list[int | None], texts: list[bytes], steps: list[int], parts: list[int], bits: int):
        self.words = [split(t, lower=False) for t in texts]
        self.sent = np.array([LAST if i is None else i for i in ids], np.int64)
        self.size = np.array([len(w) for w in self.words], np.int64)
        self.doc = np.repeat(np.arange(len(ids)), self.size)
        self.flat = hash_words([w for own in self.words for w in own])
        self.steps, self.parts, self.bits = steps, parts, np.uint64(64 - bits)
        #: Where windows of the current level start that may repeat; None: all.
        self.alive: np.ndarray | None = None

    def starts(self, length: int) -> np.ndarray:
        n = max(0, len(self.flat) - length + 1)
        return np.flatnonzero(self.doc[:n] == self.doc[length - 1 : length - 1 + n])

    def ask(self, level: int) -> Question:
        """The question of a level, after those before it were told."""
        length = self.steps[level]
        if level == len(self.steps) - 1:
            self.at = self.starts(length) if self.alive is None else np.flatnonzero(self.alive)
            # A second hash, of other hashes of the words.
            full, more = (mix(windows(x, length))[self.at] for x in (self.flat, mix(self.flat ^ np.uint64(0x5851F42D4C957F2D))))
            return Question(full, self.doc[self.at], self.sent, self.parts[level], more)
        longer = self.steps[level + 1]
        at = self.starts(longer)
        own = mix(windows(self.flat, length)) >> self.bits << self.bits
        least, pick = own[at], at.copy()
        for step in range(1, longer - length + 1):
            other = own[at + step]
            lower = other < least
            least = np.where(lower, other, least)
            pick[lower] = at[lower] + step
        if self.alive is not None:
            going = self.alive[pick]
            at, pick = at[going], pick[going]
        places = np.unique(pick)
        self.at, self.of = at, np.searchsorted(places, pick)
        return Question(own[places], self.doc[places], self.sent, self.parts[level])

    def tell(self, question: Question, replies: dict[int, bytes]) -> None:
        shared = question.told(replies)
        shared[question.mine[question.behind]] = True
        self.alive = np.zeros(len(self.flat), bool)
        self.alive[self.at[shared[question.mine][self.of]]] = True

    def replay(self, replies: dict[int, dict[int, bytes]], levels: int) -> None:
        """Goes on from the last level whose question left its state."""
        begin = max((k for k in range(levels + 1) if -1 in replies.get(k, {})), default=0)
        if begin:
            self.alive = np.unpackbits(np.frombuffer(replies[begin][-1], np.uint8), count=len(self.flat)).astype(bool)
        for level in range(begin, levels):
            self.tell(self.ask(level), replies[level])

    def state(self, chunk: str, parts: int) -> dict:
        """What is alive, as a row that comes back with the replies; it goes to one of many negative parts."""
        return {"part": -1 - zlib.crc32(chunk.encode()) % parts, "chunk": chunk, "keys": np.packbits(self.alive).tobytes()}


def _by_level(replies: pa.Table, chunk: str, levels: int) -> dict[int, dict[int, bytes]]:
    out: dict[int, dict[int, bytes]] = {k: {} for k in range(levels)}
    for level, name, part, bits in zip(*(replies.column(c).to_pylist() for c in ("level", "chunk", "part", "bits"))):
        if name == chunk:
            out[level][part] = bits
    return out


def _answer(level: int, last: bool):
    """Per key: whether two documents hold it, on the last level whether a smaller document does."""

    def answer(asked: pa.Table) -> pa.Table:
        n = asked.num_rows
        if asked.column("part")[0].as_py() < 0:
            return pa.table({"level": [level] * n, "chunk": asked.column("chunk"), "part": [-1] * n, "bits": asked.column("keys"), "some": [False] * n}, schema=_REPLY)
        blobs = asked.column("keys").to_pylist()
        keys = np.concatenate([C.unpack_keys(b) for b in blobs])
        doc = np.concatenate([np.repeat(np.cumsum(C.unplanes(i, np.int64)), C.unplanes(c, np.int32)) for i, c in zip(asked.column("ids").to_pylist(), asked.column("counts").to_pylist())])
        more = np.concatenate([np.frombuffer(x, np.uint64) for x in asked.column("more").to_pylist()]) if last else None
        order, new = _groups(keys, more)
        heads, group = np.flatnonzero(new), np.cumsum(new) - 1
        least = np.minimum.reduceat(doc[order], heads)
        yes = np.empty(len(keys), bool)
        yes[order] = least[group] < doc[order] if last else (least < np.maximum.reduceat(doc[order], heads))[group]
        ends = np.cumsum([len(b) // 7 for b in blobs])
        split_ = np.split(yes, ends[:-1])
        own = asked.column("own").to_pylist()
        return pa.table({"level": [level] * n, "chunk": asked.column("chunk"), "part": asked.column("part"), "bits": [np.packbits(x).tobytes() for x in split_], "some": [bool(x.any()) or o for x, o in zip(split_, own)]}, schema=_REPLY)

    return answer


def remove_repeats(docs: DataFrame, window: int = 13) -> DataFrame:
    """-> doc_id, n_words, n_removed, kept_sha256: kept_texts with a digest in place of the text."""
    return kept_texts(docs, window).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def kept_texts(docs: DataFrame, window: int = 13, bits: int = BITS) -> DataFrame:
    """-> doc_id, n_words, n_removed, kept: the words that stay, joined by blanks. bits: by which the levels
    before the last compare windows; fewer let more through and change no result."""
    scratch = Scratch(docs.sparkSession)
    chunks = C.chunked(docs, scratch)
    steps = lengths(window)
    parts = [C.part_count(chunks, 0.8 if k == len(steps) - 1 else 0.4) for k in range(len(steps))]

    def texts(table: pa.Table | pa.RecordBatch, row: int) -> tuple[list[int | None], Texts]:
        ids, own = C.unpack(*(table.column(c)[row].as_py() for c in ("ids", "sizes", "texts")))
        return ids, Texts(ids, own, steps, parts, bits)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                for blob in texts(batch, row)[1].ask(0).blobs(batch.column("chunk")[row].as_py()):
                    yield pa.RecordBatch.from_pylist([blob], schema=_ASK)

    def following(level: int):
        def ask(chunk: pa.Table, replies: pa.Table) -> pa.Table:
            out: list[dict] = []
            for row in range(chunk.num_rows):
                name, (_, t) = chunk.column("chunk")[row].as_py(), texts(chunk, row)
                t.replay(_by_level(replies, name, level), level)
                out += [*t.ask(level).blobs(name), t.state(name, parts[level])]
            return pa.Table.from_pylist(out, schema=_ASK)

        return ask

    told: DataFrame | None = None
    survive = True
    for level in range(len(steps)):
        asked = chunks.mapInArrow(first, ASK) if told is None else chunks.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(following(level), ASK)
        answer = _answer(level, level == len(steps) - 1)
        replies = scratch.store(asked.repartition(parts[level], "part").groupBy("part").applyInArrow(answer, REPLY))
        told = replies if told is None else told.unionByName(replies)
        survive = bool(replies.agg(F.max("some")).first()[0])
        if not survive:
            break

    def finish(chunk: pa.Table, replies: pa.Table) -> pa.Table:
        out: dict[str, list] = {f.name: [] for f in _RESULT}
        for row in range(chunk.num_rows):
            name, (ids, t) = chunk.column("chunk")[row].as_py(), texts(chunk, row)
            cover = np.zeros(int(t.size.sum()) + window, np.int32)
            if survive:
                last = len(steps) - 1
                got = _by_level(replies, name, len(steps))
                t.replay(got, last)
                q = t.ask(last)
                gone = t.at[q.told(got[last])[q.mine] | q.behind]
                np.add.at(cover, gone, 1)
                np.add.at(cover, gone + window, -1)
            covered = np.cumsum(cover) > 0
            begin = 0
            for i, words in zip(ids, t.words):
                mask = covered[begin : begin + len(words)]
                begin += len(words)
                kept = [w for w, g in zip(words, mask) if not g] if mask.any() else words
                out["doc_id"].append(i)
                out["n_words"].append(len(words))
                out["n_removed"].append(len(words) - len(kept))
                out["kept"].append(b" ".join(kept).decode("utf-8", "surrogatepass"))
        return pa.Table.from_batches(pa.table(out, schema=_RESULT).to_batches(ROWS), _RESULT)

    return chunks.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(finish, RESULT)
