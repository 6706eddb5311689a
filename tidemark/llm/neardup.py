"""MinHash near-duplicates with an LSH forest.

A document's set holds its distinct shingles of `width` words (A-Z in lower case). Documents with equal
sets are one node. TREES signature orders of DEPTH min-hashes each are kept sorted, every one a tree
written out in order: neighbours in an order share the longest prefixes. Candidates come in three rounds:

1. neighbours in each order; every node confirms the FIRST whose signatures agree best;
2. all other neighbours that are still in different components;
3. all pairs below one tree node that are so even then. How deep that tree node lies adapts to the
   region: a pair meets where its region has no more than CROSS such pairs per member, and at full depth
   in any case.

Only nodes that share a tree node of depth LEAST with another one take part. Every link is confirmed on the
full sets, 100 * intersection >= percent * union; pairs are confirmed whose signatures agree in percent
less DEVIATIONS standard deviations, by which a link at the threshold is lost with probability 3e-7. A
pair inside one component needs no confirmation, so a group of n near copies costs a multiple of n. Full
depth follows `percent`: a pair at the threshold is missed by all trees with probability MISS at most at
full depth (5e-4 at depth 8 for 85, 7e-5 at depth 5 for 80), in regions that are crowded down to there; in
others it meets at depth 2, where all trees miss it with less than 1e-10. Thresholds under 54 would need
more trees than there are.

Defined cases: null or empty text, or no words: an empty set, linked with nothing; fewer words than
width: the whole sequence as one shingle; very long texts: whole, like others; null doc_id: after all
others; rows with one doc_id are judged by their texts; ties: the least doc_id stays; repeated rows: one
node, the same result; empty table: no rows; other columns, whatever their names, are ignored by
near_duplicates and kept by drop_near_duplicates.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, row_hash, without
from .shingles import hash_words, mix, split, windows

WIDTH, PERCENT, TREES, DEPTH = 5, 85, 24, 8
#: Neighbours taken on each side of an order, partners that a node confirms first, least depth at which
#: nodes meet, pairs per member that a region may have.
REACH, FIRST, LEAST, CROSS = 2, 2, 2, 8
#: Members of a region that a task holds twice at most, and shingles that they have; shingles of sets that a
#: task keeps at a time.
BLOCK, BLOCK_SHINGLES, HELD = 4096, 8 << 20, 2 << 20
#: For a pair at the threshold: the probability that all trees miss it at full depth; standard deviations
#: by which its signatures' agreement may fall short.
MISS, DEVIATIONS = 5e-4, 5.0

#: A signature: one byte of every min-hash, tree by tree, then three more of the first LEAST of each tree.
SKETCH, MORE = TREES * DEPTH, 3 * LEAST
BASE = "doc_id long, row_hash long, key binary, n_shingles long, sign binary"
_BASE = pa.schema([("doc_id", pa.int64()), ("row_hash", pa.int64()), ("key", pa.binary()), ("n_shingles", pa.int64()), ("sign", pa.binary())])
PAIRS = "a long, b long, alike int"
_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("alike", pa.int32())])
LINKS = "a long, b long"
_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])
_SEEDS = (np.random.default_rng(20240101).integers(0, 1 << 32, TREES * DEPTH, dtype=np.uint32) | np.uint32(1)).astype(np.uint32)


def levels(percent: int) -> list[int]:
    """Depths at which regions are tried; the last one is as deep as MISS allows."""
    last = max((d for d in range(LEAST, DEPTH + 1) if (1 - (percent / 100) ** d) ** TREES <= MISS), default=LEAST)
    return sorted({LEAST, (LEAST + last) // 2, last})


def agreeing(percent: int) -> int:
    """Least number of equal min-hashes for which full sets are compared."""
    s = percent / 100
    return max(1, math.ceil(SKETCH * s - DEVIATIONS * math.sqrt(SKETCH * s * (1 - s))))


def shingles(text: bytes, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    words = hash_words(split(text, lower=True))
    return np.unique(windows(words, min(width, len(words)))) if len(words) else np.empty(0, np.uint64)


def set_key(own: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(own.tobytes())


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of SKETCH + TREES * MORE bytes per set; the sets aren't empty."""
    out = np.empty((len(sets), TREES * DEPTH), np.uint32)
    at = 0
    while at < len(sets):  # blocks that fit into a processor's cache
        to, held = at, 0
        while to < len(sets) and (to == at or held + len(sets[to]) <= 1 << 16):
            held += len(sets[to])
            to += 1
        x = (mix(np.concatenate(sets[at:to])) >> np.uint64(32)).astype(np.uint32)
        starts = np.cumsum([0, *(len(s) for s in sets[at : to - 1])])
        for k, seed in enumerate(_SEEDS):
            out[at:to, k] = np.minimum.reduceat(x * seed, starts)
        at = to
    spread = (out * np.uint32(0x9E3779B1)).astype(">u4").view(np.uint8).reshape(len(sets), TREES, DEPTH, 4)
    return np.concatenate([spread[..., 0].reshape(len(sets), -1), spread[:, :, :LEAST, 1:].reshape(len(sets), -1)], axis=1)


def path(tree: Column, depth: Column | int = DEPTH) -> Column:
    """The first min-hashes of a tree, as bytes that sort as the tree does."""
    first = [x for k in range(LEAST) for x in (F.substring("sign", tree * DEPTH + (k + 1), F.lit(1)), F.substring("sign", tree * MORE + (SKETCH + 3 * k + 1), F.lit(3)))]
    return F.concat(*first, F.substring("sign", tree * DEPTH + (LEAST + 1), F.lit(depth) - LEAST))


def _base(docs: DataFrame, width: int) -> DataFrame:
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 2000):
                part = batch.slice(begin, 2000)
                sets = [shingles((t.as_py() or "").encode("utf-8", "surrogatepass"), width) for t in part.column(1)]
                full = [i for i, s in enumerate(sets) if len(s)]
                signs: list[bytes | None] = [None] * len(sets)
                for i, row in zip(full, signatures([sets[i] for i in full])) if full else ():
                    signs[i] = row.tobytes()
                keys = [set_key(s) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(keys, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array(signs, pa.binary())], schema=_BASE)

    return docs.select(F.col("doc_id").cast("long"), "text", row_hash().alias("row_hash")).mapInArrow(sign, BASE)


def _rows(column: pa.Array, size: int) -> np.ndarray:
    """A column of equally long blobs as rows of bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, size)


def _neighbours(forest: DataFrame, percent: int) -> DataFrame:
    """a, b, alike: pairs of nodes close to each other in an order whose signatures are near enough. The
    orders are sorted across the cluster; equal paths are told apart by the node, so no region is too
    large for a task."""
    least = agreeing(percent)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried: pa.Table | None = None
        for batch in batches:
            new = pa.Table.from_batches([batch])
            own = new if carried is None else pa.concat_tables([carried, new])
            begin, n = own.num_rows - batch.num_rows, own.num_rows
            own = own.combine_chunks()
            place, node, size = (own.column(c).to_numpy() for c in ("p", "node", "n_shingles"))
            sketch = _rows(own.column("sketch"), SKETCH)
            found = []
            for reach in range(1, REACH + 1):
                i = np.arange(max(begin, reach), n)
                j = i - reach
                met = (place[i] == place[j]) & (100 * np.minimum(size[i], size[j]) >= percent * np.maximum(size[i], size[j]))
                i, j = i[met], j[met]
                alike = (sketch[i] == sketch[j]).sum(axis=1)
                good = alike >= least
                i, j = i[good], j[good]
                found.append((np.minimum(node[i], node[j]), np.maximum(node[i], node[j]), alike[good].astype(np.int32)))
            carried = own.slice(max(0, n - REACH))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], schema=_PAIRS)

    ordered = forest.repartitionByRange("tree", "path", "node").sortWithinPartitions("tree", "path", "node")
    return ordered.select("p", "node", "n_shingles", "sketch").mapInArrow(near, PAIRS).groupBy("a", "b").agg(F.first("alike").alias("alike"))


def _first(pairs: DataFrame) -> DataFrame:
    """The pairs that are among the FIRST best of one of their nodes."""
    ends = pairs.select("a", "b", "alike", F.explode(F.array("a", "b")).alias("node"))
    rank = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("alike"), "a", "b"))
    return ends.withColumn("_rank", rank).where(F.col("_rank") <= FIRST).select("a", "b").distinct()


def _payloads(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, packed: one compressed text for each of nodes (node, doc_id, row_hash)."""

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([z.compress((t.as_py() or "").encode("utf-8", "surrogatepass")) for t in batch.column(2)], pa.binary())], ["own_id", "own_hash", "packed"])

    packed = docs.select(F.col("doc_id").cast("long").alias("own_id"), row_hash().alias("own_hash"), "text").mapInArrow(squeeze, "own_id long, own_hash long, packed binary")
    held = packed.join(nodes.select("node", "doc_id", "row_hash"), F.col("own_id").eqNullSafe(F.col("doc_id")) & (F.col("own_hash") == F.col("row_hash")))
    return held.groupBy("own_id", "own_hash").agg(F.first("node").alias("node"), F.first("packed").alias("packed")).select("node", "packed")


@lru_cache(maxsize=64)
def _unpacked(packed: bytes, width: int) -> np.ndarray:
    return shingles(zstandard.ZstdDecompressor().decompress(packed), width)


def _similar(s: np.ndarray, t: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(s, t, assume_unique=True))
    return 100 * both >= percent * (len(s) + len(t) - both)


def _confirmed(pairs: DataFrame, texts: DataFrame, percent: int, width: int) -> DataFrame:
    """The pairs whose full sets are as similar as asked."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hold = []
            for x, y in zip(batch.column(2), batch.column(3)):
                hold.append(_similar(_unpacked(x.as_py(), width), _unpacked(y.as_py(), width), percent))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(hold, pa.bool_()))

    one = texts.select(F.col("node").alias("a"), F.col("packed").alias("pa"))
    two = texts.select(F.col("node").alias("b"), F.col("packed").alias("pb"))
    return pairs.select("a", "b").join(two, "b").join(one, "a").select("a", "b", "pa", "pb").mapInArrow(compare, LINKS)


def components(links: DataFrame, held: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """node, root (the smallest node reachable) for all nodes of the links, as a table in held: large-star
    and small-star steps until nothing changes; each step is written, so the lineage stays short. The least
    neighbours are stored before they are joined, so that adaptive execution can split a node with many
    links."""
    scratch = Scratch(links.sparkSession)
    edges = scratch.store(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    before = None
    while True:
        # Large star: what is above a node hangs on the least node next to it.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch.store(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = scratch.store(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v"))
        # Small star: a node and what is below it hang on the least of these.
        low = scratch.store(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u").select(F.explode(F.array(F.col("u"), F.col("v"))).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        edges = scratch.store(small)
        scratch.keep(edges)
        row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if tuple(row) == before:
            done = scratch.store(edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()))
            scratch.keep(done)
            held.adopt(scratch)
            return done
        before = tuple(row)


def _extended(labels: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """labels after more links: only the roots that these join are worked on again."""
    joined = components(_labelled(_labelled(links, labels, "a", "ra"), labels, "b", "rb").select("ra", "rb"), scratch, "ra", "rb")
    new = joined.select(F.col("node").alias("_n"), F.col("root").alias("_m"))
    moved = labels.join(new, F.col("root") == F.col("_n"), "left").select("node", F.coalesce("_m", "root").alias("root"))
    return scratch.store(moved.unionByName(joined.join(labels, "node", "left_anti")))


def _labelled(frame: DataFrame, labels: DataFrame, key: str, name: str) -> DataFrame:
    return frame.join(labels.select(F.col("node").alias("_node"), F.col("root").alias("_root")), F.col(key) == F.col("_node"), "left").withColumn(name, F.coalesce("_root", key)).drop("_node", "_root")


class _Block:
    """Members of one block of a region and of one group of its visitors. Visitors are the members outside
    the region's largest component; they sit in their own blocks as well."""

    def __init__(self, members: pa.Table, percent: int):
        members = members.combine_chunks()
        self.node, self.n, self.root = (members.column(c).to_numpy() for c in ("node", "n_shingles", "root"))
        self.visits, self.few = (members.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("visits", "few"))
        self.tree, self.percent, self.least, self.full = members.column("tree")[0].as_py(), percent, agreeing(percent), levels(percent)[-1]
        signs = _rows(members.column("sign"), SKETCH + TREES * MORE)
        self.sketch, self.more = signs[:, :SKETCH], signs[:, SKETCH:].reshape(-1, TREES, MORE)

    def pairs(self) -> Iterator[tuple[int, np.ndarray]]:
        """A visitor and the members that it may be linked to, in other components; two visitors meet where
        the lesser one visits."""
        for i in np.flatnonzero(self.visits):
            other = ~self.visits & (self.root != self.root[i]) & (100 * np.minimum(self.n, self.n[i]) >= self.percent * np.maximum(self.n, self.n[i]))
            near = np.flatnonzero(other & (~self.few | (self.node > self.node[i])))
            same = self.sketch[near] == self.sketch[i]
            near, same = near[good := same.sum(axis=1) >= self.least], same[good]
            # A pair that an earlier tree has together down to full depth is that tree's to tell.
            told = same.reshape(-1, TREES, DEPTH)[:, : self.tree, : self.full].all(axis=2) & (self.more[near, : self.tree] == self.more[i, : self.tree]).all(axis=2)
            yield i, near[~told.any(axis=1)]


def _candidates(percent: int):
    """The members of a block that may be linked to another one there."""

    def run(members: pa.Table) -> pa.Table:
        block = _Block(members, percent)
        has = np.zeros(members.num_rows, bool)
        for i, near in block.pairs():
            has[near] = True
            has[i] |= len(near) > 0
        return members.filter(pa.array(has))

    return run


def _linked(percent: int, width: int):
    """Links between members of a block, confirmed on full sets; none between members that the links before
    have joined already, so that a block gives fewer links than it has members."""

    def run(members: pa.Table) -> pa.Table:
        block, packed = _Block(members, percent), members.column("packed").to_pylist()
        sets: dict[int, np.ndarray] = {}
        above: dict[int, int] = {}
        held = 0

        def top(x: int) -> int:
            while x in above:
                x = above[x]
            return x

        def own(i: int) -> np.ndarray:
            nonlocal held
            if i not in sets:
                if held > HELD:
                    sets.clear()
                    held = 0
                sets[i] = shingles(zstandard.ZstdDecompressor().decompress(packed[i]), width)
                held += len(sets[i])
            return sets[i]

        a, b = [], []
        for i, near in block.pairs():
            for j in near:
                x, y = top(int(block.root[i])), top(int(block.root[j]))
                if x != y and _similar(own(int(i)), own(int(j)), percent):
                    above[max(x, y)] = min(x, y)
                    a.append(min(block.node[i], block.node[j]))
                    b.append(max(block.node[i], block.node[j]))
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=_LINKS)

    return run


MEMBER = "p long, block int, group int, tree int, node long, n_shingles long, root long, few boolean, visits boolean, sign binary"


def _regions(docs: DataFrame, nodes: DataFrame, labels: DataFrame, percent: int, width: int, scratch: Scratch) -> DataFrame:
    """a, b: links below one tree node between different components, each region at its own depth. Regions of
    more than BLOCK members are dealt over several tasks; only the texts of members that may have a link
    follow them."""
    rooted = scratch.store(_labelled(nodes.select("node", "n_shingles", "sign"), labels, "node", "root"))
    left = rooted.select("node", "n_shingles", "root", "sign", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    taken, depths = None, levels(percent)
    for level in depths:
        keyed = left.select("node", "n_shingles", "root", "tree", *(["sign"] if level == LEAST else ["path"]), _region(F.col("tree"), level, level == LEAST).alias("p"))
        sizes = keyed.groupBy("p", "root").agg(F.count("*").alias("c"), F.sum("n_shingles").alias("n")).groupBy("p").agg(
            F.sum("c").alias("m"), F.sum("n").alias("n"), F.sum(F.col("c") * F.col("c")).alias("same"), F.max(F.struct("c", "root", "n")).alias("top")
        ).where("m * m > same").withColumn("take", (F.col("m") * F.col("m") - F.col("same") <= 2 * CROSS * F.col("m")) | F.lit(level == depths[-1]))
        sizes = scratch.store(sizes.select("p", "m", F.col("n").alias("all_n"), "top", "take"))
        if level == LEAST:  # signatures follow only into the regions that have pairs
            keyed = keyed.withColumn("path", path(F.col("tree"))).drop("sign")
        marked = scratch.store(keyed.join(sizes, "p"))
        tasks = lambda m, n: F.ceil(F.greatest(m / BLOCK, n / BLOCK_SHINGLES)).cast("int")
        blocks, groups = tasks(F.col("m"), F.col("all_n")).alias("blocks"), tasks(F.col("m") - F.col("top.c"), F.col("all_n") - F.col("top.n")).alias("groups")
        own = marked.where("take").select("p", "tree", "node", "root", F.col("top.root").alias("most"), blocks, groups)
        taken = own if taken is None else taken.unionByName(own)
        left = marked.where("not take").select("node", "n_shingles", "root", "tree", "path")
    dealt = lambda blocks, salt: F.pmod(F.xxhash64("node", F.lit(salt)), blocks).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), blocks - 1))
    few = (F.col("root") != F.col("most")).alias("few")
    sits = taken.select("p", every(F.col("groups")).alias("group"), dealt(F.col("blocks"), 0).alias("block"), "tree", "node", few, F.lit(False).alias("visits"))
    calls = taken.where("root <> most").select("p", dealt(F.col("groups"), 1).alias("group"), every(F.col("blocks")).alias("block"), "tree", "node", few, F.lit(True).alias("visits"))
    signed = sits.unionByName(calls).join(rooted, "node").select([x.split()[0] for x in MEMBER.split(", ")])
    key = ("p", "block", "group")
    members = scratch.store(signed.groupBy(*key).applyInArrow(_candidates(percent), MEMBER))
    texts = scratch.store(_payloads(docs, nodes.join(members.select("node").distinct(), "node", "left_semi")), packed=True, texts=True)
    return members.join(texts, "node").groupBy(*key).applyInArrow(_linked(percent, width), LINKS).distinct()


def _region(tree: Column, level: int, from_sign: bool) -> Column:
    """A number for the tree node of depth `level` above a path."""
    taken = path(tree, LEAST) if from_sign else F.substring("path", 1, 4 * LEAST + level - LEAST)
    return F.xxhash64(tree, taken)


def _near(docs: DataFrame, width: int, percent: int, scratch: Scratch) -> DataFrame:
    """doc_id, row_hash, n_shingles, component_id; reads tables in scratch."""
    base = scratch.store(_base(docs, width), texts=True)
    holder = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_hash")).alias("holder")
    nodes = base.where("n_shingles > 0").groupBy("key").agg(holder, F.first("n_shingles").alias("n_shingles"), F.first("sign").alias("sign"))
    nodes = scratch.store(nodes.select(F.monotonically_increasing_id().alias("node"), "key", "holder.doc_id", "holder.row_hash", "n_shingles", "sign"))
    # Most nodes share no tree node of the least depth with another one; they are done.
    tree = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")
    places = nodes.select("node", "sign", tree).select("node", "tree", _region(F.col("tree"), LEAST, True).alias("p"))
    shared = places.groupBy("p").agg(F.count("*").alias("c")).where("c > 1").select("p")
    met = scratch.store(places.join(shared, "p", "left_semi"))
    alive = scratch.store(nodes.join(met.select("node").distinct(), "node", "left_semi").drop("key"))
    forest = met.join(alive, "node").select("tree", "p", path(F.col("tree")).alias("path"), "node", "n_shingles", F.substring("sign", 1, SKETCH).alias("sketch"))
    pairs = scratch.store(_neighbours(forest, percent))
    scratch.drop(met)
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    texts = scratch.store(_payloads(docs, alive.join(ends, "node", "left_semi")), packed=True, texts=True)
    first = scratch.store(_first(pairs))
    links = scratch.store(_confirmed(first, texts, percent, width))
    labels = components(links, scratch)
    rest = pairs.join(first, ["a", "b"], "left_anti")
    rest = scratch.store(_labelled(_labelled(rest, labels, "a", "ra"), labels, "b", "rb").where("ra <> rb").select("a", "b"))
    found = scratch.store(_confirmed(rest, texts, percent, width))
    if not found.isEmpty():
        labels = _extended(labels, found, scratch)
    scratch.keep(base, nodes, alive, labels)
    third = scratch.store(_regions(docs, alive, labels, percent, width, scratch))
    if not third.isEmpty():
        labels = _extended(labels, third, scratch)
    scratch.keep(base, nodes, labels)
    rooted = scratch.store(labels.join(nodes.select("node", "key", "doc_id"), "node"))
    least = scratch.store(rooted.groupBy("root").agg(F.min("doc_id").alias("component_id")))
    linked = rooted.join(least, "root").select("key", "component_id")
    alone = nodes.join(labels, "node", "left_anti").select("key", F.col("doc_id").alias("component_id"))
    of_key = scratch.store(linked.unionByName(alone))
    scratch.keep(base, of_key)
    whole = base.where("n_shingles > 0").select("doc_id", "row_hash", "n_shingles", "key").join(of_key, "key").drop("key")
    return whole.unionByName(base.where("n_shingles = 0").select("doc_id", "row_hash", "n_shingles", F.col("doc_id").alias("component_id")))


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, row_hash, n_shingles, component_id, kept."""
    return _near(docs, width, percent, Scratch(docs.sparkSession)).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """docs with the document of least doc_id of each component. Rows that repeat one document
    (same doc_id and text) stay together."""
    scratch = Scratch(docs.sparkSession)
    near = _near(docs, width, percent, scratch)
    gone = scratch.store(near.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id", "row_hash").distinct())
    scratch.keep(gone)
    return without(docs, gone)
