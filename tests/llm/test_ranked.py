"""Ranked search against sums over all documents."""

import math
import random
import re

import numpy as np
import pytest

from tidemark.llm import ranked
from tidemark.llm.common import Scratch

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k):
    own = [(i, terms(t)) for i, t in docs]
    own = [(i, t) for i, t in own if t]
    n, total = len(own), sum(len(t) for _, t in own)
    df = {}
    for _, t in own:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    out = []
    for item, text in items:
        asked, scores = set(terms(text)), []
        for i, t in own:
            m = 50 + 50 * len(t) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * (1_000_000_000 * t.count(x) // (1000 * t.count(x) + 20 * m)) for x in asked & set(t))
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, rank + 1, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scores, key=lambda x: x[:3])[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("chunk_bytes", [300, 1 << 20])
def test_search_against_brute_force(spark, docs, nothing, chunk_bytes):
    data = [(r["doc_id"], r["text"]) for r in docs.collect()] + [(700, "Éa étre, naïve_case X-1 x 中文"), (701, "ÉA éTRE"), (None, "the heed"), (702, "!!! ... \x7f")]
    rng = random.Random(4)
    items = [(0, data[3][1]), (1, "The HEED of eron"), (2, None), (3, ""), (4, "no such words"), (5, "éa ÉA 中文 x"), (5, "and"), (6, " ".join(rng.choice(data[5][1].split() + ["the", "zz"]) for _ in range(40))), (1, "The HEED of eron")]
    table = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame([(i, t, 3) for i, t in items], "item_id long, text string, rank int")
    found = ranked.index(table, Scratch(spark), chunk_bytes)
    for k, block in ((7, 4 << 20), (50, 200)):
        got = sorted([tuple(r) for r in ranked.search(found, asked, k, block_bytes=block).collect()], key=str)
        assert got == brute(data, items, k)
    assert ranked.search(found, asked.limit(0)).count() == 0
    assert ranked.search(ranked.index(nothing, Scratch(spark)), asked).count() == 0


@pytest.mark.parametrize("seed", range(30))
def test_reading_ends_with_the_right_documents(seed):
    rng = np.random.default_rng(seed)
    n, lists, total = 400, [], np.zeros(400, np.int64)
    for _ in range(rng.integers(1, 9)):
        docs = rng.choice(n, rng.integers(1, n), replace=False)
        docs.sort()
        impacts = rng.integers(1, rng.choice([3, 1000, 10**9]), len(docs))
        total[docs] += impacts
        order = np.argsort(-impacts, kind="stable")
        lists.append((docs[order], impacts[order]))
    want = [i for i in np.lexsort((np.arange(n), -total)) if total[i] > 0][:20]
    at, scores = ranked.best(lists, n, 20, first=2)
    assert at.tolist() == want and scores.tolist() == total[want].tolist()


def test_rare_terms_end_reading_early():
    """Two documents lead by far: the long list of the common term is not read to its end."""

    class Counted(np.ndarray):
        read = 0

        def __getitem__(self, x):
            if isinstance(x, slice):
                Counted.read = max(Counted.read, x.stop)
            return super().__getitem__(x)

    common = np.arange(100_000), np.sort(np.random.default_rng(0).integers(1, 1000, 100_000))[::-1].view(Counted)
    rare = np.array([5, 7]), np.array([10**9, 10**9 - 5])
    common = np.concatenate([[5, 7], np.setdiff1d(common[0], [5, 7])]), common[1]
    at, _ = ranked.best([common, rare], 100_000, 2)
    assert at.tolist() == [5, 7] and Counted.read < 1000
