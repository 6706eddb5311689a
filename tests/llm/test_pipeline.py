"""The pipeline's stages on a small table, each against what it must do."""

import collections
import random

from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import neardup, quality

from .test_corpus import brute_components


def test_stages(spark, docs, tmp_path):
    item = " ".join(f"bench{i}" for i in range(25))
    extra = [(500, f"words around the item {item} and after it too", "en", "s", 0), (501, 'my words here are ten and more, token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" so there it is', "en", "s", 0), (502, "SHOUTING ALL DAY LONG IS NOT A WAY TO WRITE DOCUMENTS", "en", "s", 0)]
    own = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    own.write.parquet(str(tmp_path / "documents.parquet"))
    at, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, at, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        seen[name] = (at, spark.read.parquet(str(tmp_path / name)))
        if name != "best_fit_packing":
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        at = seen[name][1]
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    before, after = seen["quality_rules"]
    assert ids(after) == ids(quality.cascade(before).where("kept")) and 502 not in ids(after) and {500, 501} <= ids(after)
    before, after = seen["near_dedup"]
    assert ids(after) == {c for _, _, n, c in brute_components([(r["doc_id"], r["text"]) for r in before.collect()], 80)}
    before, after = seen["decontamination"]
    assert ids(before) - ids(after) == {500}
    before, after = seen["secret_scans"]
    texts = {r["doc_id"]: r["text"] for r in after.collect()}
    assert ids(before) == ids(after) and "24be64439e" not in texts[501] and "[secret]" in texts[501]
    assert all(texts[r["doc_id"]] == r["text"] for r in before.where("doc_id <> 501").collect())
    before, after = seen["best_fit_packing"]
    assert ids(after) == ids(before)
    rows = lambda df: collections.Counter((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in df.collect())
    assert rows(corpus_pipeline.run(spark, str(tmp_path))) == rows(after)
    assert after.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0


def test_stages_on_odd_tables(spark, tmp_path):
    """Texts of a million letters, blanks and line ends, columns of a stage's own names, and a table without rows."""
    spark.createDataFrame([(0, "nothing of it stands in these texts at all")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rng = random.Random(2)
    words = [f"w{rng.randrange(5000)}" for _ in range(150_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:-5])), (3, " ".join(words[:40])), (4, None), (5, ""), (6, " ".join(words[50:90]) + " " * 1_000_000 + " ".join(words[90:130]) + "\n" * 1_000_000 + "end")]
    full = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    own = full.withColumns({c: F.lit("mine") for c in ("key", "row_hash", "_h", "spans", "row", "node")})
    for docs, want in ((own, {1, 3, 6}), (own.limit(0), set())):
        at = docs
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, at, str(tmp_path))
            path = str(tmp_path / f"{name}{len(want)}")
            out.write.parquet(path)
            at = spark.read.schema(out.schema).parquet(path)
            if name != "best_fit_packing":
                assert out.columns == docs.columns and at.where("key <> 'mine' or node <> 'mine'").count() == 0
        assert {r["doc_id"] for r in at.select("doc_id").distinct().collect()} == want


def test_near_dedup_links_at_eighty_in_a_hundred(spark, tmp_path):
    """Against brute force; most pairs lie between 0.80 and 0.85, where op5's threshold takes none."""
    rng, data = random.Random(8), []
    for g in range(60):
        w = [f"g{g}w{k}" for k in range(204)]
        data.append((2 * g, " ".join(w), "en", "s", 0))
        for at in rng.sample(range(10, 190, 12), rng.choice([3, 4, 4, 4, 5])):
            w[at] = f"x{rng.randrange(10**6)}"
        data.append((2 * g + 1, " ".join(w), "en", "s", 0))
    sets = {}
    for i, t, *_ in data:
        w = t.split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    alike = {g: (len(sets[2 * g] & sets[2 * g + 1]), len(sets[2 * g] | sets[2 * g + 1])) for g in range(60)}
    want = {2 * g for g in alike} | {2 * g + 1 for g, (both, either) in alike.items() if 100 * both < 80 * either}
    between = [g for g, (both, either) in alike.items() if 80 * either <= 100 * both < 85 * either]
    assert len(between) > 20 and len(want) > 65
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, str(tmp_path)).collect()} == want


def test_forest_follows_the_threshold():
    assert neardup.levels(85) == [2, 5, 8]
    for percent in range(60, 100, 5):
        s, depths = percent / 100, neardup.levels(percent)
        assert (1 - s ** depths[-1]) ** neardup.TREES <= 5e-4 and depths[0] == 2
    assert neardup.agreeing(80) < neardup.agreeing(85) < 0.85 * neardup.SKETCH
