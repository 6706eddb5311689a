"""Golden cases of the linkage and reconciliation operators, property checks, and the SQL oracles."""

import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import formats as P
from tidemark.functions import scores as S
from tidemark.functions import text as T
from tidemark.operators import link, progress, select, state
from tidemark.plans import library_queries  # noqa: F401
from tidemark.plans.queries import ORACLES, QUERIES
from tidemark.sources import readers, sinks
from tidemark.streaming import sessions

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


def values(spark, column_of, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(column_of(F.col("t"))).collect()]


def pairs(spark, f, *data):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(data)], "i int, a string, b string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("a"), F.col("b"))).collect()]


def test_isbn_forms(spark):
    got = values(spark, T.isbn_variants, "0575082011", "978-0-575-08201-4", "9780575082015", "0575082012", "9791234567896", "12", None)
    assert got == [["0575082011", "9780575082014"], ["9780575082014", "0575082011"], ["9780575082015"], ["0575082012"], ["9791234567896"], [], []]


def test_isbn_forms_are_inverse(spark):
    cores = [f"{random.Random(i).randrange(10**9):09}" for i in range(50)]
    df = spark.createDataFrame([(c,) for c in cores], "core string")
    ten = F.concat("core", F.expr("cast((11 - (10*cast(substr(core,1,1) as int)+9*cast(substr(core,2,1) as int)+8*cast(substr(core,3,1) as int)+7*cast(substr(core,4,1) as int)+6*cast(substr(core,5,1) as int)+5*cast(substr(core,6,1) as int)+4*cast(substr(core,7,1) as int)+3*cast(substr(core,8,1) as int)+2*cast(substr(core,9,1) as int)) % 11) % 11 as string)"))
    rows = df.select(F.regexp_replace(ten, "^(.{9})10$", "$1X").alias("t")).select("t", T.isbn13_to_10(T.isbn10_to_13(F.col("t"))).alias("u")).collect()
    assert all(r["t"] == r["u"] for r in rows)


def test_standard_titles(spark):
    got = values(spark, T.standard_title, "Counterfeit: A Novel", "Counterfeit: The Story of Money", "The Été (Unabridged)", "Dune, Book II", "ñix", "Part i", "東京", "", None)
    assert got == ["counterfeit", "counterfeit the story of money", "ete", "dune", "n9", "", "", "", ""]


def test_similarities(spark):
    assert pairs(spark, T.general_similarity, ("", "a"), ("a", ""), ("abc", "abc"), (None, "x")) == [0.0, 0.0, 1.0, 0.0]
    j = pairs(spark, T.jaro, ("martha", "marhta"), ("dixon", "dicksonx"), ("", ""), ("a", ""), ("ab", "cd"))
    assert [round(x, 6) for x in j] == [0.944444, 0.766667, 1.0, 0.0, 0.0]
    a = pairs(spark, T.author_similarity, ("smith john", "john smith"))
    assert a == [1.0]


def test_asins(spark):
    assert values(spark, T.clean_asin, "b0 1234567 8", "1234567890", "B012", None) == ["B012345678", None, None, None]


def test_validate_progress(spark):
    rows = [("audiobook", "42", True, None, None), ("ebook", "-5", None, None, None), ("ebook", "105", None, None, None), ("ebook", "  85  ", None, None, None), ("ebook", "not-a-number", None, None, None), ("ebook", "", None, None, None), ("audiobook", None, None, 1800.0, 3600.0), ("ebook", None, True, None, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, fmt string, progress string, is_finished boolean, position double, total double")
    assert [r["progress_valid"] for r in progress.validate_progress(df).orderBy("i").collect()] == [42.0, 0.0, 100.0, 85.0, None, None, 50.0, 100.0]


def test_positions(spark):
    df = spark.createDataFrame([(0, 50.0, 300.0, "pages"), (1, 0.0, 300.0, "pages"), (2, 0.0, 300.0, "seconds"), (3, 50.0, 0.0, "pages"), (4, 33.3, 1000.0, "seconds")], "i int, p double, total double, unit string")
    at = df.withColumn("at", progress.to_position(F.col("p"), F.col("total"), F.col("unit"))).withColumn("back", progress.from_position(F.col("at"), F.col("total"))).orderBy("i").collect()
    assert [r["at"] for r in at] == [150.0, 1.0, 0.0, 1.0, 333.0] and at[0]["back"] == 50.0 and at[4]["back"] == 33.3


def test_regressions(spark):
    cases = [(60.0, 50.0), (90.0, 20.0), (95.0, 5.0), (None, 50.0), (None, None)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(cases)], "i int, previous double, progress double")
    got = progress.analyze_regression(df).orderBy("i").collect()
    assert [(r["drop"], r["blocked"], r["warned"], r["reason"]) for r in got[:3]] == [(10.0, False, False, "small drop"), (70.0, True, False, "blocked re-read"), (90.0, True, False, "blocked re-read")]
    assert [r["reason"] for r in got[3:]] == ["new", "invalid"]


def test_completion(spark):
    rows = [("audiobook", 98.33, None, 3600.0), ("audiobook", 75.0, None, 3600.0), ("audiobook", 100.0, False, 3600.0), ("ebook", 96.0, None, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, fmt string, progress double, is_finished boolean, total double")
    assert [r["complete"] for r in progress.detect_completion(df).orderBy("i").collect()] == [True, False, False, True]


def test_minimum(spark):
    rows = [(3.07, None), (5.0, None), (3.0, True), (None, None), (6.0, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, progress double, is_finished boolean")
    assert [r["below_minimum"] for r in progress.below_minimum(df).orderBy("i").collect()] == [True, True, False, False, False]


def test_fold_of_records(spark):
    rows = [(1, 1, "a", 10, True), (1, 1, "b", 20, False), (1, 2, "a", 10, False), (1, 2, "b", 5, True), (1, 3, "a", 10, False), (1, 3, "b", 5, False)]
    df = spark.createDataFrame(rows, "user_id int, item_id int, pos string, t int, is_finished boolean").select("*", F.timestamp_seconds("t").alias("last_update"), F.lit(0.5).alias("progress_ratio"), F.lit(None).cast("string").alias("episode_id"))
    assert {r["item_id"]: r["pos"] for r in progress.latest_records(df).collect()} == {1: "b", 2: "b", 3: "a"}


def test_capable_edition_by_length(spark):
    e = spark.createDataFrame([(1, 7, 36000, None, None), (2, 7, 28800, None, None), (3, 7, None, 288, "Read"), (4, 7, None, None, None)], "edition_id long, book_id long, audio_seconds int, pages int, reading_format string").withColumns({"users_count": F.lit(1), "score": F.lit(1)})
    got = select.progress_capable(e, "book_id", F.lit("audiobook"), F.lit(29000)).first()
    assert (got["edition_id"], got["unit"], got["total"]) == (2, "seconds", 28800.0)


def test_work_score_of_a_generic_subtitle(spark):
    df = spark.createDataFrame([(1, "Social Creature: A Novel", "Tara Burton", 9, "Social Creature", "Tara Burton", 100, 2018)], "item_id int, item_title string, item_author string, book_id int, title string, author string, activity long, publication_year int")
    r = link.score_works(df).first()
    assert r["title_score"] == 100.0 and r["score"] >= 70 and r["confidence"] == "high"


def test_scores_are_bounded(spark):
    e = spark.createDataFrame([(i, None if i % 2 else 10**i, None if i % 3 else 5, "Listened" if i % 2 else None, 10**i) for i in range(8)], "edition_id int, audio_seconds long, pages int, reading_format string, users_count long")
    e = e.withColumns({c: F.lit(None).cast("string") for c in ("asin", "isbn_10", "isbn_13", "physical_format")}).withColumn("score", F.lit(-5))
    for profile in (S.DEFAULT, S.TITLE_AUTHOR, S.STRICT):
        got = select.score_editions(e, S.EditionContext(F.lit("audiobook"), F.lit(3600)), profile)
        assert all(0 <= r["edition_score"] <= 100 for r in got.collect())


def test_merge_keeps_and_overwrites(spark):
    old = spark.createDataFrame([(1, 10, 5), (2, 20, 6)], "k int, v int, made int")
    new = spark.createDataFrame([(2, 21, 9), (3, 30, 9)], "k int, v int, made int")
    got = sorted(map(tuple, state.merge(old, new, ("k",), ("v",), keep_old=("made",)).collect()))
    assert got == [(1, 10, 5), (2, 21, 6), (3, 30, 9)]


def test_flatten_and_enrich(spark, tmp_path):
    (tmp_path / "items").mkdir()
    (tmp_path / "items/a.json").write_text(
        '{"id":"1","libraryId":"l","mediaType":"book","media":{"duration":3600,"audioFiles":[{"path":"x"}],"metadata":{"title":"T","subtitle":"S","authors":[{"name":"A"},{"id":"q"}],"isbn":"978-0-575-08201-4","seriesName":"R","sequence":"2.5","publishedYear":"1999 x"}}}\n'
        '{"id":"2","libraryId":"l","title":"Top","author":"B","asin":"b012345678","publishedYear":"99","metadata":{"title":"M"}}\n'
    )
    got = {r["item_id"]: r for r in readers.flatten_items(readers.read_items(spark, str(tmp_path / "items"))).collect()}
    one, two = got["1"], got["2"]
    assert (one["title"], one["author"], one["isbn_raw"], one["series_sequence"], one["publication_year"], one["duration_s"], one["fmt"]) == ("T: S", "A, [Unknown Author]", "9780575082014", 2.5, 1999, 3600.0, "audiobook")
    assert (two["title"], two["author"], two["asin_raw"], two["publication_year"], two["fmt"]) == ("Top", "B", "B012345678", None, "ebook")


def test_search_payloads(spark):
    df = spark.createDataFrame([(1, '{"hits":[{"document":{"id":"a","title":"x"}},{"document":{"id":"b"}}]}'), (2, '[{"id":"c"}]'), (3, "broken {")], "q int, payload string")
    hits, rejected = readers.unpack_search(df)
    assert sorted((r["q"], r["position"], r["id"]) for r in hits.collect()) == [(1, 0, "a"), (1, 1, "b"), (2, 0, "c")]
    assert [r["q"] for r in rejected.collect()] == [3]


def test_library_filter(spark):
    libs = spark.createDataFrame([("1", "Fiction"), ("2", "Talks")], "id string, name string")
    entry = lambda *x: spark.createDataFrame([(e,) for e in x], "entry string")
    kept, unmatched = readers.filter_libraries(libs, include=entry("FICTION", "nope"), exclude=entry("1"))
    assert [r["id"] for r in kept.collect()] == ["1"] and [r["entry"] for r in unmatched.collect()] == ["nope"]
    assert [r["id"] for r in readers.filter_libraries(libs, exclude=entry("2"))[0].collect()] == ["1"]


def test_write_verification(spark):
    plan = spark.createDataFrame([(1, 100.0, 50.0), (2, 100.0, 50.0), (3, 100.0, 50.0)], "action_id int, position double, progress double")
    ack = spark.createDataFrame([(1, 101.0, 50.0), (2, 90.0, 50.0)], "action_id int, position double, progress double")
    assert {r["action_id"]: r["verified"] for r in sinks.verify_writes(plan, ack).collect()} == {1: True, 2: False, 3: False}


def test_delay_decisions(spark):
    now = F.lit("2024-01-01 12:00:00").cast("timestamp")
    rows = [(30.0, 50.0, False), (20.0, 22.0, False), (20.0, 24.0, False), (24.0, 26.0, False), (50.0, 100.0, True)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, stored double, progress double, complete boolean").withColumns({"pending": F.lit(None).cast("double"), "last_external": F.lit(None).cast("timestamp"), "known": F.lit(True)})
    assert [r["why"] for r in sessions.delay_decision(df, now).orderBy("i").collect()] == ["significant", "session_open", "session_open", "significant", "complete"]
    with pytest.raises(ValueError):
        sessions.SessionOptions(timeout=10)


def test_stream_sessions_equal_batch(spark, tmp_path):
    rng = random.Random(1)
    rows = [(u, i, 1_700_000_000 + rng.randrange(20_000), f"{k:03}", float(k)) for k, (u, i) in enumerate((rng.randrange(2), rng.randrange(2)) for _ in range(60))]
    # A late event per key closes the sessions before it.
    rows += [(u, i, 1_700_900_000, "999", 1.0) for u in range(2) for i in range(2)] + [(9, 9, 1_701_800_000, "999", 1.0)]
    df = spark.createDataFrame(rows, "user_id long, item_id long, s long, pos string, progress double").select("user_id", "item_id", F.timestamp_seconds("s").alias("ts"), "pos", "progress")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    live = sessions.stream_sessions(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    live.writeStream.format("memory").queryName("live").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    key = ["user_id", "item_id", "session_start", "session_end", "first_progress", "last_progress", "n_events"]
    batch = [tuple(r) for r in sessions.sessionize(df, 900).where("user_id < 9").select(*key).collect()]
    assert sorted(tuple(r) for r in spark.table("live").select(*key).collect()) == sorted(batch)


def test_stateful_updates(spark, tmp_path):
    at = lambda s: 1_700_000_000 + s
    for k, rows in enumerate([[(1, 1, at(0), 10.0)], [(1, 1, at(60), 11.0)], [(1, 1, at(120), 60.0)], [(2, 2, at(20_000), 1.0)], [(2, 2, at(20_100), 2.0)]]):
        df = spark.createDataFrame(rows, "user_id long, item_id long, s long, progress double").select("user_id", "item_id", F.timestamp_seconds("s").alias("ts"), "progress")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    sessions.delayed_updates(stream).writeStream.format("memory").queryName("updates").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    got = [(r["item_id"], r["progress"], r["why"]) for r in spark.table("updates").collect()]
    assert (1, 10.0, "significant") in got and (1, 60.0, "significant") in got


def canon(df: pd.DataFrame) -> list[tuple]:
    cell = lambda v: None if v is None or v is pd.NaT or v != v else (f"{v:.6f}" if isinstance(v, float) else str(v))
    return sorted((tuple(cell(v) for v in row) for row in df[sorted(df.columns)].astype(object).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = QUERIES[name](spark, SF).toPandas(), con.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    fix = lambda df: df.apply(lambda c: c.astype(float) if c.dtype.kind == "f" else c)
    a, b = fix(got), fix(want)
    for c in a.columns:  # whole numbers that nulls made floats on one side
        if "f" in (a[c].dtype.kind, b[c].dtype.kind):
            a[c], b[c] = a[c].astype(float), b[c].astype(float)
    assert canon(a) == canon(b)


def test_formats(spark):
    df = spark.createDataFrame([("10h 30m",), ("45m",), ("0m",), (None,)], "t string")
    assert [r[0] for r in df.select(P.parse_duration(F.col("t"))).collect()] == [37800, 2700, None, None]


def test_every_work_of_a_block_is_compared(spark):
    """Forty works of one block; an item's own work can be the least active."""
    words = "amber brook cedar delta ember frost grove haven inlet jewel".split()
    works = [(n, f"Silver Tide {words[n % 10]} {words[n // 10]}", "Mara Holt" if n % 3 else "Milo Hart", 1000 - 20 * n) for n in range(40)]
    works += [(100 + n, *works[n][1:3], 5) for n in range(0, 40, 7)] + [(200, None, None, 1)]
    items = [(n, works[n][1].upper() if n % 2 else works[n][1] + " (Unabridged)", works[n][2]) for n in range(40)] + [(50, "Silver Tide", "Mara Holt"), (51, None, "x")]
    w = spark.createDataFrame(works, "book_id long, title string, author string, activity long")
    i = spark.createDataFrame(items, "item_id long, title string, author string")
    every = i.select("item_id", F.col("title").alias("item_title"), F.col("author").alias("item_author")).crossJoin(w.where("title is not null"))
    brute = {}
    for r in link.score_works(every.where("item_title is not null")).select("item_id", "book_id", "score").collect():
        brute.setdefault(r["item_id"], []).append((-round(r["score"], 9), r["book_id"]))
    got = {r["item_id"]: (-round(r["score"], 9), r["book_id"]) for r in link.link_by_title_author(i, w).collect()}
    assert got == {n: min(own) for n, own in brute.items() if min(own)[0] <= -70} and all(got[n][1] == n for n in range(40))
    best = {}
    for r in link.best_matches(link.score_works(link.candidate_pairs(i, w))).collect():
        best.setdefault(r["item_id"], []).append((-round(r["score"], 9), r["book_id"]))
    assert {n: sorted(own) for n, own in best.items() if n != 51} == {n: sorted(own)[:10] for n, own in brute.items()}


@pytest.mark.parametrize("extras", [True, False])
def test_best_works_are_those_of_all_pairs(spark, extras):
    """Many works that differ in activity alone, scores that end at 0, missing parts, repeated items."""
    names = [("Silver Tide", "Mara Holt"), ("Silver Tide Rising", "Milo Hart"), ("Ox", "M H"), ("", "Qi Wu"), ("Silver Tide", None)]
    works = [(n, *names[n % 5], (n * 37) % 90 if n % 4 else None, "Tides" if n % 2 else None, 1 + n % 2, 2000 + n % 3 if n % 7 else None) for n in range(120)]
    items = [(n, names[n % 5][0].upper() + (" (Unabridged)" if n % 2 else ""), names[n % 5][1], "The Tides Series" if n % 3 else None, float(n % 3), 2001 if n % 4 else None) for n in range(30)]
    w = spark.createDataFrame(works, "book_id long, title string, author string, activity long, series_name string, series_sequence int, publication_year int")
    i = spark.createDataFrame([*items, (90, None, "x", None, None, None)], "item_id long, title string, author string, item_series string, item_sequence double, item_year int")
    if not extras:
        i = i.select("item_id", "title", "author")
    want, got = {}, {}
    for r in link.score_works(link.candidate_pairs(i, w)).select("item_id", "book_id", "score").collect():
        want.setdefault(r["item_id"], []).append((-round(r["score"], 6), r["book_id"]))
    for r in link.best_works(i, w, 4).select("item_id", "book_id", "score").collect():
        got.setdefault(r["item_id"], []).append((-round(r["score"], 6), r["book_id"]))
    assert {n: sorted(rows) for n, rows in got.items()} == {n: sorted(rows)[:4] for n, rows in want.items()} and len(got) > 20
    assert link.best_works(i.limit(0), w).count() == 0 and link.best_works(i, w.limit(0)).count() == 0


@pytest.mark.parametrize("percent", [34, 60, 80, 100])
def test_similar_token_sets_are_those_of_all_pairs(spark, percent):
    words = "amber brook cedar delta ember frost grove haven inlet jewel".split()
    texts = [(n, " ".join(words[(n * k) % 10] for k in range(1, 2 + n % 5)) + " common!") for n in range(60)] + [(60, None), (61, ""), (62, "a b"), (63, "Common, common")]
    df = spark.createDataFrame(texts, "id long, text string")
    sets = {n: {w.strip("!,").lower() for w in (t or "").split() if len(w.strip("!,")) > 2} for n, t in texts}
    want = {(a, b): round(len(x & y) / len(x | y), 9) for a, x in sets.items() for b, y in sets.items() if x and y and 100 * len(x & y) >= percent * len(x | y)}
    got = link.similar_token_sets(df, df, percent).collect()
    assert len(got) == len(want) and {(r["left_id"], r["right_id"]): round(r["jaccard"], 9) for r in got} == want
    assert link.similar_token_sets(df.limit(0), df, percent).count() == 0
