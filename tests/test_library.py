"""Libraries, search results, state tables, sinks and streams, on small frames."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions import formats as P
from tidemark.operators import library, link, progress, select, state
from tidemark.plans import report
from tidemark.sources import readers, sinks
from tidemark.streaming import sessions


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_progress_goes_to_the_edition_that_the_user_owns(spark):
    """An audiobook's ASIN is in the catalogue; the user owns another edition of the work."""
    lib = spark.createDataFrame([(1, 7, 70, None), (1, 7, 71, "B0AAAAAAAA"), (1, 8, 80, None), (1, 8, 81, None), (2, 7, 72, None)], "user_id long, book_id long, edition_id long, asin string")
    links = spark.createDataFrame(
        [(1, 1, "asin", "B0AAAAAAAA", 79, 7), (1, 2, "isbn", None, 81, 8), (1, 3, "isbn", None, 89, 8), (1, 4, "asin", "B0CCCCCCCC", 90, 9), (2, 5, "asin", "B0AAAAAAAA", 71, 7), (None, 6, "isbn", None, 70, 7)],
        "user_id long, item_id long, match_type string, asin string, edition_id long, book_id long",
    )
    got = {r["item_id"]: (r["edition_id"], r["tier"]) for r in library.owned_links(links, lib).collect()}
    assert got == {1: (71, "cross_edition"), 2: (81, "library"), 3: (80, "cross_edition"), 4: (90, "search"), 5: (72, "cross_edition"), 6: (70, "search")}


def test_regression_is_rounded_before_the_thresholds(spark):
    df = spark.createDataFrame([(65.1, 50.1), (65.1, 50.2), (90.3, 40.3), (0.3, 0.1), (None, 5.0)], "previous double, progress double").withColumn("first_run", F.lit(False))
    got = [(r["warned"], r["blocked"]) for r in progress.analyze_regression(df).collect()]
    assert got == [(True, False), (False, False), (False, True), (False, False), (False, False)]


def test_token_search_needs_every_word(spark):
    works = spark.createDataFrame([(1, "Red Sea Rising", "Ann Lee", 5), (2, "The Red Sea", "Bo Lee", 9), (3, "Sea", "Ann Lee", 99), (4, None, None, 1), (5, "Red Sea", "Cy Day", 9)], "book_id long, title string, author string, activity long")
    items = spark.createDataFrame([(1, "red sea", "Lee"), (2, "sea", "Ann"), (3, None, None), (4, "Blue", "x")], "item_id long, title string, author string")
    assert rows(library.search_tokens(items, works, 2)) == [(1, 2, 1), (1, 5, 2), (2, 2, 2), (2, 3, 1)]
    assert rows(library.search_tokens(items, works, 5, True)) == [(1, 1, 2), (1, 2, 1), (2, 1, 2), (2, 3, 1)]


def test_author_search_takes_the_name_as_it_is(spark):
    df = spark.createDataFrame([(1, "a", "100% Real"), (2, "b", "100 Real"), (3, "c", "x_y"), (4, "d", None)], "id int, title string, author string")
    assert [r["id"] for r in link.author_search(df, "0% r").collect()] == [1] and [r["id"] for r in link.author_search(df, "X_Y").collect()] == [3]


def test_search_fields(spark):
    cases = [
        ({"contributions": [{"person": {"name": "A"}}, {"author": {"name": "B"}, "contribution": "Narrator"}]}, ("A, B", "audiobook", 0.0, None, None, None, None)),
        ({"author_names": ["C", ""], "format": "Ebook", "popularity": "12", "duration": "1h 30m"}, ("C", "Ebook", 12.0, 5400.0, None, None, None)),
        ({"author": "D", "reading_format": {"format": "Listened"}, "runtime": 60, "series": {"name": "x"}, "series_name": " S ", "book_number": "2.5 of 4"}, ("D", "Listened", 0.0, 60.0, "S", 2.5, None)),
        ({"physical_format": "Hardcover", "book": {"format": "Ebook", "activity": 3, "year": "1999"}, "year": "12"}, (None, "physical", 3.0, None, None, None, 1999)),
        ({"published": "in May 2001", "activity": "many"}, (None, "unknown", 0.0, None, None, None, 2001)),
        ({}, (None, "unknown", 0.0, None, None, None, None)),
    ]
    df = spark.createDataFrame([(i, json.dumps(c)) for i, (c, _) in enumerate(cases)] + [(99, None), (98, "no json")], "i int, payload string")
    got = {r["i"]: tuple(r)[1:] for r in readers.flatten_hits(df).collect()}
    assert [got[i] for i in range(len(cases))] == [w for _, w in cases] and got[99] == got[98] == cases[-1][1]


def test_item_fields_by_level_and_name(spark, tmp_path):
    items = [
        {"id": "1", "isbn": "x", "metadata": {"isbn10": "0-575-08201-1"}, "amazonASIN": "b0 12345678", "series": [{"name": "n"}], "media": {"metadata": {"series": "T", "volume": "3"}, "length": 10.0, "current_time": 5}},
        {"id": "2", "sequence": "x", "metadata": {"sequence": "2"}, "duration": 0, "totalLength": 7.0, "media": {"duration": 9.0}},
    ]
    (tmp_path / "a.json").write_text("\n".join(map(json.dumps, items)))
    got = {r["item_id"]: r for r in readers.flatten_items(readers.read_items(spark, str(tmp_path / "a.json"))).collect()}
    one, two = got["1"], got["2"]
    assert (one["isbn_raw"], one["asin_raw"], one["series_name"], one["series_sequence"], one["duration_s"], one["position"]) == ("0575082011", "B012345678", "T", 3.0, 10.0, 5.0)
    assert (two["series_sequence"], two["duration_s"]) == (None, 7.0)


def test_moments(spark):
    data = ["1700000000000", "2023-11-14T22:13:20Z", "2023-11-14 22:13:20", "", None, "0", "soon", "2023-99-99"]
    df = spark.createDataFrame([(x,) for x in data], "t string")
    shown = [r[0] for r in df.select(P.localize_timestamp(F.col("t"), "Asia/Tokyo")).collect()]
    assert shown == ["2023-11-15 07:13:20"] * 3 + ["N/A"] * 3 + ["Invalid"] * 2
    days = [str(r[0]) for r in df.select(P.localize_date(F.col("t"), "Asia/Tokyo")).collect()]
    assert days[:3] == ["2023-11-15", "2023-11-15", "2023-11-14"] and days[4] == "None" and days[6:] == ["None", "None"]


def test_key_patterns(spark):
    items = spark.createDataFrame([(1, 1, "The  Sea", "Ann O'Lee"), (1, 2, None, None)], "user_id long, item_id long, title string, author string")
    known = spark.createDataFrame([(1, "title_author", "the  sea", f"k{i}") for i in range(7)] + [(2, "title_author", "the  sea", "z")], "user_id long, identifier_type string, title string, identifier string")
    got = {r["item_id"]: r["patterns"] for r in library.key_patterns(items, known).collect()}
    assert got[1] == ["title_author:the_sea|ann_o'lee", "The  Sea:Ann O'Lee", "thesea:annolee", "k0", "k1", "k2", "k3", "k4"] and got[2] == ["title_author:|", ":"]


def test_skips_and_statistics(spark):
    old = spark.createDataFrame([(1, "a", "isbn", "t", "x", 1), (1, "b", "isbn", "t", "x", 1)], "user_id long, identifier string, identifier_type string, title string, reason string, created_at int")
    new = spark.createDataFrame([(1, "a", "isbn", "t", "y", 2), (1, "c", "isbn", "t", "y", 2)], old.schema)
    assert [(r["identifier"], r["reason"], r["created_at"]) for r in library.store_skips(old, new).orderBy("identifier").collect()] == [("a", "y", 1), ("b", "x", 1), ("c", "y", 2)]
    assert [r["identifier"] for r in library.clear_skips(old, new).collect()] == ["b"]
    users = spark.createDataFrame([(1,), (2,)], "user_id long")
    stored = spark.createDataFrame([(1, 5, 4, 3, 2, 1)], "user_id long, " + ", ".join(f"{c} long" for c in library.STATISTICS))
    assert rows(library.load_statistics(stored, users)) == [(1, 5, 4, 3, 2, 1), (2, 0, 0, 0, 0, 0)]


def test_state_keys_and_titles(spark):
    items = spark.createDataFrame([(1, 1, "b012345678", "978-0-575-08201-4", " T x ", "A")], "user_id long, item_id long, asin_raw string, isbn_raw string, title string, author string")
    assert [(r["identifier"], r["prio"]) for r in state.state_keys(items).orderBy("prio").collect()] == [("B012345678", 0), ("9780575082014", 1), ("0575082011", 2), ("title_author:t_x|a", 3)]
    assert items.select(P.state_title(F.col("title"))).first()[0] == "t x"


def test_several_keys_of_one_item(spark):
    """A later key can hold the state, and the first key that is unchanged decides."""
    keys = spark.createDataFrame([(1, 1, "a", "isbn", 0), (1, 1, "b", "isbn", 1), (1, 2, "c", "isbn", 0), (1, 2, "d", "asin", 1), (1, 3, "e", "isbn", 0)], "user_id long, item_id long, identifier string, identifier_type string, prio int")
    held = spark.createDataFrame([(1, "b", "isbn", 50.0, 7), (1, "c", "isbn", 10.0, 8), (1, "d", "asin", 50.0, None), (1, "e", "isbn", 10.0, 9)], "user_id long, identifier string, identifier_type string, progress_percent double, edition_id long")
    now = spark.createDataFrame([(1, i, 50.0) for i in (1, 2, 3)], "user_id long, item_id long, progress_now double")
    assert rows(state.early_check(keys, held, now)) == [(1, 1, "skip", None), (1, 2, "repair", 8), (1, 3, "sync", 9)]


def test_distinct_editions_and_casts(spark):
    a, b = (spark.createDataFrame(x, "edition_id int, src string") for x in ([(1, "a"), (2, "a")], [(2, "b"), (3, "b")]))
    assert rows(select.distinct_editions(a, b)) == [(1, "a"), (2, "a"), (3, "b")] and rows(select.distinct_editions(a, b, "last")) == [(1, "a"), (2, "b"), (3, "b")]
    df = spark.createDataFrame([(" 12x", "YES", "1.5"), ("x", "0", "y"), (None, None, None)], "a string, b string, c string")
    assert [tuple(r) for r in readers.cast_columns(df, {"a": "int", "b": "boolean", "c": "double"}).collect()] == [(12, True, 1.5), (None, False, None), (None, None, None)]


def test_scoring_failures(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("c",)], "message string")
    assert tuple(report.scoring_failures(df).first()) == (4, 3, ["a", "b"])
    assert tuple(report.scoring_failures(df.limit(0)).first()) == (0, 0, [])


def test_state_versions(spark, tmp_path):
    """A version may be derived from the one before, and an unfinished one isn't seen."""
    path = str(tmp_path / "state")
    assert sinks.write_state(spark.range(3), path) == 1
    assert sinks.write_state(sinks.read_state(spark, path).unionByName(spark.range(3, 5)), path) == 2
    (tmp_path / "state/version=3").mkdir()
    assert sinks.read_state(spark, path).count() == 5 and sinks.write_state(spark.range(1), path) == 3 and sinks.read_state(spark, path).count() == 1


def test_reports_and_exports(spark, tmp_path):
    failed = spark.createDataFrame([("not_found", "1", "isbn"), ("odd", "2", "asin"), ("odd", "3", None)], "category string, item_id string, identifier string")
    assert rows(sinks.failure_report(failed, str(tmp_path / "f"))) == [("not_found", 1), ("odd", 2)]
    assert spark.read.json(str(tmp_path / "f")).where("suggestion like '%ISBN%'").count() == 1
    held = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-01-03"), (3, None)], "id int, updated_at string")
    assert sinks.export_json(held, str(tmp_path / "e")).first()["n"] == 3
    assert spark.read.json(str(tmp_path / "e")).count() == 3
    actions = spark.createDataFrame([("error", 1), ("synced", 2)], "status string, id int")
    sinks.write_actions(actions, str(tmp_path / "a"))
    sinks.write_actions(actions, str(tmp_path / "a"))
    sinks.dump_errors(actions, str(tmp_path / "d"))
    assert spark.read.parquet(str(tmp_path / "a")).count() == 4 and [r["id"] for r in spark.read.json(str(tmp_path / "d")).collect()] == [1]


def test_user_books_and_sessions_from_files(spark, tmp_path):
    book = {"id": 5, "user_id": 1, "status_id": 2, "book": {"id": 7, "title": "T", "contributions": [{"author": {"name": "A"}}, {"person": {"name": "N"}, "contribution": "Narrator"}], "editions": [{"id": 70, "reading_format": {"format": "Ebook"}}, {"id": 71}]}}
    (tmp_path / "b.json").write_text(json.dumps(book))
    owned, editions = readers.flatten_user_books(readers.read_user_books(spark, str(tmp_path / "b.json")))
    assert owned.first()["book_id"] == 7 and rows(editions.select("edition_id", "narrator")) == [(70, "N"), (71, "N")]
    (tmp_path / "s").mkdir()
    for page in range(2):
        (tmp_path / f"s/{page}.json").write_text(json.dumps({"id": str(page), "libraryItemId": "i", "userId": "u", "updatedAt": 1_700_000_000_000 + page}))
    found = readers.read_sessions(spark, str(tmp_path / "s"))
    items = spark.createDataFrame([("i", None), ("j", None)], "item_id string, last_listened_at timestamp")
    assert found.count() == 2 and readers.latest_sessions(items, found).where("last_listened_at is not null").count() == 1


def test_known_progress_is_not_looked_up_again(spark):
    items = spark.createDataFrame([(1,), (2,), (3,)], "item_id int")
    looked, known = (spark.createDataFrame(x, "item_id int, progress_percent double") for x in ([(1, 5.0), (2, 6.0)], [(1, 50.0)]))
    assert rows(readers.item_details(items, looked, known)) == [(1, 50.0), (2, 6.0), (3, None)]


def test_session_lists(spark):
    df = spark.createDataFrame([(1, 1, 5.0, True), (1, 2, None, False), (2, 3, None, False)], "user_id int, item_id int, pending double, active boolean").withColumn("last_change", F.lit(0))
    assert rows(sessions.active_sessions(df)) == [(1, 1, 5.0, 0)] and rows(sessions.has_active(df)) == [(1, True), (2, False)]


@pytest.mark.parametrize("fail, max_delay", [(False, 7200), (True, 3600)])
def test_stream_keeps_its_baseline_and_counts(spark, tmp_path, fail, max_delay):
    """After a session has expired, a small update is still small; after the maximum delay it goes out."""
    at = lambda s: 1_700_000_000 + s
    batches = [
        [(1, 1, at(0), 10.0)], [(1, 1, at(60), 11.0)], [(9, 9, at(9_000), 1.0)], [(9, 9, at(9_100), 1.5)],
        [(1, 1, at(9_200), 12.0)], [(1, 1, at(9_300), 14.0)], [(9, 9, at(30_000), 2.0)], [(9, 9, at(30_100), 2.5)],
    ]
    for k, batch in enumerate(batches):
        df = spark.createDataFrame(batch, "user_id long, item_id long, s long, progress double").select("user_id", "item_id", F.timestamp_seconds("s").alias("ts"), "progress")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    counts, out = str(tmp_path / "counts"), str(tmp_path / "out")
    deliver = sessions.deliver_expired(lambda rows: rows.withColumn("sent", F.lit(not fail)), counts)

    def both(batch, number):
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
        deliver(batch, number)

    query = sessions.delayed_updates(stream, sessions.SessionOptions(max_delay=max_delay)).writeStream.foreachBatch(both).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = [(r["progress"], r["why"]) for r in spark.read.parquet(out).where("item_id = 1").collect()]
    # The session of 11.0 expired when the clock stood at 5400 s, 3800 s before 12.0 came.
    late = [(12.0, "max_delay")] if max_delay == 3600 else []
    assert sorted(got) == sorted([(10.0, "significant"), (11.0, "expired"), *late, (14.0, "expired")])
    told = spark.read.parquet(counts).where("user_id = 1").agg(F.sum("found"), F.sum("processed"), F.sum("errors")).first()
    assert tuple(told) == (2, 0 if fail else 2, 2 if fail else 0)


def test_sessions_stay_open_until_acknowledged(spark, tmp_path):
    """A delivery that fails twice is offered three times, also by a query that starts again from its
    checkpoint; then the session is closed, and what arrived is the baseline."""
    at = lambda s: 1_700_000_000 + s
    schema = "user_id long, item_id long, ts timestamp, progress double"
    put = lambda folder, rows: spark.createDataFrame(rows, "user_id long, item_id long, s long, progress double").select(
        "user_id", "item_id", F.timestamp_seconds("s").alias("ts"), "progress").coalesce(1).write.mode("append").parquet(str(tmp_path / folder))
    put("acks", [(0, 0, at(0), 0.0)])
    offers = []

    def deliver(rows):
        got = [tuple(r) for r in rows.select("item_id", "progress", "why").collect()]
        offers.extend(x for x in got if x[0] == 1)
        fails = sum(why == "expired" for _, _, why in offers) <= 2
        return rows.withColumn("sent", (F.col("why") != "expired") | F.lit(not fails))

    def run():
        read = lambda folder: spark.readStream.schema(schema).parquet(str(tmp_path / folder))
        out = sessions.acknowledged_updates(read("in"), read("acks"))
        out.writeStream.foreachBatch(sessions.deliver_acknowledged(deliver, str(tmp_path / "acks"))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()

    for rows in ([(1, 1, at(0), 10.0)], [(1, 1, at(60), 11.0)], *[[(9, 9, at(6_000 + 1_500 * k), 1.0)] for k in range(8)]):
        put("in", rows)
        run()
    assert offers == [(1, 10.0, "significant")] + [(1, 11.0, "expired")] * 3
    put("in", [(1, 1, at(16_600), 12.0)])
    run()
    assert (1, 12.0, "significant") not in offers
