"""A library given as its works and editions has the rows of the one that lists them all."""

from tidemark.operators import library


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_a_library_in_two_tables(spark):
    works = spark.createDataFrame([(1, 7), (1, 8), (2, 7), (2, 9), (None, 7)], "user_id long, book_id long")
    editions = spark.createDataFrame([(7, 70, None), (7, 71, "b0AAAAAAAA"), (8, 70, None), (10, 90, "B0CCCCCCCC")], "book_id long, edition_id long, asin string")
    listed, lib = works.join(editions, "book_id").select("user_id", "book_id", "edition_id", "asin"), library.Library(works, editions)
    links = spark.createDataFrame(
        [(1, 1, "asin", "B0AAAAAAAA", 79, 7), (1, 2, "isbn", None, 70, 8), (1, 3, "isbn", None, 70, 10), (2, 4, "isbn", None, 91, 9), (2, 5, "asin", "B0AAAAAAAA", 70, 7), (None, 6, "isbn", None, 70, 7)],
        "user_id long, item_id long, match_type string, asin string, edition_id long, book_id long",
    )
    got = rows(library.owned_links(links, lib))
    assert got == rows(library.owned_links(links, listed)) and [r[4:] for r in got[:3]] == [(71, "cross_edition"), (70, "library"), (70, "search")]
    asked = spark.createDataFrame([(1, " 70"), (1, "70"), (2, "71"), (2, "90"), (2, None), (1, "8")], "user_id long, edition_id string")
    for by in ("edition_id", "book_id"):
        a = asked.withColumnRenamed("edition_id", by)
        columns = ["user_id", "book_id", "edition_id", "asin"]
        got = rows(library.find_owned(a, lib, by).select(*columns))
        assert got == rows(library.find_owned(a, listed, by).select(*columns)) and got
