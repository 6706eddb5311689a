"""Queries of the linkage and reconciliation operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixtures import view, with_views
from ..functions import formats as P
from ..functions import scores as S
from ..functions import text as T
from ..operators import library, link, progress, select, state
from ..streaming import sessions
from . import decide, report
from . import oracles as O

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: The moment at which state is judged, so that results repeat.
NOW = "timestamp '2024-01-20 00:00:00'"


def query(name: str, sql: str | None = None, *views: str, more: str = ""):
    """Registers a function of (spark, sf_dir) under name, with its oracle over the given views."""

    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = with_views(sql, *views, more=more)
        return f

    return register


def r6(c):
    return F.floor(F.lit(0.5) + c * 1e6) / 1e6


# Identifiers and links

KEYS = """k AS (
  SELECT edition_id, book_id, coalesce(audio_seconds > 0 OR pages > 0, false) AS has_length, unnest([
    {'kind': 'isbn', 'key': core || CASE WHEN c10 = 10 THEN 'X' ELSE c10::VARCHAR END}, {'kind': 'isbn', 'key': '978' || core || c13::VARCHAR},
    {'kind': 'asin', 'key': asin}], recursive := true) FROM fx_editions)"""


@query(
    "w1_identifier_index",
    "SELECT kind, key, edition_id, book_id FROM (SELECT *, row_number() OVER (PARTITION BY kind, key ORDER BY has_length DESC, book_id, edition_id) AS r FROM k WHERE key IS NOT NULL) WHERE r = 1",
    "fx_editions", more=KEYS,
)
def w1(spark, d):
    return link.identifier_index(view(spark, d, "fx_editions"))


@query(
    "w2_last_edition_index",
    "SELECT kind, key, edition_id, book_id FROM (SELECT *, row_number() OVER (PARTITION BY kind, key ORDER BY book_id DESC, edition_id DESC) AS r FROM k WHERE key IS NOT NULL) WHERE r = 1",
    "fx_editions", more=KEYS,
)
def w2(spark, d):
    return link.identifier_index(view(spark, d, "fx_editions"), prefer_length=False)


INDEX = KEYS + """,
ix AS (SELECT kind, key, edition_id, book_id FROM (SELECT *, row_number() OVER (PARTITION BY kind, key ORDER BY has_length DESC, book_id, edition_id) AS r FROM k WHERE key IS NOT NULL) WHERE r = 1),
ik AS (
  SELECT item_id, 'asin' AS kind, upper(asin_raw) AS key, 0 AS prio FROM fx_items WHERE asin_raw IS NOT NULL
  UNION ALL SELECT item_id, 'isbn', replace(isbn_raw, '-', ''), 1 FROM fx_items WHERE isbn_raw IS NOT NULL
  UNION ALL SELECT i.item_id, 'isbn', e.core || CASE WHEN e.c10 = 10 THEN 'X' ELSE e.c10::VARCHAR END, 2 FROM fx_items i JOIN fx_editions e ON replace(i.isbn_raw, '-', '') = '978' || e.core || e.c13::VARCHAR),
links AS (SELECT item_id, kind AS match_type, edition_id, book_id FROM (
  SELECT ik.item_id, ik.kind, ix.edition_id, ix.book_id, row_number() OVER (PARTITION BY ik.item_id ORDER BY prio) AS r FROM ik JOIN ix ON ik.kind = ix.kind AND ik.key = ix.key) WHERE r = 1)"""


@query("j1_j2_identifier_links", "SELECT * FROM links", "fx_editions", "fx_items", more=INDEX)
def j1(spark, d):
    return link.link_by_identifier(view(spark, d, "fx_items"), link.identifier_index(view(spark, d, "fx_editions")))


TIERS = INDEX + """,
ob AS (SELECT DISTINCT book_id FROM fx_user_books WHERE status_id = 3),
tiers AS (SELECT l.*, CASE WHEN ob.book_id IS NOT NULL AND l.edition_id % 2 = 0 THEN 'library' WHEN ob.book_id IS NOT NULL THEN 'cross_edition' ELSE 'search' END AS tier FROM links l LEFT JOIN ob ON ob.book_id = l.book_id)"""


def _tiers(spark, d):
    books = view(spark, d, "fx_user_books").where("status_id = 3").select("book_id").distinct()
    owned = view(spark, d, "fx_editions").where("edition_id % 2 = 0").join(books, "book_id", "left_semi")
    return link.library_tiers(j1(spark, d), owned, books)


@query("j3_j5_library_tiers", "SELECT * FROM tiers", "fx_editions", "fx_items", "fx_user_books", more=TIERS)
def j3(spark, d):
    """Finished works are owned, in their even editions."""
    return _tiers(spark, d)


@query("j6_match_counts", "SELECT match_type, tier, count(*) AS n FROM tiers GROUP BY match_type, tier", "fx_editions", "fx_items", "fx_user_books", more=TIERS)
def j6(spark, d):
    return _tiers(spark, d).groupBy("match_type", "tier").agg(F.count("*").alias("n"))


@query("j6_waterfall", "SELECT item_id, match_type, edition_id, book_id FROM links UNION ALL SELECT item_id, 'none', NULL, NULL FROM fx_items WHERE item_id NOT IN (SELECT item_id FROM links)", "fx_editions", "fx_items", more=INDEX)
def j6w(spark, d):
    none = view(spark, d, "fx_items").select("item_id", F.lit("none").alias("match_type"), F.lit(None).cast("long").alias("edition_id"), F.lit(None).cast("long").alias("book_id"))
    return link.waterfall(j1(spark, d), none)


@query(
    "n5_isbn_variants",
    "SELECT edition_id, CASE WHEN isbn_10 IS NOT NULL THEN isbn_10 || ',978' || core || c13::VARCHAR ELSE isbn_13 || ',' || core || CASE WHEN c10 = 10 THEN 'X' ELSE c10::VARCHAR END END AS variants FROM fx_editions",
    "fx_editions",
)
def n5(spark, d):
    return view(spark, d, "fx_editions").select("edition_id", F.array_join(T.isbn_variants(F.coalesce("isbn_10", "isbn_13")), ",").alias("variants"))


@query("n6_asins", "SELECT item_id, upper(asin_raw) AS asin FROM fx_items WHERE asin_raw IS NOT NULL", "fx_editions", "fx_items")
def n6(spark, d):
    return view(spark, d, "fx_items").select("item_id", T.clean_asin(F.col("asin_raw")).alias("asin")).where("asin is not null")


# Standard forms and similarities


@query("n1_standard_titles", f"SELECT item_id, {O.standard('title', T.TITLE_STEPS, True)} AS title_std FROM fx_items", "fx_editions", "fx_items")
def n1(spark, d):
    return view(spark, d, "fx_items").select("item_id", T.standard_title(F.col("title")).alias("title_std"))


@query("n2_standard_authors", f"SELECT item_id, {O.standard('author', T.AUTHOR_STEPS, False)} AS author_std FROM fx_items", "fx_editions", "fx_items")
def n2(spark, d):
    return view(spark, d, "fx_items").select("item_id", T.standard_author(F.col("author")).alias("author_std"))


@query("n3_standard_series", f"SELECT book_id, {O.standard('series_name || chr(32) || title', T.SERIES_STEPS, True)} AS series_std FROM fx_works", "fx_works")
def n3(spark, d):
    return view(spark, d, "fx_works").select("book_id", T.standard_series(F.concat_ws(" ", "series_name", "title")).alias("series_std"))


PAIRS = """p AS (SELECT i.item_id, w.book_id, lower(i.title) AS a, lower(w.title) AS b FROM fx_items i JOIN fx_works w ON w.book_id BETWEEN i.item_id AND i.item_id + 3)"""


def _pairs(spark, d):
    """Every item with its own work and the three that follow: near and far titles."""
    i = view(spark, d, "fx_items").select("item_id", F.lower("title").alias("a"), F.explode(F.sequence(F.col("item_id"), F.col("item_id") + 3)).alias("book_id"))
    return i.join(view(spark, d, "fx_works").select("book_id", F.lower("title").alias("b")), "book_id").select("item_id", "book_id", "a", "b")


@query("c1_edit_similarity", f"SELECT item_id, book_id, {O.r6(O.levenshtein('a', 'b'))} AS sim FROM p", "fx_editions", "fx_items", "fx_works", more=PAIRS)
def c1(spark, d):
    return _pairs(spark, d).select("item_id", "book_id", r6(T.levenshtein_similarity(F.col("a"), F.col("b"))).alias("sim"))


@query("c2_jaro", f"SELECT item_id, book_id, {O.r6(O.jaro('a', 'b'))} AS sim FROM p", "fx_editions", "fx_items", "fx_works", more=PAIRS)
def c2(spark, d):
    return _pairs(spark, d).select("item_id", "book_id", r6(T.jaro(F.col("a"), F.col("b"))).alias("sim"))


WINKLER = "CASE WHEN j < 0.7 THEN j ELSE j + 0.1 * (CASE WHEN substr(a, 1, 4) = substr(b, 1, 4) AND least(length(a), length(b)) >= 4 THEN 4 WHEN substr(a, 1, 3) = substr(b, 1, 3) AND least(length(a), length(b)) >= 3 THEN 3 WHEN substr(a, 1, 2) = substr(b, 1, 2) THEN 2 WHEN substr(a, 1, 1) = substr(b, 1, 1) THEN 1 ELSE 0 END) * (1 - j) END"


@query("c3_jaro_winkler", f"SELECT item_id, book_id, {O.r6(WINKLER)} AS sim FROM (SELECT *, {O.jaro('a', 'b')} AS j FROM p)", "fx_editions", "fx_items", "fx_works", more=PAIRS)
def c3(spark, d):
    return _pairs(spark, d).select("item_id", "book_id", r6(T.jaro_winkler(F.col("a"), F.col("b"))).alias("sim"))


TOKENS = "list_distinct(list_filter(string_split_regex(regexp_replace({0}, '[^A-Za-z0-9_\\s]', '', 'g'), '\\s+'), lambda t: length(t) > 2))"
JACCARD = "(CASE WHEN len(list_distinct({0} || {1})) = 0 THEN 0.0 ELSE len(list_intersect({0}, {1})) / len(list_distinct({0} || {1}))::double END)".format(TOKENS.format("a"), TOKENS.format("b"))


@query("c4_token_jaccard", f"SELECT item_id, book_id, {O.r6(JACCARD)} AS sim FROM p", "fx_editions", "fx_items", "fx_works", more=PAIRS)
def c4(spark, d):
    return _pairs(spark, d).select("item_id", "book_id", r6(T.token_jaccard(F.col("a"), F.col("b"))).alias("sim"))


BLENDED = f"(CASE WHEN a = b THEN 1.0 ELSE 0.4 * {O.levenshtein('a', 'b')} + 0.6 * ({WINKLER}) END)"


@query("c5_blended", f"SELECT item_id, book_id, {O.r6(BLENDED)} AS sim FROM (SELECT *, {O.jaro('a', 'b')} AS j FROM p)", "fx_editions", "fx_items", "fx_works", more=PAIRS)
def c5(spark, d):
    return _pairs(spark, d).select("item_id", "book_id", r6(T.blended(F.col("a"), F.col("b"))).alias("sim"))


@query("c9_general", f"SELECT item_id, book_id, {O.r6(f'CASE WHEN a = b THEN 1.0 ELSE 0.7 * {BLENDED} + 0.3 * {JACCARD} END')} AS sim FROM (SELECT *, {O.jaro('a', 'b')} AS j FROM p)", "fx_editions", "fx_items", "fx_works", more=PAIRS)
def c9(spark, d):
    return _pairs(spark, d).select("item_id", "book_id", r6(T.general_similarity(F.col("a"), F.col("b"))).alias("sim"))


# Scores and selection

CONTEXT = "e AS (SELECT x.*, CASE WHEN book_id % 2 = 0 THEN 'audiobook' ELSE 'ebook' END AS source_format, 3600 + (book_id * 41) % 36000 AS source_duration FROM fx_editions x)"


def _scored(spark, d, profile, two_stage=False, mapper=None):
    e = view(spark, d, "fx_editions").withColumns({"source_format": F.when(F.col("book_id") % 2 == 0, "audiobook").otherwise("ebook"), "source_duration": 3600 + (F.col("book_id") * 41) % 36000})
    return select.score_editions(e, S.EditionContext(F.col("source_format"), F.col("source_duration"), format_mapper=mapper), profile, two_stage)


FF = O.format_factor("reading_format", "source_format")
DEFAULT_SQL = O.clamp(f"0.4 * {FF} + 0.25 * {O.LENGTH} + 0.15 * {O.POPULARITY} + 0.1 * {O.COMPLETE} + 0.1 * {O.DATA}")
NARRATOR = "(CASE WHEN source_format <> 'audiobook' THEN 60.0 ELSE 50.0 END)"
BONUS = "(CASE WHEN {0} >= 95 THEN 3 ELSE 0 END) + (CASE WHEN users_count >= 1000 THEN least(2.0, log10(users_count / 1000)) ELSE 0 END)"
TITLE_SQL = O.clamp(f"0.4 * {FF} + 0.2 * {O.POPULARITY} + 0.17 * {O.duration_factor('source_duration', 'source_format')} + 0.13 * {O.COMPLETE} + 0.07 * {O.DATA} + 0.03 * {NARRATOR} + {BONUS.format(FF)}")
F2 = O.format_factor("reading_format", "source_format", "physical|paperback|hardcover")
DUR2 = f"(case when source_format <> 'audiobook' then 60.0 when not coalesce(audio_seconds > 0, false) then 30.0 else {O.duration_similarity('source_duration', 'audio_seconds')} end)"
TWO_SQL = O.clamp(f"0.4 * {F2} + 0.23 * {O.POPULARITY} + 0.19 * {DUR2} + 0.15 * {O.COMPLETE} + 0.03 * {NARRATOR} + {BONUS.format(F2)}")


@query("m5_edition_scores", f"SELECT edition_id, {O.r6(DEFAULT_SQL)} AS s FROM e", "fx_editions", more=CONTEXT)
def m5(spark, d):
    return _scored(spark, d, S.DEFAULT).select("edition_id", r6(F.col("edition_score")).alias("s"))


@query("m5_title_author_scores", f"SELECT edition_id, {O.r6(TITLE_SQL)} AS s FROM e", "fx_editions", more=CONTEXT)
def m5t(spark, d):
    return _scored(spark, d, S.TITLE_AUTHOR).select("edition_id", r6(F.col("edition_score")).alias("s"))


@query("m6_two_stage_scores", f"SELECT edition_id, {O.r6(TWO_SQL)} AS s FROM e", "fx_editions", more=CONTEXT)
def m6(spark, d):
    return _scored(spark, d, S.TWO_STAGE, True).select("edition_id", r6(F.col("edition_score")).alias("s"))


@query(
    "m7_m13_factors",
    f"SELECT edition_id, {FF} AS f_format, {O.LENGTH} AS f_length, {O.r6(O.POPULARITY)} AS f_popularity, {O.duration_factor('source_duration', 'source_format')} AS f_duration, {O.COMPLETE} AS f_completeness, {O.r6(O.DATA)} AS f_data FROM e",
    "fx_editions", more=CONTEXT,
)
def m7(spark, d):
    e = view(spark, d, "fx_editions").withColumns({"source_format": F.when(F.col("book_id") % 2 == 0, "audiobook").otherwise("ebook"), "source_duration": 3600 + (F.col("book_id") * 41) % 36000})
    f = S.edition_factors(S.EditionContext(F.col("source_format"), F.col("source_duration")), S.Profile({k: 1.0 for k in ("format", "length", "popularity", "duration", "completeness", "data")}))
    return e.select("edition_id", *[(r6(v) if k in ("popularity", "data") else v).alias(f"f_{k}") for k, v in f.items()])


RANKED = f"s AS (SELECT *, {DEFAULT_SQL} AS es FROM e), r AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY floor(es * 100 + 0.5) DESC, score DESC, users_count DESC, edition_id) AS rn FROM s)"


@query("w6_best_edition", f"SELECT book_id, max(CASE WHEN rn = 1 THEN edition_id END) AS edition_id, {O.r6('max(CASE WHEN rn = 1 THEN es END)')} AS edition_score, max(CASE WHEN rn = 2 THEN edition_id END) AS second_id, max(CASE WHEN rn = 3 THEN edition_id END) AS third_id FROM r GROUP BY book_id", "fx_editions", more=CONTEXT + ", " + RANKED)
def w6(spark, d):
    return select.best_editions(_scored(spark, d, S.DEFAULT), "book_id", S.DEFAULT).withColumn("edition_score", r6(F.col("edition_score")))


@query(
    "w10_strict_upgrades",
    f"SELECT book_id, edition_id, {O.r6('improvement')} AS improvement FROM (SELECT book_id, max(CASE WHEN rn = 1 THEN edition_id END) AS edition_id, max(CASE WHEN rn = 1 THEN es END) - coalesce(max(CASE WHEN edition_id = first_id THEN es END), 0) AS improvement FROM (SELECT *, min(edition_id) OVER (PARTITION BY book_id) AS first_id FROM r) GROUP BY book_id) WHERE improvement >= 5",
    "fx_editions", more=CONTEXT + ", " + RANKED,
)
def w10(spark, d):
    """Upgrades of the first edition of every work that gain five points or more."""
    scored = _scored(spark, d, S.STRICT)
    first = scored.groupBy("book_id").agg(F.min("edition_id").alias("first_id"))
    return select.best_editions(scored.join(first, "book_id"), "book_id", S.STRICT, current="first_id").select("book_id", "edition_id", r6(F.col("improvement")).alias("improvement"))


@query("w11_compare_editions", f"SELECT book_id, {O.r6('b - a')} AS improvement, b - a >= 5 AS should_upgrade FROM (SELECT book_id, max(CASE WHEN edition_id = lo THEN es END) AS a, max(CASE WHEN edition_id = hi THEN es END) AS b FROM (SELECT *, min(edition_id) OVER (PARTITION BY book_id) AS lo, max(edition_id) OVER (PARTITION BY book_id) AS hi FROM s) GROUP BY book_id)", "fx_editions", more=CONTEXT + ", " + RANKED)
def w11(spark, d):
    scored = _scored(spark, d, S.STRICT)
    end = lambda f: scored.groupBy("book_id").agg(f("edition_score", "edition_id").alias("edition_score"))
    return select.compare_editions(end(F.min_by), end(F.max_by), "book_id", S.STRICT).withColumn("improvement", r6(F.col("improvement")))


BASIS = f"(CASE WHEN {O.FORMAT} = 'audiobook' AND audio_seconds > 0 THEN 'seconds' WHEN pages > 0 THEN 'pages' WHEN audio_seconds > 0 THEN 'seconds' END)"


@query(
    "w8_progress_capable_edition",
    f"SELECT book_id, edition_id, unit, total FROM (SELECT *, CASE unit WHEN 'seconds' THEN audio_seconds ELSE pages END::double AS total, row_number() OVER (PARTITION BY book_id ORDER BY CASE WHEN {O.FORMAT} = source_format THEN 0 WHEN {O.FORMAT} = 'mixed' THEN 1 ELSE 2 END, CASE WHEN audio_seconds > 0 THEN abs(audio_seconds - source_duration) ELSE 1e18 END, users_count DESC, edition_id) AS rn FROM (SELECT *, {BASIS} AS unit FROM e) WHERE unit IS NOT NULL) WHERE rn = 1",
    "fx_editions", more=CONTEXT,
)
def w8(spark, d):
    e = view(spark, d, "fx_editions")
    wanted = F.when(F.col("book_id") % 2 == 0, "audiobook").otherwise("ebook")
    return select.progress_capable(e, "book_id", wanted, 3600 + (F.col("book_id") * 41) % 36000)


@query(
    "p17_p19_formats",
    f"SELECT edition_id, {O.FORMAT} AS internal, CASE WHEN audio_seconds > 0 THEN 'audiobook' ELSE coalesce(CASE reading_format WHEN 'Listened' THEN 'audiobook' WHEN 'Ebook' THEN 'ebook' WHEN 'Read' THEN 'physical' WHEN 'Both' THEN 'mixed' END, CASE WHEN pages > 0 THEN 'physical' ELSE 'unknown' END) END AS of_progress, {BASIS} AS unit FROM fx_editions",
    "fx_editions",
)
def p17(spark, d):
    c = F.col
    internal = P.internal_format(c("reading_format"), c("audio_seconds"))
    return view(spark, d, "fx_editions").select("edition_id", internal.alias("internal"), P.progress_format(c("reading_format"), c("audio_seconds"), c("pages")).alias("of_progress"), P.progress_basis(internal, c("audio_seconds"), c("pages"))["unit"].alias("unit"))


@query("f7_format_compatibility", f"SELECT book_id, bool_or(NOT (source_format = 'audiobook' AND {O.FORMAT} = 'book')) AS fits FROM e GROUP BY book_id", "fx_editions", more=CONTEXT)
def f7(spark, d):
    e = view(spark, d, "fx_editions")
    fits = decide.compatible(F.when(F.col("book_id") % 2 == 0, "audiobook").otherwise("ebook"), P.internal_format(F.col("reading_format"), F.col("audio_seconds")))
    return e.groupBy("book_id").agg(F.bool_or(fits).alias("fits"))


# Progress

PCT = O.percent("progress")
VALID = f"(CASE WHEN coalesce(is_finished, false) THEN coalesce({PCT}, 100.0) WHEN fmt = 'audiobook' AND total > 0 AND position >= 0 THEN least(100.0, {O.r6('position / total::double * 100')}) ELSE {PCT} END)"
LEFT = f"(total - {O.position(PCT, 'total', 'fmt')})"
DONE = f"(CASE WHEN is_finished IS NOT NULL THEN is_finished WHEN total > 0 AND progress IS NOT NULL THEN CASE WHEN fmt = 'audiobook' THEN {LEFT} <= 120 ELSE {LEFT} <= 3 END ELSE coalesce({PCT} >= 95, false) END)"
# least and greatest skip nulls in SQL, so a null progress is put back.
VALID, DONE, LEFT = (x.replace(PCT, f"(CASE WHEN progress IS NOT NULL THEN {PCT} END)") for x in (VALID, DONE, LEFT))
PCT = f"(CASE WHEN progress IS NOT NULL THEN {PCT} END)"
OLD = f"(CASE WHEN previous IS NOT NULL THEN {O.percent('previous')} END)"
DROP = f"greatest(0.0, {O.r6(f'{OLD} - {PCT}')})"
BOTH = "(progress IS NOT NULL AND previous IS NOT NULL)"


@query("g1_validate_progress", f"SELECT pos, {O.r6(VALID)} AS progress_valid FROM fx_history", "fx_history")
def g1(spark, d):
    return progress.validate_progress(view(spark, d, "fx_history")).select("pos", r6(F.col("progress_valid")).alias("progress_valid"))


@query("g2_discrepancies", f"SELECT pos, {O.r6(PCT)} AS given, placed FROM (SELECT *, least(100.0, {O.r6('position / total::double * 100')}) AS placed FROM fx_history WHERE total > 0 AND progress IS NOT NULL) WHERE abs({PCT} - placed) > 1", "fx_history")
def g2(spark, d):
    return progress.discrepancies(view(spark, d, "fx_history")).select("pos", r6(F.col("given")).alias("given"), "placed")


@query("g3_g4_positions", f"SELECT pos, CASE WHEN total > 0 THEN least(100.0, {O.r6('position / total::double * 100')}) ELSE 0.0 END AS from_position, {O.position(PCT, 'total', 'fmt')} AS to_position FROM fx_history", "fx_history")
def g3(spark, d):
    c = F.col
    unit = F.when(c("fmt") == "audiobook", "seconds").otherwise("pages")
    return view(spark, d, "fx_history").select("pos", progress.from_position(c("position"), c("total")).alias("from_position"), progress.to_position(progress.percent(c("progress")), c("total"), unit).alias("to_position"))


@query("g5_completion", f"SELECT pos, {DONE} AS complete FROM fx_history", "fx_history")
def g5(spark, d):
    return progress.detect_completion(view(spark, d, "fx_history")).select("pos", "complete")


@query(
    "g6_change",
    f"SELECT pos, CASE WHEN {BOTH} THEN {O.r6(f'abs({PCT} - {OLD})')} END AS delta, CASE WHEN progress IS NULL THEN false WHEN previous IS NULL THEN true ELSE {O.r6(f'abs({PCT} - {OLD})')} >= 0.1 END AS changed, CASE WHEN progress IS NULL THEN 'invalid' WHEN previous IS NULL THEN 'new' WHEN {PCT} > {OLD} THEN 'forward' WHEN {PCT} < {OLD} THEN 'backward' ELSE 'same' END AS direction FROM fx_history",
    "fx_history",
)
def g6(spark, d):
    return progress.detect_change(view(spark, d, "fx_history")).select("pos", "delta", "changed", "direction")


REGRESSION = f"""g AS (SELECT *, CASE WHEN {BOTH} THEN {DROP} END AS drop_, {BOTH} AND {DROP} >= 50 AS blocked, {BOTH} AND {OLD} >= 85 AND {PCT} <= 30 AS reread FROM fx_history)"""


@query(
    "g7_analyze_regression",
    f"SELECT pos, {O.r6('drop_')} AS drop_size, coalesce(drop_ > 0, false) AS regression, blocked, reread, coalesce({BOTH} AND NOT blocked AND (reread OR drop_ >= 15), false) AS warned, "
    "CASE WHEN progress IS NULL THEN 'invalid' WHEN previous IS NULL THEN 'new' WHEN blocked AND reread THEN 'blocked re-read' WHEN blocked THEN 'blocked' WHEN reread THEN 're-read' WHEN drop_ >= 15 THEN 'large drop' WHEN drop_ > 0 THEN 'small drop' ELSE 'none' END AS reason FROM g",
    "fx_history", more=REGRESSION,
)
def g7(spark, d):
    out = progress.analyze_regression(view(spark, d, "fx_history"))
    flags = [F.coalesce(c, F.lit(False)).alias(c) for c in ("regression", "blocked", "reread", "warned")]
    return out.select("pos", r6(F.col("drop")).alias("drop_size"), *flags, "reason")


@query("g8_regression_gate", "SELECT pos, CASE WHEN blocked AND NOT (pos % 7 = 0 AND previous IS NULL) THEN 'skip' ELSE 'pass' END AS gate FROM g", "fx_history", more=REGRESSION)
def g8(spark, d):
    return progress.regression_gate(view(spark, d, "fx_history").withColumn("first_run", F.col("pos") % 7 == 0)).select("pos", "gate")


@query("g9_summary", f"SELECT pos, {O.r6(VALID)} AS progress_valid, {DONE} AS complete, coalesce({VALID}, 0) = 0 AS zero, {O.position(VALID, 'total', 'fmt')} AS place FROM fx_history", "fx_history")
def g9(spark, d):
    return progress.summarize(view(spark, d, "fx_history")).select("pos", r6(F.col("progress_valid")).alias("progress_valid"), "complete", "zero", "place")


READS = "q AS (SELECT *, pos % 4 AS kind, CASE WHEN pos % 2 = 0 THEN 200 END AS rt, 20 + pos % 180 AS rp FROM fx_history), q2 AS (SELECT *, CASE WHEN kind = 0 THEN NULL ELSE pos END AS read_id, coalesce(CASE WHEN rt > 0 THEN rp / rt::double * 100 END, CASE WHEN position / rp::double > 3 THEN least(95.0, 25 * (position / rp::double)) END) AS old FROM q)"


@query("g11_read_sessions", f"SELECT pos, {O.r6('old')} AS before, CASE WHEN read_id IS NULL OR kind = 1 THEN 'new' WHEN old >= 85 AND {PCT} <= 30 THEN 'new' WHEN old - {PCT} >= 10 THEN 'regression' ELSE 'update' END AS session FROM q2", "fx_history", more=READS)
def g11(spark, d):
    h = view(spark, d, "fx_history").withColumns({"read_id": F.when(F.col("pos") % 4 != 0, F.col("pos")), "finished_at": F.when(F.col("pos") % 4 == 1, F.col("last_update")), "read_total": F.when(F.col("pos") % 2 == 0, 200), "read_position": 20 + F.col("pos") % 180})
    return progress.plan_read_sessions(h).select("pos", r6(F.col("before")).alias("before"), "session")


@query("g12_status_changes", f"SELECT pos, CASE WHEN {DONE} THEN 3 WHEN pos % 5 IN (0, 1) THEN 2 ELSE pos % 5 END::int AS next_status FROM fx_history", "fx_history")
def g12(spark, d):
    h = view(spark, d, "fx_history").withColumn("status_id", F.when(F.col("pos") % 5 != 0, (F.col("pos") % 5).cast("int")))
    return progress.plan_status(progress.detect_completion(h)).select("pos", F.col("next_status").cast("int").alias("next_status"))


@query("f4_minimum_progress", f"SELECT pos, coalesce({PCT} <= 5, false) AND NOT coalesce(is_finished, false) AS below_minimum FROM fx_history", "fx_history")
def f4(spark, d):
    return progress.below_minimum(view(spark, d, "fx_history")).select("pos", "below_minimum")


@query("p21_progress_ratio", "SELECT pos, least(1.0, greatest(0.0, progress_ratio)) AS ratio FROM fx_progress WHERE episode_id IS NULL", "fx_progress")
def p21(spark, d):
    rows = view(spark, d, "fx_progress").where("episode_id is null")
    return rows.select("pos", P.progress_ratio(F.lit("audiobook"), F.col("progress_ratio"), F.lit(None).cast("double")).alias("ratio"))


@query(
    "w3_latest_record",
    """SELECT user_id, item_id, r.pos AS pos, r.progress_ratio AS progress_ratio, r.fin AS is_finished FROM (
      SELECT user_id, item_id, list_reduce(list({'pos': pos, 'at': last_update, 'progress_ratio': progress_ratio, 'fin': coalesce(is_finished, false)} ORDER BY pos),
        lambda h, x: CASE WHEN (x.fin AND NOT h.fin) OR coalesce(x.at, TIMESTAMP '1970-01-01') >= coalesce(h.at, TIMESTAMP '1970-01-01') THEN x ELSE h END) AS r
      FROM fx_progress WHERE episode_id IS NULL GROUP BY user_id, item_id)""",
    "fx_progress",
)
def w3(spark, d):
    return progress.latest_records(view(spark, d, "fx_progress")).select("user_id", "item_id", "pos", "progress_ratio", "is_finished")


@query("w4_newest_first", "SELECT pos, user_id, rank FROM (SELECT pos, user_id, row_number() OVER (PARTITION BY user_id ORDER BY last_update DESC, pos)::int AS rank FROM fx_progress) WHERE rank <= 10", "fx_progress")
def w4(spark, d):
    return progress.newest_first(view(spark, d, "fx_progress"), 10).select("pos", "user_id", "rank")


@query("n9_durations", "SELECT edition_id, printf('%02d:%02d:%02d', audio_seconds // 3600, audio_seconds % 3600 // 60, audio_seconds % 60) AS clock, (audio_seconds // 3600)::varchar || 'h ' || (audio_seconds % 3600 // 60)::varchar || 'm' AS short, audio_seconds - audio_seconds % 60 AS parsed FROM fx_editions WHERE audio_seconds IS NOT NULL", "fx_editions")
def n9(spark, d):
    e = view(spark, d, "fx_editions").where("audio_seconds is not null")
    short = P.hours_minutes(F.col("audio_seconds"))
    return e.select("edition_id", P.clock(F.col("audio_seconds")).alias("clock"), short.alias("short"), P.parse_duration(short).alias("parsed"))


# State


@query("k2_progress_upsert", "SELECT coalesce(c.user_id, k.user_id) AS user_id, coalesce(c.identifier, k.identifier) AS identifier, coalesce(c.title, k.title) AS title, CASE WHEN c.user_id IS NOT NULL THEN c.progress_percent ELSE k.progress_percent END AS progress_percent, CASE WHEN c.user_id IS NOT NULL THEN c.status_id ELSE k.status_id END::bigint AS status_id, CASE WHEN k.user_id IS NOT NULL THEN k.edition_id ELSE c.edition_id END AS edition_id FROM fx_known k FULL JOIN fx_current c ON c.user_id = k.user_id AND c.identifier = k.identifier AND c.title = k.title", "fx_known", "fx_current")
def k2(spark, d):
    cols = ["user_id", "identifier", "title", "progress_percent", "status_id", "edition_id"]
    out = state.merge(view(spark, d, "fx_known").select(*cols), view(spark, d, "fx_current").select(*cols), state.KEY, ("progress_percent", "status_id"), keep_old=("edition_id",))
    return out.withColumn("status_id", F.col("status_id").cast("long"))


@query("k7_deletes", "SELECT k.user_id, k.item_id FROM fx_known k WHERE NOT EXISTS (SELECT 1 FROM fx_current c WHERE c.user_id = k.user_id AND c.identifier = k.identifier AND c.title = k.title AND c.progress_percent > 50)", "fx_known", "fx_current")
def k7(spark, d):
    return state.delete(view(spark, d, "fx_known"), view(spark, d, "fx_current").where("progress_percent > 50"), state.KEY).select("user_id", "item_id")


@query("k8_run_counters", "SELECT user_id, sum(n)::bigint AS runs FROM (SELECT user_id, count(*) AS n FROM fx_known GROUP BY user_id UNION ALL SELECT user_id, count(*) FROM fx_current GROUP BY user_id) GROUP BY user_id", "fx_known", "fx_current")
def k8(spark, d):
    old = view(spark, d, "fx_known").groupBy("user_id").agg(F.count("*").alias("runs"))
    return state.count_runs(old, view(spark, d, "fx_current"))


@query("f10_expectations", "SELECT user_id, item_id, CASE WHEN progress_percent < 0 OR progress_percent > 100 THEN 'progress' ELSE '' END AS violations FROM fx_current", "fx_current")
def f10(spark, d):
    return state.expectations(view(spark, d, "fx_current")).select("user_id", "item_id", F.array_join("violations", ",").alias("violations"))


SYNC = "j AS (SELECT c.*, k.user_id AS there, k.progress_percent AS kp, k.status_id AS ks, k.edition_id AS ke FROM fx_current c LEFT JOIN fx_known k ON c.user_id = k.user_id AND c.item_id = k.item_id)"
WHY = "array_to_string(list_filter([CASE WHEN there IS NULL THEN 'new' END, CASE WHEN abs(progress_percent - kp) >= 0.01 THEN 'progress' END, CASE WHEN ks = 1 THEN 'status' END, CASE WHEN there IS NOT NULL AND edition_id IS DISTINCT FROM ke THEN 'edition' END], lambda x: x IS NOT NULL), ',')"


@query("j14_needs_sync", f"SELECT user_id, item_id, reason <> '' AS needs_sync, reason FROM (SELECT *, {WHY} AS reason FROM j)", "fx_known", "fx_current", more=SYNC)
def j14(spark, d):
    return state.needs_sync(view(spark, d, "fx_current"), view(spark, d, "fx_known"), ["user_id", "item_id"]).select("user_id", "item_id", "needs_sync", "reason")


@query(
    "j11_early_check",
    "SELECT c.user_id, c.item_id, CASE WHEN abs(c.progress_percent - k.progress_percent) < 0.01 THEN CASE WHEN k.edition_id IS NOT NULL THEN 'skip' ELSE 'repair' END ELSE 'sync' END AS verdict, CASE WHEN abs(c.progress_percent - k.progress_percent) < 0.01 THEN NULL ELSE k.edition_id END AS edition_id FROM fx_current c JOIN fx_known k ON c.user_id = k.user_id AND c.item_id = k.item_id",
    "fx_known", "fx_current",
)
def j11(spark, d):
    current = view(spark, d, "fx_current")
    keys = current.select("user_id", "item_id", "identifier", "identifier_type", F.lit(0).alias("prio"))
    return state.early_check(keys, view(spark, d, "fx_known").drop("item_id"), current.withColumnRenamed("progress_percent", "progress_now"))


@query(
    "j13_fresh_decisions",
    f"SELECT c.user_id, c.identifier, c.identifier_type, c.title, 'r' || (k.item_id % 3)::varchar AS reason FROM fx_current c JOIN fx_known k ON c.user_id = k.user_id AND c.identifier = k.identifier AND c.identifier_type = k.identifier_type AND c.title = k.title WHERE k.updated_at + INTERVAL 7 DAY > {NOW} AND abs(c.progress_percent - k.progress_percent) < 0.01 AND c.updated_at = k.updated_at",
    "fx_known", "fx_current",
)
def j13(spark, d):
    stamp = F.col("updated_at").cast("timestamp")
    items = view(spark, d, "fx_current").withColumns({"context_hash": F.lit("c"), "last_listened_at": stamp})
    skips = view(spark, d, "fx_known").withColumns({"context_hash": F.lit("c"), "last_listened_at": stamp, "expires_at": stamp + F.expr("interval 7 days"), "reason": F.concat(F.lit("r"), (F.col("item_id") % 3).cast("string"))}).drop("item_id")
    return state.fresh_decisions(items, skips, F.expr(NOW))


@query("j15_stale_mappings", "SELECT user_id, item_id, edition_id FROM fx_known WHERE edition_id IS NOT NULL AND edition_id NOT IN (SELECT edition_id FROM fx_editions)", "fx_known", "fx_editions")
def j15(spark, d):
    return state.stale_mappings(view(spark, d, "fx_known"), view(spark, d, "fx_editions")).select("user_id", "item_id", "edition_id")


@query("j16_repair_state", "SELECT k.user_id, k.item_id, CASE WHEN k.edition_id IS NULL THEN 'no_edition' WHEN e.edition_id IS NULL THEN 'unknown_edition' WHEN NOT (coalesce(e.audio_seconds > 0, false) OR coalesce(e.pages > 0, false)) THEN 'no_length' END AS repair FROM fx_known k LEFT JOIN fx_editions e ON e.edition_id = k.edition_id", "fx_known", "fx_editions")
def j16(spark, d):
    return state.repair_state(view(spark, d, "fx_known"), view(spark, d, "fx_editions")).select("user_id", "item_id", "repair")


@query(
    "w13_priorities",
    "SELECT user_id, item_id, class::int AS class, row_number() OVER (PARTITION BY user_id ORDER BY class, updated_at DESC, item_id)::int AS rank FROM (SELECT *, CASE WHEN there IS NULL THEN 3 WHEN abs(progress_percent - kp) < 0.01 THEN 1 WHEN item_id % 2 = 0 THEN 0 ELSE 2 END AS class FROM j)",
    "fx_known", "fx_current", more=SYNC,
)
def w13(spark, d):
    k = view(spark, d, "fx_known").select("user_id", "item_id", F.col("progress_percent").alias("kp"), F.lit(True).alias("there"))
    j = view(spark, d, "fx_current").join(k, ["user_id", "item_id"], "left")
    items = j.select("user_id", "item_id", F.coalesce("there", F.lit(False)).alias("known"), (F.abs(F.col("progress_percent") - F.col("kp")) >= 0.01).alias("changed"), (F.col("item_id") % 2 == 0).alias("owned"), F.col("updated_at").alias("last_update"))
    return state.priorities(items).select("user_id", "item_id", "class", "rank")


# Decisions, reports and sessions


def _decided(spark, d):
    h = view(spark, d, "fx_history")
    return decide.decide(
        h.withColumns(
            {
                "remembered_skip": F.when(F.col("pos") % 13 == 0, "remembered"), "unchanged": F.col("pos") % 17 == 0, "match_tier": F.when(F.col("pos") % 19 == 0, F.lit(None)).when(F.col("pos") % 4 == 0, "search").otherwise("library"),
                "capable": F.col("total").isNotNull(), "needs_sync": F.col("pos") % 3 != 1, "first_run": F.col("pos") % 7 == 0, "status_id": (F.col("pos") % 3 + 1).cast("int"), "book_id": F.col("item_id"), "edition_id": F.col("item_id") * 1000,
            }
        )
    )


DECIDED = REGRESSION + f""",
d AS (SELECT *, CASE
  WHEN coalesce({PCT} <= 5, false) AND NOT coalesce(is_finished, false) THEN 'skipped:below_threshold' WHEN pos % 13 = 0 THEN 'skipped:remembered' WHEN pos % 17 = 0 THEN 'skipped:unchanged'
  WHEN pos % 19 = 0 THEN 'skipped:not_found' WHEN {VALID} IS NULL THEN 'skipped:invalid_progress' WHEN pos % 4 = 0 AND total IS NULL THEN 'skipped:no_length' WHEN pos % 4 = 0 THEN 'auto_added:added'
  WHEN pos % 3 = 1 THEN 'skipped:up_to_date' WHEN blocked AND NOT (pos % 7 = 0 AND previous IS NULL) THEN 'skipped:regression' WHEN {DONE} AND pos % 3 = 2 THEN 'completed:remembered' WHEN {DONE} THEN 'completed:finished' ELSE 'synced:progress' END AS v FROM g),
s AS (SELECT *, split_part(v, ':', 1) AS status, split_part(v, ':', 2) AS reason FROM d)"""


@query("g13_decisions", "SELECT pos, status, reason FROM s", "fx_history", more=DECIDED)
def g13(spark, d):
    return _decided(spark, d).select("pos", "status", "reason")


@query(
    "k13_k15_planned_writes",
    f"SELECT pos, action, place FROM (SELECT pos, {O.position(VALID, 'total', 'fmt')} AS place, unnest(list_filter([CASE WHEN status = 'auto_added' THEN 'add' END, CASE WHEN status IN ('synced', 'completed') AND pos % 3 = 0 THEN 'set_status' END, CASE WHEN status = 'synced' AND previous IS NULL THEN 'insert_read' WHEN status = 'synced' THEN 'update_read' END, CASE WHEN status = 'completed' AND reason <> 'remembered' THEN 'complete' END], lambda x: x IS NOT NULL)) AS action FROM s)",
    "fx_history", more=DECIDED,
)
def k13(spark, d):
    return decide.planned_writes(_decided(spark, d).withColumn("user_id", F.col("pos"))).select(F.col("user_id").alias("pos"), "action", F.col("position_to").alias("place"))


@query("a2_run_counters", "SELECT user_id, count(*) AS processed, " + ", ".join(f"count(*) FILTER (status = '{x}') AS {x}" for x in ("synced", "completed", "auto_added", "skipped", "delayed", "error")) + ", coalesce(array_to_string(list_sort(list(DISTINCT reason) FILTER (status = 'error')), ','), '') AS errors FROM s GROUP BY user_id", "fx_history", more=DECIDED)
def a2(spark, d):
    return report.run_counters(_decided(spark, d)).withColumn("errors", F.array_join("errors", ","))


@query("a9_run_summary", "SELECT user_id, count(*) FILTER (status IN ('synced', 'completed', 'auto_added')) AS successful, count(*) FILTER (status = 'error') AS failures FROM s GROUP BY user_id", "fx_history", more=DECIDED)
def a9(spark, d):
    return report.run_summary(report.run_counters(_decided(spark, d))).select("user_id", "successful", "failures")


@query("a3_breakdown", "SELECT 'status' AS kind, status AS name, count(*) AS n FROM s GROUP BY status UNION ALL SELECT 'reason', reason, count(*) FROM s GROUP BY reason", "fx_history", more=DECIDED)
def a3(spark, d):
    return report.breakdown(_decided(spark, d))


@query("a5_failure_categories", "SELECT reason AS category, count(*) AS n FROM s WHERE status = 'skipped' GROUP BY reason", "fx_history", more=DECIDED)
def a5(spark, d):
    return report.failure_categories(_decided(spark, d).where("status = 'skipped'").select(F.col("reason").alias("category")))


@query("a1_library_statistics", "SELECT user_id, count(*) AS total, count(*) FILTER (any_) AS with_progress, count(*) FILTER (any_ AND NOT done) AS in_progress, count(*) FILTER (done) AS completed, greatest(0, count(*) - count(*) FILTER (any_)) AS never_started, count(*) FILTER (done OR coalesce(progress > 5, false)) AS passing FROM (SELECT *, coalesce(is_finished, false) AS done, coalesce(progress > 0, false) OR coalesce(is_finished, false) AS any_ FROM fx_history) GROUP BY user_id", "fx_history")
def a1(spark, d):
    return report.library_statistics(view(spark, d, "fx_history").withColumnRenamed("progress", "progress_percent"))


@query("a4_state_statistics", f"SELECT count(*) AS rows, count(*) FILTER (updated_at > {NOW} - INTERVAL 7 DAY) AS recent FROM fx_known", "fx_known")
def a4(spark, d):
    return report.state_statistics(view(spark, d, "fx_known"), F.expr(NOW))


@query("a10_progress_changes", f"SELECT pos, {O.r6('progress - previous')} AS delta, date_diff('day', last_update::date, DATE '2024-01-20')::int AS days FROM fx_history WHERE previous IS NOT NULL AND progress <> previous", "fx_history")
def a10(spark, d):
    out = report.progress_changes(view(spark, d, "fx_history").withColumnRenamed("last_update", "updated_at"), F.lit("2024-01-20").cast("date"))
    return out.select("pos", r6(F.col("delta")).alias("delta"), "days")


SESSION_STATE = f"ss AS (SELECT user_id, item_id, progress_percent AS stored, CASE WHEN item_id % 3 = 0 THEN progress_percent + 2 END AS pending, updated_at AS last_change, item_id % 2 = 0 AS active, CASE WHEN item_id % 5 <> 0 THEN updated_at END AS last_external FROM fx_known)"


def _session_state(spark, d):
    stamp = F.col("updated_at").cast("timestamp")
    k = view(spark, d, "fx_known")
    return k.select("user_id", "item_id", F.col("progress_percent").alias("stored"), F.when(F.col("item_id") % 3 == 0, F.col("progress_percent") + 2).alias("pending"), stamp.alias("last_change"), (F.col("item_id") % 2 == 0).alias("active"), F.when(F.col("item_id") % 5 != 0, stamp).alias("last_external"))


BASE = "coalesce(nullif(pending, 0.0), stored, 0.0)"
CROSSED = "(" + " OR ".join(f"({BASE} < {m} AND np >= {m})" for m in sessions.MILESTONES) + ")"


@query(
    "t5_t7_delay_decision",
    f"SELECT user_id, item_id, why, CASE WHEN why = 'session_open' THEN 'delay' ELSE 'now' END AS decision FROM (SELECT *, CASE WHEN np >= 100 THEN 'complete' WHEN coalesce(epoch(TIMESTAMP '2024-01-15 12:00:00') - floor(epoch(last_external)) >= 3600, false) THEN 'max_delay' WHEN stored IS NULL OR abs(np - {BASE}) >= 5 OR {CROSSED} THEN 'significant' ELSE 'session_open' END AS why FROM (SELECT ss.*, stored + item_id % 7 AS np FROM ss))",
    "fx_known", more=SESSION_STATE,
)
def t5(spark, d):
    s = _session_state(spark, d).withColumn("progress", F.col("stored") + F.col("item_id") % 7)
    s = s.withColumns({"complete": F.col("progress") >= 100, "known": F.col("stored").isNotNull()})
    return sessions.delay_decision(s, F.expr("timestamp '2024-01-15 12:00:00'")).select("user_id", "item_id", "why", "decision")


@query("t2_expired_sessions", "SELECT user_id, item_id FROM ss WHERE active AND floor(epoch(last_change)) < epoch(TIMESTAMP '2024-01-15 12:00:00') - 900", "fx_known", more=SESSION_STATE)
def t2(spark, d):
    return sessions.expired_sessions(_session_state(spark, d), F.expr("timestamp '2024-01-15 12:00:00'")).select("user_id", "item_id")


@query("t9_flush_counts", "SELECT user_id, count(*) AS found, count(*) FILTER (floor(epoch(last_change)) < epoch(TIMESTAMP '2024-01-15 12:00:00') - 900) AS processed FROM ss WHERE active GROUP BY user_id", "fx_known", more=SESSION_STATE)
def t9(spark, d):
    return sessions.flush_expired(_session_state(spark, d), F.expr("timestamp '2024-01-15 12:00:00'"))[1]


@query("t9_flushed_state", "SELECT user_id, item_id, CASE WHEN gone THEN coalesce(pending, stored) ELSE stored END AS stored, CASE WHEN NOT gone THEN pending END AS pending, active AND NOT gone AS active FROM (SELECT *, active AND floor(epoch(last_change)) < epoch(TIMESTAMP '2024-01-15 12:00:00') - 900 AS gone FROM ss)", "fx_known", more=SESSION_STATE)
def t9s(spark, d):
    return sessions.flush_expired(_session_state(spark, d), F.expr("timestamp '2024-01-15 12:00:00'"))[0].select("user_id", "item_id", "stored", "pending", "active")


@query("t1_session_updates", "SELECT s.user_id, s.item_id, coalesce(c.progress_percent, s.pending) AS pending, c.user_id IS NOT NULL OR s.active AS active FROM ss s LEFT JOIN fx_current c ON c.user_id = s.user_id AND c.item_id = s.item_id AND c.progress_percent > 60", "fx_known", "fx_current", more=SESSION_STATE)
def t1(spark, d):
    updates = view(spark, d, "fx_current").where("progress_percent > 60").withColumnRenamed("progress_percent", "progress")
    return sessions.update_sessions(_session_state(spark, d), updates, F.expr(NOW)).select("user_id", "item_id", "pending", "active")


@query(
    "t11_sessionize",
    "SELECT user_id, item_id, epoch_us(min(last_update)) AS session_start, epoch_us(max(last_update)) AS session_end, min_by(progress_ratio, (last_update, pos)) AS first_progress, max_by(progress_ratio, (last_update, pos)) AS last_progress, count(*) AS n_events FROM (SELECT *, sum(new) OVER (PARTITION BY user_id, item_id ORDER BY last_update, pos) AS s FROM (SELECT *, CASE WHEN epoch_us(last_update) - lag(epoch_us(last_update)) OVER (PARTITION BY user_id, item_id ORDER BY last_update, pos) <= 86400000000 THEN 0 ELSE 1 END AS new FROM fx_progress)) GROUP BY user_id, item_id, s",
    "fx_progress",
)
def t11(spark, d):
    """A day without events ends a session."""
    e = view(spark, d, "fx_progress").select("user_id", "item_id", F.col("last_update").alias("ts"), "pos", F.col("progress_ratio").alias("progress"))
    return sessions.sessionize(e, 86400).withColumns({"session_start": F.unix_micros("session_start"), "session_end": F.unix_micros("session_end")})


# Searches, additions, further state

STD = f"iw AS (SELECT item_id, {O.standard('title', T.TITLE_STEPS, True)} AS t, string_split({O.standard('author', T.AUTHOR_STEPS, False)}, ' ') AS a FROM fx_items), ww AS (SELECT book_id, activity, {O.standard('title', T.TITLE_STEPS, True)} AS t, string_split({O.standard('author', T.AUTHOR_STEPS, False)}, ' ') AS a FROM fx_works)"
SEARCH = STD + """,
hit AS (SELECT item_id, book_id, row_number() OVER (PARTITION BY item_id ORDER BY activity DESC, book_id)::int AS rank FROM iw JOIN ww ON iw.t = ww.t AND list_has_any(iw.a, ww.a)),
both_ AS (SELECT *, 'title_author' AS strategy FROM hit WHERE rank <= 5),
alone AS (SELECT item_id, book_id, row_number() OVER (PARTITION BY item_id ORDER BY activity DESC, book_id)::int AS rank FROM iw JOIN ww ON iw.t = ww.t WHERE item_id NOT IN (SELECT item_id FROM both_))"""


@query("s7_s9_work_search", "SELECT item_id, book_id, rank, strategy FROM both_ UNION ALL SELECT item_id, book_id, rank, 'title' FROM alone WHERE rank <= 5", "fx_editions", "fx_items", "fx_works", more=SEARCH)
def s7(spark, d):
    return link.search_works(view(spark, d, "fx_items"), view(spark, d, "fx_works"))


@query("s10_candidates_with_editions", "SELECT b.item_id, b.book_id, e.edition_id, e.edition_id IS NOT NULL AS enhanced FROM both_ b LEFT JOIN fx_editions e ON e.book_id = b.book_id AND e.pages IS NOT NULL WHERE b.rank = 1", "fx_editions", "fx_items", "fx_works", more=SEARCH)
def s10(spark, d):
    hits = link.search_works(view(spark, d, "fx_items"), view(spark, d, "fx_works")).where("rank = 1 and strategy = 'title_author'")
    return library.candidates_with_editions(hits, view(spark, d, "fx_editions").where("pages is not null"))


@query("j21_hits_to_matches", "SELECT b.item_id, b.book_id, CASE WHEN o.book_id IS NOT NULL AND f.e IS NOT NULL THEN f.e ELSE b.book_id END AS edition_id, CASE WHEN o.book_id IS NOT NULL AND f.e IS NOT NULL THEN 'title_author_different_edition' ELSE 'title_author_auto_add' END AS match_type FROM both_ b LEFT JOIN (SELECT DISTINCT book_id FROM fx_user_books WHERE status_id = 3) o ON o.book_id = b.book_id LEFT JOIN (SELECT book_id, min(edition_id) AS e FROM fx_editions GROUP BY book_id) f ON f.book_id = b.book_id WHERE rank = 1", "fx_editions", "fx_items", "fx_works", "fx_user_books", more=SEARCH)
def j21(spark, d):
    hits = link.search_works(view(spark, d, "fx_items"), view(spark, d, "fx_works")).where("rank = 1 and strategy = 'title_author'").select("item_id", "book_id")
    return link.hits_to_matches(hits, view(spark, d, "fx_editions"), view(spark, d, "fx_user_books").where("status_id = 3"))


@query("j10_remembered", "SELECT i.item_id, l.edition_id, CASE WHEN e.edition_id IS NOT NULL THEN 'remembered' ELSE 'auto_add' END AS match_type, 85.0::double AS score FROM fx_items i JOIN (SELECT item_id, item_id * 1000 + item_id % 9 AS edition_id FROM fx_items) l ON l.item_id = i.item_id LEFT JOIN fx_editions e ON e.edition_id = l.edition_id", "fx_editions", "fx_items")
def j10(spark, d):
    items = view(spark, d, "fx_items").select("item_id")
    return link.resolve_remembered(items, items.withColumn("edition_id", F.col("item_id") * 1000 + F.col("item_id") % 9), view(spark, d, "fx_editions"))


@query("s13_latest_read", "SELECT user_book_id, edition_id, id, audio_seconds, pages FROM (SELECT user_id * 1000 + item_id AS user_book_id, pos AS id, item_id * 1000 + pos % 9 AS edition_id, row_number() OVER (PARTITION BY user_id * 1000 + item_id ORDER BY pos DESC) AS r FROM fx_history) h LEFT JOIN (SELECT edition_id, audio_seconds, pages FROM fx_editions) e USING (edition_id) WHERE r = 1", "fx_history", "fx_editions")
def s13(spark, d):
    c = F.col
    reads = view(spark, d, "fx_history").select((c("user_id") * 1000 + c("item_id")).alias("user_book_id"), c("pos").alias("id"), (c("item_id") * 1000 + c("pos") % 9).alias("edition_id"), F.lit(None).cast("int").alias("progress_pages"), c("position").alias("progress_seconds"), F.lit(None).cast("timestamp").alias("finished_at"))
    return link.latest_reads(reads, view(spark, d, "fx_editions")).select("user_book_id", "edition_id", "id", "audio_seconds", "pages")


@query("w12_preferred_edition", "SELECT book_id, edition_id FROM r WHERE rn = 1", "fx_editions", more=CONTEXT + ", " + RANKED)
def w12(spark, d):
    return select.preferred_editions(_scored(spark, d, S.DEFAULT), view(spark, d, "fx_editions"))


@query(
    "w9_addition_editions",
    f"SELECT m.book_id AS item_id, m.book_id, CASE WHEN m.ok THEN m.edition_id ELSE w.edition_id END AS edition_id FROM (SELECT book_id, min(edition_id) AS edition_id, bool_or(edition_id = lo AND unit IS NOT NULL) AS ok FROM (SELECT *, {BASIS} AS unit, min(edition_id) OVER (PARTITION BY book_id) AS lo FROM e) GROUP BY book_id) m LEFT JOIN (SELECT book_id, edition_id FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY CASE WHEN {O.FORMAT} = 'audiobook' THEN 0 WHEN {O.FORMAT} = 'mixed' THEN 1 ELSE 2 END, CASE WHEN audio_seconds > 0 THEN abs(audio_seconds - 20000) ELSE 1e18 END, users_count DESC, edition_id) AS rn FROM (SELECT *, {BASIS} AS unit FROM e) WHERE unit IS NOT NULL) WHERE rn = 1) w ON w.book_id = m.book_id",
    "fx_editions", more=CONTEXT,
)
def w9(spark, d):
    """Every work's first edition as the match."""
    e = view(spark, d, "fx_editions")
    matches = e.groupBy("book_id").agg(F.min("edition_id").alias("edition_id")).withColumn("item_id", F.col("book_id"))
    return select.resolve_additions(matches, e, F.lit("audiobook"), F.lit(20000))


@query("w14_remembered_or_matched", "SELECT k.item_id, k.item_id AS book_id, coalesce(e.edition_id, k.item_id * 1000) AS edition_id, e.edition_id IS NOT NULL AND NOT (coalesce(e.audio_seconds > 0, false) OR coalesce(e.pages > 0, false)) AS defer FROM fx_known k LEFT JOIN fx_editions e ON e.edition_id = k.edition_id", "fx_known", "fx_editions")
def w14(spark, d):
    k = view(spark, d, "fx_known").select("item_id", F.col("item_id").alias("book_id"), (F.col("item_id") * 1000).alias("edition_id"), F.col("edition_id").alias("remembered_id"))
    return select.remembered_or_matched(k, view(spark, d, "fx_editions"))


@query("k1_mapping_upsert", "SELECT coalesce(c.user_id, k.user_id) AS user_id, coalesce(c.identifier, k.identifier) AS identifier, coalesce(lower(c.title), k.title) AS title, CASE WHEN c.user_id IS NOT NULL THEN c.edition_id ELSE k.edition_id END AS edition_id, k.progress_percent FROM fx_known k FULL JOIN fx_current c ON c.user_id = k.user_id AND c.identifier = k.identifier AND lower(c.title) = k.title", "fx_known", "fx_current")
def k1(spark, d):
    k = view(spark, d, "fx_known").select("user_id", "identifier", "title", "identifier_type", "edition_id", "updated_at", "progress_percent")
    m = view(spark, d, "fx_current").select("user_id", "identifier", F.upper("title").alias("title"), "identifier_type", "edition_id", "updated_at")
    return state.upsert_mappings(k, m).select("user_id", "identifier", "title", "edition_id", "progress_percent")


@query("k4_completion", "SELECT k.user_id, k.item_id, CASE WHEN c.user_id IS NOT NULL THEN 100.0 ELSE k.progress_percent END AS progress_percent, coalesce(c.item_id % 2 = 0, false) AS stamped FROM fx_known k LEFT JOIN fx_current c ON c.user_id = k.user_id AND c.identifier = k.identifier AND c.title = k.title AND c.progress_percent > 80", "fx_known", "fx_current")
def k4(spark, d):
    k = view(spark, d, "fx_known").withColumn("finished_at", F.lit(None).cast("timestamp"))
    done = view(spark, d, "fx_current").where("progress_percent > 80").withColumn("finished_at", F.when(F.col("item_id") % 2 == 0, F.col("updated_at").cast("timestamp")))
    return state.complete(k, done).select("user_id", "item_id", "progress_percent", F.col("finished_at").isNotNull().alias("stamped"))


@query("j12_legacy_keys", "SELECT c.user_id, c.item_id, k.identifier, k.edition_id FROM fx_current c JOIN fx_known k ON c.user_id = k.user_id AND k.identifier = c.identifier WHERE k.edition_id IS NOT NULL", "fx_known", "fx_current")
def j12(spark, d):
    items = view(spark, d, "fx_current").select("user_id", "item_id", F.array(F.concat(F.lit("title_author:"), F.col("identifier")), F.col("identifier")).alias("patterns"))
    return state.multi_key_lookup(items, view(spark, d, "fx_known").drop("item_id"))


@query("g15_decision_policy", "SELECT pos, reason FROM s WHERE status = 'skipped' AND reason IN ('not_found', 'match_rejected', 'already_in_library')", "fx_history", more=DECIDED)
def g15(spark, d):
    return state.decision_policy(_decided(spark, d), F.expr(NOW)).select("pos", "reason")


@query(
    "g14_additions",
    f"""SELECT item_id, CASE WHEN NOT any_ THEN 'fail' WHEN mine THEN 'skip' WHEN NOT cap THEN 'skip' ELSE 'add' END AS outcome,
      CASE WHEN NOT any_ THEN 'NOT_FOUND' WHEN mine THEN 'ALREADY_IN_LIBRARY' WHEN NOT cap THEN 'no_length' ELSE 'best_edition' END AS reason, edition_id
    FROM (SELECT item_id, bool_or(fits) AS any_, bool_or(fits AND owned) AS mine, max(CASE WHEN rn = 1 AND fits THEN edition_id END) AS edition_id, coalesce(bool_or(rn = 1 AND fits AND has), false) AS cap
      FROM (SELECT c.*, row_number() OVER (PARTITION BY item_id ORDER BY NOT fits, users_count DESC, edition_id) AS rn FROM
        (SELECT book_id AS item_id, edition_id, users_count, book_id % 5 = 0 AS owned, coalesce(audio_seconds > 0 OR pages > 0, false) AS has, NOT (source_format = 'audiobook' AND {O.FORMAT} = 'book') AS fits FROM e) c) GROUP BY item_id)""",
    "fx_editions", more=CONTEXT,
)
def g14(spark, d):
    e = view(spark, d, "fx_editions")
    c = e.withColumns({"item_id": F.col("book_id"), "fmt": F.when(F.col("book_id") % 2 == 0, "audiobook").otherwise("ebook"), "match_type": F.lit("isbn"), "edition_score": F.col("users_count")})
    owned = e.where("book_id % 5 = 0").select("book_id")
    return decide.plan_additions(c, owned, e.limit(0).select(F.col("book_id").alias("item_id"))).select("item_id", "outcome", "reason", "edition_id")


@query("f13_j18_completed_union", "SELECT item_id, kind FROM (SELECT DISTINCT item_id, 'progress' AS kind FROM fx_history WHERE progress > 90 UNION ALL SELECT DISTINCT item_id, 'completed' FROM fx_history WHERE coalesce(is_finished, false) AND item_id NOT IN (SELECT item_id FROM fx_history WHERE progress > 90))", "fx_history")
def f13(spark, d):
    from ..sources import readers

    h = view(spark, d, "fx_history")
    items = h.select("item_id").distinct().withColumns({"item_finished": F.lit(False), "kind": F.lit("completed")})
    done = readers.completed_items(items, h).select("item_id", "kind")
    return readers.with_completed(h.where("progress > 90").select("item_id", F.lit("progress").alias("kind")).distinct(), done)


@query("j19_latest_session", "SELECT item_id, epoch_us(max(last_update)) AS last_listened_at FROM fx_history GROUP BY item_id", "fx_history")
def j19(spark, d):
    from ..sources import readers

    h = view(spark, d, "fx_history").select("item_id", F.col("last_update").cast("timestamp").alias("updated_at"))
    items = h.select("item_id").distinct().withColumn("last_listened_at", F.lit(None).cast("timestamp"))
    return readers.latest_sessions(items, h).select("item_id", F.unix_micros("last_listened_at").alias("last_listened_at"))


@query("f11_author_search", "SELECT book_id FROM fx_works WHERE author ILIKE '%brand#1%'", "fx_works")
def f11(spark, d):
    return link.author_search(view(spark, d, "fx_works"), "brand#1").select("book_id")


@query("p23_title_author_keys", "SELECT item_id, 'title_author:' || regexp_replace(trim(lower(title)), '\\s+', '_', 'g') || '|' || regexp_replace(trim(lower(author)), '\\s+', '_', 'g') AS key FROM fx_items", "fx_editions", "fx_items")
def p23(spark, d):
    return view(spark, d, "fx_items").select("item_id", P.title_author_key(F.col("title"), F.col("author")).alias("key"))


@query("k16_verified_writes", "SELECT pos, coalesce(pos % 4 <> 0 AND pos % 3 <= 1, false) AS verified FROM fx_history WHERE progress IS NOT NULL", "fx_history")
def k16(spark, d):
    from ..sources import sinks

    h = view(spark, d, "fx_history").where("progress is not null")
    plan = h.select(F.col("pos").alias("action_id"), F.col("position"), "progress")
    ack = h.where("pos % 4 <> 0").select(F.col("pos").alias("action_id"), (F.col("position") + F.col("pos") % 3).alias("position"), (F.col("progress") + 1).alias("progress"))
    return sinks.verify_writes(plan, ack).select(F.col("action_id").alias("pos"), "verified")
