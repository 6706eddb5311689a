"""A user's library: lookups by edition and work, links to what the user owns, what is remembered of them.

A library holds one row per owned edition: user_id, book_id, edition_id, asin. It may be given as a Library,
whose rows are only made for what is asked."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import formats as P
from ..functions import scores as S
from ..functions import text as T
from . import link, select, state


@dataclass(frozen=True)
class Library:
    """A library whose users own the same editions of a work: works (user_id, book_id), a row for each work that
    a user has, and editions (book_id, edition_id, asin). Its rows, works joined with editions, are many
    more than those of both."""

    works: DataFrame
    editions: DataFrame


def _owned(asked: DataFrame, library: DataFrame | Library) -> DataFrame:
    """asked (user_id, book_id) joined left with what its users own of its works, as _own and _asin."""
    edition = (F.col("edition_id").alias("_own"), F.col("asin").alias("_asin"))
    if isinstance(library, DataFrame):
        return asked.join(library.select("user_id", "book_id", *edition), ["user_id", "book_id"], "left")
    held = asked.join(library.works.select("user_id", "book_id", F.lit(True).alias("_held")), ["user_id", "book_id"], "left")
    own = library.editions.select(F.col("book_id").alias("_w"), *edition)
    return held.join(own, F.col("_held") & (F.col("book_id") == F.col("_w")), "left").drop("_held", "_w")


def editions_of_works(asked: DataFrame, editions: DataFrame, works: DataFrame | None = None) -> DataFrame:
    """All editions of the works in asked (book_id); works adds title and author."""
    out = editions.join(asked.select("book_id").distinct(), "book_id", "left_semi")
    return out if works is None else out.join(works.select("book_id", "title", "author"), "book_id", "left")


def works_of_editions(asked: DataFrame, editions: DataFrame, works: DataFrame) -> DataFrame:
    """The work of each edition in asked (edition_id), with the edition's lengths."""
    found = editions.join(asked.select("edition_id").distinct(), "edition_id", "left_semi").select("edition_id", "book_id", "audio_seconds", "pages")
    return found.join(works.select("book_id", "title", "author"), "book_id", "left")


def find_owned(asked: DataFrame, library: DataFrame | Library, by: str = "edition_id") -> DataFrame:
    """Library rows of the user in asked (user_id and text or number in column `by`); ids are compared as
    text."""
    wanted = asked.select("user_id", F.trim(F.col(by).cast("string")).alias("_id")).distinct()
    if isinstance(library, Library) and by == "edition_id":
        editions = library.editions.withColumn("_id", F.col(by).cast("string"))
        return library.works.join(wanted.join(editions, "_id"), ["user_id", "book_id"]).drop("_id")
    if isinstance(library, Library):
        works = library.works.withColumn("_id", F.col(by).cast("string"))
        return works.join(wanted, ["user_id", "_id"], "left_semi").drop("_id").join(library.editions, "book_id")
    rows = library.withColumn("_id", F.col(by).cast("string"))
    return rows.join(wanted, ["user_id", "_id"], "left_semi").drop("_id")


def owned_links(links: DataFrame, library: DataFrame | Library) -> DataFrame:
    """links (user_id, item_id, match_type, asin, edition_id, book_id) with the edition that progress goes to
    and tier. library: the user owns that very edition. cross_edition: the user owns another edition of the
    work, for an ASIN the one with this ASIN before the first one. search: the work isn't owned and the
    catalogue's edition stands."""
    rank = F.when(F.col("_own") == F.col("edition_id"), 0).when((F.col("match_type") == "asin") & (F.upper("_asin") == F.col("asin")), 1).otherwise(2)
    best = F.min_by(F.struct("_own", rank.alias("rank")), F.when(F.col("_own").isNotNull(), F.struct(rank, "_own"))).alias("b")
    keys = ["user_id", "item_id", "match_type", "edition_id", "book_id"]
    met = _owned(links, library).groupBy(*keys).agg(best)
    tier = F.when(F.col("b").isNull(), "search").when(F.col("b.rank") == 0, "library").otherwise("cross_edition")
    return met.select("user_id", "item_id", "match_type", "book_id", F.coalesce("b._own", "edition_id").alias("edition_id"), tier.alias("tier"))


def title_author_matches(items: DataFrame, works: DataFrame, editions: DataFrame, library: DataFrame | Library, threshold: float = 70.0) -> DataFrame:
    """items (user_id, item_id, title, author, fmt, duration_s) linked to works by title and author: the best
    work at or over the threshold, of it the best edition for the item's format and length, and then what the
    user owns: that edition, else another one of the work, else it is to be added."""
    best = link.link_by_title_author(items, works, threshold).withColumnRenamed("score", "match_score")
    context = items.select("user_id", "item_id", F.col("fmt").alias("_fmt"), F.col("duration_s").alias("_len"))
    near = best.join(context, "item_id").join(editions, "book_id")
    scored = select.score_editions(near, S.EditionContext(F.col("_fmt"), F.col("_len")), S.TITLE_AUTHOR)
    chosen = select.best_editions(scored, "item_id", S.TITLE_AUTHOR).select("item_id", "edition_id", "edition_score")
    links = best.join(context.select("user_id", "item_id"), "item_id").join(chosen, "item_id", "left")
    owned = owned_links(links.select("user_id", "item_id", F.lit("title_author").alias("match_type"), F.lit(None).cast("string").alias("asin"), "edition_id", "book_id"), library)
    kind = F.when(F.col("tier") == "library", "title_author").when(F.col("tier") == "cross_edition", "title_author_different_edition").otherwise("title_author_auto_add")
    return owned.join(links.select("item_id", F.col("match_score").alias("score"), "edition_score"), "item_id").select("user_id", "item_id", "book_id", "edition_id", kind.alias("match_type"), "tier", "score", "edition_score")


def find_matches(items: DataFrame, editions: DataFrame, works: DataFrame, library: DataFrame | Library) -> DataFrame:
    """user_id, item_id, match_type, book_id, edition_id, tier: identifiers first; titles and authors are
    compared only for the items that these leave."""
    by_id = link.link_by_identifier(items, link.identifier_index(editions))
    keyed = by_id.join(items.select("user_id", "item_id", T.clean_asin(F.col("asin_raw")).alias("asin")), "item_id")
    columns = ["user_id", "item_id", "match_type", "book_id", "edition_id", "tier"]
    left = items.join(by_id.select("item_id"), "item_id", "left_anti")
    return owned_links(keyed, library).select(*columns).unionByName(title_author_matches(left, works, editions, library).select(*columns))


def search_tokens(items: DataFrame, works: DataFrame, k: int = 10, with_author: bool = False) -> DataFrame:
    """item_id, book_id, rank: of the works whose standard title has every word of the item's (and whose
    author shares a word with the item's), the k most active. A form of title meets the works that hold its
    rarest word; equal forms are searched once."""
    words = lambda c: F.array_distinct(F.filter(F.split(c, " "), lambda w: w != ""))
    w = works.select("book_id", "activity", words(T.standard_title(F.col("title"))).alias("has"), words(T.standard_author(F.col("author"))).alias("by"))
    i = items.select("item_id", F.array_sort(words(T.standard_title(F.col("title")))).alias("want"), F.array_sort(words(T.standard_author(F.col("author")))).alias("who") if with_author else F.array().cast("array<string>").alias("who"))
    forms = i.select("want", "who").distinct().where(F.size("want") > 0)
    holders = w.select(F.explode("has").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    rarest = forms.select("want", "who", F.explode("want").alias("word")).join(holders, "word", "left").groupBy("want", "who").agg(F.min_by("word", F.struct(F.coalesce("n", F.lit(0)), "word")).alias("word"))
    met = link.dealt(rarest, w.select("*", F.explode("has").alias("word")), ["word"]).where(F.size(F.array_except("want", "has")) == 0)
    if with_author:
        met = met.where(F.arrays_overlap("who", "by"))
    rank = F.row_number().over(Window.partitionBy("want", "who").orderBy(F.desc("activity"), "book_id"))
    return i.join(met.withColumn("rank", rank).where(F.col("rank") <= k), ["want", "who"]).select("item_id", "book_id", "rank")


def candidates_with_editions(hits: DataFrame, editions: DataFrame) -> DataFrame:
    """One row for each edition of each hit (item_id, book_id); a hit without editions stays, not enhanced."""
    e = editions.select("book_id", "edition_id")
    return hits.join(e, "book_id", "left").select("item_id", "book_id", "edition_id", F.col("edition_id").isNotNull().alias("enhanced"))


# Remembered state


def remember_matches(matches: DataFrame, threshold: float = 70.0) -> DataFrame:
    """The rows of state that accepted title/author links (title, author, contributors, score, edition_id)
    leave: under the key of title and author, which are the contributors where there are any."""
    who = F.coalesce(F.nullif("contributors", F.lit("")), "author")
    kept = matches.where((F.col("score") >= threshold) & F.col("edition_id").isNotNull())
    return kept.select("user_id", P.title_author_key(F.col("title"), F.col("author")).alias("identifier"), F.lit("title_author").alias("identifier_type"), P.state_title(F.col("title")).alias("title"), who.alias("author"), "edition_id", "updated_at")


def store_sync(old: DataFrame, synced: DataFrame) -> DataFrame:
    """Mapping and progress of valid rows in one merge: a reader sees both or neither."""
    valid = state.expectations(synced).where(F.size("violations") == 0).drop("violations").withColumn("title", P.state_title(F.col("title")))
    return state.merge(old, valid.select(*old.columns), state.KEY, ("identifier_type", "edition_id", "progress_percent", "status_id", "updated_at"))


SKIP_KEY = ("user_id", "identifier", "identifier_type", "title")


def store_skips(old: DataFrame, new: DataFrame) -> DataFrame:
    """Negative decisions, one per key; a later one replaces all but the time of the first."""
    return state.merge(old, new.select(*old.columns), SKIP_KEY, tuple(c for c in old.columns if c not in (*SKIP_KEY, "created_at")), ("created_at",))


def clear_skips(skips: DataFrame, keys: DataFrame) -> DataFrame:
    """Negative decisions but those of keys."""
    return state.delete(skips, keys, SKIP_KEY)


STATISTICS = ("total", "with_progress", "in_progress", "completed", "never_started")


def store_statistics(old: DataFrame, new: DataFrame) -> DataFrame:
    """Statistics per user, new ones in place of old ones."""
    return state.merge(old, new.select(*old.columns), ("user_id",), tuple(c for c in old.columns if c != "user_id"))


def load_statistics(stored: DataFrame, users: DataFrame) -> DataFrame:
    """The statistics of users; what isn't stored is 0."""
    return users.select("user_id").distinct().join(stored, "user_id", "left").select("user_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in STATISTICS])


def prior_progress(items: DataFrame, known: DataFrame, columns: tuple[str, ...] = ("progress_percent", "edition_id", "status_id")) -> DataFrame:
    """items with what state holds under their key; null where it holds nothing."""
    held = known.select(*state.KEY, *[F.col(c).alias(f"last_{c}") for c in columns])
    return items.withColumn("title", P.state_title(F.col("title"))).join(held, list(state.KEY), "left")


def key_patterns(items: DataFrame, known: DataFrame, most: int = 5) -> DataFrame:
    """user_id, item_id, patterns: every spelling of an item's title and author, then up to `most` others
    under which state holds its title; none twice."""
    held = known.where("identifier_type = 'title_author'").select("user_id", F.col("title").alias("_t"), "identifier").distinct()
    rank = F.row_number().over(Window.partitionBy("user_id", "_t").orderBy("identifier"))
    few = held.withColumn("_r", rank).where(F.col("_r") <= most).groupBy("user_id", "_t").agg(F.array_sort(F.collect_list("identifier")).alias("_more"))
    j = items.withColumn("_t", P.state_title(F.col("title"))).join(few, ["user_id", "_t"], "left")
    own = P.title_author_keys(F.col("title"), F.col("author"))
    return j.select("user_id", "item_id", F.array_distinct(F.concat(own, F.coalesce("_more", F.array().cast("array<string>")))).alias("patterns"))


def newest_state(known: DataFrame, most: int) -> DataFrame:
    """The rows of state that were updated last, newest first, as many as a list shows."""
    return known.orderBy(F.desc_nulls_last("updated_at"), *state.KEY).limit(most)


def reuse_skips(items: DataFrame, skips: DataFrame, now: Column) -> DataFrame:
    """Rows of the actions table for items whose negative decision still holds: skipped, with its reason."""
    return state.fresh_decisions(items, skips, now).select("user_id", "identifier", "title", F.lit("skipped").alias("status"), "reason", F.lit(True).alias("remembered"))


def already_owned(candidates: DataFrame, library: DataFrame) -> DataFrame:
    """candidates (user_id, book_id) with owned: the work is in the user's library already."""
    own = library.select("user_id", "book_id", F.lit(True).alias("_own")).distinct()
    return candidates.join(own, ["user_id", "book_id"], "left").withColumn("owned", F.col("_own").isNotNull()).drop("_own")
