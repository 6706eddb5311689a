"""Choosing editions: scored, capable of progress, with upgrades only for a gain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import formats as P
from ..functions import scores as S
from ..functions import text as T


def score_editions(editions: DataFrame, ctx: S.EditionContext, profile: S.Profile, two_stage: bool = False) -> DataFrame:
    """editions with f_<factor> for every weighed factor and edition_score."""
    factors = S.edition_factors(ctx, profile, two_stage)
    staged = editions.withColumns({f"f_{k}": v for k, v in factors.items()})
    return staged.withColumn("edition_score", S.edition_score({k: F.col(f"f_{k}") for k in factors}, profile, F.col("users_count")))


def has_length() -> Column:
    """An edition has seconds or pages."""
    return S.has(F.col("audio_seconds")) | S.has(F.col("pages"))


def usable_editions(editions: DataFrame, require_length: bool = False) -> DataFrame:
    """Editions that have an id and a work and, where the profile asks for it, a length."""
    return editions.where(F.col("edition_id").isNotNull() & F.col("book_id").isNotNull() & (has_length() | F.lit(not require_length)))


def best_editions(scored: DataFrame, group: str, profile: S.Profile, current: str | None = None) -> DataFrame:
    """One row per group: the best edition, two alternatives, and improvement over the edition whose id
    is in column `current`. Order: score (to 0.01), data score, users, id. A profile with a least
    improvement gives no row where the gain is smaller."""
    scored = usable_editions(scored, profile.require_length)
    order = [F.desc(F.floor(F.col("edition_score") * 100 + 0.5)), F.desc(F.coalesce("score", F.lit(0))), F.desc(F.coalesce("users_count", F.lit(0))), "edition_id"]
    rank = scored.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    first = lambda k, c: F.max(F.when(F.col("_r") == k, F.col(c)))
    picked = [first(1, "edition_id").alias("edition_id"), first(1, "edition_score").alias("edition_score"), first(2, "edition_id").alias("second_id"), first(3, "edition_id").alias("third_id")]
    if current:
        picked.append(F.max(F.when(F.col("edition_id") == F.col(current), F.col("edition_score"))).alias("current_score"))
    wanted = (F.col("_r") <= 3) | (F.col("edition_id") == F.col(current)) if current else F.col("_r") <= 3
    out = rank.where(wanted).groupBy(group).agg(*picked)
    if not current:
        return out
    out = out.withColumn("improvement", F.col("edition_score") - F.coalesce("current_score", F.lit(0.0)))
    return out.where(F.col("improvement") >= profile.min_improvement) if profile.min_improvement else out


def compare_editions(current: DataFrame, new: DataFrame, key: str, profile: S.Profile) -> DataFrame:
    """key, improvement, should_upgrade of scored editions on two sides."""
    a = current.select(key, F.col("edition_score").alias("_c"))
    b = new.select(key, F.col("edition_score").alias("_n"))
    gain = F.col("_n") - F.col("_c")
    return a.join(b, key).select(key, gain.alias("improvement"), (gain >= profile.min_improvement).alias("should_upgrade"))


def capable_editions(editions: DataFrame) -> DataFrame:
    """Editions in which progress can be told, with unit and total."""
    basis = P.progress_basis(P.internal_format(F.col("reading_format"), F.col("audio_seconds")), F.col("audio_seconds"), F.col("pages"))
    return editions.withColumn("_basis", basis).where("_basis is not null").select(*editions.columns, F.col("_basis.unit").alias("unit"), F.col("_basis.total").alias("total"))


def progress_capable(editions: DataFrame, group: str, wanted_format: Column, duration: Column, preferred: Column | None = None) -> DataFrame:
    """Per group the edition to hold progress against: the preferred one if it is capable, else by format
    fit, distance of length, popularity, id."""
    cap = capable_editions(editions).withColumns({"_w": wanted_format, "_d": duration, "_p": preferred if preferred is not None else F.lit(None).cast("long")})
    fmt = P.internal_format(F.col("reading_format"), F.col("audio_seconds"))
    fit = F.when(fmt == F.col("_w"), 0).when(fmt == "mixed", 1).otherwise(2)
    gap = F.when(S.has(F.col("audio_seconds")) & S.has(F.col("_d")), F.abs(F.col("audio_seconds") - F.col("_d")))
    order = F.struct(
        F.when(F.col("edition_id") == F.col("_p"), 0).otherwise(1), fit, F.coalesce(gap, F.lit(float("inf"))), -F.coalesce("users_count", "score", F.lit(0)), "edition_id"
    )
    return cap.groupBy(group).agg(F.min_by(F.struct("edition_id", "unit", "total"), order).alias("e")).select(group, "e.*")


def distinct_editions(first: DataFrame, second: DataFrame, keep: str = "first", key: tuple[str, ...] = ("edition_id",)) -> DataFrame:
    """Union of two edition lists, one row per key: from the first or from the second list. Where works
    number their editions by themselves, the key is ("book_id", "edition_id")."""
    both = first.withColumn("_s", F.lit(0)).unionByName(second.withColumn("_s", F.lit(1)))
    rank = Window.partitionBy(*key).orderBy(F.col("_s") if keep == "first" else F.desc("_s"))
    return both.withColumn("_r", F.row_number().over(rank)).where("_r = 1").drop("_s", "_r")


def remembered_or_matched(matches: DataFrame, editions: DataFrame) -> DataFrame:
    """matches (item_id, book_id, edition_id, remembered_id): the remembered edition if the work still has
    it; `defer`: it can't hold progress, so a replacement waits for a confirmed write."""
    known = editions.select(F.col("edition_id").alias("_e"), (S.has(F.col("audio_seconds")) | S.has(F.col("pages"))).alias("_len"))
    j = matches.join(known, F.col("remembered_id") == F.col("_e"), "left")
    return j.select("item_id", "book_id", F.coalesce("_e", "edition_id").alias("edition_id"), (F.col("_e").isNotNull() & ~F.coalesce("_len", F.lit(False))).alias("defer"))


# Where the bands of each factor begin.
_BANDS = {
    "popularity": ((10000, "extremely popular"), (1000, "very popular"), (100, "popular"), (10, "some readers"), (1, "few readers")),
    "duration": ((95, "excellent"), (85, "very good"), (70, "good"), (50, "acceptable")),
    "completeness": ((5, "very complete"), (4, "good"), (3, "decent"), (2, "limited")),
    "narrator": ((90, "excellent"), (70, "very good"), (50, "good"), (30, "partial")),
}


def _banded(c: Column, factor: str, otherwise: str) -> Column:
    out = None
    for least, said in _BANDS[factor]:
        out = F.when(c >= least, said) if out is None else out.when(c >= least, said)
    return out.otherwise(otherwise)


def explain(editions: DataFrame, ctx: S.EditionContext) -> DataFrame:
    """editions with a reason in words for format, popularity, duration, completeness and narrator."""
    fmt, source = F.lower(F.coalesce(ctx.format_mapper() if ctx.format_mapper else F.col("reading_format"), F.lit(""))), ctx.source_format
    audio, ebook = S.contains_any(fmt, "audiobook", "listened"), S.contains_any(fmt, "ebook", "digital")
    why_format = (
        F.when(fmt == "", "unknown")
        .when(((source == "audiobook") & audio) | ((source == "ebook") & ebook), "the same")
        .when(((source == "audiobook") & ebook) | ((source == "ebook") & audio), "the other digital one")
        .when(S.contains_any(fmt, "physical", "paperback", "hardcover"), "physical")
        .otherwise("another")
    )
    users = F.coalesce("users_count", F.lit(0))
    length = T.duration_similarity(ctx.source_duration, F.col("audio_seconds"))
    missing = lambda c: c.isNull() | (c == "")
    heard = F.coalesce(source, F.lit("")) != "audiobook"
    why_duration = F.when(heard, "not relevant").when(~S.has(ctx.source_duration), "no length of the item").when(~S.has(F.col("audio_seconds")), "no length of the edition").otherwise(_banded(length, "duration", "poor"))
    given = lambda *names: F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in names]).isNotNull()
    filled = (given("asin"), given("isbn_10", "isbn_13"), S.has(F.col("pages")), S.has(F.col("audio_seconds")), given("reading_format", "physical_format"), S.has(F.col("users_count")))
    complete = sum((x.cast("int") for x in filled), F.lit(0))
    voice = S.narrator_similarity(ctx.edition_narrator, ctx.source_narrator)
    none = missing(ctx.source_narrator), missing(ctx.edition_narrator)
    why_narrator = F.when(heard, "not relevant").when(none[0] & none[1], "none known").when(none[0], "none of the item").when(none[1], "none of the edition").otherwise(_banded(voice, "narrator", "poor"))
    return editions.withColumns({"why_format": why_format, "why_popularity": _banded(users, "popularity", "no readers"), "why_duration": why_duration, "why_completeness": _banded(complete, "completeness", "minimal"), "why_narrator": why_narrator})


def preferred_editions(scored: DataFrame, editions: DataFrame) -> DataFrame:
    """book_id, edition_id: the best scored edition of a work, else its first one."""
    best = best_editions(scored, "book_id", S.DEFAULT).select("book_id", F.col("edition_id").alias("_b"))
    first = editions.groupBy("book_id").agg(F.min("edition_id").alias("_f"))
    return first.join(best, "book_id", "left").select("book_id", F.coalesce("_b", "_f").alias("edition_id"))


def resolve_additions(matches: DataFrame, editions: DataFrame, wanted_format: Column, duration: Column) -> DataFrame:
    """matches (item_id, book_id, edition_id): the matched edition of that work if it can hold progress, else
    the best sibling that can; null if there is none. Siblings are read only for the works that need them."""
    cap = capable_editions(editions).select("book_id", "edition_id", F.lit(True).alias("_c")).distinct()
    j = matches.join(cap, ["book_id", "edition_id"], "left")
    fine = j.where("_c is not null").select("item_id", "book_id", "edition_id")
    need = j.where("_c is null").select("item_id", "book_id")
    siblings = editions.join(need.select("book_id").distinct(), "book_id", "left_semi")
    found = progress_capable(siblings, "book_id", wanted_format, duration).select("book_id", "edition_id")
    return fine.unionByName(need.join(found, "book_id", "left").select("item_id", "book_id", "edition_id"))
