"""Factor and edition scores as column expressions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T


@dataclass(frozen=True)
class Profile:
    """Weights by factor; bonuses; the least gain for which an edition is replaced."""

    weights: dict[str, float]
    perfect_format: float = 0.0
    high_popularity: bool = False
    min_improvement: float = 0.0
    require_length: bool = False


# Fixed values.
DEFAULT = Profile({"format": 0.4, "length": 0.25, "popularity": 0.15, "completeness": 0.1, "data": 0.1})
TITLE_AUTHOR = Profile({"format": 0.4, "popularity": 0.2, "duration": 0.17, "completeness": 0.13, "data": 0.07, "narrator": 0.03}, 3.0, True)
STRICT = Profile(DEFAULT.weights, min_improvement=5.0)
TWO_STAGE = Profile({"format": 0.4, "popularity": 0.23, "duration": 0.19, "completeness": 0.15, "narrator": 0.03}, 3.0, True)
WORK_WEIGHTS = {"title": 0.35, "author": 0.25, "series": 0.15, "activity": 0.1, "year": 0.05}


def has(c: Column) -> Column:
    """Present and positive."""
    return F.coalesce(c > 0, F.lit(False))


def contains_any(c: Column, *parts: str) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | c.contains(p)
    return out


def format_factor(edition: Column, source: Column, text_is_physical: bool = True, no_source: float = 60.0) -> Column:
    e, s = F.lower(edition), F.lower(source)
    audio, ebook = contains_any(e, "audiobook", "listened"), contains_any(e, "ebook", "digital")
    physical = contains_any(e, "physical", "paperback", "hardcover", *(["text"] if text_is_physical else []))
    return (
        F.when(edition.isNull() | (edition == ""), 20.0)
        .when(source.isNull() | (source == ""), no_source)
        .when((s == "audiobook") & audio, 100.0)
        .when((s == "ebook") & ebook, 100.0)
        .when((s == "audiobook") & ebook, 62.5)
        .when((s == "ebook") & audio, 62.5)
        .when(physical, 37.5)
        .otherwise(12.5)
    )


def length_factor(audio_seconds: Column, pages: Column) -> Column:
    return F.when(has(audio_seconds) & has(pages), 100.0).when(has(audio_seconds) | has(pages), 60.0).otherwise(20.0)


def duration_factor(edition: Column, source: Column, source_format: Column, two_stage: bool = False) -> Column:
    """two_stage: a missing edition length counts before a missing source length."""
    out = F.when(F.coalesce(source_format, F.lit("")) != "audiobook", 60.0)
    gaps = [(~has(source), 50.0), (~has(edition), 30.0)]
    for condition, value in reversed(gaps) if two_stage else gaps:
        out = out.when(condition, value)
    return out.otherwise(T.duration_similarity(source, edition))


def popularity_factor(users: Column) -> Column:
    return F.when(~has(users), 20.0).otherwise(F.least(F.lit(100.0), 20 + F.log10(users + 1) * 25))


def completeness_factor(asin: Column, isbn_10: Column, isbn_13: Column, pages: Column, audio_seconds: Column, fmt: Column, users: Column) -> Column:
    """Sum of what is there over six, but at least 40; 30 if nothing is there."""
    filled = lambda c: c.isNotNull() & (c != "")
    parts = [(filled(asin), 20), (filled(isbn_10) | filled(isbn_13), 20), (has(pages), 15), (has(audio_seconds), 15), (filled(fmt), 15), (has(users), 15)]
    total = sum((F.when(F.coalesce(p, F.lit(False)), v).otherwise(0) for p, v in parts), F.lit(0))
    return F.when(total == 0, 30.0).otherwise(F.greatest(F.lit(40.0), total / 6))


def data_factor(score: Column) -> Column:
    return F.when(score.isNull(), 50.0).otherwise(F.least(F.lit(100.0), F.greatest(F.lit(0), score) / 2000 * 100))


def narrator_similarity(edition: Column, source: Column) -> Column:
    return T.general_similarity(T.standard_author(source), T.standard_author(edition)) * 100


def narrator_factor(edition: Column, source: Column, source_format: Column) -> Column:
    none = lambda c: c.isNull() | (c == "")
    alike = narrator_similarity(edition, source)
    return (
        F.when(F.coalesce(source_format, F.lit("")) != "audiobook", 60.0).when(none(source) & none(edition), 50.0).when(none(source), 40.0).when(none(edition), 30.0).otherwise(alike)
    )


def series_factor(name: Column, sequence: Column, other: Column, other_sequence: Column, similarity: Column | None = None) -> Column:
    """similarity: of the standard names, from 0 to 1, if it is known already."""
    none = lambda c: c.isNull() | (c == "")
    alike = (T.series_similarity(T.standard_series(name), T.standard_series(other)) if similarity is None else similarity) * 100
    both = has(sequence) & has(other_sequence)
    bonus = F.when(both & (sequence == other_sequence), 20.0).when(both, 5.0).otherwise(0.0)
    scored = F.get(F.transform(F.array(alike), lambda x: F.when(x < 70, F.greatest(F.lit(20.0), x * 0.5)).otherwise(F.least(F.lit(100.0), x + bonus))), F.lit(0))
    return F.when(none(name) & none(other), 60.0).when(none(name) | none(other), 45.0).otherwise(scored)


def year_factor(year: Column, other: Column) -> Column:
    gap = F.abs(year - other)
    bands = F.when(gap == 0, 100.0).when(gap == 1, 85.0).when(gap <= 3, 70.0).when(gap <= 5, 50.0).otherwise(20.0)
    none = lambda c: c.isNull() | (c == 0)
    return F.when(none(year) & none(other), 60.0).when(none(year) | none(other), 45.0).otherwise(bands)


def activity_factor(activity: Column) -> Column:
    return F.when(~has(activity), 30.0).otherwise(F.least(F.lit(100.0), 30 + F.log10(activity + 1) * 20))


def clamp(c: Column) -> Column:
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), c))


@dataclass(frozen=True)
class EditionContext:
    """What an edition is held against; columns or literals."""

    source_format: Column
    source_duration: Column
    source_narrator: Column = field(default_factory=lambda: F.lit(None).cast("string"))
    edition_narrator: Column = field(default_factory=lambda: F.lit(None).cast("string"))
    format_mapper: Callable[[], Column] | None = None


def edition_factors(ctx: EditionContext, profile: Profile, two_stage: bool = False) -> dict[str, Column]:
    """The factors that the profile weighs, over columns of an editions table."""
    fmt = ctx.format_mapper() if ctx.format_mapper else F.col("reading_format")
    c = F.col
    every = {
        "format": format_factor(fmt, ctx.source_format, text_is_physical=not two_stage),
        "length": length_factor(c("audio_seconds"), c("pages")),
        "popularity": popularity_factor(c("users_count")),
        "duration": duration_factor(c("audio_seconds"), ctx.source_duration, ctx.source_format, two_stage),
        "completeness": completeness_factor(c("asin"), c("isbn_10"), c("isbn_13"), c("pages"), c("audio_seconds"), F.coalesce(c("reading_format"), c("physical_format")), c("users_count")),
        "data": data_factor(c("score")),
        "narrator": narrator_factor(ctx.edition_narrator, ctx.source_narrator, ctx.source_format),
    }
    return {k: every[k] for k in profile.weights}


def edition_score(factors: dict[str, Column], profile: Profile, users: Column) -> Column:
    total = sum((factors[k] * w for k, w in profile.weights.items()), F.lit(0.0))
    if profile.perfect_format:
        total = total + F.when(factors["format"] >= 95, profile.perfect_format).otherwise(0.0)
    if profile.high_popularity:
        total = total + F.when(users >= 1000, F.least(F.lit(2.0), F.log10(users / 1000))).otherwise(0.0)
    return clamp(total)
