"""Formats, bases and clean values of items and editions, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scores import has

# Catalogue formats and the internal ones.
INTERNAL = {"Listened": "audiobook", "Ebook": "ebook", "Read": "book", "Both": "mixed"}
PROGRESS = {"Listened": "audiobook", "Ebook": "ebook", "Read": "physical", "Both": "mixed"}


def _mapped(c: Column, table: dict[str, str]) -> Column:
    out = None
    for k, v in table.items():
        out = F.when(c == k, v) if out is None else out.when(c == k, v)
    return out


def internal_format(reading_format: Column, audio_seconds: Column) -> Column:
    return F.coalesce(_mapped(reading_format, INTERNAL), F.when(has(audio_seconds), "audiobook").otherwise("book"))


def progress_format(reading_format: Column, audio_seconds: Column, pages: Column) -> Column:
    return F.when(has(audio_seconds), "audiobook").otherwise(F.coalesce(_mapped(reading_format, PROGRESS), F.when(has(pages), "physical").otherwise("unknown")))


def progress_basis(fmt: Column, audio_seconds: Column, pages: Column) -> Column:
    """struct<unit, total>: seconds for audiobooks, else pages, else seconds; null if there is no length."""
    basis = lambda unit, total: F.struct(F.lit(unit).alias("unit"), total.cast("double").alias("total"))
    return F.when((fmt == "audiobook") & has(audio_seconds), basis("seconds", audio_seconds)).when(has(pages), basis("pages", pages)).when(has(audio_seconds), basis("seconds", audio_seconds))


def source_format(media_type: Column, library_type: Column, has_audio: Column, has_ebook: Column) -> Column:
    """Decision list over what an item says about itself."""
    kind = F.lower(F.coalesce(media_type, F.lit("")))
    return (
        F.when(kind.isin("audiobook", "ebook"), kind)
        .when(F.lower(F.coalesce(library_type, F.lit(""))).isin("audiobook", "ebook"), F.lower(library_type))
        .when(F.coalesce(has_audio, F.lit(False)), "audiobook")
        .when(F.coalesce(has_ebook, F.lit(False)), "ebook")
        .otherwise("ebook")
    )


def progress_ratio(fmt: Column, progress: Column, ebook_progress: Column) -> Column:
    """The position as a share of the whole: finite, clamped to [0, 1]; ebooks prefer their own value."""
    fine = lambda c: F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.least(F.lit(1.0), F.greatest(F.lit(0.0), c)))
    p, e = fine(progress), fine(ebook_progress)
    return F.when(fmt == "ebook", F.coalesce(e, p)).otherwise(F.coalesce(p, e))


def parse_duration(c: Column) -> Column:
    """Seconds of text such as '10h 30m'; 0 is null."""
    part = lambda unit: F.coalesce(F.nullif(F.regexp_extract(c, rf"(\d+)\s*{unit}", 1), F.lit("")).cast("long"), F.lit(0))
    return F.nullif(part("h") * 3600 + part("m") * 60 + part("s"), F.lit(0))


def clock(seconds: Column) -> Column:
    s = F.floor(seconds).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600).cast("long"), F.floor(s % 3600 / 60).cast("long"), s % 60)


def hours_minutes(seconds: Column) -> Column:
    s = F.floor(seconds).cast("long")
    return F.concat(F.floor(s / 3600).cast("string"), F.lit("h "), F.floor(s % 3600 / 60).cast("string"), F.lit("m"))


def _moment(c: Column) -> Column:
    """A point in time from milliseconds, ISO or SQL text; null if it is none of these."""
    text = F.trim(c.cast("string"))
    dated = text.contains("T") | text.contains("-")
    return F.when(text.rlike(r"^\d+$"), F.timestamp_millis(text.try_cast("long"))).when(dated, text.try_cast("timestamp"))


def localize_timestamp(c: Column, zone: str = "UTC") -> Column:
    """Local time as text; N/A where there is nothing, Invalid where it can't be read. The session's zone is
    taken to be UTC."""
    text = F.trim(c.cast("string"))
    local = F.date_format(F.from_utc_timestamp(_moment(c), zone), "yyyy-MM-dd HH:mm:ss")
    return F.when(text.isNull() | text.isin("", "0"), "N/A").otherwise(F.coalesce(local, F.lit("Invalid")))


def localize_date(c: Column, zone: str = "UTC") -> Column:
    """The calendar day in the zone; text without a time is that zone's day already."""
    text = F.trim(c.cast("string"))
    day = F.to_date(F.from_utc_timestamp(_moment(c), zone))
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}( |$)"), F.substring(text, 1, 10).try_cast("date")).otherwise(day)


def title_author_key(title: Column, author: Column) -> Column:
    flat = lambda c: F.regexp_replace(F.trim(F.lower(F.coalesce(c, F.lit("")))), r"\s+", "_")
    return F.concat(F.lit("title_author:"), flat(title), F.lit("|"), flat(author))


def title_author_keys(title: Column, author: Column) -> Column:
    """Every spelling under which state may hold a title and author: today's and the two of older state."""
    bare = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9:]", "")
    t, a = (F.coalesce(c, F.lit("")) for c in (title, author))
    return F.array_distinct(F.array(title_author_key(title, author), F.concat(t, F.lit(":"), a), F.concat(bare(t), F.lit(":"), bare(a))))


def state_title(title: Column) -> Column:
    return F.lower(F.trim(title))
