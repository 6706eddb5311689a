"""Progress: validation, positions, completion, change, regression and what follows from them.

Columns read: fmt (audiobook, ebook, physical, ...), progress (percent, any type), is_finished
(nullable boolean), position and total (seconds or pages), previous (percent)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Thresholds:
    # Fixed values.
    minimum: float = 5.0
    change: float = 0.1
    state_change: float = 0.01
    session_change: float = 5.0
    audio_left: float = 120.0
    pages_left: float = 3.0
    complete: float = 95.0
    block: float = 50.0
    warn: float = 15.0
    session_warn: float = 10.0
    reread_from: float = 85.0
    reread_to: float = 30.0


def round6(c: Column) -> Column:
    return F.floor(c * 1e6 + 0.5) / 1e6


def half_up(c: Column) -> Column:
    return F.floor(c + 0.5)


def percent(c: Column) -> Column:
    """A number in [0, 100], parsed and clamped; null for anything that isn't finite."""
    x = F.trim(c.cast("string")).try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), F.least(F.lit(100.0), F.greatest(F.lit(0.0), x)))


def from_position(position: Column, total: Column) -> Column:
    ok = F.coalesce((total > 0) & (position >= 0), F.lit(False))
    return F.when(ok, F.least(F.lit(100.0), round6(position / total * 100))).otherwise(0.0)


def to_position(progress: Column, total: Column, unit: Column) -> Column:
    """Pages in [1, total], seconds in [0, total]; 1 or 0 where progress or total is missing."""
    least = F.when(unit == "pages", 1.0).otherwise(0.0)
    ok = progress.isNotNull() & F.coalesce(total > 0, F.lit(False))
    return F.when(ok, F.least(total.cast("double"), F.greatest(least, half_up(progress / 100 * total).cast("double")))).otherwise(least)


def normalize_flags(df: DataFrame) -> DataFrame:
    """df with is_finished true only for true or 1, and progress 0 where there is none."""
    said = F.lower(F.trim(F.col("is_finished").cast("string")))
    return df.withColumns({"is_finished": F.coalesce(said.isin("true", "1"), F.lit(False)), "progress": F.coalesce("progress", F.lit(0.0))})


def validate_progress(df: DataFrame) -> DataFrame:
    """Adds progress_valid: for finished items the given value, else 100; audiobooks by their position;
    else the given value."""
    given = percent(F.col("progress"))
    placed = F.when((F.col("fmt") == "audiobook") & F.coalesce((F.col("total") > 0) & (F.col("position") >= 0), F.lit(False)), from_position(F.col("position"), F.col("total")))
    return df.withColumn("progress_valid", F.when(F.coalesce("is_finished", F.lit(False)), F.coalesce(given, F.lit(100.0))).otherwise(F.coalesce(placed, given)))


def discrepancies(df: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """Rows whose given and position-based progress differ by more than tolerance."""
    placed = F.when((F.col("total") > 0) & (F.col("position") >= 0), from_position(F.col("position"), F.col("total")))
    return df.withColumns({"given": percent(F.col("progress")), "placed": placed}).where(F.abs(F.col("given") - F.col("placed")) > tolerance)


def below_minimum(df: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """Adds below_minimum: progress at or under the threshold and not finished; no progress isn't gated."""
    low = F.coalesce(percent(F.col("progress")) <= t.minimum, F.lit(False))
    return df.withColumn("below_minimum", low & ~F.coalesce("is_finished", F.lit(False)))


def is_zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0)) == 0


def detect_completion(df: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """Adds complete: the flag decides where there is one; else what is left of the length; else percent."""
    p = percent(F.col("progress"))
    unit = F.when(F.col("fmt") == "audiobook", "seconds").otherwise("pages")
    left = F.col("total") - to_position(p, F.col("total"), unit)
    known = F.coalesce(F.col("total") > 0, F.lit(False)) & p.isNotNull()
    by_length = F.when(F.col("fmt") == "audiobook", left <= t.audio_left).otherwise(left <= t.pages_left)
    return df.withColumn("complete", F.when(F.col("is_finished").isNotNull(), F.col("is_finished")).when(known, by_length).otherwise(F.coalesce(p >= t.complete, F.lit(False))))


def detect_change(df: DataFrame, threshold: float = Thresholds.change) -> DataFrame:
    """Adds delta, changed and direction of progress against previous."""
    old, new = percent(F.col("previous")), percent(F.col("progress"))
    delta = round6(F.abs(new - old))
    changed = F.when(new.isNull(), False).when(old.isNull(), True).otherwise(delta >= threshold)
    way = F.when(new.isNull(), "invalid").when(old.isNull(), "new").when(new > old, "forward").when(new < old, "backward").otherwise("same")
    return df.withColumns({"delta": delta, "changed": changed, "direction": way})


def analyze_regression(df: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """Adds drop, regression, blocked, reread, warned, reason."""
    old, new = percent(F.col("previous")), percent(F.col("progress"))
    drop = F.greatest(F.lit(0.0), round6(old - new))
    both = old.isNotNull() & new.isNotNull()
    block, again = both & (drop >= t.block), both & (old >= t.reread_from) & (new <= t.reread_to)
    warn = both & ~block & (again | (drop >= t.warn))
    reason = (
        F.when(new.isNull(), "invalid")
        .when(old.isNull(), "new")
        .when(block & again, "blocked re-read")
        .when(block, "blocked")
        .when(again, "re-read")
        .when(warn, "large drop")
        .when(drop > 0, "small drop")
        .otherwise("none")
    )
    return df.withColumns({"drop": F.when(both, drop), "regression": both & (drop > 0), "blocked": block, "reread": again, "warned": warn, "reason": reason})


def with_previous(history: DataFrame, keys: list[str], order: list[str], value: str = "progress") -> DataFrame:
    """history with the value of the row before it, per key."""
    return history.withColumn("previous", F.lag(value).over(Window.partitionBy(*keys).orderBy(*order)))


def regression_gate(df: DataFrame, enabled: bool = True, force: bool = False, t: Thresholds = Thresholds()) -> DataFrame:
    """Adds gate: skip where a regression is blocked; off when disabled or forced, and for a first run
    (first_run) without an earlier read."""
    on = F.lit(enabled and not force) & ~(F.col("first_run") & F.col("previous").isNull())
    return analyze_regression(df, t).withColumn("gate", F.when(on & F.col("blocked"), "skip").otherwise("pass"))


def summarize(df: DataFrame) -> DataFrame:
    """Adds progress_valid, shown, complete, zero and place."""
    out = detect_completion(validate_progress(df))
    unit = F.when(F.col("fmt") == "audiobook", "seconds").otherwise("pages")
    return out.withColumns(
        {
            "shown": F.coalesce(F.format_string("%.1f%%", F.floor(F.col("progress_valid") * 10 + 0.5) / 10), F.lit("N/A")),
            "zero": is_zero(F.col("progress_valid")),
            "place": to_position(F.col("progress_valid"), F.col("total"), unit),
        }
    )


def plan_read_sessions(df: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """Adds session: new where the latest read (finished_at, read_position, read_total) is finished or
    this is a re-read, regression for a drop worth a warning, else update."""
    ratio = F.col("position") / F.nullif(F.col("read_position"), F.lit(0))
    guess = F.when(ratio > 3, F.least(F.lit(95.0), 25 * ratio))
    old = F.coalesce(F.when(F.col("read_total") > 0, F.col("read_position") / F.col("read_total") * 100), guess)
    new = percent(F.col("progress"))
    drop = old - new
    return df.withColumn("before", old).withColumn(
        "session",
        F.when(F.col("read_id").isNull() | F.col("finished_at").isNotNull(), "new").when((old >= t.reread_from) & (new <= t.reread_to), "new").when(drop >= t.session_warn, "regression").otherwise("update"),
    )


def plan_status(df: DataFrame) -> DataFrame:
    """Adds next_status: finished 3; any progress on a wanted item 2; an item that isn't there yet 2."""
    return df.withColumn("next_status", F.when(F.coalesce("complete", F.lit(False)), 3).when(F.col("status_id").isNull() | (F.col("status_id") == 1), 2).otherwise(F.col("status_id")))


def latest_records(records: DataFrame) -> DataFrame:
    """One progress record per (user_id, item_id): an ordered fold in which a newly finished record
    replaces an unfinished one, and otherwise a record that is not older replaces the one before.
    Episode rows don't count."""
    own = F.struct("pos", "last_update", "progress_ratio", F.coalesce("is_finished", F.lit(False)).alias("is_finished"))
    ordered = F.sort_array(F.collect_list(own))

    def step(held: Column, r: Column) -> Column:
        newly = r["is_finished"] & ~held["is_finished"]
        return F.when(newly | (F.coalesce(r["last_update"], F.lit(0).cast("timestamp")) >= F.coalesce(held["last_update"], F.lit(0).cast("timestamp"))), r).otherwise(held)

    return (
        records.where(F.col("episode_id").isNull())
        .select("user_id", "item_id", "pos", F.col("last_update").cast("timestamp").alias("last_update"), "progress_ratio", "is_finished")
        .groupBy("user_id", "item_id")
        .agg(ordered.alias("r"))
        .withColumn("r", F.aggregate(F.slice("r", F.lit(2), F.size("r")), F.get("r", F.lit(0)), step))
        .select("user_id", "item_id", "r.*")
    )


def newest_first(records: DataFrame, n: int, key: str = "user_id") -> DataFrame:
    """The n newest records per user."""
    order = Window.partitionBy(key).orderBy(F.desc(F.coalesce(F.col("last_update").cast("timestamp"), F.lit(0).cast("timestamp"))), "pos")
    return records.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
