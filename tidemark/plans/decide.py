"""The per-item decision table and its follow-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import formats as P
from ..operators import progress as G
from ..operators.progress import Thresholds


def decide(items: DataFrame, t: Thresholds = Thresholds(), auto_add: bool = True, delay: bool = False) -> DataFrame:
    """items -> status and reason, by the first rule that holds. Columns read: progress, is_finished,
    fmt, position, total, previous, remembered_skip, unchanged, match_tier, capable, needs_sync,
    first_run, status_id."""
    staged = G.regression_gate(G.detect_completion(G.validate_progress(G.below_minimum(items, t)), t), t=t)
    rules = [
        (F.col("below_minimum"), "skipped", "below_threshold"),
        (F.col("remembered_skip").isNotNull(), "skipped", None),
        (F.col("unchanged"), "skipped", "unchanged"),
        (F.col("match_tier").isNull(), "skipped", "not_found"),
        (F.col("progress_valid").isNull(), "skipped", "invalid_progress"),
        ((F.col("match_tier") == "search") & ~F.lit(auto_add), "skipped", "auto_add_off"),
        ((F.col("match_tier") == "search") & ~F.col("capable"), "skipped", "no_length"),
        (F.col("match_tier") == "search", "auto_added", "added"),
        (~F.col("needs_sync"), "skipped", "up_to_date"),
        (F.lit(delay) & ~F.col("complete"), "delayed", "session_open"),
        (F.col("gate") == "skip", "skipped", "regression"),
        (F.col("complete") & (F.col("status_id") == 3), "completed", "remembered"),
        (F.col("complete"), "completed", "finished"),
    ]
    status = reason = None
    for condition, s, r in rules:
        condition = F.coalesce(condition, F.lit(False))
        said = F.col("remembered_skip") if r is None else F.lit(r)
        status = F.when(condition, s) if status is None else status.when(condition, s)
        reason = F.when(condition, said) if reason is None else reason.when(condition, said)
    out = staged.withColumns({"status": status.otherwise("synced"), "reason": reason.otherwise("progress")})
    return out.select(*items.columns, "progress_valid", "complete", "status", "reason")


def planned_writes(decided: DataFrame) -> DataFrame:
    """Rows of the planned-actions table: add, set_status, update_read or insert_read, complete."""
    act = F.col("status")
    actions = F.array_compact(
        F.array(
            F.when(act == "auto_added", "add"),
            F.when(act.isin("synced", "completed") & (F.col("status_id") == 1), "set_status"),
            F.when((act == "synced") & F.col("previous").isNull(), "insert_read").when(act == "synced", "update_read"),
            F.when((act == "completed") & (F.col("reason") != "remembered"), "complete"),
        )
    )
    unit = F.when(F.col("fmt") == "audiobook", "seconds").otherwise("pages")
    return decided.withColumn("position_to", G.to_position(F.col("progress_valid"), F.col("total"), unit)).select(
        "user_id", "item_id", "book_id", "edition_id", "progress_valid", "position_to", F.posexplode(actions).alias("step", "action")
    )


def compatible(source_format, edition_format):
    """Only an audiobook against a book is incompatible; no source format fits all."""
    return ~F.coalesce((source_format == "audiobook") & (edition_format == "book"), F.lit(False))


def plan_additions(candidates: DataFrame, owned: DataFrame, remembered: DataFrame) -> DataFrame:
    """candidates (item_id, fmt, match_type, book_id, reading_format, audio_seconds, pages, edition_score,
    edition_id) -> per item: outcome add, skip or fail, with reason and edition."""
    c = candidates.withColumn("_fmt", P.internal_format(F.col("reading_format"), F.col("audio_seconds")))
    c = c.withColumn("_fits", compatible(F.col("fmt"), F.col("_fmt"))).withColumn("_capable", F.coalesce(F.col("audio_seconds") > 0, F.lit(False)) | F.coalesce(F.col("pages") > 0, F.lit(False)))
    c = c.join(owned.select("book_id", F.lit(True).alias("_owned")).distinct(), "book_id", "left")
    rank = F.struct(F.when(F.col("match_type") == "asin", 0).when(F.col("match_type") == "isbn", 1).otherwise(2), -F.col("edition_score"), "edition_id")
    usable = F.col("_fits")
    best = c.groupBy("item_id").agg(
        F.bool_or("_fits").alias("_any"),
        F.bool_or(F.col("_fits") & F.col("_owned").isNotNull()).alias("_mine"),
        F.min_by(F.struct("book_id", "edition_id", "_capable"), F.when(usable, rank)).alias("b"),
    )
    best = best.join(remembered.select("item_id", F.lit(True).alias("_known")).distinct(), "item_id", "left")
    outcome = F.when(F.col("_known").isNotNull(), "skip").when(~F.col("_any"), "fail").when(F.col("_mine"), "skip").when(~F.col("b._capable"), "skip").otherwise("add")
    reason = F.when(F.col("_known").isNotNull(), "remembered").when(~F.col("_any"), "NOT_FOUND").when(F.col("_mine"), "ALREADY_IN_LIBRARY").when(~F.col("b._capable"), "no_length").otherwise("best_edition")
    return best.select("item_id", outcome.alias("outcome"), reason.alias("reason"), "b.book_id", "b.edition_id")
