"""Statistics and summaries of libraries and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def library_statistics(items: DataFrame, minimum: float = 5.0) -> DataFrame:
    """items (user_id, progress_percent, is_finished) -> counts per user."""
    p, done = F.col("progress_percent"), F.coalesce("is_finished", F.lit(False))
    some = F.coalesce(p > 0, F.lit(False)) | done
    return items.groupBy("user_id").agg(
        F.count("*").alias("total"),
        F.count_if(some).alias("with_progress"),
        F.count_if(some & ~done).alias("in_progress"),
        F.count_if(done).alias("completed"),
        F.greatest(F.lit(0), F.count("*") - F.count_if(some)).alias("never_started"),
        F.count_if(done | F.coalesce(p > minimum, F.lit(False))).alias("passing"),
    )


def run_counters(actions: DataFrame) -> DataFrame:
    """One row per user with a column per status, and the distinct reasons of errors in order."""
    s = F.col("status")
    names = ("synced", "completed", "auto_added", "skipped", "delayed", "error")
    errors = F.array_sort(F.collect_set(F.when(s == "error", F.col("reason")))).alias("errors")
    return actions.groupBy("user_id").agg(F.count("*").alias("processed"), *[F.count_if(s == n).alias(n) for n in names], errors)


def breakdown(actions: DataFrame) -> DataFrame:
    """kind, name, n: counts by status and by reason."""
    return actions.select(F.explode(F.array(F.struct(F.lit("status").alias("kind"), F.col("status").alias("name")), F.struct(F.lit("reason").alias("kind"), F.col("reason").alias("name")))).alias("x")).groupBy("x.kind", "x.name").agg(F.count("*").alias("n"))


def state_statistics(state: DataFrame, now) -> DataFrame:
    return state.agg(F.count("*").alias("rows"), F.count_if(F.col("updated_at") > now - F.expr("interval 7 days")).alias("recent"))


def failure_categories(failed: DataFrame) -> DataFrame:
    return failed.groupBy("category").agg(F.count("*").alias("n"))


def run_summary(counters: DataFrame) -> DataFrame:
    c = F.col
    return counters.withColumns({"successful": c("synced") + c("completed") + c("auto_added"), "failures": c("error")})


def progress_changes(actions: DataFrame, now) -> DataFrame:
    """Changed rows with delta and days since the last update."""
    return actions.where(F.col("previous").isNotNull() & (F.col("progress") != F.col("previous"))).withColumns({"delta": F.col("progress") - F.col("previous"), "days": F.datediff(now, F.col("updated_at"))})


def scoring_failures(errors: DataFrame) -> DataFrame:
    """n, n_messages and the first two messages in order."""
    each = errors.groupBy("message").agg(F.count("*").alias("n"))
    least = F.min("message")
    first = each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("message").alias("n_messages"), least.alias("_a"))
    second = each.join(F.broadcast(first.select("_a")), F.col("message") > F.col("_a")).agg(least.alias("_b"))
    return first.withColumn("_k", F.lit(0)).join(F.broadcast(second.withColumn("_k", F.lit(0))), "_k").select("n", "n_messages", F.array_compact(F.array("_a", "_b")).alias("examples"))
