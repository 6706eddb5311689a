"""Writing planned actions, reports and state tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _versions(spark: SparkSession, path: str) -> list[int]:
    """The complete versions of a table, in order."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    done = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/version=*/_SUCCESS")) or []
    return sorted(int(x.getPath().getParent().getName().split("=")[1]) for x in done)


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """The newest complete version."""
    return spark.read.parquet(f"{path.rstrip('/')}/version={_versions(spark, path)[-1]}")


def write_state(state: DataFrame, path: str) -> int:
    """state as a new version beside the ones before, from which it may be derived; readers see it when it is
    complete. Returns its number."""
    version = (_versions(state.sparkSession, path) or [0])[-1] + 1
    state.write.mode("overwrite").parquet(f"{path.rstrip('/')}/version={version}")
    return version


def write_actions(actions: DataFrame, path: str) -> None:
    actions.write.mode("append").partitionBy("status").parquet(path)


def export_json(state: DataFrame, path: str) -> DataFrame:
    """State rows, newest first, as JSON lines; returns the header row (exported_at, n)."""
    state.orderBy(F.desc("updated_at")).write.mode("overwrite").json(path)
    return state.agg(F.count("*").alias("n")).withColumn("exported_at", F.current_timestamp())


# What to look at, by category of failure.
SUGGESTIONS = {
    "not_found": "add the item's ISBN or ASIN to its metadata",
    "no_edition": "add an edition of that format to the catalogue",
    "match_rejected": "check title and author of the item",
}


def failure_report(failed: DataFrame, path: str) -> DataFrame:
    """Entries by category below path, with their identifiers and a suggestion; returns the counts per
    category."""
    hint = F.create_map(*[F.lit(x) for kv in SUGGESTIONS.items() for x in kv])
    told = failed.withColumn("suggestion", F.coalesce(F.element_at(hint, F.col("category")), F.lit("see the log of the run")))
    told.write.mode("overwrite").partitionBy("category").json(path)
    return failed.groupBy("category").agg(F.count("*").alias("n"))


def dump_errors(actions: DataFrame, path: str) -> None:
    actions.where(F.col("status") == "error").write.mode("overwrite").json(path)


def verify_writes(plan: DataFrame, acknowledged: DataFrame, key: str = "action_id") -> DataFrame:
    """plan with verified: the acknowledged position is within one of the expected one, and positive
    progress was reported as such."""
    a = acknowledged.select(key, F.col("position").alias("_got"), F.col("progress").alias("_progress"))
    near = F.abs(F.col("_got") - F.col("position")) <= 1
    seen = (F.col("progress") <= 0) | F.col("_progress").isNull() | (F.col("_progress") > 0)
    return plan.join(a, key, "left").withColumn("verified", F.coalesce(near & seen, F.lit(False))).drop("_got", "_progress")
