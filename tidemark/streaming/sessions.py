"""Delayed progress updates: sessions per (user_id, item_id), in batch and as stream state."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Seconds by which events may come late.
LATENESS = 3600
MILESTONES = (25, 50, 75, 90, 95, 100)


@dataclass(frozen=True)
class SessionOptions:
    """Seconds; timeout 60-7200, max_delay 300-86400, timeout below max_delay."""

    timeout: int = 900
    max_delay: int = 3600
    significant: float = 5.0
    enabled: bool = True
    immediate_completion: bool = True

    def __post_init__(self):
        if not (60 <= self.timeout <= 7200 and 300 <= self.max_delay <= 86400 and self.timeout < self.max_delay):
            raise ValueError("timeout must be 60-7200 s, max_delay 300-86400 s, and timeout below max_delay")


def significant(old: Column, new: Column, known: Column, o: SessionOptions) -> Column:
    """A jump of at least o.significant, or over a milestone; always for unknown rows."""
    crossed = F.exists(F.array(*[F.lit(float(m)) for m in MILESTONES]), lambda m: (old < m) & (new >= m))
    return ~known | (F.abs(new - old) >= o.significant) | crossed


def delay_decision(df: DataFrame, now: Column, o: SessionOptions = SessionOptions()) -> DataFrame:
    """df (progress, pending, stored, last_external, complete, known) with decision and why. A pending
    progress of 0 is no baseline."""
    baseline = F.coalesce(F.nullif("pending", F.lit(0.0)), "stored", F.lit(0.0))
    overdue = F.coalesce(F.unix_timestamp(now) - F.unix_timestamp("last_external") >= o.max_delay, F.lit(False))
    why = (
        F.when(~F.lit(o.enabled), "disabled")
        .when(F.col("complete") & F.lit(o.immediate_completion), "complete")
        .when(overdue, "max_delay")
        .when(significant(baseline, F.col("progress"), F.col("known"), o), "significant")
        .otherwise("session_open")
    )
    return df.withColumn("why", why).withColumn("decision", F.when(F.col("why") == "session_open", "delay").otherwise("now"))


def update_sessions(state: DataFrame, updates: DataFrame, now: Column) -> DataFrame:
    """Pending progress of known rows is replaced and the session marked active; unknown updates are dropped."""
    u = updates.select("user_id", "item_id", F.col("progress").alias("_p"))
    j = state.join(u, ["user_id", "item_id"], "left")
    hit = F.col("_p").isNotNull()
    keep = [c for c in state.columns if c not in ("pending", "last_change", "active")]
    return j.select(*keep, F.when(hit, F.col("_p")).otherwise(F.col("pending")).alias("pending"), F.when(hit, now).otherwise(F.col("last_change")).alias("last_change"), (hit | F.col("active")).alias("active"))


def expired_sessions(state: DataFrame, now: Column, o: SessionOptions = SessionOptions()) -> DataFrame:
    return state.where(F.col("active") & (F.unix_timestamp("last_change") < F.unix_timestamp(now) - o.timeout))


def complete_sessions(state: DataFrame, done: DataFrame, now: Column) -> DataFrame:
    """Sessions in done are cleared: their progress is stored and the last sync is now."""
    d = done.select("user_id", "item_id", F.lit(True).alias("_d"))
    j = state.join(d, ["user_id", "item_id"], "left")
    hit = F.col("_d").isNotNull()
    keep = [c for c in state.columns if c not in ("stored", "pending", "active", "last_external")]
    return j.select(
        *keep,
        F.when(hit, F.coalesce("pending", "stored")).otherwise(F.col("stored")).alias("stored"),
        F.when(~hit, F.col("pending")).alias("pending"),
        (F.col("active") & ~hit).alias("active"),
        F.when(hit, now).otherwise(F.col("last_external")).alias("last_external"),
    )


def flush_expired(state: DataFrame, now: Column, o: SessionOptions = SessionOptions()) -> tuple[DataFrame, DataFrame]:
    """(state after the flush, found and processed counts per user) over all users."""
    gone = expired_sessions(state, now, o)
    counts = state.where("active").groupBy("user_id").agg(F.count("*").alias("found"), F.count_if(F.unix_timestamp("last_change") < F.unix_timestamp(now) - o.timeout).alias("processed"))
    return complete_sessions(state, gone, now), counts


def sessionize(events: DataFrame, gap_seconds: int = 900) -> DataFrame:
    """Batch: user_id, item_id, session start and end, first and last progress, events. A session ends
    when nothing comes for gap_seconds."""
    w = Window.partitionBy("user_id", "item_id").orderBy("ts", "pos")
    at = F.col("ts").cast("timestamp")
    new = F.coalesce((F.unix_micros(at) - F.unix_micros(F.lag(at).over(w)) > gap_seconds * 1_000_000).cast("int"), F.lit(1))
    numbered = events.withColumn("ts", at).withColumn("_new", new).withColumn("_s", F.sum("_new").over(w))
    return numbered.groupBy("user_id", "item_id", "_s").agg(
        F.min("ts").alias("session_start"), F.max("ts").alias("session_end"), F.min_by("progress", F.struct("ts", "pos")).alias("first_progress"),
        F.max_by("progress", F.struct("ts", "pos")).alias("last_progress"), F.count("*").alias("n_events"),
    ).drop("_s")


def stream_sessions(events: DataFrame, gap: str = "15 minutes", lateness: str = "1 hour") -> DataFrame:
    """The same sessions from a stream; rows later than the watermark are dropped by Spark."""
    return (
        events.withWatermark("ts", lateness)
        .groupBy("user_id", "item_id", F.session_window("ts", gap).alias("w"))
        .agg(F.min_by("progress", F.struct("ts", "pos")).alias("first_progress"), F.max_by("progress", F.struct("ts", "pos")).alias("last_progress"), F.count("*").alias("n_events"), F.max("ts").alias("session_end"))
        .select("user_id", "item_id", F.col("w.start").alias("session_start"), "session_end", "first_progress", "last_progress", "n_events")
    )


def active_sessions(state: DataFrame) -> DataFrame:
    """user_id, item_id, pending, last_change of the sessions that are open."""
    return state.where("active").select("user_id", "item_id", "pending", "last_change")


def has_active(state: DataFrame) -> DataFrame:
    """user_id, has_active, for every user with state."""
    return state.groupBy("user_id").agg(F.bool_or("active").alias("has_active"))


FLUSHED = "user_id long, item_id long, progress double, n_updates long, why string"


def delayed_updates(events: DataFrame, o: SessionOptions = SessionOptions()) -> DataFrame:
    """Stateful stream (user_id, item_id, ts, progress): emits a row when an update must go out at once
    (complete, max_delay since the last one that went out, or significant) and when a session has been silent
    for the timeout, in event time. What went out last stays in the state and is what later updates are
    compared with, as delay_decision does in batch."""
    state = "stored double, pending double, n long, sent long"

    def step(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        stored, pending, n, sent = held.get if held.exists else (None, None, 0, None)
        out: list[tuple] = []
        if held.hasTimedOut:
            if n:
                out.append((*key, pending, n, "expired"))
                stored, sent = pending, held.getCurrentWatermarkMs()
            held.update((stored, None, 0, sent))
        else:
            newest = 0
            for row in sorted((r for f in frames for r in f[["ts", "progress"]].itertuples(index=False)), key=lambda r: r.ts):
                at = int(row.ts.timestamp() * 1000)
                newest = max(newest, at)
                old = pending or stored or 0.0
                pending, n = row.progress, n + 1
                if o.immediate_completion and pending >= 100:
                    why = "complete"
                elif sent is not None and at - sent >= o.max_delay * 1000:
                    why = "max_delay"
                elif stored is None or abs(pending - old) >= o.significant or any(old < m <= pending for m in MILESTONES):
                    why = "significant"
                else:
                    why = None
                if why:
                    out.append((*key, pending, n, why))
                    stored, pending, n, sent = pending, None, 0, at
            held.update((stored, pending, n, sent))
            if n:
                held.setTimeoutTimestamp(max(newest + o.timeout * 1000, held.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["user_id", "item_id", "progress", "n_updates", "why"])

    return events.withWatermark("ts", "1 hour").groupBy("user_id", "item_id").applyInPandasWithState(step, FLUSHED, state, "append", GroupStateTimeout.EventTimeTimeout)


def acknowledged_updates(events: DataFrame, acks: DataFrame, o: SessionOptions = SessionOptions()) -> DataFrame:
    """As delayed_updates, for deliveries that may fail: a session that has been silent for the timeout is
    offered (why 'expired', with the time of the offer as `at`) and stays open until acks (user_id, item_id, ts,
    progress), a second stream, tells that its progress arrived; until then it is offered again after each further
    timeout. Only what is acknowledged becomes the stored progress. An acknowledgement of an older progress leaves
    the newer one pending. Delivery is at least once: an acknowledgement that is an hour late in event time is lost,
    and its session is offered again."""
    state = "stored double, pending double, n long, sent long"

    def step(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        stored, pending, n, sent = held.get if held.exists else (None, None, 0, None)
        clock, newest, out = held.getCurrentWatermarkMs(), 0, []
        if held.hasTimedOut:
            if n:
                out.append((*key, pending, n, "expired", pd.Timestamp(clock, unit="ms")))
        else:
            rows = (r for f in frames for r in f[["ts", "progress", "acked"]].itertuples(index=False))
            for row in sorted(rows, key=lambda r: (r.ts, r.acked)):
                at = int(row.ts.timestamp() * 1000)
                newest = max(newest, at)
                if row.acked:
                    stored, sent = row.progress, at
                    if n and pending == row.progress:
                        pending, n = None, 0
                    continue
                old = pending or stored or 0.0
                pending, n = row.progress, n + 1
                if o.immediate_completion and pending >= 100:
                    why = "complete"
                elif sent is not None and at - sent >= o.max_delay * 1000:
                    why = "max_delay"
                elif stored is None or abs(pending - old) >= o.significant or any(old < m <= pending for m in MILESTONES):
                    why = "significant"
                else:
                    continue
                out.append((*key, pending, n, why, row.ts))
        held.update((stored, pending, n, sent))
        if n:
            held.setTimeoutTimestamp(max(newest, clock) + o.timeout * 1000)
        yield pd.DataFrame(out, columns=["user_id", "item_id", "progress", "n_updates", "why", "at"])

    columns = ["user_id", "item_id", "ts", "progress"]
    both = events.select(*columns, F.lit(False).alias("acked")).unionByName(acks.select(*columns, F.lit(True).alias("acked")))
    grouped = both.withWatermark("ts", f"{LATENESS} seconds").groupBy("user_id", "item_id")
    return grouped.applyInPandasWithState(step, f"{FLUSHED}, at timestamp", state, "append", GroupStateTimeout.EventTimeTimeout)


def deliver_acknowledged(deliver: Callable[[DataFrame], DataFrame], acks: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch on acknowledged_updates: hands what must go out to deliver, which returns it with `sent`,
    and writes an acknowledgement below acks, a folder that the second stream reads, for what was sent. A failing
    row gets none, so its session stays open. A batch that is run again writes its files anew; an
    acknowledgement that is read twice changes nothing."""

    def batch(rows: DataFrame, number: int) -> None:
        done = deliver(rows).where("sent")
        # As late as any event may be now, so that it neither moves the clock nor comes late.
        ts = F.timestamp_seconds(F.unix_timestamp("at") + F.when(F.col("why") == "expired", F.lit(LATENESS)).otherwise(0))
        done.select("user_id", "item_id", ts.alias("ts"), "progress").write.mode("append").parquet(acks)

    return batch


def deliver_expired(deliver: Callable[[DataFrame], DataFrame], counts: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: hands the expired sessions of a batch to deliver, which returns them with `sent`, and
    appends how many were found, processed and failed, per user, below counts. A batch that is run again
    replaces its own counts."""

    def batch(rows: DataFrame, number: int) -> None:
        sent = deliver(rows.where("why = 'expired'"))
        done = F.coalesce(F.col("sent"), F.lit(False))
        found = sent.groupBy("user_id").agg(F.count("*").alias("found"), F.count_if(done).alias("processed"), F.count_if(~done).alias("errors"))
        found.write.mode("overwrite").parquet(f"{counts.rstrip('/')}/batch={number}")

    return batch
