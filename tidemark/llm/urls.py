"""URL filters with dated lists: entries become validity intervals, and an as-of join judges every
capture by the entries that are active at its fetch time.

An entry (pattern, listed, since) turns a host, and all hosts below it, on or off the list from
`since` until the next entry of the same pattern. Entries at one instant: `listed` wins. A capture is
blocked if any suffix of its host is on the list at its fetch time (start inclusive, end exclusive).

Defined cases: no host in the URL, null URL or null fetch time: never blocked; null pattern or date:
the entry is ignored; very long URLs: whole, like others, however long their host; ties: of two active patterns the longer one is the
rule; repeated captures: each gets its own result; repeated entries count once; empty list or no captures:
nothing is blocked; other columns of the captures are kept, but for host, blocked and rule, which are
replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import store


def host_of(url: Column) -> Column:
    """Lower-case host without user, port or trailing dot; '' where there is none."""
    authority = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return F.lower(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r"\.?(:[0-9]*)?$", ""))


def intervals(entries: DataFrame) -> DataFrame:
    """pattern, listed, since -> pattern, valid_from, valid_to (null: open), of listed spells only."""
    clean = entries.where(F.col("pattern").isNotNull() & F.col("since").isNotNull())
    one = clean.groupBy(F.lower("pattern").alias("pattern"), "since").agg(F.max("listed").alias("listed"))
    order = Window.partitionBy("pattern").orderBy("since")
    return one.select("pattern", "listed", F.col("since").alias("valid_from"), F.lead("since").over(order).alias("valid_to")).where("listed").drop("listed")


def temporal_filter(captures: DataFrame, entries: DataFrame, url: str = "url", at: str = "fetched_at", grain: str = "month") -> DataFrame:
    """captures with host, blocked and rule (the most specific active pattern). Intervals are cut at
    calendar months, so a capture meets only the entries of its own host and month, however long the
    history of a pattern is; the judged hosts are distinct (host, fetch time) pairs."""
    spells = intervals(entries)
    last = F.lit(captures.agg(F.max(at)).first()[0]).cast("timestamp")  # one value; null: no captures
    until = F.date_trunc(grain, F.least(F.coalesce("valid_to", last), last))
    months = F.sequence(F.date_trunc(grain, "valid_from"), F.greatest(until, F.date_trunc(grain, "valid_from")), F.expr(f"interval 1 {grain}"))
    cut = spells.select("pattern", "valid_from", "valid_to", F.explode(months).alias("_month"))
    host = host_of(F.col(url))
    asked = captures.select(host.alias("_host"), F.col(at).alias("_at")).where("_host <> '' and _at is not null").distinct()
    # A host's suffixes are looked up by the numbers of labels that patterns have: as many as the list's longest
    # pattern has at most, none of them longer than that pattern.
    named = store(cut.select("pattern").distinct().withColumn("_n", F.size(F.split("pattern", r"\."))))
    lengths = [r["_n"] for r in named.select("_n").distinct().orderBy("_n").collect()]
    labels = F.split("_host", r"\.")
    suffixes = F.explode(F.transform(F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: n <= F.size(labels)), lambda n: F.struct(n.alias("_n"), F.array_join(F.slice(labels, -n, n), ".").alias("pattern"))))
    # Suffixes that no entry names go before captures meet; the patterns are stored, so that Spark knows their size.
    suffixed = asked.select("_host").distinct().select("_host", suffixes.alias("x")).select("_host", "x.*").join(named, ["pattern", "_n"], "left_semi")
    hits = (
        asked.withColumn("_month", F.date_trunc(grain, "_at"))
        .join(suffixed, "_host")
        .join(cut, ["pattern", "_month"])
        .where((F.col("_at") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("_at") < F.col("valid_to"))))
        .groupBy("_host", "_at")
        .agg(F.max_by("pattern", "_n").alias("_rule"))
        .select("_host", F.col("_at").alias("_hit_at"), "_rule")
    )
    # Stored, so that the join below may split a crowded (host, time) or broadcast: an aggregate can do neither.
    hits = store(hits)
    rows = captures.select(F.struct("*").alias("row"), host.alias("host"), F.col(at).alias("own_at"))
    met = rows.where("host <> ''").join(hits, (F.col("host") == F.col("_host")) & (F.col("own_at") == F.col("_hit_at")), "left").select("row", "host", "_rule")
    met = met.unionByName(rows.where("host = ''").select("row", "host", F.lit(None).cast("string").alias("_rule")))
    mine = [F.col(f"row.`{c}`").alias(c) for c in captures.columns if c not in ("host", "blocked", "rule")]
    return met.select(*mine, "host", F.col("_rule").isNotNull().alias("blocked"), F.col("_rule").alias("rule"))
