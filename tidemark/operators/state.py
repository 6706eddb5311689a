"""Remembered state: merges, checks against it, what becomes stale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ("user_id", "identifier", "title")


def merge(old: DataFrame, new: DataFrame, keys: tuple[str, ...], columns: tuple[str, ...], keep_old: tuple[str, ...] = ()) -> DataFrame:
    """Upsert: `columns` come from new where it has the key (a null there overwrites), keep_old ones only
    for keys that old lacks. One shuffle of both sides on the keys."""
    o, n = old.withColumn("_o", F.lit(True)).alias("o"), new.withColumn("_n", F.lit(True)).alias("n")
    joined = o.join(n, [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys], "full_outer")
    fresh = F.col("n._n").isNotNull()
    out = [F.when(fresh, F.col(f"n.{k}")).otherwise(F.col(f"o.{k}")).alias(k) for k in keys]
    for c in old.columns:
        if c in keys:
            continue
        if c in keep_old:
            out.append(F.when(F.col("o._o").isNotNull(), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c))
        elif c in columns:
            out.append(F.when(fresh, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
        else:
            out.append(F.col(f"o.{c}"))
    return joined.select(*out)


def delete(state: DataFrame, requests: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """state without the rows that a request names."""
    return state.join(requests.select(*keys).distinct(), list(keys), "left_anti")


def expectations(rows: DataFrame) -> DataFrame:
    """Adds violations, the names of the rules that a row breaks."""
    empty = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == ""
    p = F.col("progress_percent")
    rules = {
        "user": empty("user_id"),
        "identifier": empty("identifier"),
        "title": empty("title"),
        "type": empty("identifier_type") | ~F.coalesce(F.col("identifier_type").isin("isbn", "asin", "title_author"), F.lit(False)),
        "progress": p.isNotNull() & (F.isnan(p) | (p < 0) | (p > 100)),
    }
    return rows.withColumn("violations", F.array_compact(F.array(*[F.when(v, F.lit(k)) for k, v in rules.items()])))


def state_keys(items: DataFrame) -> DataFrame:
    """user_id, item_id, identifier, identifier_type, prio: all keys under which state may be held."""
    from ..functions import formats as P
    from ..functions import text as T

    key = lambda c, kind: F.struct(c.alias("identifier"), F.lit(kind).alias("identifier_type"))
    own = F.transform(T.asins(F.col("asin_raw")), lambda k: key(k, "asin"))
    isbns = F.transform(T.isbn_variants(F.col("isbn_raw")), lambda k: key(k, "isbn"))
    keys = F.concat(own, isbns, F.array(key(P.title_author_key(F.col("title"), F.col("author")), "title_author")))
    return items.select("user_id", "item_id", F.posexplode(keys).alias("prio", "k")).select("user_id", "item_id", "k.identifier", "k.identifier_type", "prio")


def early_check(keys: DataFrame, state: DataFrame, current: DataFrame, threshold: float = 0.01) -> DataFrame:
    """user_id, item_id, verdict, edition_id of items with state: keys are tried in order of prio; an
    unchanged key skips, one without a usable edition but unchanged repairs, and otherwise the last
    changed key gives the edition."""
    j = keys.join(state, ["user_id", "identifier", "identifier_type"]).join(current.select("user_id", "item_id", "progress_now"), ["user_id", "item_id"])
    same = F.abs(F.col("progress_now") - F.col("progress_percent")) < threshold
    stop = F.when(same & F.col("edition_id").isNotNull(), "skip").when(same, "repair")
    return (
        j.withColumn("_stop", stop)
        .groupBy("user_id", "item_id")
        .agg(F.min_by("_stop", F.when(F.col("_stop").isNotNull(), F.col("prio"))).alias("_v"), F.max_by("edition_id", F.when(F.col("_stop").isNull() & F.col("edition_id").isNotNull(), F.col("prio"))).alias("edition_id"))
        .select("user_id", "item_id", F.coalesce("_v", F.lit("sync")).alias("verdict"), "edition_id")
    )


def fresh_decisions(items: DataFrame, skips: DataFrame, now: Column, tolerance: float = 0.01) -> DataFrame:
    """items joined with the negative decision that still holds for them: same key, not expired, same
    context, same progress and last-listened time."""
    j = items.alias("i").join(skips.alias("s"), ["user_id", "identifier", "identifier_type", "title"])
    holds = (
        (F.col("s.expires_at") > now)
        & F.col("i.context_hash").eqNullSafe(F.col("s.context_hash"))
        & (F.abs(F.col("i.progress_percent") - F.col("s.progress_percent")) < tolerance)
        & F.col("i.last_listened_at").eqNullSafe(F.col("s.last_listened_at"))
    )
    return j.where(holds).select("user_id", "identifier", "identifier_type", "title", "s.reason")


def needs_sync(current: DataFrame, state: DataFrame, keys: list[str], threshold: float = 0.01) -> DataFrame:
    """current with needs_sync and reason (new, progress, status, edition; comma-joined)."""
    s = state.select(*[F.col(k).alias(f"_{k}") for k in keys], F.lit(True).alias("_there"), F.col("progress_percent").alias("_p"), F.col("status_id").alias("_s"), F.col("edition_id").alias("_e"))
    j = current.join(s, [F.col(k) == F.col(f"_{k}") for k in keys], "left")
    why = F.array_compact(
        F.array(
            F.when(F.col("_there").isNull(), "new"),
            F.when(F.abs(F.col("progress_percent") - F.col("_p")) >= threshold, "progress"),
            F.when(F.col("_s") == 1, "status"),
            F.when(F.col("_there").isNotNull() & ~F.col("edition_id").eqNullSafe(F.col("_e")), "edition"),
        )
    )
    return j.select(*current.columns, (F.size(why) > 0).alias("needs_sync"), F.array_join(why, ",").alias("reason"))


def stale_mappings(state: DataFrame, owned_editions: DataFrame) -> DataFrame:
    """State rows whose edition is no longer owned."""
    own = owned_editions.select("edition_id").distinct()
    return state.where(F.col("edition_id").isNotNull()).join(own, "edition_id", "left_anti")


def repair_state(state: DataFrame, editions: DataFrame) -> DataFrame:
    """state with repair: no_edition, unknown_edition, no_length or null."""
    e = editions.select(F.col("edition_id").alias("_e"), (F.coalesce(F.col("audio_seconds") > 0, F.lit(False)) | F.coalesce(F.col("pages") > 0, F.lit(False))).alias("_len")).distinct()
    j = state.join(e, F.col("edition_id") == F.col("_e"), "left")
    why = F.when(F.col("edition_id").isNull(), "no_edition").when(F.col("_e").isNull(), "unknown_edition").when(~F.col("_len"), "no_length")
    return j.select(*state.columns, why.alias("repair"))


def priorities(items: DataFrame) -> DataFrame:
    """items (known, changed, owned, last_update) with class: 0 changed and owned, 1 unchanged, 2 changed
    and stale, 3 unresolved; and rank per user by class and newest first."""
    from pyspark.sql import Window

    c = F.when(~F.col("known"), 3).when(~F.col("changed"), 1).when(F.col("owned"), 0).otherwise(2)
    order = Window.partitionBy("user_id").orderBy("class", F.desc_nulls_last("last_update"), "item_id")
    return items.withColumn("class", c).withColumn("rank", F.row_number().over(order))


def count_runs(counters: DataFrame, runs: DataFrame) -> DataFrame:
    """user_id, runs: the old counters plus the runs of each user."""
    new = runs.groupBy("user_id").agg(F.count("*").alias("_n"))
    return counters.join(new, "user_id", "full_outer").select("user_id", (F.coalesce("runs", F.lit(0)) + F.coalesce("_n", F.lit(0))).alias("runs"))


def fingerprint(books: DataFrame, key: str = "user_id", member: str = "book_id", config: str = "") -> DataFrame:
    """key, n, digest, context_hash: they change when a member is added or removed, context_hash with the
    configuration too. Partial sums and a fixed hash; no list of all members."""
    number = F.conv(F.substring(F.md5(F.col(member).cast("string").cast("binary")), 1, 15), 16, 10).cast("long")
    own = books.select(key, member).distinct().groupBy(key).agg(F.count("*").alias("n"), F.bit_xor(number).alias("digest"))
    return own.withColumn("context_hash", F.md5(F.concat_ws("|", F.lit(config), F.col("n").cast("string"), F.col("digest").cast("string")).cast("binary")))


def decision_policy(actions: DataFrame, now: Column, ttl_days: int = 7, remembered: tuple[str, ...] = ("not_found", "match_rejected", "already_in_library"), force: bool = False) -> DataFrame:
    """Skips that are remembered, with their expiry; none when forced."""
    return actions.where((F.col("status") == "skipped") & F.col("reason").isin(*remembered) & F.lit(not force)).withColumn("expires_at", now + F.expr(f"interval {ttl_days} days"))


def upsert_mappings(state: DataFrame, mappings: DataFrame) -> DataFrame:
    """Edition mappings by (user_id, identifier, lower-case title): type, edition and time are overwritten,
    progress stays."""
    new = mappings.withColumn("title", F.lower(F.trim("title")))
    for c in state.columns:
        if c not in new.columns:
            new = new.withColumn(c, F.lit(None).cast(state.schema[c].dataType))
    return merge(state, new.select(*state.columns), KEY, ("identifier_type", "edition_id", "updated_at"))


def complete(state: DataFrame, done: DataFrame) -> DataFrame:
    """Rows in done (KEY, finished_at) get progress 100, and the time where there is one."""
    d = done.select(*KEY, F.col("finished_at").alias("_f"), F.lit(True).alias("_d"))
    j = state.join(d, list(KEY), "left")
    out = {"progress_percent": F.when(F.col("_d"), 100.0).otherwise(F.col("progress_percent")), "finished_at": F.coalesce("_f", "finished_at")}
    return j.select(*[out[c].alias(c) if c in out else F.col(c) for c in state.columns])


def multi_key_lookup(items: DataFrame, state: DataFrame) -> DataFrame:
    """items (user_id, item_id, patterns): the first pattern, in order, for which state has a complete row."""
    keys = items.select("user_id", "item_id", F.posexplode("patterns").alias("pos", "identifier"))
    rows = keys.join(state.where("edition_id is not null and progress_percent is not null"), ["user_id", "identifier"])
    return rows.groupBy("user_id", "item_id").agg(F.min_by(F.struct("identifier", "edition_id"), "pos").alias("h")).select("user_id", "item_id", "h.*")
