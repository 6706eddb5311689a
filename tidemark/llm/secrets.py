"""Secret scans with corpus-wide ownership frequency. DataFrame functions only.

Base kinds are found by their pattern alone. Further candidates (bearer tokens, long mixed-case
strings) become spans of kind `owned` only if their value is held by few distinct owners in the
whole corpus: a value copied by many owners is an example, one that few own looks live. Every base
span gets the same label, as a column, but stays a span either way.

Spans are (kind, start, end) in code points, end exclusive; within one kind they don't overlap.
Defined cases: null or empty text: no spans; very long texts and texts with very many spans: whole, in
time in proportion to them; a null owner or repository counts as one of its own; ties: two spans with one
start are ordered as the kinds are listed; repeated rows: each gets the same result and counts once per
owner and repository; empty table: no rows; other columns, whatever their names, are ignored by
scan_secrets and kept by mask_secrets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, let, row_hash, running

# The base kinds in their order, pattern, group that holds the value, least length of it.
# Where the value ends a match, the least length is in the pattern.
BASE = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: Candidates of kind `owned`: pattern, group of the value, least length.
EXTRA = (
    ("bearer", r"(?i:bearer)\x20+([A-Za-z0-9._~+/=-]+)", 1, 16),
    ("mixed", r"[A-Za-z0-9+/_-]{24,}", 0, 24),
)
ORDER = ("assign", "access", "hex", "owned")
#: A value held by more distinct owners, or repositories, than these is an example.
MAX_OWNERS, MAX_REPOSITORIES = 2, 20

#: begin and stop are the places in bytes of UTF-8.
SPAN = "array<struct<start:bigint,ord:int,end:bigint,value:string,kind:string,begin:bigint,stop:bigint>>"


def _none() -> Column:
    return F.array().cast(SPAN)


def _spans(text: Column, kind: str, order: int, pattern: str, group: int, least: int) -> Column:
    """The matches of pattern whose value has `least` characters, with their places: the pieces
    between the matches give the places."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    pieces = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
    parts = F.arrays_zip(pieces.alias("piece"), found.alias("match"), values.alias("value"))

    def place(own: Column) -> Column:
        ends = lambda length: running(F.transform(own, lambda m: (length(m["piece"]) + length(m["match"])).cast("bigint")), lambda at, n: at + n)

        def span(at: Column):
            return lambda m, i: F.struct(
                (F.get(at["chars"], i) - F.char_length(m["match"])).cast("bigint").alias("start"),
                F.lit(order).alias("ord"),
                F.get(at["chars"], i).alias("end"),
                m["value"].alias("value"),
                F.lit(kind).alias("kind"),
                (F.get(at["bytes"], i) - F.octet_length(m["match"])).cast("bigint").alias("begin"),
                F.get(at["bytes"], i).alias("stop"),
            )

        both = F.struct(ends(F.char_length).alias("chars"), ends(F.octet_length).alias("bytes"))
        return F.filter(let(both, lambda at: F.transform(own, span(at))), lambda s: F.char_length(s["value"]) >= least)

    return F.when(F.regexp_like(text, F.lit(_probe(pattern, least))), let(parts, place)).otherwise(_none()).cast(SPAN)


def _probe(pattern: str, least: int) -> str:
    """A pattern that every text with such a span has: the last run with its least length."""
    return pattern.replace("=-]+)", f"=-]{{{least},}})")


def candidates(docs: DataFrame, owner: str = "source", repository: str = "doc_id") -> DataFrame:
    """-> doc_id, key (hash of the text), _owner, _repo, base spans, extra candidate spans."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = F.concat(*[_spans(text, kind, i, p, g, n) for i, (kind, p, g, n) in enumerate(BASE)])
    extra = F.concat(*[_spans(text, kind, len(BASE) + i, p, g, n) for i, (kind, p, g, n) in enumerate(EXTRA)])
    mixed = F.filter(extra, lambda s: (s["kind"] != "mixed") | (s["value"].rlike("[0-9]") & s["value"].rlike("[A-Z]") & s["value"].rlike("[a-z]")))
    return docs.select(
        F.col("doc_id"),
        row_hash().alias("key"),
        F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("_owner"),
        F.coalesce(F.col(repository).cast("string"), F.lit("")).alias("_repo"),
        base.alias("base"),
        mixed.alias("extra"),
    )


def ownership(found: DataFrame, max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """-> value_hash, n_owners, n_repositories, live. Triples of value, owner and repository are counted
    once before the values meet, so a value in a third of all documents arrives as few rows."""
    seen = found.select("_owner", "_repo", F.explode(F.concat("base", "extra")).alias("s")).select(F.sha2(F.col("s.value"), 256).alias("value_hash"), "_owner", "_repo")
    return (
        seen.groupBy("value_hash")
        .agg(F.count_distinct("_owner").alias("n_owners"), F.count_distinct("_repo").alias("n_repositories"))
        .withColumn("live", (F.col("n_owners") <= max_owners) & (F.col("n_repositories") <= max_repositories))
    )


def _scanned(docs: DataFrame, scratch: Scratch, owner: str, repository: str, max_owners: int, max_repositories: int) -> DataFrame:
    """See scan_secrets; reads tables in scratch."""
    found = scratch.store(candidates(docs, owner, repository))
    # Stored, so that adaptive execution can split a value that a third of all documents hold.
    live = scratch.store(ownership(found, max_owners, max_repositories).where("live").select("value_hash"))
    each = (
        found.where(F.size("base") + F.size("extra") > 0)
        .select("doc_id", "key", "base", "extra")
        .dropDuplicates(["doc_id", "key"])
        .select("doc_id", "key", F.explode(F.concat("base", "extra")).alias("s"))
        .withColumn("value_hash", F.sha2(F.col("s.value"), 256))
        .join(live, "value_hash", "left_semi")
    )
    owned = lambda s: F.struct(s["start"].alias("start"), F.lit(len(BASE)).alias("ord"), s["end"].alias("end"), s["value"].alias("value"), F.lit("owned").alias("kind"), s["begin"].alias("begin"), s["stop"].alias("stop"))
    added = F.array_compact(F.collect_list(F.when(F.col("s.ord") >= len(BASE), owned(F.col("s")))))
    labels = scratch.store(each.groupBy(F.col("doc_id").alias("of"), F.col("key").alias("of_key")).agg(added.alias("added"), F.count("*").alias("n_live")))
    n = F.size("base") + F.size("extra")
    some = found.where(n > 0).join(labels, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("key") == F.col("of_key")), "left")
    none = found.where(n == 0).withColumns({"added": _none(), "n_live": F.lit(0).cast("long")})
    # Equal ones stand together once sorted; array_distinct would compare structs pair by pair.
    spans = let(F.sort_array(F.concat("base", F.coalesce("added", _none()))), lambda own: F.filter(own, lambda x, i: (i == 0) | (x != F.get(own, i - 1))))
    n_live = F.coalesce("n_live", F.lit(0))
    return some.select(*none.columns).unionByName(none).select("doc_id", "key", F.sort_array("base").alias("base"), spans.alias("spans"), n_live.alias("n_live"), (n - n_live).cast("long").alias("n_examples"))


def scan_secrets(docs: DataFrame, owner: str = "source", repository: str = "doc_id", max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """One row per document: doc_id, key, base, spans (base and added ones by start, then kind), n_live,
    n_examples (of all spans and candidates, by ownership)."""
    return _scanned(docs, Scratch(docs.sparkSession), owner, repository, max_owners, max_repositories)


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def mask_secrets(docs: DataFrame, mask: str = "[secret]", owner: str = "source", repository: str = "doc_id", max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """docs with every span replaced by mask in text (overlapping spans: one mask) and n_chars, where
    there is one, recounted for these texts. All rows stay."""
    scratch = Scratch(docs.sparkSession)
    scanned = _scanned(docs, scratch, owner, repository, max_owners, max_repositories)
    places = F.transform("spans", lambda s: F.struct(s["begin"].alias("begin"), s["stop"].alias("stop")))
    hits = scratch.store(scanned.where(F.size("spans") > 0).dropDuplicates(["doc_id", "key"]).select(F.col("doc_id").alias("of"), F.col("key").alias("of_key"), places.alias("spans")))
    scratch.keep(hits)

    def masked(spans: Column) -> Column:
        def cut(text: Column) -> Column:
            """The text from the end of the spans before to each span, and a mask if it overlaps none of them."""
            raw, ends = text["raw"], text["ends"]
            upto = lambda i: F.coalesce(F.get(ends, i), F.lit(0))
            part = lambda at, n: F.substring(raw, (at + 1).cast("int"), n.cast("int")).cast("string")
            piece = lambda s, i: let(upto(i - 1), lambda at: F.when(s["begin"] >= at, F.concat(part(at, s["begin"] - at), F.lit(mask))).otherwise(""))
            return F.concat(F.array_join(F.transform(spans, piece), ""), part(upto(F.size(ends) - 1), F.octet_length(raw)))

        ends = running(F.transform(spans, lambda s: s["stop"]), F.greatest)
        return let(F.struct(ends.alias("ends"), F.col("row.text").cast("binary").alias("raw")), cut)

    rows = docs.select(F.struct("*").alias("row"), row_hash().alias("own_key"))
    joined = rows.join(hits, F.col("row.doc_id").eqNullSafe(F.col("of")) & (F.col("own_key") == F.col("of_key")), "left")
    joined = joined.withColumn("new", F.when(F.col("spans").isNull(), F.col("row.text")).otherwise(masked(F.col("spans"))))
    kind = {f.name: f.dataType for f in docs.schema}
    count = F.when(F.col("spans").isNull(), F.col("row.n_chars")).otherwise(F.char_length("new").cast(kind["n_chars"])) if "n_chars" in kind else None
    new = {"text": F.col("new"), "n_chars": count}
    return joined.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
