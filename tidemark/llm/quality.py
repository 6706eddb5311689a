"""Quality rules: measures of every text, fixed base limits, and a short-circuit cascade of rules
whose order follows rejection per cost, both estimated on a sample. DataFrame functions only.

quality_filter measures a text only as far as the rules need that are tried before one rejects it; the
costly repeated windows are measured for what the cheap rules leave. cascade adds all measures, so there
only the rules' conditions are cut short.

Defined cases: null or empty text: no words (so base_failed); very long texts: whole, like others; ties:
rules with equal rejection per cost keep their declared order; repeated rows: each gets its own result;
empty table: empty result, rules stay in their declared order; other columns are kept, but for those
with a measure's name, which cascade replaces. The sample decides only the order in which rules are
tried, never a verdict: a text is kept if no rule rejects it, whatever the order; `reason` names the
first rule in that order.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, words

SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5

#: What a rule may use: text, words (an array) and the measures, by name.
Parts = Mapping[str, Column]


@dataclass(frozen=True)
class Rule:
    """A condition under which a text is rejected, and about how many characters, words or lines are gone
    through to find that out, both in terms of the parts of a text."""

    name: str
    rejects: Callable[[Parts], Column]
    cost: Callable[[Parts], Column]


def default_rules() -> list[Rule]:
    count = lambda p, pattern: F.regexp_count(p["text"], F.lit(pattern))
    chars = lambda p: F.char_length(p["text"])
    return [
        Rule("shouting", lambda p: 2 * count(p, "[A-Z]") > count(p, "[A-Za-z]"), lambda p: 2 * chars(p)),
        Rule("exclamations", lambda p: 2 * count(p, "!") > p["n_words"], chars),
        Rule("symbols", lambda p: 100 * p["n_symbols"] > 20 * p["n_words"], chars),
        Rule("word_length", lambda p: (p["word_chars"] < 2 * p["n_words"]) | (p["word_chars"] > 20 * p["n_words"]), lambda p: F.size(p["words"]) + chars(p)),
        Rule("dup_lines", lambda p: 100 * p["n_dup_lines"] > 40 * (count(p, "\n") + 1), lambda p: 3 * chars(p)),
    ]


def base_rules() -> list[Rule]:
    """The fixed limits, as rules of the same kind."""
    return [
        Rule("base", lambda p: p["n_words"] < 10, lambda p: F.lit(1)),
        Rule("base", lambda p: 100 * p["n_repeat_words"] > 20 * p["n_words"], lambda p: 60 * F.size(p["words"])),
    ]


def _repeat_words(w: Column) -> Column:
    """Words inside WINDOW-word windows that occur twice or more in the array w. Equal hashes only
    pick the texts whose windows are then compared as strings."""
    n = F.size(w)
    starts = F.sequence(F.lit(0), n - WINDOW)
    hashes = F.transform(starts, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))
    keyed = F.sort_array(F.transform(starts, lambda i: F.struct(F.concat_ws(" ", *[F.get(w, i + k) for k in range(WINDOW)]).alias("k"), i.alias("i"))))

    def covered(s: Column) -> Column:
        again = F.filter(s, lambda e, j: (e["k"] == F.get(s, j + 1)["k"]) | ((j > 0) & (e["k"] == F.get(s, F.greatest(j - 1, F.lit(0)))["k"])))
        at = F.sort_array(F.transform(again, lambda e: e["i"]))
        return let(at, lambda p: F.aggregate(F.transform(p, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(p, j + 1), x + WINDOW) - x)), F.lit(0), lambda a, b: a + b))

    repeats = let(hashes, lambda h: F.size(F.array_distinct(h)) < F.size(h))
    return F.when(n < WINDOW + 1, 0).when(~repeats, 0).otherwise(let(keyed, covered))


def measures(text: Column, w: Column) -> dict[str, Column]:
    """The measures of a text without null and its words."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return {
        "n_words": F.size(w).cast("long"),
        "word_chars": F.char_length(F.array_join(w, "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": let(w, _repeat_words).cast("long"),
    }


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measure(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and base_failed."""
    text = F.coalesce(F.col("text"), F.lit(""))
    keep = [c for c in docs.columns if c not in (*MEASURES, "base_failed")]
    names = iter(range(len(keep) + 1))
    w = next(name for i in names if (name := f"_words{i}") not in keep)
    counted = docs.select(*keep, words("text").alias(w)).select(*keep, *[c.alias(name) for name, c in measures(text, F.col(w)).items()])
    return counted.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def order_rules(docs: DataFrame, rules: Sequence[Rule], sample_rows: int = 2000) -> list[Rule]:
    """The rules by estimated rejection per cost, on about sample_rows rows picked by a hash of doc_id; one
    pass over the sample adds up both for every rule, so the order repeats from run to run."""
    total = docs.count()
    if not total:
        return list(rules)
    below = min(-(1 << 63) + int(sample_rows / total * (1 << 64)), (1 << 63) - 1)
    sample = docs.where(F.xxhash64("doc_id") <= below).select(F.coalesce("text", F.lit("")).alias("text"), words("text").alias("words"))
    sample = sample.select("*", *[c.alias(name) for name, c in measures(F.col("text"), F.col("words")).items()])
    parts = {c: F.col(c) for c in sample.columns}
    sums = [F.sum(x) for r in rules for x in (F.coalesce(r.rejects(parts), F.lit(False)).cast("long"), r.cost(parts).cast("double"))]
    row = sample.agg(*[x.alias(str(i)) for i, x in enumerate(sums)]).first()
    gain = [(row[2 * i] or 0) / max(row[2 * i + 1] or 0.0, 1.0) for i in range(len(rules))]
    return [rules[i] for i in sorted(range(len(rules)), key=lambda i: -gain[i])]


def cascade(docs: DataFrame, rules: Sequence[Rule] | None = None, sample_rows: int = 2000) -> DataFrame:
    """Adds the measures, reason (null: none) and kept. Rules are tried in estimated order; CASE WHEN
    stops at the first that rejects."""
    measured = measure(docs)
    parts = {"text": F.coalesce(F.col("text"), F.lit("")), "words": words("text")} | {c: F.col(c) for c in MEASURES}
    reason = F.when(F.col("base_failed"), F.lit("base"))
    for rule in order_rules(docs, default_rules() if rules is None else rules, sample_rows):
        reason = reason.when(rule.rejects(parts), F.lit(rule.name))
    return measured.withColumn("reason", reason).withColumn("kept", F.col("reason").isNull())


def quality_filter(docs: DataFrame, rules: Sequence[Rule] | None = None, sample_rows: int = 2000) -> DataFrame:
    """The documents that the cascade keeps, with their own columns; the base limits are rules among the
    others, and no measure is taken before its rule's turn."""
    ordered = order_rules(docs, [*base_rules(), *(default_rules() if rules is None else rules)], sample_rows)
    text = F.coalesce(F.col("text"), F.lit(""))

    def rejected(w: Column) -> Column:
        parts = {"text": text, "words": w} | measures(text, w)
        out = F.when(ordered[0].rejects(parts), True)
        for rule in ordered[1:]:
            out = out.when(rule.rejects(parts), True)
        return out.otherwise(False)

    return docs.where(~let(words("text"), rejected))
