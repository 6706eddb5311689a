"""Chat formatting: a finite-state machine over roles and a declarative template.

Turns of a conversation (rows ordered by turn, then role, then text; nulls first) become text
segments with a loss flag each. The machine reads one role after the other; `valid` says whether it
ends in an accepting state. Invalid conversations are formatted as well, so that no row is lost.

Defined cases: null role or text: empty string; very long texts: whole, like others; null conv_id: one
conversation of its own; ties: turns of one number are ordered by role, then text; repeated rows: repeated
turns; empty table: no rows; other columns, whatever their names, are ignored. DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Marks around a turn, roles that are learned, and the machine: state -> role -> next state."""

    open: str = "### "
    sep: str = ":\n"
    close: str = "</turn>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "start"
    accept: tuple[str, ...] = ("assistant",)
    moves: dict = field(
        default_factory=lambda: {
            "start": {"system": "system", "user": "user"},
            "system": {"user": "user"},
            "user": {"assistant": "assistant"},
            "assistant": {"user": "user"},
        }
    )

    @property
    def controls(self) -> tuple[str, ...]:
        return (self.open, self.close.rstrip())


def escape(text: Column, template: Template) -> Column:
    """Backslashes are doubled; a control string gets a backslash after its first character."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for mark in template.controls:
        out = F.replace(out, F.lit(mark), F.lit(f"{mark[0]}\\{mark[1:]}"))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_chat(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """-> conv_id, n_turns, state, valid, segments array<struct<text, loss>>, formatted."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    moves = F.create_map(*[F.lit(x) for state, to in template.moves.items() for role, end in to.items() for x in (f"{state}>{role}", end)])
    conv = turns.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct(F.col("turn").alias("turn"), blank("role").alias("role"), blank("text").alias("text")))).alias("_turns")
    )
    segments = F.flatten(
        F.transform(
            "_turns",
            lambda t: F.array(
                F.struct(F.concat(F.lit(template.open), F.url_encode(t["role"]), F.lit(template.sep)).alias("text"), F.lit(False).alias("loss")),
                F.struct(escape(t["text"], template).alias("text"), t["role"].isin(*template.loss_roles).alias("loss")),
                F.struct(F.lit(template.close).alias("text"), F.lit(False).alias("loss")),
            ),
        )
    )
    state = F.aggregate("_turns", F.lit(template.start), lambda s, t: F.coalesce(F.element_at(moves, F.concat(s, F.lit(">"), t["role"])), F.lit("error")))
    return (
        conv.select("conv_id", F.size("_turns").cast("long").alias("n_turns"), state.alias("state"), segments.alias("segments"))
        .withColumn("valid", F.col("state").isin(*template.accept))
        .withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))
    )


def read_back(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """Adds turns array<struct<role, text>>, parsed from `formatted` alone, and loss_text, the learned
    segments without escapes."""

    def turn(piece: Column) -> Column:
        head, at = len(template.open), F.instr(piece, template.sep)
        return F.struct(
            F.url_decode(F.substring(piece, F.lit(head + 1), at - (head + 1))).alias("role"),
            unescape(F.substring(piece, at + len(template.sep), F.char_length(piece))).alias("text"),
        )

    pieces = F.split("formatted", rf"\Q{template.close}\E", -1)
    return formatted.withColumn("_pieces", pieces).select(
        *formatted.columns,
        F.transform(F.slice("_pieces", F.lit(1), F.size("_pieces") - 1), turn).alias("turns"),
        F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "").alias("loss_text"),
    )
