"""Chat formatting: a declarative template, a finite-state machine over roles, and segments with loss flags."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """What a turn looks like and which turn orders are valid.

    A control string is anything that begins with ``<|``.  Inside texts and roles each
    ``<``, backslashes, ``|`` gets one more backslash, so ``<|`` never occurs there and
    removing one backslash restores the text exactly.
    """

    start: str = "<|im_start|>"
    after_role: str = "\n"
    end: str = "<|im_end|>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    first_state: str = "start"
    accepting: tuple[str, ...] = ("answered",)
    transitions: dict[tuple[str, str], str] = field(default_factory=lambda: {
        ("start", "system"): "system",
        ("start", "user"): "asked",
        ("system", "user"): "asked",
        ("asked", "assistant"): "answered",
        ("answered", "user"): "asked",
        ("answered", "tool"): "called",
        ("called", "assistant"): "answered",
    })

    def __post_init__(self):
        if not (self.start.startswith("<|") and self.end.startswith("<|")):
            raise ValueError("turn marks must begin with <|, which texts cannot contain")


CHATML = Template()
BROKEN = "broken"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    """Roles end at a line break, so theirs are written as backslash n (and a backslash as backslash b)."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\"))


def format_conversations(turns: DataFrame, template: Template = CHATML) -> DataFrame:
    """One row per conversation: ``conv_id, n_turns, state, valid, segments, formatted``.

    ``turns`` has ``conv_id, turn, role, text``; other columns are ignored.  Turns are
    ordered by (turn, role, text), nulls first; repeated rows are turns of their own.
    Null role or text counts as empty.  A row without conv_id belongs to no other row:
    rows of that kind are conversations of their own (equal ones together).  ``segments``
    are the consecutive pieces of ``formatted`` with ``loss`` set on the texts of the loss
    roles only.  ``state`` is where the state machine ends and ``valid`` whether it
    accepts; an invalid order is formatted all the same.  An empty table gives no rows.

    A formatted conversation is one row, so a conversation has to fit into a task; the
    turns of all conversations together need not.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.select("conv_id", F.col("turn").cast("long"), role.alias("role"), text.alias("text"))
    alone = F.when(F.col("conv_id").isNull(), F.xxhash64("turn", "role", "text"))
    grouped = rows.groupBy("conv_id", alone.alias("_alone")).agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("_turns")
    )
    moves = F.create_map(*[F.lit(x) for (state, by), to in template.transitions.items() for x in (f"{state}\n{by}", to)])
    step = lambda state, t: F.coalesce(F.element_at(moves, F.concat(state, F.lit("\n"), t["role"])), F.lit(BROKEN))

    def piece(content: Column, loss: Column) -> Column:
        return F.struct(content.alias("text"), loss.alias("loss"))

    no = F.lit(False)
    segments = F.flatten(F.transform("_turns", lambda t: F.array(
        piece(F.concat(F.lit(template.start), escape_role(t["role"]), F.lit(template.after_role)), no),
        piece(escape(t["text"]), t["role"].isin(*template.loss_roles)),
        piece(F.lit(template.end), no),
    )))
    return (
        grouped.select("conv_id", F.size("_turns").cast("long").alias("n_turns"),
                       F.aggregate("_turns", F.lit(template.first_state), step).alias("state"), segments.alias("segments"))
        .withColumn("valid", F.col("state").isin(*template.accepting))
        .withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))
    )


def read_back(formatted: Column, template: Template = CHATML) -> Column:
    """The turns of a formatted conversation as array<struct<role, text>>, texts and roles unescaped."""
    parts = F.filter(F.split(formatted, re.escape(template.start)), lambda p: p != "")
    end, mark = template.end, template.after_role

    def turn(p: Column) -> Column:
        head = F.substring_index(p, mark, 1)
        body = F.substring(p, F.length(head) + 1 + len(mark), F.length(p) - F.length(head) - len(mark) - len(end))
        return F.struct(unescape_role(head).alias("role"), unescape(body).alias("text"))

    return F.transform(parts, turn)


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    kept = F.filter(segments, lambda s: s["loss"])
    return F.array_join(F.transform(kept, lambda s: unescape(s["text"])), "")


def digests(formatted: DataFrame, template: Template = CHATML) -> DataFrame:
    """What a formatted table holds, read back from it: counts and hashes per conversation."""
    turns = F.array_join(F.transform(read_back(F.col("formatted"), template),
                                     lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return formatted.select(
        "conv_id",
        F.size(read_back(F.col("formatted"), template)).cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length(loss_text(F.col("segments"))).cast("long").alias("loss_chars"),
        F.sha2(loss_text(F.col("segments")), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )
