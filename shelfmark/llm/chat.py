"""Chat formatting with a declarative template.

A finite-state machine over the roles validates the order of turns. Each turn becomes three text segments (head, text,
close) with a loss flag each. Control strings inside texts and roles are escaped, so the formatted text can be read
back exactly. Everything is column expressions.

Defined cases: a null or unknown role is formatted with the template's mark for unknown roles and makes the
conversation invalid; a null text is empty; turns are ordered by turn number (null first), then role, then text, so
ties and repeated rows stay and have one result; rows with a null conversation id form one conversation; an empty
table gives no rows; columns other than the named ones are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Marks, role labels, roles under the loss mask, and the allowed order of roles."""

    open: str = "### "
    head_end: str = ": "
    close: str = "</turn>"
    after: str = "\n"
    escape: str = "\\"
    unknown: str = "@"
    labels: dict = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant"})
    trained: tuple = ("assistant",)
    # state -> roles that may follow; the state is the last role
    order: dict = field(
        default_factory=lambda: {
            "start": ("system", "user"),
            "system": ("user",),
            "user": ("assistant",),
            "assistant": ("user",),
        }
    )
    final: tuple = ("assistant",)

    def __post_init__(self):
        marks = self.controls()
        for mark in marks:
            if not mark or self.escape in mark or any(mark[:i] == mark[-i:] for i in range(1, len(mark))):
                raise ValueError(f"a mark must not be empty, hold the escape, or begin with its own end: {mark!r}")
        if len(self.escape) != 1 or len(marks) > 9 or any(self.open in v or self.head_end in v for v in self.labels.values()):
            raise ValueError("labels must not hold marks, and the escape is one character")
        if any(v.startswith(self.unknown) for v in self.labels.values()):
            raise ValueError("no label may begin with the mark of unknown roles")

    def controls(self) -> list[str]:
        return [self.open, self.close, self.head_end]


def _replace(text: Column, old: str, new: str) -> Column:
    return F.replace(text, F.lit(old), F.lit(new))


def escaped(text: Column, template: Template, role: bool = False) -> Column:
    """The escape becomes escape + 0, control string i becomes escape + i; the head's end only matters in roles."""
    text = _replace(text, template.escape, f"{template.escape}0")
    for i, mark in enumerate(template.controls()[: 3 if role else 2], 1):
        text = _replace(text, mark, f"{template.escape}{i}")
    return text


def unescaped(text: Column, template: Template) -> Column:
    for i, mark in reversed(list(enumerate(template.controls(), 1))):
        text = _replace(text, f"{template.escape}{i}", mark)
    return _replace(text, f"{template.escape}0", template.escape)


def format_conversations(
    rows: DataFrame, template: Template = Template(), conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """conv_id, n_turns, valid, error_turn, segments (text, loss), formatted.

    ``error_turn`` is the 0-based position of the first turn that the machine does not allow; the number of turns
    where the conversation only ends too early; null in valid ones.
    """
    entry = F.struct(
        F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text")
    )
    turns = rows.groupBy(F.col(conv).alias("conv_id")).agg(F.sort_array(F.collect_list(entry)).alias("turns"))
    known = F.create_map(*[F.lit(x) for pair in template.labels.items() for x in pair])

    def segments(t):
        label = F.coalesce(known[t["role"]], F.concat(F.lit(template.unknown), escaped(t["role"], template, role=True)))
        head = F.concat(F.lit(template.open), label, F.lit(template.head_end))
        return F.array(
            F.struct(head.alias("text"), F.lit(False).alias("loss")),
            F.struct(escaped(t["text"], template).alias("text"), t["role"].isin(*template.trained).alias("loss")),
            F.struct(F.lit(template.close + template.after).alias("text"), F.lit(False).alias("loss")),
        )

    steps = [f"{state}>{r}" for state, following in template.order.items() for r in following]
    start = F.struct(F.lit("start").alias("state"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("error"))

    def step(acc, r):
        allowed = F.concat(acc["state"], F.lit(">"), r).isin(*steps)
        error = F.when(acc["error"].isNull() & ~allowed, acc["at"]).otherwise(acc["error"])
        return F.struct(r.alias("state"), (acc["at"] + 1).alias("at"), error.alias("error"))

    machine = F.aggregate(F.col("turns.role"), start, step)
    ends = F.when(F.col("_m.state").isin(*template.final), F.lit(None)).otherwise(F.col("_m.at"))
    return (
        turns.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.flatten(F.transform("turns", segments)).alias("segments"), machine.alias("_m"))
        .withColumn("error_turn", F.coalesce(F.col("_m.error"), ends).cast("int"))
        .withColumn("valid", F.col("error_turn").isNull())
        .withColumn("formatted", F.array_join("segments.text", ""))
        .select("conv_id", "n_turns", "valid", "error_turn", "segments", "formatted")
    )


def read_back(formatted: Column, template: Template = Template()) -> Column:
    """The turns (role, text) of a formatted conversation."""
    parts = F.split(formatted, re.escape(template.close + template.after).replace("\\\n", "\\n"), -1)
    roles = F.create_map(*[F.lit(x) for pair in template.labels.items() for x in pair[::-1]])

    def turn(part):
        head = F.substring_index(part, template.head_end, 1)
        label = F.substring(head, F.lit(len(template.open) + 1), F.length(head))
        own = unescaped(F.substring(label, F.lit(len(template.unknown) + 1), F.length(label)), template)
        body = F.substring(part, F.length(head) + F.lit(len(template.head_end) + 1), F.length(part))
        return F.struct(F.coalesce(roles[label], own).alias("role"), unescaped(body, template).alias("text"))

    return F.transform(F.slice(parts, 1, F.size(parts) - 1), turn)


def loss_text(segments: Column, template: Template = Template()) -> Column:
    """All text under the loss mask, unescaped, with nothing between."""
    under = F.filter(segments, lambda s: s["loss"])
    return F.array_join(F.transform(under, lambda s: unescaped(s["text"], template)), "")
