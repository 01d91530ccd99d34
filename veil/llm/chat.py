"""Chat formatting from a declarative template, with DataFrame functions only.

A template names the roles' labels, the marks around a turn, the transitions of
a finite-state machine over roles, its accepting states and the roles that are
trained on.  A conversation becomes text segments with a loss flag each: the
opening mark with the role's label, the escaped text, and the closing mark; only
texts of trained roles count for the loss.

Escaping is reversible and leaves no control string inside texts: the escape
character becomes ``\\e``, and the first character of each control string
becomes an escape character with a letter of its own.  So the closing mark
splits formatted text exactly, whatever texts say.

Cases: rows of a conversation stand in order of turn, role and text, so that
ties and repeated rows have one result; null roles and texts are empty; roles
without a label are written as ``=role`` and reject the conversation; a null
conversation id is a conversation like any other; an empty table gives no rows;
columns besides the four named are not read.  A conversation is one row of the
result, so it must fit a row (2 GB).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ESCAPE = "\\"


@dataclass(frozen=True)
class Template:
    labels: dict[str, str] = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant"})
    opening: str = "### "
    between: str = ": "
    closing: str = "</turn>\n"
    #: What texts may not hold as it stands, with the letter that stands for its first character.
    controls: tuple[tuple[str, str], ...] = (("### ", "h"), ("</turn>", "t"))
    trained: tuple[str, ...] = ("assistant",)
    start: str = "start"
    transitions: tuple[tuple[str, str, str], ...] = (
        ("start", "system", "system"),
        ("start", "user", "user"),
        ("system", "user", "user"),
        ("user", "assistant", "assistant"),
        ("assistant", "user", "user"),
    )
    accepting: tuple[str, ...] = ("user", "assistant")

    def escape(self, text: Column) -> Column:
        text = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "e"))
        for control, letter in self.controls:
            text = F.replace(text, F.lit(control), F.lit(ESCAPE + letter + control[1:]))
        return text

    def unescape(self, text: Column) -> Column:
        for control, letter in self.controls:
            text = F.replace(text, F.lit(ESCAPE + letter), F.lit(control[0]))
        return F.replace(text, F.lit(ESCAPE + "e"), F.lit(ESCAPE))

    def label(self, role: Column) -> Column:
        shown = F.concat(F.lit("="), F.replace(self.escape(role), F.lit(":"), F.lit(ESCAPE + "c")))
        for name, label in self.labels.items():
            shown = F.when(role == name, F.lit(label)).otherwise(shown)
        return shown

    def role(self, label: Column) -> Column:
        name = self.unescape(F.replace(F.substring(label, 2, 1 << 30), F.lit(ESCAPE + "c"), F.lit(":")))
        for role, shown in self.labels.items():
            name = F.when(label == shown, F.lit(role)).otherwise(name)
        return name

    def step(self, state: Column, role: Column) -> Column:
        to = F.lit("rejected")
        for source, by, target in self.transitions:
            to = F.when((state == source) & (role == by), F.lit(target)).otherwise(to)
        return to


def format_chats(turns: DataFrame, template: Template | None = None, *, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, n_turns, valid (the machine accepts the roles in turn order), segments (text, loss)."""
    t = template or Template()
    empty = F.lit("")
    rows = turns.select(F.col(conversation).alias("conv_id"), F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), empty).alias("role"), F.coalesce(F.col(text), empty).alias("text")).alias("one"))
    chats = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("one")).alias("turns"))
    segments = F.flatten(
        F.transform(
            "turns",
            lambda x: F.array(
                F.struct(F.concat(F.lit(t.opening), t.label(x["role"]), F.lit(t.between)).alias("text"), F.lit(False).alias("loss")),
                F.struct(t.escape(x["text"]).alias("text"), x["role"].isin(*t.trained).alias("loss")),
                F.struct(F.lit(t.closing).alias("text"), F.lit(False).alias("loss")),
            ),
        )
    )
    state = F.aggregate("turns", F.lit(t.start), lambda state, x: t.step(state, x["role"]))
    return chats.select("conv_id", F.size("turns").cast("long").alias("n_turns"), state.isin(*t.accepting).alias("valid"), segments.alias("segments"))


def formatted(segments: str = "segments") -> Column:
    """The whole text of formatted segments."""
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def read_turns(text: Column, template: Template | None = None) -> Column:
    """The turns of formatted text: array of (role, text), exactly as they were before formatting."""
    t = template or Template()
    parts = F.split(text, "\\Q" + t.closing + "\\E", -1)

    def turn(part: Column) -> Column:
        at = F.locate(t.between, part, len(t.opening) + 1)
        label = F.substring(part, F.lit(len(t.opening) + 1), at - F.lit(len(t.opening) + 1))
        return F.struct(t.role(label).alias("role"), t.unescape(F.substring(part, at + F.lit(len(t.between)), F.length(part))).alias("text"))

    return F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), turn)


def loss_text(segments: str = "segments", template: Template | None = None) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    t = template or Template()
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: t.unescape(s["text"])), "")
