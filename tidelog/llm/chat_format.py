"""Chat formatting: a finite-state machine over roles and a declarative template.

DataFrame functions only.  A template names the marks around turns, the roles
that carry loss, and the machine's moves.  Marks can't occur in texts: backslash,
``#`` and ``<`` are escaped in them (and ``:`` in roles), reversibly.

A conversation's rows are ordered by turn (then role and text); repeated rows
are turns of their own.  Null texts and roles count as empty, a null
conversation id is a conversation of its own.  Conversations whose order the
machine rejects are formatted too, with ``valid`` false.  An empty table gives
an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """``moves``: the state after a role, by state; states are named after the
    last role, ``start`` comes first.  ``accept``: states a conversation may end in."""

    open: str = "### "
    separator: str = ": "
    close: str = " </turn>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    moves: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"start": ("system", "user"), "system": ("user",), "user": ("assistant", "tool"), "assistant": ("user", "tool"), "tool": ("assistant", "tool")})
    accept: tuple[str, ...] = ("assistant",)


TEMPLATE = Template()
_ESCAPES = (("\\", "\\\\"), ("#", "\\h"), ("<", "\\l"), (":", "\\c"))


def escape(text: Column, role: bool = False) -> Column:
    for plain, coded in _ESCAPES[: 4 if role else 3]:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    def part(p: Column) -> Column:
        for plain, coded in _ESCAPES[1:]:
            p = F.replace(p, F.lit(coded), F.lit(plain))
        return p

    return F.array_join(F.transform(F.split(text, r"\\\\", -1), part), "\\")


def final_state(roles: Column, template: Template = TEMPLATE) -> Column:
    """Runs the machine over an array of roles; ``error`` absorbs."""
    moves = F.create_map(*[F.lit(x) for state, next_ in template.moves.items() for role in next_ for x in (f"{state}\n{role}", role)])
    return F.aggregate(roles, F.lit("start"), lambda state, role: F.coalesce(F.try_element_at(moves, F.concat(state, F.lit("\n"), role)), F.lit("error")))


def format_conversations(rows: DataFrame, template: Template = TEMPLATE, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, valid, segments array<struct<text, loss>>, formatted)."""
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    whole = rows.groupBy(F.col(conv_col).alias("conv_id")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))

    def segments(t: Column) -> Column:
        def piece(text: Column, loss: Column) -> Column:
            return F.struct(text.alias("text"), loss.alias("loss"))

        head = F.concat(F.lit(template.open), escape(t["role"], role=True), F.lit(template.separator))
        return F.array(piece(head, F.lit(False)), piece(escape(t["text"]), t["role"].isin(*template.loss_roles)), piece(F.lit(template.close), F.lit(False)))

    out = whole.select("conv_id", final_state(F.col("turns.role"), template).isin(*template.accept).alias("valid"), F.flatten(F.transform("turns", segments)).alias("segments"))
    return out.withColumn("formatted", F.array_join("segments.text", ""))


def read_turns(formatted: Column, template: Template = TEMPLATE) -> Column:
    """Turns (role, text) read back from a formatted conversation."""
    turns = F.split(formatted, template.close.replace("\n", "\\n"), -1)
    turns = F.slice(turns, 1, F.size(turns) - 1)

    def turn(t: Column) -> Column:
        role = F.substring_index(F.substr(t, F.lit(len(template.open) + 1)), template.separator[0], 1)
        text = F.substr(t, F.length(role) + len(template.open) + len(template.separator) + 1)
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))

    return F.transform(turns, turn)


def digest(formatted: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """Counts and digests of what can be read back from the output."""
    turns = formatted.withColumn("back", read_turns(F.col("formatted"), template))
    under_loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    told = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return turns.select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length(under_loss).cast("long").alias("loss_chars"),
        F.sha2(under_loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )
