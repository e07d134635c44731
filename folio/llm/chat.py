"""Operator 5: chat formatting. Native column expressions, one grouping by conversation.

A template declares a pair of control strings for each role, the roles that are learnt, and the
transitions of a finite-state machine over roles. A conversation's turns, in order, give segments
``(text, loss)``: control string, escaped text, control string; their concatenation is the
formatted text. The machine runs over the roles: ``valid`` tells whether every transition is
declared, ``first_error`` the position of the first that is not (from 0), ``complete`` whether the
last state is one in which a conversation may end. Invalid conversations are formatted all the
same; the caller filters on ``valid``.

Escaping: a control string inside a text gets U+2060 after its first character (one more if it has
some already), and reading back takes one away. No escaped text holds a control string, so the
first closing one ends a turn.

Nulls: a null text or role is empty, turns with a null number come first, a null conv_id is a
conversation. Equal turn numbers go by role and text, repeated rows are repeated turns. Empty
tables give no rows. Other columns are ignored. A conversation is one row of the result and must
fit in one, as its digest must.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

JOINER = "⁠"


@dataclass(frozen=True)
class Template:
    #: role → opening and closing control string; each is a bracket, a name and a bracket
    turns: dict[str, tuple[str, str]]
    #: for all other roles: opening, between role and text, closing
    other: tuple[str, str, str]
    learnt: frozenset[str]
    #: state → roles that may follow; states are roles and "start"
    follows: dict[str, tuple[str, ...]]
    ends: frozenset[str]

    def controls(self) -> list[str]:
        return [c for pair in self.turns.values() for c in pair] + list(self.other)


INSTRUCTION = Template(
    turns={"system": ("[SYS]", "[/SYS]"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")},
    other=("[TURN]", "[TEXT]", "[/TURN]"),
    learnt=frozenset({"assistant"}),
    follows={"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)},
    ends=frozenset({"assistant"}),
)


def _control_pattern(template: Template) -> tuple[str, str]:
    """The first characters of the control strings, and alternatives of what follows them."""
    firsts = "".join(sorted({re.escape(c[0]) for c in template.controls()}))
    rests = "|".join(sorted({re.escape(c[1:]) for c in template.controls()}))
    return f"([{firsts}])", f"({JOINER}*(?:{rests}))"


def escape(text: Column, template: Template) -> Column:
    first, rest = _control_pattern(template)
    return F.regexp_replace(text, first + rest, f"$1{JOINER}$2")


def unescape(text: Column, template: Template) -> Column:
    first, rest = _control_pattern(template)
    return F.regexp_replace(text, first + JOINER + rest, "$1$2")


def format_conversations(rows: DataFrame, template: Template = INSTRUCTION) -> DataFrame:
    """conv_id, segments, formatted, n_turns, valid, first_error and complete of each conversation."""
    turn = F.struct(F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("_turns"))

    def segment(text: Column, loss: bool | Column = False) -> Column:
        return F.struct(text.alias("text"), (F.lit(loss) if isinstance(loss, bool) else loss).alias("loss"))

    def of_turn(t: Column) -> Column:
        body = escape(t["text"], template)
        opening, between, closing = (F.lit(c) for c in template.other)
        made = F.array(segment(F.concat(opening, escape(t["role"], template), between)), segment(body), segment(closing))
        for role, (start, end) in template.turns.items():
            known = F.array(segment(F.lit(start)), segment(body, role in template.learnt), segment(F.lit(end)))
            made = F.when(t["role"] == role, known).otherwise(made)
        return made

    def advance(state: Column, t: Column) -> Column:
        """state: (role now, turns read, position of the first error or null)"""
        allowed = F.lit(False)
        for now, then in template.follows.items():
            allowed = F.when(state["now"] == now, t["role"].isin(*then)).otherwise(allowed)
        error = F.coalesce(state["error"], F.when(~allowed, state["read"]))
        return F.struct(t["role"].alias("now"), (state["read"] + 1).alias("read"), error.alias("error"))

    begin = F.struct(F.lit("start").alias("now"), F.lit(0).alias("read"), F.lit(None).cast("int").alias("error"))
    made = grouped.select("conv_id", F.flatten(F.transform("_turns", of_turn)).alias("segments"), F.size("_turns").cast("long").alias("n_turns"), F.aggregate("_turns", begin, advance).alias("_end"))
    return made.select(
        "conv_id", "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "n_turns",
        F.col("_end.error").isNull().alias("valid"), F.col("_end.error").alias("first_error"), F.col("_end.now").isin(*template.ends).alias("complete"),
    )


def read_back(formatted: Column, template: Template = INSTRUCTION) -> Column:
    """The turns of a formatted conversation: an array of (role, text)."""
    opens = {start: role for role, (start, _) in template.turns.items()}
    closes = [end for _, end in template.turns.values()] + [template.other[2]]
    pattern = "(?s)({})(.*?)(?:{})".format("|".join(map(re.escape, [*opens, template.other[0]])), "|".join(map(re.escape, closes)))
    bodies = F.regexp_extract_all(formatted, F.lit(pattern), F.lit(2))

    def turn(start: Column, body: Column) -> Column:
        between = template.other[1]
        at = F.instr(body, F.lit(between))
        role, text = F.substring(body, F.lit(1), at - 1), F.substring(body, at + len(between), F.length(body))
        for control, name in opens.items():
            role, text = F.when(start == control, F.lit(name)).otherwise(role), F.when(start == control, body).otherwise(text)
        return F.struct(unescape(role, template).alias("role"), unescape(text, template).alias("text"))

    return F.zip_with(F.regexp_extract_all(formatted, F.lit(pattern), F.lit(1)), bodies, turn)


def learnt_text(segments: Column, template: Template = INSTRUCTION) -> Column:
    """All text under the loss mask as it was before it was escaped, nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"], template)), "")


def digests(formatted: DataFrame, template: Template = INSTRUCTION) -> DataFrame:
    """Per conversation, from the formatted text and the segments: what was said and what is learnt."""
    read = formatted.select("*", read_back(F.col("formatted"), template).alias("_turns"), learnt_text(F.col("segments"), template).alias("_learnt"))
    said = F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("_turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("_learnt").cast("long").alias("loss_chars"),
        F.sha2("_learnt", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "valid",
    )
