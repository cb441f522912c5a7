"""Chat formatting: a declarative template and a finite-state machine over roles, in DataFrame expressions only."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ChatTemplate:
    """What surrounds a turn, which roles train, and which role may follow which state."""

    start: str = "<|im_start|>"
    end: str = "<|im_end|>"
    after_role: str = "\n"
    after_turn: str = "\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    initial: str = "begin"
    transitions: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            "begin": {"system": "primed", "user": "asked"},
            "primed": {"system": "primed", "user": "asked"},
            "asked": {"assistant": "answered", "tool": "asked"},
            "answered": {"user": "asked", "tool": "asked"},
        }
    )
    accepting: tuple[str, ...] = ("answered",)


CHATML = ChatTemplate()
_MARK = "<|"  # every control string begins so; texts never hold it once escaped


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit(_MARK), F.lit("&lt;|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;|"), F.lit(_MARK)), F.lit("&amp;"), F.lit("&"))


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("&nl;"))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("&nl;"), F.lit("\n")))


def format_chat(rows: DataFrame, template: ChatTemplate = CHATML) -> DataFrame:
    """conv_id, formatted, segments array<struct<text, loss>>, final_state, valid.

    Rows are (conv_id, turn, role, text), ordered by turn, then role and text, so
    ties are stable and repeated rows repeat. A null role or text is empty; a null
    conv_id forms its own conversation; null turns come first. An empty table
    gives no rows; other columns are ignored. A conversation whose roles break
    the machine is formatted all the same, with `valid` false and final_state
    'rejected'. A conversation is one output string, so its turns meet in one row.
    """
    t = template
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("_turns"))
    arcs = F.create_map(*[F.lit(x) for state, by in t.transitions.items() for role, to in by.items() for x in (f"{state}\n{role}", to)])
    state = F.aggregate(
        "_turns",
        F.lit(t.initial),
        lambda s, x: F.coalesce(F.try_element_at(arcs, F.concat(s, F.lit("\n"), x["role"])), F.lit("rejected")),
    )

    def pieces(x: Column) -> Column:
        return F.array(
            F.struct(F.concat(F.lit(t.start), _escape_role(x["role"]), F.lit(t.after_role)).alias("text"), F.lit(False).alias("loss")),
            F.struct(escape(x["text"]).alias("text"), x["role"].isin(*t.loss_roles).alias("loss")),
            F.struct(F.lit(t.end + t.after_turn).alias("text"), F.lit(False).alias("loss")),
        )

    return (
        turns.withColumn("segments", F.flatten(F.transform("_turns", pieces)))
        .withColumn("final_state", state)
        .select(
            "conv_id",
            F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
            "segments",
            "final_state",
            F.col("final_state").isin(*t.accepting).alias("valid"),
        )
    )


def read_back(formatted: DataFrame, template: ChatTemplate = CHATML) -> DataFrame:
    """conv_id, turns array<struct<role, text>>, loss array<string>, formatted, valid: parsed from the formatted strings."""
    t = template
    parts = F.split("formatted", "\\Q" + t.end + t.after_turn + "\\E")

    def turn(part: Column) -> Column:
        body = F.substr(part, F.lit(len(t.start) + 1))
        cut = F.instr(body, t.after_role)
        role, text = F.substr(body, F.lit(1), cut - 1), F.substr(body, cut + len(t.after_role))
        return F.struct(_unescape_role(role).alias("role"), unescape(text).alias("text"))

    return formatted.select(
        "conv_id",
        F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), turn).alias("turns"),
        F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])).alias("loss"),
        "formatted",
        "valid",
    )
