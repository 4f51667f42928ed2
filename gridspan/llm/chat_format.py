"""Chat formatting from a declarative template.

A finite-state machine over the roles checks the order of turns; the template gives each role its
header, end mark and loss flag. Where a control string begins inside a text a backslash parts its first
character from the rest, and where one already does so another is added: no control string can arise, the
escaping can be undone exactly, and all other text stays as it is. One shuffle by conversation;
everything else is expressions.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ChatTemplate:
    """Marks around a turn, per-role loss flags, and the machine's transitions (state, role) -> state.

    ``controls`` are strings that no text may hold, other templates' among them.
    """

    start: str = "<|im_start|>"
    header_end: str = "\n"
    end: str = "<|im_end|>\n"
    controls: tuple[str, ...] = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>", "<s>", "</s>", "[INST]", "[/INST]")
    loss_roles: tuple[str, ...] = ("assistant",)
    first: str = "start"
    final: tuple[str, ...] = ("assistant",)
    transitions: dict[tuple[str, str], str] = field(
        default_factory=lambda: {("start", "system"): "system", ("start", "user"): "user", ("system", "user"): "user", ("user", "assistant"): "assistant", ("assistant", "user"): "user", ("assistant", "tool"): "tool", ("tool", "assistant"): "assistant"}
    )


#: In headers a line break is escaped too, since it ends the header.
HEADER_ESCAPES = (("&", "&amp;"), ("\n", "&#10;"))
ERROR_STATE = "!"


def _quoted(text: str) -> str:
    return "\\Q" + text + "\\E"


def _beginning(t: ChatTemplate, backslashes: str) -> str:
    """A pattern for a control string's first character and the backslashes after it, before the rest of the string."""
    heads, rests = {c[0] for c in t.controls}, {c[1:] for c in t.controls}
    if any(h in r for h in heads for r in rests) or "\\" in "".join(t.controls) or min(map(len, t.controls)) < 2:
        raise ValueError("a control string's first character must not occur in the rest of one, nor a backslash anywhere")
    if not all(any(c in mark for c in t.controls) for mark in (t.start, t.end)):
        raise ValueError("marks must hold a control string")
    return f"({'|'.join(map(_quoted, sorted(heads)))}){backslashes}(?={'|'.join(map(_quoted, sorted(rests)))})"


def escape(text: Column, t: ChatTemplate, header: bool = False) -> Column:
    for plain, coded in HEADER_ESCAPES if header else ():
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return F.regexp_replace(text, _beginning(t, r"(\\*)"), r"$1\\$2")


def unescape(text: Column, t: ChatTemplate, header: bool = False) -> Column:
    text = F.regexp_replace(text, _beginning(t, r"\\(\\*)"), "$1$2")
    for plain, coded in reversed(HEADER_ESCAPES) if header else ():
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def format_conversations(turns: DataFrame, template: ChatTemplate | None = None, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, valid (boolean), error_turn (int, the first turn out of order, from 0), segments, formatted.

    ``segments`` is an array of struct(text, loss): per turn a header, the escaped text and an end mark; only texts of
    loss roles carry the flag. ``formatted`` is their concatenation. Turns go by number, ties by role and text;
    null roles and texts are empty ones, null turns come first, rows with a null id are one conversation. Repeated rows are turns of their own and
    break the order. A conversation out of order is formatted all the same. An empty table gives no rows. Very long texts are kept
    whole: a conversation is one row, as long as its texts. Other columns, whatever their names, are not carried along.
    """
    t = template or ChatTemplate()
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    talks = turns.groupBy(F.col(id_col).alias("conv_id")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    moves = F.create_map(*[F.lit(x) for (state, role), after in t.transitions.items() for x in (f"{state}>{role}", after)])
    walk = F.aggregate(
        "turns",
        F.struct(F.lit(t.first).alias("state"), F.lit(0).alias("at")),
        lambda at, x: F.when(at["state"] == ERROR_STATE, at).otherwise(
            F.struct(F.coalesce(moves[F.concat(at["state"], F.lit(">"), x["role"])], F.lit(ERROR_STATE)).alias("state"), F.when(moves[F.concat(at["state"], F.lit(">"), x["role"])].isNull(), at["at"]).otherwise(at["at"] + 1).alias("at"))
        ),
    )
    segments = F.flatten(
        F.transform(
            "turns",
            lambda x: F.array(
                F.struct(F.concat(F.lit(t.start), escape(x["role"], t, header=True), F.lit(t.header_end)).alias("text"), F.lit(False).alias("loss")),
                F.struct(escape(x["text"], t).alias("text"), x["role"].isin(*t.loss_roles).alias("loss")),
                F.struct(F.lit(t.end).alias("text"), F.lit(False).alias("loss")),
            ),
        )
    )
    done = talks.select("conv_id", walk.alias("walk"), segments.alias("segments"))
    return done.select(
        "conv_id",
        (F.col("walk.state").isin(*t.final)).alias("valid"),
        F.when(F.col("walk.state") == ERROR_STATE, F.col("walk.at")).alias("error_turn"),
        "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
    )


def read_turns(formatted: Column, template: ChatTemplate | None = None) -> Column:
    """The turns, array of struct(role, text), that a formatted conversation holds."""
    t = template or ChatTemplate()
    pieces = F.filter(F.split(formatted, _quoted(t.end)), lambda p: F.startswith(p, F.lit(t.start)))
    body = lambda p: F.substring(p, F.lit(len(t.start) + 1), F.length(p))
    role = lambda p: F.substring_index(body(p), t.header_end, 1)
    return F.transform(pieces, lambda p: F.struct(unescape(role(p), t, header=True).alias("role"), unescape(F.substring(body(p), F.length(role(p)) + F.lit(len(t.header_end) + 1), F.length(p)), t).alias("text")))


def loss_text(segments: Column, template: ChatTemplate | None = None) -> Column:
    """The unescaped text under the loss mask."""
    t = template or ChatTemplate()
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"], t)), "")
