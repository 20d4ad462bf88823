"""Chat formatting with DataFrame functions only.

A finite-state machine over the roles of a conversation checks the order of
its turns; a declarative template gives the text around every turn and says
which roles are learned.  The result is the formatted text and its segments,
each with a loss flag.

Defined results: a null text or role is an empty one; turns with the same
number are ordered by role, then text; repeated rows are repeated turns; rows
with a null conversation id form one conversation; an unknown role, or one that
may not follow, makes the conversation invalid (``valid`` false) but it is
formatted all the same; an empty table gives no rows; other columns are left
out.  A conversation is one training example and must fit in a row.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: State before the first turn, and that of a conversation with a wrong turn.
START, WRONG = "start", "wrong"


@dataclass(frozen=True)
class Template:
    """``open`` + role + ``middle`` + text + ``close`` for every turn.

    ``moves`` has, for each state (the role before), the roles that may come;
    ``final`` the states in which a conversation may end; ``learned`` the roles
    whose texts carry the loss.  All three strings begin or end so that a text
    in which ``<|`` is escaped can't hold them.
    """

    open: str = "<|im_start|>"
    middle: str = "\n"
    close: str = "<|im_end|>\n"
    learned: tuple[str, ...] = ("assistant",)
    moves: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {
            START: ("system", "user"),
            "system": ("user",),
            "user": ("assistant",),
            "assistant": ("user",),
        }
    )
    final: tuple[str, ...] = ("assistant",)


CHATML = Template()


def escape(text: Column) -> Column:
    """``<|`` with any backslashes between gets one more, so none is left bare."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def escape_role(role: Column) -> Column:
    """As ``escape``, and a role also may not hold the line end after it."""
    return F.replace(F.replace(escape(role), F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(F.replace(role, F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%")))


def final_state(roles: Column, template: Template) -> Column:
    """The state machine: a fold over an array of roles."""
    allowed = [f"{state}>{role}" for state, roles_ in template.moves.items() for role in roles_]
    step = lambda state, role: F.when(
        F.concat(state, F.lit(">"), role).isin(allowed), role
    ).otherwise(F.lit(WRONG))
    return F.aggregate(roles, F.lit(START), step)


def format_conversations(
    turns: DataFrame,
    template: Template = CHATML,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """One row per conversation: ``conv_id``, ``valid``, ``formatted`` and
    ``segments`` (array of ``text``, ``loss``) whose texts joined are ``formatted``."""
    rows = turns.select(
        F.col(conv).alias("conv_id"),
        F.struct(
            F.col(turn).alias("turn"),
            F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
        ).alias("t"),
    )
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))

    def segments(t: Column) -> Column:
        head = F.concat(F.lit(template.open), escape_role(t["role"]), F.lit(template.middle))
        return F.array(
            F.struct(head.alias("text"), F.lit(False).alias("loss")),
            F.struct(escape(t["text"]).alias("text"), t["role"].isin(*template.learned).alias("loss")),
            F.struct(F.lit(template.close).alias("text"), F.lit(False).alias("loss")),
        )

    return grouped.select(
        "conv_id",
        final_state(F.col("turns.role"), template).isin(*template.final).alias("valid"),
        F.flatten(F.transform("turns", segments)).alias("segments"),
    ).select(
        "conv_id",
        "valid",
        F.array_join(F.col("segments.text"), "").alias("formatted"),
        "segments",
    )


def read_back(formatted: DataFrame, template: Template = CHATML) -> DataFrame:
    """The turns and the learned text, read from ``formatted`` and the loss flags:
    ``conv_id``, ``valid``, ``formatted``, ``turns`` (role, text), ``learned``."""
    bodies = F.filter(F.split("formatted", _quoted(template.open)), lambda _, i: i > 0)
    turns = F.transform(
        bodies,
        lambda body: F.struct(
            unescape_role(F.substring_index(body, template.middle, 1)).alias("role"),
            unescape(
                body.substr(
                    F.length(F.substring_index(body, template.middle, 1)) + len(template.middle) + 1,
                    F.length(body)
                    - F.length(F.substring_index(body, template.middle, 1))
                    - len(template.middle)
                    - len(template.close),
                )
            ).alias("text"),
        ),
    )
    learned = F.filter("segments", lambda s: s["loss"])
    return formatted.select(
        "conv_id",
        "valid",
        "formatted",
        turns.alias("turns"),
        F.array_join(F.transform(learned, lambda s: unescape(s["text"])), "").alias("learned"),
    )


def _quoted(text: str) -> str:
    return "".join(f"\\{c}" if c in r"\.^$|?*+()[]{}<>" else c for c in text)


def digests(formatted: DataFrame, template: Template = CHATML) -> DataFrame:
    """What a reader of the output finds in it, one row per conversation."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read_back(formatted, template).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )
