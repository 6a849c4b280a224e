"""Conversations as marked-up training text, with loss flags and turn-order checks.

All of it is DataFrame functions.  Turns are sorted over the cluster and handled in parts
of up to PART_TURNS rows, whatever their numbers, so that no task gathers a conversation
of unbounded length to format it.  The finite-state machine over roles composes: a part maps every state at its
start to the state at its end, and a conversation's verdict chains those maps.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns

PART_TURNS = 256


@dataclass(frozen=True)
class Template:
    """A turn is start + role + role_end + text + end; only texts of loss_roles count.

    `moves` maps state -> {role: state}; a role without a move rejects.  Texts never
    hold `guard` unguarded: each occurrence gets `guard_mark` behind it, so start and
    end, which contain guard, can't occur in a text, and removing the marks restores it.
    """

    start: str = "<|im_start|>"
    role_end: str = "\n"
    end: str = "<|im_end|>\n"
    guard: str = "<|"
    guard_mark: str = "|"
    loss_roles: tuple[str, ...] = ("assistant",)
    first: str = "begin"
    accept: tuple[str, ...] = ("answered",)
    moves: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            "begin": {"system": "told", "user": "asked"},
            "told": {"user": "asked"},
            "asked": {"assistant": "answered"},
            "answered": {"user": "asked"},
        }
    )


CHATML = Template()


def _escape(text: Column, t: Template) -> Column:
    return F.replace(text, F.lit(t.guard), F.lit(t.guard + t.guard_mark))


def _unescape(text: Column, t: Template) -> Column:
    return F.replace(text, F.lit(t.guard + t.guard_mark), F.lit(t.guard))


def _escape_role(role: Column, t: Template) -> Column:
    safe = F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))
    return _escape(safe, t)


def _unescape_role(role: Column, t: Template) -> Column:
    plain = _unescape(role, t)
    return F.replace(F.replace(plain, F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def _machine(t: Template) -> tuple[list[str], list[str], list[int]]:
    """States (the last rejects for good), roles, and the next state's number for each pair."""
    states = [t.first, *(s for s in t.moves if s != t.first), "rejected"]
    roles = sorted({r for m in t.moves.values() for r in m})
    dead = len(states) - 1
    after = [states.index(t.moves[s][r]) if r in t.moves.get(s, {}) else dead for s in states for r in [*roles, None]]
    return states, roles, after


def format_conversations(turns: DataFrame, template: Template = CHATML, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each part of a conversation: conv_id, part, n_turns, segments, moves.

    Parts of a conversation follow each other by number; the numbers have no other
    meaning, and hold for one evaluation: write the result before using it twice.
    segments is an array of (text, loss): what is to be tokenized, in order, and
    whether it counts for the loss; joined over parts they are the formatted text.
    moves[s] is the machine's state after the part if it was in state s before.
    Turns are ordered by number (null first), then role, then text; repeated turns
    stay; a null text or role is an empty one; a null conv_id is a conversation.
    """
    t = template
    states, roles, after = _machine(t)
    rows = columns(turns, conv_id=conv_id, turn=turn, role=role, text=text)
    one = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    # the last sort key lets equal rows be dealt to several tasks
    rows = rows.select("conv_id", one.alias("one"), F.monotonically_increasing_id().alias("tie")).orderBy("conv_id", "one", "tie")
    rows = rows.select("conv_id", F.floor(F.monotonically_increasing_id() / PART_TURNS).alias("part"), "one")
    parts = rows.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list("one")).alias("all"))

    def marked(x: Column) -> Column:
        plain = lambda text, loss=False: F.struct(text.alias("text"), F.lit(loss).alias("loss") if isinstance(loss, bool) else loss.alias("loss"))
        head = F.concat(F.lit(t.start), _escape_role(x["role"], t), F.lit(t.role_end))
        return F.array(plain(head), plain(_escape(x["text"], t), x["role"].isin(*t.loss_roles)), plain(F.lit(t.end)))

    table = F.array(*[F.lit(x) for x in after])
    number = lambda r: F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(x) for x in roles]), r), F.lit(0)), F.lit(len(roles) + 1)).cast("int")
    step = lambda s, x: F.element_at(table, s * (len(roles) + 1) + number(x["role"]))
    moves = F.array(*[F.aggregate("all", F.lit(s), step) for s in range(len(states))])
    return parts.select("conv_id", "part", F.size("all").alias("n_turns"), F.flatten(F.transform("all", marked)).alias("segments"), moves.alias("moves"))


def verdicts(formatted: DataFrame, template: Template = CHATML) -> DataFrame:
    """conv_id, valid: whether the whole conversation's turn order is accepted."""
    states, _, _ = _machine(template)
    good = [states.index(s) for s in template.accept]
    parts = F.array_sort(F.collect_list(F.struct("part", "moves")))
    last = F.aggregate(F.col("parts"), F.lit(0), lambda s, p: F.element_at(p["moves"], s + 1))
    return formatted.groupBy("conv_id").agg(parts.alias("parts")).select("conv_id", last.isin(*good).alias("valid"))


def parsed(formatted: DataFrame, template: Template = CHATML) -> DataFrame:
    """What the formatted text says, by part: turns (role, text), loss_text, chars, moves.

    Turns come from the joined text alone, by its marks; loss_text from the flags.
    """
    t = template
    quoted = "\\Q" + t.start + "\\E"
    whole = F.array_join(F.col("segments.text"), "")
    bodies = F.slice(F.split(whole, quoted, -1), 2, F.size(F.split(whole, quoted, -1)))

    def turn(body: Column) -> Column:
        role = F.substring_index(body, t.role_end, 1)
        size = F.char_length(body) - F.char_length(role) - len(t.role_end) - len(t.end)
        text = F.substring(body, F.char_length(role) + len(t.role_end) + 1, size)
        return F.struct(_unescape_role(role, t).alias("role"), _unescape(text, t).alias("text"))

    under_loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: _unescape(s["text"], t)), "")
    return formatted.select("conv_id", "part", F.transform(bodies, turn).alias("turns"), under_loss.alias("loss_text"), F.char_length(whole).cast("long").alias("chars"), "moves")
