"""Chat formatting (native: DataFrame operations only).

A declarative template names the marks around a turn, the roles that carry loss and the order in which roles
may follow each other. A finite-state machine over each conversation's roles checks the order; every
conversation is formatted, and `valid` and `bad_turn` tell what the machine found. The result is a list of
segments (text, loss) whose texts, joined, are the formatted conversation.

Marks inside a text are escaped by one backslash between `<` and `|`, whatever number of backslashes stands
there already, so that the escape can be undone for every text; in a role a line feed becomes `<|nl|>`.

Defined cases: null text and null role are empty; rows of equal conv_id and turn are ordered by role, then
text; a null turn comes first; rows with a null conv_id form one conversation; no rows give no conversations.
A conversation is gathered whole (its output is one text), so its turns must fit in a task. Other columns are not
read, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ChatTemplate:
    """open, role, after_role, text, close, in this order, make a turn; loss: roles whose texts are learned."""

    open: str = "<|im_start|>"
    after_role: str = "\n"
    close: str = "<|im_end|>"
    after_turn: str = "\n"
    newline_in_role: str = "<|nl|>"
    loss: tuple[str, ...] = ("assistant",)
    start: str = "start"
    #: state -> role -> state; a role that is missing leads to `error`, which is never left.
    moves: dict[str, dict[str, str]] = field(default_factory=lambda: {
        "start": {"system": "ready", "user": "asked"},
        "ready": {"user": "asked"},
        "asked": {"assistant": "answered", "tool": "asked"},
        "answered": {"user": "asked", "tool": "asked"},
    })
    final: tuple[str, ...] = ("answered",)


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _literal(mark: str) -> str:
    return "".join(c if c.isalnum() else ("\\n" if c == "\n" else "\\" + c) for c in mark)


def format_chats(rows: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """One row per conversation: conv_id, segments array<struct<text, loss>>, formatted, valid, bad_turn (index of the first turn out of order, null if none)."""
    t = template
    turns = rows.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("said"))
    turns = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("said")).alias("turns"))
    moves = F.create_map(*[F.lit(x) for state, to in t.moves.items() for role, then in to.items() for x in (f"{state}>{role}", then)])

    def step(acc: Column, turn: Column) -> Column:
        then = F.coalesce(F.try_element_at(moves, F.concat(acc["state"], F.lit(">"), turn["role"])), F.lit("error"))
        bad = F.when(acc["bad"].isNotNull(), acc["bad"]).when(then == "error", acc["n"])
        return F.struct(then.alias("state"), (acc["n"] + 1).alias("n"), bad.alias("bad"))

    run = F.aggregate("turns", F.struct(F.lit(t.start).alias("state"), F.lit(0).alias("n"), F.lit(None).cast("int").alias("bad")), step)

    def segments(turn: Column) -> Column:
        role = F.replace(escaped(turn["role"]), F.lit("\n"), F.lit(t.newline_in_role))
        seg = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        return F.array(
            seg(F.concat(F.lit(t.open), role, F.lit(t.after_role)), F.lit(False)),
            seg(escaped(turn["text"]), turn["role"].isin(*t.loss)),
            seg(F.lit(t.close + t.after_turn), F.lit(False)),
        )

    out = turns.select("conv_id", run.alias("run"), F.flatten(F.transform("turns", segments)).alias("segments"))
    return out.select(
        "conv_id", "segments", F.array_join(F.col("segments.text"), "").alias("formatted"),
        (F.col("run.bad").isNull() & F.col("run.state").isin(*t.final)).alias("valid"), F.col("run.bad").alias("bad_turn"),
    )


def read_back(formatted: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """Adds turns array<struct<role, text>>, parsed from the formatted string alone."""
    t = template
    rule = f"(?s){_literal(t.open)}(.*?){_literal(t.after_role)}(.*?){_literal(t.close + t.after_turn)}"
    part = lambda k: F.regexp_extract_all("formatted", F.lit(rule), F.lit(k))
    role = lambda r: unescaped(F.replace(r, F.lit(t.newline_in_role), F.lit("\n")))
    return formatted.withColumn("turns", F.zip_with(part(1), part(2), lambda r, x: F.struct(role(r).alias("role"), unescaped(x).alias("text"))))


def digests(read: DataFrame) -> DataFrame:
    """What op10 returns of read_back()'s rows: digests of the turns read and of what the loss mask covers."""
    learned = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescaped(s["text"])), "")
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), said.alias("said"), learned.alias("learned"), "formatted", "valid", "bad_turn").select(
        "conv_id", "n_turns", F.sha2("said", 256).alias("turns_sha256"), F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "valid", F.col("bad_turn").cast("long").alias("bad_turn"),
    )
