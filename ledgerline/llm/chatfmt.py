"""Chat formatting as one relational plan: collect turn structs, sort, merge runs of a role, concatenate.

Only built-in expressions run. The template is

    <|im_start|>ROLE<|im_sep|>TEXT[<|im_cont|>TEXT ...]<|im_end|>\\n

with one block for a run of adjacent turns of one role; <|im_cont|> stands between the turns of a run, so reading back
gives the turns as they came. Every control string starts with "<|". Inside roles and texts, "<", any backslashes and
"|" get one more backslash, so "<|" never occurs there, and taking that backslash away restores the text exactly.

Defined results: null role or text counts as empty; a null conversation id is a conversation of its own; turns with the
same number go by role, then text; repeated rows are kept; an empty table gives an empty result; further columns are
ignored. One conversation is one formatted string, so it has to fit in a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the template.
START, SEP, CONT, END = "<|im_start|>", "<|im_sep|>", "<|im_cont|>", "<|im_end|>\n"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def format_conversations(turns: DataFrame, conv_id: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text", loss_role: str = "assistant") -> DataFrame:
    """One row for each conversation: its id, `formatted`, and `segments`.

    segments: array of struct(piece, loss) whose pieces, end to end, are `formatted`; loss marks the pieces (each the
    escaped text of one turn of loss_role) that training counts.
    """
    struct = F.struct(F.col(order).alias("o"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("r"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    piece = lambda what, loss: F.struct(what.alias("piece"), loss.alias("loss"))
    fixed = lambda what: piece(F.lit(what), F.lit(False))

    def turn(t: Column, i: Column) -> Column:
        said = piece(escaped(t["t"]), t["r"] == loss_role)
        return F.when(i == 0, F.array(said)).otherwise(F.array(fixed(CONT), said))

    def block(run: Column) -> Column:
        head = piece(F.concat(F.lit(START), escaped(run[0]["r"]), F.lit(SEP)), F.lit(False))
        return F.concat(F.array(head), F.flatten(F.transform(run, turn)), F.array(fixed(END)))

    collected = turns.select(F.col(conv_id).alias("conv_id"), struct.alias("turn")).groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    # where a run begins: the role is not that of the turn before
    begins = F.filter(F.sequence(F.lit(0), F.size("turns") - 1), lambda i: (i == 0) | (F.get("turns", i)["r"] != F.get("turns", i - 1)["r"]))
    until = lambda k: F.coalesce(F.get("begins", k + 1), F.size("turns"))
    runs = F.transform("begins", lambda b, k: F.slice("turns", b + 1, until(k) - b))
    merged = collected.withColumn("begins", begins).withColumn("runs", runs)
    segments = merged.select("conv_id", F.flatten(F.transform("runs", block)).alias("segments"))
    return segments.select("conv_id", F.array_join(F.transform("segments", lambda s: s["piece"]), "").alias("formatted"), "segments")


def read_turns(formatted: Column) -> Column:
    """The turns, array of struct(role, text), of a formatted conversation."""
    quoted = lambda s: rf"\Q{s}\E"

    def of_block(b: Column) -> Column:
        head_body = F.split(b, quoted(SEP), 2)
        body = F.split(head_body[1], quoted(END))[0]
        return F.transform(F.split(body, quoted(CONT)), lambda t: F.struct(unescaped(head_body[0]).alias("role"), unescaped(t).alias("text")))

    blocks = F.split(formatted, quoted(START))
    return F.flatten(F.transform(F.slice(blocks, 2, F.greatest(F.size(blocks) - 1, F.lit(0))), of_block))


def read_loss(segments: Column) -> Column:
    """All text under the loss mask, unescaped piece by piece."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["piece"])), "")
