r"""Chat formatting whose text reads back as exactly the turns it was made from.

A conversation is `<|im_start|>role`, a line end, the text, `<|im_end|>` and a line end per turn.
A parser that knows nothing but these marks reads the text back. Every turn is first written as it
is and read back; where the reading differs from the source, or the turn holds a `<|` that a
tokenizer might take for a mark, the turn is written escaped; whole conversations are then read back
again. Escaping puts one more backslash behind the `<` of anything that looks like `<|` or an escape
of it, so it can be undone exactly; a line end inside a role becomes `<n|`.

Nulls: a null text or role reads as empty, a null turn number comes first, rows without a
conversation id form one conversation. Turns with equal numbers are ordered by role and text, and
repeated rows stay as repeated turns. An empty table gives no rows. Other columns are not read.
One output row holds a whole conversation, so a conversation has to fit one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BEGIN, END = "<|im_start|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _escape_role(role: Column) -> Column:
    return F.replace(F.regexp_replace(role, r"<(\\*)(n?)\|", r"<\\$1$2|"), F.lit("\n"), F.lit("<n|"))


def _unescape_role(role: Column) -> Column:
    return F.regexp_replace(F.replace(role, F.lit("<n|"), F.lit("\n")), r"<\\(\\*)(n?)\|", r"<$1$2|")


def _render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(BEGIN), role, F.lit("\n"), text, F.lit(END))


def parse(formatted: Column) -> Column:
    """The turns of a formatted text, an array of role and text. What doesn't follow the grammar
    comes out as turns that differ from any source."""
    blocks = F.split(formatted, r"<\|im_end\|>\n?")
    blocks = F.slice(blocks, F.lit(1), F.size(blocks) - 1)

    def turn(block: Column) -> Column:
        body = F.substring_index(block, BEGIN, -1)
        role = F.substring_index(body, "\n", 1)
        return F.struct(
            _unescape_role(role).alias("role"),
            unescape(F.substr(body, F.length(role) + 2)).alias("text"),
        )

    return F.transform(blocks, turn)


def format_conversations(rows: DataFrame) -> DataFrame:
    """conv_id, formatted, loss (spans of assistant text in code points, end exclusive), source (the
    turns formatted) and identical (whether the parser gives them back).

    rows: conv_id, turn, role, text.
    """
    role, text = F.col("role"), F.col("text")
    turns = rows.select("conv_id", "turn", F.coalesce(role, F.lit("")).alias("role"),
                        F.coalesce(text, F.lit("")).alias("text"))
    source = F.array(F.struct(role.alias("role"), text.alias("text")))
    raw_reads_back = (parse(_render(role, text)) == source) & ~F.concat(role, text).contains("<|")
    turns = turns.withColumn("_raw", raw_reads_back).select(
        "conv_id", "turn", "role", "text",
        F.when(F.col("_raw"), role).otherwise(_escape_role(role)).alias("_role"),
        F.when(F.col("_raw"), text).otherwise(escape(text)).alias("_text"),
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    size = F.length(_render(F.col("_role"), F.col("_text")))
    before = F.coalesce(F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    turns = turns.withColumns({
        "_n": F.row_number().over(order),
        "_begin": before + len(BEGIN) + F.length("_role") + 1,
    })
    whole = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(
        "_n", "role", "text", "_role", "_text", "_begin"))).alias("_turns"))
    whole = whole.select(
        "conv_id",
        F.array_join(F.transform("_turns", lambda t: _render(t["_role"], t["_text"])), "").alias("formatted"),
        F.transform(
            F.filter("_turns", lambda t: t["role"] == "assistant"),
            lambda t: F.struct(t["_begin"].alias("begin"), (t["_begin"] + F.length(t["_text"])).alias("end")),
        ).alias("loss"),
        F.transform("_turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("source"),
    )
    return whole.withColumn("identical", parse(F.col("formatted")) == F.col("source"))


def under_loss(formatted: Column, loss: Column) -> Column:
    """The texts under the loss mask, without escapes, in order."""
    return F.transform(loss, lambda s: unescape(
        F.substr(formatted, (s["begin"] + 1).cast("int"), (s["end"] - s["begin"]).cast("int"))))
