r"""Chat formatting with a grammar round trip, in DataFrame functions only.

Grammar, turn after turn, nothing between:

    assistant   <s>BODY</s>
    user        [INST] BODY [/INST]
    other       <<SYS>>ROLE\nBODY<</SYS>>

A body holds no control string (<s> </s> [INST] [/INST] <<SYS>> <</SYS>>). Each turn is rendered
verbatim and read back by the parser; where what comes back isn't the source, or the body breaks the
grammar, the conflicting strings are escaped and the turn is read back again, and a turn that still
differs is an error. The escape puts one backslash behind the opening bracket of a control string or
of one that has backslashes there already ([INST] gives [\INST], [\INST] gives [\\INST]); the parser
takes one away, so escaping and reading back are inverse.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: An opening bracket, backslashes, the rest of a control string.
CONFLICT = r"(\[|<<|<)(\\*)(/?(?:INST\]|SYS>>|s>))"
ESCAPED = r"(\[|<<|<)\\(\\*)(/?(?:INST\]|SYS>>|s>))"
CONTROL = r"(\[|<<|<)(/?(?:INST\]|SYS>>|s>))"
TURN = r"(?s)<s>.*?</s>|\[INST\] .*? \[/INST\]|<<SYS>>.*?<</SYS>>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONFLICT, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def role_line(role: Column) -> Column:
    """A role on one line: backslash is \\e, line feed \\n, control strings escaped."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\e")), F.lit("\n"), F.lit("\\n")))


def role_of(line: Column) -> Column:
    return F.replace(F.replace(unescape(line), F.lit("\\n"), F.lit("\n")), F.lit("\\e"), F.lit("\\"))


def render(role: Column, body: Column) -> Column:
    return (
        F.when(role == "assistant", F.concat(F.lit("<s>"), body, F.lit("</s>")))
        .when(role == "user", F.concat(F.lit("[INST] "), body, F.lit(" [/INST]")))
        .otherwise(F.concat(F.lit("<<SYS>>"), role_line(role), F.lit("\n"), body, F.lit("<</SYS>>")))
    )


def _inside(unit: Column, before: int, after: int) -> Column:
    return F.substring(unit, F.lit(before + 1), F.length(unit) - before - after)


def parse(unit: Column) -> Column:
    """Struct (role, text, clean) of one turn of formatted text; clean: its body keeps to the grammar."""
    system = _inside(unit, 7, 8)
    line = F.substring_index(system, "\n", 1)
    body = F.when(unit.startswith("<s>"), _inside(unit, 3, 4)).when(unit.startswith("[INST] "), _inside(unit, 7, 8)).otherwise(F.substring(system, F.length(line) + 2, F.length(system)))
    role = F.when(unit.startswith("<s>"), "assistant").when(unit.startswith("[INST] "), "user").otherwise(role_of(line))
    return F.struct(role.alias("role"), unescape(body).alias("text"), (~body.rlike(CONTROL)).alias("clean"))


def same(unit: Column, role: Column, text: Column) -> Column:
    """Does the parser, reading the unit, find one turn and in it the source?"""
    turns = F.regexp_extract_all(unit, F.lit(TURN), F.lit(0))
    back = parse(F.get(turns, F.lit(0)))
    return F.coalesce((F.size(turns) == 1) & (F.get(turns, F.lit(0)) == unit) & back["clean"] & (back["role"] == role) & (back["text"] == text), F.lit(False))


def format_chat(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id, formatted string, n_turns long, n_escaped long) per conversation.

    Turns come by turn, null first, equal ones by role and text; repeated rows stay. Null role or
    text counts as empty, null ids form one conversation, no rows give no rows, other columns are
    left out. A conversation is one string, so its rows meet in one task.
    """
    turns = conversations.select(F.col(id_col).alias("id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    turns = turns.withColumn("unit", render(F.col("role"), F.col("text"))).withColumn("plain", same(F.col("unit"), F.col("role"), F.col("text")))
    turns = turns.withColumn("unit", F.when(F.col("plain"), F.col("unit")).otherwise(render(F.col("role"), escape(F.col("text")))))
    checked = F.when(F.col("plain") | same(F.col("unit"), F.col("role"), F.col("text")), F.col("unit")).otherwise(F.raise_error(F.lit("a turn doesn't come back from its formatted text")))
    turns = turns.withColumn("unit", checked)
    grouped = turns.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "unit"))).alias("turns"), F.sum((~F.col("plain")).cast("long")).alias("n_escaped"))
    return grouped.select(F.col("id").alias(id_col), F.array_join(F.transform("turns", lambda t: t["unit"]), "").alias("formatted"), F.size("turns").cast("long").alias("n_turns"), "n_escaped")


def parse_chat(formatted: Column) -> Column:
    """The turns of a formatted text: array of (role, text, clean)."""
    return F.transform(F.regexp_extract_all(formatted, F.lit(TURN), F.lit(0)), parse)


def loss_text(turns: Column) -> Column:
    """All text under the loss mask: what the assistant says, in order, nothing between."""
    return F.array_join(F.transform(F.filter(turns, lambda t: t["role"] == "assistant"), lambda t: t["text"]), "")
