r"""Chat formatting with a grammar round trip.

Turns are rendered as ``<|im_start|>ROLE\nTEXT<|im_end|>\n``. A strict, deterministic parser reads the rendered text
back and its turns are compared with the source. Where they differ, content that conflicts with the grammar is escaped
(one backslash goes between ``<`` and ``|``, behind those already there, which the parser takes away again) until both
are identical. A conversation that still differs raises an error, so no wrong text gets out.

Roles never break the grammar: ``%``, line feeds and ``<`` in a role are always percent-encoded.

Defined results: null texts and roles are empty; turns are ordered by (turn, role, text), null turns first; repeated
rows are turns of their own; a null conv_id is a conversation of its own; an empty table gives no conversation. Other
columns are not read. All operations are DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The template's control strings.
START, END = "<|im_start|>", "<|im_end|>"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _role_out(role: Column) -> Column:
    for a, b in (("%", "%25"), ("\n", "%0A"), ("<", "%3C")):
        role = F.replace(role, F.lit(a), F.lit(b))
    return role


def _role_in(role: Column) -> Column:
    for a, b in (("<", "%3C"), ("\n", "%0A"), ("%", "%25")):
        role = F.replace(role, F.lit(b), F.lit(a))
    return role


def rendered(turns: Column, escape: bool) -> Column:
    """turns: array of (role, text)."""
    body = escaped if escape else (lambda x: x)
    one = F.transform(turns, lambda t: F.concat(F.lit(START), _role_out(t["role"]), F.lit("\n"), body(t["text"]), F.lit(END + "\n")))
    return F.array_join(one, "")


def parsed(text: Column) -> Column:
    """The turns that the grammar reads from text; a turn that breaks it is null."""
    parts = F.split(text, rf"\Q{START}\E", -1)

    def turn(part: Column) -> Column:
        line = F.instr(part, "\n")
        rest = F.substr(part, line + 1)
        stop = F.instr(rest, END)
        right = (line > 0) & (stop > 0) & (F.substr(rest, stop + len(END)) == "\n")
        got = F.struct(_role_in(F.substr(part, F.lit(1), line - 1)).alias("role"), unescaped(F.substr(rest, F.lit(1), stop - 1)).alias("text"))
        return F.when(right, got)

    return F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), turn)


def format_chats(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, formatted (the training text), escaped (whether it had to be), turns (as the parser reads them back)."""
    one = F.struct(F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    talks = rows.select(F.col(conv).alias("conv_id"), one.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    talks = talks.select("conv_id", F.transform("ts", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("source"))
    talks = talks.withColumn("plain", rendered(F.col("source"), False))
    talks = talks.withColumn("clean", same_turns(parsed(F.col("plain")), F.col("source")))
    talks = talks.select("conv_id", "source", F.when(F.col("clean"), F.col("plain")).otherwise(rendered(F.col("source"), True)).alias("formatted"), (~F.col("clean")).alias("escaped"))
    talks = talks.withColumn("turns", parsed(F.col("formatted")))
    right = same_turns(F.col("turns"), F.col("source"))
    return talks.select("conv_id", F.when(right, F.col("formatted")).otherwise(F.raise_error(F.lit("a conversation does not survive its round trip"))).alias("formatted"), "escaped", "turns")


def same_turns(got: Column, wanted: Column) -> Column:
    return (F.size(got) == F.size(wanted)) & ~F.exists(F.zip_with(got, wanted, lambda a, b: F.coalesce(a == b, F.lit(False))), lambda x: ~x)


def trained_text(turns: Column, role: str = "assistant") -> Column:
    """The text under the loss mask: each text of that role, unescaped, in order, with nothing between."""
    return F.array_join(F.transform(F.filter(turns, lambda t: t["role"] == role), lambda t: t["text"]), "")
