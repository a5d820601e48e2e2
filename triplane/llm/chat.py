"""Chat formatting by a grammar round trip, with DataFrame operations alone.

A turn is rendered as a frame of control strings around its text. The rendered turn is parsed again by a
deterministic grammar and held against the source. Turns that do not come back are rendered anew with escapes, parsed and
held against the source again; the frame's opening says which form it has. An escaped text holds no control sign, so it
comes back; one that did not would end the job with an error.

    turn   = "<s>[INST]" text "[/INST]"             a user's turn
           | "<s>[OUT]" text "</s>"                 an assistant's turn, under the loss mask
           | "<s>[ROLE:" role "]" text "[/ROLE]"    any other role
           escaped: "<s>[!INST]", "<s>[!OUT]", "<s>[!ROLE:"
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Control strings that a text written as it is must not hold: fixed values of the grammar.
CONTROL = r"<s>|</s>|\[!?INST\]|\[/INST\]|\[!?OUT\]|\[!?ROLE:|\[/ROLE\]"
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&lsqb;"), ("]", "&rsqb;"))
FRAME = r"(?s)<s>\[(!?)(INST|OUT|ROLE:([^\]]*))\](.*?)(?:\[/INST\]|</s>|\[/ROLE\])"


def escape(c: Column) -> Column:
    for plain, coded in ESCAPES:
        c = F.replace(c, F.lit(plain), F.lit(coded))
    return c


def unescape(c: Column) -> Column:
    for plain, coded in reversed(ESCAPES):
        c = F.replace(c, F.lit(coded), F.lit(plain))
    return c


def _render(role: Column, text: Column, escaped: bool) -> Column:
    sign, body = ("!", escape(text)) if escaped else ("", text)
    return (
        F.when(role == "user", F.concat(F.lit(f"<s>[{sign}INST]"), body, F.lit("[/INST]")))
        .when(role == "assistant", F.concat(F.lit(f"<s>[{sign}OUT]"), body, F.lit("</s>")))
        .otherwise(F.concat(F.lit(f"<s>[{sign}ROLE:"), escape(role) if escaped else role, F.lit("]"), body, F.lit("[/ROLE]")))
    )


def _parsed(rendered: Column) -> Column:
    """Array of (role, text): the turns that the grammar finds in a rendered string."""
    part = lambda i: F.regexp_extract_all(rendered, F.lit(FRAME), F.lit(i))
    zipped = F.arrays_zip(part(1).alias("sign"), part(2).alias("tag"), part(3).alias("name"), part(4).alias("body"))

    def turn(x):
        coded = x["sign"] == "!"
        role = F.when(x["tag"] == "INST", F.lit("user")).when(x["tag"] == "OUT", F.lit("assistant")).otherwise(F.when(coded, unescape(x["name"])).otherwise(x["name"]))
        return F.struct(role.alias("role"), F.when(coded, unescape(x["body"])).otherwise(x["body"]).alias("text"))

    return F.transform(zipped, turn)


def rendered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and the rendered turn, escaped only where its plain form does not come back."""
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    def comes_back(rendered: Column) -> Column:
        # With a turn behind it: "<s" at the end of a text may not join what follows.
        back = _parsed(F.concat(rendered, F.lit("<s>[INST][/INST]")))
        return (F.size(back) == 2) & (back[0]["role"] == F.col("role")) & (back[0]["text"] == F.col("text")) & (back[1]["text"] == "")

    plain, escaped = (_render(F.col("role"), F.col("text"), form) for form in (False, True))
    clean = ~F.rlike(F.concat_ws(" ", "role", "text"), F.lit(CONTROL))
    lost = F.raise_error(F.concat(F.lit("a turn does not come back from its escaped form: "), F.col("text")))
    return rows.withColumn("rendered", F.when(clean & comes_back(plain), plain).when(comes_back(escaped), escaped).otherwise(lost))


def format_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id, formatted (the rendered turns of a conversation in order of turn, role and text)."""
    turns = rendered_turns(conversations)
    listed = F.array_sort(F.collect_list(F.struct("turn", "role", "text", "rendered")))
    return turns.groupBy("conv_id").agg(F.array_join(F.transform(listed, lambda x: x["rendered"]), "").alias("formatted"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, as parsed from ``formatted``."""
    parsed = formatted.withColumn("_t", _parsed(F.col("formatted")))
    loss = F.array_join(F.transform(F.filter("_t", lambda x: x["role"] == "assistant"), lambda x: x["text"]), "")
    whole = F.array_join(F.transform("_t", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return parsed.select(
        "conv_id", F.size("_t").cast("long").alias("n_turns"), sha(whole).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"),
        sha(loss).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def chat_format(conversations: DataFrame) -> DataFrame:
    """The digests of every conversation's turns, read back from its formatted text.

    Null text and null role count as empty; turns are ordered by turn, then role, then text, nulls first; repeated
    rows are turns of their own; rows of null conv_id are one conversation; other columns are ignored; an empty
    table gives an empty result. A conversation is one string by its contract, so one task holds each one's text.
    """
    return read_back(format_conversations(conversations))
