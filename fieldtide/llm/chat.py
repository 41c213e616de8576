"""Chat formatting on built-in functions only.

A conversation is a list of turns, a turn a list of typed parts (text, image, audio, document).
The visitor below turns the parts into text: runs of texts have their control strings escaped,
the others become a placeholder. Attachments keep order, kind, reference and token count.

    <s>role\\ntext of the turn</s><s>role\\n...</s>

Escaping adds one backslash behind the bracket of whatever looks like a control string
(`</s>` -> `<\\/s>`, `<\\/s>` -> `<\\\\/s>`), so it is undone exactly by taking one away.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The control strings of the template and of common instruction formats.
CONTROL = r"/?s>|/?INST\]|/?SYS>>|image>|audio>|document>"
BEGIN, END = "<s>", "</s>"
PLACEHOLDERS = ("image", "audio", "document")
LEARNED_ROLE = "assistant"

PART = T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("text", T.StringType()),
    T.StructField("ref", T.StringType()), T.StructField("tokens", T.LongType()),
])


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*)({CONTROL})", r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*)({CONTROL})", "$1$2$3")


def escape_role(role: Column) -> Column:
    """A role ends at the line's end, so line feeds and backslashes in it are spelled out."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\"))


def text_part(text: Column) -> Column:
    return F.struct(
        F.lit("text").alias("kind"), text.alias("text"), F.lit(None).cast("string").alias("ref"),
        F.lit(0).cast("long").alias("tokens"))


def _visit(parts: Column) -> Column:
    """The text that stands for the parts: neighbouring texts are one run, escaped as a whole.

    So no control string can be put together from the ends of two parts. A placeholder ends a
    run. Null parts and text parts without text are empty and end none; no parts, no text.
    """
    kind = lambda p: F.coalesce(p["kind"], F.lit("text"))

    def placeholder(p: Column) -> Column:
        return F.when(kind(p).isin(*PLACEHOLDERS), F.concat(F.lit("<"), kind(p), F.lit(">"))).otherwise(
            F.raise_error(F.concat(F.lit("unknown part kind: "), kind(p))))

    def step(so_far: Column, p: Column) -> Column:
        said = F.when(p["kind"] == "text", F.coalesce(p["text"], F.lit(""))).otherwise(F.lit(""))
        return F.when(kind(p) == "text", F.struct(
            so_far["done"].alias("done"), F.concat(so_far["run"], said).alias("run"))).otherwise(F.struct(
                F.concat(so_far["done"], escape(so_far["run"]), placeholder(p)).alias("done"), F.lit("").alias("run")))

    none = F.struct(F.lit("").alias("done"), F.lit("").alias("run"))
    return F.aggregate(parts, none, step, lambda x: F.concat(x["done"], escape(x["run"])))


def flatten_parts(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, parts array<PART>) -> body, attachments, expanded tokens.

    attachments: (kind, ref, tokens) in the order of their placeholders. A null count is 0.
    """
    media = F.filter("parts", lambda p: p["kind"].isin(*PLACEHOLDERS))
    return turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce(_visit(F.col("parts")), F.lit("")).alias("body"),
        F.coalesce(F.transform(media, lambda p: F.struct(
            p["kind"].alias("kind"), p["ref"].alias("ref"),
            F.coalesce(p["tokens"], F.lit(0)).cast("long").alias("tokens"))),
            F.array().cast("array<struct<kind:string,ref:string,tokens:bigint>>")).alias("attachments"),
    )


def format_chats(turns: DataFrame) -> DataFrame:
    """One row per conversation: its formatted text, loss mask, attachments and token counts.

    turns: conv_id, turn, role and either `parts` (array<PART>) or `text` (one text part).
    Null text, parts or role: empty. Rows are ordered by turn, ties by role and text; repeated
    rows are turns of their own; a null turn comes first; rows without conv_id form one
    conversation. Further columns are ignored. No turns, no rows.
    loss_spans: (turn_index, turn_begin, begin, length) in characters of `formatted`, one for
    each turn of the assistant. A conversation is one string by its nature, so its size is that
    of the caller's conversation; nothing else is gathered.
    """
    if "parts" not in turns.columns:
        turns = turns.withColumn("parts", F.array(text_part(F.col("text"))))
    head = F.concat(F.lit(BEGIN), escape_role(F.col("role")), F.lit("\n"))
    flat = flatten_parts(turns).select("*", head.alias("head"))
    flat = flat.select("*", F.concat("head", "body", F.lit(END)).alias("said"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "body")
    length = F.char_length("said")
    placed = flat.select(
        "conv_id", "said", "attachments", (F.row_number().over(order) - 1).alias("at"),
        (F.sum(length).over(order.rowsBetween(Window.unboundedPreceding, 0)) - length).alias("turn_begin"),
        F.when(F.col("role") == LEARNED_ROLE, F.char_length("body")).alias("length"),
        F.char_length("head").alias("skip"),
    )
    gathered = placed.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("at", "said", "attachments"))).alias("turns"),
        F.sort_array(F.collect_list(F.when(F.col("length").isNotNull(), F.struct(
            F.col("at").alias("turn_index"), "turn_begin",
            (F.col("turn_begin") + F.col("skip")).alias("begin"), "length")))).alias("loss_spans"),
    )
    return gathered.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: t["said"]), "").alias("formatted"),
        "loss_spans", F.flatten(F.transform("turns", lambda t: t["attachments"])).alias("attachments"),
    ).withColumn("expanded_tokens", F.aggregate(
        F.transform("attachments", lambda a: a["tokens"]), F.lit(0).cast("long"), lambda x, y: x + y))


def _segments(formatted: Column) -> Column:
    """The turns of a formatted text without their ends; the last piece of the split is empty."""
    cut = F.split(formatted, END)
    return F.slice(cut, F.lit(1), F.greatest(F.size(cut) - 1, F.lit(0)))


def read_turns(formatted: Column) -> Column:
    """Formatted text -> array of (role, text), unescaped. Placeholders stay as they are."""
    def turn(segment: Column) -> Column:
        at = F.instr(segment, "\n")
        return F.struct(
            unescape_role(segment.substr(F.lit(len(BEGIN) + 1), at - F.lit(len(BEGIN) + 1))).alias("role"),
            unescape(segment.substr(at + 1, F.char_length(segment))).alias("text"))

    return F.transform(_segments(formatted), turn)


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    segments = _segments(formatted)
    return F.array_join(F.transform(spans, lambda s: unescape(
        F.get(segments, s["turn_index"]).substr(
            (s["begin"] - s["turn_begin"] + 1).cast("int"), s["length"]))), "")
