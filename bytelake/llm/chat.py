"""Chat formatting by event-sourced reconstruction: logs of one conversation, sorted and folded into final messages, then rendered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEAD, COLON, TAIL = "### ", ": ", "</turn>\n"


def escape(text: Column) -> Column:
    r"""Reversible: `\` becomes `\b`, `<` becomes `\l`, `#` becomes `\h`; no control string can then occur in a text."""
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l")), F.lit("#"), F.lit("\\h"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\h"), F.lit("#")), F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    r"""As escape(), and `:` becomes `\c`, for the colon ends a role."""
    return F.replace(escape(role), F.lit(":"), F.lit("\\c"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\c"), F.lit(":")))


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages of an event log (conv_id, seq, op, role, text, target).

    op 'message' (also null) starts a message; 'regenerate' starts one that replaces the message before it; 'delta'
    appends to the message that is open at its place; 'edit' replaces the whole text so far of message number
    ``target`` (from 0, in order of their start events, replaced ones counted; null: the open one). Deltas and edits
    before any start, and edits of a number that doesn't exist, have no effect. Equal seq: by op, role, text.
    Returns (conv_id, msg, role, text), msg gapless from 0.

    One shuffle, by conv_id; the windows and aggregates after it keep that partitioning.
    """
    text, op = F.coalesce("text", F.lit("")), F.coalesce("op", F.lit("message"))
    log = Window.partitionBy("conv_id").orderBy("seq", "op", "role", "text")
    starts = F.col("op").isin("message", "regenerate").cast("int")
    e = (
        events.select("conv_id", "seq", op.alias("op"), F.coalesce("role", F.lit("")).alias("role"), text.alias("text"), "target")
        .withColumn("nth", F.row_number().over(log))
        .withColumn("open", F.sum(starts).over(log.rowsBetween(Window.unboundedPreceding, 0)) - 1)
        .withColumn("msg", F.when(F.col("op") == "edit", F.coalesce("target", "open")).otherwise(F.col("open")).cast("long"))
        .where("msg >= 0")
    )
    one = Window.partitionBy("conv_id", "msg")
    e = (
        e.withColumn("base", F.max(F.when(F.col("op") != "delta", F.col("nth"))).over(one))
        .withColumn("begun", F.max(F.col("op").isin("message", "regenerate").cast("int")).over(one))
        .where((F.col("nth") >= F.col("base")) | F.col("op").isin("message", "regenerate"))
    )
    m = (
        e.where("begun = 1")
        .groupBy("conv_id", "msg")
        .agg(
            F.max(F.when(F.col("op").isin("message", "regenerate"), F.col("role"))).alias("role"),
            F.max(F.when(F.col("op").isin("message", "regenerate"), F.col("op"))).alias("how"),
            F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("nth") >= F.col("base"), F.struct("nth", "text")))), lambda x: x["text"]), "").alias("text"),
        )
    )
    by = Window.partitionBy("conv_id").orderBy("msg")
    return m.withColumn("next", F.lead("how").over(by)).where("next IS NULL OR next <> 'regenerate'").select("conv_id", (F.row_number().over(by) - 1).cast("long").alias("msg"), "role", "text")


def render(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row for each conversation: (conv_id, formatted, loss_spans), spans of code points, end exclusive.

    A message renders as ``### role: text</turn>`` and a line end, role and text escaped reversibly. The loss mask
    holds the escaped texts of loss_role. A conversation becomes one string, so it is one record in one task.
    """
    by = Window.partitionBy("conv_id").orderBy("msg")
    m = (
        messages.withColumn("head", F.concat(F.lit(HEAD), escape_role(F.col("role")), F.lit(COLON)))
        .withColumn("body", escape(F.col("text")))
        .withColumn("size", (F.length("head") + F.length("body") + len(TAIL)).cast("long"))
        .withColumn("at", F.sum("size").over(by) - F.col("size") + F.length("head"))
    )
    span = F.when((F.col("role") == loss_role), F.struct(F.col("at").cast("long").alias("start"), (F.col("at") + F.length("body")).cast("long").alias("end")))
    return m.groupBy("conv_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("msg", F.concat("head", "body", F.lit(TAIL)).alias("turn")))), lambda x: x["turn"]), "").alias("formatted"),
        F.sort_array(F.collect_list(span)).alias("loss_spans"),
    )


def parse(formatted: Column) -> Column:
    """The turns of a rendered conversation as array<struct<role, text>>, unescaped."""
    pieces = F.split(formatted, TAIL, -1)

    def turn(p: Column) -> Column:
        at = F.locate(COLON, p)
        return F.struct(unescape_role(F.substring(p, F.lit(len(HEAD) + 1), at - 1 - len(HEAD))).alias("role"), unescape(F.substring(p, at + len(COLON), F.length(p))).alias("text"))

    return F.transform(F.slice(pieces, 1, F.size(pieces) - 1), turn)


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")


def format_chats(conversations: DataFrame, *, conv_col: str = "conv_id", seq_col: str = "turn", role_col: str = "role", text_col: str = "text", op_col: str | None = None, target_col: str | None = None, loss_role: str = "assistant") -> DataFrame:
    """Event log to rendered conversations: (conv_id, formatted, loss_spans).

    Without op_col every row is a whole message. Null texts and roles are empty; null conv_id is a conversation of
    its own; rows with equal sequence numbers, also repeated rows, all count, ordered by op, role, text; no rows give
    no conversations. Only the named columns are read.
    """
    col = lambda c, kind: F.col(c).cast(kind) if c else F.lit(None).cast(kind)
    return render(fold_events(conversations.select(F.col(conv_col).alias("conv_id"), F.col(seq_col).alias("seq"), col(op_col, "string").alias("op"), F.col(role_col).alias("role"), F.col(text_col).alias("text"), col(target_col, "long").alias("target"))), loss_role)
