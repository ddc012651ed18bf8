"""Exact duplicates by content sort: range-partition normalised bytes, sort, compare neighbours in full."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bytelake.llm.common import fold_ascii, named, strings, text_or_empty


def content_sort_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", carry: list[str] | None = None, block_rows: int = 1000) -> DataFrame:
    """Groups of equal texts; one row of each group stays.

    Texts are equal when identical after lower-casing A-Z only. Returns (doc_id, keep_id, group_size, kept,
    text_sha256), one row for each input row, and with ``carry`` a struct ``row`` of those input columns. ``keep``
    is 'min' or 'max': the row with the smallest or the largest identifier stays.

    Plan: one shuffle of the texts. Sampled splitters on (first 32 characters, digest, salt) deal them out, so the
    sampled keys stay small whatever the texts' length; each task sorts its share externally and rows with equal
    keys and equal whole texts form a run. A text whose copies exceed max(block_rows, rows / 10,000) is "hot": there
    are at most 10,000 such texts, so their list may be broadcast; their copies are salted over blocks of about
    block_rows. Size and survivor of hot texts come from a second pass over those rows alone, combined in each task
    by the whole text before anything is shuffled. A digest never decides that two texts are equal.

    Defined cases: a null text is empty; empty texts are equal to each other. Null identifiers lose against any
    other; if a group has only null identifiers, keep_id is null and one of its rows stays. Rows that repeat an
    identifier and text are copies of each other: exactly one stays. An empty table gives an empty result. Other
    columns, whatever their names, are not read unless carried.
    """
    best, order = {"min": (F.min, F.asc_nulls_last), "max": (F.max, F.desc_nulls_last)}[keep]
    text = text_or_empty(text_col)
    rows = docs.select(
        F.col(id_col).alias("doc_id"), text.alias("text"), *([F.struct(*[named(c) for c in carry if c != text_col]).alias("rest")] if carry else []), *([F.col(text_col).isNull().alias("void")] if carry else [])
    ).withColumn("text_sha256", F.sha2(fold_ascii(F.col("text")), 256))
    least = max(block_rows, docs.count() // 10_000)
    many = rows.groupBy("text_sha256").agg(F.count("*").alias("n")).where(F.col("n") > least).select("text_sha256")
    many = [r[0] for r in many.collect()]  # at most 10,000
    listed = F.broadcast(strings(docs.sparkSession, "text_sha256", many))
    copies = rows.join(listed, "text_sha256").groupBy("text_sha256", fold_ascii(F.col("text")).alias("norm")).agg(F.count("*").alias("hot_size"), best("doc_id").alias("hot_keep"))
    # Of different texts with one digest, none is hot here: their rows go without salt.
    hot = copies.withColumn("texts", F.count("*").over(Window.partitionBy("text_sha256"))).where("texts = 1").select("text_sha256", "hot_size", "hot_keep")
    dealt = (
        rows.join(F.broadcast(hot), "text_sha256", "left")
        .withColumn("salt", F.when(F.col("hot_size").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("hot_size") / block_rows))).cast("long"))
        .withColumn("head", F.substring(fold_ascii(F.substring("text", 1, 32)), 1, 32))
        .repartitionByRange("head", "text_sha256", "salt")
        .withColumn("norm", fold_ascii(F.col("text")))
    )
    run = Window.partitionBy("head", "text_sha256", "salt", "norm")
    out = dealt.select(
        "doc_id", "text_sha256", "hot_size", "hot_keep", *(["rest", "text", "void"] if carry else []),
        F.row_number().over(run.orderBy(order("doc_id"))).alias("nth"), best("doc_id").over(run).alias("run_keep"), F.count("*").over(run).alias("run_size"), F.col("salt"),
    ).withColumn("keep_id", F.when(F.col("hot_size").isNull(), F.col("run_keep")).otherwise(F.col("hot_keep")))
    #: A hot group without any identifier is dealt to one salt, for xxhash64(null) is constant.
    kept = (F.col("nth") == 1) & F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return out.select(
        "doc_id", "keep_id", F.coalesce("hot_size", "run_size").alias("group_size"), kept.alias("kept"), "text_sha256",
        *([F.struct(*[(F.when(~F.col("void"), F.col("text")) if c == text_col else named(c, "rest.")).alias(c) for c in carry]).alias("row")] if carry else []),
    )
