"""Mixing sources to target weights: hash-random order inside each source, distributed prefix sums, exact cuts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bytelake.llm.common import materialize, named, text_or_empty, words


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def source_targets(sources: DataFrame, weights: tuple[float, ...], share: float, max_epochs: int) -> DataFrame:
    """(source, source_size, target) from (source, source_size): one row a source.

    Weights repeat over the sources by code point, null last. Targets are min(max_epochs * size, level * weight)
    with the one level at which they sum to share * all sizes (what capping and resharing ends in).
    """
    one = Window.orderBy(F.asc_nulls_last("source"))
    s = sources.withColumn("nth", F.row_number().over(one) - 1)
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("nth", F.lit(len(weights))) + 1).cast("int"))).withColumn("cap", F.col("source_size").cast("double") * max_epochs)
    fill, every = Window.orderBy(F.col("cap") / F.col("weight"), "nth"), Window.partitionBy()
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("level", (F.sum(F.col("source_size").cast("double")).over(every) * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    # Sources capped come first in this order; the first whose level its own cap doesn't undercut sets the level of the rest.
    s = s.withColumn("rank", F.row_number().over(fill)).withColumn("free", F.min(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct("rank", "level"))).over(every))
    return s.select("source", "source_size", F.when(F.col("free").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("free.level") * F.col("weight"))).alias("target"))


def mix_sources(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, max_epochs: int = 2, seed: str = "mix", buckets: int = 4096) -> DataFrame:
    """How many words of each document the mix takes: (doc_id, source, size, source_size, target, taken), one row for each input row.

    size counts the words of the text. A source's budget floor(target) takes whole epochs of all its documents, then
    documents in the order of a seeded hash of the identifier, the one at the end in part: taken words of a source
    equal its budget exactly, and no document exceeds max_epochs times its size.

    Plan: the texts are read once, narrow; what is left is (doc_id, source, size, hash), written to the shared
    folder. The hash's leading bits deal each source into ``buckets`` ordered ranges, so a source with most rows is
    spread like any other; prefix sums are a window inside (source, range) plus the sums of the ranges before,
    a window over at most ``buckets`` rows a source. Windows over the list of sources see one row a source.

    Defined cases: null text has size 0 and taken 0; null source is a source, the last; null identifiers hash as
    the word null; equal identifiers are ordered by size, repeated rows count each. If all sizes are 0, targets are 0. An
    empty table gives an empty result. Other columns are not read.
    """
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")))
    rows = materialize(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(text_or_empty(text_col)).alias("size"), F.md5(name).alias("key")), "sizes")
    rows = rows.withColumn("range", (F.conv(F.substring("key", 1, 6), 16, 10).cast("long") * buckets / F.lit(1 << 24)).cast("long"))
    sums = rows.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    by = Window.partitionBy("source").orderBy("range")
    starts = sums.withColumn("start", F.sum("range_size").over(by) - F.col("range_size")).select(F.col("source").alias("s"), F.col("range").alias("r"), "start")
    targets = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, max_epochs).withColumnRenamed("source", "t")
    inside = Window.partitionBy("source", "range").orderBy("key", "size")
    cum = rows.withColumn("inside", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    cum = cum.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r"))).join(targets, F.col("source").eqNullSafe(F.col("t")))
    budget, before = F.floor("target").cast("long"), F.col("start") + F.col("inside")
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size")).cast("long")).otherwise(F.lit(0).cast("long"))
    rest = budget - whole * F.col("source_size")
    return cum.select("doc_id", "source", "size", "source_size", "target", (whole * F.col("size") + F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest - before))).cast("long").alias("taken"), "key")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document as often as it is taken whole, then the part, all columns of docs kept.

    Rows are told apart by their content, so docs may repeat identifiers. A part is the document's first words
    (taken modulo size of them), joined by single spaces; documents of which nothing is taken are left out, also
    those without words. With clashing names (size, taken, ...) docs keeps its own columns.
    """
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    # Equal identifiers share what is taken: by (identifier, size) every row of such a set takes the same or the cut.
    taken = mix_sources(docs, **options).groupBy("doc_id", "source", "size").agg(F.sort_array(F.collect_list("taken"), asc=False).alias("list"))
    source_col = options.get("source_col", "source")
    ours = docs.select(F.struct(*[named(c) for c in docs.columns]).alias("row")).select(
        "row", named(id_col, "row.").alias("i"), named(source_col, "row.").alias("o"), n_words(text_or_empty(named(text_col, "row."))).alias("n")
    )
    nth = F.row_number().over(Window.partitionBy("i", "o", "n").orderBy(F.xxhash64("row")))
    on = F.col("i").eqNullSafe(F.col("doc_id")) & F.col("o").eqNullSafe(F.col("source")) & (F.col("n") == F.col("size"))
    j = ours.withColumn("nth", nth).join(taken, on).withColumn("take", F.element_at("list", F.col("nth"))).where("take > 0")
    j = j.withColumn("whole", F.floor(F.col("take") / F.col("n")).cast("int")).withColumn("part", (F.col("take") % F.col("n")).cast("int"))
    cut = F.array_join(F.slice(words(text_or_empty(named(text_col, "row."))), 1, F.col("part")), " ")
    parts = F.concat(F.array_repeat(F.lit(False), F.col("whole")), F.when(F.col("part") > 0, F.array(F.lit(True))).otherwise(F.array().cast("array<boolean>")))
    return j.withColumn("cut", F.explode(parts)).select(*[F.when(F.col("cut"), cut).otherwise(named(c, "row.")).alias(c) if c == text_col else named(c, "row.").alias(c) for c in docs.columns])

