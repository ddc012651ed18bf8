"""Joins and windows on symbol, section, match and interval tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pair_symbols(old: DataFrame, new: DataFrame, old_length: int | None = None, new_length: int | None = None) -> DataFrame:
    """(pair_id, name, n_off, o_off, size) from (pair_id, name, off, size): by name, of repeated old names the last by offset; the
    smaller size, inside both images, more than 0."""
    last = old.groupBy("pair_id", "name").agg(F.max(F.struct("off", "size")).alias("o"))
    j = new.join(last, ["pair_id", "name"]).select("pair_id", "name", F.col("off").alias("n_off"), F.col("o.off").alias("o_off"), F.least("size", "o.size").alias("size"))
    ok = (F.col("n_off") >= 0) & (F.col("o_off") >= 0) & (F.col("size") > 0)
    if old_length is not None:
        ok = ok & (F.col("o_off") < old_length)
    if new_length is not None:
        ok = ok & (F.col("n_off") < new_length)
    return j.where(ok)


def pair_sections(old: DataFrame, new: DataFrame) -> DataFrame:
    """(pair_id, section_index, n_off, o_off, size) from (pair_id, section_index, off, size, image_len): same index, cut to both images."""
    cut = lambda t, s: t.select("pair_id", "section_index", F.col("off").alias(f"{s}_off"), F.least("size", F.col("image_len") - F.col("off")).alias(f"{s}_size"))
    return cut(new, "n").join(cut(old, "o"), ["pair_id", "section_index"]).select("pair_id", "section_index", "n_off", "o_off", F.least("n_size", "o_size").alias("size")).where("size > 0 AND n_off >= 0 AND o_off >= 0")


def symbols_in_sections(symbols: DataFrame, sections: DataFrame) -> DataFrame:
    """Adds file_off: the symbol's place in the file by its section's."""
    s = sections.select("image_id", "section_index", F.col("addr").alias("s_addr"), F.col("file_offset").alias("s_off"))
    return symbols.join(s, ["image_id", "section_index"]).withColumn("file_off", F.col("s_off") + F.col("addr") - F.col("s_addr")).drop("s_addr", "s_off")


def union_of_intervals(spans: DataFrame, key: str = "pair_id") -> DataFrame:
    """(key, start, end): disjoint intervals that cover what (key, start, end) cover."""
    by = Window.partitionBy(key).orderBy("start", "end")
    reach = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(reach.isNull() | (F.col("start") > reach), 1).otherwise(0)).over(by.rowsBetween(Window.unboundedPreceding, 0))
    return spans.where("end > start").withColumn("island", island).groupBy(key, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def gaps(spans: DataFrame, lengths: DataFrame, key: str = "pair_id") -> DataFrame:
    """(key, start, end): what intervals leave of [0, length), from (key, length)."""
    edge = lengths.select(key, F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("end")).unionByName(union_of_intervals(spans, key).select(key, "start", "end")).unionByName(lengths.select(key, F.col("length").alias("start"), F.col("length").alias("end")))
    by = Window.partitionBy(key).orderBy("start", "end")
    return edge.select(key, F.max("end").over(by.rowsBetween(Window.unboundedPreceding, 0)).alias("from"), F.lead("start").over(by).alias("to")).where("to > from").select(key, F.col("from").alias("start"), F.col("to").alias("end"))


def overlaps(matches: DataFrame, regions: DataFrame, least: int = 8, bin_size: int = 4096) -> DataFrame:
    """Matches (pair_id, n_off, o_off, length) clipped to regions (pair_id, region_id, start, end), ``least`` bytes at least.

    An equi-join on bins of the new image, so no side is compared with all of the other's rows; a hit is counted in
    the bin where it starts.
    """
    bins = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / bin_size), F.floor((F.col(b) - 1) / bin_size)))
    m = matches.where("length > 0").withColumn("m_end", F.col("n_off") + F.col("length")).withColumn("bin", bins("n_off", "m_end"))
    r = regions.where("end > start").withColumn("bin", bins("start", "end"))
    j = m.join(r, ["pair_id", "bin"]).withColumn("a", F.greatest("n_off", "start")).withColumn("b", F.least("m_end", "end"))
    j = j.where((F.col("b") - F.col("a") >= least) & (F.floor(F.col("a") / bin_size) == F.col("bin")))
    return j.select("pair_id", "region_id", F.col("a").alias("n_off"), (F.col("o_off") + F.col("a") - F.col("n_off")).alias("o_off"), (F.col("b") - F.col("a")).alias("length"))


def coverage_score(symbols: DataFrame, length: int) -> DataFrame:
    """(image_id, score): bytes of symbols inside the image, overlaps counted each."""
    inside = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.lit(length) - F.col("off")))
    return symbols.groupBy("image_id").agg(F.sum(inside).alias("score"))
