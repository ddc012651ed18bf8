"""Sharding by extendible hashing: only buckets over the byte limit split on a further bit of the hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bytelake.llm.common import materialize, text_or_empty

#: Bits of the hash that are used: 15 hexadecimal digits of md5.
BITS = 60




def slot() -> Column:
    """The slot of a row: the first ``bits`` bits of its hash."""
    return F.expr(f"shiftright(hash, {BITS} - bits)").alias("slot")


def directory(rows: DataFrame, limit: int) -> DataFrame:
    """(bits, slot, depth) for the slots whose bucket is final, from (hash, bytes, base, bits): rows of an open bucket agree in their
    first ``base`` bits and are looked at by their first ``bits``. depth: of the bucket the slot belongs to.

    A bucket is final at the first depth at which it is within the limit, or holds one hash only.
    """
    slots = rows.groupBy("base", "bits", slot()).agg(F.sum("bytes").alias("bytes"), F.min("hash").alias("lo"), F.max("hash").alias("hi"))
    at = slots.withColumn("depth", F.explode(F.sequence("base", "bits"))).withColumn("prefix", F.expr("shiftright(slot, bits - depth)"))
    final = at.groupBy("bits", "depth", "prefix").agg(F.sum("bytes").alias("bytes"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).where((F.col("bytes") <= limit) | (F.col("lo") == F.col("hi")))
    return at.select("bits", "slot", "depth", "prefix").join(final.select("bits", "depth", "prefix"), ["bits", "depth", "prefix"], "left_semi").groupBy("bits", "slot").agg(F.min("depth").alias("depth"))


def extendible_shards(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 1 << 20, spare_bits: int = 4, most_bits: int = 22) -> DataFrame:
    """(doc_id, bytes, shard, depth, shard_bytes, shard_docs): the shard of every row, named by its hash prefix.

    The hash is of identifier and text, so copies of a text spread. A round looks at as many further bits of each open
    bucket as its bytes ask for, plus spare_bits, at most most_bits (so a directory has about 2 ** spare_bits slots for
    each shard, whatever the input's size); what is still over the limit goes to the next round as buckets of their
    own. Texts are read once and narrow; rounds work on (hash, bytes) rows in the shared folder, and each shuffles sums by slot.

    Rows equal in identifier and text have equal hashes that no bit can part: such a bucket is cut into numbered
    shards (prefix/number) of as many rows as the limit holds. A single document over the limit is alone in its shard,
    the only case in which a shard exceeds the limit.

    Defined cases: null text has 0 bytes; null identifiers hash as the word null; rows of 0 bytes alone make one
    shard named by the empty prefix; an empty table gives no rows. Other columns are not read.
    """
    text = text_or_empty(text_col)
    digest = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit(":"), text))
    rows = materialize(docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("bytes"), F.conv(F.substring(digest, 1, 15), 16, 10).cast("long").alias("hash")), "hashes")
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    width = lambda size: F.least(F.lit(most_bits), F.greatest(F.lit(1), F.ceil(F.log2(F.greatest(F.lit(1.0), size / limit))).cast("int") + spare_bits))
    left, placed = rows.withColumn("base", F.lit(0)).withColumn("bits", F.least(F.lit(BITS), width(F.lit(float(total))))), None
    while True:
        found = materialize(directory(left, limit), "directory")
        open_rows = left.withColumn("slot", slot())
        here = open_rows.join(found, ["bits", "slot"]).select("doc_id", "bytes", "hash", "depth")
        placed = here if placed is None else placed.unionByName(here)
        rest = materialize(open_rows.join(found, ["bits", "slot"], "left_anti"), "rest")
        if not rest.take(1):
            break
        sizes = rest.groupBy("bits", "slot").agg(width(F.sum("bytes")).alias("more"))
        left = rest.join(sizes, ["bits", "slot"]).select("doc_id", "bytes", "hash", F.col("bits").alias("base"), F.least(F.lit(BITS), F.col("bits") + F.col("more")).alias("bits"))
    name = F.expr(f"CASE WHEN depth = 0 THEN '' ELSE lpad(bin(shiftright(hash, {BITS} - depth)), depth, '0') END")
    named = placed.withColumn("name", name)
    sums = named.groupBy("name").agg(F.sum("bytes").alias("sum"), F.count("*").alias("n"), F.min("bytes").alias("one"))
    fits = named.join(sums.where(F.col("sum") <= limit), "name").select("doc_id", "bytes", F.col("name").alias("shard"), "depth", F.col("sum").alias("shard_bytes"), F.col("n").alias("shard_docs"))
    many = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.col("one"))).cast("long")
    over = named.join(sums.where(F.col("sum") > limit), "name").withColumn("nth", F.row_number().over(Window.partitionBy("name").orderBy("doc_id")) - 1).withColumn("part", F.floor(F.col("nth") / many).cast("long"))
    size = F.least(many, F.col("n") - F.col("part") * many)
    over = over.select("doc_id", "bytes", F.when(F.col("n") == 1, F.col("name")).otherwise(F.concat("name", F.lit("/"), F.col("part").cast("string"))).alias("shard"), "depth", (size * F.col("one")).alias("shard_bytes"), size.alias("shard_docs"))
    return fits.unionByName(over)
