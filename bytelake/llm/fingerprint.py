"""Document fingerprints: a sketch that keeps every shingle hash below a fixed fraction of the hash range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bytelake.llm.common import fold_ascii, text_or_empty, words

LARGEST = (1 << 63) - 1
#: Share of the hash range that a sketch keeps: half, for texts of some fifty words to have about 24 hashes.
FRACTION = 1 / 2
#: Null identifiers stand first.
FIRST = -(1 << 63)


def shingle_hashes(w: Column, k: int = 5) -> Column:
    """63-bit hash of every run of k words of the array w; with fewer words, of all of them as one; none without words."""
    whole = F.xxhash64(F.array_join(w, " "), F.lit(k))
    runs = F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]).bitwiseAND(F.lit(LARGEST)))
    return F.when(F.size(w) == 0, F.array().cast("array<bigint>")).when(F.size(w) < k, F.array(whole.bitwiseAND(F.lit(LARGEST)))).otherwise(runs)


def with_sketch(df: DataFrame, text: Column, name: str, *, k: int = 5, fraction: float = FRACTION) -> DataFrame:
    """Adds the sketch of a text: distinct hashes below fraction of the range, ascending, and always the smallest one,
    so only a text without words has an empty sketch."""
    w, h = f"__{name}_words", f"__{name}_hashes"
    df = df.withColumn(w, words(fold_ascii(text))).withColumn(h, shingle_hashes(F.col(w), k))
    return df.withColumn(name, retained(F.col(h), fraction)).drop(w, h)


def retained(hashes: Column, fraction: float) -> Column:
    below = F.filter(hashes, lambda x: x < int(LARGEST * fraction))
    return F.when(F.size(hashes) == 0, hashes).otherwise(F.sort_array(F.array_distinct(F.array_append(below, F.array_min(hashes)))))


def merge(a: Column, b: Column, fraction: float = FRACTION) -> Column:
    """The sketch of two texts taken together."""
    return retained(F.array_union(a, b), fraction)


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity; 1 if both are empty, 0 if one is."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / both)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has, whatever their lengths; 1 for an empty a."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def encode(sketch: Column) -> Column:
    return F.array_join(F.transform(sketch, lambda x: F.lower(F.hex(x))), " ")


def grid(keys: DataFrame, rows: int, most: int = 1 << 16) -> tuple[DataFrame, float] | None:
    """(g, cells) for at most 1026 equal ranges g of the key, each to be cut into that many cells, and the ranges' width.

    Cells hold about ``rows`` keys; a range that is denser than others is cut finer. Together there are at most about
    ``most`` cells.
    """
    lo, hi, n = keys.agg(F.min("key"), F.max("key"), F.count("*")).first()
    if not n:
        return None
    width = float(max(1, -(-(hi - lo + 1) // 1024)))
    rows = max(rows, -(-n // most))
    return keys.groupBy(F.floor(F.col("key") / width).cast("long").alias("g")).agg(F.ceil(F.count("*") / rows).cast("long").alias("cells")), width


def with_next(docs: DataFrame, rows: int = 2048) -> DataFrame:
    """Adds next_text to (key, doc_id, text): the text of the row after, by key then text, after the last the first.

    Rows are dealt to cells, ordered ranges of the key, and lead() runs inside a cell; the first rows of a cell are
    also dealt, as ghosts, to the end of the cell before. Cells number at most about 2 ** 16, so their list may be
    broadcast. The texts are shuffled once.
    """
    made = grid(docs.select("key"), rows)
    if made is None:
        return docs.withColumn("next_text", F.lit(None).cast("string"))
    ranges, width = made
    place = docs.withColumn("g", F.floor(F.col("key") / width).cast("long")).join(F.broadcast(ranges), "g")
    place = place.withColumn("h", F.least(F.col("cells") - 1, F.greatest(F.lit(0), F.floor((F.col("key") / width - F.col("g")) * F.col("cells")))).cast("long"))
    cells = place.groupBy("g", "h").agg(F.min("key").alias("least"))
    around = Window.orderBy("g", "h")
    last = F.max(F.struct("g", "h")).over(Window.partitionBy())
    cells = cells.withColumn("before", F.coalesce(F.lag(F.struct("g", "h")).over(around), last))
    own = F.struct("g", "h", F.lit(0).alias("ghost"))
    ghost = F.when(F.col("key") == F.col("least"), F.array(own, F.struct(F.col("before.g"), F.col("before.h"), F.lit(1).alias("ghost")))).otherwise(F.array(own))
    dealt = place.join(F.broadcast(cells), ["g", "h"]).withColumn("at", F.explode(ghost)).select("key", "doc_id", "text", "at.*").repartition("g", "h")
    follow = F.lead("text").over(Window.partitionBy("g", "h").orderBy("ghost", "key", "text"))
    return dealt.withColumn("next_text", follow).where("ghost = 0").select("key", "doc_id", "text", "next_text")


def fingerprint_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 5, fraction: float = FRACTION) -> DataFrame:
    """Fingerprints of every whole text, of its edited text, and their likeness and containment, also to the next document.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many (or all) of the next
    document, by ascending doc_id, after the last the first. Returns (doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next, in_edited, in_next), one row for each input row.

    Plan: texts are shuffled once, to ranges of doc_id (with_next); sketches are made after it, narrow.

    Defined cases: null text is empty, its fingerprint the empty string; null identifiers stand before all others;
    rows that repeat an identifier follow each other by text; a lone document is its own next; an empty table gives no
    rows. Other columns are not read.
    """
    rows = with_next(docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(FIRST)).alias("key"), F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")))
    sketch = lambda df, name: with_sketch(df, F.col(name), f"{name}_sketch", k=k, fraction=fraction)
    both = rows.withColumn("n", F.length("text")).withColumn("half", F.floor(F.col("n") / 2).cast("int"))
    both = both.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), F.col("n") - F.col("half")), F.substring(F.col("next_text"), F.lit(1), F.col("half"))))
    both = sketch(sketch(sketch(both, "text"), "edited"), "next_text")
    a, b, c = F.col("text_sketch"), F.col("edited_sketch"), F.col("next_text_sketch")
    return both.select(
        "doc_id", F.col("n").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), encode(a).alias("fingerprint"), encode(b).alias("edited_fingerprint"),
        likeness(a, b).alias("near_edited"), likeness(a, c).alias("near_next"), containment(a, b).alias("in_edited"), containment(a, c).alias("in_next"),
    )
