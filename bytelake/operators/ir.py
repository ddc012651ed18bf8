"""Disassembly as a token stream: lines to instructions, shared token ids, matches of tokens carried over to bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bytelake.functions.kernels import Match, maximal_matches, merged_neighbours
from bytelake.functions.names_sql import mnemonic_class, operand_text
from bytelake.sources.symbols import DISASSEMBLY


def instruction_rows(lines: DataFrame, lo: int | None = None, hi: int | None = None, size: int | None = None) -> DataFrame:
    """(image_id, idx, addr, size, token, operands) of disassembly lines (image_id, line_no, text), by address, inside [lo, hi)."""
    part = lambda k: F.regexp_extract("text", DISASSEMBLY.pattern, k)
    rows = lines.where(F.col("text").rlike(DISASSEMBLY.pattern)).select("image_id", "line_no", F.conv(part(1), 16, 10).cast("long").alias("addr"), (F.lit(size) if size else F.ceil(F.length(part(2)) / 2).cast("int")).alias("size"), mnemonic_class(part(3)).alias("token"), operand_text(part(4)).alias("operands"))
    rows = rows.where((F.col("addr") >= (lo if lo is not None else 0)) & (F.col("addr") < (hi if hi is not None else (1 << 63) - 1)))
    idx = F.row_number().over(Window.partitionBy("image_id").orderBy("addr", "line_no")) - 1
    return rows.withColumn("idx", idx.cast("long")).drop("line_no")


def token_ids(rows: DataFrame, most: int = 1 << 16) -> DataFrame:
    """Adds token_id, one numbering for all images. The alphabet may have at most ``most`` tokens, or there is an error: it is numbered
    on the driver and broadcast."""
    known = [r[0] for r in rows.select("token").distinct().orderBy("token").limit(most + 1).collect()]
    if len(known) > most:
        raise ValueError(f"over {most} different tokens")
    ids = rows.sparkSession.createDataFrame(list(zip(known, range(len(known)), strict=True)), "token string, token_id int")
    return rows.join(F.broadcast(ids), "token")


def token_matches(old: bytes, new: bytes, least: int = 4) -> list[Match]:
    """Maximal runs of equal tokens; streams are bytes of token ids."""
    return [Match(*m) for m in maximal_matches(old, new, least).tolist()]


def byte_matches(found: list[Match], old: list[tuple[int, int]], new: list[tuple[int, int]], old_image: bytes, new_image: bytes) -> list[Match]:
    """Token matches as matches of really equal bytes. old, new: (offset, size) of each instruction; runs break where sizes, bytes or
    places don't follow each other."""
    out: list[Match] = []
    for m in found:
        for k in range(m.length):
            (a, s), (b, t) = new[m.new + k], old[m.old + k]
            if s == t and new_image[a : a + s] == old_image[b : b + t]:
                out.append(Match(a, b, s))
    return merged_neighbours(sorted(set(out)), 0)


def section_bounds(sections: DataFrame, name: str) -> DataFrame:
    """(image_id, addr_start, addr_end) of the first section so named, or whose name starts so; sections of no size are none."""
    hit = sections.where((F.col("name") == name) | F.col("name").startswith(name)).where("size > 0")
    first = hit.groupBy("image_id").agg(F.min(F.struct(F.col("name") != name, "section_index", "addr", "size")).alias("s"))
    return first.select("image_id", F.col("s.addr").alias("addr_start"), (F.col("s.addr") + F.col("s.size")).alias("addr_end"))
