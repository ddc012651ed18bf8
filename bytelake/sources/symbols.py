"""Symbol metadata: tolerant JSON, linker maps and text dumps into tables, and the tables' derived columns."""

from __future__ import annotations

import json
import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bytelake.functions.names_sql import good_symbol, norm_site
from bytelake.operators.rowwise import flat_map

SYMBOLS = "image_id string, name string, addr long, file_offset long, off long, size long, type string"


def number(v: object) -> int | None:
    """A number, or text that is one, decimal or 0x; anything else is none."""
    if isinstance(v, bool) or v is None:
        return None
    if isinstance(v, int | float):
        return int(v)
    try:
        return int(str(v), 0)
    except ValueError:
        return None


def flat_symbols(text: str | None) -> list[tuple]:
    """(name, addr, file_offset, off, size, type) of every well-formed entry of a symbol JSON.

    Layouts: a list under "symbols"; a dict of name to entry or to a list of segments, under "symbols", in the root, or in
    each of "sections". The rest, and text that is no JSON, is skipped.
    """
    try:
        root = json.loads(text or "")
    except ValueError:
        return []
    if not isinstance(root, dict):
        return []
    tables = [root["symbols"]] if isinstance(root.get("symbols"), dict | list) else []
    sections = root.get("sections")
    for s in sections.values() if isinstance(sections, dict) else sections if isinstance(sections, list) else []:
        if isinstance(s, dict) and isinstance(s.get("symbols"), dict | list):
            tables.append(s["symbols"])
    out = []
    for t in tables or [{k: v for k, v in root.items() if isinstance(v, dict | list)}]:
        named = [(e.get("name") or e.get("symbol") or e.get("func"), e) for e in t if isinstance(e, dict)] if isinstance(t, list) else [(k, e) for k, v in t.items() for e in (v if isinstance(v, list) else [v]) if isinstance(e, dict)]
        out += [(str(n), number(e.get("addr")), number(e.get("file_offset")), number(e.get("off")), number(e.get("size")) or 0, e.get("type")) for n, e in named if n]
    return out


def symbol_table(files: DataFrame, flash_base: int = 0) -> DataFrame:
    """Symbols of JSON texts (image_id, text): off is addr less the base where there is a base and an address, else file_offset, else
    off; entries without a place, before the image's start or of no size are dropped."""
    rows = flat_map(files.select("image_id", "text"), flat_symbols, "image_id string, name string, addr long, file_offset long, given long, size long, type string", keep=1)
    off = F.when(F.col("addr").isNotNull() & F.lit(flash_base > 0), F.col("addr") - flash_base).otherwise(F.coalesce("file_offset", "given"))
    return rows.withColumn("off", off).where(good_symbol(F.col("name")) & (F.col("off") >= 0) & (F.col("size") > 0)).select(*[c.split()[0] for c in SYMBOLS.split(", ")])


def read_symbols(spark: SparkSession, path: str, flash_base: int = 0) -> DataFrame:
    """Symbols of the JSON files below a path; the image is the file's path. Where there is no such path there are no symbols."""
    try:
        files = spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("image_id"), F.col("value").alias("text"))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        files = spark.createDataFrame([], "image_id string, text string")
    return symbol_table(files, flash_base)


def map_symbols(lines: DataFrame, flash_base: int, image_length: int) -> DataFrame:
    """Symbols of linker map lines (image_id, line_no, text): the first address in [base, base + length], the last good name on the
    line that is no number, no address and no path, less commas and colons at its end; of one address the least name. Size is the
    distance to the next, so the last one, without size, is dropped."""
    found = F.transform(F.regexp_extract_all("text", F.lit(r"\b0x([0-9a-fA-F]+)\b"), F.lit(1)), lambda x: F.conv(x, 16, 10).cast("long"))
    words = F.filter(F.split(F.trim("text"), r"\s+"), lambda t: ~t.rlike(r"^(?:0x[0-9a-fA-F]+|[0-9]+)$|[\\/]"))
    tokens = F.filter(F.transform(words, lambda t: F.regexp_replace(t, "[,:]+$", "")), good_symbol)
    rows = lines.withColumn("addr", F.get(F.filter(found, lambda a: a.between(flash_base, flash_base + image_length)), F.lit(0))).withColumn("name", F.try_element_at(tokens, F.lit(-1))).where("addr IS NOT NULL AND name IS NOT NULL")
    first = rows.withColumn("nth", F.row_number().over(Window.partitionBy("image_id", "addr").orderBy("name"))).where("nth = 1")
    size = F.lead("addr").over(Window.partitionBy("image_id").orderBy("addr")) - F.col("addr")
    return first.select("image_id", "name", "addr", (F.col("addr") - flash_base).alias("off"), size.alias("size")).where("size > 0")


def preferred_symbols(first: DataFrame, second: DataFrame) -> DataFrame:
    """Both tables (image_id, name, off, size): a name's rows come from the first where it has any."""
    return first.unionByName(second.join(first.select("image_id", "name").distinct(), ["image_id", "name"], "left_anti"))


def sized_symbols(symbols: DataFrame) -> DataFrame:
    """Adds size to (image_id, section_index, name, addr, size_decl, section_end): declared, else to the next address of the section, the
    last to the section's end. Of one address the name without $ stays, then the least."""
    one = Window.partitionBy("image_id", "section_index", "addr").orderBy(F.col("name").startswith("$"), "name")
    kept = symbols.withColumn("nth", F.row_number().over(one)).where("nth = 1").drop("nth")
    after = F.lead("addr").over(Window.partitionBy("image_id", "section_index").orderBy("addr"))
    return kept.withColumn("size", F.coalesce(F.when(F.col("size_decl") > 0, F.col("size_decl")), after - F.col("addr"), F.col("section_end") - F.col("addr")))


def code_regions(markers: DataFrame) -> DataFrame:
    """(image_id, section_index, start, end, type) between $a, $t (code) and $d (data) markers (image_id, section_index, addr, name, section_end)."""
    end = F.coalesce(F.lead("addr").over(Window.partitionBy("image_id", "section_index").orderBy("addr", "name")), "section_end")
    kind = F.when(F.col("name").rlike(r"^\$[at]"), "code").when(F.col("name").startswith("$d"), "data")
    return markers.where(kind.isNotNull()).select("image_id", "section_index", F.col("addr").alias("start"), end.alias("end"), kind.alias("type")).where("end > start")


# The lines of a text dump. Header of a section; first segment (number, load, file offset, address); section (number, name, kind,
# address, offset, size); symbol (number, name, address, section, type, binding, size); instruction (address, code, mnemonic, operands).
HEX = "(0x[0-9a-fA-F]+)"
HEADER_LINE = r"^Section #(\d+)\s+(.*?):\s*$"
SEGMENT_LINE = rf"^\s*\d+:\s+load\s+{HEX}\s+{HEX}"
SECTION_LINE = rf"^\s*(\d+):\s+(.+?)\s+(?:pbits|nobits)\s+{HEX}\s+{HEX}\s+{HEX}"
SYMBOL_LINE = rf"^\s*\d+:\s+(\S+)\s+{HEX}\s+(\S+)\s+(\S+)\s+(\S+)(?:\s+{HEX})?\s*$"
CODE_LINE = r"^\s*0x([0-9a-fA-F]+):\s+0x([0-9a-fA-F]{4}|[0-9a-fA-F]{8})\s+(\S+)\s*(.*)$"


def dump_tables(lines: DataFrame, norm_section: str = "P2 ro", lo: int = 0, hi: int = (1 << 32) - 1) -> dict[str, DataFrame]:
    """Segment, section, symbol and norm-site tables of text dumps (image_id, line_no, text).

    A line belongs to the section whose header stands last before it. Numbers are hexadecimal with 0x; addresses of
    symbols outside [lo, hi] and of Abs and Ext sections are dropped.
    """
    header = F.regexp_extract("text", HEADER_LINE, 1)
    before = Window.partitionBy("image_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("in", F.last(F.when(header != "", F.struct(header.cast("int").alias("index"), F.regexp_extract("text", HEADER_LINE, 2).alias("name"))), ignorenulls=True).over(before))
    value = lambda c: F.conv(F.regexp_replace(c, "^0x", ""), 16, 10).cast("long")
    seg, sec, sym, ins = SEGMENT_LINE, SECTION_LINE, SYMBOL_LINE, CODE_LINE
    part = lambda pattern, k: F.regexp_extract("text", pattern, k)
    section = rows.where("in IS NULL").where(F.col("text").rlike(sec)).select("image_id", part(sec, 1).cast("int").alias("section_index"), part(sec, 2).alias("name"), value(part(sec, 3)).alias("addr"), value(part(sec, 4)).alias("file_offset"), value(part(sec, 5)).alias("size"))
    symbol = rows.where("`in`.name = '.symtab'").where(F.col("text").rlike(sym) & ~part(sym, 3).isin("Abs", "Ext")).select("image_id", part(sym, 1).alias("name"), value(part(sym, 2)).alias("addr"), part(sym, 3).cast("int").alias("section_index"), part(sym, 4).alias("type"), part(sym, 5).alias("binding"), value(part(sym, 6)).alias("size_decl")).where(F.col("addr").between(lo, hi))
    site = norm_site(part(ins, 3), part(ins, 4), lo, hi)
    sites = rows.where(F.col("in.name") == norm_section).where(F.col("text").rlike(ins)).select("image_id", F.col("in.index").alias("section_index"), F.conv(part(ins, 1), 16, 10).cast("long").alias("addr"), site.alias("kind")).where("kind IS NOT NULL")
    first = Window.partitionBy("image_id").orderBy("line_no")
    segment = rows.where(F.col("text").rlike(seg)).withColumn("nth", F.row_number().over(first)).where("nth = 1").select("image_id", value(part(seg, 1)).alias("file_offset"), value(part(seg, 2)).alias("vaddr"))
    return {"segment": segment, "section": section, "symbol": symbol, "norm_site": sites}


DISASSEMBLY = re.compile(r"^\s*0x([0-9a-fA-F]+):\s+(?:0x)?([0-9a-fA-F]+)\s+([A-Za-z0-9_.]+)(.*)$")
