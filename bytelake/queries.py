"""The queries on the driver's tables, one for each operator or group of operators, and their DuckDB oracles.

Pairs: PL pages by consecutive page_id; DM documents against their mutations; CL turns of a conversation against the
turn before.
"""

from __future__ import annotations

import tempfile
import uuid
import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bytelake.functions import bytes_sql as B
from bytelake.functions import codec, kernels, names_sql
from bytelake.operators import ir, pairing, similarity
from bytelake.operators.rowwise import flat_map
from bytelake.plans import patching
from bytelake.sources import images, symbols
from bytelake.streaming.frames import reassemble

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.spread(images.text_images(table(spark, sf_dir, "documents"), "doc_id", "text"))


def page_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.consecutive_pairs(images.text_images(table(spark, sf_dir, "pages"), "page_id", "html"))


# SQL fragments. Bytes of a text as a list of integers; CRC-32 by its table, which is built by rule.
LIST = "list_transform(regexp_extract_all(hex(encode({})), '..'), lambda x: CAST('0x' || x AS BIGINT))"
CRC_TABLE = "(SELECT list_transform(range(256), lambda x: list_reduce(list_prepend(x, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tbl)"
CRC = "xor(list_reduce(list_prepend(4294967295, {}), lambda c, b: xor(c >> 8, tbl[(xor(c, b) & 255) + 1])), 4294967295)"
U = "(CASE WHEN {0} < 128 THEN 1 WHEN {0} < 16384 THEN 2 WHEN {0} < 2097152 THEN 3 WHEN {0} < 268435456 THEN 4 WHEN {0} < 34359738368 THEN 5 ELSE 6 END)"
PL = "pl AS (SELECT n.page_id AS pair_id, coalesce(o.html, '') AS old, coalesce(n.html, '') AS new FROM pages n JOIN pages o ON o.page_id = n.page_id - 1)"
#: One row for each place that both images have, with both bytes as two hex digits.
SAME_PLACE = f"""{PL},
l AS (SELECT pair_id, regexp_extract_all(hex(encode(old)), '..') AS o, regexp_extract_all(hex(encode(new)), '..') AS n FROM pl),
p AS (SELECT pair_id, unnest(range(least(len(o), len(n)))) AS i, unnest(o[:least(len(o), len(n))]) AS ob, unnest(n[:least(len(o), len(n))]) AS nb FROM l)"""
#: Runs of changed bytes at the same place.
CHANGES = f"""{SAME_PLACE},
c AS (SELECT pair_id, i, i - row_number() OVER (PARTITION BY pair_id ORDER BY i) AS g FROM p WHERE ob <> nb),
r AS (SELECT pair_id, min(i) AS off, count(*) AS len FROM c GROUP BY pair_id, g)"""
#: Maximal matches of 16 bytes or more.
MATCHES = f"""{PL},
lg AS (SELECT pair_id, hex(encode(old)) AS o, hex(encode(new)) AS n FROM pl),
og AS (SELECT pair_id, i, substr(o, 2 * i + 1, 32) AS g FROM (SELECT pair_id, o, unnest(range(greatest(0, len(o) // 2 - 15))) AS i FROM lg)),
ng AS (SELECT pair_id, i, substr(n, 2 * i + 1, 32) AS g FROM (SELECT pair_id, n, unnest(range(greatest(0, len(n) // 2 - 15))) AS i FROM lg)),
hit AS (SELECT ng.pair_id, ng.i AS ni, og.i AS oi FROM ng JOIN og ON ng.pair_id = og.pair_id AND ng.g = og.g),
isl AS (SELECT *, ni - row_number() OVER (PARTITION BY pair_id, ni - oi ORDER BY ni) AS k FROM hit),
m AS (SELECT pair_id, min(ni) AS n_off, min(oi) AS o_off, count(*) + 15 AS length FROM isl GROUP BY pair_id, ni - oi, k)"""


# Scans, frames, encoded lengths


@query(f"""
WITH i AS (SELECT 'document' AS kind, doc_id AS image_id, coalesce(text, '') AS t FROM documents UNION ALL SELECT 'page', page_id, coalesce(html, '') FROM pages)
SELECT kind, image_id, CAST(strlen(t) AS BIGINT) AS len, CAST({CRC.format(LIST.format("t"))} AS BIGINT) AS crc32 FROM i, {CRC_TABLE}
""")
def q_image_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = images.text_images(table(spark, sf_dir, "pages"), "page_id", "html")
    rows = documents(spark, sf_dir).withColumn("kind", F.lit("document")).unionByName(pages.withColumn("kind", F.lit("page")))
    return rows.select("kind", "image_id", F.octet_length("bytes").cast("long").alias("len"), F.crc32("bytes").alias("crc32"))


@query(f"""
WITH b AS (SELECT doc_id AS image_id, {LIST.format("coalesce(text, '')")} AS l FROM documents),
f AS (SELECT image_id, l, unnest(range((len(l) + 501) // 502)) AS frame_no FROM b)
SELECT image_id, CAST(frame_no AS INT) AS frame_no, CAST(len(l[frame_no * 502 + 1 : frame_no * 502 + 502]) AS BIGINT) AS len,
       CAST({CRC.format("l[frame_no * 502 + 1 : frame_no * 502 + 502]")} AS BIGINT) AS crc32
FROM f, {CRC_TABLE}
""")
def q_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = patching.frames(documents(spark, sf_dir), ["image_id"], "bytes")
    return f.select("image_id", "frame_no", F.octet_length("payload").cast("long").alias("len"), "crc32")


@query(f"""
WITH b AS (SELECT doc_id AS image_id, {LIST.format("coalesce(text, '')")} AS l FROM documents)
SELECT image_id, CAST(len(l) AS BIGINT) AS total_len, CAST({CRC.format("l")} AS BIGINT) AS total_crc32, CAST((len(l) + 501) // 502 AS INT) AS frames FROM b, {CRC_TABLE}
""")
def q_frame_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patching.manifests(documents(spark, sf_dir), ["image_id"], "bytes").select("image_id", "total_len", "total_crc32", "frames")


@query(f"""
SELECT l_orderkey, CAST(l_linenumber AS INT) AS l_linenumber, CAST({U.format("l_orderkey")} AS BIGINT) AS u_order,
       CAST(1 + {U.format("l_partkey")} + {U.format("l_orderkey")} AS BIGINT) AS copy_bytes, CAST(1 + {U.format("l_orderkey")} + l_orderkey AS BIGINT) AS add_bytes,
       CAST(1 + {U.format("l_partkey")} + {U.format("l_orderkey")} + l_orderkey AS BIGINT) AS diff_bytes
FROM lineitem
""")
def q_encoded_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    off, n = F.col("l_partkey"), F.col("l_orderkey")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", B.uleb_len(n).alias("u_order"), B.copy_cost(off, n).alias("copy_bytes"), B.add_cost(n).alias("add_bytes"), B.diff_cost(off, n).alias("diff_bytes"))


@query("""
WITH v AS (SELECT o_orderkey, o_orderkey * o_orderkey * 31 AS v FROM orders)
SELECT o_orderkey, v, v AS again,
       CASE WHEN v < 128 THEN printf('%02X', v)
            ELSE array_to_string(list_transform(range(CAST(ceil(len(ltrim(bin(v), '0')) / 7.0) AS BIGINT)),
                 lambda k: printf('%02X', CASE WHEN (v >> CAST(7 * (k + 1) AS BIGINT)) > 0 THEN ((v >> CAST(7 * k AS BIGINT)) & 127) + 128 ELSE (v >> CAST(7 * k AS BIGINT)) & 127 END)), '') END AS digits
FROM v
""")
def q_uleb_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") * F.col("o_orderkey") * 31).alias("v")).withColumn("digits", B.uleb_hex(F.col("v")))
    return v.select("o_orderkey", "v", B.uleb_value(F.col("digits")).alias("again"), "digits")


@query("""
WITH w AS (SELECT l_orderkey, CAST(l_linenumber AS INT) AS l_linenumber, (l_orderkey * 2654435761 + l_partkey * 40503 + l_linenumber) % 4294967296 AS w FROM lineitem),
h AS (SELECT *, w & 65535 AS a, (w >> 16) & 65535 AS b FROM w)
SELECT l_orderkey, l_linenumber, ((a & 61440) = 53248 AND (a & 3840) <> 3840) OR (a & 63488) = 57344 OR (a & 65280) IN (45312, 47360) AS thumb16,
       (a & 63488) IN (61440, 63488) AND (b & 63488) IN (61440, 63488) AS thumb32, ((w >> 25) & 7) = 5 AS arm, (w & 268435440) IN (19922704, 19922736) AS arm_reg, w >= 134217728 AND w < 536870912 AS flash
FROM h
""")
def q_branch_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", ((F.col("l_orderkey") * 2654435761 + F.col("l_partkey") * 40503 + F.col("l_linenumber")) % (1 << 32)).alias("w"))
    a, b = F.col("w").bitwiseAND(0xFFFF), F.shiftright("w", 16).bitwiseAND(0xFFFF)
    return w.select("l_orderkey", "l_linenumber", B.thumb16_branch(a).alias("thumb16"), B.thumb32_branch(a, b).alias("thumb32"), B.arm_branch(F.col("w")).alias("arm"), B.arm_branch_register(F.col("w")).alias("arm_reg"), B.flash_pointer(F.col("w"), 0x08000000, 0x20000000).alias("flash"))


@query("""
WITH w AS (SELECT doc_id AS image_id, unnest(regexp_extract_all(hex(encode(coalesce(text, ''))), '.{8}')) AS w FROM documents)
SELECT image_id, count(*) AS words, CAST(sum(CAST('0x' || w AS BIGINT)) AS BIGINT) AS sum_be,
       CAST(sum(CAST('0x' || substr(w, 7, 2) || substr(w, 5, 2) || substr(w, 3, 2) || substr(w, 1, 2) AS BIGINT)) AS BIGINT) AS sum_le
FROM w GROUP BY image_id
""")
def q_word_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.explode(F.when(F.octet_length("bytes") >= 4, F.sequence(F.lit(0), F.floor(F.octet_length("bytes") / 4).cast("int") * 4 - 4, F.lit(4))).otherwise(F.array().cast("array<int>")))
    rows = documents(spark, sf_dir).withColumn("at", at)
    return rows.groupBy("image_id").agg(F.count("*").alias("words"), F.sum(B.word_at(F.col("bytes"), F.col("at"), 4, "be")).alias("sum_be"), F.sum(B.word_at(F.col("bytes"), F.col("at"))).alias("sum_le"))


# Names, mnemonics, operands

NAMES_SQL = "SELECT p_partkey, unnest([p_name, '$a' || p_brand, '.L' || p_partkey, '??' || p_brand, '@' || p_type, substr(p_name, 1, 1), '', '__thumb$x', '.__init', 'isr' || p_size]) AS name FROM part"


@query(f"""
WITH n AS ({NAMES_SQL})
SELECT p_partkey, name, CASE WHEN name = '' THEN false WHEN starts_with(name, '??') THEN true WHEN regexp_matches(name, '^(\\$|\\.L|\\.__|@|__thumb\\$)') THEN false
       WHEN regexp_matches(lower(name), 'main|init|handler|isr|task|function|interrupt') THEN true ELSE length(name) >= 2 END AS good,
       NOT regexp_matches(name, '^(\\$|\\.L|__|@)') AS function_like
FROM n
""")
def q_symbol_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    names = F.array("p_name", F.concat(F.lit("$a"), "p_brand"), F.concat(F.lit(".L"), F.col("p_partkey").cast("string")), F.concat(F.lit("??"), "p_brand"), F.concat(F.lit("@"), "p_type"), F.substring("p_name", 1, 1), F.lit(""), F.lit("__thumb$x"), F.lit(".__init"), F.concat(F.lit("isr"), F.col("p_size").cast("string")))
    return p.select("p_partkey", F.explode(names).alias("name")).select("p_partkey", "name", names_sql.good_symbol(F.col("name")).alias("good"), names_sql.function_like(F.col("name")).alias("function_like"))


MNEMONICS = "b bl beq ldr ldrb str strh add subs mul mov mvn cmp tst push pop stm vadd fmul nop cbz adc blx movw 1x".split()
MNEMONIC_LIST = ", ".join(f"'{m}'" for m in MNEMONICS)


@query(f"""
WITH d AS (
  SELECT p_partkey, [{MNEMONIC_LIST}][CAST(p_partkey % {len(MNEMONICS)} + 1 AS INT)] AS mnemonic,
         ' R' || p_size || ',  #-' || p_partkey || ', [PC, #0x' || printf('%x', p_partkey) || '] 0x' || printf('%x', p_partkey * 16) || '  ; ' || p_brand AS ops FROM part),
u AS (SELECT *, CASE WHEN regexp_matches(upper(mnemonic), '^[A-Z]') THEN regexp_extract(upper(mnemonic), '^[A-Z]+') ELSE upper(mnemonic) END AS b FROM d)
SELECT p_partkey, mnemonic, CASE WHEN b IN ('B','BL','BX','BLX','CBZ','CBNZ') THEN 'BR' WHEN b LIKE 'LDR%' THEN 'LDR' WHEN b LIKE 'STR%' THEN 'STR' WHEN b IN ('ADD','ADC','SUB','SBC','RSB','MUL','MLA') THEN 'ALU'
       WHEN b IN ('MOV','MVN') THEN 'MOV' WHEN b IN ('CMP','CMN','TST','TEQ') THEN 'CMP' WHEN b IN ('PUSH','POP','STM','LDM') THEN 'STACK' WHEN b LIKE 'V%' OR b LIKE 'F%' THEN 'FP' ELSE b END AS class,
       trim(regexp_replace(regexp_replace(regexp_replace(split_part(ops, ';', 1), '#-?(0x[0-9a-fA-F]+|[0-9]+)', '#IMM', 'g'), '0x[0-9a-fA-F]+', 'IMM', 'g'), '\\s+', ' ', 'g')) AS operands
FROM u
""")
def q_mnemonics(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    ops = F.concat(F.lit(" R"), F.col("p_size").cast("string"), F.lit(",  #-"), key.cast("string"), F.lit(", [PC, #0x"), F.lower(F.hex(key)), F.lit("] 0x"), F.lower(F.hex(key * 16)), F.lit("  ; "), F.col("p_brand"))
    p = table(spark, sf_dir, "part").select("p_partkey", F.element_at(F.array(*map(F.lit, MNEMONICS)), (key % len(MNEMONICS) + 1).cast("int")).alias("mnemonic"), ops.alias("ops"))
    return p.select("p_partkey", "mnemonic", names_sql.mnemonic_class(F.col("mnemonic")).alias("class"), names_sql.operand_text(F.col("ops")).alias("operands"))


# Changes at one place, costs, runs


def same_place(spark: SparkSession, sf_dir: str, kernel: Callable, schema: str) -> DataFrame:
    def cut(old: bytes, new: bytes) -> list[tuple]:
        n = min(len(old), len(new))
        return kernel(bytes(old[:n]), bytes(new[:n]))

    return flat_map(page_pairs(spark, sf_dir), cut, f"pair_id long, {schema}", keep=1)


@query(f"WITH {CHANGES} SELECT pair_id, off, len FROM r")
def q_change_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return same_place(spark, sf_dir, lambda o, n: [(a, b - a) for a, b in kernels.change_runs(o, n).tolist()], "off long, len long")


@query(f"""
WITH {CHANGES}, s AS (SELECT pair_id, least(len(o), len(n)) AS size FROM l), a AS (SELECT pair_id, count(*) AS runs, sum(len) AS changed FROM r GROUP BY pair_id)
SELECT pair_id, CASE WHEN coalesce(runs, 0) > 400 OR coalesce(changed, 0) / greatest(1, size) > 0.9 THEN NULL ELSE coalesce(runs, 0) END AS runs FROM s LEFT JOIN a USING (pair_id)
""")
def q_change_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    def kernel(o: bytes, n: bytes) -> list[tuple]:
        found = kernels.gated_changes(o, n, most_runs=400, most_ratio=0.9)
        return [(None if found is None else len(found),)]

    return same_place(spark, sf_dir, kernel, "runs long")


@query(f"""
WITH {SAME_PLACE}
SELECT pair_id, count(*) AS size, CAST(sum((CAST('0x' || nb AS INT) - CAST('0x' || ob AS INT) + 256) % 256) AS BIGINT) AS diff_sum,
       round(sum(CASE WHEN nb = ob THEN 1 ELSE 0 END) / count(*), 6) AS zero_ratio
FROM p GROUP BY pair_id
""")
def q_diff_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    def kernel(o: bytes, n: bytes) -> list[tuple]:
        d = codec.differences(o, n)
        return [(len(d), sum(d), round(d.count(0) / len(d), 6))] if d else []

    return same_place(spark, sf_dir, kernel, "size long, diff_sum long, zero_ratio double")


@query(f"""
WITH {CHANGES}, z AS (SELECT pair_id, count(*) AS size, sum(CASE WHEN nb = ob THEN 1 ELSE 0 END) AS same FROM p GROUP BY pair_id),
d AS (SELECT pair_id, len, off - lag(off, 1, 0) OVER (PARTITION BY pair_id ORDER BY off) AS delta FROM r),
e AS (SELECT pair_id, count(*) AS k, sum(len) AS bytes, sum({U.format("delta")}) AS ud, sum({U.format("len")}) AS ul, min(len) AS lo, max(len) AS hi FROM d GROUP BY pair_id),
cc AS (
  SELECT pair_id, 1 + {U.format("size")} + size AS add_cost, 1 + 1 + {U.format("size")} + CAST(trunc(size * (1 - (same / size) * 0.8::DOUBLE)) AS BIGINT) AS diff_cost,
         CASE WHEN k IS NOT NULL THEN 1 + 1 + {U.format("size")} + {U.format("k")} + ud + ul + bytes END AS patch_cost,
         CASE WHEN lo = hi THEN 1 + 1 + {U.format("size")} + {U.format("k")} + {U.format("lo")} + ud + bytes END AS compact_cost, k
  FROM z LEFT JOIN e USING (pair_id))
SELECT pair_id, CAST(add_cost AS BIGINT) AS add_cost, CAST(diff_cost AS BIGINT) AS diff_cost, CAST(patch_cost AS BIGINT) AS patch_cost, CAST(compact_cost AS BIGINT) AS compact_cost,
       CASE WHEN k IS NULL THEN 'COPY' WHEN add_cost <= least(diff_cost, coalesce(patch_cost, add_cost), coalesce(compact_cost, add_cost)) THEN 'ADD'
            WHEN diff_cost <= least(coalesce(patch_cost, diff_cost), coalesce(compact_cost, diff_cost)) THEN 'DIFF'
            WHEN patch_cost <= coalesce(compact_cost, patch_cost) THEN 'PATCH' ELSE 'PATCH_COMPACT' END AS best
FROM cc
""")
def q_patch_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    def kernel(o: bytes, n: bytes) -> list[tuple]:
        if not n:
            return []
        changes = kernels.change_runs(o, n)
        c = codec.costs(0, o, n, changes)
        return [(c["ADD"], c["DIFF"], c.get("PATCH"), c.get("PATCH_COMPACT"), min(c, key=c.get) if len(changes) else "COPY")]

    return same_place(spark, sf_dir, kernel, "add_cost long, diff_cost long, patch_cost long, compact_cost long, best string")


@query(f"""
WITH b AS (SELECT doc_id AS image_id, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS l FROM documents),
p AS (SELECT image_id, unnest(range(len(l))) AS i, unnest(l) AS b FROM b),
g AS (SELECT image_id, i, b, i - row_number() OVER (PARTITION BY image_id, b ORDER BY i) AS g FROM p)
SELECT image_id, CAST(min(i) AS BIGINT) AS off, count(*) AS len, CAST('0x' || b AS INT) AS fill FROM g GROUP BY image_id, b, g HAVING count(*) >= 4
""")
def q_fill_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    def kernel(data: bytes) -> list[tuple]:
        return [(a, b - a, data[a]) for a, b in kernels.value_runs(kernels.array_of(data)).tolist() if b - a >= 4]

    return flat_map(documents(spark, sf_dir), kernel, "image_id long, off long, len long, fill int", keep=1)


@query("""
WITH d AS (SELECT doc_id AS pair_id, hex(encode(coalesce(text, ''))) AS o FROM documents),
p AS (SELECT pair_id, o, substr(o, 1, len(o) // 4 * 2) || '000102030405060708090A0B0C0D0E0F101112131415161718191A1B1C1D1E1F2021222324252627' || substr(o, len(o) // 4 * 2 + 1) AS n FROM d),
l AS (SELECT pair_id, regexp_extract_all(o, '..') AS o, regexp_extract_all(n, '..') AS n FROM p),
a AS (SELECT *, coalesce((SELECT min(i) FROM (SELECT unnest(range(len(o))) AS i, unnest(o) AS x, unnest(n[:len(o)]) AS y) WHERE x <> y), len(o)) AS prefix FROM l),
s AS (SELECT *, list_reverse(o[prefix + 1 :]) AS ro, list_reverse(n[prefix + 1 :]) AS rn FROM a)
SELECT pair_id, CAST(prefix AS BIGINT) AS prefix, CAST(coalesce((SELECT min(i) FROM (SELECT unnest(range(len(ro))) AS i, unnest(ro) AS x, unnest(rn[:len(ro)]) AS y) WHERE x <> y), len(ro)) AS BIGINT) AS suffix FROM s
""")
def q_prefix_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = images.mutated_pairs(documents(spark, sf_dir), ("insert",)).select("pair_id", "old", "new")
    return flat_map(pairs, lambda o, n: [kernels.ends_in_common(bytes(o), bytes(n))], "pair_id long, prefix long, suffix long", keep=1)


# Blocks, matches, covers


@query("""
WITH h AS (SELECT doc_id AS image_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT image_id, substr(h, 32 * k + 1, 128) AS block FROM (SELECT image_id, h, unnest(range(greatest(0, (len(h) // 2 - 64) // 16 + 1))) AS k FROM h WHERE len(h) >= 128))
SELECT block, count(*) AS n, count(DISTINCT image_id) AS images FROM b GROUP BY block HAVING count(*) > 1
""")
def q_block_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.octet_length("bytes")
    rows = documents(spark, sf_dir).where(n >= 64).withColumn("at", F.explode(F.sequence(F.lit(0), n - 64, F.lit(16))))
    blocks = rows.select("image_id", F.substring(F.col("bytes"), F.col("at") + 1, F.lit(64)).alias("block"))
    return blocks.groupBy("block").agg(F.count("*").alias("n"), F.countDistinct("image_id").alias("images")).where("n > 1").select(F.hex("block").alias("block"), "n", "images")


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_map(page_pairs(spark, sf_dir), lambda o, n: map(tuple, kernels.maximal_matches(bytes(o), bytes(n), 16).tolist()), "pair_id long, n_off long, o_off long, length long", keep=1)


@query(f"WITH {MATCHES} SELECT pair_id, CAST(n_off AS BIGINT) AS n_off, CAST(o_off AS BIGINT) AS o_off, length FROM m")
def q_maximal_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(spark, sf_dir)


@query(f"""
WITH RECURSIVE {MATCHES},
best AS MATERIALIZED (
  SELECT pair_id, i, max(n_end - i) AS len, arg_min(o_off + i - n_off, (n_off - n_end, o_off - n_off)) AS o
  FROM (SELECT pair_id, n_off, o_off, n_off + length AS n_end, unnest(range(n_off, n_off + length - 15)) AS i FROM m) GROUP BY pair_id, i),
nxt AS MATERIALIZED (SELECT b.pair_id, b.i, b.len, b.i + greatest(1, b.len // 2) AS want FROM best b),
step AS MATERIALIZED (SELECT n.pair_id, n.i, n.len, b.i AS to_i FROM nxt n ASOF LEFT JOIN best b ON n.pair_id = b.pair_id AND n.want <= b.i),
walk AS (
  SELECT s.pair_id, s.i, s.len, s.to_i FROM step s JOIN (SELECT pair_id, min(i) AS i FROM best GROUP BY pair_id) f USING (pair_id, i)
  UNION ALL SELECT s.pair_id, s.i, s.len, s.to_i FROM walk w JOIN step s ON s.pair_id = w.pair_id AND s.i = w.to_i)
SELECT pair_id, CAST(i AS BIGINT) AS n_off, CAST(len AS BIGINT) AS length FROM walk
""")
def q_global_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_map(page_pairs(spark, sf_dir), lambda o, n: [(m.new, m.length) for m in kernels.global_matches(bytes(o), bytes(n), 16)], "pair_id long, n_off long, length long", keep=1)


def sound(found: list[kernels.Match], old: bytes, new: bytes) -> bool:
    """Whether matches don't overlap and hold equal bytes."""
    apart = all(a.new + a.length <= b.new for a, b in zip(found, found[1:], strict=False))
    return apart and all(old[m.old : m.old + m.length] == new[m.new : m.new + m.length] for m in found)


@query(f"WITH {PL} SELECT pair_id, true AS local_ok, true AS cover_ok, true AS cover_best, true AS chunks_ok FROM pl")
def q_covers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local matches, chunk matches and the best cover of all: sound, and worth no less than what trimming gives."""

    def kernel(old: bytes, new: bytes) -> list[tuple]:
        old, new = bytes(old), bytes(new)
        local, far = kernels.local_matches(old, new), kernels.global_matches(old, new, 16)
        cover = kernels.best_cover(far + local)
        worth = lambda ms: sum(max(0, kernels.saving(m)) for m in ms)
        return [(sound(local, old, new), sound(cover, old, new), worth(cover) >= max(worth(local), worth(kernels.trimmed(far)[:1])), sound(kernels.chunk_matches(old, new, 256, 64, 1024), old, new))]

    return flat_map(page_pairs(spark, sf_dir), kernel, "pair_id long, local_ok boolean, cover_ok boolean, cover_best boolean, chunks_ok boolean", keep=1)


@query(f"""
WITH {MATCHES}, p AS (SELECT DISTINCT pair_id, unnest(range(n_off, n_off + length)) AS i FROM m), c AS (SELECT pair_id, count(*) AS covered FROM p GROUP BY pair_id)
SELECT pair_id, CAST(strlen(new) AS BIGINT) AS length, coalesce(covered, 0) AS covered, strlen(new) - coalesce(covered, 0) AS in_gaps FROM pl LEFT JOIN c USING (pair_id)
""")
def q_match_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = matches(spark, sf_dir).select("pair_id", F.col("n_off").alias("start"), (F.col("n_off") + F.col("length")).alias("end"))
    lengths = page_pairs(spark, sf_dir).select("pair_id", F.octet_length("new").cast("long").alias("length"))
    covered = pairing.union_of_intervals(spans).groupBy("pair_id").agg(F.sum(F.col("end") - F.col("start")).alias("covered"))
    left = pairing.gaps(spans, lengths).groupBy("pair_id").agg(F.sum(F.col("end") - F.col("start")).alias("in_gaps"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return lengths.join(covered, "pair_id", "left").join(left, "pair_id", "left").select("pair_id", "length", zero("covered"), zero("in_gaps"))


@query(f"""
WITH {MATCHES}, r AS (SELECT pair_id, k AS region_id, k * 256 AS s, least(strlen(new), k * 256 + 256) AS e FROM (SELECT pair_id, new, unnest(range((strlen(new) + 255) // 256)) AS k FROM pl))
SELECT pair_id, region_id, CAST(greatest(n_off, s) AS BIGINT) AS n_off, CAST(o_off + greatest(n_off, s) - n_off AS BIGINT) AS o_off, CAST(least(n_off + length, e) - greatest(n_off, s) AS BIGINT) AS length
FROM m JOIN r USING (pair_id) WHERE least(n_off + length, e) - greatest(n_off, s) >= 8
""")
def q_match_region_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.octet_length("new").cast("long")
    r = page_pairs(spark, sf_dir).where(n > 0).select("pair_id", n.alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / 256))).alias("region_id"))
    regions = r.select("pair_id", "region_id", (F.col("region_id") * 256).alias("start"), F.least("n", F.col("region_id") * 256 + 256).alias("end"))
    return pairing.overlaps(matches(spark, sf_dir), regions)


@query("""
WITH s AS (SELECT p_partkey, p_name, unnest(range(length(p_name))) AS spot FROM part)
SELECT p_partkey, string_agg(CAST(spot AS VARCHAR), ',' ORDER BY substr(p_name, CAST(spot AS INT) + 1)) AS suffixes FROM s GROUP BY p_partkey
""")
def q_suffix_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", B.image("p_name").alias("bytes"))
    return flat_map(p, lambda d: [(",".join(map(str, kernels.suffix_order(bytes(d)).tolist())),)] if d else [], "p_partkey long, suffixes string", keep=1)


GEAR_SQL = "[" + ", ".join(str(int(x) & 255) for x in kernels.GEAR) + "]"  # the low 8 bits are all that a mask of 8 bits sees
FINGERPRINT = " + ".join(f"coalesce(lag(g, {j}) OVER w, 0) * {1 << j}" for j in range(8))


@query(f"""
WITH b AS (SELECT doc_id AS image_id, {LIST.format("coalesce(text, '')")} AS l FROM documents),
p AS (SELECT image_id, unnest(range(len(l))) AS i, {GEAR_SQL}[CAST(unnest(l) AS INT) + 1] AS g FROM b),
f AS (SELECT image_id, i, ({FINGERPRINT}) & 255 AS f FROM p WINDOW w AS (PARTITION BY image_id ORDER BY i))
SELECT image_id, count(*) AS n, CAST(sum(i + 1) AS BIGINT) AS places FROM f WHERE f = 0 AND i >= 7 GROUP BY image_id
""")
def q_cdc_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    def kernel(data: bytes) -> list[tuple]:
        at = kernels.cut_candidates(bytes(data), 256)
        return [(len(at), int(at.sum()))] if len(at) else []

    return flat_map(documents(spark, sf_dir), kernel, "image_id long, n long, places long", keep=1)


def chunk_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    def kernel(data: bytes) -> list[tuple]:
        data = bytes(data)
        return [(k, a, b - a, zlib.crc32(data[a:b]), data[a:b]) for k, (a, b) in enumerate(kernels.chunks(data, 256, 64, 1024))]

    return flat_map(documents(spark, sf_dir), kernel, "image_id long, chunk_no long, start long, length long, crc long, data binary", keep=1)


#: Chunks (image_id, chunk_no, start, e, n): after at least 64 bytes the first candidate ends one, else the 1024th byte or the end.
CHUNKS = f"""b AS (SELECT doc_id AS image_id, {LIST.format("coalesce(text, '')")} AS l FROM documents),
p AS (SELECT image_id, unnest(range(len(l))) AS i, {GEAR_SQL}[CAST(unnest(l) AS INT) + 1] AS g FROM b),
f AS (SELECT image_id, i, ({FINGERPRINT}) & 255 AS f FROM p WINDOW w AS (PARTITION BY image_id ORDER BY i)),
c AS (SELECT image_id, list(i + 1 ORDER BY i) AS cuts FROM f WHERE f = 0 AND i >= 7 GROUP BY image_id),
d AS (SELECT image_id, CAST(len(l) AS BIGINT) AS n, cuts FROM b LEFT JOIN c USING (image_id) WHERE len(l) > 0),
k AS (
  SELECT image_id, CAST(0 AS BIGINT) AS chunk_no, CAST(0 AS BIGINT) AS start, CAST(least(n, 1024, coalesce(list_min(list_filter(cuts, lambda x: x >= 64)), n)) AS BIGINT) AS e, n, cuts FROM d
  UNION ALL
  SELECT image_id, chunk_no + 1, e, CAST(least(n, e + 1024, coalesce(list_min(list_filter(cuts, lambda x: x >= e + 64)), n)) AS BIGINT), n, cuts FROM k WHERE e < n)"""


@query(f"""
WITH RECURSIVE {CHUNKS},
h AS (SELECT k.image_id, e - start AS length, substr(hex(encode(text)), 2 * start + 1, 2 * (e - start)) AS h FROM k JOIN documents ON doc_id = image_id),
g AS (SELECT h, length, count(*) AS n, count(DISTINCT image_id) AS images FROM h GROUP BY h, length HAVING count(*) > 1)
SELECT CAST({CRC.format("list_transform(regexp_extract_all(h, '..'), lambda x: CAST('0x' || x AS BIGINT))")} AS BIGINT) AS crc, length, n, images FROM g, {CRC_TABLE}
""")
def q_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content-defined chunks that several places share: equal in CRC, length and digest."""
    g = chunk_table(spark, sf_dir).groupBy("crc", "length", F.unhex(F.sha2("data", 256)).alias("digest")).agg(F.count("*").alias("n"), F.countDistinct("image_id").alias("images"))
    return g.where("n > 1").select("crc", "length", "n", "images")


@query(f"WITH RECURSIVE {CHUNKS} SELECT image_id, chunk_no, start, e - start AS length FROM k")
def q_cdc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk's place."""
    return chunk_table(spark, sf_dir).select("image_id", "chunk_no", "start", "length")


NEW_REPEATS = " UNION ALL ".join(
    f"""SELECT pair_id, {b} AS block, count(*) AS groups, CAST(sum(n - 1) AS BIGINT) AS extra, CAST(any_value(cov) AS BIGINT) AS bytes_covered FROM (
  SELECT g.pair_id, g.x, g.n, c.cov FROM g{b} g JOIN c{b} c USING (pair_id)) GROUP BY pair_id"""
    for b in (16, 32, 64)
)
NEW_REPEAT_CTES = ",\n".join(
    f"""n{b} AS (SELECT pair_id, k * 4 AS at, substr(n, 8 * k + 1, {2 * b}) AS x FROM (SELECT pair_id, n, unnest(range(greatest(0, (len(n) // 2 - {b}) // 4 + 1))) AS k FROM lg WHERE len(n) >= {2 * b})),
o{b} AS (SELECT DISTINCT pair_id, substr(o, 8 * k + 1, {2 * b}) AS x FROM (SELECT pair_id, o, unnest(range(greatest(0, (len(o) // 2 - {b}) // 4 + 1))) AS k FROM lg WHERE len(o) >= {2 * b})),
f{b} AS (SELECT n{b}.* FROM n{b} ANTI JOIN o{b} USING (pair_id, x)),
g{b} AS (SELECT pair_id, x, count(*) AS n FROM f{b} GROUP BY pair_id, x HAVING count(*) > 1),
c{b} AS (SELECT pair_id, count(DISTINCT i) AS cov FROM (SELECT f.pair_id, unnest(range(f.at, f.at + {b})) AS i FROM f{b} f SEMI JOIN g{b} g USING (pair_id, x)) GROUP BY pair_id)"""
    for b in (16, 32, 64)
)


@query(f"WITH {PL}, lg AS (SELECT pair_id, hex(encode(old)) AS o, hex(encode(new)) AS n FROM pl),\n{NEW_REPEAT_CTES}\n{NEW_REPEATS}")
def q_new_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    def kernel(old: bytes, new: bytes) -> list[tuple]:
        found = [(b, *kernels.new_repeats(bytes(old), bytes(new), b)) for b in (16, 32, 64)]
        return [f for f in found if f[1]]

    return flat_map(page_pairs(spark, sf_dir), kernel, "pair_id long, block int, groups long, extra long, bytes_covered long", keep=1)


GRAMS = "SELECT DISTINCT pair_id, substr({0}, 8 * k + 1, 32) AS g FROM (SELECT pair_id, {0}, unnest(range((len({0}) // 2 - 16) // 4 + 1)) AS k FROM lg WHERE len({0}) >= 32)"


@query(f"""
WITH {PL}, lg AS (SELECT pair_id, hex(encode(old)) AS o, hex(encode(new)) AS n FROM pl), a AS ({GRAMS.format("o")}), b AS ({GRAMS.format("n")}),
i AS (SELECT pair_id, count(*) AS shared FROM a JOIN b USING (pair_id, g) GROUP BY pair_id), u AS (SELECT pair_id, count(*) AS every FROM (SELECT * FROM a UNION SELECT * FROM b) GROUP BY pair_id)
SELECT pair_id, coalesce(shared, 0) AS shared, coalesce(every, 0) AS every, CASE WHEN every IS NULL THEN 1.0::DOUBLE ELSE round(coalesce(shared, 0) / every, 6) END AS jaccard FROM pl LEFT JOIN i USING (pair_id) LEFT JOIN u USING (pair_id)
""")
def q_kgram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    def grams(data: str) -> F.Column:
        n = F.octet_length(data)
        return F.when(n >= 16, F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), n - 16), F.lit(4)), lambda i: F.hex(F.substring(F.col(data), i + 1, F.lit(16)))))).otherwise(F.array().cast("array<string>"))

    p = page_pairs(spark, sf_dir).select("pair_id", grams("old").alias("a"), grams("new").alias("b"))
    p = p.select("pair_id", F.size(F.array_intersect("a", "b")).cast("long").alias("shared"), F.size(F.array_union("a", "b")).cast("long").alias("every"))
    return p.withColumn("jaccard", F.when(F.col("every") == 0, F.lit(1.0)).otherwise(F.round(F.col("shared") / F.col("every"), 6)))


#: Bounds of what counts as an address in pages: words of blanks, digits and letters up to '@'.
PAGE_ADDRESSES = (0x20202020, 0x40404040)
LITTLE = "CAST('0x' || " + " || ".join("substr({0}, " + str(i) + ", 2)" for i in (7, 5, 3, 1)) + " AS BIGINT)"
THUMB_WIDE = "{0} & 63488 IN (61440, 63488)"
#: Both sides of a pair as hex; words, half-words and what they look like; grams by the CRC-32 of their bytes.
SIMILARITY = f"""
WITH {PL}, s AS (SELECT pair_id, unnest([0, 1]) AS side, unnest([hex(encode(old)), hex(encode(new))]) AS h FROM pl),
n AS (SELECT pair_id, side, h, len(h) // 2 AS size FROM s),
w0 AS (SELECT pair_id, side, unnest(range(len(h) // 8)) AS k, unnest(regexp_extract_all(h, '.{{8}}')) AS x FROM s),
w AS (SELECT *, {LITTLE.format("x")} AS v FROM w0),
words AS (SELECT pair_id, side, k, x, v, (v >= {PAGE_ADDRESSES[0]} AND v < {PAGE_ADDRESSES[1]}) OR (v >= 536870912 AND v < 537395200) AS address, (v >> 25) & 7 = 5 OR v & 268435440 IN (19922704, 19922736) AS arm FROM w),
h0 AS (SELECT pair_id, side, unnest(range(len(h) // 4)) AS k, unnest(regexp_extract_all(h, '.{{4}}')) AS x FROM s),
h1 AS (SELECT pair_id, side, k, CAST('0x' || substr(x, 3, 2) || substr(x, 1, 2) AS BIGINT) AS v FROM h0),
h2 AS (SELECT *, lead(v) OVER (PARTITION BY pair_id, side ORDER BY k) AS after FROM h1),
half AS (SELECT pair_id, side, k, (v & 61440 = 53248 AND v & 3840 <> 3840) OR v & 63488 = 57344 OR v & 65280 IN (45312, 47360) AS narrow, {THUMB_WIDE.format("v")} AND coalesce({THUMB_WIDE.format("after")}, false) AS wide FROM h2),
thumb AS (SELECT pair_id, count_if(narrow OR (wide AND k < 2047)) AS c FROM half WHERE side = 1 AND k < 2048 GROUP BY pair_id),
arm AS (SELECT pair_id, count_if(arm) AS c, max(v) FILTER (k = 0) AS first, max(v) FILTER (k = 1) AS second FROM words WHERE side = 1 AND k < 1024 GROUP BY pair_id),
guess AS (
    SELECT pair_id, CASE WHEN first >= 536870912 AND first < 537395200 AND second % 2 = 1 AND second >= {PAGE_ADDRESSES[0]} AND second < {PAGE_ADDRESSES[1]} THEN 'thumb'
        WHEN coalesce(arm.c, 0)::DOUBLE / greatest(1, least(size, 4096) // 4) > 1.2::DOUBLE * (coalesce(thumb.c, 0)::DOUBLE / greatest(1, least(size, 4096) // 2)) THEN 'arm' ELSE 'thumb' END AS mode
    FROM n LEFT JOIN thumb USING (pair_id) LEFT JOIN arm USING (pair_id) WHERE side = 1),
branches AS (SELECT pair_id, side, 2 * k AS place FROM half JOIN guess USING (pair_id) WHERE mode = 'thumb' AND (narrow OR wide) UNION ALL SELECT pair_id, side, 4 * k FROM words JOIN guess USING (pair_id) WHERE mode = 'arm' AND arm),
sites AS (SELECT pair_id, side, place FROM branches UNION SELECT pair_id, side, 4 * k FROM words WHERE address),
zeroed AS (SELECT pair_id, side, string_agg(CASE WHEN address THEN '00000000' ELSE x END, '' ORDER BY k) AS h FROM words GROUP BY pair_id, side),
view AS (SELECT pair_id, side, z.h || substr(n.h, len(z.h) + 1) AS h, CASE mode WHEN 'arm' THEN 4 ELSE 2 END AS step FROM zeroed z JOIN n USING (pair_id, side) JOIN guess USING (pair_id)),
g0 AS (SELECT pair_id, side, h, step, unnest(range((len(h) // 2 - 16) // step + 1)) AS k FROM view WHERE len(h) >= 32),
g1 AS (SELECT DISTINCT pair_id, side, substr(h, 2 * step * k + 1, 32) AS g FROM g0),
g2 AS (SELECT g, {CRC.format("list_transform(regexp_extract_all(g, '..'), lambda x: CAST('0x' || x AS BIGINT))")} AS crc FROM (SELECT DISTINCT g FROM g1), {CRC_TABLE}),
grams AS (SELECT DISTINCT pair_id, side, crc AS place FROM g1 JOIN g2 USING (g)),
js AS (SELECT pair_id, count_if(n = 2) / count(*) AS j FROM (SELECT pair_id, place, count(*) AS n FROM sites GROUP BY 1, 2) GROUP BY pair_id),
jg AS (SELECT pair_id, count_if(n = 2) / count(*) AS j FROM (SELECT pair_id, place, count(*) AS n FROM grams GROUP BY 1, 2) GROUP BY pair_id),
d AS (SELECT pair_id, side, coalesce(c, 0)::DOUBLE / greatest(1, size // CASE mode WHEN 'arm' THEN 4 ELSE 2 END) AS d FROM n JOIN guess USING (pair_id) LEFT JOIN (SELECT pair_id, side, count(*) AS c FROM branches GROUP BY 1, 2) USING (pair_id, side)),
a AS (SELECT pair_id, 1::DOUBLE - least(1::DOUBLE, abs(max(d) FILTER (side = 0) - max(d) FILTER (side = 1))) AS a FROM d GROUP BY pair_id),
parts AS (SELECT pair_id, mode, old = '' OR new = '' AS none, coalesce(jg.j, 1)::DOUBLE AS g, coalesce(js.j, 1)::DOUBLE AS s, a.a FROM pl JOIN guess USING (pair_id) JOIN a USING (pair_id) LEFT JOIN js USING (pair_id) LEFT JOIN jg USING (pair_id))
SELECT pair_id, mode, CASE WHEN none THEN 0::DOUBLE ELSE round_even(0.60::DOUBLE * g + 0.25::DOUBLE * s + 0.15::DOUBLE * a, 6) END AS sim, CASE WHEN none THEN 0::DOUBLE ELSE round_even(g, 6) END AS s_kgram, CASE WHEN none THEN 0::DOUBLE ELSE round_even(s, 6) END AS s_sites, CASE WHEN none THEN 0::DOUBLE ELSE round_even(a, 6) END AS s_bd FROM parts
"""


@query(SIMILARITY)
def q_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.similarities(page_pairs(spark, sf_dir), "pair_id", *PAGE_ADDRESSES)


# Symbols, sections, regions, instructions


def symbol_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A symbol file for each part in one of the five layouts."""
    key, name, size = F.col("p_partkey").cast("string"), F.regexp_replace("p_name", '["\\\\]', ""), F.col("p_size").cast("string")
    entry = F.concat(F.lit('{"addr": '), (F.col("p_partkey") + 0x08000000).cast("string"), F.lit(', "size": '), size, F.lit("}"))
    layouts = [
        F.concat(F.lit('{"symbols": [{"name": "'), name, F.lit('", "addr": '), (F.col("p_partkey") + 0x08000000).cast("string"), F.lit(', "size": '), size, F.lit('}, "malformed"]}')),
        F.concat(F.lit('{"symbols": {"'), name, F.lit('": '), entry, F.lit("}}")),
        F.concat(F.lit('{"symbols": {"'), name, F.lit('": [{"file_offset": '), key, F.lit(', "size": '), size, F.lit("}]}}")),
        F.concat(F.lit('{"sections": {"3": {"symbols": {"'), name, F.lit('": '), entry, F.lit("}}}}")),
        F.concat(F.lit('{"'), name, F.lit('": {"off": '), key, F.lit(', "size": '), size, F.lit("}}")),
    ]
    return table(spark, sf_dir, "part").select(key.alias("image_id"), F.element_at(F.array(*layouts), (F.col("p_partkey") % 5 + 1).cast("int")).alias("text"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS image_id, p_name AS name, p_partkey AS off, CAST(p_size AS BIGINT) AS size FROM part WHERE p_size > 0 AND length(p_name) >= 2")
def q_json_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols.symbol_table(symbol_json(spark, sf_dir), 0x08000000).select("image_id", "name", "off", "size")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def q_json_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "long").alias("k"))


@query("""
WITH o AS (SELECT p_brand, p_type AS name, p_partkey AS off, CAST(p_size AS BIGINT) AS size FROM part WHERE p_partkey % 2 = 0),
n AS (SELECT p_brand, p_type AS name, p_partkey AS off, CAST(p_size AS BIGINT) AS size FROM part WHERE p_partkey % 2 = 1),
l AS (SELECT p_brand, name, max(off) AS off, arg_max(size, off) AS size FROM o GROUP BY p_brand, name)
SELECT n.p_brand AS pair_id, n.name, n.off AS n_off, l.off AS o_off, least(n.size, l.size) AS size FROM n JOIN l USING (p_brand, name) WHERE least(n.size, l.size) > 0
""")
def q_symbol_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "part").select(F.col("p_brand").alias("pair_id"), F.col("p_type").alias("name"), F.col("p_partkey").alias("off"), F.col("p_size").cast("long").alias("size"))
    return pairing.pair_symbols(s.where("off % 2 = 0"), s.where("off % 2 = 1"))


@query("""
WITH s AS (SELECT l_orderkey AS pair_id, l_linenumber AS section_index, max(l_partkey) AS o_off, max(l_suppkey) AS n_off, CAST(max(l_quantity) AS BIGINT) * 20 AS o_size, CAST(max(l_quantity) AS BIGINT) * 30 AS n_size FROM lineitem GROUP BY 1, 2)
SELECT pair_id, CAST(section_index AS INT) AS section_index, n_off, o_off, least(n_size, 900 - n_off, o_size, 1500 - o_off) AS size FROM s WHERE least(n_size, 900 - n_off, o_size, 1500 - o_off) > 0
""")
def q_section_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("pair_id"), F.col("l_linenumber").alias("section_index")).agg(F.max("l_partkey").alias("l_partkey"), F.max("l_suppkey").alias("l_suppkey"), F.max("l_quantity").cast("long").alias("q"))
    old = rows.select("pair_id", "section_index", F.col("l_partkey").alias("off"), (F.col("q") * 20).alias("size"), F.lit(1500).alias("image_len"))
    new = rows.select("pair_id", "section_index", F.col("l_suppkey").alias("off"), (F.col("q") * 30).alias("size"), F.lit(900).alias("image_len"))
    return pairing.pair_sections(old, new)


@query("""
WITH m AS (SELECT user_id AS image_id, 0 AS section_index, epoch_us(ts) AS addr, CASE WHEN event_id % 3 = 0 THEN '$d' WHEN event_id % 3 = 1 THEN '$t' ELSE '$a' END AS name FROM events),
r AS (SELECT image_id, section_index, addr AS "start", coalesce(lead(addr) OVER (PARTITION BY image_id ORDER BY addr, name), 4102444800000000) AS "end", CASE WHEN name = '$d' THEN 'data' ELSE 'code' END AS type FROM m)
SELECT image_id, section_index, "start", "end", type FROM r WHERE "end" > "start"
""")
def q_code_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    name = F.when(F.col("event_id") % 3 == 0, "$d").when(F.col("event_id") % 3 == 1, "$t").otherwise("$a")
    m = e.select(F.col("user_id").alias("image_id"), F.lit(0).alias("section_index"), F.unix_micros(F.col("ts").cast("timestamp")).alias("addr"), name.alias("name"), F.lit(4102444800000000).alias("section_end"))
    return symbols.code_regions(m)


@query("""
WITH s AS (SELECT l_suppkey AS image_id, l_partkey AS addr, min(l_orderkey) AS k FROM lineitem GROUP BY 1, 2),
z AS (SELECT *, CASE WHEN k % 7 = 0 THEN 5 ELSE 0 END AS decl, lead(addr) OVER (PARTITION BY image_id ORDER BY addr) AS nxt FROM s)
SELECT image_id, addr, 's' || k AS name, CAST(CASE WHEN decl > 0 THEN decl WHEN nxt IS NOT NULL THEN nxt - addr ELSE 1000000 - addr END AS BIGINT) AS size FROM z
""")
def q_symbol_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("image_id"), F.col("l_partkey").alias("addr")).agg(F.min("l_orderkey").alias("k"))
    s = s.select("image_id", F.lit(0).alias("section_index"), F.concat(F.lit("s"), F.col("k").cast("string")).alias("name"), "addr", F.when(F.col("k") % 7 == 0, F.lit(5)).otherwise(F.lit(0)).cast("long").alias("size_decl"), F.lit(1000000).cast("long").alias("section_end"))
    twice = s.unionByName(s.withColumn("name", F.concat(F.lit("$"), "name")))
    return symbols.sized_symbols(twice).select("image_id", "addr", "name", "size")


@query("""
WITH s AS (SELECT p_brand AS image_id, 134217728 + p_partkey * 4 AS addr, 'sym_' || p_partkey AS name FROM part),
z AS (SELECT *, lead(addr) OVER (PARTITION BY image_id ORDER BY addr) - addr AS size FROM s)
SELECT image_id, name, CAST(addr AS BIGINT) AS addr, CAST(addr - 134217728 AS BIGINT) AS off, CAST(size AS BIGINT) AS size FROM z WHERE size > 0
""")
def q_map_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    text = F.concat(F.lit("  .text 0x1 0x"), F.lower(F.hex(F.col("p_partkey") * 4 + 0x08000000)), F.lit("   0x20  sym_"), F.col("p_partkey").cast("string"), F.lit("  $t"))
    return symbols.map_symbols(p.select(F.col("p_brand").alias("image_id"), F.col("p_partkey").alias("line_no"), text.alias("text")), 0x08000000, 1 << 24)


OPERANDS = ("R1, R0", "??func_2 + 0x14", "0x08001234", "R0, [PC, #0x10]  ; 0x8000010", "R2, label")


@query(f"""
WITH l AS (SELECT p_brand AS image_id, p_partkey * 4 AS addr, upper([{MNEMONIC_LIST}, 'dc32', 'adr'][CAST(p_partkey % {len(MNEMONICS) + 2} + 1 AS INT)]) AS m, CAST(p_partkey % 5 AS INT) AS k FROM part)
SELECT image_id, 4 AS section_index, addr, CASE WHEN m IN ({", ".join(f"'{b}'" for b in names_sql.BRANCHES)}) THEN 'branch' ELSE 'ptr' END AS kind
FROM l WHERE m IN ({", ".join(f"'{b}'" for b in names_sql.BRANCHES)}) OR (m = 'DC32' AND k IN (0, 1, 2, 3, 4)) OR (m IN ('LDR', 'ADR') AND k IN (1, 3, 4))
""")
def q_norm_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    mnemonic = F.element_at(F.array(*map(F.lit, [*MNEMONICS, "dc32", "adr"])), (F.col("p_partkey") % (len(MNEMONICS) + 2) + 1).cast("int"))
    ops = F.element_at(F.array(*map(F.lit, OPERANDS)), (F.col("p_partkey") % 5 + 1).cast("int"))
    body = p.select(F.col("p_brand").alias("image_id"), F.col("p_partkey").alias("line_no"), F.concat(F.lit("  0x"), F.lower(F.hex(F.col("p_partkey") * 4)), F.lit(":    0xe1b01000     "), F.upper(mnemonic), F.lit("   "), ops).alias("text"))
    head = p.select(F.col("p_brand").alias("image_id"), F.lit(-1).cast("long").alias("line_no"), F.lit("Section #4 P2 ro:").alias("text")).distinct()
    return symbols.dump_tables(head.unionByName(body), lo=0x08000000, hi=0x08FFFFFF)["norm_site"]


@query(f"""
WITH l AS (SELECT p_brand AS image_id, p_partkey * 4 AS addr, upper([{MNEMONIC_LIST}][CAST(p_partkey % {len(MNEMONICS) - 1} + 1 AS INT)]) AS b FROM part),
t AS (SELECT image_id, addr, CASE WHEN b IN ('B','BL','BX','BLX','CBZ','CBNZ') THEN 'BR' WHEN b LIKE 'LDR%' THEN 'LDR' WHEN b LIKE 'STR%' THEN 'STR' WHEN b IN ('ADD','ADC','SUB','SBC','RSB','MUL','MLA') THEN 'ALU'
       WHEN b IN ('MOV','MVN') THEN 'MOV' WHEN b IN ('CMP','CMN','TST','TEQ') THEN 'CMP' WHEN b IN ('PUSH','POP','STM','LDM') THEN 'STACK' WHEN b LIKE 'V%' OR b LIKE 'F%' THEN 'FP' ELSE b END AS token FROM l)
SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY addr) - 1 AS idx, CAST(addr AS BIGINT) AS addr, 4 AS size, token, CAST(dense_rank() OVER (ORDER BY token) - 1 AS INT) AS token_id FROM t
""")
def q_ir_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    mnemonic = F.element_at(F.array(*map(F.lit, MNEMONICS)), (F.col("p_partkey") % (len(MNEMONICS) - 1) + 1).cast("int"))
    text = F.concat(F.lit("  0x"), F.lower(F.hex(F.col("p_partkey") * 4)), F.lit(":  e1b01000  "), mnemonic, F.lit("  R1, #4 ; x"))
    return ir.token_ids(ir.instruction_rows(p.select(F.col("p_brand").alias("image_id"), F.col("p_partkey").alias("line_no"), text.alias("text")))).select("image_id", "idx", "addr", "size", "token", "token_id")


@query("""
WITH f AS (SELECT p_brand AS image_id, p_type AS name, CAST(p_partkey AS BIGINT) AS off, CAST(p_size AS BIGINT) AS size FROM part WHERE p_partkey % 3 = 0),
s AS (SELECT p_brand AS image_id, p_type AS name, CAST(p_partkey AS BIGINT) AS off, CAST(p_size AS BIGINT) AS size FROM part WHERE p_partkey % 3 <> 0),
m AS (SELECT * FROM f UNION ALL SELECT s.* FROM s ANTI JOIN f USING (image_id, name))
SELECT image_id, count(*) AS n, CAST(sum(greatest(0, least(size, 1000 - off))) AS BIGINT) AS score FROM m GROUP BY image_id
""")
def q_merged_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "part").select(F.col("p_brand").alias("image_id"), F.col("p_type").alias("name"), F.col("p_partkey").alias("off"), F.col("p_size").cast("long").alias("size"))
    merged = symbols.preferred_symbols(s.where("off % 3 = 0"), s.where("off % 3 <> 0"))
    return merged.groupBy("image_id").agg(F.count("*").alias("n")).join(pairing.coverage_score(merged, 1000), "image_id")


@query("""
WITH s AS (SELECT l_suppkey AS pair_id, l_orderkey * 8 AS n_off, CAST(max(l_quantity) AS BIGINT) AS size FROM lineitem GROUP BY 1, 2),
r AS (SELECT pair_id, n_off, size, lag(n_off + size) OVER (PARTITION BY pair_id ORDER BY n_off) AS before FROM s),
g AS (SELECT *, sum(CASE WHEN before IS NULL OR n_off - before < 0 OR n_off - before > 64 THEN 1 ELSE 0 END) OVER (PARTITION BY pair_id ORDER BY n_off) AS g FROM r)
SELECT pair_id, CAST(min(n_off) AS BIGINT) AS n_off, CAST(max_by(n_off + size, n_off) - min(n_off) AS BIGINT) AS size FROM g GROUP BY pair_id, g
""")
def q_merge_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions at one offset in two equal images merge over gaps of at most 64 bytes."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("pair_id"), (F.col("l_orderkey") * 8).alias("off")).agg(F.max("l_quantity").cast("long").alias("size"))
    rows = rows.groupBy("pair_id").agg(F.sort_array(F.collect_list(F.struct("off", "size"))).alias("regions"))

    def kernel(regions: list[dict]) -> list[tuple]:
        found = [kernels.Match(r["off"], r["off"], r["size"]) for r in regions]
        image = bytes(max(m.new + m.length for m in found))
        return [(m.new, m.length) for m in kernels.merged_regions(found, image, image)]

    return flat_map(rows, kernel, "pair_id long, n_off long, size long", keep=1)


# Patches

KINDS_SQL = "[" + ", ".join(f"'{k}'" for k in images.MUTATIONS) + "]"
EVERY_PAIR = f"SELECT doc_id AS pair_id, unnest({KINDS_SQL}) AS kind, true AS ok FROM documents"


def patches(spark: SparkSession, sf_dir: str, mode: str = "global", kinds: tuple[str, ...] = images.MUTATIONS) -> DataFrame:
    return patching.generate_patches(images.mutated_pairs(documents(spark, sf_dir), kinds), ["pair_id", "kind"], mode)


@query(EVERY_PAIR)
def q_roundtrip_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patches(spark, sf_dir, "global").select("pair_id", "kind", "ok")


@query(EVERY_PAIR)
def q_roundtrip_advanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With lines as symbols, paragraphs as sections and numbers as sites."""
    pairs = images.described(images.mutated_pairs(documents(spark, sf_dir)))
    return patching.generate_patches(pairs, ["pair_id", "kind"], "advanced", symbols_col="symbols", sections_col="sections", sites_cols=("old_sites", "new_sites")).select("pair_id", "kind", "ok")


@query("SELECT n.conv_id AS chain, n.turn AS seq, CAST(strlen(coalesce(n.text, '')) AS BIGINT) AS target_len, true AS ok FROM conversations n JOIN conversations o ON o.conv_id = n.conv_id AND o.turn = n.turn - 1")
def q_version_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    chains = images.version_chains(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")
    return patching.generate_patches(chains, ["chain", "seq"]).select("chain", "seq", "target_len", "ok")


@query("SELECT doc_id AS pair_id, md5(encode(coalesce(text, ''))) AS image_md5, CAST(NULL AS VARCHAR) AS error FROM documents")
def q_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patches from each document's mutation back to the document, applied."""
    pairs = images.mutated_pairs(documents(spark, sf_dir), ("small",)).select("pair_id", F.col("new").alias("old"), F.col("old").alias("new"))

    def kernel(old: bytes, new: bytes) -> list[tuple]:
        return [(bytes(old), codec.compress(patching.make_patch(bytes(old), bytes(new))[0]))]

    made = flat_map(pairs, kernel, "pair_id long, old binary, patch binary", keep=1)
    return patching.apply_patches(made, ["pair_id"]).select("pair_id", F.md5("image").alias("image_md5"), "error")


DAMAGE = ("magic", "truncated", "beyond_old", "short", "lz4", "unknown", "long_number")


@query(f"SELECT doc_id AS pair_id, unnest([{', '.join(f'{chr(39)}{d}{chr(39)}' for d in DAMAGE)}]) AS damage, true AS refused FROM documents WHERE strlen(coalesce(text, '')) > 0")
def q_apply_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged patches are refused."""

    def kernel(data: bytes) -> list[tuple]:
        data = bytes(data)
        n = len(data)
        if not n:
            return []
        good = codec.encode([codec.Instruction(codec.COPY, n, 0)], n)
        head = good[: codec.HEADER_SIZE]
        return [("magic", data, b"XXXX" + good[4:]), ("truncated", data, good[:-2]), ("beyond_old", data, codec.encode([codec.Instruction(codec.COPY, n, 1)], n)), ("short", data, head + b"\0"), ("lz4", data, head + b"\x05\0"), ("unknown", data, head + b"\x09\0"), ("long_number", data, head + b"\x01" + b"\xff" * 6 + b"\0")]

    bad = flat_map(documents(spark, sf_dir), kernel, "pair_id long, damage string, old binary, patch binary", keep=1)
    return patching.apply_patches(bad, ["pair_id", "damage"]).select("pair_id", "damage", F.col("error").isNotNull().alias("refused"))


@query(f"SELECT doc_id AS pair_id, unnest({KINDS_SQL}) AS kind, true AS adds_up FROM documents")
def q_op_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoded sizes of a patch's instructions, header and end add up to the stream, and lengths to the target."""

    def kernel(patch: bytes, raw_len: int, target_len: int) -> list[tuple]:
        (target, head), *rows = codec.decode(codec.inflated(bytes(patch)))
        return [(head + sum(n for _, n in rows) + 1 == raw_len and sum(x.length for x, _ in rows) == target == target_len,)]

    return flat_map(patches(spark, sf_dir).select("pair_id", "kind", "patch", "raw_len", "target_len"), kernel, "pair_id long, kind string, adds_up boolean", keep=2)


@query()
def q_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patching.composition(patching.instructions(patches(spark, sf_dir), ["pair_id", "kind"]))


@query()
def q_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patching.resources(patching.instructions(patches(spark, sf_dir), ["pair_id", "kind"]), ["pair_id", "kind"])


#: A line item as an instruction: its kind by the part, region by quantity and supplier, as many changes of 3 bytes as the line's number.
INSTRUCTIONS = f"""
l AS (SELECT l_orderkey AS pair_id, l_partkey % 7 AS kind, CAST(l_quantity AS BIGINT) * 100 AS length, l_suppkey * 100 AS old, CAST(l_linenumber AS BIGINT) AS n FROM lineitem),
e AS (SELECT pair_id, ['COPY', 'ADD', 'DIFF', 'PATCH', 'FILL', 'PATCH_COMPACT', 'PATCH_DIFF'][kind + 1] AS op, length, n, {U.format("length")} AS l, {U.format("old")} AS o FROM l),
x AS (SELECT pair_id, op, length, CASE op WHEN 'COPY' THEN 1 + o + l WHEN 'ADD' THEN 1 + l + length WHEN 'DIFF' THEN 1 + o + l + length WHEN 'FILL' THEN 2 + l WHEN 'PATCH_COMPACT' THEN 3 + o + l + 4 * n ELSE 2 + o + l + 5 * n END AS size,
    CASE WHEN op IN ('ADD', 'DIFF') THEN length WHEN op LIKE 'PATCH%' THEN 3 * n ELSE 0 END AS data, CASE WHEN op IN ('ADD', 'DIFF') THEN (length + 4) // 5 ELSE 0 END AS zeros FROM e)"""


def line_instructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The instructions of patches made of an order's line items, encoded, compressed and read back."""
    item = F.struct((F.col("l_partkey") % 7).alias("kind"), (F.col("l_quantity").cast("long") * 100).alias("length"), (F.col("l_suppkey") * 100).alias("old"), F.col("l_linenumber").cast("int").alias("n"))
    orders = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("pair_id")).agg(F.collect_list(item).alias("items"))
    kinds = (codec.COPY, codec.ADD, codec.DIFF, codec.PATCH, codec.FILL, codec.PATCH_COMPACT, codec.PATCH_DIFF)

    def instruction(kind: int, length: int, old: int, n: int) -> codec.Instruction:
        op = kinds[kind]
        data = (bytes(range(5)) * (length // 5 + 1))[:length] if op in (codec.ADD, codec.DIFF) else b"\x07" if op == codec.FILL else b""
        return codec.Instruction(op, length, 0 if op in (codec.ADD, codec.FILL) else old, data, tuple((8 * i, b"abc") for i in range(n)) if op in (codec.PATCH, codec.PATCH_COMPACT, codec.PATCH_DIFF) else ())

    def kernel(items: list[dict]) -> list[tuple]:
        made = [instruction(**i) for i in items]
        return [(codec.compress(codec.encode(made, sum(x.length for x in made))),)]

    return patching.instructions(flat_map(orders, kernel, "pair_id long, patch binary", keep=1), ["pair_id"])


@query(f"""
WITH {INSTRUCTIONS}, g AS (SELECT op, count(*) AS n, sum(size - data) AS meta_bytes, sum(data) AS data_bytes, sum(size) AS total_bytes, min(length) AS min_length, round(avg(length), 6) AS avg_length, max(length) AS max_length, max(size) AS max_size, sum(length) AS output_bytes, sum(zeros) AS zeros FROM x GROUP BY op)
SELECT op, n, CAST(meta_bytes AS BIGINT) AS meta_bytes, CAST(data_bytes AS BIGINT) AS data_bytes, CAST(total_bytes AS BIGINT) AS total_bytes, min_length, avg_length, max_length, CAST(max_size AS BIGINT) AS max_size, CAST(output_bytes AS BIGINT) AS output_bytes, CAST(zeros AS BIGINT) AS zeros,
    round(100::DOUBLE * total_bytes / sum(total_bytes) OVER (), 6) AS pct, CASE WHEN output_bytes > 0 THEN round(data_bytes / output_bytes, 6) END AS density FROM g
""")
def q_instruction_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patching.composition(line_instructions(spark, sf_dir))


@query(f"""
WITH {INSTRUCTIONS}, g AS (SELECT pair_id, max(CASE WHEN op LIKE 'PATCH%' OR op IN ('COPY', 'DIFF') THEN length ELSE 0 END) AS max_block, max(CASE WHEN op IN ('ADD', 'FILL') THEN length ELSE 0 END) AS max_literal, max(CASE WHEN op LIKE 'PATCH%' THEN length ELSE 0 END) AS max_patch,
    CAST(sum(CASE WHEN op = 'COPY' THEN length ELSE 0 END) AS BIGINT) AS copied, CAST(sum(CASE WHEN op IN ('ADD', 'FILL') THEN length ELSE 0 END) AS BIGINT) AS added, CAST(sum(CASE WHEN op LIKE 'PATCH%' THEN length ELSE 0 END) AS BIGINT) AS patched, CAST(sum(CASE WHEN op = 'DIFF' THEN length ELSE 0 END) AS BIGINT) AS differed FROM x GROUP BY pair_id)
SELECT *, greatest(max_block, max_literal) + 4096 AS peak_bytes, 32768 + 502 + max_patch AS sim_bytes, round(copied / 4e6 + added / 3e6 + patched / 2e6, 9) AS seconds, round(copied / 4e6 + added / 3e6 + (patched + differed) / 2e6, 9) AS seconds_with_diff FROM g
""")
def q_decoder_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patching.resources(line_instructions(spark, sf_dir), ["pair_id"])


@query(f"WITH {INSTRUCTIONS} SELECT op, length, count(*) AS n, row_number() OVER (PARTITION BY op ORDER BY length DESC) <= 10 AS among_longest FROM x GROUP BY op, length")
def q_instruction_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patching.lengths(line_instructions(spark, sf_dir))


@query(f"""
WITH {MATCHES}, k AS (SELECT pair_id, length, row_number() OVER (PARTITION BY pair_id ORDER BY length DESC, n_off, o_off) AS k FROM m)
SELECT pair_id, CAST(k AS INT) AS k, length FROM k WHERE k <= 10
""")
def q_top_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = Window.partitionBy("pair_id").orderBy(F.desc("length"), "n_off", "o_off")
    return matches(spark, sf_dir).withColumn("k", F.row_number().over(by)).where("k <= 10").select("pair_id", "k", "length")


@query("SELECT doc_id AS pair_id, CAST((strlen(coalesce(text, '')) + 501) // 502 AS INT) AS frames, CAST(strlen(coalesce(text, '')) AS BIGINT) AS total_len, md5(encode(coalesce(text, ''))) AS patch_md5 FROM documents WHERE strlen(coalesce(text, '')) > 0")
def q_frame_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of every document, as a stream from files, put together again; the result is a table in the shared folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    run = f"{(base or tempfile.mkdtemp(prefix='bytelake-frames-')).rstrip('/')}/frames-{uuid.uuid4().hex}"
    made = patching.frames(documents(spark, sf_dir).withColumnRenamed("image_id", "pair_id"), ["pair_id"], "bytes")
    n = made.groupBy("pair_id").agg(F.count("*").cast("int").alias("frames"))
    made.join(n, "pair_id").write.mode("overwrite").parquet(f"{run}/in")
    stream = spark.readStream.schema("pair_id long, frame_no int, payload binary, crc32 long, frames int").parquet(f"{run}/in")
    done = reassemble(stream).writeStream.format("parquet").option("checkpointLocation", f"{run}/state").outputMode("append").trigger(availableNow=True).start(f"{run}/out")
    done.awaitTermination()
    return spark.read.schema("pair_id long, frames int, total_len long, total_crc32 long, patch binary").parquet(f"{run}/out").select("pair_id", "frames", "total_len", F.md5("patch").alias("patch_md5"))
