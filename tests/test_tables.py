"""Relational operators on small tables, and every query against DuckDB on the smallest data."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from bytelake import queries as own
from bytelake.functions.bytes_sql import word_at
from bytelake.operators import ir, pairing
from bytelake.operators.similarity import breakdown, density_threshold, guess_mode
from bytelake.plans import patching
from bytelake.sources import images, symbols

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(v):
    return f"{v:.9g}" if isinstance(v, float) else bytes(v).hex() if isinstance(v, bytes | bytearray) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return c


@pytest.mark.parametrize("name", sorted(own.QUERIES))
def test_query(spark, duck, name):
    df = own.QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in own.ORACLES:
        assert rows
        return
    got = duck.execute(own.ORACLES[name])
    columns = [d[0] for d in got.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    a = sorted(repr([cell(r[c]) for c in order]) for r in rows)
    b = sorted(repr([cell(r[columns.index(c)]) for c in order]) for r in got.fetchall())
    assert a == b


def test_entry(spark):
    assert entry.entry(spark).where("NOT ok").count() == 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_symbol_layouts(spark):
    texts = ['{"symbols": [{"name": "a1", "addr": 20, "size": 4}, "x", {"symbol": "b1", "off": "0x8", "size": 2}, {"name": "$c", "off": 1, "size": 1}, {"name": "neg", "addr": 3, "size": 4}]}', '{"sections": {"3": {"symbols": {"foo": {"file_offset": 9, "size": 1}}}}}', '{"bar": {"off": 12, "size": 0}, "baz": [{"off": 1, "size": 2}, {"off": 5, "size": 2}]}', "no json", None, "[1]"]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "image_id string, text string")
    got = {(r.image_id, r.name, r.off, r["size"]) for r in symbols.symbol_table(df, 10).collect()}
    assert got == {("0", "a1", 10, 4), ("0", "b1", 8, 2), ("1", "foo", 9, 1), ("2", "baz", 1, 2), ("2", "baz", 5, 2)}


def test_dump(spark):
    lines = ["  0:  load  0x34  0x08000000", "  3: P1 ro            pbits   0x8000188  0x1bc  0x5c5c 0x4", "Section #7 .symtab:", "  12: foo   0x08000200  3 Code Gb 0x40", "  13: $a    0x08000200  3 -- Lc", "  14: gone  0x08000300  Abs -- Lc", "Section #4 P2 ro:", "  0x20:    0xe1b01000     MOV   R1, R0", "  0x24:    0xea000000     B   label", "  0x4f044: 0x08001234     DC32  0x08001234", "  0x4f048: 0x0078         DC16  ??sym + 0x14"]
    t = symbols.dump_tables(spark.createDataFrame([("i", n, x) for n, x in enumerate(lines)], "image_id string, line_no long, text string"))
    assert [tuple(r) for r in t["segment"].collect()] == [("i", 0x34, 0x08000000)]
    assert [tuple(r) for r in t["section"].collect()] == [("i", 3, "P1 ro", 0x8000188, 0x1BC, 0x5C5C)]
    assert sorted((r.name, r.size_decl) for r in t["symbol"].collect()) == [("$a", None), ("foo", 0x40)]
    assert sorted((r.addr, r.kind) for r in t["norm_site"].collect()) == [(0x24, "branch"), (0x4F044, "ptr"), (0x4F048, "ptr")]


def test_tokens_to_bytes(spark):
    lines = ["  0x0: e1b01000 MOV R1, R0", "  0x4: 0xeafffffe b 0x10 ; x", "  0x8: e5901000 LDR R1, [R0, #4]"]
    rows = ir.token_ids(ir.instruction_rows(spark.createDataFrame([("i", n, x) for n, x in enumerate(lines)], "image_id string, line_no long, text string"))).orderBy("idx").collect()
    assert [(r.token, r["size"], r.operands) for r in rows] == [("MOV", 4, "R1, R0"), ("BR", 4, "IMM"), ("LDR", 4, "R1, [R0, #IMM]")]
    old, new = bytes(range(32)), bytes(range(8)) + b"XXXX" + bytes(range(12, 32))
    spots = [(i, 4) for i in range(0, 32, 4)]
    found = ir.token_matches(bytes([1, 2, 3, 4, 5, 6, 7, 8]), bytes([1, 2, 3, 4, 5, 6, 7, 8]))
    assert [tuple(m) for m in ir.byte_matches(found, spots, spots, old, new)] == [(0, 0, 8), (12, 12, 20)]


def test_intervals(spark):
    spans = spark.createDataFrame([(1, 2, 5), (1, 4, 9), (1, 20, 22), (2, 0, 4), (1, 7, 7)], "pair_id int, start long, end long")
    lengths = spark.createDataFrame([(1, 30), (2, 4), (3, 6)], "pair_id int, length long")
    assert sorted(map(tuple, pairing.union_of_intervals(spans).collect())) == [(1, 2, 9), (1, 20, 22), (2, 0, 4)]
    assert sorted(map(tuple, pairing.gaps(spans, lengths).collect())) == [(1, 0, 2), (1, 9, 20), (1, 22, 30), (3, 0, 6)]


def test_words_and_similarity(spark):
    df = spark.createDataFrame([(bytearray(b"\x01\x02\x03\x04\x05"),)], "b binary")
    r = df.select(word_at(df.b, df.b.isNotNull().cast("int") * 0), word_at(df.b, df.b.isNotNull().cast("int") * 0, endian="be"), word_at(df.b, df.b.isNotNull().cast("int") * 2)).first()
    assert tuple(r) == (0x04030201, 0x01020304, -1)
    assert breakdown(b"", b"a", 0, 1)[1:] == (0.0, 0.0, 0.0, 0.0)
    assert breakdown(b"a" * 64, b"a" * 64, 0, 1)[1] == 1.0
    head = (0x20001000).to_bytes(4, "little") + (0x08000101).to_bytes(4, "little")
    assert guess_mode(head + bytes(64), 0x08000000, 0x08100000) == "thumb"
    assert [density_threshold(x) for x in (0.9, 0.75, 0.1)] == [0.7, 0.6, 0.5]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "old.bin").write_bytes(b"abc" * 100)
    assert [(r.len, bytes(r.bytes)) for r in images.read_images(spark, str(tmp_path)).collect()] == [(300, b"abc" * 100)]
    made = patching.frames(images.read_images(spark, str(tmp_path)), ["image_id"], "bytes", payload=128)
    made.write.parquet(str(tmp_path / "frames"))
    assert sorted((r.frame_no, len(r.payload)) for r in spark.read.parquet(str(tmp_path / "frames")).collect()) == [(0, 128), (1, 128), (2, 44)]


def test_resources_of_every_mutation(spark):
    rows = own.q_resources(spark, SF).select("pair_id", "kind").collect()
    ids = {r.image_id for r in own.documents(spark, SF).where("octet_length(bytes) > 0").collect()}
    assert len(rows) == len(set(rows)) and {r.kind for r in rows} == set(images.MUTATIONS)
    assert {(r.pair_id, r.kind) for r in rows} >= {(i, k) for i in ids for k in images.MUTATIONS}


def test_similarity_masks_addresses():
    """Images that differ in words that look like addresses alone share all grams."""
    rest = bytes(range(1, 61))
    old, new = (rest + a.to_bytes(4, "little") + rest for a in (0x08000100, 0x08000F00))
    mode, sim, grams, sites, alike = breakdown(old, new, 0x08000000, 0x08001000, "raw")
    assert (mode, grams, sites, alike) == ("raw", 1.0, 1.0, 1.0) and abs(sim - 1.0) < 1e-12
    assert breakdown(old, new, 0, 1, "raw")[2] < 1.0


def test_map_lines(spark):
    lines = [
        (1, " .text  0x08000010  0x20  src/main.o"), (2, " .text  0x08000010  0x20  zeta,"), (3, "alpha: 0x08000010 12"), (4, r" 0x08000040 beta: C:\lib\x.o"),
        (5, "0x09000000 far"), (6, "no address here"), (7, "0x08000080 a"), (8, "0x08000100 last"),
    ]
    d = spark.createDataFrame([("i", n, t) for n, t in lines], "image_id string, line_no int, text string")
    got = sorted((r.name, r.off, r.size) for r in symbols.map_symbols(d, 0x08000000, 0x1000).collect())
    assert got == [(".text", 0x10, 0x30), ("beta", 0x40, 0xC0)]


def test_sections_of_symbols(spark, tmp_path):
    sections = spark.createDataFrame([("i", 1, "P1 ro", 0x100, 0x10, 0x40), ("i", 2, "P1", 0x200, 0x50, 0), ("i", 3, "P1 rw", 0x300, 0x90, 0x20)], "image_id string, section_index int, name string, addr long, file_offset long, size long")
    assert [(r.addr_start, r.addr_end) for r in ir.section_bounds(sections, "P1").collect()] == [(0x100, 0x140)]
    assert ir.section_bounds(sections, "P9").count() == 0
    rows = pairing.symbols_in_sections(spark.createDataFrame([("i", 3, "f", 0x308)], "image_id string, section_index int, name string, addr long"), sections).collect()
    assert [r.file_off for r in rows] == [0x98]
    (tmp_path / "a.json").write_text('{"symbols": {"func": {"addr": 272, "size": 8}, "x": 3}}')
    (tmp_path / "b.json").write_text("not json")
    assert [(r.name, r.off, r.size) for r in symbols.read_symbols(spark, str(tmp_path), 256).collect()] == [("func", 16, 8)]
    assert symbols.read_symbols(spark, str(tmp_path / "none")).count() == 0


def test_token_numbers_are_bounded(spark):
    rows = spark.createDataFrame([("b",), ("a",), ("b",)], "token string")
    assert sorted(map(tuple, ir.token_ids(rows).collect())) == [("a", 0), ("b", 1), ("b", 1)]
    with pytest.raises(ValueError):
        ir.token_ids(rows, most=1)
