import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from bytelake.functions import codec
from bytelake.functions.codec import ADD, COPY, DIFF, FILL, PATCH, PATCH_COMPACT, PATCH_DIFF, Instruction, PatchError
from bytelake.plans import patching
from bytelake.sources.images import MUTATIONS, mutate

HEAD = "445054310000{}00000000"
GOLDENS = [
    ([], 0, HEAD.format("00000000") + "00"),
    ([Instruction(COPY, 300)], 300, HEAD.format("2c010000") + "0100ac0200"),
    ([Instruction(ADD, 2, data=b"ab")], 2, HEAD.format("02000000") + "0202616200"),
    ([Instruction(FILL, 8, data=b"\xff")], 8, HEAD.format("08000000") + "06ff010800"),
    ([Instruction(PATCH, 4, changes=((2, b"\xaa"),))], 4, HEAD.format("04000000") + "04000401" + "0201aa00"),
    ([Instruction(PATCH_COMPACT, 4, changes=((1, b"\xaa"), (3, b"\xbb")))], 4, HEAD.format("04000000") + "07000402" + "010102aabb00"),
    ([Instruction(DIFF, 2, data=b"\x01\xff")], 2, HEAD.format("02000000") + "03000201ff00"),
    ([Instruction(PATCH_DIFF, 4, changes=((2, b"\x01"),))], 4, HEAD.format("04000000") + "08000401" + "02010100"),
]


@pytest.mark.parametrize(("instructions", "size", "stream"), GOLDENS)
def test_goldens(instructions, size, stream):
    raw = codec.encode(instructions, size)
    assert raw.hex() == stream
    decoded = list(codec.decode(raw))
    assert decoded[0][0] == size and [x for x, _ in decoded[1:]] == instructions
    assert len(codec.apply_patch(bytes(400), raw)) == size
    assert codec.apply_patch(bytes(400), codec.compress(raw)) == codec.apply_patch(bytes(400), raw)


@pytest.mark.parametrize("bad", ["4450543200000100000000000000", "44505431000001000000000000000100ff", "44505431000001000000000000000100ffffffffffff0100", "445054310000010000000000000001000200", "44505431000002000000000000000201616100", "445054310000040000000000000004000401040200aabb00", "44505431000001000000000000000500", "44505431000001000000000000000900", "445054310000010000000000000000"])
def test_refused(bad):
    with pytest.raises(PatchError):
        codec.apply_patch(b"x", bytes.fromhex(bad))


def test_six_byte_numbers_are_read():
    assert codec.Reader(bytes.fromhex("808080808001")).uleb() == 1 << 35


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=400), st.binary(max_size=400), st.sampled_from(["global", "advanced"]))
def test_round_trip_of_any_pair(a, b, mode):
    for old, new in ((a, b), (a, a + b + a), (a * 3, b + a * 2)):
        raw, ok = patching.make_patch(old, new, mode)
        assert ok and codec.apply_patch(old, raw) == new


@pytest.mark.parametrize("kind", MUTATIONS)
def test_round_trip_of_mutations(kind):
    data = b"".join(b"line %d of %d words\n" % (i, i * 7919 % 101) for i in range(400))
    for mode in ("global", "advanced"):
        raw, ok = patching.make_patch(data, mutate(kind, data, 5), mode)
        assert ok and len(codec.compress(raw)) < len(data)
    p = patching.Profile(chunked=True)
    assert codec.apply_patch(data, codec.encode(patching.plan_global(data, mutate(kind, data, 5), p), len(mutate(kind, data, 5)))) == mutate(kind, data, 5)


def test_symbols_and_sites_make_no_wrong_bytes():
    from bytelake.functions.kernels import Match

    old = bytes(range(256)) * 8
    new = old[:100] + b"\xff\xff\xff\xff" + old[104:] + b"tail"
    raw = codec.encode(patching.plan_advanced(old, new, [Match(0, 0, 512), Match(512, 512, 512), Match(600, 600, 300)], patching.Profile(fast_path=0), sites=([(100, "ptr")], [(100, "branch")])), len(new))
    assert codec.apply_patch(old, raw) == new
    raw = codec.encode(patching.plan_global(old, new, sites=([(100, "ptr")], [(100, "ptr")])), len(new))
    assert codec.apply_patch(old, raw) == new


def test_peephole_and_literals():
    joined = codec.peephole([Instruction(COPY, 3, 5), Instruction(COPY, 4, 8), Instruction(ADD, 1, data=b"a"), Instruction(ADD, 2, data=b"bc")])
    assert joined == [Instruction(COPY, 7, 5), Instruction(ADD, 3, data=b"abc")]
    assert codec.literals(b"ab" + b"z" * 9 + b"c") == [Instruction(ADD, 2, data=b"ab"), Instruction(FILL, 9, data=b"z"), Instruction(ADD, 1, data=b"c")]
    assert codec.first_difference(b"abc", b"abd") == 2 and codec.first_difference(b"ab", b"abd") == 2 and codec.first_difference(b"a", b"a") is None


def test_symbol_regions_are_gated_by_similarity():
    rng = __import__("numpy").random.default_rng(5)
    old = rng.integers(0, 256, 3000).astype("u1").tobytes()
    body = bytearray(old[500:1500])
    body[20::50] = bytes(b ^ 255 for b in body[20::50])  # 20 changed runs
    dense = bytearray(old[1500:2000])
    for k in range(0, 500, 10):
        dense[k : k + 2] = bytes(b ^ 255 for b in dense[k : k + 2])  # 20 % of the bytes
    new = bytes(rng.integers(0, 256, 300).astype("u1").tobytes() + body + dense)
    p = patching.Profile(fast_path=0)
    where = lambda xs: [(x.op in (PATCH, PATCH_COMPACT, PATCH_DIFF, DIFF), x.length, x.old) for x in xs if x.op != ADD]
    from bytelake.functions.kernels import Match

    assert where(patching.plan_advanced(old, new, [Match(300, 500, 1000)], p))[0] == (True, 1000, 500)
    assert (True, 500, 1500) in where(patching.plan_advanced(old, new, [Match(1300, 1500, 700)], p))  # cut to the image, too
    assert (True, 1000, 500) not in where(patching.plan_advanced(old, new, [Match(300, 500, 1000)], patching.Profile(fast_path=0, least_similarity=0.99)))
    filled = where(patching.plan_advanced(old, new, [Match(300, 500, 400)], p, sections=[Match(300, 500, 1500)]))
    assert filled == [(True, 400, 500), (True, 1100, 900)]


def test_patches_take_metadata(spark):
    from bytelake.sources import images

    line = b"%d a line of some text that goes on for a while, number 1234\n"
    old = b"".join(line % (1000 * i) for i in range(60))
    new = b"".join(sorted((line % (1000 * i) for i in range(60)), reverse=True)).replace(b"1234", b"5678") + b"\n\nnew end"
    pairs = images.described(spark.createDataFrame([(1, "x", bytearray(old), bytearray(new))], "pair_id long, kind string, old binary, new binary"))
    row = pairs.first()
    assert len(row.symbols) == 60 and len(row.sections) == 1 and len(row.old_sites) >= 60 and row.old_sites[0].kind == "ptr"
    some = {"symbols_col": "symbols", "sections_col": "sections", "sites_cols": ("old_sites", "new_sites")}
    for mode in ("global", "advanced"):
        got = patching.generate_patches(pairs, ["pair_id"], mode, patching.Profile(fast_path=0), **some).first()
        assert got.ok
    plain = patching.generate_patches(pairs, ["pair_id"], "advanced", patching.Profile(fast_path=0)).first()
    assert plain.ok and plain.raw_len != got.raw_len


def test_row_kernels_yield_batches_bounded_by_bytes():
    """Few large rows don't gather in a worker; a larger one goes alone."""
    import pyarrow as pa
    from types import SimpleNamespace

    from bytelake.operators.rowwise import flat_map

    table = SimpleNamespace(columns=["i", "data"], is_cached=False, mapInArrow=lambda f, kind: SimpleNamespace(f=f))
    run = flat_map(table, lambda data: [(data * k, [(1, 2)] * k) for k in (1, 2, 9)], "i long, data binary, pairs array<struct<a:long,b:long>>", keep=1, most_bytes=5000).f
    given = pa.RecordBatch.from_pydict({"i": list(range(20)), "data": [bytes([i]) * 1000 for i in range(20)]})
    made = list(run(iter([given, given])))
    assert [r for b in made for r in b.to_pylist()] == 2 * [{"i": i, "data": bytes([i]) * 1000 * k, "pairs": [{"a": 1, "b": 2}] * k} for i in range(20) for k in (1, 2, 9)]
    assert all(b.nbytes <= 5000 or b.num_rows == 1 for b in made) and len(made) == 80


def test_row_kernels_in_one_pass(spark):
    """Pairs, their metadata and their patches are made in one worker, and are those of passes on their own."""
    from bytelake.sources import images

    texts = [(i, bytearray(b"line %d of 1234\n" % i * 9 + b"\n\n" + bytes(range(256)) * i)) for i in range(5)]
    pairs = images.mutated_pairs(spark.createDataFrame([*texts, (5, bytearray())], "image_id long, bytes binary"))
    some = {"symbols_col": "symbols", "sections_col": "sections", "sites_cols": ("old_sites", "new_sites")}
    one = patching.generate_patches(images.described(pairs), ["pair_id", "kind"], "advanced", **some)
    parts = patching.generate_patches(images.described(pairs.select("*")).select("*"), ["pair_id", "kind"], "advanced", **some)
    plans = [d._jdf.queryExecution().executedPlan().toString().count("MapInArrow") for d in (one, parts)]
    assert plans == [1, 3]
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, parts.collect())) and one.count() == 36
