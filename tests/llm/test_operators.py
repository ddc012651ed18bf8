"""Each operator against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import base64
import collections
import gzip
import hashlib
import math
import random
import re
import time
import tracemalloc
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from bytelake.llm import boosting, chat, exact, fingerprint, jaccard, mixing, packing, pii, quality, sharding, warc
from bytelake.llm.common import released, strings
from bytelake.llm.components import components, extended
from bytelake.llm.queries import queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, size long, row string, key string, n long, score double, salt int, `odd name.x` int"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def hard_rows():
    rng = random.Random(5)
    base = prose(rng, 120)
    words = base.split()
    rows = [(1, None, None), (2, "", "b"), (3, "   \n", "b"), (4, "one", "a"), (4, "one", "a"), (5, "One", None), (None, "one", "a"), (None, None, None), (6, base, "a"), (7, base.upper(), "a"), (8, " ".join(words[:60] + ["x"] + words[61:]), "c"), (9, base + "\tEnd", "c"), (10, "Ünïcode é 日本 🎉 " * 30, "d"), (10, "other text under the same identifier", "d"), (11, prose(rng, 30_000), "e"), (12, "<|endoftext|> \\### </turn> \x00 \x1c", "é")]
    rows += [(20 + i, base, "hot") for i in range(30)]
    rows += [(100 + i, prose(rng, rng.randrange(1, 300)), rng.choice(["a", "b", "hot"])) for i in range(60)]
    return [(i, t, "en", s, None if t is None else len(t), True, 7, "r", "k", 3, 0.5, 1, 9) for i, t, s in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(hard_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def fold(t):
    return (t or "").translate({c: c + 32 for c in range(65, 91)})


def word_list(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def shingles(t, k=5):
    w = word_list(fold(t))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


# Packing


def test_packing(docs, none):
    from tokenizers import Tokenizer
    import public_tokenizers

    tok = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    rows = packing.pack_documents(docs).collect()
    want = collections.Counter()
    for r in docs.collect():
        ids = [*tok.encode(r.text or "", add_special_tokens=False).ids, 1]
        want[(r.doc_id, len(ids))] += 1
        for p in {(p.start, p.length, p.ids_crc32) for p in rows if p.doc_id == r.doc_id and p.doc_tokens == len(ids)}:
            if p[0] + p[1] <= len(ids) and [x for x in hard_rows() if x[0] == r.doc_id] == [x for x in hard_rows() if x[0] == r.doc_id and x[1] == r.text]:
                assert zlib.crc32(np.array(ids[p[0] : p[0] + p[1]], dtype="<u4").tobytes()) == p[2]
    for (doc, n), times in want.items():
        mine = sorted((p.start, p.length) for p in rows if p.doc_id == doc and p.doc_tokens == n)
        covered = collections.Counter(i for a, b in mine for i in range(a, a + b))
        assert set(covered) == set(range(n)) and set(covered.values()) == {times}
    by = collections.defaultdict(list)
    for p in rows:
        by[p.sequence_id].append(p)
    for ps in by.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == ps[0].sequence_length <= 2048
    assert packing.pack_documents(none).count() == 0


@pytest.mark.parametrize("text", ["a   b  c \n d", "  x", "\n\n y\t z  ", "don't 'S we'll 123abc…¿qué?", "x \n\n\ny  z", "日本語 テスト 🎉 \x1c a\x85b", "ab<|endoftext|>c", "Ça, naïve; œuvre. ſtraße ²³ ½"])
def test_encoder_agrees_with_tokenizer(text):
    e = packing.Encoder()
    assert e.ids(text) == e.whole(text) == e.ids(text)


def test_little_padding_on_many_small_partitions(spark):
    rng = random.Random(12)
    docs = spark.createDataFrame([(i, prose(rng, rng.randrange(1, 400))) for i in range(1000)], "doc_id long, text string")
    for parts in (1, 70):
        rows = packing.pack_documents(docs.repartition(parts)).collect()
        used, sequences = sum(r.length for r in rows), {r.sequence_id for r in rows}
        assert 1 - used / (2048 * len(sequences)) < 0.025
        assert sum(r.doc_tokens for r in rows if r.start == 0) == used and all(r.sequence_id >= 0 for r in rows)


def test_differencing_is_near_equal():
    rng = random.Random(1)
    sizes = [rng.randrange(1, 513) for _ in range(300)]
    groups = packing.windows(sizes, 2048)
    assert sorted(i for g in groups for i in g) == list(range(300))
    totals = [sum(sizes[i] for i in g) for g in groups]
    assert max(totals) <= 2048 and max(totals) - min(totals) < 200
    assert packing.windows([], 10) == [] and packing.windows([2048, 1], 2048) == [[0], [1]]


# Quality


def test_quality(spark, docs, none):
    rng = random.Random(3)
    rows = [(i, prose(rng, 80) if i % 2 else " ".join([rng.choice(WORDS)] * 80)) for i in range(400)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i, _ in rows] + [(1, 1, 0), (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    net = quality.fit_quality(d, labels, epochs=12)
    got = {r.doc_id: r for r in quality.score_quality(d, net).collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, _ in rows)
    out = [r for r in got.values() if r.held_out]
    assert len(out) > 50 and np.mean([r.predicted == r.doc_id % 2 for r in out]) > 0.9
    again = quality.fit_quality(d, labels, epochs=12)
    assert all(np.array_equal(net.p[k], again.p[k]) for k in net.p)
    hard = quality.score_quality(docs, net, carry=docs.columns).collect()
    assert len(hard) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in hard)
    assert {r.row["odd name.x"] for r in hard} == {9}
    assert quality.score_quality(none, net).count() == 0
    for l in (labels.where("quality = 1"), labels.limit(0)):
        assert len({r.score for r in quality.score_quality(docs, quality.fit_quality(d, l)).collect()}) == 1


def test_quality_memory(spark):
    """Temporary arrays are small beside the texts; a carried text goes to the worker once; answers come in bounded batches."""
    net, texts = quality.Network.fresh(8, 32, 24, np.random.default_rng(1)), [b"some words " * 10_000] * 10
    tracemalloc.start()
    net.score(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16_000_000
    docs = spark.createDataFrame([(i, None if i % 7 == 0 else "word " * i) for i in range(300)], "doc_id long, text string").coalesce(1)
    got = quality.score_quality(docs, net, carry=docs.columns)
    sent = re.search(r"MapInArrow.*?\n.*?Project \[(.*)\]", got._jdf.queryExecution().analyzed().toString())[1]
    assert len(re.findall(r"\btext#", sent)) == 1
    plain = {r.doc_id: r.score for r in quality.score_quality(docs, net).collect()}
    rows = got.collect()
    assert [(r.row.doc_id, r.row.text) for r in rows] == [(r.doc_id, r.text) for r in docs.collect()]
    assert all(r.doc_id == r.row.doc_id and abs(r.score - plain[r.doc_id]) < 1e-6 for r in rows)


def test_driver_lists_start_no_python_workers(spark):
    for values in ([], ["a", "b"]):
        made = strings(spark, "x", values)
        assert [r.x for r in made.collect()] == values
        assert "LogicalRDD" not in made._jdf.queryExecution().logical().toString()
    docs = spark.createDataFrame(pa.table({"doc_id": [1, 2], "text": ["a", "A"]}))
    assert "ExistingRDD" not in exact.content_sort_dedup(docs)._jdf.queryExecution().executedPlan().toString()


def test_released_kernels_give_memory_back():
    def anonymous():
        with open("/proc/self/smaps_rollup") as f:
            return sum(map(int, re.findall(r"Pss_Anon:\s+(\d+)", f.read()))) // 1024

    def kernel(batches):
        for b in batches:
            held = [np.ones(12_500) for _ in range(1000)]  # 100 MB in pieces that malloc keeps
            yield b
            del held[:-1]
            last.append(held.pop())

    last = []
    before = anonymous()
    assert list(released(kernel)(iter([1, 2]))) == [1, 2]
    assert anonymous() - before < 50


def test_quality_sees_the_whole_text():
    net = quality.Network.fresh(8, 8, 8, np.random.default_rng(1))
    a = b"same words " * 5000
    scores = net.score([a, a[:-9] + b"DIFFERENT", a[:30_000] + b"@@@@@@@@" + a[30_008:]])
    assert len(set(scores.tolist())) == 3
    assert np.allclose(net.score([a, b"", b"x"]), [net.score([t])[0] for t in (a, b"", b"x")])


def naive_score(p, chunks):
    """Probability by one loop over each chunk's (bytes, places of filters, share filled)."""
    hidden = []
    for data, places, fill in chunks:
        pooled = np.full(len(p["bias"]), -np.inf)
        for at in places:
            window = np.concatenate([p["embed"][b] for b in data[at : at + quality.WIDTH]]).astype(float)
            pooled = np.maximum(pooled, window @ p["filters"])
        m = np.append(np.maximum(pooled + p["bias"], 0), fill)
        hidden.append(np.maximum(m @ p["hidden"] + p["hidden_bias"], 0))
    d = np.concatenate([np.mean(hidden, axis=0), np.max(hidden, axis=0)])
    return 1 / (1 + math.exp(-(d @ p["out"] + p["out_bias"][0])))


def naive_chunks(text):
    """Chunks of four cells, each three cells after the one before, that reach the end of the text and the padding its last filter sees."""
    cells = -(-(len(text) + quality.WIDTH) // quality.CELL)
    data, out, first = text + bytes(2 * quality.CHUNK), [], 0
    while True:
        end = min(first + quality.CELLS, cells)
        out.append((data, range(first * quality.CELL, end * quality.CELL, quality.STRIDE), min(quality.CHUNK, max(0, len(text) - first * quality.CELL)) / quality.CHUNK))
        if end == cells:
            return out
        first += quality.STEP


def test_quality_forward_pass_against_loops():
    rng = np.random.default_rng(3)
    net = quality.Network.fresh(4, 5, 6, rng)
    net.p["bias"], net.p["out_bias"] = rng.standard_normal(5).astype(np.float32) * 0.1, np.array([0.2], dtype=np.float32)
    texts = [rng.integers(1, 256, n).astype(np.uint8).tobytes() for n in (0, 1, 7, 119, 120, 121, 127, 128, 129, 376, 377, 503, 504, 505, 512, 1000, 2600)]
    for step in (128, 1 << 18):
        assert np.allclose(net.score(texts, step), [naive_score(net.p, naive_chunks(t)) for t in texts], atol=1e-5)


def test_quality_gradients_against_differences():
    rng = np.random.default_rng(4)
    p = {k: v.astype(np.float64) for k, v in quality.Network.fresh(3, 4, 5, rng).p.items()}
    p["bias"], p["hidden_bias"] = rng.standard_normal(4) * 0.1, rng.standard_normal(5) * 0.1
    texts = [rng.integers(1, 256, n).astype(np.uint8).tobytes() for n in (40, 700, 1500)]
    part = [(quality.training_chunks(t, 99), y) for t, y in zip(texts, (1, 0, 1), strict=True)]
    places = range(0, quality.CHUNK, quality.STRIDE)

    def loss():
        probs = [naive_score(p, [(b, places, n / quality.CHUNK) for b, n in chunks]) for chunks, _ in part]
        return -sum(math.log(q if y else 1 - q) for q, (_, y) in zip(probs, part, strict=True)) / len(part)

    found = quality.gradients(p, part)
    assert found.keys() == p.keys()
    for name, g in found.items():
        assert g.shape == p[name].shape
        flat, gs = p[name].reshape(-1), np.asarray(g, dtype=float).reshape(-1)
        for i in {int(np.abs(gs).argmax()), *rng.integers(0, flat.size, 3).tolist()}:
            was, eps = flat[i], 1e-5
            flat[i] = was + eps
            up = loss()
            flat[i] = was - eps
            down = loss()
            flat[i] = was
            assert math.isclose((up - down) / (2 * eps), gs[i], rel_tol=2e-3, abs_tol=2e-6), (name, i)


# Mixing


def test_mixing(docs, none):
    rows = mixing.mix_sources(docs).collect()
    assert len(rows) == docs.count()
    size = collections.Counter()
    for r in hard_rows():
        size[r[3]] += len(word_list(r[1]))
    order = sorted(s for s in size if s is not None) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    goal, target, free = 1.5 * sum(size.values()), {}, set(size)
    while free:
        left = goal - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * size[s]]
        if not over:
            target |= share
            break
        target |= {s: 2 * size[s] for s in over}
        free -= set(over)
    taken = collections.Counter()
    for r in rows:
        assert r.source_size == size[r.source] and r.target == pytest.approx(target[r.source]) and 0 <= r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) < 1 for s in size)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix_sources(docs.repartition(7)).collect()))
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    got = collections.Counter()
    for r in mixed.collect():
        got[r.source] += len(word_list(r.text))
    assert got == {s: n for s, n in taken.items() if n}
    assert mixing.mix_sources(none).count() == 0 and mixing.mixed_documents(none).count() == 0


# WARC


def test_warc(spark, tmp_path):
    schema = "page_id long, url string, html string, file int"
    rows = [(i, f"http://x/{i}\r\nEvil: 1", f"<p>é {i}</p>\r\n\r\nWARC/1.1\r\n", 0) for i in range(-40, 9000, 3)] + [(None, None, None, 0), (6, None, None, 0), (6, None, None, 0), (7, "u", None, 0)]
    left = spark.createDataFrame(rows, schema)

    def written(t):
        path = str(tmp_path / uuid.uuid4().hex)
        warc.write_warc(warc.warc_records(t), path)
        return path

    def audit(a, b, **options):
        found = warc.fixity_audit(*(warc.read_digests(spark, written(t)) for t in (a, b)), **options).collect()
        return sorted((r.id[10:-1], r.status) for r in found)

    assert audit(left, left) == []
    right = spark.createDataFrame([(i, u, (h or "") + "!" if i in (8, 77) else h, f) for i, u, h, f in rows if i != 83][:-4] + rows[-3:-1] + [(7, "u", "!", 0), (9999, "n", "n", 0), (None, "z", "z", 0)], schema)
    want = [("77", "corrupt"), ("8", "corrupt"), ("83", "missing"), ("9999", "extra"), ("7", "corrupt"), ("none", "corrupt")]
    assert audit(left, right) == sorted(want)
    assert {i for i, s in audit(left, right, moved=True) if s == "moved"} == {str(r[0]) for r in rows if r[0] is not None and 8 < r[0] < 4096 and r[0] not in (77, 83)}
    assert audit(left.limit(0), left.limit(0)) == [] and len(audit(left, left.limit(0))) == len(rows)
    far = spark.createDataFrame([(-(1 << 63), "a", "b", 0), ((1 << 63) - 1, "a", "b", 0)], schema)
    assert len(audit(far, far.limit(0))) == 2 and audit(far, far) == []
    back = warc.read_warc(spark, written(left)).collect()
    assert sorted(bytes(r.payload).decode() for r in back) == sorted(r[2] or "" for r in rows)
    assert {r.kind for r in back} == {"resource"}


def test_replicas_are_written_from_one_shuffle_of_the_pages(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, f"http://x/{i}", base64.b64encode(rng.randbytes(1500)).decode(), i % 3 == 0) for i in range(-4100, 4200, 5)] + [(None, None, None, False), (6, "u", None, True), (6, None, "é", False)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, extra boolean").repartition(3)
    sides = [(~F.col("extra"), F.col("html")), (F.col("page_id") % 7 != 0, F.concat(F.lit("?"), F.col("html"))), (F.lit(False), F.col("html"))]

    def inflated(folder):
        names = sorted(p for p in folder.rglob("part-*.gz"))
        assert len({p.parent for p in names}) == len(names)  # one file in a folder
        return {p.parent.name: gzip.decompress(p.read_bytes()) for p in names}

    folders = warc.write_replicas(pages, str(tmp_path / "all"), sides)
    for i, (held, body) in enumerate(sides):
        warc.write_warc(warc.warc_records(pages.where(held).withColumn("html", body)), str(tmp_path / f"one{i}"))
        assert inflated(tmp_path / "all" / f"replica={i}") == inflated(tmp_path / f"one{i}")
        assert warc.read_digests(spark, folders[i]).count() == pages.where(held).count()
    assert sum(map(len, inflated(tmp_path / "one0").values())) > 1_500_000

    pages.drop("extra").where("page_id > 0").write.parquet(str(tmp_path / "pages.parquet"))
    sc = spark.sparkContext._jsc.sc()

    def shuffled():
        sc.listenerBus().waitUntilEmpty()
        return sc.statusStore().executorList(False).head().totalShuffleWrite()

    before = shuffled()
    assert queries()["op4_fixity"](spark, str(tmp_path)).count()
    written = shuffled() - before
    assert written < 1.6 * sum(p.stat().st_size for p in (tmp_path / "pages.parquet").glob("part-*"))


def test_damage_between_and_order_of_records(spark, tmp_path):
    one, two, three = (f"WARC/1.1\r\nWARC-Record-ID: <{i}>\r\nContent-Length: 3\r\n\r\nab{i}\r\n\r\n".encode() for i in range(3))
    files = {"a": one + two + three, "b": one + b"junk" + two + three, "c": one + three + two, "d": gzip.compress(one) + gzip.compress(two) + gzip.compress(three)}
    for name, data in files.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.warc").write_bytes(data)
    digests = {name: warc.read_digests(spark, str(tmp_path / name)) for name in files}
    told = lambda b, **options: sorted((str(r.id), r.status, r.offset) for r in warc.fixity_audit(digests["a"], digests[b], **options).collect())
    assert told("d", moved=True) == []
    assert told("b") == [("None", "extra", len(one))]
    assert told("c") == [] and told("c", moved=True) == [("<1>", "moved", len(one)), ("<2>", "moved", 2 * len(one))]


def test_every_byte_of_a_warc_file_is_in_one_row():
    record = b"WARC/1.0\r\nWARC-Record-ID: <r>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    for data in (b"", b"WARC/", b"junk", record * 3, b"x" + record, record + b"WARC/1.0\r\n", record[:-2], record.replace(b": 5", b": 99"), record.replace(b": 5", b": ?"), record.replace(b"hello", b"hellos") * 2):
        for size in (1, 7, 1 << 16):
            rows = list(warc.parse_warc(data[i : i + size] for i in range(0, len(data), size)))
            assert [r[4] for r in rows] == [sum(r[5] for r in rows[:i]) for i in range(len(rows))] and sum(r[5] for r in rows) == len(data)
            assert [r[6] for r in rows] == [hashlib.sha256(data[r[4] : r[4] + r[5]]).hexdigest() for r in rows]
    zipped = gzip.compress(record) * 40
    assert b"".join(warc.inflated(pa.py_buffer(zipped), 50)) == record * 40
    assert b"".join(warc.inflated(pa.py_buffer(zipped[:200] + b"\xff" * 30 + zipped[230:]), 50)).startswith(record)


# Fingerprints


def test_fingerprints(spark, docs, none):
    rows = fingerprint.fingerprint_documents(docs).collect()
    assert len(rows) == docs.count()
    ordered = sorted(((-1 if r[0] is None else r[0]), r[1] or "") for r in hard_rows())
    want = collections.Counter()
    for i, (d, t) in enumerate(ordered):
        nxt, half = ordered[(i + 1) % len(ordered)][1], len(t) // 2
        want[(d, len(t), hashlib.sha256((t[: len(t) - half] + nxt[:half]).encode()).hexdigest())] += 1
    assert collections.Counter((-1 if r.doc_id is None else r.doc_id, r.n_chars, r.edited_sha256) for r in rows) == want
    same = collections.defaultdict(set)
    for r in rows:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        same[r.fingerprint].add(r.doc_id)
    assert set(range(20, 50)) | {6} in [s & (set(range(20, 50)) | {6}) for s in same.values()]
    assert fingerprint.fingerprint_documents(none).count() == 0
    lone = fingerprint.fingerprint_documents(docs.where("doc_id = 11")).first()
    assert lone.near_next == 1.0
    rng = random.Random(2)
    a = prose(rng, 4000).split()
    t = spark.createDataFrame([(1, " ".join(a)), (2, " ".join(a[:2000]))], "doc_id long, text string")
    r = fingerprint.fingerprint_documents(t).orderBy("doc_id").collect()
    true = len(shingles(" ".join(a)) & shingles(" ".join(a[:2000]))) / len(shingles(" ".join(a)))
    assert r[0].near_next == pytest.approx(true, abs=0.05) and r[1].in_next == 1.0
    pair = fingerprint.with_sketch(fingerprint.with_sketch(spark.createDataFrame([(" ".join(a[:500]), " ".join(a[496:900]), " ".join(a[:900]))], "x string, y string, z string"), F.col("x"), "sx"), F.col("y"), "sy")
    pair = fingerprint.with_sketch(pair, F.col("z"), "sz").select(fingerprint.merge(F.col("sx"), F.col("sy")).alias("m"), "sz").first()
    assert pair.m == pair.sz


def test_likeness_of_short_texts(spark):
    rng = random.Random(4)
    pairs = [(a := prose(rng, 52).split(), a[:40] + prose(rng, 12).split()) for _ in range(200)]
    d = spark.createDataFrame([(i, " ".join(a), " ".join(b)) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    d = fingerprint.with_sketch(fingerprint.with_sketch(d, F.col("a"), "x"), F.col("b"), "y").select("i", fingerprint.likeness(F.col("x"), F.col("y")).alias("j")).collect()
    true = [len(shingles(" ".join(a)) & shingles(" ".join(b))) / len(shingles(" ".join(a)) | shingles(" ".join(b))) for a, b in pairs]
    assert sum(abs(r.j - true[r.i]) for r in d) / len(d) < 0.08


def test_next_over_many_ranges(spark):
    rng = random.Random(9)
    ids = sorted({*range(500), *(rng.randrange(1 << 40) for _ in range(500)), -5, 1 << 62})
    d = spark.createDataFrame([(i, f"t{i}") for i in ids], "key long, text string").withColumn("doc_id", F.col("key"))
    got = {r.key: r.next_text for r in fingerprint.with_next(d, rows=16).collect()}
    assert got == {a: f"t{b}" for a, b in zip(ids, ids[1:] + ids[:1], strict=True)}


# Sharding


def test_sharding(docs, none):
    for limit in (1, 500, 3000, 1 << 30):
        rows = sharding.extendible_shards(docs, limit=limit, most_bits=3).collect()
        assert len(rows) == docs.count()
        by = collections.defaultdict(list)
        for r in rows:
            by[r.shard].append(r)
        for name, rs in by.items():
            assert rs[0].shard_bytes == sum(r.bytes for r in rs) and rs[0].shard_docs == len(rs)
            assert rs[0].shard_bytes <= limit or len(rs) == 1
        names = sorted({n.split("/")[0] for n in by})
        assert all(not b.startswith(a) for a, b in zip(names, names[1:], strict=False))
    assert sharding.extendible_shards(none).count() == 0


# Near copies


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b) and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    best = {}
    for (i, _), l in zip(rows, label, strict=True):
        if i is not None:
            best[l] = min(i, best.get(l, i))
    return collections.Counter((i, len(s), best.get(l) if s else i) for (i, _), s, l in zip(rows, sets, label, strict=True))


def test_jaccard_join(spark, docs, none):
    got = jaccard.ngram_jaccard_join(docs)[1].collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components([(r[0], r[1]) for r in hard_rows()])
    assert jaccard.ngram_jaccard_join(none)[1].count() == 0
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None and 6 <= r.doc_id < 60 and r.doc_id not in (10, 11, 12)) == [6]


def test_one_of_each_with_null_and_repeated_identifiers(spark):
    rng = random.Random(8)
    a, b, c = (prose(rng, 60) for _ in range(3))
    near = lambda t: t + " end"
    rows = [(None, a, 1), (None, near(a), 2), (None, a, 3), (1, b, 4), (None, near(b), 5), (2, near(b), 6), (2, c, 7), (2, c, 8), (3, near(c), 9), (None, "", 10), (None, None, 11), (2, " ", 12), (7, "", 13), (2, c, 7)]
    kept = jaccard.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, n int").repartition(3))
    got = sorted(tuple(r) for r in kept.select("n", "doc_id").collect())
    # one row of each group (a: both identifiers null, either text; b: 1; c: 2), and those without words
    assert [x for x in got if x[0] > 3] == [(4, 1), (7, 2), (10, None), (11, None), (12, 2), (13, 7)] and len([x for x in got if x[0] <= 3]) == 1
    assert kept.columns == ["doc_id", "text", "n"]


@pytest.mark.parametrize("seed", range(3))
def test_jaccard_join_on_families(spark, seed):
    rng = random.Random(seed)
    rows, passage = [], prose(rng, 40)
    for _ in range(12):
        base = prose(rng, rng.randrange(3, 160)).split()
        for _ in range(rng.randrange(1, 30)):
            w = list(base)
            for _ in range(rng.randrange(0, 6)):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            rows.append((len(rows), " ".join(w) + (" " + passage if rng.random() < 0.2 else "")))
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = jaccard.ngram_jaccard_join(d, block=5, most_frequent=50)[1].collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows)


def test_signature_trees_lose_nothing():
    rng = np.random.default_rng(4)
    for words, copies in ((1, 5), (4, 5), (32, 5), (4, 1), (4, 40)):
        base = [np.unique(rng.integers(0, 1 << 63, rng.integers(5, 600), dtype=np.uint64)) for _ in range(20)]
        sets = [np.unique(np.where(rng.random(len(b)) < 0.05, rng.integers(0, 1 << 63, len(b), dtype=np.uint64), b)) for b in base for _ in range(copies)]
        n, sizes, bits = len(sets), [len(s) for s in sets], [jaccard.bitmap(s, words) for s in sets]
        true = {(i, j) for i in range(n) for j in range(i + 1, n) if jaccard.alike(sets[i], sets[j])}
        every, forest, few = (jaccard.Proposals(list(range(n)), most) for most in (1 << 62, 0, 1 << 62))
        every.search(np.array(sizes), bits)
        forest.search(np.array(sizes), bits)
        few.few(sizes, bits)
        ordered = {(min(p), max(p)) for p in every.found}
        assert true <= ordered == {(min(p), max(p)) for p in few.found} and not every.more
        # the forest connects what the pairs connect, with as few of them as can be
        assert {(min(p), max(p)) for p in forest.found} <= ordered and all(forest.root(i) == forest.root(j) for i, j in ordered)
        assert len(forest.found) == n - len({forest.root(i) for i in range(n)})


def test_most_links_come_from_tree_traversal(spark, monkeypatch):
    """The traversal alone proposes the pairs that are compared: at most one for each set before components are known."""
    rng, sizes = random.Random(11), []
    rows = [(100 * f + c, " ".join(w if rng.random() > 0.004 else rng.choice(WORDS) for w in base)) for f in range(6) for base in [prose(rng, 120).split()] for c in range(40)]
    whole = jaccard.verified
    monkeypatch.setattr(jaccard, "verified", lambda pairs, texts, k: (sizes.append(pairs.count()), whole(pairs, texts, k))[1])
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    links, member = jaccard.ngram_jaccard_join(d)
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in member.collect()) == brute_components(rows)
    need = member.select("key").distinct().count() - member.select("component_id").distinct().count()
    assert sizes[0] <= len(rows) and sum(sizes) < 2 * len(rows) and 50 < need <= links.count()


def test_jaccard_join_in_salted_and_cut_trees(spark):
    rng = random.Random(5)
    base = prose(rng, 80).split()
    rows = [(i, " ".join(w if rng.random() > rate else rng.choice(WORDS) for w in base)) for rate in (0.0, 0.01, 0.05, 0.1) for i in range(int(rate * 1000), int(rate * 1000) + 40)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for options in ({"block": 6, "rounds": (1, 3, 1 << 62)}, {"hot_rows": 5, "block": 4, "rounds": (1, 1 << 62)}):
        got = jaccard.ngram_jaccard_join(d, **options)[1].collect()
        assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows)


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 200), (200, 150), (7, 7)], "a long, b long")
    got = {r.v: r.c for r in components(links).collect()}
    assert got == {i: 0 for i in range(51)} | {100: 100, 150: 100, 200: 100}
    assert components(links.limit(0)).count() == 0
    more = spark.createDataFrame([(30, 150), (500, 400), (3, 4), (50, 600)], "a long, b long")
    whole = {r.v: r.c for r in components(links.unionByName(more)).collect()}
    assert {r.v: r.c for r in extended(components(links), more).collect()} == whole and whole[200] == 0 and whole[500] == 400


# Personal data

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(t):
    out = {k: [] for k in BASE}
    for k, p in BASE.items():
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            if k == "ip" and any(int(x) > 255 for x in m[0].split(".")) or k == "card" and not (16 <= len(d) <= 19 and luhn(d)) or k == "phone" and not 8 <= len(d) <= 15:
                continue
            out[k].append((m.start(), m.end()))
    return out


def pii_texts():
    rng = random.Random(8)
    parts = ["a.b@c.d", "a@b.c_d@e.f", "@x.y", "é🎉 q@w-e.r.t.", "1.2.3.4", "1.2.3.4.5.6.7.8", "999.1.1.1", "0001.2.3.255", "4337166598464399", "4337 1665 9846 4399", "4337-1665-9846-4398", "12  34", "4337166598464399 1", "+1 (988) 555-2485", "+12", "+1-2-3-4-5-6-7-8", "+999 999 999 999 999 9", " ", "\n", "x", "7", "-", ".", "@", "+", "( "]
    made = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 12))) for _ in range(400)]
    return [*made, "", None, "1 " * 30_000, "a." * 20_000 + "@" + "b." * 20_000 + "c", "9" * 50_000, "+" + "1 " * 9, "1.1.1.1 " * 2000]


def test_personal_data(spark, none):
    texts = pii_texts()
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)] + [(None, "a@b.c", 1, "x")], "doc_id long, text string, start int, base_email string").repartition(3)
    rows = pii.find_personal_data(d, rounds=4).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        t = "a@b.c" if r.doc_id is None else texts[r.doc_id] or ""
        want = base_spans(t)
        for k in pii.KINDS:
            assert [tuple(s) for s in r[f"base_{k}"]] == want[k], (k, t[:200])
            for a, b in r[f"more_{k}"]:
                assert 0 <= a < b <= len(t) and all(b <= x or y <= a for spans in want.values() for x, y in spans)
    assert pii.find_personal_data(none).count() == 0
    one = spark.createDataFrame([("mail a@b.c now",)], "t string")
    assert one.select(pii.redact(F.col("t"), pii.base_spans(F.col("t"), "email"))).first()[0] == "mail [redacted] now"


def test_personal_data_in_other_forms_is_added(spark):
    card = "4539 1488 0343 6467"
    rows = []
    for i in range(400):
        rows += [
            f"please write to ann{i}@firm{i % 7}.example.com or call +1 555 {100 + i % 800} {1000 + i} today", f"pay by card {card} from host 10.0.{i % 200}.{i % 250} now", f"order {7000000000 + 7919 * i} of 20{i % 30:02d}-0{1 + i % 9}-1{i % 9} was {i}.{10000000 + i} long",
            f"serial {4000000000000000 + 7 * i} and 1 2 3 4 5 6 7 8 9 at 300.{i}.1.999", f"sizes {i} . {i + 1} . {i + 2} . 900 and meet @ {i} . then we",
        ]
    plain = len(rows)
    more = {"phone": ["call (555) 123-4567 now", "tel 555-123-4567"], "email": ["mail to bob [at] corp [dot] org please"], "card": ["card 4539.1488.0343.6467 is mine"], "ip": ["server 10[.]1[.]2[.]3 is down"]}
    hits = {"phone": ["(555) 123-4567", "555-123-4567"], "email": ["bob [at] corp [dot] org"], "card": ["4539.1488.0343.6467"], "ip": ["10[.]1[.]2[.]3"]}
    rows += [t for k in more for t in more[k]]
    got = {r.doc_id: r for r in pii.find_personal_data(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    added = {rows[i][a:b] for i, r in got.items() if i >= plain for k in pii.KINDS for a, b in r[f"more_{k}"]}
    assert added == {h for k in hits for h in hits[k]}
    for i, k in enumerate([k for k in more for _ in more[k]], plain):
        assert len(got[i][f"more_{k}"]) == 1
    assert [(rows[i], k) for i, r in got.items() if i < plain for k in pii.KINDS if r[f"more_{k}"]] == []


def test_personal_data_in_linear_time(spark, none):
    """Thousands of spans in one text: places, what they overlap, and the redacted text."""
    n = 6000
    text = " ".join(f"user{i}@mail{i % 7}.org é" if i % 3 else f"+1 (555) 010-{i:04d}" for i in range(n))
    started = time.time()
    row = pii.find_personal_data(spark.createDataFrame([(1, text), (2, "")], "doc_id long, text string")).where("doc_id = 1").first()
    assert [(s.start, s.end) for s in row.base_email] == [m.span() for m in re.finditer(r"user[0-9]+@mail[0-9]\.org", text)]
    assert len(row.base_phone) == n / 3 and time.time() - started < 120
    spans = sorted([(s.start, s.end) for k in ("email", "phone") for s in row[f"base_{k}"]])
    d = spark.createDataFrame([(text, spans), ("", []), ("héllo", []), ("abc", [(0, 3)])], "text string, spans array<struct<start:int,end:int>>")
    got = [r[0] for r in d.select(pii.redact(F.col("text"), F.col("spans"), "#", piece=50)).collect()]
    want, at = [], 0
    for a, b in spans:
        want, at = [*want, text[at:a], "#"], b
    assert got == ["".join(want) + text[at:], "", "héllo", "#"]


def test_overlapping(spark):
    rng = random.Random(3)
    span = lambda: (lambda a: (a, a + rng.randrange(1, 6)))(rng.randrange(300))
    rows = [([span() for _ in range(rng.randrange(150))], [span() for _ in range(rng.randrange(40))]) for _ in range(6)]
    d = spark.createDataFrame(rows, "x array<struct<start:int,end:int>>, y array<struct<start:int,end:int>>")
    got = [r[0] for r in d.select(pii.overlapping(F.col("x"), F.col("y"))).collect()]
    assert got == [[any(a < d and c < b for c, d in y) for a, b in x] for x, y in rows]


def test_boosting():
    rng = np.random.default_rng(1)
    x = rng.random((2000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    m = boosting.fit(x[:1500], y[:1500], ["a", "b", "c"], rounds=40)
    assert ((m.predict(x[1500:], ["a", "b", "c"]) > 0) == y[1500:]).mean() > 0.95
    assert boosting.fit(x, np.zeros(2000), ["a", "b", "c"]).trees == []
    assert boosting.precise_threshold(np.array([3.0, 2.0, 1.0]), np.array([1.0, 1.0, 0.0]), 0.99) == 2.0
    assert boosting.precise_threshold(np.array([1.0]), np.array([0.0]), 0.99) == float("inf")


def test_selector_is_fitted_on_all_candidates(spark):
    """More candidates than a driver's sample held: model and thresholds are those of all of them."""
    n = 30_000
    f = {x: F.lit(0.0) for x in pii.FEATURES} | {"kind": (F.col("id") % 4).cast("double"), "length": (F.xxhash64("id") % 50).cast("double"), "digits": (F.abs(F.xxhash64(F.col("id") + 1)) % 17).cast("double")}
    rule = (F.col("length") > 3) & (F.col("digits") < 9) & (F.xxhash64("id", F.lit(7)) % 50 != 0) | (F.col("kind") == 2) & (F.col("digits") > 14)
    c = spark.range(n).select("id", *[v.alias(k) for k, v in f.items()]).select("*", rule.alias("rule"))
    one = F.array(F.struct(F.col("id").cast("int").alias("start"), F.lit(0).alias("end"), "rule", *pii.FEATURES))
    none = F.filter(one, lambda x: F.lit(False))
    tables = c.select(*[(F.when(F.col("kind") == i, one).otherwise(none)).alias(f"try_{k}") for i, k in enumerate(pii.KINDS)], *[none.alias(f"like_{k}") for k in pii.KINDS], F.col("id").alias("text_hash"))
    rows = c.select("*", (F.pmod(F.xxhash64(*pii.FEATURES, F.col("id").cast("int"), "id"), F.lit(5)) == 0).alias("out")).toPandas()
    model, least = pii.fit_selector(tables, rounds=5, precision=0.9)
    x, y, out = rows[pii.FEATURES].to_numpy(float), rows["rule"].to_numpy(float), rows["out"].to_numpy(bool)
    want = boosting.fit(x[~out], y[~out], pii.FEATURES, rounds=5)
    flat = lambda t: [(t.feature, t.threshold, round(t.value, 6) if t.feature is None else 0)] + (flat(t.left) + flat(t.right) if t.feature else [])
    assert model.base == want.base and list(map(flat, model.trees)) == list(map(flat, want.trees)) and len(want.trees) == 5
    score = want.predict(x[out], pii.FEATURES)
    for i, k in enumerate(pii.KINDS):
        of = x[out][:, 0] == i
        assert least[k] == pytest.approx(max(0.0, boosting.precise_threshold(score[of], y[out][of], 0.9)), abs=1e-6)
    tree = boosting.Node(feature="x", threshold=1.0, left=boosting.Node(2.0), right=boosting.Node(feature="x", threshold=2.0, left=boosting.Node(1.0), right=boosting.Node(-1.0)))
    counts = spark.createDataFrame([(0.0, 0.0, 10, 10), (0.0, 1.5, 5, 4), (0.0, 1.6, 5, 5), (0.0, 3.0, 5, 0), (1.0, 0.0, 10, 5)], "kind double, x double, _n long, _positive long")
    assert boosting.count_thresholds(counts, boosting.Boosted(0.5, [tree]), "kind", 0.9) == {0.0: 1.5}


# Exact copies


def test_exact(spark, docs, none):
    for keep in ("max", "min"):
        for block in (1000, 3):
            rows = exact.content_sort_dedup(docs, keep=keep, block_rows=block, carry=docs.columns).collect()
            groups = collections.defaultdict(list)
            for r in hard_rows():
                groups[fold(r[1])].append(r[0])
            kept = collections.Counter()
            assert len(rows) == docs.count()
            for r in rows:
                ids = groups[fold(r.row.text)]
                known = [i for i in ids if i is not None]
                assert r.keep_id == ((max if keep == "max" else min)(known) if known else None) and r.group_size == len(ids)
                assert r.text_sha256 == hashlib.sha256(fold(r.row.text).encode()).hexdigest() and r.row["odd name.x"] == 9
                kept[r.text_sha256] += r.kept
                assert not r.kept or r.doc_id == r.keep_id
            assert set(kept.values()) == {1}
    assert exact.content_sort_dedup(none).count() == 0


# Chats


def test_chats(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "\\### Assistant: </turn> ok"), (1, 2, "user", None), (1, 3, "assistant", "a\\b<l>#h: é🎉\n"), (2, 5, None, "x"), (2, 5, None, "x"), (2, 1, "assist: ant", "y"), (None, 0, "assistant", ""), (3, None, "assistant", "z" * 50_000)]
    d = spark.createDataFrame([(*r, "m") for r in rows], "conv_id long, turn long, role string, text string, formatted string").repartition(3)
    got = {r.conv_id: r for r in chat.format_chats(d).select("conv_id", "formatted", chat.parse(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    assert set(got) == {1, 2, 3, None}
    for c, r in got.items():
        want = sorted(((-1 if t is None else t, role or "", text or "") for i, t, role, text in rows if i == c))
        assert [(t.role, t.text) for t in r.turns] == [(a, b) for _, a, b in want]
        assert r.loss == "".join(b for _, a, b in want if a == "assistant")
        assert r.formatted.count("</turn>") == len(want)
    assert chat.format_chats(d.limit(0)).count() == 0


def test_event_fold(spark):
    log = [("message", "user", "q", None), ("message", "assistant", "Hel", None), ("delta", "assistant", "lo", None), ("delta", None, "!", None), ("regenerate", "assistant", "Bye", None), ("delta", None, ".", None), ("edit", None, "Q?", 0), ("edit", None, "lost", 9), ("message", "user", "", None), ("edit", None, "thanks", None), ("delta", None, " a lot", None)]
    d = spark.createDataFrame([(1, i, *e) for i, e in enumerate(log)] + [(2, 0, "delta", None, "nothing open", None)], "conv_id long, turn long, op string, role string, text string, at long").repartition(3)
    got = chat.format_chats(d, op_col="op", target_col="at").select("conv_id", chat.parse(F.col("formatted")).alias("t")).collect()
    assert [(r.conv_id, [(t.role, t.text) for t in r.t]) for r in got] == [(1, [("user", "Q?"), ("assistant", "Bye."), ("user", "thanks a lot")])]
