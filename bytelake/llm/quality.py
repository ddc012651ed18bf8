"""Quality classifier: a byte-level convolutional network in numpy.

Learned filters pass over every byte of a document. Overlapping chunks keep the maximum of each filter, a hidden layer
reads each chunk, and mean and maximum over the chunks combine into one probability.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import as_strided
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from bytelake.llm.common import named, released

#: A chunk is 4 cells of 128 bytes and shares one with the next; filters look at 8 bytes, at every second byte.
CELL, CELLS, STEP, WIDTH, STRIDE = 128, 4, 3, 8, 2
CHUNK = CELL * CELLS
POSITIONS = CHUNK // STRIDE


@dataclass
class Network:
    """Parameters by name; all float32."""

    p: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, dims: int, filters: int, hidden: int, rng: np.random.Generator) -> Network:
        draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        zeros = lambda n: np.zeros(n, dtype=np.float32)
        return cls({
            "embed": draw(256, dims, scale=0.5), "filters": draw(WIDTH * dims, filters, scale=(WIDTH * dims) ** -0.5), "bias": zeros(filters),
            "hidden": draw(filters + 1, hidden, scale=(filters + 1) ** -0.5), "hidden_bias": zeros(hidden), "out": draw(2 * hidden, scale=(2 * hidden) ** -0.5), "out_bias": zeros(1),
        })

    def responses(self, data: np.ndarray, positions: int) -> np.ndarray:
        """Filter responses at byte 0, STRIDE, 2 * STRIDE, ... of data, which holds WIDTH bytes more."""
        x = np.ascontiguousarray(self.p["embed"][data])
        n = x.itemsize * x.shape[1]
        return as_strided(x, (positions, WIDTH * x.shape[1]), (STRIDE * n, x.itemsize)) @ self.p["filters"]

    def combine(self, pooled: np.ndarray, fill: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Probability of each document from its chunks' pooled responses; starts: each document's first chunk."""
        m = np.concatenate([np.maximum(pooled + self.p["bias"], 0), fill[:, None]], axis=1)
        h = np.maximum(m @ self.p["hidden"] + self.p["hidden_bias"], 0)
        d = np.concatenate([np.add.reduceat(h, starts) / counts[:, None], np.maximum.reduceat(h, starts)], axis=1)
        z = np.clip(d @ self.p["out"] + self.p["out_bias"], -30, 30)
        return 1 / (1 + np.exp(-z.astype(np.float64)))

    def score(self, texts: list[bytes], step: int = 1 << 15) -> np.ndarray:
        """Probability of label 1 of every whole text, each padded and with an empty cell after it, so no filter sees another text.

        Memory: the responses to ``step`` bytes at a time and one row a cell.
        """
        cells = np.array([(len(t) + WIDTH + CELL - 1) // CELL for t in texts], dtype=np.int64)
        first = np.concatenate([[0], np.cumsum(cells + 1)])
        data = np.zeros(int(first[-1]) * CELL + WIDTH, dtype=np.uint8)
        for at, t in zip(first.tolist(), texts, strict=False):
            data[at * CELL : at * CELL + len(t)] = np.frombuffer(t, dtype=np.uint8)
        most = np.empty((int(first[-1]), self.p["bias"].size), dtype=np.float32)
        many = max(1, step // CELL)
        for at in range(0, len(most), many):
            n = min(many, len(most) - at)
            r = self.responses(data[at * CELL : (at + n) * CELL + WIDTH], n * CELL // STRIDE)
            most[at : at + n] = r.reshape(n, CELL // STRIDE, -1).max(axis=1)
        counts = np.maximum(1, -(-(cells - 1) // STEP))
        starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
        doc = np.repeat(np.arange(len(texts)), counts)
        at = first[doc] + STEP * (np.arange(len(doc)) - starts[doc])
        pooled = most[at]
        for k in range(1, CELLS):
            np.maximum(pooled, most[np.minimum(at + k, first[doc + 1] - 2)], out=pooled)
        left = np.array([len(t) for t in texts])[doc] - CELL * (at - first[doc])
        return self.combine(pooled, (np.clip(left, 0, CHUNK) / CHUNK).astype(np.float32), starts, counts)


def training_chunks(text: bytes, most: int) -> list[tuple[bytes, int]]:
    """At most ``most`` of a text's chunks, evenly spread over all of it, each with the bytes its last filters see, padded."""
    cells = (len(text) + WIDTH + CELL - 1) // CELL
    count = max(1, -(-(cells - 1) // STEP))
    at = sorted({round(i * (count - 1) / max(1, most - 1)) for i in range(most)}) if count > most else range(count)
    return [(text[i * STEP * CELL : i * STEP * CELL + CHUNK + WIDTH].ljust(CHUNK + WIDTH, b"\0"), min(CHUNK, max(0, len(text) - i * STEP * CELL))) for i in at]


def train(samples: list[tuple[list[tuple[bytes, int]], int]], *, dims: int = 8, filters: int = 32, hidden: int = 24, epochs: int = 8, batch: int = 64, rate: float = 4e-3, seed: int = 7) -> Network:
    """Fit by Adam on logistic loss. samples: (chunks, label 0 or 1). With labels of one kind, or none, the score is constant."""
    rng = np.random.default_rng(seed)
    net = Network.fresh(dims, filters, hidden, rng)
    share = float(np.mean([y for _, y in samples])) if samples else 0.5
    if share in (0.0, 1.0) or not samples:
        net.p["out"][:] = 0
        net.p["out_bias"][:] = np.log((share + 1e-3) / (1 - share + 1e-3))
        return net
    net.p["out_bias"][:] = np.log(share / (1 - share))
    first, second, t = {k: np.zeros_like(v) for k, v in net.p.items()}, {k: np.zeros_like(v) for k, v in net.p.items()}, 0
    for epoch in range(epochs):
        order = rng.permutation(len(samples))
        for a in range(0, len(order), batch):
            part = [samples[i] for i in order[a : a + batch]]
            g, t = gradients(net.p, part), t + 1
            step = rate * 0.5 * (1 + np.cos(np.pi * (epoch + a / len(order)) / epochs)) + 1e-5
            for k, v in g.items():
                first[k] = 0.9 * first[k] + 0.1 * v
                second[k] = 0.999 * second[k] + 0.001 * v * v
                net.p[k] -= (step * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return net


def gradients(p: dict[str, np.ndarray], part: list[tuple[list[tuple[bytes, int]], int]]) -> dict[str, np.ndarray]:
    counts = np.array([len(c) for c, _ in part])
    starts, doc = np.concatenate([[0], np.cumsum(counts)[:-1]]), np.repeat(np.arange(len(part)), counts)
    data = np.frombuffer(b"".join(b for c, _ in part for b, _ in c), dtype=np.uint8).reshape(len(doc), CHUNK + WIDTH)
    fill, y = np.array([n / CHUNK for c, _ in part for _, n in c], dtype=np.float32), np.array([y for _, y in part], dtype=np.float32)
    dims, nf = p["embed"].shape[1], p["bias"].size
    x = np.ascontiguousarray(p["embed"][data])
    s = x.strides
    win = as_strided(x, (len(doc), POSITIONS, WIDTH * dims), (s[0], STRIDE * s[1], s[2]))
    r = np.matmul(win, p["filters"])
    best = r.argmax(axis=1)
    pooled = np.take_along_axis(r, best[:, None, :], axis=1)[:, 0] + p["bias"]
    m = np.concatenate([np.maximum(pooled, 0), fill[:, None]], axis=1)
    h = np.maximum(m @ p["hidden"] + p["hidden_bias"], 0)
    mean, top = np.add.reduceat(h, starts) / counts[:, None], np.maximum.reduceat(h, starts)
    d = np.concatenate([mean, top], axis=1)
    dz = (1 / (1 + np.exp(-np.clip(d @ p["out"] + p["out_bias"], -30, 30))) - y) / len(part)
    dd, nh = dz[:, None] * p["out"][None, :], h.shape[1]
    at_top = h == top[doc]
    ties = np.add.reduceat(at_top.astype(np.float32), starts)
    dh = ((dd[:, :nh] / counts[:, None])[doc] + at_top * (dd[:, nh:] / ties)[doc]) * (h > 0)
    dm = (dh @ p["hidden"].T)[:, :nf] * (pooled > 0)
    chosen = win[np.arange(len(doc))[:, None], best]  # chunk, filter, WIDTH * dims
    dx = (dm[:, :, None] * p["filters"].T[None]).reshape(-1, dims)
    ids = data[np.arange(len(doc))[:, None, None], STRIDE * best[:, :, None] + np.arange(WIDTH)].ravel()
    embed = np.stack([np.bincount(ids, weights=dx[:, j], minlength=256) for j in range(dims)], axis=1).astype(np.float32)
    return {
        "embed": embed, "filters": np.einsum("nfk,nf->kf", chosen, dm), "bias": dm.sum(axis=0), "hidden": m.T @ dh, "hidden_bias": dh.sum(axis=0),
        "out": d.T @ dz, "out_bias": dz.sum(keepdims=True),
    }


def held_out(doc_id: F.Column) -> F.Column:
    """Rows that are never learned from: crc32 of the identifier as text leaves 2 when divided by 4. Null: not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most_rows: int = 3000, most_chunks: int = 12, **training) -> Network:
    """Train on a bounded sample: of each label the most_rows identifiers that come first by hash, most_chunks chunks each.

    Held-out rows, null labels and null identifiers are left out; of repeated label rows the smaller label counts. The
    two classes are sampled alike, and the output bias takes back what that does to the share of label 1.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & ~held_out(F.col(id_col))).groupBy(F.col(id_col).alias("i")).agg(F.min(label_col).cast("int").alias("y"))
    sizes = dict(map(tuple, known.groupBy("y").count().collect()))
    # Twice as many as needed pass by hash, so tasks together send the driver no more, however many they are.
    share = lambda y: min(1.0, 2 * most_rows / max(1, sizes.get(y, 0)))
    picked = [known.where((F.col("y") == y) & (F.pmod(F.xxhash64("i", F.lit(1)), F.lit(1 << 32)) < int(share(y) * (1 << 32)))).orderBy(F.xxhash64("i"), "i").limit(most_rows) for y in (0, 1)]
    sample = F.broadcast(picked[0].unionByName(picked[1]))  # at most 2 * most_rows rows

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            chunks = [training_chunks((t or "").encode(), most_chunks) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([b"".join(c for c, _ in x) for x in chunks], type=pa.binary()), pa.array([[n for _, n in x] for x in chunks], type=pa.list_(pa.int32()))], names=["i", "y", "chunks", "sizes"])

    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("text")).join(sample, "i").select("i", "y", "text").mapInArrow(cut, "i long, y int, chunks binary, sizes array<int>").collect()
    one = {}
    for r in sorted(rows, key=lambda r: (r["i"], r["y"], bytes(r["chunks"]))):
        one.setdefault(r["i"], r)
    whole = CHUNK + WIDTH
    samples = [([(bytes(r["chunks"][k * whole : (k + 1) * whole]), n) for k, n in enumerate(r["sizes"])], r["y"]) for r in one.values()]
    net = train(samples, **training)
    used = [sum(y == v for _, y in samples) for v in (0, 1)]
    if min(used) and all(sizes.get(v) for v in (0, 1)):
        net.p["out_bias"] += np.float32(np.log((sizes[1] / sizes[0]) / (used[1] / used[0])))
    return net


def score_quality(docs: DataFrame, net: Network, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7, carry: list[str] | None = None) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row by its whole text, with ``carry`` a struct ``row`` of those columns.

    Narrow: no shuffle, nothing but the text is looked at. Null texts are empty; an empty text has the score of a
    chunk of padding; null or repeated identifiers make no difference; an empty table gives no rows. A text that is
    carried goes to the worker once, inside ``row``, and rows come back in batches of about 1 MB of text.
    """
    p, kept = net.p, carry or []
    inside = kept.index(text_col) if text_col in kept else None

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Network(p)
        for b in batches:
            at, size = 0, 0
            group: list[bytes] = []
            for t in b.column(1) if inside is None else b.column(1).field(inside):
                group.append((t.as_py() or "").encode())
                size += len(group[-1]) + CELL
                if size > 1 << 20 or at + len(group) == b.num_rows:
                    part = b.slice(at, len(group))
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.score(group), type=pa.float64()), *[part.column(b.num_columns - 1)] * bool(kept)], names=["doc_id", "score", *["row"] * bool(kept)])
                    at, size, group = at + len(group), 0, []

    row = F.struct(*[named(c) for c in kept]).alias("row")
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), *[F.col(text_col).alias("text")] * (inside is None), *[row] * bool(kept))
    schema = StructType([StructField("doc_id", LongType()), StructField("score", DoubleType()), *([given.schema["row"]] if kept else [])])
    out = given.mapInArrow(released(score), schema)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *["row"] * bool(kept))


def crc_mod(doc_id: int) -> int:
    """What held_out() compares with 2, for tests."""
    return zlib.crc32(str(doc_id).encode()) % 4
