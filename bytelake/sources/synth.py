"""Synthetic code images with symbols, and scenarios of change between two of them. Everything follows from the seed by hashing."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from bytelake.operators.rowwise import flat_map

SCENARIOS = ("small", "base", "reorder", "churn", "mix")


def draw(*key: object) -> np.random.Generator:
    """A generator for a key; equal keys give equal numbers."""
    return np.random.default_rng(int.from_bytes(hashlib.sha256(repr(key).encode()).digest()[:8], "little"))


@dataclass(frozen=True)
class Layout:
    arch: str = "thumb"
    base: int = 0x08000000
    functions: int = 64
    least: int = 256
    most: int = 2048
    pointer_stride: int = 16
    branch_stride: int = 8
    seed: int = 1


@dataclass(frozen=True)
class Symbol:
    name: str
    addr: int
    size: int


def body(x: Layout, number: int, size: int) -> bytearray:
    """A function of plain words with branches and addresses at their strides."""
    rng = draw(x.seed, "body", number)
    word = 2 if x.arch == "thumb" else 4
    out = bytearray(rng.integers(0, 256, size // word * word, dtype=np.uint8).tobytes())
    for k in range(0, len(out) - 3, 4):
        if k // 4 % x.pointer_stride == x.pointer_stride - 1:
            out[k : k + 4] = (x.base + int(rng.integers(0, 1 << 16)) * 4).to_bytes(4, "little")
        elif k // 4 % x.branch_stride == 0:
            out[k : k + word] = (0xE000 | int(rng.integers(0, 0x800))).to_bytes(2, "little") if word == 2 else (0xEA000000 | int(rng.integers(0, 1 << 24))).to_bytes(4, "little")
    return out


def build(x: Layout, order: list[int] | None = None, sizes: list[int] | None = None, padding: int = 0) -> tuple[bytes, list[Symbol]]:
    """(image, symbols): functions in the order given, each with padding of up to ``padding`` bytes after it."""
    rng = draw(x.seed, "sizes")
    sizes = sizes or [int(s) // 4 * 4 for s in rng.integers(x.least, x.most + 1, x.functions)]
    image, symbols = bytearray(256), []
    for f in order or range(len(sizes)):
        symbols.append(Symbol(f"func_{f:04d}", x.base + len(image), sizes[f]))
        image += body(x, f, sizes[f])
        image += bytes(int(draw(x.seed, "pad", f).integers(0, padding + 1)) // 4 * 4) if padding else b""
    return bytes(image), symbols


def scenario(name: str, x: Layout = Layout(), base_delta: int = 0x2000) -> tuple[bytes, list[Symbol], bytes, list[Symbol]]:
    """(old, its symbols, new, its symbols). small: 1 % of bytes changed. base: the addresses moved. reorder: functions shuffled, padded.
    churn: a tenth more functions. mix: moved, sizes changed by up to 16 bytes, shuffled, 1 % changed."""
    old, symbols = build(x)
    rng = draw(x.seed, name)
    order = rng.permutation(x.functions).tolist()
    moved = Layout(x.arch, x.base + base_delta, x.functions, x.least, x.most, x.pointer_stride, x.branch_stride, x.seed)
    if name == "small":
        new, after = old, symbols
    elif name == "base":
        new, after = build(moved)
    elif name == "reorder":
        new, after = build(x, order, padding=8)
    elif name == "churn":
        more = x.functions + max(1, x.functions // 10)
        new, after = build(Layout(x.arch, x.base, more, x.least, x.most, x.pointer_stride, x.branch_stride, x.seed), sizes=[s.size for s in symbols] + [int(s) // 4 * 4 for s in rng.integers(x.least, x.most + 1, more - x.functions)])
    elif name == "mix":
        new, after = build(moved, order, [max(16, s.size + int(d) // 4 * 4) for s, d in zip(symbols, rng.integers(-16, 17, x.functions), strict=True)])
    else:
        raise ValueError(name)
    if name in ("small", "mix"):
        changed = np.frombuffer(new, dtype=np.uint8).copy()
        hit = rng.random(len(changed)) < 0.01
        changed[hit] ^= rng.integers(1, 256, int(hit.sum())).astype(np.uint8)
        new = changed.tobytes()
    return old, symbols, new, after


def scenario_table(spark: SparkSession, seeds: int = 4, names: tuple[str, ...] = SCENARIOS) -> DataFrame:
    """(pair_id, scenario, old, new, old_symbols, new_symbols) for each seed; images are made on the executors."""
    symbols = "array<struct<name:string,addr:bigint,size:bigint>>"

    def kernel(seed: int) -> list[tuple]:
        made = [(n, scenario(n, Layout(functions=16, seed=seed))) for n in names]
        rows = lambda ss: [{"name": s.name, "addr": s.addr, "size": s.size} for s in ss]
        return [(seed, n, o, w, rows(a), rows(b)) for n, (o, a, w, b) in made]

    return flat_map(spark.range(seeds).select("id"), kernel, f"pair_id long, scenario string, old binary, new binary, old_symbols {symbols}, new_symbols {symbols}")
