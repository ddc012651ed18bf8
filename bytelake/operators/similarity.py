"""Similarity of two code images: shared grams, shared sites of branches and addresses, branch density."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame

from bytelake.functions.kernels import masked, pointer_words, words_of
from bytelake.operators.rowwise import flat_map


def halves(data: bytes, endian: str = "le") -> np.ndarray:
    return np.frombuffer(data, dtype="<u2" if endian == "le" else ">u2", count=len(data) // 2).astype(np.int64)


def thumb_branches(data: bytes, endian: str = "le") -> np.ndarray:
    """Offsets of half-words that are a 16-bit branch or begin a 32-bit one."""
    h = halves(data, endian)
    narrow = ((h & 0xF000) == 0xD000) & ((h & 0x0F00) != 0x0F00) | ((h & 0xF800) == 0xE000) | np.isin(h & 0xFF00, (0xB100, 0xB900))
    wide = np.isin(h & 0xF800, (0xF000, 0xF800))
    return 2 * np.flatnonzero(narrow | (wide & np.append(wide[1:], False)))


def arm_branches(data: bytes, endian: str = "le") -> np.ndarray:
    w = words_of(data, endian)
    return 4 * np.flatnonzero(((w >> 25) & 7 == 5) | np.isin(w & 0x0FFFFFF0, (0x012FFF10, 0x012FFF30)))


def gram_set(data: bytes, k: int, step: int) -> set[int]:
    return {zlib.crc32(data[i : i + k]) for i in range(0, len(data) - k + 1, step)}


def jaccard(a: set, b: set) -> float:
    """1 for two empty sets, 0 if one is empty."""
    return len(a & b) / len(a | b) if a and b else float(not a and not b)


def guess_mode(data: bytes, lo: int, hi: int, endian: str = "le") -> str:
    """'thumb' or 'arm': by a vector table, else by which branches are clearly more frequent in the first 4 KiB, else thumb."""
    head = data[:4096]
    w = words_of(head[:8], endian)
    if len(w) == 2 and 0x20000000 <= w[0] < 0x20080000 and w[1] % 2 == 1 and lo <= w[1] < hi:
        return "thumb"
    thumb, arm = len(thumb_branches(head, endian)) / max(1, len(head) // 2), len(arm_branches(head, endian)) / max(1, len(head) // 4)
    return "arm" if arm > 1.2 * thumb else "thumb"


#: Weights of shared grams, shared sites and like density of branches.
GRAMS, SITES, DENSITY = 0.60, 0.25, 0.15


def breakdown(old: bytes, new: bytes, lo: int, hi: int, mode: str = "auto", endian: str = "le") -> tuple[str, float, float, float, float]:
    """(mode, similarity, grams, sites, branch density), each 0 if a side is empty. Grams are those of the images with words that look
    like addresses set to zero. Mode 'raw' knows no branches."""
    mode = guess_mode(new, lo, hi, endian) if mode == "auto" else mode
    if not old or not new:
        return mode, 0.0, 0.0, 0.0, 0.0
    step, unit, find = {"thumb": (2, 2, thumb_branches), "arm": (4, 4, arm_branches)}.get(mode, (4, 1, lambda d, e: np.empty(0, dtype=np.int64)))
    sides = [(find(d, endian), pointer_words(d, lo, hi, endian)) for d in (old, new)]
    grams = jaccard(*(gram_set(masked(d, [(at, "ptr") for at in words.tolist()]), 16, step) for d, (_, words) in zip((old, new), sides, strict=True)))
    sites = jaccard(*({*branches.tolist(), *words.tolist()} for branches, words in sides))
    density = [len(branches) / max(1, len(d) // unit) for (branches, _), d in zip(sides, (old, new), strict=True)]
    alike = 1 - min(1.0, abs(density[0] - density[1]))
    return mode, GRAMS * grams + SITES * sites + DENSITY * alike, grams, sites, alike


def density_threshold(similarity: float) -> float:
    """Share of changed bytes that a region of that similarity may have and still be patched."""
    return 0.7 if similarity >= 0.85 else 0.6 if similarity >= 0.70 else 0.5


def similarities(pairs: DataFrame, key: str, lo: int, hi: int, mode: str = "auto", endian: str = "le") -> DataFrame:
    """(key, mode, sim, s_kgram, s_sites, s_bd) of pairs (key, old, new)."""

    def kernel(old: bytes, new: bytes) -> list[tuple]:
        return [tuple(round(x, 6) if isinstance(x, float) else x for x in breakdown(bytes(old), bytes(new), lo, hi, mode, endian))]

    return flat_map(pairs.select(key, "old", "new"), kernel, f"{key} long, mode string, sim double, s_kgram double, s_sites double, s_bd double", keep=1)
