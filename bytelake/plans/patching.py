"""From pairs of images to patches and back: the plans of one pair, and the DataFrames that run them for all pairs.

A pair is the unit of parallelism. Everything after the pairs' join is narrow: matching, selection, encoding and
verification of a pair happen in one pass over its row.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytelake.functions import codec
from bytelake.functions.codec import ADD, COPY, PATCH, Instruction, PatchError
from bytelake.functions.kernels import (
    Match,
    best_cover,
    change_runs,
    chunk_matches,
    coverage,
    ends_in_common,
    gated_changes,
    global_matches,
    local_matches,
    masked,
    merged_regions,
    pointer_words,
    refined,
    reloc_changes,
    reloc_regions,
    runs,
    trimmed,
    uleb_size,
)
from bytelake.operators.rowwise import fields, flat_map
from bytelake.operators.similarity import breakdown, density_threshold


@dataclass(frozen=True)
class Profile:
    """Settings of a plan. fast() looks at less. least_similarity drops symbol regions below it; sections are filled in for
    images of less than sections_below bytes."""

    least: int = 16
    block: int = 48
    step: int = 16
    least_run: int = 32
    skip_local: float | None = None
    small_gap: int = 256
    copy_margin: int = 2
    fast_path: float = 0.02
    flash_base: int = 0x08000000
    endian: str = "le"
    chunked: bool = False
    least_similarity: float = 0.0
    sections_below: int = 200_000

    @classmethod
    def fast(cls) -> Profile:
        return cls(skip_local=0.90, block=48, step=8, least_run=24)


def candidates(old: bytes, new: bytes, p: Profile, starts: np.ndarray | None = None) -> list[Match]:
    """The best cover by global matches and, unless those cover enough, local ones and, if asked for, content-defined chunks."""
    found = global_matches(old, new, p.least)
    if p.skip_local is None or coverage(found, len(new)) < p.skip_local * len(new):
        found = found + local_matches(old, new, least=p.least_run, block=p.block, step=p.step)
    if p.chunked:
        found = found + chunk_matches(old, new)
    return best_cover(found, starts)


def fill_gap(old: bytes, new: bytes, a: int, b: int, found: list[Match], p: Profile) -> list[Instruction]:
    """Instructions for new[a:b] outside regions: a patch of addresses at the same offset, literals if small, else the clipped
    matches that save enough and literals between."""
    piece = new[a:b]
    lo, hi = p.flash_base, p.flash_base + max(len(old), len(new))
    if len(piece) >= 48 and b <= len(old) and len(pointer_words(piece[:256], lo, hi, p.endian, ram=None)) >= 2:
        changes = reloc_changes(old[a:b], piece, lo, hi, p.endian)
        if changes is not None:
            return codec.best_encoding(a, old, piece, changes)
    if len(piece) <= p.small_gap:
        return codec.literals(piece)
    clipped = [Match(max(m.new, a), m.old + max(m.new, a) - m.new, min(m.new + m.length, b) - max(m.new, a)) for m in found if m.new < b and m.new + m.length > a]
    clipped = [m for m in clipped if m.length >= 8] or [Match(m.new + a, m.old, m.length) for m in local_matches(old, piece, least=p.least_run, block=p.block, step=p.step)]
    out, at = [], a
    for m in trimmed(clipped):
        if 1 + uleb_size(m.old) + uleb_size(m.length) + p.copy_margin <= 1 + uleb_size(m.length) + m.length:
            out += codec.literals(new[at : m.new]) + [Instruction(COPY, m.length, m.old)]
            at = m.new + m.length
    return out + codec.literals(new[at:b])


def emit(old: bytes, new: bytes, regions: list[tuple[Match, np.ndarray | None]], found: list[Match], p: Profile) -> list[Instruction]:
    """Regions in order of address, what lies between them as gaps; regions are cut where they overlap."""
    out, at = [], 0
    for m, changes in sorted(regions, key=lambda r: r[0]):
        if m.new < at or m.old + m.length > len(old) or m.new + m.length > len(new):
            continue
        out += fill_gap(old, new, at, m.new, found, p) + codec.best_encoding(m.old, old, new[m.new : m.new + m.length], changes)
        at = m.new + m.length
    return codec.peephole(out + fill_gap(old, new, at, len(new), found, p))


def plan_global(old: bytes, new: bytes, p: Profile = Profile(), sites: tuple[list, list] | None = None, starts: np.ndarray | None = None) -> list[Instruction]:
    """Matches on the images, or on their normalised views if there are sites; each is patched to the real bytes."""
    view = (masked(old, sites[0]), masked(new, sites[1])) if sites else (old, new)
    cover = candidates(*view, p, starts)
    regions = [(m, change_runs(old[m.old : m.old + m.length], new[m.new : m.new + m.length])) for m in cover]
    return emit(old, new, regions, cover, p)


def plan_whole(old: bytes, new: bytes, most_ratio: float = 0.02) -> list[Instruction] | None:
    """Common prefix and suffix, the middle patched in place, what it is longer by inserted; None if more than most_ratio changes."""
    a, b = ends_in_common(old, new)
    middle = min(len(old), len(new)) - a - b
    changes = change_runs(old[a : a + middle], new[a : a + middle])
    inserted = new[a + middle : len(new) - b]
    if (int((changes[:, 1] - changes[:, 0]).sum()) + len(inserted)) / max(1, len(new)) > most_ratio:
        return None
    out = [Instruction(COPY, a, 0)] if a else []
    if middle:
        edits = tuple((x, new[a + x : a + y]) for x, y in changes.tolist())
        out.append(Instruction(PATCH, middle, a, changes=edits) if edits else Instruction(COPY, middle, a))
    if inserted:
        out.append(Instruction(ADD, len(inserted), data=inserted))
    return codec.peephole(out + ([Instruction(COPY, b, len(old) - b)] if b else []))


def inside(regions: list[Match] | None, old: bytes, new: bytes) -> list[Match]:
    """Regions cut to both images; those with nothing left are dropped."""
    cut = [Match(r.new, r.old, min(r.length, len(new) - r.new, len(old) - r.old)) for r in regions or [] if r.new >= 0 and r.old >= 0]
    return [r for r in cut if r.length > 0]


def region_changes(a: bytes, b: bytes, lo: int, hi: int, p: Profile, reloc: bool = True) -> np.ndarray | None:
    """Changes of a symbol region, or None if they are too many: the more alike its sides, the denser they may be."""
    if not reloc:
        return gated_changes(a, b, 64, 0.5)
    alike = breakdown(a, b, lo, hi, endian=p.endian)[1]
    return None if alike < p.least_similarity else reloc_changes(a, b, lo, hi, p.endian, max(128, len(b) // 4), density_threshold(alike))


def plan_advanced(
    old: bytes, new: bytes, symbols: list[Match] | None = None, p: Profile = Profile(), sites: tuple[list, list] | None = None, reloc: bool = True, sections: list[Match] | None = None
) -> list[Instruction]:
    """The whole-image fast path; else symbol regions, merged and gated by how alike they are and how much of them changes, what
    sections hold beside them, runs of moved addresses, and refined matches in the gaps."""
    if (short := plan_whole(old, new, p.fast_path)) is not None:
        return short
    lo, hi = p.flash_base, p.flash_base + max(len(old), len(new))
    regions: list[tuple[Match, np.ndarray | None]] = []
    covered = np.zeros(len(new), dtype=bool)
    for m in trimmed(merged_regions(inside(symbols, old, new), old, new), least=1):
        changes = region_changes(old[m.old : m.old + m.length], new[m.new : m.new + m.length], lo, hi, p, reloc)
        if changes is not None:
            regions.append((m, changes))
            covered[m.new : m.new + m.length] = True
    for m in inside(sections, old, new) if reloc and len(new) < p.sections_below else []:
        for x, y in runs(~covered[m.new : m.new + m.length]).tolist():
            changes = reloc_changes(old[m.old + x : m.old + y], new[m.new + x : m.new + y], lo, hi, p.endian, max(128, (y - x) // 4), 0.5)
            if changes is not None:
                regions.append((Match(m.new + x, m.old + x, y - x), changes))
                covered[m.new + x : m.new + y] = True
    for at, size in reloc_regions(old, new, lo, hi, covered, p.endian) if reloc else []:
        regions.append((Match(at, at, size), change_runs(old[at : at + size], new[at : at + size])))
        covered[at : at + size] = True
    view = (masked(old, sites[0]), masked(new, sites[1])) if sites else (old, new)
    found = trimmed(refined(trimmed(global_matches(*view, p.least) + local_matches(*view, block=p.block, step=p.step)), old, new))
    return emit(old, new, regions, found, p)


def make_patch(
    old: bytes, new: bytes, mode: str = "global", p: Profile = Profile(), symbols: list[Match] | None = None, sections: list[Match] | None = None, sites: tuple[list, list] | None = None
) -> tuple[bytes, bool]:
    """(raw patch, verified): of a failed advanced plan the global one is made instead; what fails both is not verified."""
    plans = {"advanced": lambda: plan_advanced(old, new, symbols, p, sites, sections=sections), "global": lambda: plan_global(old, new, p, sites)}
    for name in dict.fromkeys((mode, "global")):
        raw = codec.encode(plans[name](), len(new))
        try:
            if codec.apply_patch(old, raw) == new:
                return raw, True
        except PatchError:
            pass
    return raw, False


def generate_patches(
    pairs: DataFrame, keys: list[str], mode: str = "global", profile: Profile = Profile(), old_col: str = "old", new_col: str = "new",
    symbols_col: str | None = None, sections_col: str | None = None, sites_cols: tuple[str, str] | None = None,
) -> DataFrame:
    """Adds (patch, compressed, raw_len, patch_len, target_len, ok) to the keys of pairs; ok: applying it gives new, byte for byte.

    symbols_col, sections_col: arrays of (n_off, o_off, size), paired regions. sites_cols: arrays of (at, kind) of either
    image, sites to normalise if neither is null. Null is none.
    """
    extra = [c for c in (symbols_col, sections_col, *(sites_cols or ())) if c]

    def kernel(old: bytes, new: bytes, *more: list | None) -> list[tuple]:
        given = dict(zip(extra, more, strict=True))
        paired = lambda c: [Match(*fields(r)) for r in given.get(c) or []]
        sites = tuple([fields(r) for r in given[c]] for c in sites_cols) if sites_cols and all(given[c] is not None for c in sites_cols) else None
        raw, ok = make_patch(bytes(old), bytes(new), mode, profile, paired(symbols_col), paired(sections_col), sites)
        small = codec.compress(raw)
        return [(small, True, len(raw), len(small), len(new), ok)]

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.select(*keys).schema)
    return flat_map(pairs, kernel, f"{schema}, patch binary, compressed boolean, raw_len long, patch_len long, target_len long, ok boolean", keep=len(keys), columns=[*keys, old_col, new_col, *extra])


def apply_patches(patches: DataFrame, keys: list[str], old_col: str = "old", patch_col: str = "patch") -> DataFrame:
    """(keys, image, error): the rebuilt image, or why there is none."""

    def kernel(old: bytes, patch: bytes) -> list[tuple]:
        try:
            return [(codec.apply_patch(bytes(old), bytes(patch)), None)]
        except (PatchError, ValueError) as e:
            return [(None, str(e))]

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in patches.select(*keys).schema)
    return flat_map(patches.select(*keys, old_col, patch_col), kernel, f"{schema}, image binary, error string", keep=len(keys))


def instructions(patches: DataFrame, keys: list[str], patch_col: str = "patch") -> DataFrame:
    """One row for each instruction: (keys, seq, op, new_off, length, old_off, size, data_bytes, pieces, zeros); size is the encoded one,
    data_bytes what of it is content."""

    def kernel(patch: bytes) -> list[tuple]:
        out, at = [], 0
        for seq, (x, size) in enumerate(codec.decode(codec.inflated(bytes(patch)))):
            if seq:
                data = len(x.data) if x.op in (ADD, codec.DIFF) else sum(len(c) for _, c in x.changes)
                out.append((seq - 1, codec.NAMES[x.op], at, x.length, x.old, size, data, len(x.changes), x.data.count(0)))
                at += x.length
        return out

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in patches.select(*keys).schema)
    return flat_map(patches.select(*keys, patch_col), kernel, f"{schema}, seq long, op string, new_off long, length long, old_off long, size long, data_bytes long, pieces long, zeros long", keep=len(keys))


def composition(rows: DataFrame) -> DataFrame:
    """Per opcode: count, meta, data and all bytes, share of all bytes, least, mean and greatest region length and encoded size, share of zero
    bytes in differences, changed bytes by region bytes."""
    from pyspark.sql import Window

    g = rows.groupBy("op").agg(
        F.count("*").alias("n"), F.sum(F.col("size") - F.col("data_bytes")).alias("meta_bytes"), F.sum("data_bytes").alias("data_bytes"), F.sum("size").alias("total_bytes"),
        F.min("length").alias("min_length"), F.round(F.avg("length"), 6).alias("avg_length"), F.max("length").alias("max_length"), F.max("size").alias("max_size"),
        F.sum("length").alias("output_bytes"), F.sum("zeros").alias("zeros"),
    )
    share = F.round(100.0 * F.col("total_bytes") / F.sum("total_bytes").over(Window.partitionBy()), 6)
    density = F.when(F.col("output_bytes") > 0, F.round(F.col("data_bytes") / F.col("output_bytes"), 6))
    return g.withColumn("pct", share).withColumn("density", density)


def lengths(rows: DataFrame, k: int = 10) -> DataFrame:
    """(op, length, n, among_longest): how often each region length comes per opcode, and whether it is one of the k longest."""
    from pyspark.sql import Window

    g = rows.groupBy("op", "length").agg(F.count("*").alias("n"))
    longest = g.withColumn("rank", F.row_number().over(Window.partitionBy("op").orderBy(F.desc("length")))).where(F.col("rank") <= k)
    return g.join(F.broadcast(longest.select("op", "length", F.lit(True).alias("top"))), ["op", "length"], "left").select("op", "length", "n", F.coalesce("top", F.lit(False)).alias("among_longest"))


def resources(rows: DataFrame, keys: list[str], payload: int = 502, scale: float = 1.0) -> DataFrame:
    """Per patch: peak memory of a decoder (greatest block and literal, window, payload, overhead) and its time by assumed bandwidths,
    differences also with their own term."""
    of = lambda *ops: F.when(F.col("op").isin(*ops), F.col("length")).otherwise(0)
    g = rows.groupBy(*keys).agg(
        F.max(of("PATCH", "PATCH_COMPACT", "PATCH_DIFF", "COPY", "DIFF")).alias("max_block"), F.max(of("ADD", "FILL")).alias("max_literal"), F.max(of("PATCH", "PATCH_COMPACT", "PATCH_DIFF")).alias("max_patch"),
        F.sum(of("COPY")).alias("copied"), F.sum(of("ADD", "FILL")).alias("added"), F.sum(of("PATCH", "PATCH_COMPACT", "PATCH_DIFF")).alias("patched"), F.sum(of("DIFF")).alias("differed"),
    )
    return g.withColumns({
        "peak_bytes": F.greatest("max_block", "max_literal") + 4096, "sim_bytes": F.lit(32768 + payload) + F.col("max_patch"),
        "seconds": F.round((F.col("copied") / 4e6 + F.col("added") / 3e6 + F.col("patched") / 2e6) * scale, 9), "seconds_with_diff": F.round((F.col("copied") / 4e6 + F.col("added") / 3e6 + (F.col("patched") + F.col("differed")) / 2e6) * scale, 9),
    })


def frames(patches: DataFrame, keys: list[str], patch_col: str = "patch", payload: int = 502) -> DataFrame:
    """(keys, frame_no, payload, crc32): a patch in frames of at most ``payload`` bytes; an empty one has none."""
    n = F.ceil(F.octet_length(patch_col) / payload).cast("int")
    at = F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")))
    rows = patches.select(*keys, patch_col, at.alias("frame_no")).withColumn("payload", F.substring(F.col(patch_col), F.col("frame_no") * payload + 1, F.lit(payload)))
    return rows.select(*keys, "frame_no", "payload", F.crc32("payload").alias("crc32"))


def manifests(patches: DataFrame, keys: list[str], patch_col: str = "patch", payload: int = 502) -> DataFrame:
    """(keys, total_len, total_crc32, frame_payload_size, frames, frame_crc32)."""
    n = F.ceil(F.octet_length(patch_col) / payload).cast("int")
    crcs = F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.crc32(F.substring(F.col(patch_col), i * payload + 1, F.lit(payload))))
    return patches.select(*keys, F.octet_length(patch_col).cast("long").alias("total_len"), F.crc32(patch_col).alias("total_crc32"), F.lit(payload).alias("frame_payload_size"), n.alias("frames"), crcs.alias("frame_crc32"))
