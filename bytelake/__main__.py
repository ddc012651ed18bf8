"""Command line for single images: gen, apply, sim, repeats, analyze, synth."""

from __future__ import annotations

import argparse
import json
import sys
import zlib
from collections import Counter
from pathlib import Path

from bytelake.functions import codec, kernels
from bytelake.plans import patching


def pairs_of(old: str, new: str, base: int) -> list[kernels.Match]:
    from bytelake.sources.symbols import flat_symbols

    def places(path: str) -> dict[str, tuple[int, int]]:
        return {n: (addr - base if addr is not None and base else file_offset if file_offset is not None else off if off is not None else -1, size) for n, addr, file_offset, off, size, _ in flat_symbols(Path(path).read_text())}

    a, b = places(old), places(new)
    return [kernels.Match(b[n][0], a[n][0], min(a[n][1], b[n][1])) for n in sorted(a.keys() & b.keys()) if a[n][0] >= 0 and b[n][0] >= 0 and min(a[n][1], b[n][1]) > 0]


def gen(a: argparse.Namespace) -> int:
    old, new = Path(a.old).read_bytes(), Path(a.new).read_bytes()
    base = int(a.flash_base, 0)
    profile = patching.Profile.fast() if a.speed_profile == "fast" else patching.Profile()
    profile = patching.Profile(**{**profile.__dict__, "flash_base": base, "endian": a.endian, "chunked": a.cdc})
    found = pairs_of(a.old_sym, a.new_sym, base) if a.old_sym and a.new_sym else []
    raw, ok = patching.make_patch(old, new, a.mode, profile, found)
    patch = codec.compress(raw)
    Path(a.out).write_bytes(patch)
    if a.frames:
        folder = Path(a.frames)
        folder.mkdir(parents=True, exist_ok=True)
        parts = [patch[i : i + a.frame_size] for i in range(0, len(patch), a.frame_size)]
        for i, p in enumerate(parts):
            (folder / f"frame_{i:05d}.bin").write_bytes(p)
        (folder / "manifest.json").write_text(json.dumps({"total_len": len(patch), "total_crc32": zlib.crc32(patch), "frame_payload_size": a.frame_size, "frames": len(parts), "frame_crc32": [zlib.crc32(p) for p in parts]}, indent=2))
    print(json.dumps({"old": len(old), "new": len(new), "raw": len(raw), "patch": len(patch), "verified": ok}))
    return 0 if ok else 2


def apply(a: argparse.Namespace) -> int:
    image = codec.apply_patch(Path(a.old).read_bytes(), Path(a.patch).read_bytes())
    if a.out:
        Path(a.out).write_bytes(image)
    at = codec.first_difference(image, Path(a.expect).read_bytes()) if a.expect else None
    print("OK" if at is None else f"differs at {at}")
    return 0 if at is None else 1


def analyze(a: argparse.Namespace) -> int:
    raw = codec.inflated(Path(a.patch).read_bytes())
    (target, _), *rows = codec.decode(raw)
    count, size, longest = Counter(), Counter(), Counter()
    for x, n in rows:
        name = codec.NAMES[x.op]
        count[name] += 1
        size[name] += n
        longest[name] = max(longest[name], x.length)
    print(json.dumps({"target": target, "raw": len(raw), "ops": {k: {"count": count[k], "bytes": size[k], "longest": longest[k]} for k in count}}))
    return 0


def sim(a: argparse.Namespace) -> int:
    old, patch = Path(a.old).read_bytes(), Path(a.patch).read_bytes()
    raw = codec.inflated(patch)
    block = max((x.length for x, _ in list(codec.decode(raw))[1:] if x.op in (codec.PATCH, codec.PATCH_COMPACT, codec.PATCH_DIFF)), default=0)
    image = codec.apply_patch(old, patch)
    same = image == Path(a.new).read_bytes() if a.new else None
    print(json.dumps({"ram": (32768 if raw != patch else 0) + a.payload + block, "output": len(image), "match": same}))
    return 0 if same in (True, None) else 1


def repeats(a: argparse.Namespace) -> int:
    old, new = Path(a.old).read_bytes(), Path(a.new).read_bytes()
    for b in map(int, a.block_sizes.split(",")):
        groups, extra, covered = kernels.new_repeats(old, new, b, a.step)
        print(json.dumps({"block": b, "groups": groups, "extra": extra, "bytes_covered": covered}))
    return 0


def synth(a: argparse.Namespace) -> int:
    from bytelake.sources.synth import Layout, scenario

    old, s, new, t = scenario(a.scenario, Layout(arch=a.arch, functions=a.funcs, seed=a.seed))
    folder = Path(a.out)
    folder.mkdir(parents=True, exist_ok=True)
    for name, image, symbols in (("old", old, s), ("new", new, t)):
        (folder / f"{name}.bin").write_bytes(image)
        (folder / f"{name}.json").write_text(json.dumps({"symbols": [x.__dict__ for x in symbols]}, indent=2))
    return 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="bytelake", description=__doc__)
    sub = p.add_subparsers(required=True)

    def command(f, *required: str, **options) -> None:
        c = sub.add_parser(f.__name__)
        c.set_defaults(run=f)
        for name in required:
            c.add_argument(f"--{name}", required=True)
        for name, default in options.items():
            kind = {"action": "store_true"} if default is False else {"default": default, "type": type(default) if default is not None else str}
            c.add_argument(f"--{name.replace('_', '-')}", **kind)

    command(gen, "old", "new", "out", old_sym=None, new_sym=None, flash_base="0x08000000", frames=None, frame_size=502, cdc=False, endian="le", mode="global", speed_profile="balanced")
    command(apply, "old", "patch", out=None, expect=None)
    command(sim, "old", "patch", new=None, payload=502)
    command(repeats, "old", "new", block_sizes="16,32,64", step=4)
    command(analyze, "patch")
    command(synth, "out", scenario="small", arch="thumb", funcs=64, seed=1)
    return p


if __name__ == "__main__":
    args = parser().parse_args()
    sys.exit(args.run(args))
