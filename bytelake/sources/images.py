"""Images, pairs of images and deterministic mutations, from files or from columns of text."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bytelake.functions.bytes_sql import image
from bytelake.operators.rowwise import flat_map

SPLICE = bytes(range(40))


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(image_id, bytes, len) of the files below a path."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("image_id"), F.col("content").alias("bytes"), F.col("length").alias("len"))


def text_images(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(image_id long, bytes): a text column as UTF-8 images."""
    return df.select(F.col(id_col).cast("long").alias("image_id"), image(text_col).alias("bytes"))


def spread(scan: DataFrame) -> DataFrame:
    """A scan with at least as many partitions as there are cores, for kernels that cost more than a shuffle; large scans stay as they are."""
    n = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= n else scan.repartition(2 * n)


def consecutive_pairs(images: DataFrame) -> DataFrame:
    """(pair_id, old, new): each image with the one whose id is one less; an equi-join, so neither side is gathered."""
    old = images.select((F.col("image_id") + 1).alias("pair_id"), F.col("bytes").alias("old"))
    return old.join(images.select(F.col("image_id").alias("pair_id"), F.col("bytes").alias("new")), "pair_id")


def version_chains(df: DataFrame, key: str, order: str, text_col: str) -> DataFrame:
    """(chain, seq, old, new): each version with the one before in its chain."""
    by = Window.partitionBy(key).orderBy(order)
    rows = df.select(F.col(key).alias("chain"), F.col(order).cast("long").alias("seq"), image(F.lag(text_col).over(by)).alias("old"), F.lag(order).over(by).alias("before"), image(text_col).alias("new"))
    return rows.where("before IS NOT NULL").drop("before")


def mutate(kind: str, data: bytes, number: int) -> bytes:
    """small: byte i plus one where i % 97 = number % 97. base: of aligned words with an even first byte the last byte plus 32.
    reorder: lines by md5, then place. churn: the reversed image appended. insert: 40 bytes spliced in at half length. mix: reorder, then small."""
    import hashlib

    import numpy as np

    if kind == "mix":
        return mutate("small", mutate("reorder", data, number), number)
    if kind == "churn":
        return data + data[::-1]
    if kind == "insert":
        half = len(data) // 2
        return data[:half] + SPLICE + data[half:]
    if kind == "reorder":
        return b"\n".join(sorted(data.split(b"\n"), key=lambda line: hashlib.md5(line).hexdigest()))
    out = np.frombuffer(data, dtype=np.uint8).copy()
    if kind == "small":
        out[number % 97 :: 97] += 1
    elif kind == "base":
        words = out[: len(out) // 4 * 4].reshape(-1, 4)
        words[words[:, 0] % 2 == 0, 3] += 32
    else:
        raise ValueError(kind)
    return out.tobytes()


MUTATIONS = ("small", "base", "reorder", "churn", "insert", "mix")


def mutated_pairs(images: DataFrame, kinds: tuple[str, ...] = MUTATIONS) -> DataFrame:
    """(pair_id, kind, old, new): each image against each of its mutations."""

    def kernel(number: int, data: bytes) -> list[tuple]:
        return [(number, k, bytes(data), mutate(k, bytes(data), number)) for k in kinds]

    return flat_map(images.select("image_id", "bytes"), kernel, "pair_id long, kind string, old binary, new binary")


def paired_lines(old: bytes, new: bytes, split: bytes = b"\n", head: int = 12) -> list[tuple[int, int, int]]:
    """(n_off, o_off, size) of the parts between ``split``, as symbols by the name of their first bytes: of repeated old names the
    last by offset; the smaller size, more than 0."""

    def parts(data: bytes) -> list[tuple[bytes, int, int]]:
        out, at = [], 0
        for part in data.split(split):
            out.append((part[:head], at, len(part)))
            at += len(part) + len(split)
        return out

    last = {name: (off, size) for name, off, size in parts(old)}
    return [(off, last[name][0], min(size, last[name][1])) for name, off, size in parts(new) if name in last and min(size, last[name][1]) > 0]


def paired_paragraphs(old: bytes, new: bytes) -> list[tuple[int, int, int]]:
    """(n_off, o_off, size) of the parts between empty lines, as sections by their number; the smaller size, more than 0."""

    def parts(data: bytes) -> list[tuple[int, int]]:
        out, at = [], 0
        for part in data.split(b"\n\n"):
            out.append((at, len(part)))
            at += len(part) + 2
        return out

    return [(n, o, min(a, b)) for (n, a), (o, b) in zip(parts(new), parts(old), strict=False) if min(a, b) > 0]


def number_sites(data: bytes) -> list[tuple[int, str]]:
    """Places of four digits each, from the left, as sites of addresses."""
    return [(m.start(), "ptr") for m in re.finditer(rb"[0-9]{4}", data)]


def described(pairs: DataFrame) -> DataFrame:
    """(pair_id, kind, old, new) with metadata as an image's symbol file would give them: lines as symbols, paragraphs as
    sections, numbers as sites."""

    def kernel(old: bytes, new: bytes) -> list[tuple]:
        old, new = bytes(old), bytes(new)
        return [(old, new, paired_lines(old, new), paired_paragraphs(old, new), number_sites(old), number_sites(new))]

    region, site = "array<struct<n_off:long,o_off:long,size:long>>", "array<struct<at:long,kind:string>>"
    schema = f"pair_id long, kind string, old binary, new binary, symbols {region}, sections {region}, old_sites {site}, new_sites {site}"
    return flat_map(pairs, kernel, schema, keep=2, columns=["pair_id", "kind", "old", "new"])
