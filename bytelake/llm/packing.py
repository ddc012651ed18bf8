"""Packing token sequences into windows by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import heapq
import json
import re
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytelake.llm.common import materialize, released

#: How byte-level BPE splits a text before merging, and the one special string of the vocabulary.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPECIAL = "<|endoftext|>"
#: Texts with other characters go to the tokenizer whole, lest Unicode versions differ.
UNUSUAL = re.compile("[^\t-\r -~¡-ɏ‐-‧‰-⁞€]")
MARKS = frozenset(".,;:!?")
RUN = re.compile(r"\s ")

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long"


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary: itself, or the next one from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in own)}


class Encoder(dict):
    """Ids of a text, as little-endian unsigned 32-bit bytes.

    As every space that follows no white space starts a split, a text without such runs is looked up chunk by chunk
    between spaces. What was met before is remembered in two generations of at most ``most`` chunks; the older goes
    when the younger is full. New splits are merged by tiktoken with the ranks of the same vocabulary, which has less
    to do for each call; tests hold the ids against those of the tokenizer itself.
    """

    def __init__(self, path: str | None = None, most: int = 400_000) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("byte_bpe_50k.json")
        super().__init__()
        own = byte_alphabet()
        with open(path, encoding="utf-8") as f:
            ranks = {bytes(own[c] for c in token): i for token, i in json.load(f)["model"]["vocab"].items() if token != SPECIAL}
        self.tokenizer, self.merge = Tokenizer.from_file(str(path)), tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})._encode_single_piece
        self.split, self.most, self.old = regex.compile(SPLIT).findall, most, {}
        self.marks = {c: self.splits(c) for c in MARKS}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def splits(self, text: str) -> bytes:
        ids = array("I")
        for part in self.split(text):
            ids.extend(self.merge(part))
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        ids = self.old.get(chunk)
        if ids is None:
            if chunk.isalpha():
                ids = array("I", self.merge(" " + chunk)).tobytes() if sys.byteorder == "little" else self.splits(" " + chunk)
            elif chunk[-1:] in MARKS and chunk[:-1].isalpha():  # letters and a mark are two splits
                ids = self[chunk[:-1]] + self.marks[chunk[-1]]
            else:
                ids = self.splits(" " + chunk)
        self[chunk] = ids
        return ids

    def ids(self, text: str) -> bytes:
        if SPECIAL in text or UNUSUAL.search(text):
            return self.whole(text)
        if RUN.search(text):
            return self.splits(text)
        first, *rest = text.split(" ")
        return self.splits(first) + b"".join(map(self.__getitem__, rest))


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Indexes of sizes in k near-equal groups: the two partial partitions of widest spread merge, the largest group of
    one with the smallest of the other, until one is left. Ties by age, so reruns agree."""
    heap = []
    for i, s in enumerate(sizes):
        sums = np.zeros(k, dtype=np.int64)
        sums[0] = s
        heap.append((-s, i, sums, [[i]] + [[]] * (k - 1)))
    heapq.heapify(heap)
    n = len(sizes)
    while len(heap) > 1:
        _, _, a, x = heapq.heappop(heap)
        _, _, b, y = heap[0]
        total = a + b[::-1]
        order = np.argsort(-total, kind="stable")
        groups = [p + q if p and q else p or q for p, q in zip(x, reversed(y), strict=True)]
        total = total[order]
        total -= total[-1]
        heapq.heapreplace(heap, (-int(total[0]), n, total, [groups[j] for j in order.tolist()]))
        n += 1
    return heap[0][3] if heap else []


def windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """Groups of at most ``capacity`` in all: as few as the total needs, one more whenever a group exceeds it."""
    if not sizes:
        return []
    k = -(-sum(sizes) // capacity)
    while True:
        groups = differencing(sizes, k)
        over = max(sum(sizes[i] for i in g) for g in groups)
        if over <= capacity:
            return [g for g in groups if g]
        k += 1


def settle(rests: list[tuple], first: int, capacity: int, out: list[tuple]) -> int:
    """Deals pieces (doc_id, start, length, ...) out to windows numbered from ``first`` on, adds them to out, clears them; how many windows."""
    made = 0
    for group in windows([r[2] for r in rests], capacity):
        at, size = 0, sum(rests[i][2] for i in group)
        for i in sorted(group):
            out.append((*rests[i], first + made, at, size))
            at += rests[i][2]
        made += 1
    rests.clear()
    return made


def batch_of(out: list[tuple]) -> pa.RecordBatch:
    rows = pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in zip(*out, strict=True)], names=[c.split()[0] for c in SCHEMA.split(", ")])
    out.clear()
    return rows


def pack_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, piece: int = 512, block_windows: int = 64, slack: int = 16, pool: int = 64, end_id: int = 1, tokenizer_path: str | None = None) -> DataFrame:
    """Pieces of tokenised documents and their place in sequences of at most ``capacity`` tokens.

    A document is its ids and then end_id. Whole windows are cut from it first; the rest is cut into pieces of at
    most ``piece`` tokens. Each task packs its own rows: when the rests of a block fill block_windows windows but for
    ``slack`` tokens each (the last piece is cut there), Karmarkar-Karp differencing deals them out to near-equal
    windows. What a task has left, under a block, goes to a pool with that of the other tasks of its ``pool``
    neighbours, and is packed there, block by block: so small tasks cost no padding.

    Returns (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_length). Each id lies in
    exactly one piece; sequence_id is (partition, running number), or 2 ** 62 and (pool, running number). The tasks'
    pieces, not their texts or ids, lie as a table in the shared folder. Memory: one batch of texts, and the rests of one block.

    Defined cases: null text is empty, one piece with end_id alone; null or repeated identifiers are kept as they
    are, each row a document; an empty table gives no rows. Other columns are not read. Only the pools' pieces are shuffled.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, last = Encoder(tokenizer_path), np.array([end_id], dtype="<u4").tobytes()
        base, made = TaskContext.get().partitionId() << 33, 0
        out: list[tuple] = []
        rests: list[tuple] = []
        held, full = 0, block_windows * max(1, capacity - slack)

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = encoder.ids(text.as_py() or "") + last
                n, view = len(ids) // 4, memoryview(ids)
                start = 0
                while n - start >= capacity:
                    out.append((doc, start, capacity, zlib.crc32(view[4 * start : 4 * (start + capacity)]), n, base + made, 0, capacity))
                    start, made = start + capacity, made + 1
                while start < n:
                    size = min(piece, n - start, full - held)
                    rests.append((doc, start, size, zlib.crc32(view[4 * start : 4 * (start + size)]), n))
                    start, held = start + size, held + size
                    if held >= full:
                        made += settle(rests, base + made, capacity, out)
                        held = 0
                if len(out) >= 20_000:
                    yield batch_of(out)
        # Left for the pool: a negative sequence_id, and the order in the task as offset.
        out += [(*r, -1 - (base >> 33), i, 0) for i, r in enumerate(rests)]
        if out:
            yield batch_of(out)

    def pack_pools(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        rests: list[tuple] = []
        at, held, made = None, 0, 0
        for b in batches:
            for which, *piece_of, _, _ in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if which != at or held + piece_of[2] > block_windows * max(1, capacity - slack):
                    made += settle(rests, 1 << 62 | (at or 0) << 33 | made, capacity, out)
                    held = 0
                if which != at:
                    at, made = which, 0
                rests.append(tuple(piece_of))
                held += piece_of[2]
                if len(out) >= 20_000:
                    yield batch_of(out)
        settle(rests, 1 << 62 | (at or 0) << 33 | made, capacity, out)
        if out:
            yield batch_of(out)

    pieces = materialize(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(released(pack), SCHEMA), "pieces")
    left = pieces.where("sequence_id < 0").select(F.expr(f"(-1 - sequence_id) div {pool}").alias("pool"), "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    pooled = left.repartition("pool").sortWithinPartitions("pool", F.desc("sequence_id"), "offset").mapInArrow(released(pack_pools), SCHEMA)
    return pieces.where("sequence_id >= 0").unionByName(pooled)
