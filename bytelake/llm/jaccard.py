"""N-gram Jaccard join by signature trees.

Documents become sets of word shingles. A pair at the threshold must share a token of its prefixes, the rarest part of
each set under one global order, so every prefix token that two sets share routes them into a tree. A tree's nodes hold
the OR of their sets' token bitmaps and the range of their sizes; a dual traversal goes down node pairs and drops those
whose largest possible overlap is too small. What is left is compared in full.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytelake.llm.common import discard, materialize, released
from bytelake.llm.components import extended

#: Stands for a null identifier: the largest.
NO_ID = (1 << 63) - 1
#: Similarity as a fraction: 80 / 100.
NUM, DEN = 80, 100
#: Odd factors of the words of a shingle, powers of one; words' hashes are spread over 64 bits already.
FACTORS = [np.uint64(pow(0x9E3779B97F4A7C15, i, 1 << 64)) for i in range(1, 65)]


class Shingler(dict):
    """Sorted distinct 64-bit hashes of a text's word shingles; hashes of words are remembered, at most ``most``."""

    def __init__(self, k: int = 5, most: int = 500_000) -> None:
        import xxhash

        super().__init__()
        self.k, self.most, self.hash = k, most, xxhash.xxh64_intdigest

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = h = self.hash(word)
        return h

    def tokens(self, text: str | None) -> np.ndarray:
        words = text.encode().lower().split() if text else []  # bytes: A-Z only, ASCII white space only
        n = len(words)
        if n == 0:
            return np.empty(0, dtype=np.uint64)
        h = np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=n)
        width = min(n, self.k)
        out = h[: n - width + 1] * FACTORS[0]
        for i in range(1, width):
            out += h[i : n - width + 1 + i] * FACTORS[i % len(FACTORS)]
        out += np.uint64(width)
        return distinct(out)


def distinct(x: np.ndarray) -> np.ndarray:
    x.sort()
    keep = np.empty(len(x), dtype=bool)
    keep[:1] = True
    np.not_equal(x[1:], x[:-1], out=keep[1:])
    return x if keep.all() else x[keep]


def set_key(tokens: np.ndarray) -> int:
    """63-bit name of a set, from its sorted tokens; with the size beside it, 80 bits and more tell sets apart."""
    import xxhash

    return xxhash.xxh64_intdigest(tokens.tobytes(), seed=1) >> 1


def prefix_length(n: int) -> int:
    """So many first tokens, by any global order, of two sets of similarity NUM / DEN or more have one in common."""
    return n - (NUM * n + DEN - 1) // DEN + 1


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    both = np.intersect1d(a, b, assume_unique=True).size
    return DEN * both >= NUM * (a.size + b.size - both)


def texts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    for b in batches:
        yield b, b.column(b.schema.get_field_index("text")).to_pylist()


def frequent_tokens(docs: DataFrame, k: int, most: int) -> list[tuple[int, int]]:
    """The at most ``most`` tokens in the most sets, with their counts over all documents, rarest first.

    Only the order in which tokens fill prefixes depends on it, never what is found. A task counts all its sets,
    each once, and passes on what it met in three or more.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, seen, held, tally, size = Shingler(k), set(), [], {}, 0

        def fold() -> None:
            nonlocal size
            if held:
                t, n = np.unique(np.concatenate(held), return_counts=True)
                often = n >= 2
                for x, y in zip(t[often].tolist(), n[often].tolist(), strict=True):
                    tally[x] = tally.get(x, 0) + y
                if len(tally) > 2_000_000:
                    for x in [x for x, y in tally.items() if y < 3]:
                        del tally[x]
            held.clear()
            size = 0

        for _, texts in texts_of(batches):
            for text in texts:
                t = shingler.tokens(text)
                if t.size and (key := set_key(t)) not in seen:
                    seen.add(key)
                    held.append(t)
                    size += t.size
                    if size > 4_000_000:
                        fold()
        fold()
        kept = [(t, n) for t, n in tally.items() if n >= 3]
        yield pa.RecordBatch.from_arrays([pa.array(np.array([t for t, _ in kept], dtype=np.uint64).view(np.int64)), pa.array([n for _, n in kept], type=pa.int64())], names=["token", "n"])

    counted = docs.select("text").mapInArrow(released(count), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    top = counted.where("n >= 8").orderBy(F.desc("n"), "token").limit(most).collect()
    return [(r["token"], r["n"]) for r in reversed(top)]


def prefixes(docs: DataFrame, k: int, frequent: list[tuple[int, int]], hot_rows: int) -> DataFrame:
    """(doc_id, n, key, prefix, bits): size and name of each document's set, its prefix tokens and its bitmap.

    Prefix and bitmap stand once for each set that a task meets; copies have none. A token counted in over hot_rows
    sets is salted: its last bits are XOR-ed with one of so many numbers as make parts of about hot_rows sets.
    """
    tokens, counts = np.array([t for t, _ in frequent], dtype=np.int64).view(np.uint64), np.array([n for _, n in frequent], dtype=np.int64)
    order = np.argsort(tokens)
    held = docs.sparkSession.sparkContext.broadcast((tokens[order], order.astype(np.int64), -(-counts[order] // hot_rows)))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, (known, rank, salts), seen = Shingler(k), held.value, set()
        nothing = np.empty(0, dtype=np.int64)

        def prefix_of(t: np.ndarray, key: int) -> np.ndarray:
            length = prefix_length(t.size)
            if not len(known):
                return t[:length]
            at = np.minimum(np.searchsorted(known, t), len(known) - 1)
            often = known[at] == t
            rare = t[~often]
            if rare.size >= length:
                return rare[:length]
            common = at[often]
            common = common[np.argsort(rank[common])][: length - rare.size]
            return np.concatenate([rare, known[common] ^ (np.uint64(key) % salts[common].astype(np.uint64))])

        for b, texts in texts_of(batches):
            n, key, prefix, bits = [], [], [], []
            for text in texts:
                t = shingler.tokens(text)
                name = set_key(t)
                n.append(t.size)
                key.append(name)
                new = t.size > 0 and name not in seen
                if new:
                    if len(seen) >= 1_000_000:
                        seen.clear()
                    seen.add(name)
                prefix.append(prefix_of(t, name).view(np.int64) if new else nothing)
                bits.append(bitmap(t) if new else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, type=pa.int32()), pa.array(key, type=pa.int64()), lists(prefix), pa.array(bits, type=pa.binary())], names=["doc_id", "n", "key", "prefix", "bits"])

    return docs.select("doc_id", "text").mapInArrow(released(make), "doc_id long, n int, key long, prefix array<long>, bits binary")


def lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays) if arrays else np.empty(0, dtype=np.int64), type=pa.int64()))


def bitmap(tokens: np.ndarray, words: int = 4) -> bytes:
    """64 * words bits, bit (token mod bits) set for each token; words doubles while a set has over 32 tokens a word, up to 4096."""
    while tokens.size > 32 * words and words < 4096:
        words *= 2
    flags = np.zeros(64 * words, dtype=bool)
    flags[(tokens & np.uint64(64 * words - 1)).view(np.int64)] = True
    return np.packbits(flags, bitorder="little").tobytes()


def verified(pairs: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """The pairs (a, b) of set names whose whole sets are alike. texts: (key, text), one for each name."""
    sided = pairs.join(texts.select(F.col("key").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("key").alias("b"), F.col("text").alias("text_b")), "b")

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, recent = Shingler(k), {}

        def tokens(key: int, column: pa.Array, i: int) -> np.ndarray:
            if key not in recent:
                if len(recent) > 256:
                    recent.clear()
                recent[key] = shingler.tokens(column[i].as_py())
            return recent[key]

        for b in batches:
            left, right = b.column(0).to_pylist(), b.column(1).to_pylist()
            good = [i for i in range(b.num_rows) if alike(tokens(left[i], b.column(2), i), tokens(right[i], b.column(3), i))]
            yield pa.RecordBatch.from_arrays([pa.array([left[i] for i in good], type=pa.int64()), pa.array([right[i] for i in good], type=pa.int64())], names=["a", "b"])

    return sided.select("a", "b", "text_a", "text_b").mapInArrow(released(test), "a long, b long")


def texts_for(pairs: DataFrame, docs: DataFrame, reps: DataFrame, k: int, small: int = 200_000) -> DataFrame:
    """(key, text), one for each set name in pairs. Of the documents with the name's identifier those whose text has that set,
    for identifiers may repeat. Few names, by count, are broadcast, and no text is shuffled for the others."""
    names = materialize(pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct().join(reps, "key").withColumnRenamed("rep", "doc_id"), "names")
    ids = F.broadcast(names) if names.count() <= small else names

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(k)
        for b in batches:
            yield b.filter(pa.array([set_key(shingler.tokens(x)) == key for key, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)], type=pa.bool_()))

    texts = materialize(docs.join(ids, "doc_id").select("key", "text").mapInArrow(released(own), "key long, text string").dropDuplicates(["key"]), "texts")
    discard(names)
    return texts


# Signature trees


class SignatureTree:
    """Levels of nodes over sets in a given order; level 0 are the sets, each further level joins ``fan`` neighbours.

    A node holds the OR of bitmaps, smallest and largest size, most sets' tokens that share a bit (spare), and the
    range of component labels below it, which relabel() renews as components grow.
    """

    def __init__(self, bits: np.ndarray, sizes: np.ndarray, labels: np.ndarray, fan: int = 8) -> None:
        spare = sizes - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        self.fan, self.levels = fan, [(bits, sizes, sizes, spare)]
        while len(self.levels[-1][0]) > 1:
            at = np.arange(0, len(self.levels[-1][0]), fan)
            self.levels.append(tuple(op.reduceat(x, at, axis=0) for op, x in zip((np.bitwise_or, np.minimum, np.maximum, np.maximum), self.levels[-1], strict=True)))
        self.relabel(labels)

    def relabel(self, labels: np.ndarray) -> None:
        self.ranges = [(labels, labels)]
        while len(self.ranges) < len(self.levels):
            at = np.arange(0, len(self.ranges[-1][0]), self.fan)
            self.ranges.append(tuple(op.reduceat(x, at) for op, x in zip((np.minimum, np.maximum), self.ranges[-1], strict=True)))

    def possible(self, level: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether a set below node i and one below node j, of different components, may reach the similarity."""
        (bits, least, most, spare), (low, high) = self.levels[level], self.ranges[level]
        keep = ~((low[i] == high[i]) & (low[j] == high[j]) & (low[i] == low[j]))
        keep &= (DEN * most[i] >= NUM * least[j]) & (DEN * most[j] >= NUM * least[i])
        i, j, at = i[keep], j[keep], np.flatnonzero(keep)
        if level == 0:  # two sets differ in at least as many tokens as their bitmaps in bits
            fine = (NUM + DEN) * np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1, dtype=np.int64) <= (DEN - NUM) * (least[i] + least[j])
        else:
            common = np.bitwise_count(bits[i] & bits[j]).sum(axis=1, dtype=np.int64) + np.minimum(spare[i], spare[j])
            fine = (NUM + DEN) * common >= NUM * (least[i] + least[j])
        out = np.zeros(len(keep), dtype=bool)
        out[at[fine]] = True
        return out

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of sets that may be alike, by dual traversal from (root, root), so many node pairs at a time as 32 MB of bitmaps allow."""
        step = max(self.fan**2, min(1 << 15, 2_000_000 // self.levels[0][0].shape[1]))
        stack = [(len(self.levels) - 1, np.array([0]), np.array([0]))]
        while stack:
            level, i, j = stack.pop()
            if len(i) > step:
                stack += [(level, i[a : a + step], j[a : a + step]) for a in range(0, len(i), step)]
                continue
            keep = self.possible(level, i, j)
            i, j = i[keep], j[keep]
            if not len(i):
                continue
            if level == 0:
                yield i, j
                continue
            n, f = len(self.levels[level - 1][0]), np.arange(self.fan)
            for at in range(0, len(i), part := max(1, step // self.fan**2)):
                x = (i[at : at + part, None, None] * self.fan + f[None, :, None] + 0 * f[None, None, :]).ravel()
                y = (j[at : at + part, None, None] * self.fan + f[None, None, :] + 0 * f[None, :, None]).ravel()
                real = (x < n) & (y < n) & ((x < y) if level == 1 else (x <= y))
                stack.append((level - 1, x[real], y[real]))


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """A bitmap as it would be with fewer bits: the parts OR-ed."""
    return np.bitwise_or.reduce(bits.reshape(-1, words), axis=0)


class Proposals:
    """Pairs of a group's sets that its signature trees don't rule out, of different components only.

    With ``most`` = 0 a pair that may be alike makes one component of two for the rest of the search, so there is at
    most one pair less than there are sets. Else at most ``most`` pairs for two components; ``more`` tells whether
    some may be left out. Sets whose sizes may be alike have bitmaps of one length, or one twice the other's: there is
    a tree for each length, which holds the next longer ones too, folded.
    """

    def __init__(self, labels: list[int], most: int) -> None:
        named = {x: i for i, x in enumerate(dict.fromkeys(labels))}
        self.of, self.most, self.found, self.more = np.array([named[x] for x in labels]), most, [], False
        self.parent, self.times = list(range(len(named))), {}

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = x = self.parent[self.parent[x]]
        return x

    def add(self, i: int, j: int) -> bool:
        """Takes a pair; whether components have changed."""
        a, b = self.root(int(self.of[i])), self.root(int(self.of[j]))
        if a == b:
            return False
        if self.most:
            at = (min(a, b), max(a, b))
            self.times[at] = times = self.times.get(at, 0) + 1
            if times > self.most:
                self.more = True
                return False
        else:
            self.parent[max(a, b)] = min(a, b)
        self.found.append((i, j))
        self.more |= not self.most
        return not self.most

    def few(self, sizes: list[int], bits: list[bytes]) -> None:
        """All pairs, without a tree above the sets."""
        rows = [int.from_bytes(x, "little") for x in bits]
        for j in range(1, len(rows)):
            for i in range(j):
                n, m, x, y = sizes[i], sizes[j], rows[i], rows[j]
                if DEN * min(n, m) < NUM * max(n, m):
                    continue
                if (long := max(len(bits[i]), len(bits[j]))) > (short := min(len(bits[i]), len(bits[j]))):
                    half = (1 << 8 * short) - 1
                    x, y = ((z & half) | (z >> 8 * short) if len(of) == long else z for z, of in ((x, bits[i]), (y, bits[j])))
                if (NUM + DEN) * (x ^ y).bit_count() <= (DEN - NUM) * (n + m):
                    self.add(i, j)

    def search(self, sizes: np.ndarray, bits: list[bytes]) -> None:
        words = np.array([len(x) // 8 for x in bits])
        for w in sorted(set(words.tolist())):
            at = np.flatnonzero((words == w) | (words == 2 * w))
            at = at[np.lexsort((at, sizes[at], self.of[at]))]
            if len(at) < 2:
                continue
            tree = SignatureTree(np.stack([folded(np.frombuffer(bits[i], dtype="<u8"), w) for i in at.tolist()]), sizes[at], self.now(at))
            for i, j in tree.pairs():
                fresh = (words[at[i]] == w) | (words[at[j]] == w)  # two of the longer ones meet in their own tree
                if any([self.add(x, y) for x, y in zip(at[i[fresh]].tolist(), at[j[fresh]].tolist(), strict=True)]):
                    tree.relabel(self.now(at))

    def now(self, at: np.ndarray) -> np.ndarray:
        return np.array([self.root(x) for x in range(len(self.parent))])[self.of[at]]


GROUP = ["kind", "g", "size_class", "i", "j"]


def proposed(members: DataFrame, most: int) -> DataFrame:
    """Distinct (a, b, more) from (*GROUP, key, n, label, bits): pairs that may be alike, and a row (kind, g, true) where some were
    left out. GROUP names a group of bounded size, which one task searches."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at, found = {}, None, set()  # rows of one group by key

        def done() -> None:
            if len(held) > 1:
                keys, (sizes, labels, bits) = list(held), zip(*held.values(), strict=True)
                got = Proposals(labels, most)
                if len(keys) <= 4:
                    got.few(sizes, bits)
                else:
                    got.search(np.array(sizes, dtype=np.int64), bits)
                found.update((min(keys[i], keys[j]), max(keys[i], keys[j]), False) for i, j in got.found)
                if got.more:
                    found.add((at[0], at[1], True))

        def batch() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([f[s] for f in found], type=t) for s, t in enumerate((pa.int64(), pa.int64(), pa.bool_()))], names=["a", "b", "more"])
            found.clear()
            return out

        for b in batches:
            for *group, key, n, label, bits in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if group != at:
                    done()
                    held, at = {}, group
                    if len(found) > 50_000:
                        yield batch()
                held[key] = (n, label, bits)
        done()
        if found:
            yield batch()

    dealt = members.select(*GROUP, "key", "n", "label", "bits").repartition(*GROUP).sortWithinPartitions(*GROUP)
    return dealt.mapInArrow(released(search), "a long, b long, more boolean").distinct()


def in_parts(key: str, parts: F.Column) -> F.Column:
    return F.pmod(F.xxhash64(key), parts).cast("int")


def ngram_jaccard_join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 5, most_frequent: int = 1 << 17, hot_rows: int = 100_000, block: int = 2000, rounds: tuple[int, ...] = (0, 16, 1 << 62)) -> tuple[DataFrame, DataFrame]:
    """Links between different sets, and the membership of every document.

    Returns (links, membership). links: (a, b), names of sets; of the links inside a group of alike sets enough to
    connect it, and every link that joins sets not connected otherwise. membership: (doc_id, n_shingles, key,
    component_id, label), one row for each input row; component_id is the smallest doc_id reachable by links, itself
    included.

    Words are lower-cased (A-Z only) runs without ASCII white space; a set has the distinct k-word shingles, with fewer
    words the whole sequence as one. Two sets link when 100 * intersection >= 80 * union. Tokens are 64-bit hashes.

    Plan: (1) count frequent tokens, all documents, broadcast at most most_frequent of them: the order that fills
    prefixes rarest first. (2) Sets, names, prefixes and bitmaps, one narrow pass; equal sets are one from here on.
    (3) Prefix tokens that two sets share are trees; trees of the same sets count once, and tokens in over hot_rows
    sets are salted. (4) Every set goes to the largest of its trees, once. Dual traversal of each, or of blocks of
    ``block`` sets, proposes pairs that may be alike and takes them as one component for the rest of the traversal:
    at most one pair a set. These are compared in full, and texts fetched for them only. (5) Two sets of each component in a tree that was
    cut meet again, so that the blocks of a large group of near copies become one component. (6) What is left are trees
    that still hold several components. Those that are mostly of one component become one tree of that component.
    Traversal proposes all their pairs of different components that may be alike; if there are more than rounds[0]
    for two components the rest is left for the next round, by when the two may have become one; the last round has no
    such limit. Trees over ``block`` sets are cut by size class, and by blocks of which those of one component never meet.

    Defined cases: null text is empty; documents without words have n_shingles 0 and are linked with nothing, their
    component_id is their own doc_id; null doc_ids count as larger than any other; a component of null doc_ids alone
    has none; repeated rows are members like any other; an empty table gives none. Other columns are not read.
    """
    docs = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col(text_col).alias("text"))
    frequent = frequent_tokens(docs, k, most_frequent)
    sets = materialize(prefixes(docs, k, frequent, hot_rows), "sets")
    marks = sets.where("bits IS NOT NULL").select("key", "bits")
    # One exchange for both uses, which read the same columns. Copies that several tasks met fall out here.
    routed = sets.select(F.explode("prefix").alias("tree"), "key", "n").where("tree IS NOT NULL").repartition("tree")
    shared = routed.distinct().groupBy("tree").agg(F.count("*").alias("members"), F.bit_xor(F.xxhash64("key")).alias("x"), F.bit_xor(F.xxhash64("key", F.lit(1))).alias("y"))
    hot = [(t, -(-n // hot_rows)) for t, n in frequent if n > hot_rows]
    if hot:
        salted = docs.sparkSession.createDataFrame(hot, "root long, salts long").select("root", F.expr("explode(sequence(0L, salts - 1))").alias("salt")).select("root", F.expr("root ^ salt").alias("tree"))
        shared = shared.join(salted, "tree", "left")
    else:
        shared = shared.withColumn("root", F.lit(None).cast("long"))
    trees = shared.where("members > 1 OR root IS NOT NULL").groupBy("root", "members", "x", "y").agg(F.min("tree").alias("tree"))
    # root: the token itself; the trees of a salted token have one root.
    member = materialize(routed.join(trees.select("tree", "members", F.coalesce("root", "tree").alias("root")), "tree").distinct(), "members")
    reps = sets.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("rep"))
    tested, links, labels = [], [], None

    def grouped(rows: DataFrame, most: int) -> DataFrame:
        return materialize(proposed(rows.join(marks, "key"), most), "proposals")

    def compare(proposals: DataFrame) -> None:
        nonlocal labels
        pairs = proposals.where("NOT more").select("a", "b")
        if tested:
            pairs = materialize(pairs.join(every(tested), ["a", "b"], "left_anti"), "pairs")
        tested.append(pairs)
        texts = texts_for(pairs, docs, reps, k)
        links.append(materialize(verified(pairs, texts, k), "links"))
        discard(texts)
        labels = extended(labels, links[-1])

    def every(tables: list[DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionByName, tables)

    alone = [F.lit(0).alias("kind"), F.col("tree").alias("g"), F.lit(0).alias("size_class")]
    home = member.where("members > 1").groupBy("key", "n").agg(F.max(F.struct("members", "tree", "root")).alias("top")).select("key", "n", "top.*")
    home = materialize(home.withColumn("i", in_parts("key", F.ceil(F.col("members") / block))), "homes")
    compare(grouped(home.select(*alone, "i", F.lit(0).alias("j"), "key", "n", F.col("key").alias("label")), 0))
    cut = home.where((F.col("members") > block) | (F.col("root") != F.col("tree")))
    if cut.take(1):
        ends = cut.join(labels, cut["key"] == F.col("v"), "left").groupBy("root", F.coalesce("c", "key").alias("label")).agg(F.min(F.struct("key", "n")).alias("lo"), F.max(F.struct("key", "n")).alias("hi"), F.count("*").alias("c")).where("c > 1")
        ends = materialize(ends.select("root", "label", F.explode(F.array("lo", "hi")).alias("e")).select("root", "label", "e.*"), "ends")
        ends = ends.join(ends.groupBy("root").agg(F.ceil(F.count("*") / block).alias("parts")), "root").withColumnRenamed("root", "tree")
        compare(grouped(ends.select(*alone, in_parts("key", F.col("parts")).alias("i"), F.lit(0).alias("j"), "key", "n", "label"), 0))
    rest = member
    for most in rounds:
        roots, rows = open_groups(rest, labels, block)
        left = grouped(in_blocks(rows, block), most)
        compare(left)
        discard(rows)
        more = left.where("more").select(F.col("a").cast("int").alias("kind"), F.col("b").alias("g"))
        if not more.take(1):
            break
        rest = rest.join(roots.join(more, ["kind", "g"], "left_semi").select("root"), "root", "left_semi")
    discard(member, home)
    named = reps.join(labels, reps["key"] == labels["v"], "left").select("key", "rep", F.coalesce("c", "key").alias("label"))
    least = named.groupBy("label").agg(F.min("rep").alias("component"))
    of = named.join(least, "label").select("key", "component", "label")
    known = lambda c: F.when(c != NO_ID, c)
    membership = sets.drop("prefix", "bits").join(of, "key", "left").select(
        known(F.col("doc_id")).alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), "key", known(F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))).alias("component_id"), F.when(F.col("n") > 0, F.col("label")).alias("label")
    )
    return every(links), membership


def open_groups(member: DataFrame, labels: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """Trees that still hold several components: (root, kind, g), and the sets in them: (kind, g, size_class, key, n, label, bulk).

    kind 0: a tree, g its root; kind 1: all trees that are mostly of one component, g, whose sets (the bulk) needn't
    meet each other. Sizes of alike sets are at most one class of ratio DEN / NUM apart; a tree of kind 0 with over
    ``block`` sets is cut into such classes, each set in its own and the next.
    """
    marked = member.join(labels, member["key"] == labels["v"], "left").select("root", "key", "n", F.coalesce("c", "key").alias("label")).distinct()
    parts = marked.groupBy("root", "label").agg(F.count("*").alias("c"), F.min("n").alias("lo"), F.max("n").alias("hi"))
    tops = parts.groupBy("root").agg(F.max(F.struct("c", "label")).alias("top"), F.sum("c").alias("total"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count("*").alias("components"))
    tops = tops.where((F.col("components") > 1) & ((F.col("total") > 2) | (DEN * F.col("lo") >= NUM * F.col("hi"))))
    mostly = (F.col("total") > 16) & (2 * F.col("top.c") > F.col("total"))
    roots = tops.select("root", F.when(mostly, 1).otherwise(0).alias("kind"), F.when(mostly, F.col("top.label")).otherwise(F.col("root")).alias("g"), (~mostly & (F.col("total") > block)).alias("wide"))
    roots = materialize(roots, "roots")
    rows = marked.join(roots, "root").select("kind", "g", "key", "n", "label", ((F.col("kind") == 1) & (F.col("label") == F.col("g"))).alias("bulk"), "wide").distinct()
    own = F.floor(F.ln("n") / F.ln(F.lit(DEN / NUM))).cast("int")
    return roots, materialize(rows.withColumn("size_class", F.explode(F.when(F.col("wide"), F.array(own, own + 1)).otherwise(F.array(F.lit(0))))).drop("wide"), "open")


def in_blocks(rows: DataFrame, block: int) -> DataFrame:
    """(*GROUP, key, n, label) from open_groups(): i and j are the blocks of about ``block`` sets that meet. A block of the bulk meets
    those of the others only."""
    count = rows.groupBy("kind", "g", "size_class").agg(F.ceil(F.count_if("bulk") / block).cast("int").alias("bulks"), F.ceil(F.count_if(~F.col("bulk")) / block).cast("int").alias("others"))
    dealt = rows.join(count, ["kind", "g", "size_class"]).withColumn("mine", in_parts("key", F.when(F.col("bulk"), F.col("bulks")).otherwise(F.col("others"))))
    mine, others = F.col("mine"), F.col("others")
    tile = lambda i, j: F.struct(i.alias("i"), j.alias("j"))
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    meet = F.when(F.col("bulk"), F.transform(upto(others), lambda o: tile(o, others + mine))).otherwise(
        F.concat(F.transform(upto(others), lambda o: tile(F.least(o, mine), F.greatest(o, mine))), F.transform(upto(F.col("bulks")), lambda b: tile(mine, others + b)))
    )
    return dealt.select("kind", "g", "size_class", "key", "n", "label", F.explode(meet).alias("t")).select("kind", "g", "size_class", "t.i", "t.j", "key", "n", "label")


def with_set_key(docs: DataFrame, k: int) -> DataFrame:
    """Adds __n and __key, the size and name of a row's set, as in the join."""
    from pyspark.sql.types import LongType, StructType

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(k)
        for b, texts in texts_of(batches):
            sets = [shingler.tokens(t) for t in texts]
            added = [pa.array([t.size for t in sets], type=pa.int64()), pa.array([set_key(t) for t in sets], type=pa.int64())]
            yield pa.RecordBatch.from_arrays([*b.columns, *added], names=[*b.schema.names, "__n", "__key"])

    return docs.mapInArrow(own, StructType([*docs.schema.fields]).add("__n", LongType()).add("__key", LongType()))


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 5, **options) -> DataFrame:
    """The rows of docs, all columns, that stay when each group of linked documents keeps one row, that with its smallest
    identifier (null last), of these the one with the smallest set key, of these the first by text and other columns.

    Documents without words stay. Only rows whose identifier is null or repeated are shingled again, to tell them apart.
    """
    member = ngram_jaccard_join(docs, id_col=id_col, text_col=text_col, k=k, **options)[1]
    member = materialize(member.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("__id"), F.col("key").alias("__key"), "label"), "member")
    shared = materialize(member.groupBy("__id").agg(F.count("*").alias("n")).where(f"n > 1 OR __id = {NO_ID}").select("__id"), "shared")
    first = member.where("label IS NOT NULL").groupBy("label").agg(F.min(F.struct("__id", "__key")).alias("top")).select("top.*")
    wordless = member.where("label IS NULL").select("__id")
    rows = docs.withColumn("__id", F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)))
    alone = first.select("__id").unionByName(wordless).join(shared, "__id", "left_anti")
    kept = rows.join(alone, "__id", "left_semi").drop("__id")
    if shared.isEmpty():
        return kept
    # Nulls need no join, which would deal them all to one task.
    null, some = rows.where(f"__id = {NO_ID}"), rows.where(f"__id <> {NO_ID}").join(shared, "__id", "left_semi")
    columns = {c: F.col("`" + c.replace("`", "``") + "`") for c in docs.columns}
    unclear = null.unionByName(some).select("__id", columns[text_col].alias("text"), F.struct(*columns.values()).alias("row"))
    unclear = materialize(with_set_key(unclear, k), "unclear")
    best = unclear.where("__n > 0").join(first, ["__id", "__key"], "left_semi").groupBy("__id", "__key").agg(F.min_by("row", F.struct("text", F.to_json("row"))).alias("row"))
    return kept.unionByName(best.select("row.*")).unionByName(unclear.where("__n = 0").select("row.*"))
