"""Gradient-boosted trees of depth 2, applied as a Spark expression; fitted on all rows of a table (fit_counts), or of arrays (fit).

Both grow a tree level by level from sums by leaf, feature and bin; of a table only these and the cuts between bins reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass
class Node:
    """A split (feature <= threshold goes left), or a leaf if feature is None."""

    value: float = 0.0
    feature: str | None = None
    threshold: float = 0.0
    left: Node | None = None
    right: Node | None = None


@dataclass
class Boosted:
    base: float = 0.0
    trees: list[Node] = field(default_factory=list)

    def logit(self, get: Callable[[str], Column]) -> Column:
        """The model as an expression; get: the column of a feature."""

        def one(n: Node) -> Column:
            return F.lit(n.value) if n.feature is None else F.when(get(n.feature) <= n.threshold, one(n.left)).otherwise(one(n.right))

        total = F.lit(self.base)
        for t in self.trees:
            total = total + one(t)
        return total

    def predict(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        out = np.full(len(x), self.base)
        for t in self.trees:
            out += [descend(t, dict(zip(names, row, strict=True))) for row in x] if len(x) < 2 else walk(t, x, names)
        return out


def descend(n: Node, row: dict[str, float]) -> float:
    while n.feature is not None:
        n = n.left if row[n.feature] <= n.threshold else n.right
    return n.value


def walk(n: Node, x: np.ndarray, names: list[str], value: Callable[[Node], float] = lambda n: n.value) -> np.ndarray:
    if n.feature is None:
        return np.full(len(x), value(n))
    low = x[:, names.index(n.feature)] <= n.threshold
    out = np.empty(len(x))
    out[low], out[~low] = walk(n.left, x[low], names, value), walk(n.right, x[~low], names, value)
    return out


def leaves(n: Node) -> list[Node]:
    return [n] if n.feature is None else leaves(n.left) + leaves(n.right)


def grow(sums: Callable[[Node], list[np.ndarray]], names: list[str], cuts: list[np.ndarray], depth: int, rate: float, ridge: float = 1.0) -> Node:
    """A tree. sums: for each leaf of a tree, from the left, an array (feature, bin, 3) of counts, gradients and Hessians."""
    value = lambda g, h: float(rate * g / (h + ridge))
    root = Node()
    for level in range(depth):
        tables, open_ = sums(root), leaves(root)
        if not level:
            root.value = value(*tables[0][0].sum(axis=0)[1:])
        for leaf, table in zip(open_, tables, strict=True):
            n, g, h = table[0].sum(axis=0)
            best, at = 1e-6, None
            for j, edges in enumerate(cuts if n >= 20 else []):
                if not len(edges):
                    continue
                nl, gl, hl = np.cumsum(table[j, : len(edges) + 1], axis=0)[:-1].T
                gain = np.where((nl > 0) & (nl < n), gl**2 / (hl + ridge) + (g - gl) ** 2 / (h - hl + ridge) - g**2 / (h + ridge), 0.0)
                if gain[k := int(gain.argmax())] > best:
                    best, at = float(gain[k]), (names[j], float(edges[k]), Node(value(gl[k], hl[k])), Node(value(g - gl[k], h - hl[k])))
            if at is not None:
                leaf.feature, leaf.threshold, leaf.left, leaf.right = at
        if len(leaves(root)) == len(open_):
            break
    return root


def boost(positive: float, n: float, sums: Callable[[Boosted, Node], list[np.ndarray]], names: list[str], cuts: list[np.ndarray], *, rounds: int = 24, depth: int = 2, rate: float = 0.3) -> Boosted:
    """Logistic boosting with Newton leaves. Deterministic: no sampling, the first of equal splits."""
    share = float(np.clip(positive / n if n else 0.0, 1e-3, 1 - 1e-3))
    model = Boosted(base=float(np.log(share / (1 - share))))
    for _ in range(rounds if 0 < positive < n else 0):
        model.trees.append(grow(lambda tree: sums(model, tree), names, cuts, depth, rate))
    return model


def fit(x: np.ndarray, y: np.ndarray, names: list[str], *, bins: int = 16, **options) -> Boosted:
    """The model of arrays."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for c in x.T] if len(y) else []
    slots = [np.searchsorted(edges, c, side="left") for edges, c in zip(cuts, x.T, strict=False)]  # x <= edges[s] for s >= slot

    def sums(model: Boosted, tree: Node) -> list[np.ndarray]:
        p, open_ = 1 / (1 + np.exp(-model.predict(x, names))), leaves(tree)
        marks = dict(zip(map(id, open_), range(len(open_)), strict=True))
        leaf = walk(tree, x, names, lambda n: marks[id(n)])
        return [np.array([[np.bincount(s[leaf == i], weights=w[leaf == i], minlength=bins) for w in (np.ones(len(y)), y - p, p * (1 - p))] for s in slots]).transpose(0, 2, 1) for i in range(len(open_))]

    return boost(float(y.sum()), len(y), sums, names, cuts, **options)


def table_cuts(rows: DataFrame, names: list[str], out: str, bins: int = 16) -> list[np.ndarray]:
    """For each column the distinct quantiles of all rows that aren't held out, by counts of its values.

    They are counted, not filtered: of a filter on many columns Spark infers as many conditions as there are sets of them.
    """
    counts = rows.select((~F.col(out)).cast("long").alias("one"), F.posexplode(F.array(*names)).alias("j", "x")).groupBy("j", "x").agg(F.sum("one").alias("n")).where("x IS NOT NULL AND n > 0")
    by = Window.partitionBy("j")
    placed = counts.withColumn("upto", F.sum("n").over(by.orderBy("x"))).withColumn("all", F.sum("n").over(by))
    place = [F.expr(f"({k} * (all - 1)) div {bins}") for k in range(1, bins)]
    hit = F.exists(F.array(*place), lambda at: (at >= F.col("upto") - F.col("n")) & (at < F.col("upto")))
    found = placed.where(hit).select("j", "x").collect()
    return [np.array(sorted(r.x for r in found if r.j == j)) for j in range(len(names))]


def table_counts(rows: DataFrame, names: list[str], cuts: list[np.ndarray], by: list[str], label: str) -> DataFrame:
    """(by, names, _n, _positive): rows by their bins, each named by its upper cut, the last one by infinity. Splits at cuts part them alike."""

    def upper(name: str, edges: np.ndarray) -> Column:
        return F.coalesce(*[F.when(F.col(name) <= float(e), F.lit(float(e))) for e in edges], F.lit(float("inf"))).alias(name)

    binned = rows.select(*by, label, *map(upper, names, cuts))
    return binned.groupBy(*by, *names).agg(F.count("*").alias("_n"), F.sum(F.col(label).cast("long")).alias("_positive"))


def fit_counts(counts: DataFrame, names: list[str], cuts: list[np.ndarray], **options) -> Boosted:
    """The model of all rows that table_counts() counted: a small aggregate for each level of each tree. Sums are of integers (units of
    2**-30), so they don't depend on the order of rows."""
    unit, width = 1 << 30, max((len(c) for c in cuts), default=0) + 1
    n, positive = counts.agg(F.sum("_n"), F.sum("_positive")).first()
    p = lambda model: 1 / (1 + F.exp(-model.logit(F.col)))

    def sums(model: Boosted, tree: Node) -> list[np.ndarray]:
        open_ = leaves(tree)
        marks = dict(zip(map(id, open_), range(len(open_)), strict=True))
        mark = lambda t: F.lit(marks[id(t)]) if t.feature is None else F.when(F.col(t.feature) <= t.threshold, mark(t.left)).otherwise(mark(t.right))
        parts = counts.select("*", p(model).alias("_p")).select(
            mark(tree).alias("leaf"), F.col("_n").alias("n"), (F.col("_positive") * unit - F.col("_n") * F.round(F.col("_p") * unit).cast("long")).alias("g"),
            (F.col("_n") * F.round(F.col("_p") * (1 - F.col("_p")) * unit).cast("long")).alias("h"), F.posexplode(F.array(*names)).alias("j", "x"),
        )
        out = np.zeros((len(open_), len(names), width, 3))
        for r in parts.groupBy("leaf", "j", "x").agg(F.sum("n").alias("n"), F.sum("g").alias("g"), F.sum("h").alias("h")).collect():
            out[r.leaf, r.j, np.searchsorted(cuts[r.j], r.x)] = r.n, r.g / unit, r.h / unit
        return list(out)

    return boost(positive or 0, n or 0, sums, names, cuts, **options)


def count_thresholds(counts: DataFrame, model: Boosted, by: str, precision: float) -> dict[float, float]:
    """precise_threshold() for each value of a column, of all rows that table_counts() counted; none where it is infinite."""
    scored = counts.select(by, model.logit(F.col).alias("score"), "_n", "_positive").groupBy(by, "score").agg(F.sum("_n").alias("n"), F.sum("_positive").alias("positive"))
    down = Window.partitionBy(by).orderBy(F.desc("score"))
    good = scored.withColumn("share", F.sum("positive").over(down) / F.sum("n").over(down)).where(F.col("share") >= precision)
    return {r[by]: r.least for r in good.groupBy(by).agg(F.min("score").alias("least")).collect()}


def precise_threshold(score: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The least score from which on at least that share of the held-out cases is positive; infinite if there is none."""
    if not len(y):
        return float("inf")
    order = np.argsort(-score, kind="stable")
    share = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    last = np.flatnonzero((share >= precision) & np.append(np.diff(score[order]) != 0, True))
    return float(score[order][last[-1]]) if len(last) else float("inf")
