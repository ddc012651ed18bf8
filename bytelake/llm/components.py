"""Connected components of a link table by minimum labels and pointer jumping, all distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytelake.llm.common import discard, materialize


def components(links: DataFrame, most_rounds: int = 64) -> DataFrame:
    """(v, c) for each vertex of links (a, b): c is the smallest vertex that its links reach.

    A round takes the least label over the neighbours and then that label's own label, so rounds grow with the
    logarithm of the longest path. Rounds are tables in the shared folder; the driver sees only a count of changes.
    """
    both = materialize(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "links")
    labels = materialize(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("c")), "labels")
    for _ in range(most_rounds):
        near = both.join(labels.select(F.col("v").alias("b"), "c"), "b").groupBy(F.col("a").alias("v")).agg(F.min("c").alias("m"))
        step = labels.join(near, "v").select("v", F.col("c").alias("was"), F.least("c", "m").alias("c"))
        jump = step.join(labels.select(F.col("v").alias("c"), F.col("c").alias("up")), "c", "left").select("v", "was", F.least("c", F.coalesce("up", "c")).alias("c"))
        made = materialize(jump, "labels")
        discard(labels)
        labels = made.select("v", "c")
        if not made.where("c <> was").take(1):
            break
    else:
        raise RuntimeError("components didn't settle")
    discard(both)
    return labels


def extended(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """components() of the links that made ``labels`` and of further ones, from those between the components alone."""
    if labels is None:
        return components(links)
    named = lambda side: labels.select(F.col("v").alias(side), F.col("c").alias(f"c_{side}"))
    ends = links.join(named("a"), "a", "left").join(named("b"), "b", "left").select(F.coalesce("c_a", "a").alias("a"), F.coalesce("c_b", "b").alias("b"))
    top = components(ends.where("a <> b").distinct())
    renamed = labels.join(top.select(F.col("v").alias("c"), F.col("c").alias("up")), "c", "left").select("v", F.coalesce("up", "c").alias("c"))
    out = materialize(renamed.unionByName(top.join(labels, "v", "left_anti")), "labels")
    discard(labels, top)
    return out
