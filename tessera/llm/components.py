"""Connected components of an edge table, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, comp) of every node of edges (a, b): comp is the smallest node it is connected with.

    Each round takes the least label among neighbours (pre-aggregated before the shuffle) and then the label of that
    label. Labels only fall. Each round is a written table, and goes when the next one stands.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = scratch.keep(both, f"{name}-edges")
    labels = scratch.keep(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("comp")), f"{name}-0")
    round_, moved = 0, True
    while moved:
        round_ += 1
        other = labels.select(F.col("node").alias("b"), F.col("comp").alias("theirs"))
        least = both.join(other, "b").groupBy(F.col("a").alias("node")).agg(F.min("theirs").alias("theirs"))
        near = labels.join(least, "node", "left").select("node", F.col("comp").alias("old"), F.least("comp", F.coalesce("theirs", "comp")).alias("via"))
        jump = labels.select(F.col("node").alias("via"), F.col("comp").alias("beyond"))
        now = near.join(jump, "via", "left").select("node", "old", F.least("via", F.coalesce("beyond", "via")).alias("comp"))
        now = scratch.keep(now, f"{name}-{round_}")
        scratch.drop(f"{name}-{round_ - 1}")
        moved = not now.where("comp <> old").isEmpty()
        labels = now.select("node", "comp")
    scratch.drop(f"{name}-edges")
    return labels
