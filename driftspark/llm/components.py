"""Connected components of a link table by repeated contraction, all in joins and groupings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftspark.llm import shared


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that each linked node can reach.

    Each round, every node hooks onto its neighbour with the least hash if that is less
    than its own; links are then rewritten to the hooked nodes. Hash order makes the
    number of rounds logarithmic (expected) also for long chains. Every round is written
    to the shared folder, so a lost executor costs no earlier round. The hooks shrink from
    round to round; they are followed once, from the last round back to the first.
    """
    edges = shared.staged(links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct(), "links")
    rounds = []
    while not edges.isEmpty():
        ranked = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("id"))
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = both.groupBy("a").agg(F.min(F.least(ranked("a"), ranked("b")))["id"].alias("to"))
        rounds.append(shared.staged(hooks, "hooks"))
        at = lambda c: rounds[-1].select(F.col("a").alias(c), F.col("to").alias(f"{c}_to"))
        edges = shared.staged(edges.join(at("a"), "a").join(at("b"), "b")
                              .select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b"))
                              .where("a <> b").distinct(), "links")
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    labels = rounds.pop().select(F.col("a").alias("node"), F.col("to").alias("label"))
    for hooks in reversed(rounds):
        last = labels.select(F.col("node").alias("to"), "label")
        labels = hooks.join(last, "to", "left").select(F.col("a").alias("node"), F.coalesce("label", "to").alias("label"))
    labels = shared.staged(labels, "labels")
    least = labels.groupBy("label").agg(F.min("node").alias("component"))
    return labels.join(least, "label").select("node", "component")
