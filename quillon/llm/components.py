"""Connected components of links between documents, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quillon.llm.common import Scratch


def components(links: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): the smallest id that each linked id can reach.

    Each round maps every node to the least of itself and its neighbours,
    follows that map once more and contracts the links; a star is gone after
    one round and a chain of n after about log n. Only a link count reaches
    the driver. Null ends and loops are ignored; no links give no rows.
    """
    links = links.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a < b").distinct()
    links = scratch.keep(links)
    labels = None
    while not links.isEmpty():
        ends = links.select(F.col("a").alias("id"), F.col("a").alias("to")).unionAll(links.select(F.col("b").alias("id"), F.col("a").alias("to")))
        step = scratch.keep(ends.groupBy("id").agg(F.min("to").alias("to")))
        onward = step.select(F.col("id").alias("to"), F.col("to").alias("next"))
        step2 = scratch.keep(step.join(onward, "to").select("id", F.least("to", "next").alias("to")))
        if labels is None:
            grown = step2.select("id", F.col("to").alias("component"))
        else:
            moved = step2.select(F.col("id").alias("component"), "to")
            grown = labels.join(moved, "component", "left").select("id", F.coalesce("to", "component").alias("component"))
        grown = scratch.keep(grown)
        by_a = step2.select(F.col("id").alias("a"), F.col("to").alias("x"))
        by_b = step2.select(F.col("id").alias("b"), F.col("to").alias("y"))
        left = links.join(by_a, "a").join(by_b, "b").where("x <> y")
        shrunk = scratch.keep(left.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        scratch.drop(links, step, step2, *([labels] if labels is not None else []))
        links, labels = shrunk, grown
    if labels is None:
        return links.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return labels
