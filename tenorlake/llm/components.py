"""Connected components of a graph given as links, without collecting links or nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import checkpointed, clean, erase, small, store


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``links (a long, b long)``; a component is its least node.

    Nodes are renamed by a 64-bit hash that is one to one on longs, so that their order is random.
    Each round every node takes the least of itself and its neighbours, links are drawn again between
    what the nodes took, and loops and repeated links go; in random order a round removes a share of
    the nodes whatever the graph's shape. Rounds end, each with its tables stored, when no link is left.
    Null ends and self links are ignored; nodes without links are not returned.

    Tables are stored and not checkpointed, as a checkpoint keeps its plan's estimate of its size, and a join's estimate is
    the product of both sides': its digits would triple with each round until the driver has no room for the number.
    Stored ones have the size of their files.
    """
    spark = links.sparkSession
    used = links.where("a is not null and b is not null and a <> b")
    named, path = store(used.select(F.xxhash64("a").alias("a"), F.xxhash64("b").alias("b"), F.col("a").alias("node_a"), F.col("b").alias("node_b")).distinct(), "links")
    names = named.select(F.explode(F.array(F.struct(F.col("a").alias("h"), F.col("node_a").alias("node")), F.struct(F.col("b").alias("h"), F.col("node_b").alias("node")))).alias("x")).select("x.*").distinct()
    left = named.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    label, held = names.select("h", "node", F.col("h").alias("to")), [path]
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least, taken = store(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("took")), "took")
        label, labels = store(label.join(least.select(F.col("a").alias("to"), F.col("took").alias("next")), "to", "left").select("h", "node", F.coalesce("next", "to").alias("to")), "labels")
        ends = left.join(least.select("a", F.col("took").alias("c")), "a").join(least.select(F.col("a").alias("b"), F.col("took").alias("d")), "b")
        left, further = store(ends.where("c <> d").select(F.least("c", "d").alias("a"), F.greatest("c", "d").alias("b")).distinct(), "left")
        # nothing reads the round before any more
        for path in (*held, taken):
            erase(spark, path)
        held = [labels, further]
        del both, least, ends
        clean(spark)
    # the result is read later, so it lies in checkpoints, which go when nothing refers to them
    label = checkpointed(label)
    for path in held:
        erase(spark, path)
    # a table of its own, so that the rows of a hot component can be split among tasks
    least = small(checkpointed(label.groupBy("to").agg(F.min("node").alias("component"))))
    return label.join(least, "to").select("node", "component")
