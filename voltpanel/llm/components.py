"""Connected components of a link table by alternating large-star and small-star steps.

Both steps are an aggregate and a join over the links, so a node with very many links is
combined map-side and its join partition can be split; nothing is collected. Each round is
stored in the shared folder, which cuts the lineage and survives lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltpanel.session import materialised


def _state(links: DataFrame) -> tuple:
    """A digest of the link set, equal for equal sets."""
    return tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.hash("a", "b").cast("long"))).first())


def _large_star(links: DataFrame) -> DataFrame:
    """Every node hands its smallest neighbour (or itself) to its larger neighbours."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("least"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Every node hands its smallest neighbour to its smaller neighbours and keeps it itself."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")
    least = down.groupBy("a").agg(F.min("b").alias("least"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return moved.unionByName(least.select("a", F.col("least").alias("b"))).filter("a <> b").distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """node, root: the least node that each linked node reaches; ``links`` has longs a and b.

    Nodes without links do not appear. No links give an empty table.
    """
    spark = links.sparkSession
    links = materialised(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = _state(links)
    while state[0]:
        links = materialised(_small_star(_large_star(links)), "links")
        before, state = state, _state(links)
        if state == before:
            break
    roots = links.select(F.col("b").alias("node")).distinct()
    if not state[0]:
        return spark.createDataFrame([], "node bigint, root bigint")
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots.withColumn("root", F.col("node")))
