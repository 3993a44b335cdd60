"""Iterative PageRank over an edge list, with lineage cut by reliable checkpoints."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.checkpoints import ensure_checkpoint_dir

#: Edges that one task holds; more edges take more partitions and not more memory.
EDGES = 500_000
_PARTITIONS = "spark.sql.shuffle.partitions"


@contextmanager
def partitions(spark: SparkSession, n: int) -> Iterator[None]:
    """For what is executed inside: the number of partitions of shuffles that name none."""
    before = spark.conf.get(_PARTITIONS)
    spark.conf.set(_PARTITIONS, str(n))
    try:
        yield
    finally:
        spark.conf.set(_PARTITIONS, before)


def pagerank(edges: DataFrame, iterations: int, damping: float = 0.85, checkpoint_every: int = 10) -> DataFrame:
    """(node, rank) after ``iterations`` rounds of ``1 - d + d * sum of contributions``.

    ``edges`` has the columns src and dst; repeated edges count once. Ranks start at 1; a node without outgoing edges
    gives nothing, a node without incoming edges has no rank after the first round. Edges are counted first, so that
    partitions have about EDGES of them at any size. They stay rows, hashed by source once and cached with the source's
    degree beside, so that no node's targets are gathered in one row; each round shuffles contributions alone, summed
    before the exchange. The last ranks are checkpointed, which ends the use of the cache.
    """
    spark = edges.sparkSession
    ensure_checkpoint_dir(spark)
    n = max(int(spark.conf.get(_PARTITIONS)), -(-edges.count() // EDGES))
    pairs = edges.select(F.col("src").alias("node"), "dst").repartition(n, "node").distinct()
    links = pairs.withColumn("degree", F.count(F.lit(1)).over(Window.partitionBy("node"))).cache()
    ranks = links.select("node", F.lit(1.0).alias("rank")).distinct()
    with partitions(spark, n):
        for i in range(1, iterations + 1):
            ranked = links.join(ranks, "node") if i > 1 else links.filter("node is not null").withColumn("rank", F.lit(1.0))
            sent = ranked.select(F.col("dst").alias("node"), (F.col("rank") / F.col("degree")).alias("part"))
            ranks = sent.groupBy("node").agg((F.lit(1 - damping) + F.lit(damping) * F.sum("part")).alias("rank"))
            if i % checkpoint_every == 0 or i == iterations:
                ranks = ranks.checkpoint()
    links.unpersist()
    return ranks
