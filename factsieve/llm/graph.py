"""Connected components of a table of links, by star contraction."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factsieve.llm.store import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    """Join each node's larger neighbours to the smallest of its neighbourhood."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return (
        both.join(least.withColumnRenamed("a", "k"), F.col("a") == F.col("k"))
        .where(F.col("b") > F.col("a"))
        .select(F.col("b").alias("a"), F.col("m").alias("b"))
        .where("a <> b")
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Join each node and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    lower = down.join(least.withColumnRenamed("a", "k"), F.col("a") == F.col("k")).select(
        F.col("b").alias("a"), F.col("m").alias("b")
    )
    return lower.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(links: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root`` for every linked node that is not itself the smallest of its component.

    Each round is two combined aggregations and two joins that adaptive execution splits
    where one node has very many links; the number of rounds grows with the logarithm of
    the longest chain. The rounds end when the links are stars, without one more that
    changes nothing. Nothing but a yes or no per round reaches the driver.
    """
    edges = scratch.slim(
        links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct(),
        "edges",
    )
    while not _are_stars(edges):
        new = scratch.slim(_small_star(_large_star(edges)), "star")
        scratch.drop(edges)
        edges = new
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node has either one link, to a smaller node, or only links from larger ones."""
    up = edges.select(F.col("a").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above"))
    down = edges.select(F.col("b").alias("node"), F.lit(0).alias("below"), F.lit(1).alias("above"))
    ends = up.union(down).groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
    return ends.where("below + above > 1").isEmpty()
