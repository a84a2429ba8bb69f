"""Connected components by alternating large and small stars, each a shuffle on a vertex with partial minima."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import materialize


def _star(edges: DataFrame) -> DataFrame:
    """Each vertex's neighbours, all smaller than itself, and the vertex are hung on the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    hung = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hung.unionAll(least.select("a", F.col("m").alias("b"))).where("a != b")


def components(edges: DataFrame) -> DataFrame:
    """(a, b) pairs of longs, each with a > b wanted or not, to (v, component): the smallest vertex that v reaches.

    Vertices without an edge don't come up. The number of rounds grows with the logarithm of the longest path.
    """
    edges = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct())
    state = None
    while True:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = materialize(_star(large.where("a != b").distinct()).distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("a").alias("v"), F.col("b").alias("component"))
        state = now
