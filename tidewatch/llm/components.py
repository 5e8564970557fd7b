"""Connected components of a link table, in tables that stay distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import sized_for, stored


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _hung_on_least(neighbours: DataFrame, small: bool, rows: int) -> DataFrame:
    """Hang each node's neighbours on the least of them and the node itself.

    ``small``: only the neighbours below a node move, and the node with them (small star);
    otherwise those above it move (large star).
    """
    ways = neighbours.where("b < a") if small else neighbours
    least = ways.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
    least = stored(sized_for(least, rows), "least")
    met = ways.join(least, "a")
    if small:
        moved = met.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(
            least.select("a", F.col("low").alias("b"))
        )
    else:
        moved = met.where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return sized_for(moved.where("a <> b").distinct(), rows)


def components(links: DataFrame) -> DataFrame:
    """(a, b) links → (node, component): the least node of each linked set, for nodes with a link.

    Alternates large and small stars until the link table no longer changes; each round is a few
    aggregations and joins over tables in the shared folder, and chains shrink geometrically.
    """
    now = stored(links.where("a <> b").distinct(), "links")
    rows, seen = 2 * now.count(), None
    while True:
        now = stored(_hung_on_least(_both_ways(now), False, rows), "large-star")
        now = stored(_hung_on_least(_both_ways(now), True, rows), "small-star")
        state = now.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        ).first()
        if tuple(state) == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        seen = tuple(state)
