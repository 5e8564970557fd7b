"""Running totals and ranks over an order too large for one task.

Rows are range-partitioned on (keys, order), each partition is totalled, and the totals of the
partitions before it are added to a window inside the partition. One hot key spreads over as many
partitions as it needs. The partitioned rows are checkpointed because both the totals and the
windows read them and must see the same partition numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.session import durable


def prefix_sums(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    sums: dict[str, Column | str],
    partitions: int | None = None,
) -> DataFrame:
    """Add inclusive running sums per key. ``order`` must be total within a key."""
    inputs = {f"_in_{n}": (F.col(c) if isinstance(c, str) else c) for n, c in sums.items()}
    by = [*[F.col(k) for k in keys], *order]
    rows = df.withColumns(inputs)
    # Without a fixed number, adaptive execution may merge neighbouring small ranges; the order of
    # the partitions stays the order of the ranges either way.
    spread = rows.repartitionByRange(partitions, *by) if partitions else rows.repartitionByRange(*by)
    spread = durable(spread.withColumn("_pid", F.spark_partition_id()))
    # One row per (key, partition): as many as partitions plus keys, never as many as rows.
    totals = spread.groupBy(*keys, "_pid").agg(
        *[F.sum(f"_in_{n}").alias(f"_sum_{n}") for n in sums]
    )
    before = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, "_pid", *[F.sum(f"_sum_{n}").over(before).alias(f"_off_{n}") for n in sums]
    )
    inside = (
        Window.partitionBy(*keys, "_pid")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    on = [*[F.col(f"s.{k}").eqNullSafe(F.col(f"t.{k}")) for k in keys], F.col("s._pid") == F.col("t._pid")]
    local = spread.withColumns({f"_loc_{n}": F.sum(f"_in_{n}").over(inside) for n in sums})
    joined = local.alias("s").join(offsets.alias("t"), on)
    return joined.select(
        *[F.col(f"s.{c}") for c in df.columns],
        *[
            (F.col(f"s._loc_{n}") + F.coalesce(F.col(f"t._off_{n}"), F.lit(0))).alias(n)
            for n in sums
        ],
    )


def row_numbers(
    df: DataFrame, keys: list[str], order: list[Column], name: str = "rank"
) -> DataFrame:
    """Exact row_number() per key, for keys of any size."""
    return prefix_sums(df, keys, order, {name: F.lit(1).cast("bigint")})


def running_count(
    df: DataFrame,
    keys: list[str],
    ts: str,
    tie: str,
    name: str,
    chunk_ms: int = 3_600_000,
) -> DataFrame:
    """Position of each row in its key's time order, counted per time chunk.

    Time order has natural cuts, so no checkpoint is needed: rows are numbered inside a
    (key, chunk) and the counts of earlier chunks are added.
    """
    cut = df.withColumn("_chunk", F.floor(F.col(ts) / chunk_ms).cast("bigint"))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    earlier = (
        cut.groupBy(*keys, "_chunk")
        .count()
        .withColumn("_before", F.coalesce(F.sum("count").over(before), F.lit(0)))
        .drop("count")
    )
    inside = Window.partitionBy(*keys, "_chunk").orderBy(ts, tie)
    return (
        cut.withColumn("_inside", F.row_number().over(inside))
        .join(earlier, [*keys, "_chunk"])
        .select(*df.columns, (F.col("_inside") + F.col("_before")).cast("bigint").alias(name))
    )
