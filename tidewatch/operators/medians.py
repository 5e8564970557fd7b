"""Exact medians per key for keys of any size.

Histograms narrow the range that holds a key's middle values until few values are left; only those
are sorted. Histograms are counts by (key, bin) that combine before they are shuffled, so no task
holds the values of a key, however many rows it has.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.session import durable

#: Bins of one histogram; values that may be left to sort.
BINS, ROOM = 4096, 65_536


def _met(rows: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """Rows beside each target of their key whose range holds the row's value."""
    named = targets.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys] + [F.col("_v").between(F.col("_lo"), F.col("_hi"))]
    return rows.join(named, reduce(and_, on)).drop(*[f"_k_{k}" for k in keys])


def medians(
    df: DataFrame, keys: list[str], value: Column, name: str, bins: int = BINS, room: int = ROOM
) -> DataFrame:
    """(keys, name): the median of the values that are not null; the mean of the middle two if even.

    A key without such values has no row. Infinite values are left out; equal values need no room.
    """
    finite = ~F.isnan("_v") & (F.abs("_v") < float("inf"))
    rows = df.select(*keys, value.cast("double").alias("_v")).where(finite)
    whole = rows.groupBy(*keys).agg(F.count("_v").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    # The lower and the upper middle are looked for on their own: they may part at a bin's edge.
    middle = F.array(F.floor((F.col("_n") - 1) / 2), F.floor(F.col("_n") / 2))
    targets = durable(whole.select(*keys, F.posexplode(middle).alias("_which", "_rank"), "_n", "_lo", "_hi"))
    wide = (F.col("_n") > room) & (F.col("_lo") < F.col("_hi"))
    while not targets.where(wide).isEmpty():
        targets = durable(targets.where(~wide).unionByName(_narrowed(rows, targets.where(wide), keys, bins)))
    left = _met(rows, targets.where("_lo < _hi"), keys).groupBy(*keys, "_which", "_rank")
    sorted_values = F.sort_array(F.collect_list("_v"))
    found = left.agg(F.element_at(sorted_values, (F.col("_rank") + 1).cast("int")).alias("_m")).drop("_rank")
    equal = targets.where("_lo = _hi").select(*keys, "_which", F.col("_lo").alias("_m"))
    return found.unionByName(equal).groupBy(*keys).agg(((F.min("_m") + F.max("_m")) / 2).alias(name))


def _narrowed(rows: DataFrame, targets: DataFrame, keys: list[str], bins: int) -> DataFrame:
    """Targets with the range of the one bin that holds their rank, as its values bound it."""
    # The range is halved first, so that it cannot overflow; the largest value is in the last bin.
    place = (F.col("_v") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2)
    cut = F.least(F.floor(place * bins), F.lit(bins - 1)).alias("_bin")
    counted = _met(rows, targets.drop("_n"), keys).groupBy(*keys, "_which", "_rank", cut).agg(
        F.count("_v").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")
    )
    upto = Window.partitionBy(*keys, "_which").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_n").over(upto), F.lit(0))
    placed = counted.withColumn("_rank", F.col("_rank") - before)
    return placed.where((F.col("_rank") >= 0) & (F.col("_rank") < F.col("_n"))).drop("_bin")
