"""Share of the attention observed across one polled universe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.values import non_negative
from tidewatch.operators.keys import join_null_safe
from tidewatch.operators.ordered import row_numbers

# The components and their weights.
COMPONENT_WEIGHTS = {"txns_24h": 1.0, "volume_24h_usd": 1.0, "boost_total": 1.0}


def totals(tokens: DataFrame, universe: str) -> DataFrame:
    """Null-skipping component totals and the size of each universe."""
    return tokens.groupBy(universe).agg(
        F.count("*").alias("universe_size"),
        *[F.sum(non_negative(c)).alias(f"universe_{c}") for c in COMPONENT_WEIGHTS],
    )


def weighted_share(pairs: dict[str, tuple[Column, Column]], weights: dict[str, float]) -> Column:
    """Renormalised weighted mean of value/total, in percent, over the parts that resolve."""
    top, weight = F.lit(0.0), F.lit(0.0)
    for name, (value, total) in pairs.items():
        w = weights.get(name) or 0.0
        if not w:
            continue
        v, t = non_negative(value), non_negative(total)
        share = F.when(t > 0, F.try_divide(v, t))
        top = top + F.coalesce(w * share, F.lit(0.0))
        weight = weight + F.when(share.isNotNull(), F.lit(w)).otherwise(0.0)
    return F.when(weight > 0, top / weight * 100.0)


def shares(tokens: DataFrame, universe: str, weights: dict[str, float] | None = None) -> DataFrame:
    """Tokens with their universe's totals and share_pct.

    The totals are one small row per universe; joined on the universe key, where adaptive
    execution may split a hot universe on the token side.
    """
    weights = weights or COMPONENT_WEIGHTS
    joined = join_null_safe(tokens, totals(tokens, universe), [universe])
    pairs = {c: (F.col(c), F.col(f"universe_{c}")) for c in COMPONENT_WEIGHTS}
    return joined.withColumn("share_pct", weighted_share(pairs, weights))


def ranked(tokens: DataFrame, universe: str, tie: str, digits: int | None = None) -> DataFrame:
    """Add rank and percentile over the measured tokens; unmeasured ones have neither.

    ``digits`` rounds the share before ranking, for totals whose last bit depends on the order
    of summation.
    """
    rows = shares(tokens, universe)
    if digits is not None:
        rows = rows.withColumn("share_pct", F.round("share_pct", digits))
    # Unmeasured tokens sort last and keep no rank, so one pass over the universe is enough.
    order = [F.col("share_pct").desc_nulls_last(), F.col(tie)]
    placed = row_numbers(rows, [universe], order, "_at")
    counts = placed.groupBy(universe).agg(F.count("share_pct").alias("_measured"))
    rank = F.when(F.col("share_pct").isNotNull(), F.col("_at"))
    return (
        join_null_safe(placed, counts, [universe])
        .withColumn("rank", rank)
        .withColumn("percentile", (F.col("_measured") - F.col("rank") + 1) / F.col("_measured") * 100.0)
        .drop("_measured", "_at")
    )


def recompute(row_share: dict[str, float] | None = None) -> Column:
    """Share of a stored snapshot row under other component weights."""
    pairs = {
        "txns_24h": (F.col("mindshare_txns_24h"), F.col("mindshare_universe_txns_24h")),
        "volume_24h_usd": (
            F.col("market_volume_24h_usd"),
            F.col("mindshare_universe_volume_24h_usd"),
        ),
        "boost_total": (F.col("mindshare_boost_total"), F.col("mindshare_universe_boost_total")),
    }
    return weighted_share(pairs, row_share or COMPONENT_WEIGHTS)
