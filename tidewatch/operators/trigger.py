"""The trigger rule and the first crossing of each token."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.values import clean
from tidewatch.operators import keys

# The trigger thresholds and names.
MCAP_USD = 250_000.0
HOLDERS = 500
BY_MCAP = "mcap_250k"
BY_HOLDERS = "holders_500"


def crossed(value: Column | str, threshold: float) -> Column:
    """Threshold test in which missing, NaN and infinite values never cross."""
    return F.coalesce(clean(value) >= threshold, F.lit(False))


def decide(df: DataFrame, mcap: str = "mcap_usd", holders: str = "holder_count") -> DataFrame:
    """Add fired, trigger_kind and both crossing flags."""
    return (
        df.withColumn("trigger_mcap_crossed", crossed(mcap, MCAP_USD))
        .withColumn("trigger_holders_crossed", crossed(holders, HOLDERS))
        .withColumn(
            "trigger_kind",
            F.when(F.col("trigger_mcap_crossed"), BY_MCAP).when(
                F.col("trigger_holders_crossed"), BY_HOLDERS
            ),
        )
        .withColumn("fired", F.col("trigger_kind").isNotNull())
    )


def first_crossings(obs: DataFrame, token: tuple[str, ...] = ("chain", "contract")) -> DataFrame:
    """Each token's earliest firing observation. One aggregate, combined map-side."""
    fired = decide(obs).where("fired")
    return keys.first(fired, list(token), ["observed_at_ms", "pos"])


def crossing_index(
    obs: DataFrame, crossings: DataFrame, token: tuple[str, ...] = ("chain", "contract")
) -> DataFrame:
    """How many observations of the token came before its crossing."""
    at = crossings.select(
        *token, F.col("observed_at_ms").alias("_at"), F.col("pos").alias("_pos")
    )
    earlier = F.struct("observed_at_ms", "pos") < F.struct("_at", "_pos")
    counts = (
        obs.join(at, list(token))
        .groupBy(*token)
        .agg(F.count_if(earlier).alias("crossing_index"))
    )
    return crossings.join(counts, list(token))


def not_yet_fired(
    obs: DataFrame, events: DataFrame, token: tuple[str, ...] = ("chain", "contract")
) -> DataFrame:
    """Observations of tokens with no trigger event."""
    return keys.append_new(obs, events, list(token))
