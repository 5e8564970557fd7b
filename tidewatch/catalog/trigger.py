"""Trigger, labels, latest/first and mindshare queries."""

from pyspark.sql import functions as F

from tidewatch.catalog import inputs as I
from tidewatch.catalog import register
from tidewatch.operators import trigger


@register(
    "p01_trigger_predicate",
    """SELECT pos, mcap_usd, holder_count, trigger_mcap_crossed, trigger_holders_crossed,
    trigger_kind, trigger_kind IS NOT NULL AS fired FROM fired_""",
)
def p01(spark, d):
    return trigger.decide(I.obs(spark, d)).select(
        "pos", "mcap_usd", "holder_count", "trigger_mcap_crossed", "trigger_holders_crossed",
        "trigger_kind", "fired",
    )


@register(
    "w03_first_crossing",
    """SELECT snapshot_id, s.chain, s.contract, ts, s.pos, trigger_kind, market_mcap_usd, holders_count,
    (SELECT count(*) FROM obs_ o WHERE o.chain = s.chain AND o.contract = s.contract
      AND (o.observed_at_ms, o.pos) < (s.ts, s.pos)) AS crossing_index FROM snap_ s""",
)
def w03(spark, d):
    o = I.obs(spark, d)
    first = trigger.first_crossings(o)
    return trigger.crossing_index(o, first).select(
        F.concat(F.lit("s"), "user_id").alias("snapshot_id"),
        "chain",
        "contract",
        F.col("observed_at_ms").alias("ts"),
        "pos",
        "trigger_kind",
        F.col("mcap_usd").alias("market_mcap_usd"),
        F.col("holder_count").alias("holders_count"),
        "crossing_index",
    )


@register("a16_forward_labels", "SELECT * FROM labels_late_")
def a16(spark, d):
    return I.labels_job(spark, d)


@register("a16_forward_labels_open_horizons", "SELECT * FROM labels_early_")
def a16_early(spark, d):
    return I.labels_job(spark, d, I.AS_OF_EARLY)


@register(
    "w05_peak_and_trough",
    """SELECT snapshot_id, max_multiple_24h, max_drawdown_before_peak_24h, time_to_peak_minutes, survived_24h FROM labels_late_""",
)
def w05(spark, d):
    return I.labels(spark, d).select(
        "snapshot_id", "max_multiple_24h", "max_drawdown_before_peak_24h", "time_to_peak_minutes", "survived_24h"
    )
