"""Forward social series: which readings are due, and metrics derived from the raw counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.values import minutes_between
from tidewatch.operators import keys

# Scheduled offsets in minutes, tolerance, and how many readings make a full series.
OFFSETS = (0, 60, 360, 1440)
TOLERANCE = 20
FULL_SERIES = 8
TIER1_FOLLOWERS = 100_000


def nearest_offset(age: Column) -> Column:
    """The scheduled offset this age belongs to, if any."""
    hit = None
    for o in OFFSETS:
        near = F.abs(age - o) <= TOLERANCE
        hit = F.when(near, o) if hit is None else hit.when(near, o)
    return hit.cast("bigint")


def late(age: Column, offset: Column) -> Column:
    """Whether a reading was taken past its offset's tolerance."""
    return F.coalesce(age - offset > TOLERANCE, F.lit(False))


def due(snapshots: DataFrame, collected: DataFrame, platform: str, as_of_ms: int) -> DataFrame:
    """(snapshot, offset) pairs reached and not collected. A missed offset stays due."""
    done = collected.where(F.col("platform") == platform).select("snapshot_id", "offset_minutes")
    reached = snapshots.withColumn("age_minutes", minutes_between(F.lit(as_of_ms), "ts")).withColumn(
        "offset_minutes", F.explode(F.array(*[F.lit(o).cast("bigint") for o in OFFSETS]))
    )
    return reached.where("age_minutes >= offset_minutes").join(
        done.distinct(), ["snapshot_id", "offset_minutes"], "left_anti"
    )


def within_budget(due_rows: DataFrame, budget: int) -> DataFrame:
    """The first ``budget`` due readings, newest snapshot first, then offset."""
    return due_rows.orderBy(F.desc("ts"), "snapshot_id", "offset_minutes").limit(budget)


def with_readings(due_rows: DataFrame, readings: DataFrame, platform: str, source: str) -> DataFrame:
    """Observation rows for due readings; a reading that failed is a row with ``error`` set."""
    return (
        due_rows.join(readings, ["snapshot_id", "offset_minutes"], "left")
        .withColumn("platform", F.lit(platform))
        .withColumn("source", F.lit(source))
        .withColumn("late", late(F.col("age_minutes"), F.col("offset_minutes")))
    )


def _at(offset: int, column: str) -> Column:
    return F.max(F.when(F.col("offset_minutes") == offset, F.col(column)))


def _newest(column: str) -> Column:
    return F.max_by(F.struct(column), "offset_minutes")[column]


def x_metrics(observations: DataFrame) -> DataFrame:
    """One row per snapshot from its X readings at the scheduled offsets."""
    x = observations.where((F.col("platform") == "x") & F.col("offset_minutes").isin(*OFFSETS))
    return x.groupBy("snapshot_id").agg(
        _at(360, "mentions_window").alias("social_x_mentions_6h"),
        _at(1440, "mentions_window").alias("social_x_mentions_24h"),
        _at(1440, "unique_authors").alias("social_x_unique_authors_24h"),
        _newest("follower_weighted_reach").alias("social_x_follower_weighted_reach"),
        _newest("tier1_organic_engagements").alias("social_x_tier1_organic_engagements"),
        F.try_divide(
            _newest("replies").cast("double"), F.nullif(_newest("posts"), F.lit(0))
        ).alias("social_x_reply_to_post_ratio"),
    )


def tg_metrics(observations: DataFrame) -> DataFrame:
    """One row per snapshot from its Telegram readings."""
    tg = observations.where(F.col("platform") == "telegram")
    start, six = F.nullif(_at(0, "members"), F.lit(0)), F.nullif(_at(360, "members"), F.lit(0))
    last = F.max("offset_minutes")
    return tg.groupBy("snapshot_id").agg(
        _newest("exists").alias("social_tg_exists"),
        _newest("members").alias("social_tg_members"),
        (F.try_divide(six - start, start) * 100).alias("social_tg_member_growth_6h_pct"),
        F.try_divide(_newest("messages_window"), F.nullif(last, F.lit(0)) / 60).alias(
            "social_tg_msgs_per_hour"
        ),
        _at(1440, "unique_speakers").alias("social_tg_unique_speakers_24h"),
    )


def fold_into(candidates: DataFrame, observations: DataFrame) -> DataFrame:
    """Fill social fields the snapshot lacks; a value measured at the trigger stays."""
    for metrics in (x_metrics(observations), tg_metrics(observations)):
        names = [c for c in metrics.columns if c != "snapshot_id"]
        side = metrics.select("snapshot_id", *[F.col(c).alias(f"_d_{c}") for c in names])
        candidates = candidates.join(side, "snapshot_id", "left")
        candidates = candidates.withColumns(
            {
                c: F.coalesce(c, f"_d_{c}") if c in candidates.columns else F.col(f"_d_{c}")
                for c in names
            }
        ).drop(*[f"_d_{c}" for c in names])
    return candidates


def complete_series(observations: DataFrame) -> DataFrame:
    """Snapshots with every platform and offset read without error."""
    return (
        observations.where("error is null")
        .groupBy("snapshot_id")
        .agg(F.countDistinct("platform", "offset_minutes").alias("readings"))
        .where(F.col("readings") >= FULL_SERIES)
    )


def collected_offsets(observations: DataFrame) -> DataFrame:
    return observations.groupBy("snapshot_id", "platform").agg(
        F.sort_array(F.collect_set("offset_minutes")).alias("offsets")
    )


def accept(new: DataFrame, stored: DataFrame) -> DataFrame:
    """Readings whose (snapshot, platform, offset) slot is still free."""
    return keys.append_new(new, stored, ["snapshot_id", "platform", "offset_minutes"])
