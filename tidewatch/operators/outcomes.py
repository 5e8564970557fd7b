"""Forward outcome labels of a snapshot from its price path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.values import minutes_between
from tidewatch.operators import keys
from tidewatch.operators.intervals import in_window

# Horizons in minutes and the re-pricing ladder (age limit, interval).
HORIZONS = {"1h": 60, "6h": 360, "24h": 1440, "72h": 4320, "7d": 10080}
SURVIVAL = ("24h", "7d")
DRAWDOWN = ("24h", "72h")
SURVIVAL_FLOOR = 0.20
REPRICE_LADDER = ((60, 5), (360, 15), (1440, 60), (10080, 360))
WINDOW_MINUTES = max(HORIZONS.values())

LABEL_COLUMNS = (
    *[f"max_multiple_{h}" for h in HORIZONS],
    *[f"max_drawdown_before_peak_{h}" for h in DRAWDOWN],
    "time_to_peak_minutes",
    *[f"survived_{h}" for h in SURVIVAL],
)


def usable(obs: DataFrame) -> DataFrame:
    """Observations that carry a market cap."""
    return obs.where(F.col("mcap_usd").isNotNull())


def _path(anchors: DataFrame, obs: DataFrame, token: list[str]) -> DataFrame:
    """Usable observations inside the widest window, attached to their snapshot."""
    spans = anchors.withColumn("_end", F.col("ts") + WINDOW_MINUTES * 60_000)
    path = usable(obs).select(
        *token,
        F.col("observed_at_ms").alias("_ts"),
        F.col("pos").alias("_pos"),
        F.col("mcap_usd").alias("_mcap"),
    )
    return in_window(spans, path, token, "ts", "_end", "_ts")


def labels(
    snapshots: DataFrame,
    obs: DataFrame,
    as_of_ms: int,
    token: tuple[str, ...] = ("chain", "contract"),
) -> DataFrame:
    """Ten label columns per snapshot (snapshot_id, ts, token, market_mcap_usd).

    Pass one finds each horizon's peak and last price in one aggregate; pass two finds the lowest
    price up to the peak. Both aggregate map-side, so one token's long path never meets in a task
    unreduced. A horizon still open at ``as_of_ms``, or never observed, is null.
    """
    token = list(token)
    known = obs.where(F.col("observed_at_ms") <= as_of_ms)
    base = snapshots.select("snapshot_id", *token, "ts", F.col("market_mcap_usd").alias("_base"))
    valid = base.where(F.col("_base") > 0)

    def inside(minutes: int) -> Column:
        return F.col("_ts") <= F.col("ts") + minutes * 60_000

    peaks = (
        _path(valid, known, token)
        .groupBy("snapshot_id", *token, "ts", "_base")
        .agg(
            *[
                F.max(F.when(inside(m), F.struct("_mcap", (-F.col("_ts")).alias("_neg")))).alias(
                    f"_peak_{h}"
                )
                for h, m in HORIZONS.items()
            ],
            *[
                F.max_by(
                    F.when(inside(HORIZONS[h]), F.col("_mcap")),
                    F.when(inside(HORIZONS[h]), F.struct("_ts", "_pos")),
                ).alias(f"_last_{h}")
                for h in SURVIVAL
            ],
        )
    )
    # Every peak row is itself on the path, so pass two loses no snapshot that has a peak and
    # can carry pass one's findings along.
    carried = [c for c in peaks.columns if c.startswith(("_peak", "_last"))]
    dips = (
        _path(peaks, known, token)
        .groupBy("snapshot_id")
        .agg(
            *[
                F.min(F.when(F.col("_ts") <= -F.col(f"_peak_{h}._neg"), F.col("_mcap"))).alias(f"_dip_{h}")
                for h in DRAWDOWN
            ],
            *[F.any_value(c).alias(c) for c in carried],
        )
    )
    closed = {h: F.lit(as_of_ms) >= F.col("ts") + m * 60_000 for h, m in HORIZONS.items()}
    widest = None
    for h in HORIZONS:  # narrow to wide: the last closed horizon wins
        at = F.when(closed[h], minutes_between(-F.col(f"_peak_{h}._neg"), F.col("ts")))
        widest = at if widest is None else F.when(closed[h], at).otherwise(widest)
    b = F.col("_base")
    return (
        base.select("snapshot_id", "ts", "_base")
        .join(dips, "snapshot_id", "left")
        .select(
            "snapshot_id",
            *[
                F.when(closed[h], F.col(f"_peak_{h}._mcap") / b).alias(f"max_multiple_{h}")
                for h in HORIZONS
            ],
            *[
                F.when(
                    closed[h] & F.col(f"_dip_{h}").isNotNull(),
                    F.greatest(F.lit(0.0), 1.0 - F.col(f"_dip_{h}") / b),
                ).alias(f"max_drawdown_before_peak_{h}")
                for h in DRAWDOWN
            ],
            widest.alias("time_to_peak_minutes"),
            *[
                F.when(closed[h], F.col(f"_last_{h}") >= b * SURVIVAL_FLOOR).alias(f"survived_{h}")
                for h in SURVIVAL
            ],
        )
    )


def nothing_known() -> Column:
    """True where every label is still null."""
    return F.coalesce(*[F.col(c).cast("string") for c in LABEL_COLUMNS]).isNull()


def refresh(fresh: DataFrame, stored: DataFrame) -> DataFrame:
    """Labels to append: not all null, and not already the newest stored row value for value."""
    newest = keys.latest(stored, ["snapshot_id"], ["filled_at_ms", "label_id"])
    return keys.changed_only(
        fresh.where(~nothing_known()), newest, ["snapshot_id"], list(LABEL_COLUMNS)
    )


def window_closed(ts: Column, as_of_ms: int) -> Column:
    return F.lit(as_of_ms) - ts > WINDOW_MINUTES * 60_000


def due(age: Column, since_last: Column) -> Column:
    """Whether a token of this age (minutes) is due a re-price."""
    step = None
    for limit, every in REPRICE_LADDER:
        hit = since_last >= every
        step = F.when(age <= limit, hit) if step is None else step.when(age <= limit, hit)
    return (
        F.when(age > WINDOW_MINUTES, False).when(since_last.isNull(), True).otherwise(F.coalesce(step, F.lit(False)))
    )


def due_list(snapshots: DataFrame, observations: DataFrame, as_of_ms: int) -> DataFrame:
    """Snapshots to re-price now, with their age and the minutes since the last look."""
    last = observations.groupBy("snapshot_id").agg(F.max("ts").alias("_last"))
    return (
        snapshots.join(last, "snapshot_id", "left")
        .withColumn("age_minutes", minutes_between(F.lit(as_of_ms), "ts"))
        .withColumn("minutes_since_last", minutes_between(F.lit(as_of_ms), "_last"))
        .where(due(F.col("age_minutes"), F.col("minutes_since_last")))
        .drop("_last")
    )


def reprice(due_rows: DataFrame, feed: DataFrame, token: tuple[str, ...] = ("chain", "contract")) -> DataFrame:
    """Price observations for the due tokens the feed knows; an unknown token writes nothing."""
    return due_rows.select("snapshot_id", *token, F.col("ts").alias("snapshot_ts")).join(feed, list(token))


def reprice_summary(due_rows: DataFrame, feed: DataFrame, token: tuple[str, ...] = ("chain", "contract")) -> DataFrame:
    """Counts of due, re-priced and missing tokens."""
    hit = feed.select(*token, F.lit(True).alias("_hit")).distinct()
    return due_rows.join(hit, list(token), "left").agg(
        F.count("*").alias("due"),
        F.count("_hit").alias("repriced"),
        (F.count("*") - F.count("_hit")).alias("missing"),
    )


def accept_observations(obs: DataFrame, snapshots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, refused): an observation must point at a snapshot that exists."""
    ids = snapshots.select("snapshot_id").distinct()
    return obs.join(ids, "snapshot_id", "left_semi"), obs.join(ids, "snapshot_id", "left_anti")
