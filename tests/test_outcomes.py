"""Trigger boundaries and label gating."""

from pyspark.sql import functions as F

from tidewatch.operators import outcomes, trigger

HOUR = 3_600_000
T0 = 1_704_067_200_000


def labels(spark, path, as_of, baseline=100.0):
    snaps = spark.createDataFrame([("s", "c", "t", T0, baseline)], "snapshot_id string, chain string, contract string, ts bigint, market_mcap_usd double")
    rows = [("c", "t", T0 + int(h * HOUR), i, m) for i, (h, m) in enumerate(path)]
    obs = spark.createDataFrame(rows, "chain string, contract string, observed_at_ms bigint, pos int, mcap_usd double")
    return outcomes.labels(snaps, obs, as_of).first()


def test_trigger_boundaries(spark):
    rows = [(250000.0, None), (249999.99, 499), (None, 500), (float("nan"), 1), (float("inf"), None), (300000.0, 900)]
    df = trigger.decide(spark.createDataFrame(rows, "mcap_usd double, holder_count bigint"))
    got = [(r["trigger_kind"], r["trigger_mcap_crossed"], r["trigger_holders_crossed"]) for r in df.collect()]
    assert got == [
        ("mcap_250k", True, False), (None, False, False), ("holders_500", False, True),
        (None, False, False), (None, False, False), ("mcap_250k", True, True),
    ]


def test_open_and_unobserved_horizons_are_null(spark):
    r = labels(spark, [(2, 150.0)], T0 + 7 * HOUR)
    assert r["max_multiple_1h"] is None  # closed, never observed
    assert r["max_multiple_6h"] == 1.5
    assert r["max_multiple_24h"] is None and r["survived_24h"] is None
    assert r["time_to_peak_minutes"] == 120


def test_drawdown_before_earliest_peak_and_floor(spark):
    r = labels(spark, [(1, 40.0), (2, 200.0), (3, 10.0), (4, 200.0), (23, 20.0)], T0 + 25 * HOUR)
    assert r["max_multiple_24h"] == 2.0
    assert r["max_drawdown_before_peak_24h"] == 0.6
    assert r["survived_24h"] is True  # exactly at the floor
    assert r["time_to_peak_minutes"] == 120


def test_rising_path_has_no_drawdown(spark):
    assert labels(spark, [(1, 110.0), (2, 120.0)], T0 + 25 * HOUR)["max_drawdown_before_peak_24h"] == 0.0


def test_no_baseline_no_labels(spark):
    for base in (None, 0.0):
        r = labels(spark, [(1, 110.0)], T0 + 200 * HOUR, base)
        assert all(r[c] is None for c in outcomes.LABEL_COLUMNS)


def test_closed_window_ends_inclusive(spark):
    assert labels(spark, [(1, 130.0)], T0 + HOUR)["max_multiple_1h"] == 1.3


def test_unchanged_labels_are_not_written_again(spark):
    df = spark.createDataFrame([("s", None, 1.5)], "snapshot_id string, a string, max_multiple_1h double")
    full = df.select("snapshot_id", *[
        (F.col(c) if c in df.columns else F.lit(None).cast("double")).alias(c) for c in outcomes.LABEL_COLUMNS
    ])
    stored = full.select(F.lit("l").alias("label_id"), F.lit(1).alias("filled_at_ms"), "*")
    assert outcomes.refresh(full, stored).count() == 0
    assert outcomes.refresh(full.withColumn("max_multiple_6h", F.lit(2.0)), stored).count() == 1
    blank = full.withColumn("max_multiple_1h", F.lit(None).cast("double"))
    assert outcomes.refresh(blank, stored.limit(0)).count() == 0


def test_reprice_ladder(spark):
    rows = [(30, 4), (30, 5), (200, 14), (200, 15), (5000, 359), (5000, 360), (10081, 9999), (10, None)]
    df = spark.createDataFrame(rows, "age bigint, since bigint")
    got = [r[0] for r in df.select(outcomes.due(F.col("age"), F.col("since"))).collect()]
    assert got == [False, True, False, True, False, True, False, True]
