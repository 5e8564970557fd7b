"""Results do not depend on how a series is cut, and groups named null are kept."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tidewatch.catalog import inputs
from tidewatch.operators import mindshare, stats
from tidewatch.plans import chart, rotation

HOUR4 = 14_400_000


@pytest.fixture(scope="module")
def hot(spark):
    """One coin holds most rows; some values are missing."""
    chance, rows = random.Random(4), []
    for coin, n in (("hot", 400), ("b", 30), ("c", 7)):
        price = 100.0
        for i in range(n):
            price *= 1 + chance.uniform(-0.03, 0.03)
            c = None if chance.random() < 0.03 else price
            rows.append((coin, i * HOUR4, price * 0.99, price * (1 + chance.random() / 50), price * (1 - chance.random() / 50), c, chance.choice([5.0, 6.0, 20.0])))
    return spark.createDataFrame(rows, "coin string, t bigint, o double, h double, l double, c double, v double")


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_chart_studies_do_not_depend_on_stretches(hot, monkeypatch):
    def studies():
        bars = chart.numbered(hot)
        pivots = chart.pivots(bars)
        return [rows_of(x) for x in (pivots, chart.sweeps(pivots), chart.heat(bars), chart.zones(bars))]

    whole = studies()
    monkeypatch.setattr(chart, "CHUNK", 64)
    assert studies() == whole and all(whole[:3])


@pytest.mark.parametrize("span", [1, 2, 9, 20])
def test_ema_is_the_plain_recursion(hot, monkeypatch, span):
    monkeypatch.setattr(chart, "STRETCH", 16)
    got = {(r.coin, r.t): r.y for r in chart.ema(hot, "c", span, "y").collect()}
    alpha = 2 / (span + 1)
    for coin in ("hot", "b", "c"):
        state, seen = None, 0
        for r in hot.where(F.col("coin") == coin).orderBy("t").collect():
            if r.c is not None:
                state, seen = r.c if state is None else alpha * r.c + (1 - alpha) * state, seen + 1
            want = state if r.c is not None and seen >= span else None
            assert got[coin, r.t] == (None if want is None else pytest.approx(want, rel=1e-9))


def test_grid_covers_all_bars_whatever_its_stretches(hot, monkeypatch):
    whole = rows_of(rotation.grid(hot, 42))
    assert len(whole) == 3 * 400
    monkeypatch.setattr(rotation, "STRETCH", 16)
    assert rows_of(rotation.grid(hot, 42)) == whole


def test_a_chart_request_out_of_range_is_refused(hot):
    with pytest.raises(ValueError):
        chart.newest_bars(hot, "4h", 10)
    assert chart.newest_bars(hot, "4h", 50).groupBy("coin").count().where("coin = 'hot'").first()["count"] == 50


def test_many_coins_keep_blocks_small(spark):
    n = 2000
    g = spark.range(n).select(F.concat(F.lit("k"), "id").alias("coin"), F.explode(F.sequence(F.lit(0), F.lit(9))).alias("i"))
    g = g.withColumns({"n_bars": F.lit(10), "ret": F.sin(F.col("i") + F.length("coin")) + F.rand(3) / 10})
    got = rotation.strings(g, 10)
    assert got.count() > 0
    assert -(-n // rotation.BLOCK_COINS) == 8


def test_null_groups_are_kept(spark):
    rows = [(i, i % 2, float(i), "a" if i % 3 else None) for i in range(60)]
    df = spark.createDataFrame(rows, "id bigint, label bigint, score double, g string")
    lifts = stats.decile_lift(df, ["g"], [F.col("score").desc(), F.col("id")])
    assert {r.g for r in lifts.collect()} == {"a", None}
    split = stats.time_split(df, "score", "id", ["g"])
    assert split.count() == 60 and split.where("g is null and split = 'train'").count() == 14
    polled = df.select(F.col("g").alias("poll_id"), F.col("id").alias("pos"), *[F.col("score").alias(c) for c in mindshare.COMPONENT_WEIGHTS])
    assert mindshare.ranked(polled, "poll_id", "pos").count() == 60


def broadcast_windows(df):
    """Joins on the chunks of windows that broadcast a side, which holds a row per chunk."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "_chunk" in plan
    return re.findall(r"Broadcast\w+Join \[[^\]]*_chunk", plan)


def test_the_day_before_each_snapshot_is_not_broadcast(spark, sf):
    """What the features of the backtest rows read."""
    assert not broadcast_windows(inputs.trailing(spark, sf))


def test_the_windows_of_labels_are_not_broadcast(spark, sf):
    """What the training rows of the fit read: both passes over the price path."""
    assert not broadcast_windows(inputs.labels_job(spark, sf))


def test_the_windows_of_social_readings_are_not_broadcast(spark, sf):
    """What the exit test reads: four windows a snapshot, each in two chunks."""
    assert not broadcast_windows(inputs.social_job(spark, sf))
