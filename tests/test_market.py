"""Rotation and chart readings against brute force."""

import numpy as np
import pytest

from tidewatch.plans import chart, rotation

HOUR4 = 14_400_000
W = 42


@pytest.fixture(scope="module")
def series():
    rng = np.random.default_rng(7)
    n = 140
    common = rng.normal(0, 0.01, n)
    out = {}
    for k, b in enumerate((1.0, 1.6, 0.5, 1.1)):
        rets = b * common + rng.normal(0, 0.002, n)
        out[f"C{k}"] = 100 * np.exp(np.cumsum(rets))
    return out


@pytest.fixture(scope="module")
def candles(spark, series):
    rows = []
    for coin, px in series.items():
        for i, c in enumerate(px):
            if coin == "C2" and i in (60, 61):
                continue
            rows.append((coin, i * HOUR4, float(c) * 0.999, float(c) * 1.01, float(c) * 0.99, float(c), 10.0 + i % 7))
    return spark.createDataFrame(rows, "coin string, t bigint, o double, h double, l double, c double, v double")


def returns(series):
    out = {}
    for coin, px in series.items():
        r = np.r_[np.nan, np.diff(np.log(px))]
        if coin == "C2":
            r[60:63] = np.nan
        out[coin] = r
    return out


def test_web_recovers_the_planted_beta(spark, series, candles):
    g = rotation.grid(candles, W)
    got = {r["coin"]: r["beta"] for r in rotation.web(g, W).collect()}
    rets = returns(series)
    bench = np.nanmean(np.vstack(list(rets.values())), axis=0)
    for coin, r in rets.items():
        y, x = r[-W:], bench[-W:]
        assert got[coin] == pytest.approx(np.cov(y, x)[0, 1] / np.var(x, ddof=1), rel=1e-6)
    assert got["C1"] > got["C0"] > got["C2"]


@pytest.mark.parametrize("block_coins", [1, 256])
def test_strings_match_pairwise_loop(spark, series, candles, block_coins):
    rets = returns(series)
    got = {r["coin"]: r for r in rotation.strings(rotation.grid(candles, W), W, block_coins).collect()}
    for coin in rets:
        top = weight = 0.0
        strung = 0
        for other in rets:
            if other == coin:
                continue
            y, x = rets[coin][-W:], rets[other][-W:]
            rho = np.corrcoef(y, x)[0, 1]
            if rho < 0.5:
                continue
            s = np.cumsum(y - np.cov(y, x)[0, 1] / np.var(x, ddof=1) * x)
            top += rho * (s[-1] - s.mean()) / s.std(ddof=1)
            weight += rho
            strung += 1
        assert got[coin]["strung"] == strung
        assert got[coin]["score"] == pytest.approx(top / weight, rel=1e-6)


def test_short_history_is_withheld(spark, candles):
    g = rotation.grid(candles.where(f"t >= {60 * HOUR4}"), W)
    assert rotation.rotation(g, W).count() == 0
    assert rotation.web(g, W).count() == 4


def test_ema_gaps_and_warm_up(spark):
    values = [1.0, None, 2.0, 3.0, 4.0]
    df = spark.createDataFrame([("c", i, v) for i, v in enumerate(values)], "coin string, t int, v double")
    got = {r["t"]: r["y"] for r in chart.ema(df, "v", 3, "y").collect()}
    assert got[0] is None and got[1] is None and got[2] is None
    assert got[3] == pytest.approx(0.5 * 3 + 0.5 * 1.5)
    assert got[4] == pytest.approx(0.5 * 4 + 0.5 * got[3])


def test_pivots_are_strict_on_the_left_only(spark):
    highs = [1, 1, 2, 5, 5, 1, 1, 1, 1]
    df = spark.createDataFrame([("c", i, i, 1.0, float(h), 0.5, 1.0) for i, h in enumerate(highs)], "coin string, i int, t int, o double, h double, l double, c double")
    got = [(r["i"], r["kind"]) for r in chart.pivots(df).collect()]
    assert got == [(3, "high")]


def test_boxes_need_three_touches_and_break_on_a_close(spark):
    rows = []
    for i in range(60):
        peak = i % 10 == 5 and i < 40
        base = 10.0 + 0.01 * (i % 3)
        rows.append(("c", i * HOUR4, base, 12.0 if peak else base + 0.5, base - 0.5, base, 1.0))
    rows[50] = ("c", 50 * HOUR4, 13.0, 13.5, 12.9, 13.2, 1.0)
    df = spark.createDataFrame(rows, "coin string, t bigint, o double, h double, l double, c double, v double")
    drawn = chart.boxes(chart.newest_bars(df, "4h", 60)).where("side = 'SELL'").collect()
    assert len(drawn) == 1
    box = drawn[0]
    assert box["touches"] == 4 and box["start"] == 5 and box["state"] == "BROKEN" and box["end"] == 50
