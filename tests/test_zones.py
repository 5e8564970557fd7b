"""Zones and medians do not depend on how a series is cut, and equal a plain walk."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import medians
from tidewatch.plans import chart, zones

SCHEMA = "coin string, i int, t int, o double, h double, l double, c double"


def series(seed, coin, n, drift=0.0):
    chance, price, rows = random.Random(seed), 100.0, []
    for i in range(n):
        price *= 1 + chance.gauss(drift, 0.02)
        high, low = price * (1 + chance.random() / 40), price * (1 - chance.random() / 40)
        close = None if chance.random() < 0.02 else round(chance.uniform(low, high), 2)
        opened = chance.choice([None, 0.0, *[round(chance.uniform(low, high), 2)] * 8])
        rows.append((coin, i, i, opened, round(high, 2), round(low, 2), close))
    return rows


def plain_zones(rows):
    """Bar by bar: closes break zones, then the bar's own swing comes back to one or opens one."""
    tol = statistics.median([h - l for *_, h, l, _ in rows if h > l])
    live, out, marks = [], [], []
    for n, (coin, i, _, o, h, l, c) in enumerate(rows):
        if c is None:
            continue
        for z in [z for z in live if z["sign"] * c > z["outer"]]:
            live.remove(z)
            out.append((z, i, "BROKEN"))
        around = rows[max(0, n - 3) : n + 4]
        if len(around) < 7:
            continue
        highs, lows = [r[4] for r in around], [r[5] for r in around]
        for sign, here in ((1, h > max(highs[:3]) and h >= max(highs[4:])), (-1, l < min(lows[:3]) and l <= min(lows[4:]))):
            if not here:
                continue
            price = sign * (h if sign > 0 else l)
            inner, outer = max(sign * (o or c), sign * c), price
            if sign > 0:
                inner = min(inner, outer - tol / 2)
            else:
                outer = max(outer, inner + tol / 2)
            for z in live:
                if (
                    z["sign"] == sign
                    and z["inner"] - tol <= price <= z["outer"] + tol
                    and max(z["outer"], outer) - min(z["inner"], inner) <= 3 * tol
                ):
                    z["outer"], z["inner"] = max(z["outer"], outer), min(z["inner"], inner)
                    z["marks"].append((i, sign * price))
                    break
            else:
                live.append({"sign": sign, "outer": outer, "inner": inner, "start": i, "marks": []})
    out += [(z, rows[-1][1], "SELL" if z["sign"] > 0 else "BUY") for z in live]
    for z, end, state in out:
        if len(z["marks"]) >= 2:
            a, b = z["sign"] * z["outer"], z["sign"] * z["inner"]
            marks.append((rows[0][0], "SELL" if z["sign"] > 0 else "BUY", max(a, b), min(a, b), z["start"], end, len(z["marks"]) + 1, state, tuple(z["marks"])))
    return marks


@pytest.fixture(scope="module")
def rows():
    return {c: series(s, c, n, d) for s, c, n, d in ((1, "hot", 2700, 0.0), (2, "up", 200, 0.01), (3, "flat", 100, 0.0))}


@pytest.mark.parametrize("stretch, chunk", [(4096, 512), (64, 32), (16, 16)])
def test_zones_equal_a_plain_walk_for_a_coin_with_most_bars(spark, rows, monkeypatch, stretch, chunk):
    monkeypatch.setattr(zones, "STRETCH", stretch)
    monkeypatch.setattr(chart, "CHUNK", chunk)
    walked, walk = [], zones._walked
    monkeypatch.setattr(zones, "_walked", lambda steps, seeds: walked.append(walk(steps, seeds)) or walked[-1])
    bars = spark.createDataFrame([r for s in rows.values() for r in s], SCHEMA)
    got = chart.zones(bars).collect()
    got = sorted((r.coin, r.side, r.top, r.bottom, r.start, r.end, r.touches, r.state, tuple((m.i, m.price) for m in r.marks)) for r in got)
    want = sorted(z for s in rows.values() for z in plain_zones(s))
    assert len(want) > 20 and [g[:2] + g[4:8] for g in got] == [w[:2] + w[4:8] for w in want]
    for g, w in zip(got, want):
        assert g[2:4] == pytest.approx(w[2:4]) and [m[0] for m in g[8]] == [m[0] for m in w[8]]
    # A stretch holds its own bars at most, and rounds are few beside the stretches.
    sizes = chart.extremes(chart._swings(bars).where("c is not null")).groupBy("coin", F.floor(F.col("i") / stretch)).count()
    assert sizes.agg(F.max("count")).first()[0] <= stretch
    assert len(walked) <= 1 + (2700 // stretch) // 3


def test_a_stretch_is_walked_again_only_if_its_seed_changed():
    at = {"coin": "c", "tol": 1.0, "close_up": 10.0, "close_down": -9.0, "high_from": 10.0, "high_to": 11.0, "low_from": None, "low_to": None}
    far = {"sign": 1, "start": 0, "outer": 50.0, "inner": 49.0, "touches": 1}
    near = {"sign": 1, "start": 1, "outer": 11.0, "inner": 10.5, "touches": 1}
    first = at | {"stretch": 0, "seed": [], "standing": [far, near]}
    second = at | {"stretch": 1, "seed": [], "standing": []}
    out = zones.carry([second, first])
    assert [(r["stretch"], r["changed"]) for r in out] == [(0, False), (1, True), (None, False)]
    assert out[1]["seed"] == [near] and far in out[2]["seed"]
    assert not any(r["changed"] for r in zones.carry([first, second | {"seed": [near]}]))


@pytest.mark.parametrize("room, bins", [(65_536, 4096), (4, 3), (1, 2)])
def test_medians_are_exact_whatever_room_there_is(spark, room, bins):
    chance, rows = random.Random(8), []
    for key, n in (("hot", 900), ("even", 10), ("one", 1), (None, 7), ("same", 60), ("none", 0)):
        rows += [(key, chance.choice([chance.gauss(0, 1), chance.gauss(0, 1e9), 3.25 if key != "same" else 7.0])) for _ in range(n)]
    rows = [(k, 7.0 if k == "same" else v) for k, v in rows] + [("none", None), ("hot", float("nan"))]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: r.m for r in medians.medians(df, ["k"], F.col("v"), "m", bins, room).collect()}
    want = {k: statistics.median([v for q, v in rows if q == k and v is not None and v == v]) for k in ("hot", "even", "one", None, "same")}
    assert got == pytest.approx(want)
