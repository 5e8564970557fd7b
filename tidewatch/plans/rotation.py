"""Relative rotation, richness, pair spreads and liquidity over candles.

The grid covers all bars; each reading filters the newest bars it needs, so what it does per
instrument has a fixed number of rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.chains import lookup
from tidewatch.operators.ordered import row_numbers
from tidewatch.session import durable
from tidewatch.sources.candles import impact_spread_bps, notional, open_interest_usd

# Coverage and label thresholds, tail length and read-on windows.
MIN_COVERAGE = 0.9
WEB_AT = 1.0
LEAN_AT, STRETCHED_AT = 1.0, 2.0
MIN_CORR = 0.5
HOT_AT, THIN_AT = 1.5, 0.67
TAIL = 6
DAY_MS = 86_400_000
#: Bar times of a stretch of the grid; coins of a block of pair spreads.
STRETCH, BLOCK_COINS = 512, 256
READ_ON = {"15m": 96, "1h": 48, "4h": 42, "1d": 30}
QUADRANTS = ("LEADING", "WEAKENING", "LAGGING", "IMPROVING")
# One phrase per (richness, quadrant).
PHRASES = {
    "rich LEADING": "the premium still chased",
    "rich WEAKENING": "the premium paid, the chase tiring",
    "rich IMPROVING": "rich past its beta while the ratio turns up from behind",
    "rich LAGGING": "rich past its beta, losing on the ratio",
    "cheap LEADING": "cheap past its beta, winning on the ratio",
    "cheap WEAKENING": "cheap past its beta, the lead fading",
    "cheap IMPROVING": "the discount being bid back",
    "cheap LAGGING": "the discount still being sold",
    "fair LEADING": "in line with its beta, out in front",
    "fair WEAKENING": "in line with its beta, the lead fading",
    "fair IMPROVING": "in line with its beta, turning up",
    "fair LAGGING": "in line with its beta, falling behind",
}


def momentum_lag(window: int) -> int:
    return max(2, window // 6)


def recent_bars(window: int) -> int:
    return max(1, window // 8)


def bars_needed(window: int) -> int:
    return 2 * window + momentum_lag(window) + TAIL


def choose_names(contexts: DataFrame, n: int, per: list[str] = ()) -> DataFrame:
    """The n assets that traded most money, of each ``per`` if given; unknown volume is left out."""
    known = contexts.where("day_ntl_vlm is not null")
    ranked = row_numbers(known, list(per), [F.desc("day_ntl_vlm"), F.col("coin")], "_nth")
    return ranked.where(F.col("_nth") <= n).drop("_nth")


def grid(candles: DataFrame, window: int) -> DataFrame:
    """Every coin on the union of all bar times, gaps null: (coin, i, t, o, c, money, ret, bench).

    ``i`` counts backwards from 0, the newest bar; ``n_bars`` is the number of bar times. Readings
    take the bars they need by ``i``; a time range is the caller's filter on ``candles``. Coins and
    times meet in stretches of times, and a stretch carries the bar before it, so a return needs no
    other stretch.
    """
    times = row_numbers(candles.select("t").distinct(), [], [F.desc("t")], "i").withColumn("i", F.col("i") - 1)
    offered = times.agg(F.max("i")).first()[0]
    n_bars = 0 if offered is None else offered + 1
    home = F.floor(F.col("i") / STRETCH)
    # The bar before the oldest of a stretch is the newest of the next one.
    edge = F.when((F.col("i") % STRETCH == 0) & (F.col("i") > 0), home - 1)
    slots = times.withColumn("_stretch", F.explode(F.array_compact(F.array(home, edge))))
    coins = candles.select("coin").distinct().withColumn(
        "_stretch", F.explode(F.sequence(F.lit(0), F.lit(max(0, n_bars - 1) // STRETCH)))
    )
    frame = coins.join(slots, "_stretch").withColumn("n_bars", F.lit(n_bars).cast("bigint"))
    joined = frame.join(candles, ["coin", "t"], "left")
    by_coin = Window.partitionBy("coin", "_stretch").orderBy("t")
    close = F.when(F.col("c") > 0, F.col("c"))
    rows = joined.select(
        "coin",
        "_stretch",
        "i",
        "t",
        "n_bars",
        F.when(F.col("o") > 0, F.col("o")).alias("o"),
        close.alias("c"),
        notional().alias("money"),
    ).withColumn("ret", F.log(F.try_divide(F.col("c"), F.lag("c").over(by_coin))))
    rows = rows.where(F.col("_stretch") == F.floor(F.col("i") / STRETCH)).drop("_stretch")
    per_bar = rows.groupBy("i").agg(
        F.avg("ret").alias("_mean"), F.count("ret").alias("_present"), F.count("*").alias("_members")
    )
    quorum = F.when(
        F.col("_members") > 1, F.greatest(F.lit(2), F.ceil(F.col("_members") / 2))
    ).otherwise(1)
    bench = per_bar.select("i", F.when(F.col("_present") >= quorum, F.col("_mean")).alias("bench"))
    return rows.join(bench, "i")


def coverage(*columns: str) -> Column:
    """Share of rows in which all the columns are known."""
    hit = F.lit(True)
    for c in columns:
        hit = hit & F.col(c).isNotNull()
    return F.count_if(hit) / F.count("*")


def _rolling_z(value: str, window: int) -> Column:
    w = Window.partitionBy("coin").orderBy(F.desc("i")).rowsBetween(-(window - 1), 0)
    sd = F.stddev_samp(value).over(w)
    z = F.when(sd == 0, 0.0).otherwise((F.col(value) - F.avg(value).over(w)) / sd)
    return F.when((F.count(value).over(w) == window) & (F.count("*").over(w) == window), z)


def quadrant(ratio: Column, momentum: Column) -> Column:
    ahead = F.when(momentum >= 100, "LEADING").otherwise("WEAKENING")
    behind = F.when(momentum >= 100, "IMPROVING").otherwise("LAGGING")
    return F.when(ratio.isNotNull() & momentum.isNotNull(), F.when(ratio >= 100, ahead).otherwise(behind))


def levels(g: DataFrame, window: int) -> DataFrame:
    """Per bar: relative level rs, its rolling z as ratio, the lagged change and momentum.

    Coins with thin coverage are left out. A bar without a print adds nothing to the level.
    """
    lag, need = momentum_lag(window), bars_needed(window)
    rows = g.where((F.col("i") < need) & (F.col("n_bars") >= need)).withColumn("rel", F.col("ret") - F.col("bench"))
    ok = rows.groupBy("coin").agg(coverage("rel").alias("_c")).where(F.col("_c") >= MIN_COVERAGE)
    rows = rows.join(ok.select("coin"), "coin", "left_semi")
    forward = Window.partitionBy("coin").orderBy(F.desc("i"))
    level = F.sum(F.coalesce("rel", F.lit(0.0))).over(forward.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("rs", level)
    rows = rows.withColumn("ratio", 100.0 + _rolling_z("rs", window))
    rows = rows.withColumn("change", F.col("ratio") - F.lag("ratio", lag).over(forward))
    return rows.withColumn("momentum", 100.0 + _rolling_z("change", window))


def rotation(g: DataFrame, window: int) -> DataFrame:
    """(coin, ratio, momentum, quadrant, tail); coins with thin coverage have no row."""
    rows = levels(g, window)
    point = F.struct((-F.col("i")).alias("k"), F.round("ratio", 3).alias("r"), F.round("momentum", 3).alias("m"))
    return (
        rows.groupBy("coin")
        .agg(
            F.max(F.when(F.col("i") == 0, F.col("ratio"))).alias("ratio"),
            F.max(F.when(F.col("i") == 0, F.col("momentum"))).alias("momentum"),
            F.transform(
                F.sort_array(F.collect_list(F.when(F.col("i") < TAIL, point))), lambda p: F.struct(p["r"], p["m"])
            ).alias("tail"),
        )
        .withColumn("quadrant", quadrant(F.col("ratio"), F.col("momentum")))
    )


def web_label(z: Column) -> Column:
    return F.when(z >= WEB_AT, "rich").when(z <= -WEB_AT, "cheap").when(z.isNotNull(), "fair")


def web(g: DataFrame, window: int) -> DataFrame:
    """(coin, beta, z, label): drift of the beta-adjusted return in standard errors."""
    rows = g.where((F.col("i") < window) & (F.col("n_bars") >= window))
    known = F.col("ret").isNotNull() & F.col("bench").isNotNull()
    fit = rows.groupBy("coin").agg(
        coverage("ret", "bench").alias("_c"),
        F.count_if(known).alias("_n"),
        F.covar_samp("ret", "bench").alias("_cov"),
        F.var_samp(F.when(known, F.col("bench"))).alias("_var"),
    )
    slopes = fit.where((F.col("_c") >= MIN_COVERAGE) & (F.col("_n") >= 3) & (F.col("_var") > 0)).select(
        "coin", (F.col("_cov") / F.col("_var")).alias("beta")
    )
    resid = F.col("ret") - F.col("beta") * F.col("bench")
    drift = (
        rows.where(known)
        .join(slopes, "coin")
        .withColumn("_r", resid)
        .groupBy("coin", "beta")
        .agg(F.sum("_r").alias("_sum"), F.stddev_samp("_r").alias("_sd"), F.count("*").alias("_n"))
    )
    z = F.col("_sum") / (F.col("_sd") * F.sqrt(F.col("_n").cast("double")))
    return drift.where(F.col("_sd") > 0).select("coin", "beta", z.alias("z")).withColumn("label", web_label(F.col("z")))


def strings_label(score: Column) -> Column:
    side = F.when(score > 0, "rich").otherwise("cheap")
    return (
        F.when(F.abs(score) >= STRETCHED_AT, F.concat(F.lit("stretched "), side))
        .when(F.abs(score) >= LEAN_AT, side)
        .when(score.isNotNull(), "slack")
    )


def _pull_block(left: pd.DataFrame, right: pd.DataFrame, window: int) -> list[dict]:
    """Partial strings of every left coin against one block of partners. Emits no pairs."""
    r = np.array(right["ret"].tolist(), dtype=float)
    names = right["coin"].to_numpy()
    out = []
    for coin, series in zip(left["coin"], left["ret"]):
        y = np.array(series, dtype=float)
        both = ~np.isnan(y)[None, :] & ~np.isnan(r)
        n = both.sum(axis=1)
        ys = np.where(both, y[None, :], 0.0)
        xs = np.where(both, r, 0.0)
        with np.errstate(divide="ignore", invalid="ignore"):
            my, mx = ys.sum(1) / n, xs.sum(1) / n
            dy = np.where(both, y[None, :] - my[:, None], 0.0)
            dx = np.where(both, r - mx[:, None], 0.0)
            cov = (dy * dx).sum(1) / (n - 1)
            vy, vx = (dy**2).sum(1) / (n - 1), (dx**2).sum(1) / (n - 1)
            corr = cov / np.sqrt(vy * vx)
            spread = np.cumsum(np.where(both, ys - (cov / vx)[:, None] * xs, 0.0), axis=1)
            ms = np.where(both, spread, 0.0).sum(1) / n
            sd = np.sqrt(np.where(both, (spread - ms[:, None]) ** 2, 0.0).sum(1) / (n - 1))
            z = np.where(sd == 0, 0.0, (spread[:, -1] - ms) / sd)
        use = (names != coin) & (n >= MIN_COVERAGE * window) & (n >= 3) & (vx > 0) & (vy > 0)
        use &= np.nan_to_num(corr) >= MIN_CORR
        if not use.any():
            continue
        # The tautest of equals is the first partner by name.
        best = min(np.flatnonzero(use), key=lambda k: (-abs(z[k]), names[k]))
        out.append(
            {
                "coin": coin,
                "top": float((corr[use] * z[use]).sum()),
                "weight": float(corr[use].sum()),
                "strung": int(use.sum()),
                "partner": names[best],
                "partner_z": float(z[best]),
                "partner_corr": float(corr[best]),
            }
        )
    return out


def strings(g: DataFrame, window: int, block_coins: int = BLOCK_COINS) -> DataFrame:
    """(coin, score, label, strung, tautest partner) from correlation-weighted pair spreads.

    One row per coin holds its window of returns. Coins fall into blocks by hash, as many as keep a
    block near ``block_coins`` coins; every pair of blocks is one task, and each task returns one
    partial row per coin, never the pairs.
    """
    rows = g.where((F.col("i") < window) & (F.col("n_bars") >= window))
    by_time = F.sort_array(F.collect_list(F.struct((-F.col("i")).alias("k"), "ret")))
    vectors = rows.groupBy("coin").agg(
        F.transform(by_time, lambda p: F.coalesce(p["ret"], F.lit(float("nan")))).alias("ret")
    )
    vectors = durable(vectors)
    blocks = max(1, -(-vectors.count() // block_coins))
    home = vectors.withColumn("_b", F.pmod(F.xxhash64("coin"), F.lit(blocks)).cast("int"))
    others = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = home.select(F.col("_b").alias("bi"), others.alias("bj"), F.lit(0).alias("side"), "coin", "ret")
    right = home.select(others.alias("bi"), F.col("_b").alias("bj"), F.lit(1).alias("side"), "coin", "ret")

    def pull(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        got = _pull_block(a, b, window) if len(a) and len(b) else []
        return pd.DataFrame(
            got, columns=["coin", "top", "weight", "strung", "partner", "partner_z", "partner_corr"]
        )

    partial = left.unionByName(right).groupBy("bi", "bj").applyInPandas(
        pull,
        "coin string, top double, weight double, strung bigint, partner string, partner_z double, partner_corr double",
    )
    best = F.min_by(
        F.struct("partner", "partner_z", "partner_corr"), F.struct(-F.abs(F.col("partner_z")), F.col("partner"))
    )
    return (
        partial.groupBy("coin")
        .agg(
            (F.sum("top") / F.sum("weight")).alias("score"),
            F.sum("strung").alias("strung"),
            best.alias("_t"),
        )
        .select("coin", "score", strings_label(F.col("score")).alias("label"), "strung", "_t.*")
    )


def agreement(web_z: Column, web_side: Column, score: Column) -> Column:
    """agree / disagree when both readings lean; null when either is neutral or missing."""
    lean = (web_side != "fair") & (F.abs(score) >= LEAN_AT)
    return F.when(lean, F.when((web_z > 0) == (score > 0), "agree").otherwise("disagree"))


def liquidity(g: DataFrame, window: int) -> DataFrame:
    """(coin, rel, label): mean money of the last bars over the median of the window before."""
    k = recent_bars(window)
    rows = g.where((F.col("i") < window + k) & (F.col("n_bars") >= window + k))
    recent, base = F.col("i") < k, F.col("i") >= k
    stats = rows.groupBy("coin").agg(
        F.avg(F.when(recent, F.col("money"))).alias("_now"),
        F.count(F.when(recent, F.col("money"))).alias("_nk"),
        F.median(F.when(base, F.col("money"))).alias("_typical"),
        F.count(F.when(base, F.col("money"))).alias("_nb"),
    )
    ok = (F.col("_nk") >= k) & (F.col("_nb") >= MIN_COVERAGE * window) & (F.col("_typical") > 0)
    rel = F.col("_now") / F.col("_typical")
    label = F.when(rel >= HOT_AT, "HOT").when(rel <= THIN_AT, "thin").otherwise("normal")
    return stats.where(ok).select("coin", rel.alias("rel"), label.alias("label"))


def session_change(candles: DataFrame) -> DataFrame:
    """(coin, price, session_pct): newest close over the open of its UTC day's first bar.

    The first bar is the group's: a coin that missed it has no session change.
    """
    day = F.col("t") - F.col("t") % DAY_MS
    closes = candles.where("c > 0").groupBy("coin").agg(
        F.max_by("c", "t").alias("price"), F.max("t").alias("_last")
    )
    closes = closes.withColumn("_day", F.col("_last") - F.col("_last") % DAY_MS)
    opening = candles.groupBy(day.alias("_day")).agg(F.min("t").alias("_open_t"))
    opens = candles.where("o > 0").select("coin", F.col("t").alias("_open_t"), F.col("o").alias("_open"))
    return (
        closes.join(opening, "_day")
        .join(opens, ["coin", "_open_t"], "left")
        .select("coin", "price", (F.col("price") / F.col("_open") - 1.0).alias("session_pct"))
    )


def carpet(candles: DataFrame, contexts: DataFrame, window: int, group_label: str) -> DataFrame:
    """One row per name of ``contexts`` with all readings, its sentence, and why it could not be placed.

    A name without candles keeps its row. The grid is cut to the bars that readings take and kept
    once; each reading is a narrow aggregate over it.
    """
    g = durable(grid(candles, window).where(F.col("i") < bars_needed(window) + 1))
    rot = rotation(g, window).select("coin", "ratio", "momentum", "quadrant", "tail")
    w = web(g, window).select("coin", F.col("z").alias("web_z"), "beta", F.col("label").alias("web_label"))
    st = strings(g, window).select(
        "coin", F.col("score").alias("strings_score"), F.col("label").alias("strings_label"), "strung", "partner"
    )
    liq = liquidity(g, window).select("coin", F.col("rel").alias("liquidity_rel"), F.col("label").alias("liquidity_label"))
    out = contexts.select(
        "coin",
        F.col("day_ntl_vlm").alias("money_usd"),
        F.round(open_interest_usd(), 2).alias("oi_usd"),
        F.col("funding").alias("funding_hourly"),
        F.round(impact_spread_bps(), 2).alias("impact_bps"),
    )
    traded = candles.select("coin").distinct().withColumn("_traded", F.lit(True))
    for part in (traded, session_change(candles), rot, w, st, liq):
        out = out.join(part, "coin", "left")
    loud = F.when(F.col("liquidity_label") != "normal", F.concat("liquidity_label", F.lit(" liquidity")))
    lead = F.concat(F.upper("web_label"), F.lit(f" to {group_label}"))
    phrase = lookup(PHRASES, F.concat_ws(" ", "web_label", "quadrant"))
    placed = F.col("quadrant").isNotNull() & F.col("web_label").isNotNull()
    return (
        out.withColumn("agreement", agreement(F.col("web_z"), F.col("web_label"), F.col("strings_score")))
        .withColumn(
            "reading", F.when(placed, F.concat(F.concat_ws(" · ", lead, loud, "quadrant"), F.lit(" — "), phrase))
        )
        .withColumn(
            "unread_reason",
            F.when(F.col("_traded").isNull(), "no candles returned").when(
                F.col("quadrant").isNull(), "not enough bars in the window to place it"
            ),
        )
        .drop("_traded")
    )


def by_money(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.desc(F.coalesce("money_usd", F.lit(0.0))), "coin")


def money_by_quadrant(rows: DataFrame) -> DataFrame:
    """Share of money and count of names per quadrant; empty quadrants keep their row."""
    placed = rows.where("quadrant is not null and money_usd > 0")
    per = placed.groupBy("quadrant").agg(F.sum("money_usd").alias("_m"), F.count("*").alias("names"))
    all_ = rows.sparkSession.createDataFrame([(q,) for q in QUADRANTS], "quadrant string")
    # Four rows: the total is a window over them.
    total = F.sum("_m").over(Window.partitionBy())
    right = F.sum(F.when(F.col("quadrant").isin("LEADING", "WEAKENING"), F.col("_m"))).over(Window.partitionBy())
    return all_.join(per, "quadrant", "left").select(
        "quadrant",
        F.coalesce("names", F.lit(0)).alias("names"),
        F.round(F.coalesce(F.try_divide("_m", total), F.lit(0.0)), 4).alias("share"),
        F.round(F.coalesce(F.try_divide(right, total), F.lit(0.0)), 4).alias("right_share"),
    )


def chips(rows: DataFrame, group_label: str) -> DataFrame:
    """Names crossing sides with a rich or cheap reading behind them, in reading order."""
    pulled = F.when(
        F.col("agreement").isNotNull(),
        F.concat(F.lit("the strings "), "agreement", F.lit(" (tautest vs "), "partner", F.lit(")")),
    )
    loud = F.when(F.col("liquidity_label") != "normal", F.concat("liquidity_label", F.lit(" liquidity")))
    lead = F.concat(F.upper("web_label"), F.lit(f" to {group_label}"))
    picked = rows.where(F.col("quadrant").isin("IMPROVING", "WEAKENING") & (F.col("web_label") != "fair"))
    return picked.select(
        "coin", "quadrant", "web_label", F.concat_ws(" · ", lead, pulled, loud, "quadrant").alias("text")
    ).orderBy(F.col("quadrant") != "WEAKENING", F.col("web_label") != "rich", "coin")
