"""Rotation and chart queries over the stand-in candles."""

from pyspark.sql import functions as F

from tidewatch.catalog import inputs as I
from tidewatch.catalog import register
from tidewatch.catalog.sql import define
from tidewatch.plans import chart, rotation

W = rotation.READ_ON["4h"]
LAG, NEED, K = rotation.momentum_lag(W), rotation.bars_needed(W), rotation.recent_bars(W)
DIG = 6

# Thin the history so gaps, refusals and nulls appear: some bars are missing, some closes are zero.
define(
    "bar_",
    """SELECT coin, t, CASE WHEN t // 14400000 % 53 <> 0 THEN o END AS o, h, l,
  CASE WHEN t // 14400000 % 61 = 0 AND coin = 'click' THEN 0.0 ELSE c END AS c, v FROM candle_
  WHERE NOT (coin = 'view' AND t // 14400000 % 37 = 0) AND NOT (coin = 'signup' AND t // 14400000 % 7 = 0)""",
)
define(
    "gridt_",
    """SELECT t, row_number() OVER (ORDER BY t DESC) - 1 AS i, count(*) OVER () AS n_all FROM (SELECT DISTINCT t FROM bar_)""",
)
define(
    "grid0_",
    """SELECT c.coin, g.i, g.t, g.n_all AS n_bars, CASE WHEN b.o > 0 THEN b.o END AS o, CASE WHEN b.c > 0 THEN b.c END AS c,
  b.v * (b.h + b.l + b.c) / 3.0::DOUBLE AS money FROM (SELECT DISTINCT coin FROM bar_) c CROSS JOIN gridt_ g
  LEFT JOIN bar_ b ON b.coin = c.coin AND b.t = g.t""",
)
define("grid1_", "SELECT *, ln(c / lag(c) OVER (PARTITION BY coin ORDER BY t)) AS ret FROM grid0_")
define(
    "grid_",
    """SELECT g.*, b.bench FROM grid1_ g JOIN (SELECT i, CASE WHEN count(ret) >= CASE WHEN count(*) > 1 THEN greatest(2, ceil(count(*) / 2)) ELSE 1 END
  THEN avg(ret) END AS bench FROM grid1_ GROUP BY 1) b USING (i)""",
)


def bars(spark, d):
    """Candles with holes: missing bars, a missing open, a zero close."""
    slot = F.floor(F.col("t") / 14_400_000)
    c = I.candles(spark, d)
    gone = ((F.col("coin") == "view") & (slot % 37 == 0)) | ((F.col("coin") == "signup") & (slot % 7 == 0))
    return c.where(~gone).select(
        "coin",
        "t",
        F.when(slot % 53 != 0, F.col("o")).alias("o"),
        "h",
        "l",
        F.when((slot % 61 == 0) & (F.col("coin") == "click"), 0.0).otherwise(F.col("c")).alias("c"),
        "v",
    )


def grid(spark, d):
    return rotation.grid(bars(spark, d), W)


@register(
    "k01_candle_grid",
    f"SELECT coin, i, t, c, round(ret, {DIG}) AS ret, round(bench, {DIG}) AS bench FROM grid_",
)
def k01(spark, d):
    return grid(spark, d).select(
        "coin", F.col("i").cast("bigint").alias("i"), "t", "c", F.round("ret", DIG).alias("ret"), F.round("bench", DIG).alias("bench")
    )


@register(
    "j15_dense_grid_coverage",
    "SELECT coin, count(*) AS slots, count(c) AS filled, count(c) / count(*) AS coverage FROM grid_ GROUP BY 1",
)
def j15(spark, d):
    return grid(spark, d).groupBy("coin").agg(
        F.count("*").alias("slots"), F.count("c").alias("filled"), rotation.coverage("c").alias("coverage")
    )


@register(
    "a18_benchmark_return",
    f"SELECT i, round(any_value(bench), {DIG}) AS bench, count(ret) AS present FROM grid_ GROUP BY 1",
)
def a18(spark, d):
    return grid(spark, d).groupBy(F.col("i").cast("bigint").alias("i")).agg(
        F.round(F.any_value("bench"), DIG).alias("bench"), F.count("ret").alias("present")
    )


@register(
    "a23_coverage",
    f"SELECT coin, count(ret - bench) / count(*) AS coverage FROM grid_ WHERE i < {NEED} GROUP BY 1",
)
def a23(spark, d):
    return grid(spark, d).where(F.col("i") < NEED).groupBy("coin").agg(rotation.coverage("ret", "bench").alias("coverage"))


@register(
    "a19_sample_statistics",
    f"""SELECT coin, count(*) AS n, round(avg(ret), {DIG}) AS mean, round(stddev_samp(ret), {DIG}) AS sd, round(covar_samp(ret, bench), {DIG}) AS cov,
    round(corr(ret, bench), {DIG}) AS corr, round(regr_slope(ret, bench), {DIG}) AS beta FROM grid_ WHERE i < {W} AND ret IS NOT NULL AND bench IS NOT NULL GROUP BY 1""",
)
def a19(spark, d):
    rows = grid(spark, d).where((F.col("i") < W) & F.col("ret").isNotNull() & F.col("bench").isNotNull())
    return rows.groupBy("coin").agg(
        F.count("*").alias("n"),
        F.round(F.avg("ret"), DIG).alias("mean"),
        F.round(F.stddev_samp("ret"), DIG).alias("sd"),
        F.round(F.covar_samp("ret", "bench"), DIG).alias("cov"),
        F.round(F.corr("ret", "bench"), DIG).alias("corr"),
        F.round(F.regr_slope("ret", "bench"), DIG).alias("beta"),
    )


_FWD = "PARTITION BY coin ORDER BY i DESC"


def _z(v: str) -> str:
    w = f"({_FWD} ROWS BETWEEN {W - 1} PRECEDING AND CURRENT ROW)"
    return (
        f"CASE WHEN count({v}) OVER {w} = {W} THEN CASE WHEN stddev_samp({v}) OVER {w} = 0 THEN 0.0::DOUBLE"
        f" ELSE ({v} - avg({v}) OVER {w}) / stddev_samp({v}) OVER {w} END END"
    )


define(
    "rs_",
    f"""SELECT coin, i, sum(coalesce(ret - bench, 0)) OVER ({_FWD} ROWS UNBOUNDED PRECEDING) AS rs FROM grid_ WHERE i < {NEED} AND n_bars >= {NEED}
  AND coin IN (SELECT coin FROM grid_ WHERE i < {NEED} GROUP BY 1 HAVING count(ret - bench) / count(*) >= 0.9)""",
)
define("ratio_", f"SELECT *, 100.0::DOUBLE + {_z('rs')} AS ratio FROM rs_")
define("change_", f"SELECT *, ratio - lag(ratio, {LAG}) OVER ({_FWD}) AS change FROM ratio_")
define("mom_", f"SELECT *, 100.0::DOUBLE + {_z('change')} AS momentum FROM change_")
define(
    "rot_",
    """SELECT coin, ratio, momentum, CASE WHEN ratio >= 100 THEN CASE WHEN momentum >= 100 THEN 'LEADING' ELSE 'WEAKENING' END
  ELSE CASE WHEN momentum >= 100 THEN 'IMPROVING' ELSE 'LAGGING' END END AS quadrant FROM mom_ WHERE i = 0""",
)


@register("w07_log_returns", f"SELECT coin, t, round(ret, {DIG}) AS ret FROM grid_")
def w07(spark, d):
    return grid(spark, d).select("coin", "t", F.round("ret", DIG).alias("ret"))


@register("k02_rotation", f"SELECT coin, round(ratio, {DIG}) AS ratio, round(momentum, {DIG}) AS momentum, quadrant FROM rot_")
def k02(spark, d):
    r = rotation.rotation(grid(spark, d), W)
    return r.select("coin", F.round("ratio", DIG).alias("ratio"), F.round("momentum", DIG).alias("momentum"), "quadrant")


@register(
    "w10_rotation_tail",
    f"SELECT coin, 5 - i AS k, round(ratio, 3) AS r, round(momentum, 3) AS m FROM mom_ WHERE i < {rotation.TAIL}",
)
def w10(spark, d):
    r = rotation.rotation(grid(spark, d), W)
    return r.select("coin", F.posexplode("tail").alias("k", "p")).select(
        "coin", F.col("k").cast("bigint").alias("k"), "p.r", "p.m"
    )


define(
    "web_",
    f"""SELECT coin, beta, sum(r) / (stddev_samp(r) * sqrt(count(*)::DOUBLE)) AS z FROM (SELECT g.coin, f.beta, g.ret - f.beta * g.bench AS r FROM grid_ g JOIN
  (SELECT coin, covar_samp(ret, bench) / var_samp(bench) FILTER (ret IS NOT NULL) AS beta FROM grid_ WHERE i < {W} AND n_bars >= {W} GROUP BY 1
   HAVING count(ret - bench) / count(*) >= 0.9 AND count(ret - bench) >= 3) f USING (coin) WHERE g.i < {W} AND g.ret IS NOT NULL AND g.bench IS NOT NULL)
  GROUP BY 1, 2 HAVING stddev_samp(r) > 0""",
)
define("webl_", "SELECT *, CASE WHEN z >= 1 THEN 'rich' WHEN z <= -1 THEN 'cheap' ELSE 'fair' END AS label FROM web_")


@register("k03_web", f"SELECT coin, round(beta, {DIG}) AS beta, round(z, {DIG}) AS z, label FROM webl_")
def k03(spark, d):
    return rotation.web(grid(spark, d), W).select(
        "coin", F.round("beta", DIG).alias("beta"), F.round("z", DIG).alias("z"), "label"
    )


# The stand-in coins hardly correlate, so the pair queries read returns with a shared driver.
define(
    "pgrid_",
    """SELECT coin, i, t, n_bars, CASE WHEN ret IS NOT NULL THEN ret / 20 + sin(i::DOUBLE) + CASE WHEN coin < 'f' THEN 0.3 * sin(i::DOUBLE * i) ELSE 0 END END AS ret FROM grid_""",
)
define(
    "pair_",
    f"""SELECT a.coin, b.coin AS partner, a.i, a.ret AS y, b.ret AS x FROM pgrid_ a JOIN pgrid_ b ON a.i = b.i AND a.coin <> b.coin
  WHERE a.i < {W} AND a.n_bars >= {W} AND a.ret IS NOT NULL AND b.ret IS NOT NULL""",
)
define(
    "hedge_",
    f"""SELECT coin, partner, corr(y, x) AS rho, covar_samp(y, x) / var_samp(x) AS beta FROM pair_ GROUP BY 1, 2 HAVING count(*) >= 0.9 * {W} AND count(*) >= 3""",
)
define(
    "pull_",
    """SELECT coin, partner, rho, CASE WHEN stddev_samp(s) = 0 THEN 0 ELSE (arg_min(s, i) - avg(s)) / stddev_samp(s) END AS z FROM (SELECT p.*, h.rho,
  sum(y - h.beta * x) OVER (PARTITION BY p.coin, p.partner ORDER BY i DESC ROWS UNBOUNDED PRECEDING) AS s FROM pair_ p JOIN hedge_ h USING (coin, partner)
  WHERE h.rho >= 0.5) GROUP BY 1, 2, 3""",
)
define(
    "str_",
    """SELECT coin, sum(rho * z) / sum(rho) AS score, count(*) AS strung, arg_min(partner, (-abs(z), partner)) AS partner FROM pull_ GROUP BY 1""",
)


def pair_grid(spark, d):
    i = F.col("i").cast("double")
    own = F.when(F.col("coin") < "f", 0.3 * F.sin(i * i)).otherwise(0.0)
    return grid(spark, d).withColumn("ret", F.when(F.col("ret").isNotNull(), F.col("ret") / 20 + F.sin(i) + own))


_STR = "CASE WHEN abs(score) >= 2 THEN 'stretched ' || CASE WHEN score > 0 THEN 'rich' ELSE 'cheap' END WHEN abs(score) >= 1 THEN CASE WHEN score > 0 THEN 'rich' ELSE 'cheap' END ELSE 'slack' END"


@register("k04_strings", f"SELECT coin, round(score, {DIG}) AS score, {_STR} AS label, strung, partner FROM str_")
def k04(spark, d):
    s = rotation.strings(pair_grid(spark, d), W)
    return s.select("coin", F.round("score", DIG).alias("score"), "label", "strung", "partner")


@register(
    "w11_tautest_spread",
    f"SELECT coin, partner, round(z, {DIG}) AS partner_z, round(rho, {DIG}) AS partner_corr FROM pull_ JOIN (SELECT coin, partner FROM str_) USING (coin, partner)",
)
def w11(spark, d):
    s = rotation.strings(pair_grid(spark, d), W)
    return s.select("coin", "partner", F.round("partner_z", DIG).alias("partner_z"), F.round("partner_corr", DIG).alias("partner_corr"))


define(
    "liq_",
    f"""SELECT coin, avg(money) FILTER (i < {K}) / median(money) FILTER (i >= {K}) AS rel FROM grid_ WHERE i < {W + K} AND n_bars >= {W + K} GROUP BY 1
  HAVING count(money) FILTER (i < {K}) >= {K} AND count(money) FILTER (i >= {K}) >= 0.9 * {W} AND median(money) FILTER (i >= {K}) > 0""",
)
define("liql_", "SELECT *, CASE WHEN rel >= 1.5 THEN 'HOT' WHEN rel <= 0.67 THEN 'thin' ELSE 'normal' END AS label FROM liq_")


@register("k05_liquidity", f"SELECT coin, round(rel, {DIG}) AS rel, label FROM liql_")
def k05(spark, d):
    return rotation.liquidity(grid(spark, d), W).select("coin", F.round("rel", DIG).alias("rel"), "label")


define(
    "sess_",
    """SELECT l.coin, l.price, round(l.price / CASE WHEN b.o > 0 THEN b.o END - 1.0, 6) AS session_pct FROM (SELECT coin, arg_max(c, t) AS price, max(t) AS last
  FROM bar_ WHERE c > 0 GROUP BY 1) l JOIN (SELECT t // 86400000 AS day, min(t) AS t0 FROM bar_ GROUP BY 1) f ON f.day = l.last // 86400000
  LEFT JOIN bar_ b ON b.coin = l.coin AND b.t = f.t0""",
)


@register("k06_session_change", "SELECT * FROM sess_")
def k06(spark, d):
    return rotation.session_change(bars(spark, d)).withColumn("session_pct", F.round("session_pct", DIG))


# Every coin has a context; one listed name has no candles.
define(
    "money_",
    """SELECT coin, sum(v) FILTER (t >= 1706486400000) AS day_ntl_vlm, arg_max(c, t) AS mark_px, count(*) AS open_interest FROM candle_ GROUP BY 1
  UNION ALL SELECT 'unlisted', 5.0::DOUBLE, 2.0::DOUBLE, 10""",
)


def contexts(spark, d):
    per = I.candles(spark, d).groupBy("coin").agg(
        F.sum(F.when(F.col("t") >= 1706486400000, F.col("v"))).alias("day_ntl_vlm"),
        F.max_by("c", "t").alias("mark_px"),
        F.count("*").cast("double").alias("open_interest"),
    )
    unlisted = spark.range(1).select(
        F.lit("unlisted").alias("coin"), F.lit(5.0).alias("day_ntl_vlm"), F.lit(2.0).alias("mark_px"), F.lit(10.0).alias("open_interest")
    )
    return per.unionByName(unlisted).withColumns(
        {"funding": F.lit(0.00125), "impact_bid": F.col("mark_px") - 0.25, "impact_ask": F.col("mark_px") + 0.25}
    )


_PHRASE = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in rotation.PHRASES.items())
define(
    "carpet_",
    f"""SELECT m.coin, s.price, s.session_pct, m.day_ntl_vlm AS money_usd, round(m.open_interest * m.mark_px, 2) AS oi_usd, 0.00125::DOUBLE AS funding_hourly,
  round(((m.mark_px + 0.25) - (m.mark_px - 0.25)) / m.mark_px * 10000, 2) AS impact_bps,
  CASE WHEN s.coin IS NULL THEN 'no candles returned' WHEN r.quadrant IS NULL THEN 'not enough bars in the window to place it' END AS unread_reason, r.ratio, r.momentum, r.quadrant, w.z AS web_z, w.label AS web_label,
  q.label AS liquidity_label, CASE WHEN r.quadrant IS NOT NULL AND w.label IS NOT NULL THEN concat_ws(' · ', upper(w.label) || ' to Group',
    CASE WHEN q.label <> 'normal' THEN q.label || ' liquidity' END, r.quadrant) || ' — ' || CASE w.label || ' ' || r.quadrant {_PHRASE} END END AS reading
  FROM money_ m LEFT JOIN sess_ s USING (coin) LEFT JOIN rot_ r USING (coin) LEFT JOIN webl_ w USING (coin) LEFT JOIN liql_ q USING (coin)""",
)


def carpet(spark, d):
    return rotation.carpet(bars(spark, d), contexts(spark, d), W, "Group")


@register(
    "k07_carpet",
    f"""SELECT coin, price, session_pct, money_usd, oi_usd, funding_hourly, impact_bps, round(ratio, {DIG}) AS ratio, quadrant, round(web_z, {DIG}) AS web_z,
    web_label, liquidity_label, reading, unread_reason FROM carpet_""",
)
def k07(spark, d):
    return carpet(spark, d).select(
        "coin", "price", F.round("session_pct", DIG).alias("session_pct"), "money_usd", "oi_usd", "funding_hourly",
        "impact_bps", F.round("ratio", DIG).alias("ratio"), "quadrant", F.round("web_z", DIG).alias("web_z"), "web_label", "liquidity_label", "reading", "unread_reason",
    )


@register(
    "k08_cross_money",
    """SELECT q.quadrant, coalesce(p.names, 0) AS names, round(coalesce(p.m / t.total, 0), 4) AS share, round(coalesce(t.right_money / t.total, 0), 4) AS right_share
    FROM (VALUES ('LEADING'), ('WEAKENING'), ('LAGGING'), ('IMPROVING')) q(quadrant) LEFT JOIN (SELECT quadrant, count(*) AS names, sum(money_usd) AS m FROM carpet_
    WHERE quadrant IS NOT NULL AND money_usd > 0 GROUP BY 1) p USING (quadrant) CROSS JOIN (SELECT sum(money_usd) AS total, coalesce(sum(money_usd) FILTER
    (quadrant IN ('LEADING', 'WEAKENING')), 0) AS right_money FROM carpet_ WHERE quadrant IS NOT NULL AND money_usd > 0) t""",
)
def k08(spark, d):
    return rotation.money_by_quadrant(carpet(spark, d))


@register(
    "a15_quadrant_counts",
    "SELECT quadrant, count(*) AS n, sum(money_usd) AS money FROM carpet_ WHERE quadrant IS NOT NULL GROUP BY 1",
)
def a15(spark, d):
    return carpet(spark, d).where("quadrant is not null").groupBy("quadrant").agg(
        F.count("*").alias("n"), F.sum("money_usd").alias("money")
    )


@register(
    "f17_reading_labels",
    """SELECT pos, CASE WHEN r >= 100 THEN CASE WHEN m >= 100 THEN 'LEADING' ELSE 'WEAKENING' END ELSE CASE WHEN m >= 100 THEN 'IMPROVING' ELSE 'LAGGING' END END AS quadrant,
    CASE WHEN z >= 1 THEN 'rich' WHEN z <= -1 THEN 'cheap' ELSE 'fair' END AS web_label, CASE WHEN abs(s) >= 2 THEN 'stretched ' || CASE WHEN s > 0 THEN 'rich' ELSE 'cheap' END
    WHEN abs(s) >= 1 THEN CASE WHEN s > 0 THEN 'rich' ELSE 'cheap' END ELSE 'slack' END AS strings_label, CASE WHEN abs(z) >= 1 AND abs(s) >= 1 THEN
    CASE WHEN (z > 0) = (s > 0) THEN 'agree' ELSE 'disagree' END END AS agreement FROM (SELECT pos, (pos % 5 + 98)::DOUBLE AS r, (pos % 7 + 97)::DOUBLE AS m,
    (pos % 9 - 4) / 2.0::DOUBLE AS z, (pos % 11 - 5) / 2.0::DOUBLE AS s FROM ev_)""",
)
def f17(spark, d):
    p = F.col("pos")
    r, m, z, s = (p % 5 + 98).cast("double"), (p % 7 + 97).cast("double"), (p % 9 - 4) / 2, (p % 11 - 5) / 2
    return I.events(spark, d).select(
        "pos",
        rotation.quadrant(r, m).alias("quadrant"),
        rotation.web_label(z).alias("web_label"),
        rotation.strings_label(s).alias("strings_label"),
        rotation.agreement(z, rotation.web_label(z), s).alias("agreement"),
    )


# --- chart ---------------------------------------------------------------------

BARS = 120
define("cut_", "SELECT *, row_number() OVER (PARTITION BY coin ORDER BY t) - 1 AS i FROM bar_")
define(
    "asked_",
    f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY coin ORDER BY t DESC) AS k FROM bar_) WHERE k <= {BARS}""",
)


def cut(spark, d):
    """All bars of every coin, numbered."""
    return chart.numbered(bars(spark, d))


@register(
    "w13_session_vwap",
    f"""SELECT coin, t, round(sum(v * (h + l + c) / 3.0) OVER w / sum(v) OVER w, {DIG}) AS vwap FROM cut_ WINDOW w AS (PARTITION BY coin, t // 86400000 ORDER BY t)""",
)
def w13(spark, d):
    return chart.session_vwap(cut(spark, d)).select("coin", "t", F.round("vwap", DIG).alias("vwap"))


def ema_sql(source: str, value: str, span: int) -> str:
    """EMA by a recursive walk over each coin's ordered bars."""
    a = 2.0 / (span + 1)
    return f"""WITH RECURSIVE e AS (SELECT coin, k, at, v, CASE WHEN v IS NOT NULL THEN v END AS state, (v IS NOT NULL)::INT AS seen FROM {source} WHERE k = 0
  UNION ALL SELECT s.coin, s.k, s.at, s.v, CASE WHEN s.v IS NULL THEN e.state WHEN e.state IS NULL THEN s.v ELSE {a!r}::DOUBLE * s.v + (1 - {a!r}::DOUBLE) * e.state END,
  e.seen + (s.v IS NOT NULL)::INT FROM e JOIN {source} s ON s.coin = e.coin AND s.k = e.k + 1)
  SELECT coin, at, CASE WHEN v IS NOT NULL AND seen >= {span} THEN state END AS y FROM e"""


define("emain_", "SELECT coin, i AS k, t AS \"at\", CASE WHEN t // 14400000 % 29 <> 0 THEN c END AS v FROM cut_")
define("ema9_", ema_sql("emain_", "v", 9).replace(" at,", ' "at",').replace("s.at", 's."at"'))


@register("w14_ema", f'SELECT coin, "at" AS t, round(y, {DIG}) AS ema FROM ema9_')
def w14(spark, d):
    rows = cut(spark, d).withColumn("v", F.when(F.floor(F.col("t") / 14_400_000) % 29 != 0, F.col("c")))
    return chart.ema(rows, "v", chart.FAST_EMA, "ema").withColumn("ema", F.round("ema", DIG))


define(
    "rung_",
    """SELECT coin, row_number() OVER (PARTITION BY coin ORDER BY b) - 1 AS k, b AS "at", CASE WHEN n = 6 THEN c END AS v FROM (SELECT coin, t // 86400000 AS b,
  arg_max(c, t) AS c, count(*) AS n FROM cut_ GROUP BY 1, 2)""",
)
define("rung20_", ema_sql("rung_", "v", 5).replace(" at,", ' "at",').replace("s.at", 's."at"'))


@register(
    "k09_rung_ema",
    f'SELECT c.coin, c.t, round(r.y, {DIG}) AS rung_ema FROM cut_ c LEFT JOIN rung20_ r ON r.coin = c.coin AND r."at" = c.t // 86400000 - 1',
)
def k09(spark, d):
    return _with_span(cut(spark, d), 5).select("coin", "t", F.round("rung_ema", DIG).alias("rung_ema"))


@register(
    "j16_up_rung_as_of",
    'SELECT c.coin, c.t, r.y IS NOT NULL AS seen FROM cut_ c LEFT JOIN rung20_ r ON r.coin = c.coin AND r."at" = c.t // 86400000 - 1',
)
def j16(spark, d):
    return _with_span(cut(spark, d), 5).select("coin", "t", F.col("rung_ema").isNotNull().alias("seen"))


def _with_span(rows, span):
    """The rung EMA with a short span: the stand-in history has too few days for the usual one."""
    return chart.rung_ema(rows, "4h", span)


def pivot_sql(bars: str) -> str:
    """Fractal swings of numbered bars."""
    return f"""SELECT coin, i, t, o, h, l, c, unnest([CASE WHEN h > hl AND h >= hr THEN 'high' END, CASE WHEN l < ll AND l <= lr THEN 'low' END]) AS kind FROM (SELECT *,
  max(h) OVER lf AS hl, max(h) OVER rt AS hr, min(l) OVER lf AS ll, min(l) OVER rt AS lr, count(h) OVER ar AS n FROM {bars} WINDOW
  lf AS (PARTITION BY coin ORDER BY t ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), rt AS (PARTITION BY coin ORDER BY t ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING),
  ar AS (PARTITION BY coin ORDER BY t ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)) WHERE n = 7"""


define("piv_", pivot_sql("cut_"))


@register("w15_pivots", "SELECT coin, i, t, kind, h, l FROM piv_ WHERE kind IS NOT NULL")
def w15(spark, d):
    return chart.pivots(cut(spark, d)).select("coin", F.col("i").cast("bigint").alias("i"), "t", "kind", "h", "l")


@register(
    "w16_sweeps",
    """SELECT coin, i, t, kind AS side, CASE kind WHEN 'high' THEN h ELSE l END AS price, CASE kind WHEN 'high' THEN ph ELSE pl END AS swept FROM (SELECT *,
    lag(h) OVER w AS ph, lag(l) OVER w AS pl FROM piv_ WHERE kind IS NOT NULL WINDOW w AS (PARTITION BY coin, kind ORDER BY t))
    WHERE (kind = 'high' AND h > ph AND c < ph) OR (kind = 'low' AND l < pl AND c > pl)""",
)
def w16(spark, d):
    return chart.sweeps(chart.pivots(cut(spark, d))).withColumn("i", F.col("i").cast("bigint"))


@register(
    "w17_volume_heat",
    """SELECT coin, i, t, round(v / m, 2) AS rel, CASE WHEN c < o THEN 'down' ELSE 'up' END AS side FROM (SELECT *, median(v2) OVER w AS m, count(v2) OVER w AS n FROM
    (SELECT *, CASE WHEN t // 14400000 % 10 = 0 THEN v * 3 ELSE v END AS v2 FROM cut_) WINDOW w AS (PARTITION BY coin ORDER BY t ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING))
    WHERE v IS NOT NULL AND o IS NOT NULL AND c IS NOT NULL AND n >= 25 AND m > 0 AND v2 / m >= 2""".replace("round(v / m", "round(v2 / m"),
)
def w17(spark, d):
    loud = F.when(F.floor(F.col("t") / 14_400_000) % 10 == 0, F.col("v") * 3).otherwise(F.col("v"))
    return chart.heat(cut(spark, d).withColumn("v", loud)).withColumn("i", F.col("i").cast("bigint"))


@register("a24_typical_range", f"SELECT coin, round(median(h - l) FILTER (h > l), {DIG}) AS tol FROM cut_ GROUP BY 1")
def a24(spark, d):
    return chart.typical_range(cut(spark, d)).withColumn("tol", F.round("tol", DIG))


def zone_sql(bars: str, marks: str, tol: str) -> str:
    """Zones by a recursive walk over each coin's closed bars, the standing ones carried as a list."""
    opened = "CASE WHEN n.o IS NULL OR n.o = 0 THEN n.c ELSE n.o END"

    def met(sign: str, extreme: str, zones: str) -> str:
        """The list after one swing: the first zone it comes back to grows, else a new one is added."""
        price = f"({sign} * n.{extreme})"
        inner = f"greatest({sign} * {opened}, {sign} * n.c)"
        outer = price if sign == "1" else f"greatest({price}, {inner} + n.tol / 2)"
        inner = f"least({inner}, {price} - n.tol / 2)" if sign == "1" else inner
        test = f"""z.sign = {sign} AND z.inn - n.tol <= {price} AND {price} <= z.outr + n.tol
          AND greatest(z.outr, {outer}) - least(z.inn, {inner}) <= 3 * n.tol"""
        first = f"list_min(list_transform(list_filter({zones}, lambda z: {test}), lambda z: z.start))"
        grown = f"""list_transform({zones}, lambda z: CASE WHEN z.sign = {sign} AND z.start = {first}
          THEN {{'sign': z.sign, 'start': z.start, 'outr': greatest(z.outr, {outer}), 'inn': least(z.inn, {inner}), 'touches': z.touches + 1, 'marks': list_append(z.marks, n.i)}}
          ELSE z END)"""
        fresh = f"{{'sign': {sign}, 'start': n.i, 'outr': {outer}, 'inn': {inner}, 'touches': 1, 'marks': []::BIGINT[]}}"
        return f"CASE WHEN {first} IS NULL THEN list_append({zones}, {fresh}) ELSE {grown} END"

    empty = "[]::STRUCT(sign INTEGER, start BIGINT, outr DOUBLE, inn DOUBLE, touches INTEGER, marks BIGINT[])[]"
    return f"""WITH RECURSIVE n AS (
  SELECT b.coin, b.i, b.o, b.h, b.l, b.c, tol, coalesce(high, false) AS high, coalesce(low, false) AS low,
         row_number() OVER (PARTITION BY b.coin ORDER BY b.i) AS k
  FROM {bars} b JOIN {tol} USING (coin) LEFT JOIN (
    SELECT coin, i, bool_or(kind = 'high') AS high, bool_or(kind = 'low') AS low FROM {marks} WHERE kind IS NOT NULL GROUP BY coin, i
  ) m ON m.coin = b.coin AND m.i = b.i WHERE b.c IS NOT NULL
), fold AS (
  SELECT coin, 0::BIGINT AS k, 0::BIGINT AS i, {empty} AS zones, {empty} AS gone FROM (SELECT DISTINCT coin FROM n)
  UNION ALL
  SELECT coin, k, i, CASE WHEN low THEN {met("-1", "l", "highs")} ELSE highs END, gone FROM (
    SELECT n.*, gone, CASE WHEN high THEN {met("1", "h", "kept")} ELSE kept END AS highs FROM (
      SELECT n.*, list_filter(f.zones, lambda z: z.sign * n.c <= z.outr) AS kept, list_filter(f.zones, lambda z: z.sign * n.c > z.outr) AS gone
      FROM fold f JOIN n ON n.coin = f.coin AND n.k = f.k + 1
    ) n
  ) n
), ended AS (
  SELECT coin, i AS "end", true AS broken, unnest(gone) AS z FROM fold
  UNION ALL
  SELECT coin, (SELECT max(i) FROM {bars} b WHERE b.coin = f.coin), false, unnest(zones) FROM fold f
  WHERE k = (SELECT max(k) FROM fold g WHERE g.coin = f.coin)
)
SELECT coin, CASE z.sign WHEN 1 THEN 'SELL' ELSE 'BUY' END AS side, greatest(z.sign * z.outr, z.sign * z.inn) AS top,
       least(z.sign * z.outr, z.sign * z.inn) AS bottom, z.start AS start, "end", z.touches::BIGINT AS touches,
       CASE WHEN broken THEN 'BROKEN' WHEN z.sign = 1 THEN 'SELL' ELSE 'BUY' END AS state, z.marks AS marks FROM ended WHERE z.touches >= 3"""


define("tol_", "SELECT coin, median(h - l) FILTER (h > l) AS tol FROM cut_ GROUP BY 1")
define("zone_", zone_sql("cut_", "piv_", "tol_"))


@register(
    "k10_boxes",
    f"""SELECT coin, side, round(top, {DIG}) AS top, round(bottom, {DIG}) AS bottom, start, "end", touches, state,
    'BOX ×' || touches || ' · ' || state AS label FROM zone_""",
)
def k10(spark, d):
    edges = {e: F.round(e, DIG) for e in ("top", "bottom")}
    return chart.boxes(cut(spark, d)).withColumns(edges)


@register("k11_chart")
def k11(spark, d):
    return chart.chart(bars(spark, d), "4h", BARS)


define("ask_", "SELECT coin, t, o, h, l, c, v, row_number() OVER (PARTITION BY coin ORDER BY t) - 1 AS i FROM asked_")
define("askpiv_", pivot_sql("ask_"))
define("asktol_", "SELECT coin, median(h - l) FILTER (h > l) AS tol FROM ask_ GROUP BY 1")
define("askzone_", zone_sql("ask_", "askpiv_", "asktol_"))
define("askin_", 'SELECT coin, i AS k, t AS "at", c AS v FROM ask_')
define("askema_", ema_sql("askin_", "v", 9).replace(" at,", ' "at",').replace("s.at", 's."at"'))
_STUDIES = ("side string, price double, top double, bottom double, `end` bigint, touches bigint, label string, "
            "swept double, rel double, c double, vwap double, fast_ema double")  # fmt: skip


@register(
    "k11_chart_studies",
    f"""SELECT coin, study, i, side, round(price, {DIG}) AS price, round(top, {DIG}) AS top, round(bottom, {DIG}) AS bottom, "end", touches, label,
    round(swept, {DIG}) AS swept, rel, round(c, {DIG}) AS c, round(vwap, {DIG}) AS vwap, round(fast_ema, {DIG}) AS fast_ema FROM (
    SELECT b.coin, 'lines' AS study, b.i, NULL AS side, NULL::DOUBLE AS price, NULL::DOUBLE AS top, NULL::DOUBLE AS bottom, NULL::BIGINT AS "end",
      NULL::BIGINT AS touches, NULL AS label, NULL::DOUBLE AS swept, NULL::DOUBLE AS rel, c,
      sum(v * (h + l + c) / 3.0) OVER w / nullif(sum(CASE WHEN h + l + c IS NOT NULL THEN v END) OVER w, 0) AS vwap, e.y AS fast_ema
      FROM ask_ b LEFT JOIN askema_ e ON e.coin = b.coin AND e."at" = b.t WINDOW w AS (PARTITION BY b.coin, b.t // 86400000 ORDER BY b.t)
    UNION ALL SELECT coin, 'box', start, side, NULL, top, bottom, "end", touches, 'BOX ×' || touches || ' · ' || state, NULL, NULL, NULL, NULL, NULL FROM askzone_
    UNION ALL SELECT z.coin, 'touch', p.i, z.side, CASE z.side WHEN 'SELL' THEN p.h ELSE p.l END, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL
      FROM (SELECT coin, side, unnest(marks) AS m FROM askzone_) z JOIN ask_ p ON p.coin = z.coin AND p.i = z.m
    UNION ALL SELECT coin, 'sweep', i, kind, CASE kind WHEN 'high' THEN h ELSE l END, NULL, NULL, NULL, NULL, NULL, CASE kind WHEN 'high' THEN ph ELSE pl END,
      NULL, NULL, NULL, NULL FROM (SELECT *, lag(h) OVER k AS ph, lag(l) OVER k AS pl FROM askpiv_ WHERE kind IS NOT NULL WINDOW k AS (PARTITION BY coin, kind ORDER BY t))
      WHERE (kind = 'high' AND h > ph AND c < ph) OR (kind = 'low' AND l < pl AND c > pl)
    UNION ALL SELECT coin, 'heat', i, CASE WHEN c < o THEN 'down' ELSE 'up' END, NULL, NULL, NULL, NULL, NULL, NULL, NULL, round(v / m, 2), NULL, NULL, NULL FROM
      (SELECT *, median(v) OVER k AS m, count(v) OVER k AS n FROM ask_ WINDOW k AS (PARTITION BY coin ORDER BY t ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING))
      WHERE v IS NOT NULL AND o IS NOT NULL AND c IS NOT NULL AND n >= 25 AND m > 0 AND v / m >= 2)""",
)
def k11_studies(spark, d):
    """The assembled chart with the fields of its payloads as columns."""
    drawn = chart.chart(bars(spark, d), "4h", BARS)
    rows = drawn.select("coin", "study", "i", F.from_json("payload", _STUDIES).alias("p")).select("coin", "study", "i", "p.*")
    return rows.withColumns({c: F.round(c, DIG) for c in ("price", "top", "bottom", "swept", "c", "vwap", "fast_ema")})


@register(
    "k11_chart_headline",
    """SELECT coin, coin || ' · 4h · ' || count(*) || ' bars · ' || printf('%.1f d of tape', count(*) * 4 / 24.0) || ' · up-rung 1d' AS headline FROM asked_ GROUP BY 1""",
)
def k11_headline(spark, d):
    return chart.headline(chart.newest_bars(bars(spark, d), "4h", BARS), "4h")


@register(
    "w12_session_open",
    "SELECT coin, session_pct IS NULL AS missing, price FROM sess_",
)
def w12(spark, d):
    return rotation.session_change(bars(spark, d)).select("coin", F.col("session_pct").isNull().alias("missing"), "price")


@register(
    "o08_carpet_order",
    "SELECT coin, coalesce(money_usd, 0) AS money_usd FROM carpet_",
)
def o08(spark, d):
    rows = rotation.by_money(carpet(spark, d))
    return rows.select("coin", F.coalesce("money_usd", F.lit(0.0)).alias("money_usd"))


@register(
    "k08_cross_chips",
    """SELECT coin, quadrant, web_label, upper(web_label) || ' to Group' || CASE WHEN k % 3 = 0 THEN ' · the strings agree (tautest vs c' || k || ')' ELSE '' END
    || CASE WHEN k % 4 = 0 THEN ' · HOT liquidity' ELSE '' END || ' · ' || quadrant AS text FROM (SELECT DISTINCT contract AS coin, user_id AS k,
    ['LEADING', 'WEAKENING', 'LAGGING', 'IMPROVING'][user_id % 4 + 1] AS quadrant, ['rich', 'cheap', 'fair'][user_id % 3 + 1] AS web_label FROM ev_)
    WHERE quadrant IN ('IMPROVING', 'WEAKENING') AND web_label <> 'fair'""",
)
def k08_chips(spark, d):
    k = F.col("user_id")

    def one_of(*names):
        return F.element_at(F.array(*[F.lit(n) for n in names]), (k % len(names) + 1).cast("int"))

    rows = I.events(spark, d).select("contract", "user_id").distinct().select(
        F.col("contract").alias("coin"),
        one_of("LEADING", "WEAKENING", "LAGGING", "IMPROVING").alias("quadrant"),
        one_of("rich", "cheap", "fair").alias("web_label"),
        F.when(k % 4 == 0, "HOT").otherwise("normal").alias("liquidity_label"),
        F.when(k % 3 == 0, "agree").alias("agreement"),
        F.concat(F.lit("c"), k).alias("partner"),
    )
    return rotation.chips(rows, "Group")


@register("w08_relative_level", f"SELECT coin, i, round(rs, {DIG}) AS rs FROM rs_")
def w08(spark, d):
    rows = rotation.levels(grid(spark, d), W)
    return rows.select("coin", F.col("i").cast("bigint").alias("i"), F.round("rs", DIG).alias("rs"))


@register("w09_rolling_z", f"SELECT coin, i, round(ratio, {DIG}) AS ratio FROM ratio_ WHERE ratio IS NOT NULL")
def w09(spark, d):
    rows = rotation.levels(grid(spark, d), W).where("ratio is not null")
    return rows.select("coin", F.col("i").cast("bigint").alias("i"), F.round("ratio", DIG).alias("ratio"))


@register("a20_residual_drift", f"SELECT coin, round(beta, {DIG}) AS beta, round(z, {DIG}) AS z FROM web_")
def a20(spark, d):
    return rotation.web(grid(spark, d), W).select("coin", F.round("beta", DIG).alias("beta"), F.round("z", DIG).alias("z"))


@register("a21_weighted_spread", f"SELECT coin, round(score, {DIG}) AS score, strung FROM str_")
def a21(spark, d):
    return rotation.strings(pair_grid(spark, d), W).select("coin", F.round("score", DIG).alias("score"), "strung")


@register("j14_strung_partners", "SELECT coin, count(*) AS strung FROM pull_ GROUP BY 1")
def j14(spark, d):
    return rotation.strings(pair_grid(spark, d), W, block_coins=2).select("coin", "strung")


@register("a22_liquidity_ratio", f"SELECT coin, round(rel, {DIG}) AS rel FROM liq_")
def a22(spark, d):
    return rotation.liquidity(grid(spark, d), W).select("coin", F.round("rel", DIG).alias("rel"))
