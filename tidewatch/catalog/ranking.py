"""Rank statistics, splits, backtest and calibration queries."""

from pyspark.sql import functions as F

from tidewatch.catalog import inputs as I
from tidewatch.catalog import register
from tidewatch.catalog.sql import define
from tidewatch.operators import stats

DIG = 9


def wilson_sql(k: str, n: str) -> tuple[str, str]:
    z2 = "3.8416::DOUBLE"
    p = f"(({k})::DOUBLE / ({n}))"
    den = f"(1 + {z2} / ({n}))"
    mid = f"(({p} + {z2} / (2.0::DOUBLE * ({n}))) / {den})"
    half = f"(1.96::DOUBLE * sqrt({p} * (1 - {p}) / ({n}) + {z2} / (4.0::DOUBLE * ({n}) * ({n}))) / {den})"
    return (
        f"CASE WHEN ({n}) = 0 THEN 0.0::DOUBLE ELSE greatest(0.0, {mid} - {half}) END",
        f"CASE WHEN ({n}) = 0 THEN 1.0::DOUBLE ELSE least(1.0, {mid} + {half}) END",
    )


def hanley_sql(a: str, p: str, n: str) -> tuple[str, str]:
    q1, q2 = f"({a} / (2.0 - {a}))", f"(2.0 * {a} * {a} / (1.0 + {a}))"
    var = f"(({a} * (1.0 - {a}) + (({p}) - 1) * ({q1} - {a} * {a}) + (({n}) - 1) * ({q2} - {a} * {a})) / (({p}) * ({n})))"
    low, _ = wilson_sql(f"({p}) * ({n})", f"({p}) * ({n})")
    half = f"(1.96::DOUBLE * sqrt({var}))"
    return (
        f"CASE WHEN {a} IS NULL THEN NULL WHEN {var} <= 0 THEN CASE WHEN {a} >= 0.5 THEN {low} ELSE 0.0 END ELSE greatest(0.0, {a} - {half}) END",
        f"CASE WHEN {a} IS NULL THEN NULL WHEN {var} <= 0 THEN CASE WHEN {a} >= 0.5 THEN 1.0::DOUBLE ELSE 1.0 - {low} END ELSE least(1.0, {a} + {half}) END",
    )


def auc_sql(table: str, groups: str, score: str = "score") -> str:
    """AUC by average-tie ranks with window functions: not the engine's route."""
    part = f"PARTITION BY {groups}" if groups else ""
    cols = f"{groups}, " if groups else ""
    by = f"GROUP BY {groups}" if groups else ""
    return f"""SELECT {cols}count(*) AS n, sum(label)::BIGINT AS positives, (count(*) - sum(label))::BIGINT AS negatives,
  CASE WHEN sum(label) > 0 AND sum(label) < count(*) THEN (sum(r) FILTER (label = 1) - sum(label)::DOUBLE * (sum(label) + 1) / 2)
    / (sum(label)::DOUBLE * (count(*) - sum(label))) END AS auc FROM (SELECT *, rank() OVER ({part} ORDER BY {score})
    + (count(*) OVER (PARTITION BY {cols}{score}) - 1) / 2.0::DOUBLE AS r FROM {table}) {by}"""


define("labauc_", auc_sql("lab_", "stratum"))


@register("m06_auc_by_stratum", f"SELECT stratum, n, positives, negatives, round(auc, {DIG}) AS auc FROM labauc_")
def m06(spark, d):
    a = stats.auc(I.labelled(spark, d), ["stratum"])
    return a.withColumn("auc", F.round("auc", DIG))


@register(
    "w18_average_tie_ranks",
    f"SELECT n, positives, negatives, round(auc, {DIG}) AS auc FROM ({auc_sql('(SELECT *, floor(score / 500) AS bin FROM lab_)', '', 'bin')})",
)
def w18(spark, d):
    a = stats.auc(I.labelled(spark, d).withColumn("bin", F.floor(F.col("score") / 500)), [], score="bin")
    return a.withColumn("auc", F.round("auc", DIG))


_LO, _HI = hanley_sql("auc", "positives", "negatives")


@register(
    "m07_auc_interval",
    f"SELECT stratum, round({_LO}, {DIG}) AS auc_low, round({_HI}, {DIG}) AS auc_high FROM labauc_",
)
def m07(spark, d):
    a = stats.with_interval(stats.auc(I.labelled(spark, d), ["stratum"]))
    return a.select("stratum", F.round("auc_low", DIG).alias("auc_low"), F.round("auc_high", DIG).alias("auc_high"))


define(
    "lift_",
    """SELECT stratum, size AS decile_size, k AS decile_positives, n, p FROM (SELECT stratum, count(*) AS size,
  sum(label)::BIGINT AS k, any_value(n) AS n, any_value(p) AS p FROM (SELECT *, row_number() OVER (PARTITION BY stratum
    ORDER BY score DESC, doc_id) AS r, count(*) OVER (PARTITION BY stratum) AS n, sum(label) OVER (PARTITION BY stratum) AS p
    FROM lab_) WHERE r <= greatest(1, n // 10) GROUP BY 1)""",
)
_WL, _WH = wilson_sql("decile_positives", "decile_size")


@register(
    "m08_decile_lift",
    f"""SELECT stratum, decile_size, decile_positives, round(decile_positives / decile_size / (p / n), {DIG}) AS lift,
    round({_WL} / (p / n), {DIG}) AS lift_low, round({_WH} / (p / n), {DIG}) AS lift_high FROM lift_""",
)
def m08(spark, d):
    x = stats.decile_lift(I.labelled(spark, d), ["stratum"], [F.col("score").desc(), F.col("doc_id")])
    return x.select(
        "stratum", "decile_size", "decile_positives", *[F.round(c, DIG).alias(c) for c in ("lift", "lift_low", "lift_high")]
    )


@register(
    "w19_top_decile",
    "SELECT doc_id, score, r AS rank FROM (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM lab_) WHERE r <= greatest(1, n // 10)",
)
def w19(spark, d):
    from tidewatch.operators.ordered import row_numbers

    lab = I.labelled(spark, d).select("doc_id", "score")
    size = max(1, lab.count() // 10)
    return row_numbers(lab, [], [F.col("score").desc(), F.col("doc_id")]).where(F.col("rank") <= size)


@register(
    "a17_tie_mass",
    """SELECT stratum, max(n) / sum(n) AS tie_share, arg_max(bin, (n, -first)) AS tie_value FROM (SELECT stratum,
    floor(score / 400)::BIGINT AS bin, count(*) AS n, min(doc_id) AS first FROM lab_ GROUP BY 1, 2) GROUP BY 1""",
)
def a17(spark, d):
    rows = I.labelled(spark, d).withColumn("bin", F.floor(F.col("score") / 400).cast("bigint"))
    return stats.tie_mass(rows, ["stratum"], "bin", "doc_id")


define("split_", "SELECT *, CASE WHEN row_number() OVER (ORDER BY ts) <= floor(count(*) OVER () * 0.7::DOUBLE) THEN 'train' ELSE 'test' END AS split FROM lab_")


@register("w20_time_split", "SELECT doc_id, split FROM split_")
def w20(spark, d):
    return stats.time_split(I.labelled(spark, d), "ts", "doc_id").select("doc_id", "split")


@register(
    "m09_deployer_repair",
    """SELECT doc_id, CASE WHEN split = 'test' AND deployer IN (SELECT deployer FROM split_ WHERE split = 'train')
    THEN 'train' ELSE split END AS split, split = 'test' AND deployer IN (SELECT deployer FROM split_ WHERE split = 'train')
    AS moved FROM split_""",
)
def m09(spark, d):
    s = stats.time_split(I.labelled(spark, d), "ts", "doc_id")
    r = stats.repair_leakage(s)
    return r.select("doc_id", "split", "moved")


_BL, _BH = wilson_sql("positives", "n")


@register(
    "a27_base_rate",
    f"""SELECT stratum, n, positives, positives / n AS base_rate, round({_BL}, {DIG}) AS base_rate_low, round({_BH}, {DIG}) AS base_rate_high
    FROM (SELECT stratum, count(*) AS n, sum(label)::BIGINT AS positives FROM lab_ GROUP BY 1)""",
)
def a27(spark, d):
    b = stats.base_rate(I.labelled(spark, d), ["stratum"])
    return b.withColumns({c: F.round(c, DIG) for c in ("base_rate_low", "base_rate_high")})


_W1, _W2 = wilson_sql("k", "n")


@register(
    "f16_wilson",
    f"SELECT pos, round({_W1}, {DIG}) AS low, round({_W2}, {DIG}) AS high FROM (SELECT pos, pos % 20 AS n, pos % 20 * (pos % 3) // 2 AS k FROM ev_ WHERE pos % 20 > 0)",
)
def f16(spark, d):
    from tidewatch.functions.values import wilson

    n = F.col("pos") % 20
    low, high = wilson(F.floor(n * (F.col("pos") % 3) / 2), n)
    return I.events(spark, d).where(n > 0).select("pos", F.round(low, DIG).alias("low"), F.round(high, DIG).alias("high"))


# --- backtest -------------------------------------------------------------------

from tidewatch.plans import backtest as B  # noqa: E402

FEATURE_SQL = {
    "mcap_usd": "market_mcap_usd",
    "liquidity_usd": "market_liquidity_usd",
    "volume_24h_usd": "market_volume_24h_usd",
    "age_minutes": "age_at_trigger_minutes::DOUBLE",
    "turnover_24h": "market_volume_24h_usd / nullif(market_mcap_usd, 0)",
    "liquidity_over_mcap": "market_liquidity_usd / nullif(market_mcap_usd, 0)",
    "fdv_over_mcap": "market_fdv_usd / nullif(market_mcap_usd, 0)",
    "value_per_trade": "market_volume_24h_usd / nullif(mindshare_txns_24h, 0)",
    "txn_accel_6h_24h": "(mindshare_txns_6h / 6.0::DOUBLE) / nullif(mindshare_txns_24h / 24.0::DOUBLE, 0)",
    "buy_pressure_1h": "momentum_buys_1h / nullif(momentum_buys_1h + momentum_sells_1h, 0)",
    "buy_pressure_24h": "momentum_buys_24h / nullif(momentum_buys_24h + momentum_sells_24h, 0)",
    "volume_accel_1h_6h": "momentum_volume_1h_usd / nullif(momentum_volume_6h_usd / 6.0::DOUBLE, 0)",
    "price_change_5m_pct": "NULL::DOUBLE",
    "price_change_1h_pct": "momentum_price_change_1h_pct",
    "price_change_6h_pct": "momentum_price_change_6h_pct",
    "price_change_24h_pct": "NULL::DOUBLE",
    "mindshare_share_pct": "mindshare_share_pct",
    "mindshare_percentile": "mindshare_percentile::DOUBLE",
    "pair_count": "mindshare_pair_count::DOUBLE",
    "boost_total": "mindshare_boost_total",
    "socials_declared_n": "CASE WHEN coalesce(socials_declared_telegram, socials_declared_x, socials_declared_website) IS NOT NULL THEN"
    " (coalesce(socials_declared_telegram, false)::INT + coalesce(socials_declared_x, false)::INT + coalesce(socials_declared_website, false)::INT)::DOUBLE END",
    "declared_x": "socials_declared_x::INT::DOUBLE",
    "declared_telegram": "socials_declared_telegram::INT::DOUBLE",
    "declared_website": "socials_declared_website::INT::DOUBLE",
    "holder_count": "f.holder_count::DOUBLE",
    "top10_ex_lp_pct": "f.top10_ex_lp_pct",
    "lp_locked_pct": "f.lp_locked_pct",
    "data_completeness": "data_completeness",
}
_BAND = """CASE WHEN age_minutes >= 0 AND age_minutes < 60 THEN '<1h' WHEN age_minutes < 360 THEN '1-6h'
  WHEN age_minutes < 2880 THEN '6-48h' WHEN age_minutes IS NOT NULL THEN '>48h' END"""
# Doubles that rest on sums may differ in the last bit between engines; ties must not.
_R = 9
define(
    "bt_",
    f"""SELECT *, {_BAND} AS age_band FROM (SELECT s.snapshot_id, s.ts, (l.max_multiple_24h >= 1.05)::INT AS label,
  {', '.join(f'round({sql}, {_R}) AS {n}' for n, sql in FEATURE_SQL.items())} FROM feat_ s JOIN labels_late_ l USING (snapshot_id)
  LEFT JOIN safety0_ f USING (chain, contract) WHERE l.max_multiple_24h IS NOT NULL)""",
)


def backtest_rows(spark, d):
    facts = I.safety(spark, d).select(
        F.concat(F.lit("s"), "user_id").alias("snapshot_id"),
        F.col("collected_at_ms").alias("ts"),
        F.col("source").alias("observation_id"),
        "holder_count",
        "top10_ex_lp_pct",
        "lp_locked_pct",
    )
    rows = B.rows(I.features(spark, d), I.labels(spark, d), facts, "max_multiple_24h", 1.05, limit=None)
    return rows.withColumns({n: F.round(n, _R) for n in B.feature_columns()})


@register("m01_features", f"SELECT snapshot_id, {', '.join(FEATURE_SQL)} FROM bt_")
def m01(spark, d):
    return backtest_rows(spark, d).select("snapshot_id", *FEATURE_SQL)


@register("m02_backtest_rows", "SELECT snapshot_id, ts, label, age_band FROM bt_")
def m02(spark, d):
    return backtest_rows(spark, d).select("snapshot_id", "ts", "label", "age_band")


@register("f15_bands", f"SELECT snapshot_id, {_BAND} AS age_band, CASE WHEN market_mcap_usd >= 0 AND market_mcap_usd < 500000 THEN '<500k' WHEN market_mcap_usd < 2000000 THEN '500k-2m' END AS mcap_band FROM (SELECT *, age_at_trigger_minutes AS age_minutes FROM feat_)")
def f15(spark, d):
    from tidewatch.functions.values import age_band, mcap_band

    rows = I.features(spark, d)
    return rows.select(
        "snapshot_id", age_band("age_at_trigger_minutes").alias("age_band"), mcap_band("market_mcap_usd").alias("mcap_band")
    )


define(
    "btlong_",
    f"""SELECT snapshot_id, ts, label, age_band, feature, score, CASE WHEN row_number() OVER (PARTITION BY feature ORDER BY ts, snapshot_id)
  <= floor(count(*) OVER (PARTITION BY feature) * 0.7::DOUBLE) THEN 'train' ELSE 'test' END AS split
  FROM (UNPIVOT bt_ ON {', '.join(FEATURE_SQL)} INTO NAME feature VALUE score)""",
)
define(
    "btscope_",
    """SELECT *, 'all' AS scope FROM btlong_ UNION ALL SELECT *, split FROM btlong_ UNION ALL
  SELECT *, 'band ' || age_band FROM btlong_ WHERE age_band IS NOT NULL""",
)
define("btauc_", auc_sql("btscope_", "feature, scope"))
_BANDCOLS = ", ".join(
    f"max(auc) FILTER (scope = 'band {b}' AND n >= 12) AS auc_{i}" for i, b in enumerate(B.BANDS)
)
define(
    "btwide_",
    f"""SELECT *, CASE WHEN train IS NOT NULL AND auc IS NOT NULL THEN CASE WHEN train >= 0.5 THEN test ELSE 1.0 - test END END AS auc_out_of_sample
  FROM (SELECT feature, max(n) FILTER (scope = 'all') AS n, max(positives) FILTER (scope = 'all') AS positives,
  max(negatives) FILTER (scope = 'all') AS negatives, max(auc) FILTER (scope = 'all') AS auc, max(auc) FILTER (scope = 'train') AS train,
  max(auc) FILTER (scope = 'test') AS test, max(positives) FILTER (scope = 'test') AS tp, max(negatives) FILTER (scope = 'test') AS tn,
  {_BANDCOLS} FROM btauc_ GROUP BY 1)""",
)
_AL, _AH = hanley_sql("auc", "positives", "negatives")
_OL, _OH = hanley_sql("auc_out_of_sample", "tp", "tn")
define(
    "btties_",
    """SELECT feature, max(n) / sum(n) AS tie_share, arg_min(score, (-n, first)) AS tie_value FROM (SELECT feature, score, count(*) AS n,
  min((ts, snapshot_id)) AS first FROM btlong_ GROUP BY 1, 2) GROUP BY 1""",
)
define(
    "btlift_",
    """SELECT feature, sum(label) / count(*) / any_value(p / n) AS top_decile_lift FROM (SELECT l.feature, l.label,
    row_number() OVER (PARTITION BY l.feature ORDER BY CASE WHEN coalesce(w.auc, 0.5) >= 0.5 THEN score ELSE -score END DESC, l.ts, l.snapshot_id) AS r,
    count(*) OVER (PARTITION BY l.feature) AS n, sum(l.label) OVER (PARTITION BY l.feature) AS p
    FROM btlong_ l JOIN btwide_ w USING (feature)) WHERE r <= greatest(1, n // 10) GROUP BY 1""",
)
define(
    "bteval_",
    f"""SELECT w.* EXCLUDE (train, test, tp, tn, negatives), {_AL} AS auc_low, {_AH} AS auc_high, {_OL} AS oos_low, {_OH} AS oos_high,
  tie_share, tie_value, CASE WHEN w.auc IS NOT NULL THEN top_decile_lift END AS top_decile_lift
  FROM btwide_ w JOIN btties_ USING (feature) JOIN btlift_ USING (feature)""",
)
_STAT = (
    "auc", "auc_low", "auc_high", "auc_out_of_sample", "oos_low", "oos_high", "auc_0", "auc_1", "auc_2", "auc_3",
    "top_decile_lift", "tie_share", "tie_value",
)


@register(
    "m03_feature_evaluation",
    f"SELECT feature, n, positives, {', '.join(f'round({c}, 7) AS {c}' for c in _STAT)} FROM bteval_",
)
def m03(spark, d):
    e = B.evaluate(backtest_rows(spark, d))
    return e.select("feature", "n", "positives", *[F.round(c, 7).alias(c) for c in _STAT])


_SIDE = "(CASE WHEN auc >= 0.5 THEN 1 ELSE -1 END)"
_BAD = " OR ".join(f"coalesce(NOT ((auc_{i} - 0.5) * {_SIDE} > 0.02), false)" for i in range(4))
define(
    "btjudge_",
    f"""SELECT *, CASE WHEN auc IS NULL THEN 'unmeasurable' WHEN feature = 'age_minutes' THEN 'control variable -- ' ||
    CASE WHEN auc < 0.5 THEN 'younger surges more' ELSE 'older surges more' END || '; the strata are cut on it, so it is not checked against itself'
  WHEN tie_share >= 0.3 AND NOT survives THEN 'artefact: pinned value, and no separation inside an age band'
  WHEN tie_share >= 0.3 THEN printf('suspect: %.0f%% of rows share one value', tie_share * 100)
  WHEN NOT separates THEN 'no separation (interval spans 0.5)'
  WHEN NOT survives THEN 'confounded with age: separation does not survive stratification'
  WHEN auc_out_of_sample IS NULL THEN 'separates in sample only -- no out-of-sample split to confirm it'
  WHEN NOT auc_out_of_sample > 0.5 THEN 'separates in sample only -- the direction learned on the earlier rows did not hold on the later ones'
  ELSE 'separates, out of sample, within age bands -- a lead, not a result' END AS verdict FROM (SELECT *,
  coalesce(auc_low > 0.5 OR auc_high < 0.5, false) AS separates, feature = 'age_minutes' OR (auc IS NOT NULL AND
  coalesce(auc_0, auc_1, auc_2, auc_3) IS NOT NULL AND NOT ({_BAD})) AS survives FROM bteval_)""",
)


@register("m04_feature_verdicts", "SELECT feature, separates, survives AS survives_strata, verdict FROM btjudge_")
def m04(spark, d):
    return B.evaluate(backtest_rows(spark, d)).select("feature", "separates", "survives_strata", "verdict")


@register("o09_features_by_strength", "SELECT feature, round(abs(auc - 0.5), 7) AS strength FROM bteval_")
def o09(spark, d):
    e = B.by_strength(B.evaluate(backtest_rows(spark, d)))
    return e.select("feature", F.round(F.abs(F.col("auc") - 0.5), 7).alias("strength"))


define(
    "gate_",
    """SELECT (SELECT count(*) FROM labels_late_ WHERE survived_24h) AS survivors, (SELECT count(*) FROM labels_late_ WHERE NOT survived_24h) AS dead,
  (SELECT count(*) FROM (SELECT snapshot_id FROM soc_ WHERE error IS NULL GROUP BY 1 HAVING count(DISTINCT (platform, offset_minutes)) >= 8)) AS complete_social""",
)


@register(
    "m05_backtest_report",
    f"""SELECT n, positives, base_rate, round({_BL}, {DIG}) AS base_rate_low, round({_BH}, {DIG}) AS base_rate_high, leads,
    dead / nullif(survivors, 0) AS dead_per_survivor, complete_social >= 300 AND coalesce(dead / nullif(survivors, 0) >= 20, false) AS gate_met
    FROM (SELECT count(*) AS n, sum(label)::BIGINT AS positives, sum(label) / count(*) AS base_rate FROM bt_) CROSS JOIN gate_ CROSS JOIN
    (SELECT coalesce(string_agg(feature, ',' ORDER BY feature), '') AS leads FROM btjudge_ WHERE verdict LIKE 'separates, out of sample%')""",
)
def m05(spark, d):
    from tidewatch.plans import calibration

    wide = backtest_rows(spark, d)
    gate = calibration.exit_criteria(I.snapshots(spark, d), I.labels(spark, d), I.social(spark, d), "survived_24h")
    r = B.report(wide, B.evaluate(wide), gate.select("survivors", "dead", "complete_social"))
    return r.select(
        "n", "positives", "base_rate", F.round("base_rate_low", DIG).alias("base_rate_low"),
        F.round("base_rate_high", DIG).alias("base_rate_high"), "leads", "dead_per_survivor", "gate_met",
    )
