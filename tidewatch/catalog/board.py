"""Scoring runs, boards, snapshot rows and calibration queries."""

from pyspark.sql import functions as F

from tidewatch import schema
from tidewatch.catalog import inputs as I
from tidewatch.catalog import register
from tidewatch.catalog import screen
from tidewatch.catalog.ranking import auc_sql, hanley_sql, wilson_sql
from tidewatch.catalog.sql import define
from tidewatch.catalog.tables import scores
from tidewatch.operators import pillars, stats
from tidewatch.plans import board, calibration, scoring

DIG = 6
LATE = I.AS_OF_LATE

define(
    "run_in_",
    f"""SELECT s.snapshot_id, s.chain, s.contract, s.ts, s.user_id, s.market_mcap_usd, {LATE} AS evaluated_at_ms, s.market_mcap_usd AS mcap_usd,
  s.market_liquidity_usd AS liquidity_usd, s.market_fdv_usd AS fdv_usd, f.honeypot, f.sells_failing, f.buy_tax_pct, f.sell_tax_pct,
  f.mint_revoked, f.freeze_active, f.lp_burned, NULL::BIGINT AS lp_locked_until_ms, f.lp_locked_pct,
  coalesce(f.top10_ex_lp_pct, s.holders_top10_ex_lp_pct) AS top10_ex_lp_pct, f.deployer_prior_rugs, f.upgradeable, f.admin_renounced
  FROM feat_ s LEFT JOIN safety0_ f USING (chain, contract)""",
)


def _flags(outcome: str) -> str:
    parts = ", ".join(
        f"CASE WHEN ({screen._case(n, 1)}) = '{outcome}' THEN '{n}' END" for n in screen.SQL_CHECKS
    )
    return f"concat_ws(',', {parts})"


define(
    "run0_",
    f"SELECT snapshot_id, chain, contract, ts, market_mcap_usd, {_flags('reject')} AS rejected_by, {_flags('unknown')} AS indeterminate_on FROM run_in_",
)
# Few stand-in tokens pass all eight filters, so the ranked queries exclude on evidence only.
define(
    "run_",
    f"""SELECT r.*, r.rejected_by <> '' OR r.indeterminate_on <> '' AS excluded, round(p.s, {DIG}) AS would_score FROM run0_ r JOIN
  (SELECT snapshot_id, {screen.final_sql(pillars.FITTED_V1, cold=False)} AS s FROM pillars_) p USING (snapshot_id)""",
)


def scored(spark, d):
    return scoring.score_rows(
        I.features(spark, d), I.safety(spark, d), LATE, registry=I.STAND_IN_CHAINS
    )


@register(
    "x12_score_rows",
    "SELECT snapshot_id, excluded, rejected_by, indeterminate_on, CASE WHEN NOT excluded THEN would_score END AS score FROM run_",
)
def x12(spark, d):
    return scored(spark, d).select(
        "snapshot_id",
        "excluded",
        F.array_join("rejected_by", ",").alias("rejected_by"),
        F.array_join("indeterminate_on", ",").alias("indeterminate_on"),
        F.round("score", DIG).alias("score"),
    )


@register(
    "a14_exclusion_summary",
    """SELECT count(*) AS excluded_total, count(*) FILTER (rejected_by <> '') AS excluded_on_evidence, count(*) FILTER (rejected_by = '')
    AS excluded_as_unmeasured FROM run_ WHERE excluded""",
)
def a14(spark, d):
    return scoring.exclusion_summary(scored(spark, d))


define(
    "ranked_run_",
    """SELECT snapshot_id, excl, would_score, CASE WHEN NOT excl THEN row_number() OVER (PARTITION BY excl ORDER BY s DESC NULLS LAST, snapshot_id) END AS rank
  FROM (SELECT *, rejected_by LIKE '%authority%' AS excl, CASE WHEN NOT rejected_by LIKE '%authority%' THEN would_score END AS s FROM run_)""",
)


def ranked(spark, d):
    """Ranks with only the authority checks excluding, so that survivors exist to rank."""
    rows = pillars.score(I.features(spark, d))
    merged = scoring.filters.verdict(
        scoring.filters.override(scoring.filter_frame(rows, LATE), I.safety(spark, d), I.TOKEN), I.STAND_IN_CHAINS
    )
    bad = F.exists("rejected_by", lambda x: x.contains("authority"))
    return scoring.rank_batch(
        merged.withColumn("excluded", bad).withColumn("score", F.when(~bad, F.col("score"))), "snapshot_id", DIG
    )


@register("w06_batch_rank", "SELECT snapshot_id, excl AS excluded, rank FROM ranked_run_")
def w06(spark, d):
    return ranked(spark, d).select("snapshot_id", "excluded", "rank")


@register("o03_best_first", "SELECT snapshot_id, rank FROM ranked_run_ WHERE rank IS NOT NULL")
def o03(spark, d):
    return ranked(spark, d).where("rank is not null").select("snapshot_id", "rank")


@register(
    "o10_live_order",
    "SELECT snapshot_id FROM ranked_run_ JOIN (SELECT snapshot_id, market_mcap_usd FROM run_) USING (snapshot_id) ORDER BY rank NULLS LAST, coalesce(market_mcap_usd, 0) DESC, snapshot_id LIMIT 60",
)
def o10(spark, d):
    return board.live_order(ranked(spark, d), 60).select("snapshot_id")


@register(
    "s31_board_output",
    "SELECT snapshot_id, CASE WHEN excluded THEN 'rejected' ELSE 'ranked' END AS kind, excluded AS has_verdict FROM run_",
)
def s31(spark, d):
    rows = scoring.rank_batch(scored(spark, d), "snapshot_id", DIG)
    out = board.verdict_rows(rows)
    names = F.from_json(F.get_json_object("json", "$.rejected_by"), "array<string>")
    return out.select("snapshot_id", "kind", F.coalesce(F.size(names) > 0, F.lit(False)).alias("has_verdict"))


@register(
    "f22_batch_verdict",
    """SELECT CASE WHEN n = 0 THEN 'no candidate cleared the hard filters' WHEN best < 55 THEN printf('no edge in this batch (best score %.1f < 55); weights fitted-v1 establish no edge, so this is a logged observation, not a recommendation', best)
    ELSE printf('best score %.1f, but weights fitted-v1 were fitted on too small a sample to establish an edge -- a logged observation, not a recommendation', best) END AS verdict
    FROM (SELECT count(*) AS n, max(coalesce(would_score, 0)) AS best FROM ranked_run_ WHERE NOT excl)""",
)
def f22(spark, d):
    return scoring.batch_verdict(ranked(spark, d)).select("verdict")


def board_sql(newest: str, name: str) -> None:
    """Define the current board of the ``newest`` snapshots as a view."""
    define(
        f"{name}v_",
        f"""SELECT n.*, s.ts FROM {newest} s JOIN (SELECT * FROM score_ QUALIFY row_number() OVER
  (PARTITION BY snapshot_id ORDER BY scored_at_ms DESC, score_id DESC) = 1) n USING (snapshot_id)""",
    )
    define(
        f"{name}_",
        f"""SELECT *, CASE WHEN NOT excluded AND ts >= {LATE} - 10080 * 60000 THEN row_number() OVER (PARTITION BY excluded OR ts < {LATE} - 10080 * 60000
  ORDER BY score DESC NULLS LAST, snapshot_id) END AS board_rank FROM {name}v_ WHERE (prompt_version, weights_version) =
  (SELECT arg_max((prompt_version, weights_version), (scored_at_ms, score_id)) FROM {name}v_)""",
    )


board_sql("(SELECT * FROM snap_ ORDER BY ts DESC, snapshot_id LIMIT 80)", "board")
board_sql("snap_", "boardall")


@register("o02_current_board", "SELECT snapshot_id, score, excluded, board_rank FROM board_")
def o02(spark, d):
    since = LATE - 10080 * 60000
    return scoring.current_board(I.snapshots(spark, d), scores(spark, d), 80, since).select(
        "snapshot_id", "score", "excluded", "board_rank"
    )


@register(
    "s26_board_payload",
    f"""SELECT s.snapshot_id, b.score, b.board_rank AS rank, l.max_multiple_24h, f.honeypot, f.contract IS NOT NULL AS has_safety,
    s.ts < {LATE} - 10080 * 60000 AS outcome_window_closed, CASE s.chain WHEN 'c0' THEN 'Chain 0' WHEN 'c1' THEN 'Chain 1' WHEN 'c2' THEN 'Chain 2' ELSE s.chain END AS chain_label,
    CASE WHEN s.chain <> 'c3' THEN 'https://pages.example/s' || substr(s.chain, 2) || '/' || s.contract END AS page_url
    FROM snap_ s LEFT JOIN boardall_ b USING (snapshot_id) LEFT JOIN labels_late_ l USING (snapshot_id)
    LEFT JOIN safety0_ f USING (chain, contract)""",
)
def s26(spark, d):
    labels = I.labels(spark, d).withColumns({"filled_at_ms": F.lit(LATE), "label_id": F.col("snapshot_id")})
    rows = board.payload(
        I.snapshots(spark, d), scores(spark, d), labels, I.safety(spark, d), LATE, None, registry=I.STAND_IN_CHAINS
    )
    return rows.select(
        "snapshot_id", "score", "rank", "max_multiple_24h", F.col("safety.honeypot").alias("honeypot"),
        F.col("safety").isNotNull().alias("has_safety"), "outcome_window_closed", "chain_label", "page_url",
    )


@register(
    "s27_nested_rows",
    """SELECT snapshot_id, market_mcap_usd, market_liquidity_usd, social_tg_members, socials_declared_x FROM feat_""",
)
def s27(spark, d):
    rows = schema.conform(I.features(spark, d), "snapshots")
    docs = board.as_json(rows.select("snapshot_id", *[schema.nested(g) for g in schema.GROUPS]))
    j = F.col("json")
    return docs.select(
        "snapshot_id",
        F.get_json_object(j, "$.market.mcap_usd").cast("double").alias("market_mcap_usd"),
        F.get_json_object(j, "$.market.liquidity_usd").cast("double").alias("market_liquidity_usd"),
        F.get_json_object(j, "$.social_tg.members").cast("bigint").alias("social_tg_members"),
        F.get_json_object(j, "$.socials_declared.x").cast("boolean").alias("socials_declared_x"),
    )


@register(
    "p23_live_counts",
    "SELECT count(*) AS polled, count(*) FILTER (trigger_kind IS NOT NULL) AS triggered, count(*) FILTER (trigger_kind IS NULL) AS below_trigger FROM fired_",
)
def p23(spark, d):
    return board.live(I.obs(spark, d))


@register(
    "p02_snapshot_rows",
    """SELECT chain, contract, ts, strftime(make_timestamp(ts * 1000), '%Y-%m-%d') AS snapshot_date, trigger_kind, trigger_mcap_crossed,
    trigger_holders_crossed, market_mcap_usd, holders_count, 'stand-in' AS source FROM snap_""",
)
def p02(spark, d):
    from tidewatch.operators import trigger

    rows = board.snapshot_rows(trigger.first_crossings(I.obs(spark, d)), "stand-in")
    return rows.select(
        "chain", "contract", "ts", F.col("snapshot_date").cast("string").alias("snapshot_date"), "trigger_kind",
        "trigger_mcap_crossed", "trigger_holders_crossed", "market_mcap_usd", "holders_count", "source",
    )


_COUNTED = (
    "age_at_trigger_minutes", "listings", "market_mcap_usd", "market_liquidity_usd", "market_volume_24h_usd", "market_fdv_usd",
    "holders_growth_6h_pct", "holders_top10_ex_lp_pct", "deployer_address", "launch_bundled_supply_pct", "flow_whale",
    "flows_smart_money_entries", "flows_smart_money_hit_rate", "mindshare_share_pct", "mindshare_rank", "mindshare_percentile",
    "mindshare_universe_size", "mindshare_txns_24h", "mindshare_txns_6h",
    "mindshare_boost_total", "mindshare_pair_count", "mindshare_universe_txns_24h", "mindshare_universe_volume_24h_usd",
    "mindshare_universe_boost_total", "social_x_mentions_6h", "social_x_mentions_24h", "social_x_unique_authors_24h",
    "social_x_follower_weighted_reach", "social_x_tier1_organic_engagements", "social_x_reply_to_post_ratio", "social_tg_members",
    "social_tg_member_growth_6h_pct", "social_tg_msgs_per_hour", "social_tg_unique_speakers_24h", "socials_declared_telegram",
    "socials_declared_x", "socials_declared_website", "trends_google_trends_delta", "trends_tiktok_video_count_delta",
    "lineage_meta_tag", "lineage_position_in_meta",
)
_SUM = " + ".join(f"({c} IS NOT NULL)::BIGINT" for c in _COUNTED)


@register(
    "p04_data_completeness",
    f"SELECT snapshot_id, {_SUM} AS fields_present, 54::BIGINT AS fields_expected, ({_SUM}) / 54 AS data_completeness FROM feat_",
)
def p04(spark, d):
    rows = schema.conform(I.features(spark, d), "snapshots")
    out = scoring.completeness(rows.drop("fields_present", "fields_expected", "data_completeness"), schema.counted_columns())
    return out.select("snapshot_id", "fields_present", "fields_expected", "data_completeness")


@register(
    "p03_flatten_and_nest",
    "SELECT snapshot_id, market_mcap_usd, market_fdv_usd, trends_google_trends_delta FROM feat_",
)
def p03(spark, d):
    rows = schema.conform(I.features(spark, d), "snapshots")
    nested = rows.select("snapshot_id", *[schema.nested(g) for g in schema.GROUPS])
    flat = nested.select("snapshot_id", *[c for g in schema.GROUPS for c in schema.flat(g)])
    return flat.select("snapshot_id", "market_mcap_usd", "market_fdv_usd", "trends_google_trends_delta")


@register(
    "p05_candidate_packet",
    "SELECT snapshot_id, age_at_trigger_minutes / 60.0::DOUBLE AS age_hours, market_mcap_usd AS market_cap_usd, len(listings) AS n_listings FROM feat_",
)
def p05(spark, d):
    rows = I.features(spark, d)
    return rows.select(
        "snapshot_id",
        (F.col("age_at_trigger_minutes") / 60.0).alias("age_hours"),
        F.col("market_mcap_usd").alias("market_cap_usd"),
        F.size("listings").cast("bigint").alias("n_listings"),
    )


@register("p25_schema_conformity", "SELECT 'labels' AS name, true AS conforms, count(*) AS n FROM labels_late_")
def p25(spark, d):
    rows = schema.conform(I.labels(spark, d), "labels")
    checked = schema.validate(rows, "labels")
    try:
        schema.validate(rows.drop("survived_7d"), "labels")
        refused = False
    except schema.SchemaMismatch:
        refused = True
    return checked.agg(F.count("*").alias("n")).select(
        F.lit("labels").alias("name"), F.lit(refused).alias("conforms"), "n"
    )


@register(
    "x13_scoring_run",
    """SELECT snapshot_id, excluded, CASE WHEN NOT excluded THEN would_score END AS score FROM run_""",
)
def x13(spark, d):
    none = I.social(spark, d).where("snapshot_id is null")
    out = scoring.run(I.features(spark, d), none, I.safety(spark, d), LATE, None, registry=I.STAND_IN_CHAINS)
    return out.select("snapshot_id", "excluded", F.round("score", DIG).alias("score"))


# --- calibration ------------------------------------------------------------------

define(
    "train_",
    f"""SELECT p.snapshot_id, p.ts, 'd' || p.user_id AS deployer, CASE p.user_id % 3 WHEN 0 THEN 'hot' WHEN 1 THEN 'neutral' ELSE 'cold' END AS regime,
  (l.max_multiple_24h >= 1.05)::INT AS label, {', '.join('p.' + n for n in pillars.NAMES)} FROM pillars_ p JOIN labels_late_ l USING (snapshot_id)
  WHERE l.max_multiple_24h IS NOT NULL""",
)
define(
    "tsplit0_",
    "SELECT *, CASE WHEN row_number() OVER (ORDER BY ts, snapshot_id) <= floor(count(*) OVER () * 0.7::DOUBLE) THEN 'train' ELSE 'test' END AS part FROM train_",
)
define(
    "tsplit_",
    """SELECT * EXCLUDE (part), CASE WHEN part = 'test' AND deployer IN (SELECT deployer FROM tsplit0_ WHERE part = 'train') THEN 'train' ELSE part END AS split
  FROM tsplit0_""",
)


def training(spark, d):
    u = F.col("user_id")
    regime = F.element_at(F.array(F.lit("hot"), F.lit("neutral"), F.lit("cold")), (u % 3 + 1).cast("int"))
    first = I.features(spark, d).withColumns({"deployer": F.concat(F.lit("d"), u), "regime": regime})
    return calibration.training_rows(first, I.labels(spark, d), "max_multiple_24h", 1.05)


def held_out(spark, d):
    """Split rows; test rows whose deployer has training rows move there."""
    split = stats.time_split(training(spark, d), "ts", "snapshot_id")
    return stats.repair_leakage(split)


_IN_FORCE, _ = screen.composite_sql(pillars.FITTED_V1)
_PRIOR, _ = screen.composite_sql(pillars.PRIORS)
define(
    "vec_",
    f"""SELECT snapshot_id, ts, label, regime, 'in_force' AS vector, coalesce(round({_IN_FORCE}, 6), '-infinity'::DOUBLE) AS score FROM tsplit_ WHERE split = 'test'
  UNION ALL SELECT snapshot_id, ts, label, regime, 'priors', coalesce(round({_PRIOR}, 6), '-infinity'::DOUBLE) FROM tsplit_ WHERE split = 'test'""",
)
define("vecauc_", auc_sql("vec_", "vector"))
define(
    "veclift_",
    """SELECT vector, count(*) AS decile_size, sum(label)::BIGINT AS decile_positives, any_value(n) AS n, any_value(p) AS p FROM (SELECT *, row_number() OVER
  (PARTITION BY vector ORDER BY score DESC, ts, snapshot_id) AS r, count(*) OVER (PARTITION BY vector) AS n, sum(label) OVER (PARTITION BY vector) AS p FROM vec_)
  WHERE r <= greatest(1, n // 10) GROUP BY 1""",
)
_AL, _AH = hanley_sql("auc", "positives", "negatives")
_VECTORS = {"in_force": pillars.FITTED_V1, "priors": pillars.PRIORS}


@register(
    "m13_held_out_ranking",
    f"""SELECT a.vector, a.n, a.positives, round(auc, {DIG}) AS auc, round({_AL}, {DIG}) AS auc_low, round({_AH}, {DIG}) AS auc_high,
    CASE WHEN l.p > 0 THEN round(decile_positives / decile_size / (l.p / l.n), {DIG}) END AS lift FROM vecauc_ a JOIN veclift_ l USING (vector)""",
)
def m13(spark, d):
    test = held_out(spark, d).where("split = 'test'")
    vectors = {v: calibration.composite_of(w) for v, w in _VECTORS.items()}
    long = calibration.vector_scores(test, vectors, ["snapshot_id", "ts", "label", "regime"])
    r = calibration.ranking(long, ["vector"], digits=6)
    return r.select("vector", "n", "positives", *[F.round(c, DIG).alias(c) for c in ("auc", "auc_low", "auc_high", "lift")])


@register("a26_feature_means", "SELECT " + ", ".join(f"round(avg({n}) / 100, {DIG}) AS {n}" for n in pillars.NAMES) + " FROM tsplit_ WHERE split = 'train'")
def a26(spark, d):
    train = held_out(spark, d).where("split = 'train'")
    return train.agg(*[F.round(F.avg(F.col(n) / 100.0), DIG).alias(n) for n in pillars.NAMES])


@register(
    "m13_split_windows",
    "SELECT split, count(*) AS n, sum(label)::BIGINT AS positives, min(ts) AS from_ms, max(ts) AS to_ms FROM tsplit_ GROUP BY 1",
)
def m13_windows(spark, d):
    return calibration.windows(held_out(spark, d))


@register("m10_logistic_fit")
def m10(spark, d):
    """Coefficients of the converged fit, one row per term."""
    model = calibration.fit_converged(held_out(spark, d).where("split = 'train'"))
    rows = [(n, round(w, 4)) for n, w in {**model.weights, "bias": model.bias}.items()]
    return spark.createDataFrame(rows, "term string, coefficient double")


_STEPS = 20
_TERMS = [t for n in pillars.NAMES for t in (f"coalesce({n} / 100, coalesce(avg({n} / 100.0) OVER (), 0))", f"({n} IS NULL)::INT::DOUBLE")]
_PLACES = range(1, len(_TERMS) + 1)
define("terms_", f"SELECT label::DOUBLE AS y, [{', '.join(_TERMS)}] AS x FROM tsplit_ WHERE split = 'train'")
define(
    "fitted_",
    f"""WITH RECURSIVE f AS (
  SELECT 0 AS step, [{', '.join('0.0::DOUBLE' for _ in _PLACES)}] AS w, 0.0::DOUBLE AS b
  UNION ALL
  SELECT step + 1, [{', '.join(f'w[{k}] - {calibration.RATE}::DOUBLE * (g{k} / n + {calibration.L2}::DOUBLE * w[{k}])' for k in _PLACES)}], b - {calibration.RATE}::DOUBLE * g / n
  FROM (SELECT step, any_value(w) AS w, any_value(b) AS b, sum(e) AS g, count(*) AS n, {', '.join(f'sum(e * x[{k}]) AS g{k}' for k in _PLACES)} FROM
    (SELECT step, w, b, x, 1 / (1 + exp(-greatest(-60, least(60, b + {' + '.join(f'x[{k}] * w[{k}]' for k in _PLACES)})))) - y AS e FROM f, terms_ WHERE step < {_STEPS})
  GROUP BY step)
) SELECT w, b FROM f WHERE step = {_STEPS}""",
)
define(
    "adopted_",
    f"""SELECT name, round(CASE WHEN row_number() OVER (ORDER BY r DESC, pos) = 1 THEN r + 1 - sum(r) OVER () ELSE r END, 2) AS weight FROM
  (SELECT name, pos, round_even(CASE WHEN sum(c) OVER () > 0 THEN c / sum(c) OVER () ELSE 1.0 / count(*) OVER () END, 2) AS r FROM
  (SELECT {list(pillars.NAMES)}[pos] AS name, pos, greatest(0, w[2 * pos - 1]) AS c FROM fitted_, unnest(generate_series(1, {len(pillars.NAMES)})) AS t(pos)))""",
)
_ADOPTED, _ = screen.composite_sql({n: f"w_{n}" for n in pillars.NAMES})
define(
    "fitvec_",
    f"""SELECT snapshot_id, ts, label, regime, 'fitted' AS vector, coalesce(round({_ADOPTED}, 6), '-infinity'::DOUBLE) AS score FROM tsplit_,
  (SELECT {', '.join(f"max(weight) FILTER (name = '{n}') AS w_{n}" for n in pillars.NAMES)} FROM adopted_) WHERE split = 'test'""",
)
define("fitauc_", auc_sql("fitvec_", "vector"))


@register(
    "m10_fit_steps",
    f"""SELECT {[t for n in pillars.NAMES for t in (n, n + '__missing')] + ['bias']}[k] AS term, round(list_append(w, b)[k], 6) AS coefficient
    FROM fitted_, unnest(generate_series(1, {len(_TERMS) + 1})) AS t(k)""",
)
def m10_steps(spark, d):
    """Coefficients after a fixed number of full-batch steps."""
    model = calibration.fit_steps(held_out(spark, d).where("split = 'train'"), _STEPS)
    rows = [*model.weights.items(), ("bias", model.bias)]
    return spark.createDataFrame(rows, "term string, coefficient double").withColumn("coefficient", F.round("coefficient", 6))


@register("m12_fitted_weights", "SELECT name, weight FROM adopted_")
def m12_fitted(spark, d):
    """The stepwise fit as it would be deployed."""
    model = calibration.fit_steps(held_out(spark, d).where("split = 'train'"), _STEPS)
    return spark.createDataFrame(list(calibration.weights_of(model, spark).items()), "name string, weight double")


@register(
    "m13_fitted_ranking",
    f"""SELECT vector, n, positives, round(auc, {DIG}) AS auc, round({_AL}, {DIG}) AS auc_low, round({_AH}, {DIG}) AS auc_high FROM fitauc_""",
)
def m13_fitted(spark, d):
    """The fitted vector, rounded as deployed, on rows that the fit has not seen."""
    split = held_out(spark, d)
    weights = calibration.weights_of(calibration.fit_steps(split.where("split = 'train'"), _STEPS), spark)
    long = calibration.vector_scores(
        split.where("split = 'test'"), {"fitted": calibration.composite_of(weights)}, ["snapshot_id", "ts", "label", "regime"]
    )
    r = calibration.ranking(long, ["vector"], digits=6)
    return r.select("vector", "n", "positives", *[F.round(c, DIG).alias(c) for c in ("auc", "auc_low", "auc_high")])


@register(
    "m11_predict",
    f"SELECT snapshot_id, round(1 / (1 + exp(-(0.25 + 1.5 * coalesce(onchain_structure / 100, 0.4) - 0.5 * (onchain_structure IS NULL)::INT + 0.75 * coalesce(mindshare / 100, 0.5)))), {DIG}) AS p FROM train_",
)
def m11(spark, d):
    weights = {t: 0.0 for t in calibration._terms()}
    weights.update(onchain_structure=1.5, onchain_structure__missing=-0.5, mindshare=0.75)
    means = {n: 0.0 for n in pillars.NAMES} | {"onchain_structure": 0.4, "mindshare": 0.5}
    model = calibration.Model(weights, 0.25, means)
    return training(spark, d).select("snapshot_id", F.round(model.predict(), DIG).alias("p"))


@register(
    "m12_deployable_weights",
    """SELECT name, round(normalised, 6) AS normalised, round(CASE WHEN row_number() OVER (ORDER BY r DESC, name) = 1 THEN r + 1 - sum(r) OVER () ELSE r END, 2) AS weight FROM
    (SELECT *, round_even(normalised, 2) AS r FROM (SELECT name, c / sum(c) OVER () AS normalised FROM (SELECT event_type AS name, greatest(0, round(avg(value) - 49, 6)) AS c FROM ev_ GROUP BY 1)))""",
)
def m12(spark, d):
    coef = I.events(spark, d).groupBy(F.col("event_type").alias("name")).agg(
        F.round(F.avg("value") - 49, 6).alias("coefficient")
    )
    w = calibration.deployable(coef.withColumn("pos", F.col("name")))
    return w.select("name", F.round("normalised", 6).alias("normalised"), F.round("weight", 2).alias("weight"))


@register(
    "m14_adoption_checks",
    f"""SELECT false AS phase_0_exit_criteria_met, max(positives) > 0 AS positive_events_in_test, coalesce(max(lo) FILTER (vector = 'priors') > 0.5, false) AS out_of_sample_auc_above_chance,
    coalesce(max(auc) FILTER (vector = 'priors') > max(auc) FILTER (vector = 'in_force'), false) AS beats_the_priors_out_of_sample,
    coalesce(max(lift) FILTER (vector = 'priors') > 1, false) AS top_decile_beats_base_rate, false AS may_replace_priors FROM
    (SELECT a.*, {_AL} AS lo, decile_positives / decile_size / (l.p / l.n) AS lift FROM vecauc_ a JOIN veclift_ l USING (vector))""",
)
def m14(spark, d):
    test = held_out(spark, d).where("split = 'test'")
    vectors = {"in_force": calibration.composite_of(pillars.FITTED_V1), "deployed": calibration.composite_of(pillars.PRIORS)}
    metrics = calibration.ranking(
        calibration.vector_scores(test, vectors, ["snapshot_id", "ts", "label"]), ["vector"], digits=6
    )
    return calibration.checks(metrics, gate_met=False).drop("beats_benchmark", "has_measured_edge")


_AFTER = 1704070000000
define(
    "hol_",
    "SELECT p.snapshot_id, p.ts, x.outcome, x.label, v.vector, CASE v.vector WHEN 'in_force' THEN "
    f"coalesce(round({_IN_FORCE}, 6), '-infinity'::DOUBLE) ELSE coalesce(round({_PRIOR}, 6), '-infinity'::DOUBLE) END AS score"
    " FROM pillars_ p JOIN ("
    + " UNION ALL ".join(
        f"SELECT snapshot_id, '{l}' AS outcome, ({f'{l} >= {t}' if t else l})::INT AS label FROM labels_late_"
        for l, t in calibration.LABELS
    )
    + f") x USING (snapshot_id) CROSS JOIN (VALUES ('in_force'), ('priors')) v(vector) WHERE x.label IS NOT NULL AND p.ts > {_AFTER}",
)
define("holauc_", auc_sql("hol_", "outcome, vector"))


@register(
    "m15_held_out_by_label",
    "SELECT o.outcome, v.vector, coalesce(a.n, 0) AS n, a.positives, round(a.auc, 6) AS auc FROM (VALUES "
    + ", ".join(f"('{l}')" for l, _ in calibration.LABELS)
    + ") o(outcome) CROSS JOIN (VALUES ('in_force'), ('priors')) v(vector) LEFT JOIN holauc_ a ON a.outcome = o.outcome AND a.vector = v.vector",
)
def m15(spark, d):
    r = calibration.held_out_by_label(I.features(spark, d), I.labels(spark, d), _AFTER, _VECTORS, digits=6)
    return r.select("outcome", "vector", "n", "positives", F.round("auc", 6).alias("auc"))


_FIN = screen.final_sql(pillars.FITTED_V1, cold=False)
define(
    "fincmp_",
    f"""SELECT t.snapshot_id, t.ts, t.label, coalesce(round(f.s, 6), '-infinity'::DOUBLE) AS score FROM tsplit_ t JOIN (SELECT snapshot_id, {_FIN} AS s FROM pillars_) f
  USING (snapshot_id) WHERE t.split = 'test'""",
)


@register("j17_final_score_comparison", f"SELECT n, positives, round(auc, {DIG}) AS auc FROM ({auc_sql('fincmp_', '')})")
def j17(spark, d):
    test = held_out(spark, d).where("split = 'test'").select("snapshot_id", "ts", "label")
    final = pillars.score(I.features(spark, d)).select("snapshot_id", F.round("score", 6).alias("score"))
    rows = test.join(final, "snapshot_id").withColumn("score", F.coalesce("score", F.lit(float("-inf"))))
    return stats.auc(rows, []).select("n", "positives", F.round("auc", DIG).alias("auc"))


@register("m15_calibration_report")
def m15_report(spark, d):
    """Verdict, explanation and adoption checks of a forced fit."""
    gate = calibration.exit_criteria(I.snapshots(spark, d), I.labels(spark, d), I.social(spark, d), "survived_24h")
    fitted = calibration.fit(training(spark, d), gate_met=False, force=True)
    n = fitted.split.where("split = 'test'").count()
    one = F.lit(1).alias("_one")
    said = calibration.verdict(fitted.metrics, gate, n)
    return said.select("*", one).join(calibration.checks(fitted.metrics, False).select("*", one), "_one").drop("_one")


@register(
    "f13_guarded_ratios",
    """SELECT pos, CASE WHEN b + s > 0 THEN b::DOUBLE / (b + s) END AS pressure, CASE WHEN s <> 0 THEN b::DOUBLE / s END AS div,
    CASE WHEN b IS NOT NULL AND s > 0 THEN (b / 1.0::DOUBLE) / (s / 6.0::DOUBLE) END AS pace, coalesce((b / 1.0::DOUBLE) / (nullif(s, 0) / 6.0::DOUBLE) >= 6 - 1e-9, false) AS pinned
    FROM (SELECT pos, CASE WHEN pos % 7 > 0 THEN pos % 5 END AS b, CASE WHEN pos % 11 > 0 THEN pos % 4 END AS s FROM ev_)""",
)
def f13(spark, d):
    from tidewatch.functions.values import div, pressure, window_ratio

    p = F.col("pos")
    rows = I.events(spark, d).select("pos", F.when(p % 7 > 0, p % 5).alias("b"), F.when(p % 11 > 0, p % 4).alias("s"))
    pace, pinned = window_ratio(F.col("b"), 1.0, F.col("s"), 6.0)
    return rows.select("pos", pressure("b", "s").alias("pressure"), div("b", "s").alias("div"), pace.alias("pace"), pinned.alias("pinned"))


@register(
    "f14_clamp_scale_mean",
    """SELECT pos, CASE WHEN pos % 3 > 0 THEN greatest(0.0, least(100.0, value / 200 * 100)) END AS scaled,
    CASE WHEN pos % 3 = 0 AND pos % 4 = 0 THEN NULL ELSE (CASE WHEN pos % 3 > 0 THEN value ELSE 0 END + CASE WHEN pos % 4 > 0 THEN 10 ELSE 0 END) / ((pos % 3 > 0)::INT + (pos % 4 > 0)::INT) END AS mean FROM ev_""",
)
def f14(spark, d):
    from tidewatch.functions.values import mean_of, scale

    p, v = F.col("pos"), F.col("value")
    x, y = F.when(p % 3 > 0, v), F.when(p % 4 > 0, 10.0)
    return I.events(spark, d).select("pos", scale(x, 0.0, 200.0).alias("scaled"), mean_of(x, y).alias("mean"))
