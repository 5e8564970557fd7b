"""Filters and pillars over the stand-in snapshots."""

from pyspark.sql import functions as F

from tidewatch.catalog import inputs as I
from tidewatch.catalog import register
from tidewatch.catalog.sql import define
from tidewatch.functions.values import known
from tidewatch.operators import filters, pillars

UNK = "|| ' unknown; unknown is not clean'"

# outcome and reason of each check, as SQL CASE arms: (condition, outcome, reason)
SQL_CHECKS = {
    "sellability": [
        ("honeypot", "reject", "'honeypot detected'"),
        ("sells_failing", "reject", "'sells are failing'"),
        ("buy_tax_pct > 5", "reject", "printf('buy tax %.2f%% > 5.0%%', buy_tax_pct)"),
        ("sell_tax_pct > 5", "reject", "printf('sell tax %.2f%% > 5.0%%', sell_tax_pct)"),
        ("honeypot IS NULL OR sells_failing IS NULL", "unknown", f"'sellability' {UNK}"),
        ("buy_tax_pct IS NULL OR sell_tax_pct IS NULL", "unknown", f"'transfer tax' {UNK}"),
        ("true", "pass", "'sellable, taxes within limit'"),
    ],
    "mint_authority": [
        ("mint_revoked IS NULL", "unknown", f"'mint authority' {UNK}"),
        ("NOT mint_revoked", "reject", "'mint authority still active'"),
        ("true", "pass", "'mint authority revoked'"),
    ],
    "freeze_authority": [
        ("freeze_active IS NULL", "unknown", f"'freeze authority' {UNK}"),
        ("freeze_active", "reject", "'freeze authority active'"),
        ("true", "pass", "'freeze authority inactive'"),
    ],
    "liquidity_lock": [
        ("lp_burned", "pass", "'LP burned'"),
        ("lp_locked_until_ms IS NOT NULL AND evaluated_at_ms IS NULL", "unknown", f"'evaluation time' {UNK}"),
        (
            "(lp_locked_until_ms - evaluated_at_ms) / 86400000 < 30",
            "reject",
            "printf('LP lock expires in %.1fd < 30d', (lp_locked_until_ms - evaluated_at_ms) / 86400000)",
        ),
        (
            "lp_locked_until_ms IS NOT NULL",
            "pass",
            "printf('LP locked for %.0fd', (lp_locked_until_ms - evaluated_at_ms) / 86400000)",
        ),
        (
            "lp_locked_pct >= 95",
            "pass",
            "printf('%.0f%% of LP locked or burned; expiry not reported by any available source', lp_locked_pct)",
        ),
        ("lp_locked_pct <= 0", "reject", "'no LP locked or burned'"),
        (
            "lp_locked_pct IS NOT NULL",
            "unknown",
            "printf('only %.0f%% of LP locked, under the 95%% needed without an expiry; lock duration', "
            f"lp_locked_pct) {UNK}",
        ),
        ("NOT lp_burned", "reject", "'LP neither burned nor locked'"),
        ("true", "unknown", f"'LP burn and lock status' {UNK}"),
    ],
    "concentration": [
        ("top10_ex_lp_pct IS NULL", "unknown", f"'top-10 concentration' {UNK}"),
        ("top10_ex_lp_pct > 35", "reject", "printf('top-10 ex-LP hold %.1f%% > 35.0%%', top10_ex_lp_pct)"),
        ("true", "pass", "printf('top-10 ex-LP hold %.1f%%', top10_ex_lp_pct)"),
    ],
    "deployer_history": [
        ("deployer_prior_rugs IS NULL", "unknown", f"'deployer history' {UNK}"),
        ("deployer_prior_rugs >= 1", "reject", "'deployer linked to ' || deployer_prior_rugs || ' prior rug(s)'"),
        ("true", "pass", "'no prior rugs on deployer'"),
    ],
    "liquidity_depth": [
        ("liquidity_usd IS NULL OR coalesce(fdv_usd, mcap_usd) IS NULL", "unknown", f"'liquidity or valuation' {UNK}"),
        (
            "coalesce(fdv_usd, mcap_usd) <= 0",
            "unknown",
            f"CASE WHEN fdv_usd IS NULL THEN 'mcap' ELSE 'FDV' END || ' is not positive' {UNK}",
        ),
        (
            "liquidity_usd / coalesce(fdv_usd, mcap_usd) * 100 < 2",
            "reject",
            "printf('liquidity %.2f%% of %s < 2.0%%', liquidity_usd / coalesce(fdv_usd, mcap_usd) * 100, "
            "CASE WHEN fdv_usd IS NULL THEN 'mcap' ELSE 'FDV' END)",
        ),
        (
            "true",
            "pass",
            "printf('liquidity %.2f%% of %s', liquidity_usd / coalesce(fdv_usd, mcap_usd) * 100, "
            "CASE WHEN fdv_usd IS NULL THEN 'mcap' ELSE 'FDV' END)",
        ),
    ],
    "proxy_risk": [
        ("upgradeable IS NULL AND chain = 'c1'", "pass", "'proxies are not a construct on c1'"),
        (
            "upgradeable IS NULL AND chain NOT IN ('c0', 'c1', 'c2')",
            "unknown",
            f"'whether ' || chain || ' has EVM proxies' {UNK}",
        ),
        ("upgradeable IS NULL", "unknown", f"'upgradeability' {UNK}"),
        ("NOT upgradeable", "pass", "'contract is not upgradeable'"),
        ("admin_renounced IS NULL", "unknown", f"'proxy admin' {UNK}"),
        ("NOT admin_renounced", "reject", "'upgradeable with unrenounced admin'"),
        ("true", "pass", "'upgradeable but admin renounced'"),
    ],
}
IDS = {
    "sellability": "p07_sellability",
    "mint_authority": "p08_mint_authority",
    "freeze_authority": "p09_freeze_authority",
    "liquidity_lock": "p10_liquidity_lock",
    "concentration": "p11_concentration",
    "deployer_history": "p12_deployer_history",
    "liquidity_depth": "p13_liquidity_depth",
    "proxy_risk": "p14_proxy_risk",
}


def _case(name: str, part: int) -> str:
    arms = " ".join(
        f"WHEN {c} THEN {repr(o) if part == 1 else r}" for c, o, r in SQL_CHECKS[name]
    )
    return f"CASE {arms} END"


def _register_check(name: str) -> None:
    @register(
        IDS[name],
        f"SELECT snapshot_id, {_case(name, 1)} AS outcome, {_case(name, 2)} AS reason FROM fin_",
    )
    def run(spark, d):
        return filters.single(I.filter_inputs(spark, d), name, I.STAND_IN_CHAINS).select(
            "snapshot_id", "outcome", "reason"
        )


for _name in IDS:
    _register_check(_name)


def _names(outcome: str) -> str:
    parts = ", ".join(f"CASE WHEN ({_case(n, 1)}) = '{outcome}' THEN '{n}' END" for n in SQL_CHECKS)
    return f"concat_ws(',', {parts})"


define(
    "verdict_",
    f"SELECT snapshot_id, {_names('reject')} AS rejected_by, {_names('unknown')} AS indeterminate_on FROM fin_",
)


@register(
    "p15_verdict",
    "SELECT *, rejected_by <> '' OR indeterminate_on <> '' AS excluded FROM verdict_",
)
def p15(spark, d):
    return filters.verdict(I.filter_inputs(spark, d), I.STAND_IN_CHAINS).select(
        "snapshot_id",
        F.array_join("rejected_by", ",").alias("rejected_by"),
        F.array_join("indeterminate_on", ",").alias("indeterminate_on"),
        "excluded",
    )


@register(
    "p06_filter_input_override",
    """SELECT s.snapshot_id, coalesce(f.mint_revoked, s.user_id % 2 = 0) AS mint_revoked,
    coalesce(f.freeze_active, s.user_id % 3 = 0) AS freeze_active,
    coalesce(f.top10_ex_lp_pct, 12.5::DOUBLE) AS top10_ex_lp_pct, f.honeypot, f.lp_burned,
    f.deployer_prior_rugs FROM snap_ s LEFT JOIN safety0_ f USING (chain, contract)""",
)
def p06(spark, d):
    u = F.col("user_id")
    own = I.snapshots(spark, d).select(
        "snapshot_id",
        *I.TOKEN,
        (u % 2 == 0).alias("mint_revoked"),
        (u % 3 == 0).alias("freeze_active"),
        F.lit(12.5).alias("top10_ex_lp_pct"),
    )
    return filters.override(own, I.safety(spark, d), I.TOKEN).select(
        "snapshot_id", "mint_revoked", "freeze_active", "top10_ex_lp_pct", "honeypot", "lp_burned",
        "deployer_prior_rugs",
    )


MEASURED = (
    "honeypot", "sells_failing", "buy_tax_pct", "sell_tax_pct", "mint_revoked", "freeze_active",
    "lp_burned", "lp_locked_pct", "top10_ex_lp_pct", "holder_count", "upgradeable",
    "admin_renounced", "deployer_address", "deployer_prior_rugs",
)


@register(
    "p27_measured_fields",
    "SELECT contract, "
    + " + ".join(f"({c} IS NOT NULL)::BIGINT" for c in MEASURED)
    + " AS measured_fields FROM safety0_",
)
def p27(spark, d):
    return I.safety(spark, d).select(
        "contract", known(*[F.col(c) for c in MEASURED]).cast("bigint").alias("measured_fields")
    )


# --- pillars ------------------------------------------------------------------


def _scale(x: str, lo: float, hi: float) -> str:
    return f"CASE WHEN ({x}) IS NOT NULL THEN greatest(0.0, least(100.0, (({x})::DOUBLE - {lo}) / ({hi} - ({lo}))::DOUBLE * 100.0)) END"


def _clamp(x: str) -> str:
    return f"CASE WHEN ({x}) IS NOT NULL THEN greatest(0.0, least(100.0, {x})) END"


def _ratio(a: str, b: str) -> str:
    return f"CASE WHEN ({b}) > 0 THEN ({a})::DOUBLE / ({b})::DOUBLE END"


M24, REPLY = "social_x_mentions_24h", "social_x_reply_to_post_ratio"
DIVERSITY = _ratio("social_x_unique_authors_24h", M24)
TILT = (
    f"({_ratio('mindshare_boost_total', 'mindshare_universe_boost_total')}) / nullif(CASE WHEN "
    f"({_ratio('mindshare_txns_24h', 'mindshare_universe_txns_24h')}) > 0 THEN "
    f"{_ratio('mindshare_txns_24h', 'mindshare_universe_txns_24h')} END, 0)"
)
P1 = _ratio("momentum_buys_1h", "momentum_buys_1h + momentum_sells_1h")
P24 = _ratio("momentum_buys_24h", "momentum_buys_24h + momentum_sells_24h")
PACE = (
    "CASE WHEN momentum_volume_6h_usd > 0 THEN (momentum_volume_1h_usd / 1.0::DOUBLE) / "
    "(momentum_volume_6h_usd / 6.0::DOUBLE) END"
)
YOUNG = "coalesce(age_at_trigger_minutes / 60.0::DOUBLE < 6, false)"
DECLARED_N = (
    "coalesce(socials_declared_telegram, false)::INT + coalesce(socials_declared_x, false)::INT"
    " + coalesce(socials_declared_website, false)::INT"
)
PARTS = {
    "attention_velocity": {
        "mention_slope": _scale(
            f"(social_x_mentions_6h / 6.0::DOUBLE) / (CASE WHEN {M24} > 0 THEN {M24} END / 24.0::DOUBLE)", 0.5, 3.0
        ),
        "author_diversity": _scale(DIVERSITY, 0.1, 0.6),
        "reach_quality": _scale("social_x_follower_weighted_reach", 0.0, 5000000.0),
        "tier1_crossover": _scale("social_x_tier1_organic_engagements", 0.0, 5.0),
        "reply_ratio": _scale(REPLY, 0.0, 1.5),
    },
    "community_depth": {
        "speaker_ratio": _scale(_ratio("social_tg_unique_speakers_24h", "social_tg_members"), 0.0, 0.15),
        "member_growth": _scale("social_tg_member_growth_6h_pct", 0.0, 200.0),
        "messages_per_hour": _scale("social_tg_msgs_per_hour", 0.0, 300.0),
        "member_count": _scale("social_tg_members", 0.0, 20000.0),
    },
    "lineage_meta_fit": {
        "position_in_meta": "CASE lineage_position_in_meta WHEN 'first' THEN 100.0::DOUBLE WHEN 'second' THEN 65.0 WHEN 'derivative' THEN 20.0 END",
        "in_live_meta": "CASE WHEN lineage_meta_tag IS NOT NULL THEN 70.0::DOUBLE END",
        "cross_platform_crossover": "list_avg(list_filter([{}, {}], lambda x: x IS NOT NULL))".format(
            _scale("trends_google_trends_delta", 0.0, 100.0), _scale("trends_tiktok_video_count_delta", 0.0, 500.0)
        ),
        "socials_declared": "CASE WHEN coalesce(socials_declared_telegram, socials_declared_x, socials_declared_website)"
        f" IS NOT NULL THEN list_extract([5.0, 45.0, 65.0, 90.0], {DECLARED_N} + 1)::DOUBLE END",
    },
    "onchain_structure": {
        "holder_growth": _scale("holders_growth_6h_pct", 0.0, 150.0),
        "concentration": _clamp("100.0::DOUBLE - holders_top10_ex_lp_pct * 2.0"),
        "bundle_sniper": _clamp("100.0::DOUBLE - launch_bundled_supply_pct * 3.0"),
        "smart_money": _clamp(
            "flows_smart_money_hit_rate * 100.0::DOUBLE * CASE WHEN flows_smart_money_entries IS NOT NULL"
            " THEN least(1.0::DOUBLE, flows_smart_money_entries / 5.0::DOUBLE) END"
        ),
        "turnover": _clamp("100.0::DOUBLE - abs(market_volume_24h_usd / nullif(market_mcap_usd, 0) - 1.5::DOUBLE) * 40.0::DOUBLE"),
        "liquidity_depth": _scale("market_liquidity_usd / nullif(market_mcap_usd, 0) * 100.0::DOUBLE", 0.0, 15.0),
    },
    "asymmetry_timing": {
        "mcap_band": "CASE WHEN market_mcap_usd <= 0 THEN NULL WHEN market_mcap_usd < 500000 THEN 90.0::DOUBLE"
        " WHEN market_mcap_usd < 2000000 THEN 70.0 WHEN market_mcap_usd < 10000000 THEN 45.0"
        " WHEN market_mcap_usd IS NOT NULL THEN 20.0 END",
        "age": "CASE WHEN age_at_trigger_minutes / 60.0::DOUBLE < 72 THEN "
        + _clamp("100.0::DOUBLE - age_at_trigger_minutes / 60.0::DOUBLE * 1.5::DOUBLE")
        + " WHEN age_at_trigger_minutes IS NOT NULL THEN 20.0 END",
        "listing_ladder": "CASE WHEN list_contains(listings, 'cex_perp') THEN 70.0::DOUBLE WHEN"
        " list_contains(listings, 'dex') THEN 20.0 END",
    },
    "mindshare": {
        "universe_percentile": _clamp("mindshare_percentile::DOUBLE"),
        "share_level": _scale("mindshare_share_pct", 0.0, 5.0),
        "venue_breadth": _scale("mindshare_pair_count", 1.0, 6.0),
        "organic_tilt": f"CASE WHEN ({TILT}) <= 1 THEN 100.0::DOUBLE ELSE {_clamp(f'100.0::DOUBLE - (({TILT}) - 1.0::DOUBLE) * 50.0::DOUBLE')} END",
    },
    "momentum_flow": {
        "buy_pressure_1h": _scale(P1, 0.40, 0.65),
        "buy_pressure_24h": _scale(P24, 0.40, 0.65),
        "pressure_trend": _scale(f"({P1}) - ({P24})", -0.15, 0.15),
        "volume_acceleration": _scale(f"CASE WHEN NOT {YOUNG} AND ({PACE}) < 6 - 1e-9 THEN {PACE} END", 0.3, 3.0),
        "price_slope": _scale(
            f"CASE WHEN momentum_price_change_6h_pct IS NOT NULL AND NOT {YOUNG} THEN"
            " momentum_price_change_1h_pct - momentum_price_change_6h_pct / 6.0::DOUBLE"
            " ELSE momentum_price_change_1h_pct END",
            -10.0,
            10.0,
        ),
    },
}
DIGITS = 6


def _sum_mean(names) -> str:
    top = " + ".join(f"coalesce({n}, 0)" for n in names)
    n = " + ".join(f"({n} IS NOT NULL)::INT" for n in names)
    return f"({top}) / nullif({n}, 0)"


for _p, _parts in PARTS.items():
    _cols = ", ".join(f"{sql} AS {n}" for n, sql in _parts.items())
    _score = _sum_mean(_parts)
    if _p == "attention_velocity":
        _score = f"CASE WHEN diversity_ratio < 0.25 THEN least({_score}, CASE WHEN ({_score}) IS NOT NULL THEN 40.0 END) ELSE {_score} END"
        _cols += f", {DIVERSITY} AS diversity_ratio"
    define(
        f"pil_{_p}_",
        f"SELECT * EXCLUDE (ignored), {_score} AS score FROM (SELECT snapshot_id, 0 AS ignored, {_cols} FROM feat_)",
    )


def _register_pillar(tag: str, name: str) -> None:
    parts = list(PARTS[name])
    cols = ", ".join(f"round({c}, {DIGITS}) AS {c}" for c in [*parts, "score"])

    @register(f"{tag}_{name}", f"SELECT snapshot_id, {cols} FROM pil_{name}_")
    def run(spark, d):
        rows = I.features(spark, d)
        p = f"pillar_{name}"
        return pillars.add(rows, (name,)).select(
            "snapshot_id",
            *[F.round(f"{p}.components.{c}", DIGITS).alias(c) for c in parts],
            F.round(f"{p}.score", DIGITS).alias("score"),
        )


for _i, _name in enumerate(PARTS):
    _register_pillar(f"x{_i + 3:02d}", _name)

define(
    "pillars_",
    "SELECT f.snapshot_id, f.user_id, f.ts, f.chain, f.contract, f.data_completeness, f.flow_whale, f.flow_small, "
    + ", ".join(f"p{i}.score AS {n}" for i, n in enumerate(PARTS))
    + " FROM feat_ f "
    + " ".join(f"JOIN pil_{n}_ p{i} USING (snapshot_id)" for i, n in enumerate(PARTS)),
)


def composite_sql(weights: dict[str, float]) -> tuple[str, str]:
    top = " + ".join(f"coalesce({w} * {n}, 0)" for n, w in weights.items())
    weight = " + ".join(f"CASE WHEN {n} IS NOT NULL THEN {w}::DOUBLE ELSE 0 END" for n, w in weights.items())
    return f"CASE WHEN ({weight}) > 0 THEN ({top}) / ({weight}) END", weight


def _composites() -> str:
    cols = []
    for tag, w in (("fitted", pillars.FITTED_V1), ("prior", pillars.PRIORS)):
        value, weight = composite_sql(w)
        cols += [f"round({value}, {DIGITS}) AS {tag}_composite", f"round({weight}, {DIGITS}) AS {tag}_weight"]
    return f"SELECT snapshot_id, {', '.join(cols)} FROM pillars_"


@register("x10_composite", _composites())
def x10(spark, d):
    df = pillars.add(I.features(spark, d))
    scores = {n: F.col(f"pillar_{n}.score") for n in pillars.NAMES}
    out = []
    for tag, w in (("fitted", pillars.FITTED_V1), ("prior", pillars.PRIORS)):
        value, weight = pillars.composite(scores, w)
        out += [
            F.round(value, DIGITS).alias(f"{tag}_composite"),
            F.round(weight, DIGITS).alias(f"{tag}_weight"),
        ]
    return df.select("snapshot_id", *out)


def final_sql(weights: dict[str, float], cold: bool = True) -> str:
    value, _ = composite_sql(weights)
    s = f"({value}) * CASE WHEN coalesce(data_completeness, 1.0) < 1 THEN data_completeness ELSE 1.0::DOUBLE END"
    if cold:
        s = f"50.0::DOUBLE + (({s}) - 50.0) * 0.5::DOUBLE"
    hit = "coalesce(attention_velocity >= 70 AND flow_whale < 0 AND flow_small > 0, false)"
    return _clamp(f"CASE WHEN {hit} THEN {_clamp(f'({s}) - 20.0::DOUBLE')} ELSE {s} END")


@register(
    "x11_final_score",
    f"SELECT snapshot_id, round({final_sql(pillars.PRIORS)}, {DIGITS}) AS score,"
    " coalesce(attention_velocity >= 70 AND flow_whale < 0 AND flow_small > 0, false) AS contradiction FROM pillars_",
)
def x11(spark, d):
    return pillars.score(I.features(spark, d), pillars.PRIORS, regime="cold").select(
        "snapshot_id",
        F.round("score", DIGITS).alias("score"),
        F.exists("modifiers_applied", lambda m: m.startswith("contradiction")).alias("contradiction"),
    )


@register(
    "x11_pillar_notes",
    f"""SELECT snapshot_id, note FROM (SELECT snapshot_id, unnest([
    CASE WHEN (social_x_mentions_6h / 6.0::DOUBLE) / (CASE WHEN {M24} > 0 THEN {M24} END / 24.0::DOUBLE) < 1
      THEN 'mention curve decelerating at level -- distribution signature' END,
    CASE WHEN ({DIVERSITY}) < 0.25 THEN printf('author diversity %.2f implies coordinated posting', {DIVERSITY}) END,
    CASE WHEN {REPLY} = 0 AND {M24} <> 0 THEN 'one-way posting with no replies -- manufactured presence' END,
    CASE WHEN launch_bundled_supply_pct > 25 THEN printf('%.0f%% bundled at launch -- the float is an illusion',
      launch_bundled_supply_pct) END,
    CASE WHEN ({TILT}) >= 2 THEN printf('boost share is %.1fx trade share -- this mindshare is bought', {TILT}) END,
    CASE WHEN momentum_price_change_6h_pct > 25 AND momentum_price_change_1h_pct < 0 THEN printf(
      'up %.0f%% over 6h and down %.1f%% in the last hour -- the move is rolling over',
      momentum_price_change_6h_pct, momentum_price_change_1h_pct) END]) AS note FROM feat_)
    WHERE note IS NOT NULL""",
)
def x11_notes(spark, d):
    kinds = ("mention curve", "author diversity", "one-way", "bundled at launch", "boost share", "rolling over")
    rows = pillars.score(I.features(spark, d)).select("snapshot_id", F.explode("notes").alias("note"))
    wanted = F.lit(False)
    for k in kinds:
        wanted = wanted | F.col("note").contains(k)
    return rows.where(wanted)
