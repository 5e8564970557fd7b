"""Filters, pillars and rank statistics."""

import random

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import filters, pillars, stats


def check(spark, name, **facts):
    row = filters.inputs(spark.range(1))
    for k, v in facts.items():
        row = row.withColumn(k, F.lit(v).cast(filters.INPUTS[k]))
    return filters.single(row, name).first()["outcome"]


@pytest.mark.parametrize(
    "name, facts, want",
    [
        ("sellability", dict(honeypot=True), "reject"),
        ("sellability", dict(sell_tax_pct=5.01), "reject"),
        ("sellability", dict(honeypot=False, sells_failing=False, buy_tax_pct=5.0), "unknown"),
        ("sellability", dict(honeypot=False, sells_failing=False, buy_tax_pct=5.0, sell_tax_pct=0.0), "pass"),
        ("mint_authority", {}, "unknown"),
        ("mint_authority", dict(mint_revoked=False), "reject"),
        ("freeze_authority", dict(freeze_active=False), "pass"),
        ("liquidity_lock", dict(lp_burned=False), "reject"),
        ("liquidity_lock", dict(lp_burned=False, lp_locked_pct=97.0), "pass"),
        ("liquidity_lock", dict(lp_locked_pct=50.0), "unknown"),
        ("liquidity_lock", dict(lp_locked_pct=0.0), "reject"),
        ("liquidity_lock", dict(lp_locked_until_ms=10**12, lp_locked_pct=99.0), "unknown"),
        ("liquidity_lock", dict(lp_locked_until_ms=30 * 86_400_000, evaluated_at_ms=0), "pass"),
        ("liquidity_lock", dict(lp_locked_until_ms=29 * 86_400_000, evaluated_at_ms=0, lp_locked_pct=99.0), "reject"),
        ("concentration", dict(top10_ex_lp_pct=35.0), "pass"),
        ("deployer_history", dict(deployer_prior_rugs=1), "reject"),
        ("liquidity_depth", dict(liquidity_usd=10.0, fdv_usd=1000.0, mcap_usd=1.0), "reject"),
        ("liquidity_depth", dict(liquidity_usd=10.0, mcap_usd=0.0), "unknown"),
        ("proxy_risk", dict(chain="solana"), "pass"),
        ("proxy_risk", dict(chain="nowhere"), "unknown"),
        ("proxy_risk", dict(chain="base", upgradeable=True, admin_renounced=False), "reject"),
    ],
)
def test_filter_outcomes(spark, name, facts, want):
    assert check(spark, name, **facts) == want


def test_unknown_excludes_but_is_not_a_rejection(spark):
    r = filters.verdict(spark.range(1)).first()
    assert r["rejected_by"] == [] and len(r["indeterminate_on"]) == 8 and r["excluded"]


def score(spark, weights=None, regime=None, **cols):
    row = spark.range(1)
    for k, v in cols.items():
        row = row.withColumn(k, F.lit(v).cast(pillars.INPUTS[k]) if not isinstance(v, (list, dict)) else F.expr(v["sql"]))
    return pillars.score(row, weights, regime).first()


def test_young_token_drops_acceleration(spark):
    flow = dict(momentum_volume_1h_usd=10.0, momentum_volume_6h_usd=20.0)
    young = score(spark, age_at_trigger_minutes=120, **flow)["pillar_momentum_flow"]
    old = score(spark, age_at_trigger_minutes=600, **flow)["pillar_momentum_flow"]
    assert young["components"]["volume_acceleration"] is None and young["score"] is None
    assert old["components"]["volume_acceleration"] == 100.0


def test_zero_weight_pillars_make_no_composite(spark):
    r = score(spark, socials_declared_x=True)
    assert r["pillar_lineage_meta_fit"]["score"] == 45.0
    assert r["raw_score"] is None and r["score"] is None and r["modifiers_applied"] == []


def test_age_cliff_and_completeness(spark):
    assert score(spark, age_at_trigger_minutes=70 * 60)["pillar_asymmetry_timing"]["score"] == 0.0
    assert score(spark, age_at_trigger_minutes=72 * 60)["pillar_asymmetry_timing"]["score"] == 20.0
    half = score(spark, age_at_trigger_minutes=0, data_completeness=0.5)
    assert half["raw_score"] == 100.0 and half["score"] == 50.0
    cold = score(spark, regime="cold", age_at_trigger_minutes=0, data_completeness=0.5)
    assert cold["score"] == 50.0


def test_coordinated_posting_caps_attention(spark):
    r = score(spark, social_x_mentions_24h=100, social_x_unique_authors_24h=10, social_x_follower_weighted_reach=5e6)
    assert r["pillar_attention_velocity"]["score"] == 40.0


def brute_auc(pairs):
    pos = [s for y, s in pairs if y]
    neg = [s for y, s in pairs if not y]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def test_auc_matches_pair_counting(spark):
    rng = random.Random(5)
    rows = [("g1" if i % 3 else "g2", int(rng.random() < 0.4), float(rng.randrange(12))) for i in range(300)]
    got = {r["g"]: r["auc"] for r in stats.auc(spark.createDataFrame(rows, "g string, label int, score double"), ["g"]).collect()}
    for g in ("g1", "g2"):
        assert got[g] == pytest.approx(brute_auc([(y, s) for k, y, s in rows if k == g]))


def test_constant_score_and_single_class(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 0, 1.0), ("b", 1, 2.0)], "g string, label int, score double")
    got = {r["g"]: r["auc"] for r in stats.auc(df, ["g"]).collect()}
    assert got == {"a": 0.5, "b": None}


def test_time_split_and_leakage(spark):
    rows = [(i, i, "x" if i in (2, 9) else f"d{i}") for i in range(10)]
    s = stats.repair_leakage(stats.time_split(spark.createDataFrame(rows, "i int, ts int, deployer string"), "ts", "i"))
    got = {r["i"]: (r["split"], r["moved"]) for r in s.collect()}
    assert [i for i in got if got[i][0] == "test"] == [7, 8] or sorted(i for i in got if got[i][0] == "test") == [7, 8]
    assert got[9] == ("train", True)


def test_tie_mass_first_value_wins(spark):
    df = spark.createDataFrame([("g", 5.0, 0), ("g", 7.0, 1), ("g", 7.0, 2), ("g", 5.0, 3)], "g string, v double, pos int")
    r = stats.tie_mass(df, ["g"], "v", "pos").first()
    assert (r["tie_share"], r["tie_value"]) == (0.5, 5.0)
