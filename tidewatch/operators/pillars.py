"""Seven null-aware scoring pillars, their composite and the final score."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.chains import lookup
from tidewatch.functions.values import clamp, known, mean_of, pressure, ratio, scale, window_ratio

NAMES = (
    "attention_velocity", "community_depth", "lineage_meta_fit", "onchain_structure",
    "asymmetry_timing", "mindshare", "momentum_flow",
)
# Weight vectors over NAMES, and the modifiers.
FITTED_V1 = dict(zip(NAMES, (0.0, 0.0, 0.0, 0.55, 0.37, 0.08, 0.0)))
PRIORS = dict(zip(NAMES, (0.28, 0.20, 0.15, 0.22, 0.15, 0.0, 0.0)))
WEIGHTS_VERSION = "fitted-v1"
COLD_COMPRESSION = 0.5
CONTRADICTION_PENALTY = -20.0
DIVERSITY_FLOOR = 0.25
COORDINATED_CAP = 40.0
SPEAKER_FLOOR = 0.02
PAID_TILT = 2.0
PRESSURE_FLOOR, PRESSURE_CEILING = 0.40, 0.65
# Score per declared social count, meta position and listing rung.
DECLARED_SCORE = {0: 5.0, 1: 45.0, 2: 65.0, 3: 90.0}
POSITION_SCORE = {"first": 100.0, "second": 65.0, "derivative": 20.0}
LISTING_SCORE = {"dex": 20.0, "aggregator": 45.0, "cex_perp": 70.0, "cex_spot": 95.0}

# Inputs by stored column name; a column the caller lacks is unknown.
INPUTS = {
    "age_at_trigger_minutes": "bigint",
    "listings": "array<string>",
    "data_completeness": "double",
    "market_mcap_usd": "double",
    "market_liquidity_usd": "double",
    "market_volume_24h_usd": "double",
    "momentum_volume_1h_usd": "double",
    "momentum_volume_6h_usd": "double",
    "momentum_buys_1h": "bigint",
    "momentum_sells_1h": "bigint",
    "momentum_buys_24h": "bigint",
    "momentum_sells_24h": "bigint",
    "momentum_price_change_1h_pct": "double",
    "momentum_price_change_6h_pct": "double",
    "holders_growth_6h_pct": "double",
    "holders_top10_ex_lp_pct": "double",
    "launch_bundled_supply_pct": "double",
    "flows_net_flow_by_cohort": "map<string,double>",
    "flows_smart_money_entries": "bigint",
    "flows_smart_money_hit_rate": "double",
    "mindshare_share_pct": "double",
    "mindshare_percentile": "double",
    "mindshare_txns_24h": "bigint",
    "mindshare_boost_total": "double",
    "mindshare_pair_count": "bigint",
    "mindshare_universe_txns_24h": "bigint",
    "mindshare_universe_boost_total": "double",
    "social_x_mentions_6h": "bigint",
    "social_x_mentions_24h": "bigint",
    "social_x_unique_authors_24h": "bigint",
    "social_x_follower_weighted_reach": "double",
    "social_x_tier1_organic_engagements": "bigint",
    "social_x_reply_to_post_ratio": "double",
    "social_tg_members": "bigint",
    "social_tg_member_growth_6h_pct": "double",
    "social_tg_msgs_per_hour": "double",
    "social_tg_unique_speakers_24h": "bigint",
    "socials_declared_telegram": "boolean",
    "socials_declared_x": "boolean",
    "socials_declared_website": "boolean",
    "trends_google_trends_delta": "double",
    "trends_tiktok_video_count_delta": "double",
    "lineage_meta_tag": "string",
    "lineage_position_in_meta": "string",
}


def with_inputs(df: DataFrame) -> DataFrame:
    missing = {c: F.lit(None).cast(t) for c, t in INPUTS.items() if c not in df.columns}
    return df.withColumns(missing) if missing else df


@dataclass(frozen=True)
class Pillar:
    """Components of a pillar, its notes, and how the mean of the components becomes its score."""

    parts: dict[str, Column]
    notes: list[Column] = field(default_factory=list)
    finish: Callable[[Column], Column] = lambda mean: mean


def attention_velocity() -> Pillar:
    m24 = F.col("social_x_mentions_24h")
    replies = F.col("social_x_reply_to_post_ratio")
    pace = F.try_divide(F.col("social_x_mentions_6h") / 6.0, F.when(m24 > 0, m24) / 24.0)
    spread = ratio("social_x_unique_authors_24h", m24)
    parts = {
        "mention_slope": scale(pace, 0.5, 3.0),
        "author_diversity": scale(spread, 0.1, 0.6),
        "reach_quality": scale("social_x_follower_weighted_reach", 0.0, 5_000_000.0),
        "tier1_crossover": scale("social_x_tier1_organic_engagements", 0.0, 5.0),
        "reply_ratio": scale(replies, 0.0, 1.5),
    }

    def cap(mean: Column) -> Column:
        # least() skips nulls, so the cap applies only where a mean exists.
        low = F.least(mean, F.lit(COORDINATED_CAP))
        return F.when(mean.isNotNull() & (spread < DIVERSITY_FLOOR), low).otherwise(mean)

    return Pillar(
        parts,
        [
            F.when(pace < 1.0, "mention curve decelerating at level -- distribution signature"),
            F.when(
                spread < DIVERSITY_FLOOR,
                F.format_string("author diversity %.2f implies coordinated posting", spread),
            ),
            F.when(
                (replies == 0) & (m24 != 0),
                "one-way posting with no replies -- manufactured presence",
            ),
        ],
        cap,
    )


def community_depth() -> Pillar:
    members = F.col("social_tg_members")
    speakers = ratio("social_tg_unique_speakers_24h", members)
    parts = {
        "speaker_ratio": scale(speakers, 0.0, 0.15),
        "member_growth": scale("social_tg_member_growth_6h_pct", 0.0, 200.0),
        "messages_per_hour": scale("social_tg_msgs_per_hour", 0.0, 300.0),
        "member_count": scale(members, 0.0, 20_000.0),
    }
    dead = F.format_string("speaker ratio %.3f -- dead room with a big number", speakers)
    return Pillar(parts, [F.when(speakers < SPEAKER_FLOOR, dead)])


def lineage_meta_fit() -> Pillar:
    declared = [F.col(f"socials_declared_{s}") for s in ("telegram", "x", "website")]
    yes = sum((F.coalesce(d, F.lit(False)).cast("int") for d in declared), F.lit(0))
    parts = {
        "position_in_meta": lookup(POSITION_SCORE, F.col("lineage_position_in_meta")),
        "in_live_meta": F.when(F.col("lineage_meta_tag").isNotNull(), 70.0),
        "cross_platform_crossover": mean_of(
            scale("trends_google_trends_delta", 0.0, 100.0),
            scale("trends_tiktok_video_count_delta", 0.0, 500.0),
        ),
        "socials_declared": F.when(known(*declared) > 0, lookup(DECLARED_SCORE, yes)),
    }
    return Pillar(parts)


def onchain_structure() -> Pillar:
    mcap = F.when(F.col("market_mcap_usd") != 0, F.col("market_mcap_usd"))
    bundled = F.col("launch_bundled_supply_pct")
    entries = F.col("flows_smart_money_entries").cast("double")
    turnover = F.try_divide(F.col("market_volume_24h_usd"), mcap)
    weight = F.when(entries.isNotNull(), F.least(F.lit(1.0), entries / 5.0))
    parts = {
        "holder_growth": scale("holders_growth_6h_pct", 0.0, 150.0),
        "concentration": clamp(100.0 - F.col("holders_top10_ex_lp_pct") * 2.0),
        "bundle_sniper": clamp(100.0 - bundled * 3.0),
        "smart_money": clamp(F.col("flows_smart_money_hit_rate") * 100.0 * weight),
        "turnover": clamp(100.0 - F.abs(turnover - 1.5) * 40.0),
        "liquidity_depth": scale(F.try_divide(F.col("market_liquidity_usd"), mcap) * 100.0, 0.0, 15.0),
    }
    note = F.format_string("%.0f%% bundled at launch -- the float is an illusion", bundled)
    return Pillar(parts, [F.when(bundled > 25, note)])


def asymmetry_timing() -> Pillar:
    mcap = F.col("market_mcap_usd")
    hours = F.col("age_at_trigger_minutes") / 60.0
    rungs = F.array_compact(
        F.transform(F.coalesce("listings", F.array().cast("array<string>")), lambda x: lookup(LISTING_SCORE, x))
    )
    parts = {
        "mcap_band": F.when(mcap <= 0, None)
        .when(mcap < 500_000, 90.0)
        .when(mcap < 2_000_000, 70.0)
        .when(mcap < 10_000_000, 45.0)
        .when(mcap.isNotNull(), 20.0),
        "age": F.when(hours < 72, clamp(100.0 - hours * 1.5)).when(hours.isNotNull(), 20.0),
        "listing_ladder": F.array_max(rungs),
    }
    return Pillar(parts)


def mindshare() -> Pillar:
    boost = ratio("mindshare_boost_total", "mindshare_universe_boost_total")
    trade = ratio("mindshare_txns_24h", "mindshare_universe_txns_24h")
    tilt = F.try_divide(boost, F.when(trade > 0, trade))
    parts = {
        "universe_percentile": clamp(F.col("mindshare_percentile")),
        "share_level": scale("mindshare_share_pct", 0.0, 5.0),
        "venue_breadth": scale("mindshare_pair_count", 1.0, 6.0),
        "organic_tilt": F.when(tilt <= 1.0, 100.0).otherwise(clamp(100.0 - (tilt - 1.0) * 50.0)),
    }
    return Pillar(
        parts,
        [
            F.when(
                tilt >= PAID_TILT,
                F.format_string("boost share is %.1fx trade share -- this mindshare is bought", tilt),
            ),
            F.when(
                (boost > 0) & trade.isNull(),
                "paid boosts present but trade counts unknown -- tilt unmeasurable",
            ),
        ],
    )


def momentum_flow() -> Pillar:
    p1 = pressure("momentum_buys_1h", "momentum_sells_1h")
    p24 = pressure("momentum_buys_24h", "momentum_sells_24h")
    hours = F.col("age_at_trigger_minutes") / 60.0
    young = F.coalesce(hours < 6.0, F.lit(False))
    pace, pinned = window_ratio(
        F.col("momentum_volume_1h_usd"), 1.0, F.col("momentum_volume_6h_usd"), 6.0
    )
    usable_pace = F.when(~pinned & ~young, pace)
    c1, c6 = F.col("momentum_price_change_1h_pct"), F.col("momentum_price_change_6h_pct")
    move = F.when(c6.isNotNull() & ~young, c1 - c6 / 6.0).otherwise(c1)
    parts = {
        "buy_pressure_1h": scale(p1, PRESSURE_FLOOR, PRESSURE_CEILING),
        "buy_pressure_24h": scale(p24, PRESSURE_FLOOR, PRESSURE_CEILING),
        "pressure_trend": scale(p1 - p24, -0.15, 0.15),
        "volume_acceleration": scale(usable_pace, 0.3, 3.0),
        "price_slope": scale(move, -10.0, 10.0),
    }
    return Pillar(
        parts,
        [
            F.when(
                (p1 - p24 <= -0.10) & (p24 >= 0.55),
                F.format_string(
                    "buy pressure fell from %.2f (24h) to %.2f (1h) -- selling into the day's bid",
                    p24,
                    p1,
                ),
            ),
            F.when(
                pinned,
                "1h and 6h volume are identical -- the token is younger than six hours, so the "
                "acceleration is pinned by arithmetic and is not scored",
            ).when(
                young & pace.isNotNull(),
                F.format_string(
                    "the token is %.1fh old, younger than the six-hour window, so 1h volume "
                    "against the 6h rate reads its age and is not scored",
                    hours,
                ),
            ),
            F.when(
                usable_pace < 0.5,
                F.format_string(
                    "hourly volume is %.2fx the 6h rate -- attention is draining", pace
                ),
            ),
            F.when(
                (c6 > 25) & (c1 < 0),
                F.format_string(
                    "up %.0f%% over 6h and down %.1f%% in the last hour -- the move is rolling over",
                    c6,
                    c1,
                ),
            ),
        ],
    )


BUILDERS = {
    "attention_velocity": attention_velocity,
    "community_depth": community_depth,
    "lineage_meta_fit": lineage_meta_fit,
    "onchain_structure": onchain_structure,
    "asymmetry_timing": asymmetry_timing,
    "mindshare": mindshare,
    "momentum_flow": momentum_flow,
}


def add(df: DataFrame, names: tuple[str, ...] = NAMES) -> DataFrame:
    """Add one struct column per pillar, named pillar_<name>: score, components, notes.

    Components become columns before the means read them, and means before anything reads those:
    each expression is then evaluated once instead of being inlined at every use.
    """
    built = {n: BUILDERS[n]() for n in names}
    df = with_inputs(df)
    keep = df.columns
    df = df.withColumns({f"_{n}__{p}": c for n, b in built.items() for p, c in b.parts.items()})
    df = df.withColumns(
        {f"_{n}__mean": mean_of(*[F.col(f"_{n}__{p}") for p in b.parts]) for n, b in built.items()}
    )
    df = df.withColumns({f"_{n}__score": b.finish(F.col(f"_{n}__mean")) for n, b in built.items()})

    def packed(n: str, b: Pillar) -> Column:
        notes = F.array_compact(F.array(*b.notes)) if b.notes else F.array().cast("array<string>")
        return F.struct(
            F.col(f"_{n}__score").alias("score"),
            F.struct(*[F.col(f"_{n}__{p}").alias(p) for p in b.parts]).alias("components"),
            notes.alias("notes"),
        )

    return df.select(*keep, *[packed(n, b).alias(f"pillar_{n}") for n, b in built.items()])


def composite(scores: dict[str, Column], weights: dict[str, float]) -> tuple[Column, Column]:
    """(weighted mean over resolved pillars, weight that resolved).

    Resolved pillars of zero weight do not make a composite of zero: the mean is then null.
    """
    top, weight = F.lit(0.0), F.lit(0.0)
    for name, score in scores.items():
        if name not in weights:
            continue
        w = float(weights[name])
        top = top + F.coalesce(w * score, F.lit(0.0))
        weight = weight + F.when(score.isNotNull(), F.lit(w)).otherwise(0.0)
    return F.when(weight > 0, top / weight), weight


def contradiction() -> Column:
    """Attention peaking while large wallets sell to small ones."""
    flows = F.col("flows_net_flow_by_cohort")

    def cohort(main: str, other: str) -> Column:
        value = F.try_element_at(flows, F.lit(main))
        return F.when(value != 0, value).otherwise(F.try_element_at(flows, F.lit(other)))

    big, small = cohort("large", "whale"), cohort("small", "retail")
    return F.coalesce(
        (F.col("pillar_attention_velocity.score") >= 70) & (big < 0) & (small > 0), F.lit(False)
    )


def score(
    df: DataFrame,
    weights: dict[str, float] | None = None,
    regime: str | None = None,
) -> DataFrame:
    """Pillars, raw_score, resolved_weight, score and the modifiers applied, in order."""
    df = add(df)
    scores = {n: F.col(f"pillar_{n}.score") for n in NAMES}
    raw, weight = composite(scores, weights or FITTED_V1)
    share = F.coalesce("data_completeness", F.lit(1.0))
    s = F.when(share < 1.0, F.col("raw_score") * share).otherwise(F.col("raw_score"))
    notes = [F.when(share < 1.0, F.format_string("data_completeness x%.2f", share))]
    if regime == "cold":
        s = 50.0 + (s - 50.0) * COLD_COMPRESSION
        notes.append(F.lit("cold regime: compressed toward midpoint"))
    elif regime:
        notes.append(F.lit(f"{regime} regime: no adjustment"))
    against = contradiction()
    s = F.when(against, clamp(s + CONTRADICTION_PENALTY)).otherwise(s)
    notes.append(F.when(against, f"contradiction penalty {CONTRADICTION_PENALTY:+.0f}"))
    empty = F.array().cast("array<string>")
    return (
        df.withColumn("raw_score", raw)
        .withColumn("resolved_weight", weight)
        .withColumn("score", clamp(s))
        .withColumn(
            "modifiers_applied",
            F.when(F.col("raw_score").isNull(), empty).otherwise(F.array_compact(F.array(*notes))),
        )
        .withColumn(
            "data_gaps",
            F.array_compact(F.array(*[F.when(c.isNull(), F.lit(n)) for n, c in scores.items()])),
        )
        .withColumn("notes", F.flatten(F.array(*[F.col(f"pillar_{n}.notes") for n in NAMES])))
    )
