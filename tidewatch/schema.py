"""Explicit table schemas, their keys, and the conformity check."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VERSION = 8

# Feature groups of a snapshot and their fields.
GROUPS = {
    "market": "mcap_usd double, liquidity_usd double, volume_24h_usd double, price_usd double, fdv_usd double",
    "momentum": (
        "volume_1h_usd double, volume_6h_usd double, txns_1h bigint, buys_1h bigint, sells_1h bigint, "
        "buys_24h bigint, sells_24h bigint, price_change_5m_pct double, price_change_1h_pct double, "
        "price_change_6h_pct double, price_change_24h_pct double"
    ),
    "holders": "count bigint, growth_6h_pct double, top10_ex_lp_pct double",
    "authorities": "mint_revoked boolean, freeze_active boolean, lp_locked_until bigint",
    "deployer": "address string, prior_launches bigint, prior_rugs bigint",
    "launch": "bundled_supply_pct double, sniper_wallets bigint, initial_buy_sol double",
    "flows": (
        "net_flow_by_cohort map<string,double>, smart_money_entries bigint, smart_money_hit_rate double"
    ),
    "mindshare": (
        "share_pct double, rank bigint, percentile double, universe_size bigint, txns_24h bigint, "
        "txns_6h bigint, boost_amount double, boost_total double, boosts_active double, "
        "pair_count bigint, universe_txns_24h bigint, universe_volume_24h_usd double, "
        "universe_boost_total double"
    ),
    "social_x": (
        "mentions_6h bigint, mentions_24h bigint, unique_authors_24h bigint, "
        "follower_weighted_reach double, tier1_organic_engagements bigint, reply_to_post_ratio double"
    ),
    "social_tg": (
        "exists boolean, members bigint, member_growth_6h_pct double, msgs_per_hour double, "
        "unique_speakers_24h bigint"
    ),
    "socials_declared": "telegram boolean, x boolean, website boolean",
    "trends": "google_trends_delta double, tiktok_video_count_delta double",
    "lineage": "meta_tag string, position_in_meta string",
}
# Counted toward completeness beside the groups; momentum is left out of the count.
SCALARS = ("age_at_trigger_minutes", "listings", "regime")
UNCOUNTED = ("momentum",)


def _fields(ddl: str) -> list[tuple[str, str]]:
    """(name, type) pairs of a field list written as "name type, name type"."""
    return [tuple(item.split(" ", 1)) for item in ddl.split(", ")]


def group_columns(group: str) -> list[tuple[str, str]]:
    """(field, stored column) pairs of one group."""
    return [(name, f"{group}_{name}") for name, _ in _fields(GROUPS[group])]


def counted_columns() -> list[str]:
    """The columns data completeness is measured over."""
    groups = [g for g in GROUPS if g not in UNCOUNTED]
    return [*SCALARS, *[c for g in groups for _, c in group_columns(g)]]


_FLAT = ", ".join(
    f"{g}_{name} {kind}" for g, ddl in GROUPS.items() for name, kind in _fields(ddl)
)


@dataclass(frozen=True)
class Table:
    ddl: str
    key: str
    unique: tuple[tuple[str, ...], ...] = ()
    not_null: tuple[str, ...] = ()

    @property
    def schema(self) -> T.StructType:
        return T.StructType.fromDDL(self.ddl)


# The seven append-only tables.
TABLES = {
    "snapshots": Table(
        "snapshot_id string, ts bigint, snapshot_date date, trigger_kind string, "
        "trigger_mcap_crossed boolean, trigger_holders_crossed boolean, ticker string, chain string, "
        "contract string, telegram_url string, x_url string, entry_path string, "
        "age_at_trigger_minutes bigint, regime string, listings array<string>, schema_version int, "
        "source string, collected_at_ms bigint, supersedes string, fields_present int, "
        f"fields_expected int, data_completeness double, {_FLAT}",
        "snapshot_id",
        (("chain", "contract"),),
    ),
    "trigger_events": Table(
        "event_id string, ts bigint, chain string, contract string, trigger_kind string, "
        "trigger_mcap_crossed boolean, trigger_holders_crossed boolean, mcap_usd_at_trigger double, "
        "holder_count_at_trigger bigint, snapshot_id string, source string",
        "event_id",
        (("chain", "contract"),),
    ),
    "labels": Table(
        "label_id string, snapshot_id string, filled_at_ms bigint, max_multiple_1h double, "
        "max_multiple_6h double, max_multiple_24h double, max_multiple_72h double, "
        "max_multiple_7d double, max_drawdown_before_peak_24h double, "
        "max_drawdown_before_peak_72h double, time_to_peak_minutes bigint, survived_24h boolean, "
        "survived_7d boolean, source string",
        "label_id",
    ),
    "outcome_observations": Table(
        "observation_id string, snapshot_id string, ts bigint, minutes_since_snapshot bigint, "
        "mcap_usd double, price_usd double, liquidity_usd double, volume_24h_usd double, "
        "holder_count bigint, source string",
        "observation_id",
    ),
    "scores": Table(
        "score_id string, run_id string, snapshot_id string, scored_at_ms bigint, prompt_version int, "
        "weights_version string, model string, paper_mode boolean, batch_regime string, score double, "
        "raw_score double, rank int, excluded boolean, rejected_by array<string>, "
        "indeterminate_on array<string>, pillar_scores map<string,double>, "
        "pillar_components map<string,map<string,double>>, modifiers_applied array<string>, "
        "data_completeness double, thesis string, bear_case string, falsifier string, "
        "confidence string, data_gaps array<string>, narrative_source string, input_snapshot string",
        "score_id",
    ),
    "social_observations": Table(
        "observation_id string, snapshot_id string, platform string, ts bigint, offset_minutes bigint, "
        "handle string, exists boolean, mentions_window bigint, window_minutes bigint, "
        "unique_authors bigint, follower_weighted_reach double, tier1_organic_engagements bigint, "
        "replies bigint, posts bigint, members bigint, online bigint, messages_window bigint, "
        "unique_speakers bigint, source string, error string, age_minutes bigint",
        "observation_id",
        (("snapshot_id", "platform", "offset_minutes"),),
    ),
    "safety_observations": Table(
        "observation_id string, snapshot_id string, chain string, contract string, ts bigint, "
        "source string, collected_at_ms bigint, honeypot boolean, sells_failing boolean, "
        "buy_tax_pct double, sell_tax_pct double, mint_revoked boolean, freeze_active boolean, "
        "lp_burned boolean, lp_locked_pct double, "
        "lp_markets array<struct<market:string,locked_pct:double,burned:boolean,locked_usd:double>>, "
        "lp_total_usd double, source_fields array<string>, top10_ex_lp_pct double, "
        "holder_count bigint, upgradeable boolean, admin_renounced boolean, deployer_address string, "
        "deployer_prior_rugs bigint, rugged boolean, risk_labels array<string>, error string",
        "observation_id",
    ),
}


class SchemaMismatch(ValueError):
    """A frame lacks columns its table has."""


def validate(df: DataFrame, table: str) -> DataFrame:
    """Refuse a frame that lacks columns of the table; never widen it silently."""
    missing = sorted(set(TABLES[table].schema.names) - set(df.columns))
    if missing:
        raise SchemaMismatch(f"{table} lacks {missing}")
    return df.select(*TABLES[table].schema.names)


def conform(df: DataFrame, table: str) -> DataFrame:
    """The table's columns in order and type, null where the frame has none."""
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in TABLES[table].schema.fields
        ]
    )


def nested(group: str) -> Column:
    """One feature group as a struct column."""
    return F.struct(*[F.col(c).alias(f) for f, c in group_columns(group)]).alias(group)


def flat(group: str) -> list[Column]:
    """One feature group's struct as prefixed columns."""
    return [F.col(f"{group}.{f}").alias(c) for f, c in group_columns(group)]
