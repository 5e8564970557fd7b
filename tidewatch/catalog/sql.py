"""SQL twins of the inputs, as named common table expressions with their dependencies."""

from __future__ import annotations

import re

MIN, HOUR, DAY = 60_000, 3_600_000, 86_400_000
AS_OF_EARLY, AS_OF_LATE = 1_704_499_200_000, 1_704_758_400_000

CTES: dict[str, str] = {}


def define(name: str, sql: str) -> None:
    CTES[name] = sql


def oracle(body: str) -> str:
    """Prefix ``body`` with every CTE it names, in definition order."""
    needed: set[str] = set()

    def visit(text: str, own: str | None = None) -> None:
        for name in CTES:
            if name != own and name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(CTES[name], name)

    visit(body)
    if not needed:
        return body
    parts = [f"{n} AS ({CTES[n]})" for n in CTES if n in needed]
    head = body.lstrip()
    if head[:5].upper() == "WITH ":
        return "WITH " + ", ".join(parts) + ", " + head[5:]
    return "WITH " + ", ".join(parts) + " " + body


define(
    "ev_",
    """SELECT event_id AS pos, 'c' || (user_id % 4) AS chain, 't' || user_id AS contract, user_id,
  epoch_us(ts) // 1000 AS observed_at_ms, event_type, value, props FROM events""",
)
define(
    "obs_",
    """SELECT pos, chain, contract, user_id, observed_at_ms, event_type, value,
  CASE WHEN pos % 17 <> 0 THEN value * 2500 END AS mcap_usd,
  CASE WHEN pos % 5 <> 0 THEN row_number() OVER (PARTITION BY chain, contract
    ORDER BY observed_at_ms, pos) * 100 END AS holder_count FROM ev_""",
)
define(
    "fired_",
    """SELECT *, coalesce(mcap_usd >= 250000, false) AS trigger_mcap_crossed,
  coalesce(holder_count >= 500, false) AS trigger_holders_crossed,
  CASE WHEN mcap_usd >= 250000 THEN 'mcap_250k' WHEN holder_count >= 500 THEN 'holders_500' END
    AS trigger_kind FROM obs_""",
)
define(
    "snap_",
    """SELECT 's' || user_id AS snapshot_id, chain, contract, user_id, observed_at_ms AS ts, pos,
  trigger_kind, trigger_mcap_crossed, trigger_holders_crossed, mcap_usd AS market_mcap_usd,
  holder_count AS holders_count, event_type FROM fired_ WHERE trigger_kind IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY chain, contract ORDER BY observed_at_ms, pos) = 1""",
)
HZ = {"1h": 60, "6h": 360, "24h": 1440, "72h": 4320, "7d": 10080}


def labels_sql(as_of: int) -> str:
    """Labels per snapshot and horizon, by a different route from the engine's."""
    cols, joins = [], []
    for h, m in HZ.items():
        cols.append(f"p{h}.mcap / s.market_mcap_usd AS max_multiple_{h}")
        joins.append(
            f"""LEFT JOIN (SELECT snapshot_id, arg_max(mcap, (mcap, -seen)) AS mcap,
  arg_max(seen, (mcap, -seen)) AS seen, arg_max(mcap, (seen, pos)) AS last_mcap
  FROM path_{as_of} WHERE seen <= ts + {m * MIN} AND {as_of} >= ts + {m * MIN} GROUP BY 1) p{h}
  ON p{h}.snapshot_id = s.snapshot_id"""
        )
    for h in ("24h", "72h"):
        cols.append(f"d{h}.dd AS max_drawdown_before_peak_{h}")
        joins.append(
            f"""LEFT JOIN (SELECT q.snapshot_id, greatest(0.0, 1.0 - min(q.mcap) / any_value(q.base)) AS dd
  FROM path_{as_of} q JOIN (SELECT snapshot_id, arg_max(seen, (mcap, -seen)) AS pk FROM path_{as_of}
    WHERE seen <= ts + {HZ[h] * MIN} AND {as_of} >= ts + {HZ[h] * MIN} GROUP BY 1) k
  ON k.snapshot_id = q.snapshot_id AND q.seen <= k.pk GROUP BY 1) d{h}
  ON d{h}.snapshot_id = s.snapshot_id"""
        )
    ladder = " ".join(
        f"WHEN {as_of} >= s.ts + {m * MIN} THEN (p{h}.seen - s.ts) // {MIN}"
        for h, m in reversed(HZ.items())
    )
    cols.append(f"CASE {ladder} END AS time_to_peak_minutes")
    for h in ("24h", "7d"):
        cols.append(f"p{h}.last_mcap >= s.market_mcap_usd * 0.2 AS survived_{h}")
    return f"SELECT s.snapshot_id, {', '.join(cols)} FROM snap_ s {' '.join(joins)}"


for _name, _as_of in (("early", AS_OF_EARLY), ("late", AS_OF_LATE)):
    define(
        f"path_{_as_of}",
        f"""SELECT s.snapshot_id, s.ts, s.market_mcap_usd AS base, o.observed_at_ms AS seen, o.pos,
  o.mcap_usd AS mcap FROM snap_ s JOIN obs_ o ON o.chain = s.chain AND o.contract = s.contract
  WHERE s.market_mcap_usd > 0 AND o.mcap_usd IS NOT NULL AND o.observed_at_ms >= s.ts
  AND o.observed_at_ms <= {_as_of}""",
    )
    define(f"labels_{_name}_", labels_sql(_as_of))

define(
    "uni_",
    f"""SELECT observed_at_ms // {DAY} AS poll_id, chain, contract, user_id, count(*) AS txns_24h,
  sum(value) AS volume_24h_usd, sum(value) FILTER (event_type = 'purchase') AS boost_total,
  count(DISTINCT event_type) AS pair_count FROM ev_ GROUP BY 1, 2, 3, 4""",
)
define(
    "unitot_",
    """SELECT poll_id, count(*) AS universe_size, sum(txns_24h)::DOUBLE AS universe_txns_24h,
  sum(volume_24h_usd) AS universe_volume_24h_usd, sum(boost_total) AS universe_boost_total
  FROM uni_ GROUP BY 1""",
)
define(
    "share_",
    """SELECT u.*, t.* EXCLUDE (poll_id), round((coalesce(txns_24h / universe_txns_24h, 0)
    + coalesce(volume_24h_usd / universe_volume_24h_usd, 0)
    + coalesce(boost_total / universe_boost_total, 0))
    / ((txns_24h IS NOT NULL)::INT + (volume_24h_usd IS NOT NULL)::INT
      + (boost_total IS NOT NULL)::INT) * 100, 9) AS share_pct
  FROM uni_ u JOIN unitot_ t USING (poll_id)""",
)
define(
    "ranked_",
    """SELECT *, row_number() OVER w AS rank,
  (count(*) OVER (PARTITION BY poll_id) - row_number() OVER w + 1)
    / count(*) OVER (PARTITION BY poll_id) * 100.0 AS percentile FROM share_
  WINDOW w AS (PARTITION BY poll_id ORDER BY share_pct DESC, user_id)""",
)


def safety_sql(variant: int) -> str:
    u = f"(user_id + {variant})"

    def fact(k: int) -> str:
        return f"CASE WHEN {u} % 7 <> 0 THEN {u} % {k} = 0 END"

    return f"""SELECT DISTINCT chain, contract, user_id, 'source{variant}' AS source,
  {AS_OF_EARLY} + {u} * {HOUR} AS collected_at_ms,
  {fact(13)} AS honeypot, {fact(17)} AS sells_failing,
  CASE WHEN {u} % 9 <> 0 THEN ({u} % 11)::DOUBLE END AS buy_tax_pct,
  CASE WHEN {u} % 10 <> 0 THEN ({u} % 8)::DOUBLE END AS sell_tax_pct,
  NOT ({fact(5)}) AS mint_revoked, {fact(6)} AS freeze_active,
  CASE WHEN {u} % 4 = 1 THEN {u} % 8 = 1 END AS lp_burned,
  CASE WHEN {u} % 6 = 0 THEN {AS_OF_EARLY} + ({u} % 60) * {DAY} END AS lp_locked_until_ms,
  CASE WHEN {u} % 3 = 0 THEN 100.0 WHEN {u} % 3 = 1 THEN 0.0 ELSE 50.0 END::DOUBLE AS lp_locked_pct,
  CASE WHEN {u} % 11 <> 0 THEN ({u} % 60)::DOUBLE END AS top10_ex_lp_pct,
  CASE WHEN {u} % 3 <> 0 THEN {u} * 3 END AS holder_count,
  CASE WHEN {u} % 5 <> 0 THEN {u} % 2 = 0 END AS upgradeable,
  CASE WHEN {u} % 4 <> 3 THEN {u} % 3 = 0 END AS admin_renounced,
  CASE WHEN {u} % 6 <> 5 THEN greatest(0, {u} % 5 - 3) END AS deployer_prior_rugs,
  CASE WHEN {u} % 8 <> 0 THEN 'd' || ({u} % 12) END AS deployer_address FROM ev_"""


define("safety0_", safety_sql(0))
define("safety3_", safety_sql(3))
define(
    "fin_",
    """SELECT s.snapshot_id, s.chain, s.contract, f.* EXCLUDE (chain, contract, user_id, source,
  collected_at_ms, holder_count), s.ts AS evaluated_at_ms, s.market_mcap_usd AS mcap_usd,
  CASE WHEN s.user_id % 3 = 0 THEN s.market_mcap_usd * 1.5 END AS fdv_usd,
  CASE WHEN s.user_id % 13 <> 0 THEN (s.user_id % 40) * 1000.0::DOUBLE END AS liquidity_usd
  FROM snap_ s LEFT JOIN safety0_ f USING (chain, contract)""",
)
define(
    "trail_",
    f"""SELECT s.snapshot_id,
  count(*) FILTER (seen >= ts - {HOUR} AND e.event_type = 'purchase') AS momentum_buys_1h,
  count(*) FILTER (seen >= ts - {HOUR} AND e.event_type = 'error') AS momentum_sells_1h,
  count(*) FILTER (e.event_type = 'purchase') AS momentum_buys_24h,
  count(*) FILTER (e.event_type = 'error') AS momentum_sells_24h,
  sum(e.value) FILTER (seen >= ts - {HOUR}) AS momentum_volume_1h_usd,
  sum(e.value) FILTER (seen >= ts - {6 * HOUR}) AS momentum_volume_6h_usd,
  count(*) FILTER (seen >= ts - {6 * HOUR}) AS mindshare_txns_6h
  FROM snap_ s JOIN (SELECT *, observed_at_ms AS seen FROM ev_) e USING (chain, contract)
  WHERE e.seen BETWEEN s.ts - {DAY} AND s.ts GROUP BY 1""",
)
define(
    "feat_",
    f"""SELECT s.snapshot_id, s.chain, s.contract, s.user_id, s.ts, s.pos, s.trigger_kind,
  s.market_mcap_usd,
  CASE WHEN u % 13 <> 0 THEN (u % 40) * 1000.0::DOUBLE END AS market_liquidity_usd,
  round(volume_24h_usd, 6) AS market_volume_24h_usd,
  CASE WHEN u % 3 = 0 THEN s.market_mcap_usd * 1.5 END AS market_fdv_usd,
  round(momentum_volume_1h_usd, 6) AS momentum_volume_1h_usd,
  round(momentum_volume_6h_usd, 6) AS momentum_volume_6h_usd,
  momentum_buys_1h, momentum_sells_1h, momentum_buys_24h, momentum_sells_24h,
  CASE WHEN u % 6 <> 0 THEN (u % 41 - 20)::DOUBLE END AS momentum_price_change_1h_pct,
  CASE WHEN u % 7 <> 0 THEN (u % 91 - 30)::DOUBLE END AS momentum_price_change_6h_pct,
  CASE WHEN u % 5 <> 0 THEN (u % 33 - 8) * 5.0::DOUBLE END AS holders_growth_6h_pct,
  CASE WHEN u % 11 <> 0 THEN (u % 60)::DOUBLE END AS holders_top10_ex_lp_pct,
  CASE WHEN u % 4 = 0 THEN (u % 45)::DOUBLE END AS launch_bundled_supply_pct,
  CASE WHEN u % 6 = 1 THEN u % 9 END AS flows_smart_money_entries,
  CASE WHEN u % 4 <> 1 THEN (u % 10)::DOUBLE * 0.1::DOUBLE END AS flows_smart_money_hit_rate,
  CASE WHEN u % 5 = 2 THEN ((u % 3) - 1)::DOUBLE END AS flow_whale,
  CASE WHEN u % 5 = 2 THEN ((u % 2) * 2 - 1)::DOUBLE END AS flow_small,
  share_pct AS mindshare_share_pct, rank AS mindshare_rank, percentile AS mindshare_percentile,
  universe_size AS mindshare_universe_size, txns_24h AS mindshare_txns_24h, mindshare_txns_6h,
  round(boost_total, 6) AS mindshare_boost_total, pair_count AS mindshare_pair_count,
  universe_txns_24h::BIGINT AS mindshare_universe_txns_24h,
  round(universe_volume_24h_usd, 6) AS mindshare_universe_volume_24h_usd,
  round(universe_boost_total, 6) AS mindshare_universe_boost_total,
  CASE WHEN u % 3 <> 0 THEN u % 50 END AS social_x_mentions_6h,
  CASE WHEN u % 4 <> 0 THEN u % 120 END AS social_x_mentions_24h,
  CASE WHEN u % 5 <> 0 THEN u % 40 END AS social_x_unique_authors_24h,
  CASE WHEN u % 3 <> 1 THEN u * 50000.0::DOUBLE END AS social_x_follower_weighted_reach,
  CASE WHEN u % 3 <> 2 THEN u % 7 END AS social_x_tier1_organic_engagements,
  CASE WHEN u % 6 <> 2 THEN (u % 8) * 0.25::DOUBLE END AS social_x_reply_to_post_ratio,
  CASE WHEN u % 4 <> 2 THEN u * 90 END AS social_tg_members,
  CASE WHEN u % 5 <> 1 THEN (u % 30) * 10.0::DOUBLE END AS social_tg_member_growth_6h_pct,
  CASE WHEN u % 7 <> 3 THEN (u % 35) * 11.0::DOUBLE END AS social_tg_msgs_per_hour,
  CASE WHEN u % 6 <> 4 THEN u % 25 * 10 END AS social_tg_unique_speakers_24h,
  CASE WHEN u % 7 <> 0 THEN u % 2 = 0 END AS socials_declared_telegram,
  CASE WHEN u % 7 <> 0 THEN u % 3 = 0 END AS socials_declared_x,
  CASE WHEN u % 14 <> 0 THEN u % 5 = 0 END AS socials_declared_website,
  CASE WHEN u % 4 = 3 THEN (u % 120)::DOUBLE END AS trends_google_trends_delta,
  CASE WHEN u % 5 = 3 THEN (u % 600)::DOUBLE END AS trends_tiktok_video_count_delta,
  CASE WHEN u % 3 = 1 THEN 'm' || (u % 6) END AS lineage_meta_tag,
  CASE WHEN u % 4 = 0 THEN ['first', 'second', 'derivative'][u % 3 + 1] END AS lineage_position_in_meta,
  CASE WHEN u % 2 = 0 THEN ['dex', CASE WHEN u % 4 = 0 THEN 'cex_perp' ELSE 'other' END] END AS listings,
  CASE WHEN u % 10 <> 9 THEN (u % 11) / 10.0::DOUBLE END AS data_completeness,
  'd' || (u % 12) AS deployer_address,
  CASE WHEN u % 9 <> 0 THEN u * 7 % 4000 END AS age_at_trigger_minutes
  FROM (SELECT *, ts // {DAY} AS poll_id, user_id AS u FROM snap_) s
  LEFT JOIN (SELECT * EXCLUDE (user_id) FROM ranked_) r USING (poll_id, chain, contract)
  LEFT JOIN trail_ USING (snapshot_id)""",
)
define(
    "lab_",
    """SELECT l.doc_id, l.quality AS label, d.n_chars::DOUBLE AS score, l.doc_id AS ts,
  d.lang AS stratum, d.source AS deployer, l.toxic FROM labels l JOIN documents d USING (doc_id)""",
)
define(
    "candle_",
    f"""SELECT event_type AS coin, observed_at_ms // {4 * HOUR} * {4 * HOUR} AS t,
  arg_min(value, (observed_at_ms, pos)) AS o, max(value) AS h, min(value) AS l,
  arg_max(value, (observed_at_ms, pos)) AS c, count(*)::DOUBLE AS v FROM ev_ GROUP BY 1, 2""",
)
define(
    "soc_",
    f"""SELECT snapshot_id, platform, ts, off AS offset_minutes, platform = 'telegram' AS "exists",
  mentions_window, unique_authors, follower_weighted_reach, tier1_organic_engagements, replies,
  posts, CASE WHEN user_id % 5 <> 0 THEN user_id * 10 + off END AS members,
  CASE WHEN user_id % 3 <> 0 THEN mentions_window * 3 END AS messages_window,
  CASE WHEN user_id % 4 <> 0 THEN unique_authors * 2 END AS unique_speakers,
  CASE WHEN user_id % 10 = 3 THEN 'rate limited' END AS error, off + user_id % 50 AS age_minutes
  FROM (SELECT s.snapshot_id, s.user_id, s.ts, off, count(*) AS mentions_window,
    count(DISTINCT e.event_type) AS unique_authors, round(sum(e.value), 6) AS follower_weighted_reach,
    count(*) FILTER (e.value > 100) AS tier1_organic_engagements,
    count(*) FILTER (e.event_type = 'click') AS replies,
    count(*) FILTER (e.event_type <> 'click') AS posts
    FROM snap_ s CROSS JOIN (VALUES (0), (60), (360), (1440)) o(off)
    JOIN ev_ e ON e.chain = s.chain AND e.contract = s.contract
      AND e.observed_at_ms BETWEEN s.ts + off * {MIN} AND s.ts + off * {MIN} + {6 * HOUR}
    GROUP BY 1, 2, 3, 4) CROSS JOIN (VALUES ('x'), ('telegram')) p(platform)""",
)
