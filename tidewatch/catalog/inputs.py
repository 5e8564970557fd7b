"""The given tables shaped as the engine's inputs. Each has a SQL twin in ``sql.py``.

Snapshots, labels, features and social readings are tables in the engine: one job appends them and
later jobs read them. They are written here the same way, once per session and data folder, into
the shared folder; ``*_job`` functions are the jobs that compute them from the given tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import chains
from tidewatch.functions.values import millis
from tidewatch.operators import outcomes, trigger
from tidewatch.operators.intervals import in_window
from tidewatch.operators.ordered import running_count
from tidewatch.session import configure, scratch_table

MIN = 60_000
HOUR = 3_600_000
DAY = 86_400_000
AS_OF_EARLY = 1_704_499_200_000  # 2024-01-06 00:00 UTC
AS_OF_LATE = 1_704_758_400_000  # 2024-01-09 00:00 UTC
TOKEN = ["chain", "contract"]

# Stand-in registry: c3 is absent on purpose, so its EVM question stays unknown.
STAND_IN_CHAINS = (
    chains.Chain("c0", "Chain 0", True, "s0"),
    chains.Chain("c1", "Chain 1", False, "s1"),
    chains.Chain("c2", "Chain 2", True, "s2"),
)


_STORED: dict[tuple[str, str, str], str] = {}


def stored(spark: SparkSession, d: str, name: str, job) -> DataFrame:
    """The table ``job`` computes, written on first use and read back afterwards."""
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _STORED:
        path = scratch_table(spark, name)
        job().write.parquet(path)
        _STORED[key] = path
    return spark.read.parquet(_STORED[key])


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{d}/{name}.parquet")


def events(spark, d) -> DataFrame:
    """events with pos, chain, contract and epoch milliseconds."""
    return read(spark, d, "events").select(
        F.col("event_id").alias("pos"),
        F.concat(F.lit("c"), F.col("user_id") % 4).alias("chain"),
        F.concat(F.lit("t"), F.col("user_id")).alias("contract"),
        "user_id",
        millis("ts").alias("observed_at_ms"),
        "event_type",
        "value",
        "props",
    )


def obs(spark, d) -> DataFrame:
    """Token observations; nulls injected by fixed arithmetic."""
    counted = running_count(
        events(spark, d).drop("props"), ["chain", "contract"], "observed_at_ms", "pos", "_n"
    )
    return counted.select(
        "pos",
        "chain",
        "contract",
        "user_id",
        "observed_at_ms",
        "event_type",
        "value",
        F.when(F.col("pos") % 17 != 0, F.col("value") * 2500).alias("mcap_usd"),
        F.when(F.col("pos") % 5 != 0, F.col("_n") * 100).alias("holder_count"),
    )


def snapshots(spark, d) -> DataFrame:
    return stored(spark, d, "snapshots", lambda: snapshots_job(spark, d))


def snapshots_job(spark, d) -> DataFrame:
    """First crossing per token, with the snapshot's own columns."""
    return trigger.first_crossings(obs(spark, d)).select(
        F.concat(F.lit("s"), F.col("user_id")).alias("snapshot_id"),
        "chain",
        "contract",
        "user_id",
        F.col("observed_at_ms").alias("ts"),
        "pos",
        "trigger_kind",
        "trigger_mcap_crossed",
        "trigger_holders_crossed",
        F.col("mcap_usd").alias("market_mcap_usd"),
        F.col("holder_count").alias("holders_count"),
        "event_type",
    )


def price_path(spark, d) -> DataFrame:
    """Observations without the holder window: what labels read."""
    return events(spark, d).select(
        "pos",
        "chain",
        "contract",
        "observed_at_ms",
        F.when(F.col("pos") % 17 != 0, F.col("value") * 2500).alias("mcap_usd"),
    )


def labels(spark, d, as_of=AS_OF_LATE) -> DataFrame:
    return stored(spark, d, f"labels-{as_of}", lambda: labels_job(spark, d, as_of))


def labels_job(spark, d, as_of=AS_OF_LATE) -> DataFrame:
    return outcomes.labels(snapshots(spark, d), price_path(spark, d), as_of)


def universe(spark, d) -> DataFrame:
    """Attention components per (day, token): the polled universes."""
    per = F.floor(F.col("observed_at_ms") / DAY).cast("bigint")
    return (
        events(spark, d)
        .groupBy(per.alias("poll_id"), "chain", "contract", "user_id")
        .agg(
            F.count("*").alias("txns_24h"),
            F.sum("value").alias("volume_24h_usd"),
            F.sum(F.when(F.col("event_type") == "purchase", F.col("value"))).alias("boost_total"),
            F.countDistinct("event_type").alias("pair_count"),
        )
    )


def safety(spark, d, variant: int = 0) -> DataFrame:
    """Safety facts per token from its number; two variants disagree on purpose."""
    u = F.col("user_id") + variant

    def fact(k: int) -> F.Column:
        return F.when(u % 7 != 0, u % k == 0)

    return (
        events(spark, d)
        .select("chain", "contract", "user_id")
        .distinct()
        .select(
            "chain",
            "contract",
            "user_id",
            F.lit(f"source{variant}").alias("source"),
            (F.lit(AS_OF_EARLY) + u * HOUR).cast("bigint").alias("collected_at_ms"),
            fact(13).alias("honeypot"),
            fact(17).alias("sells_failing"),
            F.when(u % 9 != 0, (u % 11).cast("double")).alias("buy_tax_pct"),
            F.when(u % 10 != 0, (u % 8).cast("double")).alias("sell_tax_pct"),
            (~fact(5)).alias("mint_revoked"),
            fact(6).alias("freeze_active"),
            F.when(u % 4 == 1, u % 8 == 1).alias("lp_burned"),
            F.when(u % 6 == 0, F.lit(AS_OF_EARLY) + (u % 60) * DAY).cast("bigint").alias("lp_locked_until_ms"),
            F.when(u % 3 == 0, 100.0).when(u % 3 == 1, 0.0).otherwise(50.0).alias("lp_locked_pct"),
            F.when(u % 11 != 0, (u % 60).cast("double")).alias("top10_ex_lp_pct"),
            F.when(u % 3 != 0, u * 3).cast("bigint").alias("holder_count"),
            F.when(u % 5 != 0, u % 2 == 0).alias("upgradeable"),
            F.when(u % 4 != 3, u % 3 == 0).alias("admin_renounced"),
            F.when(u % 6 != 5, F.greatest(F.lit(0), u % 5 - 3)).cast("bigint").alias("deployer_prior_rugs"),
            F.when(u % 8 != 0, F.concat(F.lit("d"), u % 12)).alias("deployer_address"),
        )
    )


def filter_inputs(spark, d) -> DataFrame:
    """Snapshots joined with safety facts: what the hard filters read."""
    facts = safety(spark, d).drop("user_id", "source", "collected_at_ms", "holder_count")
    return (
        snapshots(spark, d)
        .join(facts, TOKEN, "left")
        .select(
            "snapshot_id",
            *[c for c in facts.columns],
            F.col("ts").alias("evaluated_at_ms"),
            F.col("market_mcap_usd").alias("mcap_usd"),
            F.when(F.col("user_id") % 3 == 0, F.col("market_mcap_usd") * 1.5).alias("fdv_usd"),
            F.when(F.col("user_id") % 13 != 0, (F.col("user_id") % 40) * 1000.0).alias("liquidity_usd"),
        )
    )


def trailing(spark, d) -> DataFrame:
    """Buys (purchase), sells (error) and volume of each token in the day before its snapshot."""
    snaps = snapshots(spark, d).select("snapshot_id", *TOKEN, "ts", (F.col("ts") - DAY).alias("_from"))
    rows = events(spark, d).select(*TOKEN, F.col("observed_at_ms").alias("_at"), "event_type", "value")
    path = in_window(snaps, rows, TOKEN, "_from", "ts", "_at")

    def within(hours: int, kind: str | None = None):
        c = F.col("_at") >= F.col("ts") - hours * HOUR
        return c if kind is None else c & (F.col("event_type") == kind)

    return path.groupBy("snapshot_id").agg(
        F.count_if(within(1, "purchase")).alias("momentum_buys_1h"),
        F.count_if(within(1, "error")).alias("momentum_sells_1h"),
        F.count_if(within(24, "purchase")).alias("momentum_buys_24h"),
        F.count_if(within(24, "error")).alias("momentum_sells_24h"),
        F.sum(F.when(within(1), F.col("value"))).alias("momentum_volume_1h_usd"),
        F.sum(F.when(within(6), F.col("value"))).alias("momentum_volume_6h_usd"),
        F.count_if(within(6)).alias("mindshare_txns_6h"),
    )


def features(spark, d) -> DataFrame:
    return stored(spark, d, "features", lambda: features_job(spark, d))


def features_job(spark, d) -> DataFrame:
    """Snapshot rows with every feature column the pillars read."""
    from tidewatch.operators import mindshare

    u = F.col("user_id")
    uni = universe(spark, d)
    shares = mindshare.ranked(uni, "poll_id", "user_id", digits=9)
    day = F.floor(F.col("ts") / DAY).cast("bigint").alias("poll_id")
    snaps = snapshots(spark, d).withColumn("poll_id", day)
    joined = snaps.join(shares.drop("user_id"), ["poll_id", *TOKEN], "left")
    joined = joined.join(trailing(spark, d), "snapshot_id", "left")
    return joined.select(
        "snapshot_id",
        *TOKEN,
        u,
        "ts",
        "pos",
        "trigger_kind",
        (u * 7 % 4000).alias("_age"),
        "market_mcap_usd",
        F.when(u % 13 != 0, (u % 40) * 1000.0).alias("market_liquidity_usd"),
        F.round("volume_24h_usd", 6).alias("market_volume_24h_usd"),
        F.when(u % 3 == 0, F.col("market_mcap_usd") * 1.5).alias("market_fdv_usd"),
        F.round("momentum_volume_1h_usd", 6).alias("momentum_volume_1h_usd"),
        F.round("momentum_volume_6h_usd", 6).alias("momentum_volume_6h_usd"),
        "momentum_buys_1h",
        "momentum_sells_1h",
        "momentum_buys_24h",
        "momentum_sells_24h",
        F.when(u % 6 != 0, (u % 41 - 20) * 1.0).alias("momentum_price_change_1h_pct"),
        F.when(u % 7 != 0, (u % 91 - 30) * 1.0).alias("momentum_price_change_6h_pct"),
        F.when(u % 5 != 0, (u % 33 - 8) * 5.0).alias("holders_growth_6h_pct"),
        F.when(u % 11 != 0, (u % 60) * 1.0).alias("holders_top10_ex_lp_pct"),
        F.when(u % 4 == 0, (u % 45) * 1.0).alias("launch_bundled_supply_pct"),
        F.when(u % 6 == 1, u % 9).alias("flows_smart_money_entries"),
        F.when(u % 4 != 1, (u % 10) * 0.1).alias("flows_smart_money_hit_rate"),
        F.when(
            u % 5 == 2,
            F.create_map(
                F.lit("whale"), ((u % 3) - 1) * 1.0, F.lit("small"), ((u % 2) * 2 - 1) * 1.0
            ),
        ).alias("flows_net_flow_by_cohort"),
        F.col("share_pct").alias("mindshare_share_pct"),
        F.col("rank").alias("mindshare_rank"),
        F.col("percentile").alias("mindshare_percentile"),
        F.col("universe_size").alias("mindshare_universe_size"),
        F.col("txns_24h").alias("mindshare_txns_24h"),
        "mindshare_txns_6h",
        F.round("boost_total", 6).alias("mindshare_boost_total"),
        F.col("pair_count").alias("mindshare_pair_count"),
        F.col("universe_txns_24h").cast("bigint").alias("mindshare_universe_txns_24h"),
        F.round("universe_volume_24h_usd", 6).alias("mindshare_universe_volume_24h_usd"),
        F.round("universe_boost_total", 6).alias("mindshare_universe_boost_total"),
        F.when(u % 3 != 0, u % 50).alias("social_x_mentions_6h"),
        F.when(u % 4 != 0, u % 120).alias("social_x_mentions_24h"),
        F.when(u % 5 != 0, u % 40).alias("social_x_unique_authors_24h"),
        F.when(u % 3 != 1, u * 50_000.0).alias("social_x_follower_weighted_reach"),
        F.when(u % 3 != 2, u % 7).alias("social_x_tier1_organic_engagements"),
        F.when(u % 6 != 2, (u % 8) * 0.25).alias("social_x_reply_to_post_ratio"),
        F.when(u % 4 != 2, u * 90).alias("social_tg_members"),
        F.when(u % 5 != 1, (u % 30) * 10.0).alias("social_tg_member_growth_6h_pct"),
        F.when(u % 7 != 3, (u % 35) * 11.0).alias("social_tg_msgs_per_hour"),
        F.when(u % 6 != 4, u % 25 * 10).alias("social_tg_unique_speakers_24h"),
        F.when(u % 7 != 0, u % 2 == 0).alias("socials_declared_telegram"),
        F.when(u % 7 != 0, u % 3 == 0).alias("socials_declared_x"),
        F.when(u % 14 != 0, u % 5 == 0).alias("socials_declared_website"),
        F.when(u % 4 == 3, (u % 120) * 1.0).alias("trends_google_trends_delta"),
        F.when(u % 5 == 3, (u % 600) * 1.0).alias("trends_tiktok_video_count_delta"),
        F.when(u % 3 == 1, F.concat(F.lit("m"), u % 6)).alias("lineage_meta_tag"),
        F.when(u % 4 == 0, F.element_at(F.array(F.lit("first"), F.lit("second"), F.lit("derivative")), (u % 3 + 1).cast("int"))).alias("lineage_position_in_meta"),
        F.when(u % 2 == 0, F.array(F.lit("dex"), F.when(u % 4 == 0, "cex_perp").otherwise("other"))).alias("listings"),
        F.when(u % 10 != 9, (u % 11) / 10.0).alias("data_completeness"),
        F.concat(F.lit("d"), u % 12).alias("deployer_address"),
    ).withColumn("age_at_trigger_minutes", F.when(u % 9 != 0, F.col("_age"))).drop("_age")


def labelled(spark, d) -> DataFrame:
    """Quality labels with document facts: the statistics' stand-in sample."""
    docs = read(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    return read(spark, d, "labels").join(docs, "doc_id").select(
        "doc_id",
        F.col("quality").cast("int").alias("label"),
        F.col("n_chars").cast("double").alias("score"),
        F.col("doc_id").alias("ts"),
        F.col("lang").alias("stratum"),
        F.col("source").alias("deployer"),
        "toxic",
    )


def candles(spark, d) -> DataFrame:
    """Four-hour bars per event type, the stand-in instruments."""
    at = F.struct("observed_at_ms", "pos")
    return (
        events(spark, d)
        .groupBy(
            F.col("event_type").alias("coin"),
            (F.floor(F.col("observed_at_ms") / (4 * HOUR)) * 4 * HOUR).cast("bigint").alias("t"),
        )
        .agg(
            F.min_by("value", at).alias("o"),
            F.max("value").alias("h"),
            F.min("value").alias("l"),
            F.max_by("value", at).alias("c"),
            F.count("*").cast("double").alias("v"),
        )
    )


def social(spark, d) -> DataFrame:
    return stored(spark, d, "social", lambda: social_job(spark, d))


def social_job(spark, d) -> DataFrame:
    """Readings per (snapshot, platform, offset): the events of the hour after each offset."""
    snaps = snapshots(spark, d).select("snapshot_id", *TOKEN, "ts", "user_id")
    slots = (
        snaps.withColumn("offset_minutes", F.explode(F.array(*[F.lit(o) for o in (0, 60, 360, 1440)])))
        .withColumn("_from", F.col("ts") + F.col("offset_minutes") * MIN)
        .withColumn("_to", F.col("_from") + 6 * HOUR)
    )
    rows = events(spark, d).select(*TOKEN, F.col("observed_at_ms").alias("_at"), "event_type", F.col("value").alias("_v"), F.col("pos").alias("_pos"))
    counted = (
        in_window(slots, rows, TOKEN, "_from", "_to", "_at")
        .groupBy("snapshot_id", "user_id", "ts", "offset_minutes")
        .agg(
            F.count("*").alias("mentions_window"),
            F.countDistinct("event_type").alias("unique_authors"),
            F.round(F.sum("_v"), 6).alias("follower_weighted_reach"),
            F.count_if(F.col("_v") > 100).alias("tier1_organic_engagements"),
            F.count_if(F.col("event_type") == "click").alias("replies"),
            F.count_if(F.col("event_type") != "click").alias("posts"),
        )
    )
    u, o = F.col("user_id"), F.col("offset_minutes")
    return counted.withColumn("platform", F.explode(F.array(F.lit("x"), F.lit("telegram")))).select(
        "snapshot_id",
        "platform",
        "ts",
        o.cast("bigint").alias("offset_minutes"),
        F.col("platform").eqNullSafe("telegram").alias("exists"),
        "mentions_window",
        "unique_authors",
        "follower_weighted_reach",
        "tier1_organic_engagements",
        "replies",
        "posts",
        F.when(u % 5 != 0, u * 10 + o).alias("members"),
        F.when(u % 3 != 0, F.col("mentions_window") * 3).alias("messages_window"),
        F.when(u % 4 != 0, F.col("unique_authors") * 2).alias("unique_speakers"),
        F.when(u % 10 == 3, "rate limited").alias("error"),
        (o + u % 50).alias("age_minutes"),
    )
