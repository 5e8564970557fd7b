"""Safety facts: holder lists, pool locks, pessimistic merge and deployer history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.text import has_any
from tidewatch.functions.values import flag, let, percent

# Addresses and tags of burned tokens and of holders that are not holders.
BURN_ADDRESSES = (
    "0x0000000000000000000000000000000000000000",
    "0x000000000000000000000000000000000000dead",
    "0xdead000000000000000042069420694206942069",
    "11111111111111111111111111111111",
    "1nc1nerator11111111111111111111111111111111",
)
BURN_TAGS = ("burn", "null", "dead", "incinerat")
NON_HOLDER_TAGS = (
    "lp", "liquidity", "pool", "lock", "vesting", "burn", "null", "dead", "exchange", "cex",
    "binance", "coinbase", "okx", "bybit", "kraken", "gate", "bitget",
)
TOP_HOLDERS = 10
SECURED_PCT = 95.0

HOLDERS = "array<struct<address:string,account:string,tag:string,percent:string,is_locked:string>>"

WORSE_IF_TRUE = ("honeypot", "sells_failing", "freeze_active", "upgradeable", "rugged")
WORSE_IF_FALSE = ("mint_revoked", "lp_burned", "admin_renounced")
WORSE_IF_LARGE = (
    "buy_tax_pct", "sell_tax_pct", "top10_ex_lp_pct", "holder_count", "deployer_prior_rugs",
)
WORSE_IF_SMALL = ("lp_locked_pct",)


def _tag(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(c, F.lit(""))))


def burned(address: Column, tag: Column) -> Column:
    return _tag(address).isin(*BURN_ADDRESSES) | has_any(_tag(tag), BURN_TAGS)


def not_a_holder(tag: Column) -> Column:
    return has_any(_tag(tag), NON_HOLDER_TAGS)


def _where(e: Column) -> Column:
    return F.coalesce(F.nullif(e["address"], F.lit("")), e["account"])


def _total(items: Column) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda acc, x: acc + x)


def lp_state(holders: Column) -> Column:
    """struct<burned, locked_pct> of a pool's holder list (a short list inside one payload).

    Half or more at burn addresses is burned; nothing secured is evidence of no lock; anything
    else has a secured share whose expiry is unknown.
    """
    parts = F.transform(
        F.filter(holders, lambda e: e.isNotNull()),
        lambda e: F.struct(
            F.coalesce(percent(e["percent"]), F.lit(0.0)).alias("pct"),
            burned(_where(e), e["tag"]).alias("burn"),
            F.coalesce(flag(e["is_locked"]), F.lit(False)).alias("lock"),
        ),
    )

    def add(acc: Column, p: Column) -> Column:
        pct, burn = p["pct"], p["burn"]
        return F.struct(
            (acc["burn"] + F.when(burn, pct).otherwise(0.0)).alias("burn"),
            (acc["lock"] + F.when(~burn & p["lock"], pct).otherwise(0.0)).alias("lock"),
            (acc["n"] + 1).alias("n"),
        )

    start = F.struct(F.lit(0.0).alias("burn"), F.lit(0.0).alias("lock"), F.lit(0).alias("n"))

    def answer(t: Column) -> Column:
        some, secured = t["n"] > 0, t["burn"] + t["lock"]
        return F.struct(
            F.when(some & (t["burn"] >= 50.0), True).when(some & (secured <= 0), False).alias("burned"),
            F.when(some & (t["burn"] < 50.0) & (secured <= 0), 0.0).when(some, secured).alias("locked_pct"),
        )

    return let(F.aggregate(parts, start, add), answer)


def top_holders(percents: Column) -> Column:
    """Sum of the ten largest known shares; null when none is known."""

    def sum_top(known: Column) -> Column:
        return F.when(F.size(known) > 0, _total(F.slice(F.sort_array(known, asc=False), 1, TOP_HOLDERS)))

    return let(F.array_compact(percents), sum_top)


def top10_ex_lp(holders: Column) -> Column:
    """Concentration leaving out pools, lockers, burns and exchange wallets."""
    real = F.filter(
        holders, lambda e: e.isNotNull() & ~not_a_holder(e["tag"]) & ~burned(_where(e), e["tag"])
    )
    return top_holders(F.transform(real, lambda e: percent(e["percent"])))


def pool_lock(markets: Column, total_usd: Column) -> Column:
    """struct<burned, locked_pct> over array<struct<locked_pct, burned, locked_usd>>.

    Pools that agree give their value; pools that disagree are weighted by dollars when every
    one reports them and the share is plausible; otherwise the answer is unknown.
    """
    flags = F.array_compact(F.transform(markets, lambda m: m["burned"]))
    measured = F.filter(markets, lambda m: m["locked_pct"].isNotNull())

    def secured(m: Column) -> Column:
        dollars = _total(F.transform(m, lambda x: x["locked_usd"]))
        share = F.try_divide(100.0 * dollars, F.when(total_usd > 0, total_usd))
        some = F.size(m) > 0
        return (
            F.when(
                some & F.forall(m, lambda x: x["locked_pct"] >= SECURED_PCT),
                F.array_min(F.transform(m, lambda x: x["locked_pct"])),
            )
            .when(some & F.forall(m, lambda x: x["locked_pct"] <= 0), 0.0)
            .when(some & share.between(0.0, 100.5), F.least(share, F.lit(100.0)))
        )

    return F.struct(
        let(flags, lambda f: F.when((F.size(f) > 0) & F.forall(f, lambda b: b), True)).alias("burned"),
        let(measured, secured).alias("locked_pct"),
    )


def merge(sources: DataFrame, keys: list[str], order: str = "source_order") -> DataFrame:
    """Several reports on one token into one, pessimistically.

    An unknown never erases a measurement, and the unsafe answer wins a disagreement. One
    aggregate over the union of the sources: no outer join, and any number of sources.
    """
    have = set(sources.columns)

    def first(c: str) -> Column:
        return F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c)

    rules = [
        *[F.bool_or(c).alias(c) for c in WORSE_IF_TRUE if c in have],
        *[F.bool_and(c).alias(c) for c in WORSE_IF_FALSE if c in have],
        *[F.max(c).alias(c) for c in WORSE_IF_LARGE if c in have],
        *[F.min(c).alias(c) for c in WORSE_IF_SMALL if c in have],
        *[first(c) for c in ("deployer_address", "lp_markets", "lp_total_usd", "error") if c in have],
        *[
            F.sort_array(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c)
            for c in ("risk_labels", "source_fields")
            if c in have
        ],
    ]
    return sources.groupBy(*keys).agg(
        F.array_join(F.sort_array(F.collect_set("source")), "+").alias("source"),
        F.max("collected_at_ms").alias("collected_at_ms"),
        *rules,
    )


def deployer_keys(reports: DataFrame, supported: list[str]) -> DataFrame:
    """Reports with the key their deployer is looked up by; null off the supported chains."""
    key = F.when(F.col("chain").isin(*supported), F.lower(F.nullif("deployer_address", F.lit(""))))
    return reports.withColumn("deployer_key", key)


def busiest_deployers(reports: DataFrame, limit: int | None) -> DataFrame:
    """Deployers behind the most tokens, each once, all with ``None``: one lookup answers all their tokens."""
    per = reports.where("deployer_key is not null").groupBy("chain", "deployer_key").agg(F.count("*").alias("tokens"))
    return per if limit is None else per.orderBy(F.desc("tokens"), "chain", "deployer_key").limit(limit)


def attach_history(reports: DataFrame, history: DataFrame) -> DataFrame:
    """Attach each deployer's history (prior_rugs, labels) to all its tokens."""
    answered = history.where("prior_rugs is not null").select(
        "chain", "deployer_key", F.col("prior_rugs").alias("_rugs"), F.col("labels").alias("_labels")
    )
    none = F.array().cast("array<string>")
    labels = F.sort_array(
        F.array_union(F.coalesce("risk_labels", none), F.coalesce("_labels", none))
    )
    return (
        reports.join(answered, ["chain", "deployer_key"], "left")
        .withColumn("risk_labels", F.when(F.col("_rugs").isNotNull(), labels).otherwise(F.col("risk_labels")))
        .withColumn("deployer_prior_rugs", F.coalesce("_rugs", "deployer_prior_rugs"))
        .drop("_rugs", "_labels")
    )


def with_snapshot(reports: DataFrame, snapshots: DataFrame, keys: list[str]) -> DataFrame:
    """Safety rows carrying the id of their token's snapshot, null when there is none."""
    return reports.join(snapshots.select(*keys, "snapshot_id"), keys, "left")
