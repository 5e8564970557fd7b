"""New-pool, trade/supply and holder payloads of one chain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import text
from tidewatch.functions.values import number, to_ms, whole

CHAIN = "solana"


def _text(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def new_pools(payloads: DataFrame, observed_at: str, payload: str = "payload", order: str = "pos") -> DataFrame:
    """One observation per newly pooled token."""
    schema = (
        "struct<Solana:struct<DEXPools:array<struct<Block:struct<Time:string>,Pool:struct<Market:"
        "struct<BaseCurrency:struct<MintAddress:string,Symbol:string,Name:string,Uri:string>>,"
        "Quote:struct<PostAmountInUSD:string>>>>>>"
    )
    rows = payloads.select(
        order, observed_at, F.posexplode(F.from_json(payload, schema)["Solana"]["DEXPools"]).alias("idx", "e")
    )
    base = F.col("e.Pool.Market.BaseCurrency")
    uri = text.declared_in_uri(base["Uri"])
    return rows.where(base["MintAddress"] != "").select(
        F.lit(CHAIN).alias("chain"),
        base["MintAddress"].alias("contract"),
        F.struct(order, "idx").alias("at"),
        F.col(observed_at).alias("observed_at_ms"),
        base["Symbol"].alias("ticker"),
        base["Name"].alias("name"),
        to_ms(F.col("e.Block.Time")).alias("first_seen_at_ms"),
        number(F.col("e.Pool.Quote.PostAmountInUSD")).alias("liquidity_usd"),
        uri["telegram"].alias("declared_telegram"),
        uri["x"].alias("declared_x"),
        uri["website"].alias("declared_website"),
    )


def token_metrics(payloads: DataFrame, payload: str = "payload", order: str = "pos") -> DataFrame:
    """Per-mint fields from trades and supply updates.

    Later entries overwrite price, volume and market cap even with null; names keep the newest
    trade value that is not empty, and a supply name counts only when no trade mentioned the
    mint. An authority is revoked when its key is present and empty, unknown when it is absent.
    """
    trade = "struct<Trade:struct<Currency:map<string,string>,PriceInUSD:string>,volume_24h_usd:string>"
    supply = "struct<TokenSupplyUpdate:struct<Currency:map<string,string>,Marketcap:string>>"
    parsed = payloads.select(
        order,
        F.from_json(
            payload,
            f"struct<Solana:struct<DEXTradeByTokens:array<{trade}>,TokenSupplyUpdates:array<{supply}>>>",
        )["Solana"].alias("s"),
    )
    t = parsed.select(order, F.posexplode("s.DEXTradeByTokens").alias("idx", "e")).select(
        F.struct(order, "idx").alias("at"),
        F.try_element_at("e.Trade.Currency", F.lit("MintAddress")).alias("mint"),
        number(F.col("e.Trade.PriceInUSD")).alias("price_usd"),
        number(F.col("e.volume_24h_usd")).alias("volume_24h_usd"),
        _text(F.try_element_at("e.Trade.Currency", F.lit("Symbol"))).alias("ticker"),
        _text(F.try_element_at("e.Trade.Currency", F.lit("Name"))).alias("name"),
    )

    def newest_known(c: str) -> Column:
        return F.max_by(c, F.when(F.col(c).isNotNull(), F.col("at"))).alias(c)

    trades = (
        t.where("mint <> ''")
        .groupBy("mint")
        .agg(
            F.max_by(F.struct("price_usd", "volume_24h_usd"), "at").alias("_t"),
            newest_known("ticker"),
            newest_known("name"),
        )
        .select("mint", "_t.*", F.col("ticker").alias("_tt"), F.col("name").alias("_tn"), F.lit(True).alias("_traded"))
    )
    c = F.col("e.TokenSupplyUpdate.Currency")

    def authority(key: str) -> Column:
        return F.when(
            F.map_contains_key(c, F.lit(key)), F.coalesce(F.try_element_at(c, F.lit(key)), F.lit("")) == ""
        )

    uri = text.declared_in_uri(F.try_element_at(c, F.lit("Uri")))
    s = parsed.select(order, F.posexplode("s.TokenSupplyUpdates").alias("idx", "e")).select(
        F.struct(order, "idx").alias("at"),
        F.try_element_at(c, F.lit("MintAddress")).alias("mint"),
        number(F.col("e.TokenSupplyUpdate.Marketcap")).alias("mcap_usd"),
        authority("MintAuthority").alias("mint_revoked"),
        (~authority("FreezeAuthority")).alias("freeze_active"),
        uri.alias("_uri"),
        F.try_element_at(c, F.lit("Symbol")).alias("_st"),
        F.try_element_at(c, F.lit("Name")).alias("_sn"),
    )
    supplies = (
        s.where("mint <> ''")
        .groupBy("mint")
        .agg(
            F.max_by(F.struct("mcap_usd"), "at").alias("_m"),
            newest_known("mint_revoked"),
            newest_known("freeze_active"),
            newest_known("_uri"),
            # The first supply entry sets an absent name; later ones find it present.
            F.min_by(F.struct("_st", "_sn"), "at").alias("_first"),
        )
        .select("mint", "_m.mcap_usd", "mint_revoked", "freeze_active", "_uri", "_first._st", "_first._sn", F.lit(True).alias("_supplied"))
    )
    traded = F.col("_traded").isNotNull()
    return trades.join(supplies, "mint", "full").select(
        "mint",
        "price_usd",
        "volume_24h_usd",
        "mcap_usd",
        "mint_revoked",
        "freeze_active",
        F.col("_uri.telegram").alias("declared_telegram"),
        F.col("_uri.x").alias("declared_x"),
        F.col("_uri.website").alias("declared_website"),
        F.when(traded, F.col("_tt")).otherwise(F.col("_st")).alias("ticker"),
        F.when(traded, F.col("_tn")).otherwise(F.col("_sn")).alias("name"),
        traded.alias("has_trades"),
        F.col("_supplied").isNotNull().alias("has_supply"),
    )


def holder_counts(payloads: DataFrame, payload: str = "payload", order: str = "pos") -> DataFrame:
    """Mint to holder count; the last readable entry wins."""
    schema = (
        "struct<Solana:struct<BalanceUpdates:array<struct<BalanceUpdate:struct<Currency:"
        "struct<MintAddress:string>>,holders:string>>>>"
    )
    rows = payloads.select(order, F.posexplode(F.from_json(payload, schema)["Solana"]["BalanceUpdates"]).alias("idx", "e"))
    typed = rows.select(
        F.struct(order, "idx").alias("at"),
        F.col("e.BalanceUpdate.Currency.MintAddress").alias("mint"),
        whole(F.col("e.holders")).alias("holders"),
    ).where("mint <> '' and holders is not null")
    return typed.groupBy("mint").agg(F.max_by("holders", "at").alias("holders"))


def layered(pools: DataFrame, metrics: DataFrame, holders: DataFrame) -> DataFrame:
    """Pool rows with metrics and holders laid over them.

    A metric that was reported overwrites, even when null; one that was not leaves the pool's
    value. A null holder count never overwrites.
    """
    m = metrics.select(
        F.col("mint").alias("contract"),
        *[F.col(c).alias(f"_m_{c}") for c in metrics.columns if c != "mint"],
    )
    h = holders.select(F.col("mint").alias("contract"), F.col("holders").alias("holder_count"))
    joined = pools.join(m, "contract", "left").join(h, "contract", "left")
    traded = F.coalesce("_m_has_trades", F.lit(False))
    supplied = F.coalesce("_m_has_supply", F.lit(False))
    return joined.select(
        "chain",
        "contract",
        "observed_at_ms",
        "first_seen_at_ms",
        "liquidity_usd",
        F.coalesce(_text(F.col("_m_ticker")), "ticker").alias("ticker"),
        F.coalesce(_text(F.col("_m_name")), "name").alias("name"),
        F.when(supplied, F.col("_m_mcap_usd")).alias("mcap_usd"),
        F.when(traded, F.col("_m_price_usd")).alias("price_usd"),
        F.when(traded, F.col("_m_volume_24h_usd")).alias("volume_24h_usd"),
        "holder_count",
        F.col("_m_mint_revoked").alias("mint_revoked"),
        F.col("_m_freeze_active").alias("freeze_active"),
        *[
            F.coalesce(f"_m_declared_{k}", f"declared_{k}").alias(f"declared_{k}")
            for k in ("telegram", "x", "website")
        ],
    )


def histories(rows: DataFrame, as_of_ms: int, lookback_days: int = 90) -> DataFrame:
    """Landed history inside the lookback, the input of a first-crossing backfill."""
    start = as_of_ms - lookback_days * 86_400_000
    return rows.where((F.col("observed_at_ms") >= start) & (F.col("observed_at_ms") <= as_of_ms))
