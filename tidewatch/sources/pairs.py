"""DEX pair and discovery payloads: raw text in, typed token rows out. Junk becomes nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions import chains, text
from tidewatch.functions.values import number, whole
from tidewatch.operators import keys

_SIDES = "struct<buys:string,sells:string>"
PAIR = (
    "struct<chainId:string,dexId:string,pairAddress:string,"
    "baseToken:struct<address:string,symbol:string,name:string>,priceUsd:string,"
    f"txns:struct<h24:{_SIDES},h6:{_SIDES},h1:{_SIDES}>,"
    "volume:struct<h24:string,h6:string,h1:string>,"
    "priceChange:struct<m5:string,h1:string,h6:string,h24:string>,liquidity:struct<usd:string>,"
    "fdv:string,marketCap:string,pairCreatedAt:string,boosts:struct<active:string>,"
    "info:struct<socials:array<string>,websites:array<string>>>"
)
LISTED = (
    "struct<chainId:string,tokenAddress:string,amount:string,totalAmount:string,"
    "description:string,links:array<string>>"
)
SUMS = (
    "liquidity_usd", "volume_24h_usd", "volume_6h_usd", "volume_1h_usd", "boosts_active",
)
COUNTS = ("txns_24h", "txns_6h", "txns_1h", "buys_24h", "sells_24h", "buys_1h", "sells_1h")
FLAGS = ("telegram", "x", "website")


def pools(payloads: DataFrame, payload: str = "payload", order: str = "pos", registry=chains.REGISTRY) -> DataFrame:
    """One typed row per pool. The payload is {"pairs": [...]} or a bare list."""
    wrapped = F.from_json(payload, f"struct<pairs:array<{PAIR}>>")["pairs"]
    bare = F.from_json(F.when(F.trim(payload).startswith("["), F.col(payload)), f"array<{PAIR}>")
    rows = payloads.select(order, F.posexplode(F.coalesce(wrapped, bare)).alias("idx", "p"))
    p = F.col("p")

    socials = text.link_items(p["info"]["socials"])
    websites = text.link_items(p["info"]["websites"])
    none = F.array().cast("array<struct<url:string,kind:string>>")
    links = F.when(
        p["info"]["socials"].isNotNull() | p["info"]["websites"].isNotNull(),
        F.concat(F.coalesce(socials, none), F.coalesce(websites, none)),
    )
    return (
        rows.withColumn("chain", chains.canonical(p["chainId"], registry))
        .withColumn("contract", p["baseToken"]["address"])
        .where("chain is not null and contract <> ''")
        .select(
            "chain",
            "contract",
            F.struct(order, "idx").alias("at"),
            p["baseToken"]["symbol"].alias("ticker"),
            p["baseToken"]["name"].alias("name"),
            F.nullif(p["dexId"], F.lit("")).alias("dex_id"),
            number(p["priceUsd"]).alias("price_usd"),
            number(p["marketCap"]).alias("mcap_usd"),
            number(p["fdv"]).alias("fdv_usd"),
            number(p["liquidity"]["usd"]).alias("liquidity_usd"),
            number(p["volume"]["h24"]).alias("volume_24h_usd"),
            number(p["volume"]["h6"]).alias("volume_6h_usd"),
            number(p["volume"]["h1"]).alias("volume_1h_usd"),
            number(p["boosts"]["active"]).alias("boosts_active"),
            *[
                whole(p["txns"][w][side]).alias(f"{side}_{n}")
                for w, n in (("h24", "24h"), ("h6", "6h"), ("h1", "1h"))
                for side in ("buys", "sells")
            ],
            *[
                number(p["priceChange"][w]).alias(f"price_change_{n}_pct")
                for w, n in (("m5", "5m"), ("h1", "1h"), ("h6", "6h"), ("h24", "24h"))
            ],
            whole(p["pairCreatedAt"]).alias("created_at_ms"),
            links.alias("_links"),
        )
        # Everything below reads parsed columns, so each text is parsed once.
        .withColumns(
            {
                **{c: F.when(F.col(c) > 0, F.col(c)) for c in ("mcap_usd", "fdv_usd", "created_at_ms")},
                **{f"txns_{n}": _trades(n) for n in ("24h", "6h", "1h")},
                **{f"declared_{k}": text.declares(F.col("_links"), k) for k in FLAGS},
                "telegram_url": text.first_url(F.col("_links"), "telegram"),
                "x_url": text.first_url(F.col("_links"), "x"),
            }
        )
        .drop("_links", "buys_6h", "sells_6h")
    )


def _trades(window: str) -> Column:
    b, s = F.col(f"buys_{window}"), F.col(f"sells_{window}")
    return F.when(b.isNotNull() | s.isNotNull(), F.coalesce(b, F.lit(0)) + F.coalesce(s, F.lit(0)))


def tokens(pool_rows: DataFrame) -> DataFrame:
    """Pools added up per token.

    Additive facts are null-skipping sums. Price, caps and changes come from the deepest pool,
    the first of equals. Everything is one aggregate that combines map-side.
    """
    depth = F.struct(F.coalesce("liquidity_usd", F.lit(0.0)), -F.col("at.pos"), -F.col("at.idx"))
    quoted = (
        "ticker", "name", "price_usd", "mcap_usd", "fdv_usd", "price_change_5m_pct",
        "price_change_1h_pct", "price_change_6h_pct", "price_change_24h_pct",
    )

    def first_known(c: str) -> Column:
        return F.min_by(c, F.when(F.col(c).isNotNull(), F.col("at"))).alias(c)

    return (
        pool_rows.groupBy("chain", "contract")
        .agg(
            F.max_by(F.struct(*quoted), depth).alias("_q"),
            *[F.sum(c).alias(c) for c in SUMS],
            *[F.sum(c).alias(c) for c in COUNTS],
            F.count("*").alias("pair_count"),
            F.min("created_at_ms").alias("first_seen_at_ms"),
            F.sort_array(F.collect_set("dex_id")).alias("dex_ids"),
            *[F.bool_or(f"declared_{k}").alias(f"declared_{k}") for k in FLAGS],
            first_known("telegram_url"),
            first_known("x_url"),
        )
        .select("chain", "contract", "_q.*", *SUMS, *COUNTS, "pair_count", "first_seen_at_ms",
                "dex_ids", *[f"declared_{k}" for k in FLAGS], "telegram_url", "x_url")
    )


def discovery(payloads: DataFrame, kind: Column | str, payload: str = "payload", order: str = "pos", registry=chains.REGISTRY) -> DataFrame:
    """Boost and profile lists to candidate rows with spend and declared links."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    listed = F.from_json(F.when(F.trim(payload).startswith("["), F.col(payload)), f"array<{LISTED}>")
    rows = payloads.select(order, kind.alias("discovery"), F.posexplode(listed).alias("idx", "e"))
    e = F.col("e")
    return (
        rows.withColumn("chain", chains.canonical(e["chainId"], registry))
        .withColumn("contract", e["tokenAddress"])
        .where("chain is not null and contract <> ''")
        .withColumn("_links", text.link_items(e["links"]))
        .select(
            "chain",
            "contract",
            "discovery",
            F.struct(order, "idx").alias("at"),
            number(e["amount"]).alias("boost_amount"),
            number(e["totalAmount"]).alias("boost_total"),
            e["description"].alias("description"),
            *[text.declares(F.col("_links"), k).alias(f"declared_{k}") for k in FLAGS],
            text.first_url(F.col("_links"), "telegram").alias("telegram_url"),
            text.first_url(F.col("_links"), "x").alias("x_url"),
        )
    )


# Fixed value: the order in which discovery sources are consulted.
SOURCE_ORDER = {"boost_top": 0, "boost_latest": 1, "profile": 2}


def candidates(listed: DataFrame) -> DataFrame:
    """One row per token: the first entry wins, boosts take the maximum, flags fill unknowns."""
    at = F.struct(chains.lookup(SOURCE_ORDER, F.col("discovery")), "at.pos", "at.idx")

    def first_known(c: str) -> Column:
        return F.min_by(c, F.when(F.col(c).isNotNull(), F.col("_at"))).alias(c)

    kept = ("discovery", "description", "telegram_url", "x_url")
    return (
        listed.withColumn("_at", at)
        .groupBy("chain", "contract")
        .agg(
            F.min_by(F.struct(*kept), "_at").alias("_f"),
            F.max("boost_amount").alias("boost_amount"),
            F.max("boost_total").alias("boost_total"),
            *[first_known(f"declared_{k}") for k in FLAGS],
        )
        .select("chain", "contract", "_f.*", "boost_amount", "boost_total", *[f"declared_{k}" for k in FLAGS])
    )


def with_discovery(token_rows: DataFrame, found: DataFrame, how: str = "left") -> DataFrame:
    """Token rows with their discovery facts; a measured value is never replaced."""
    shared = [c for c in (*[f"declared_{k}" for k in FLAGS], "telegram_url", "x_url")]
    side = found.select(
        "chain",
        "contract",
        F.col("discovery").alias("entry_path"),
        "boost_amount",
        "boost_total",
        *[F.col(c).alias(f"_d_{c}") for c in shared],
    )
    joined = token_rows.join(side, ["chain", "contract"], how)
    return joined.withColumns({c: F.coalesce(c, f"_d_{c}") for c in shared}).drop(
        *[f"_d_{c}" for c in shared]
    )


def capped(found: DataFrame, limit: int | None) -> DataFrame:
    """The first candidates in key order, so the cap prefers no loud token; all with ``None``."""
    return found if limit is None else found.orderBy("chain", "contract").limit(limit)


def address_key(c: Column | str) -> Column:
    """Addresses that are 0x hex compare without case; others compare exactly."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.lower(F.substring(c, 1, 2)) == "0x", F.lower(c)).otherwise(c)


def seeds(lists: DataFrame, raw: str) -> DataFrame:
    """Distinct addresses of comma-separated lists, keeping their first position."""
    items = lists.select(F.posexplode(F.split(raw, ",")).alias("pos", "item"))
    return (
        items.select("pos", F.trim("item").alias("contract"))
        .where("contract <> ''")
        .groupBy("contract")
        .agg(F.min("pos").alias("pos"))
    )


def resolve_seeds(seed_rows: DataFrame, token_rows: DataFrame, chain_order: list[str]) -> DataFrame:
    """Match seeds to tokens by address; of several chains the first requested one is used."""
    preference = chains.lookup({c: i for i, c in enumerate(chain_order)}, F.col("chain"))
    offered = token_rows.withColumn("_rank", preference).where("_rank is not null")
    matched = seed_rows.select(F.col("contract").alias("seed"), address_key("contract").alias("_key")).join(
        offered.withColumn("_key", address_key("contract")), "_key"
    )
    return keys.first(matched, ["seed"], ["_rank", "contract"]).drop("_key", "_rank")


def chain_census(payloads: DataFrame, origin: str, payload: str = "payload", registry=chains.REGISTRY) -> DataFrame:
    """Raw chain ids with counts, the origins that showed them and whether each is registered."""
    one = F.from_json(payload, "struct<pairs:array<struct<chainId:string>>>")["pairs"]
    many = F.from_json(F.when(F.trim(payload).startswith("["), F.col(payload)), "array<struct<chainId:string>>")
    ids = payloads.select(F.col(origin).alias("origin"), F.explode(F.coalesce(one, many)).alias("e"))
    counted = (
        ids.select("origin", F.col("e.chainId").alias("raw_id"))
        .where("raw_id <> ''")
        .groupBy("raw_id")
        .agg(F.count("*").alias("tokens_seen"), F.sort_array(F.collect_set("origin")).alias("seen_via"))
    )
    name = chains.canonical("raw_id", registry)
    names = [c.name for c in registry if c.known]
    bound = [c.name for c in registry if c.source_id]
    return counted.select(
        "raw_id",
        "tokens_seen",
        "seen_via",
        name.alias("canonical_name"),
        name.isin(names).alias("registered"),
        name.isin(bound).alias("bound_to_a_source"),
    )
