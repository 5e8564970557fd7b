"""Payload parsers over raw text built from the given tables, junk included.

The SQL twins never see the text: they compute the expected rows from the table itself.
"""

from pyspark.sql import functions as F

from tidewatch.catalog import inputs as I
from tidewatch.catalog import register
from tidewatch.catalog.sql import define
from tidewatch.functions import chains, text
from tidewatch.functions.values import number
from tidewatch.operators import safety
from tidewatch.sources import candles as bars
from tidewatch.sources import pairs, posts, reports, trades



def P():
    return F.col("pos")


def U():
    return F.col("user_id")


def _chain_ids():
    return F.array(*[F.lit(x) for x in ("solana", "bsc", " Ethereum ", "weird Chain!")])


define(
    "pev_",
    """SELECT *, ['solana', 'bnb', 'ethereum', 'weird-chain'][user_id % 4 + 1] AS cname,
  ['solana', 'bsc', ' Ethereum ', 'weird Chain!'][user_id % 4 + 1] AS raw_chain FROM ev_""",
)


def s(c):
    return c.cast("string")


def _chain_id():
    return F.element_at(_chain_ids(), (U() % 4 + 1).cast("int"))


def pair_payloads(spark, d):
    """One payload per event: wrapped, bare-list or junk."""
    v = F.col("value")
    sides = F.struct(s(P() % 9).alias("buys"), F.when(P() % 4 != 0, s(P() % 6)).alias("sells"))
    links = F.array_compact(
        F.array(
            F.when(P() % 2 == 0, F.struct(F.lit("telegram").alias("type"), F.concat(F.lit("https://t.me/g"), P()).alias("url"))),
            F.when(P() % 5 == 1, F.struct(F.lit("twitter").alias("type"), F.concat(F.lit("https://x.com/h"), P()).alias("url"))),
        )
    )
    sites = F.array_compact(F.array(F.when(P() % 4 == 1, F.struct(F.lit("https://site.example").alias("url")))))
    pair = F.struct(
        _chain_id().alias("chainId"),
        F.when(P() % 11 != 0, F.col("event_type")).alias("dexId"),
        F.struct(F.when(P() % 37 != 0, F.col("contract")).alias("address"), F.concat(F.lit("T"), P() % 5).alias("symbol")).alias("baseToken"),
        F.when(P() % 13 == 0, "n/a").otherwise(s(v)).alias("priceUsd"),
        F.struct(F.when(P() % 10 != 0, sides).alias("h24")).alias("txns"),
        F.struct((v * 10).alias("h24"), F.when(P() % 5 != 0, v).alias("h1")).alias("volume"),
        F.struct((P() % 41 - 20).alias("h1")).alias("priceChange"),
        F.struct(F.when(P() % 7 != 0, s(v * 100)).alias("usd")).alias("liquidity"),
        F.when(P() % 3 != 0, v * 3000).alias("fdv"),
        F.when(P() % 17 == 0, -v).otherwise(v * 2500).alias("marketCap"),
        F.when(P() % 8 == 0, F.lit(0)).otherwise(F.col("observed_at_ms")).alias("pairCreatedAt"),
        F.struct(F.when(P() % 3 != 0, P() % 3).alias("active")).alias("boosts"),
        F.when(P() % 6 != 0, F.struct(links.alias("socials"), sites.alias("websites"))).alias("info"),
    )
    return I.events(spark, d).select(
        "pos",
        "event_type",
        F.when(P() % 29 == 0, "not json")
        .when(P() % 31 == 0, F.to_json(F.array(pair)))
        .otherwise(F.to_json(F.struct(F.array(pair).alias("pairs"))))
        .alias("payload"),
    )


define(
    "pool_",
    """SELECT pos, cname AS chain, contract, CASE WHEN pos % 11 <> 0 THEN event_type END AS dex_id,
  'T' || (pos % 5) AS ticker, CASE WHEN pos % 13 <> 0 THEN value END AS price_usd,
  CASE WHEN pos % 17 <> 0 AND value > 0 THEN value * 2500 END AS mcap_usd,
  CASE WHEN pos % 3 <> 0 AND value > 0 THEN value * 3000 END AS fdv_usd,
  CASE WHEN pos % 7 <> 0 THEN value * 100 END AS liquidity_usd, value * 10 AS volume_24h_usd,
  CASE WHEN pos % 5 <> 0 THEN value END AS volume_1h_usd,
  CASE WHEN pos % 10 <> 0 THEN pos % 9 + CASE WHEN pos % 4 <> 0 THEN pos % 6 ELSE 0 END END AS txns_24h,
  CASE WHEN pos % 10 <> 0 THEN pos % 9 END AS buys_24h,
  CASE WHEN pos % 10 <> 0 AND pos % 4 <> 0 THEN pos % 6 END AS sells_24h,
  (pos % 41 - 20)::DOUBLE AS price_change_1h_pct,
  CASE WHEN pos % 8 <> 0 THEN observed_at_ms END AS created_at_ms,
  CASE WHEN pos % 3 <> 0 THEN (pos % 3)::DOUBLE END AS boosts_active,
  CASE WHEN pos % 6 <> 0 THEN pos % 2 = 0 END AS declared_telegram,
  CASE WHEN pos % 6 <> 0 THEN pos % 5 = 1 END AS declared_x,
  CASE WHEN pos % 6 <> 0 THEN pos % 4 = 1 END AS declared_website,
  CASE WHEN pos % 6 <> 0 AND pos % 2 = 0 THEN 'https://t.me/g' || pos END AS telegram_url,
  CASE WHEN pos % 6 <> 0 AND pos % 5 = 1 THEN 'https://x.com/h' || pos END AS x_url
  FROM pev_ WHERE pos % 29 <> 0 AND pos % 37 <> 0""",
)
POOL_COLS = (
    "chain", "contract", "dex_id", "ticker", "price_usd", "mcap_usd", "fdv_usd", "liquidity_usd",
    "volume_24h_usd", "volume_1h_usd", "txns_24h", "buys_24h", "sells_24h", "price_change_1h_pct",
    "created_at_ms", "boosts_active", "declared_telegram", "declared_x", "declared_website",
    "telegram_url", "x_url",
)


@register("s13_pair_payloads", f"SELECT pos, {', '.join(POOL_COLS)} FROM pool_")
def s13(spark, d):
    return pairs.pools(pair_payloads(spark, d)).select(F.col("at.pos").alias("pos"), *POOL_COLS)


define(
    "tok_",
    """SELECT chain, contract, arg_max_null(ticker, (coalesce(liquidity_usd, 0), -pos)) AS ticker,
  arg_max_null(price_usd, (coalesce(liquidity_usd, 0), -pos)) AS price_usd,
  arg_max_null(mcap_usd, (coalesce(liquidity_usd, 0), -pos)) AS mcap_usd,
  round(sum(liquidity_usd), 6) AS liquidity_usd, round(sum(volume_24h_usd), 6) AS volume_24h_usd,
  sum(txns_24h)::BIGINT AS txns_24h, sum(buys_24h)::BIGINT AS buys_24h, sum(sells_24h)::BIGINT AS sells_24h,
  sum(boosts_active) AS boosts_active, count(*) AS pair_count, min(created_at_ms) AS first_seen_at_ms,
  array_to_string(list_sort(list_distinct(list(dex_id))), ',') AS dex_ids,
  bool_or(declared_telegram) AS declared_telegram, bool_or(declared_x) AS declared_x,
  bool_or(declared_website) AS declared_website, arg_min(telegram_url, pos) AS telegram_url,
  arg_min(x_url, pos) AS x_url FROM pool_ GROUP BY 1, 2""",
)


@register("a01_pool_aggregate", "SELECT * FROM tok_")
def a01(spark, d):
    t = pairs.tokens(pairs.pools(pair_payloads(spark, d)))
    return t.select(
        "chain", "contract", "ticker", "price_usd", "mcap_usd",
        F.round("liquidity_usd", 6).alias("liquidity_usd"),
        F.round("volume_24h_usd", 6).alias("volume_24h_usd"),
        "txns_24h", "buys_24h", "sells_24h", "boosts_active", "pair_count", "first_seen_at_ms",
        F.array_join("dex_ids", ",").alias("dex_ids"), "declared_telegram", "declared_x",
        "declared_website", "telegram_url", "x_url",
    )


def listed_payloads(spark, d):
    """Boost and profile lists: two entries per event, one of them without an address."""
    entry = F.struct(
        _chain_id().alias("chainId"),
        F.col("contract").alias("tokenAddress"),
        F.when(P() % 3 != 2, s(P() % 50)).alias("amount"),
        F.when(P() % 4 != 2, P() % 500).alias("totalAmount"),
        F.when(
            P() % 5 != 0,
            F.array_compact(
                F.array(
                    F.when(P() % 2 == 1, F.struct(F.lit("telegram").alias("label"), F.lit("https://t.me/q").alias("url"))),
                    F.when(P() % 3 == 1, F.struct(F.lit("site").alias("label"), F.lit("https://a.example").alias("url"))),
                )
            ),
        ).alias("links"),
    )
    empty = F.struct(_chain_id().alias("chainId"), F.lit(None).cast("string").alias("tokenAddress"))
    both = F.concat(F.lit("["), F.to_json(entry), F.lit(","), F.to_json(empty), F.lit("]"))
    kind = F.element_at(F.array(F.lit("boost_top"), F.lit("boost_latest"), F.lit("profile")), (P() % 3 + 1).cast("int"))
    return I.events(spark, d).select(
        "pos", kind.alias("kind"), F.when(P() % 43 == 0, '{"no": 1}').otherwise(both).alias("payload")
    )


define(
    "disc_",
    """SELECT pos, cname AS chain, contract, ['boost_top', 'boost_latest', 'profile'][pos % 3 + 1] AS discovery,
  CASE WHEN pos % 3 <> 2 THEN (pos % 50)::DOUBLE END AS boost_amount,
  CASE WHEN pos % 4 <> 2 THEN (pos % 500)::DOUBLE END AS boost_total,
  CASE WHEN pos % 5 <> 0 THEN pos % 2 = 1 END AS declared_telegram,
  CASE WHEN pos % 5 <> 0 THEN false END AS declared_x,
  CASE WHEN pos % 5 <> 0 THEN pos % 3 = 1 END AS declared_website,
  CASE WHEN pos % 5 <> 0 AND pos % 2 = 1 THEN 'https://t.me/q' END AS telegram_url
  FROM pev_ WHERE pos % 43 <> 0""",
)
DISC = (
    "chain", "contract", "discovery", "boost_amount", "boost_total", "declared_telegram",
    "declared_x", "declared_website", "telegram_url",
)


def discovered(spark, d):
    return pairs.discovery(listed_payloads(spark, d), F.col("kind"))


@register("s14_discovery_payloads", f"SELECT pos, {', '.join(DISC)} FROM disc_")
def s14(spark, d):
    return discovered(spark, d).select(F.col("at.pos").alias("pos"), *DISC)


define(
    "cand_",
    """SELECT chain, contract, arg_min(discovery, (pos % 3, pos)) AS entry_path, max(boost_amount) AS boost_amount,
  max(boost_total) AS boost_total, arg_min(declared_telegram, (pos % 3, pos)) AS declared_telegram,
  arg_min(declared_website, (pos % 3, pos)) AS declared_website,
  arg_min_null(telegram_url, (pos % 3, pos)) AS telegram_url FROM disc_ GROUP BY 1, 2""",
)


@register("u02_discovery_union", "SELECT * FROM cand_")
def u02(spark, d):
    c = pairs.candidates(discovered(spark, d))
    return c.select(
        "chain", "contract", F.col("discovery").alias("entry_path"), "boost_amount", "boost_total",
        "declared_telegram", "declared_website", "telegram_url",
    )


@register("o04_capped_candidates", "SELECT chain, contract FROM cand_ ORDER BY chain, contract LIMIT 120")
def o04(spark, d):
    return pairs.capped(pairs.candidates(discovered(spark, d)), 120).select("chain", "contract")


@register("o04_all_candidates", "SELECT chain, contract FROM cand_")
def o04_all(spark, d):
    return pairs.capped(pairs.candidates(discovered(spark, d)), None).select("chain", "contract")


@register(
    "j08_tokens_with_discovery",
    """SELECT t.chain, t.contract, c.entry_path, c.boost_amount, t.pair_count,
    coalesce(t.declared_telegram, c.declared_telegram) AS declared_telegram,
    coalesce(t.declared_website, c.declared_website) AS declared_website,
    coalesce(t.telegram_url, c.telegram_url) AS telegram_url FROM tok_ t JOIN cand_ c USING (chain, contract)""",
)
def j08(spark, d):
    t = pairs.tokens(pairs.pools(pair_payloads(spark, d)))
    j = pairs.with_discovery(t, pairs.candidates(discovered(spark, d)), "inner")
    return j.select(
        "chain", "contract", "entry_path", "boost_amount", "pair_count", "declared_telegram",
        "declared_website", "telegram_url",
    )


define(
    "seedtok_",
    """SELECT ['bnb', 'ethereum', 'solana'][g + 1] AS chain, '0xAB' || user_id AS contract, count(*) AS pair_count
  FROM ev_ CROSS JOIN (VALUES (0), (1), (2)) v(g) WHERE user_id % 5 >= g GROUP BY 1, 2""",
)


@register(
    "j09_seed_addresses",
    """SELECT seed, chain, contract, pair_count FROM (SELECT DISTINCT CASE WHEN user_id % 2 = 0 THEN '0xab' ELSE '0xAB' END
    || user_id AS seed, user_id FROM ev_) x JOIN seedtok_ t ON lower(t.contract) = lower(x.seed)
    WHERE t.chain IN ('ethereum', 'bnb') QUALIFY row_number() OVER (PARTITION BY seed ORDER BY
    CASE t.chain WHEN 'ethereum' THEN 0 ELSE 1 END, contract) = 1""",
)
def j09(spark, d):
    e = I.events(spark, d)
    groups = F.explode(F.sequence(F.lit(0), F.least(F.lit(2), U() % 5).cast("int")))
    names = F.array(F.lit("bnb"), F.lit("ethereum"), F.lit("solana"))
    tokens = (
        e.select(U(), groups.alias("g"))
        .select(F.element_at(names, F.col("g") + 1).alias("chain"), F.concat(F.lit("0xAB"), U()).alias("contract"))
        .groupBy("chain", "contract")
        .agg(F.count("*").alias("pair_count"))
    )
    listed = e.select(F.concat(F.when(U() % 2 == 0, "0xab").otherwise("0xAB"), U()).alias("raw"))
    return pairs.resolve_seeds(pairs.seeds(listed, "raw"), tokens, ["ethereum", "bnb"]).select(
        "seed", "chain", "contract", "pair_count"
    )


@register(
    "u05_distinct_seeds",
    """SELECT contract, min(p) AS pos FROM (SELECT trim(x) AS contract, p - 1 AS p FROM (SELECT unnest(string_split(
    'a' || user_id || ', b' || (user_id % 7) || ',,a' || user_id, ',')) AS x, unnest(range(1, 5)) AS p FROM ev_))
    WHERE contract <> '' GROUP BY 1""",
)
def u05(spark, d):
    raw = F.concat(F.lit("a"), U(), F.lit(", b"), U() % 7, F.lit(",,a"), U())
    out = pairs.seeds(I.events(spark, d).select(raw.alias("raw")), "raw")
    return out.select("contract", F.col("pos").cast("bigint").alias("pos"))


@register(
    "a25_chain_id_census",
    """SELECT raw_chain AS raw_id, count(*) AS tokens_seen, array_to_string(list_sort(list_distinct(list(event_type))), ',')
    AS seen_via, any_value(cname) AS canonical_name, any_value(cname) <> 'weird-chain' AS registered,
    any_value(cname) <> 'weird-chain' AS bound_to_a_source FROM pev_ WHERE pos % 29 <> 0 GROUP BY 1""",
)
def a25(spark, d):
    census = pairs.chain_census(pair_payloads(spark, d), "event_type")
    return census.withColumn("seen_via", F.array_join("seen_via", ","))


# --- trades --------------------------------------------------------------------


def trade_payloads(spark, d):
    """Pools, trades, supply and holder payloads, several of each per mint."""
    v = F.col("value")
    name = F.when(P() % 3 != 0, F.concat(F.lit("N"), P() % 10))
    cur = F.to_json(
        F.struct(F.col("contract").alias("MintAddress"), F.when(P() % 4 != 0, F.concat(F.lit("S"), P() % 6)).alias("Symbol"), name.alias("Name"))
    )
    trade = F.concat(
        F.lit('{"Trade":{"Currency":'), cur, F.lit(',"PriceInUSD":'),
        F.when(P() % 5 == 0, F.lit("null")).otherwise(s(v)), F.lit('},"volume_24h_usd":"'), s(v * 10), F.lit('"}'),
    )
    mint_key = F.when(P() % 3 == 0, F.lit(',"MintAuthority":null')).when(P() % 3 == 1, F.lit(',"MintAuthority":"me"')).otherwise("")
    freeze_key = F.when(P() % 4 == 0, F.lit(',"FreezeAuthority":""')).when(P() % 4 == 1, F.lit(',"FreezeAuthority":"me"')).otherwise("")
    uri = F.when(P() % 6 == 0, F.lit(',"Uri":"https://t.me/z"')).when(P() % 6 == 1, F.lit(',"Uri":"ipfs://q"')).otherwise("")
    supply = F.concat(
        F.lit('{"TokenSupplyUpdate":{"Currency":{"MintAddress":"'), F.col("contract"), F.lit('","Symbol":"Y'), P() % 8, F.lit('"'),
        mint_key, freeze_key, uri, F.lit('},"Marketcap":'), F.when(P() % 7 == 0, F.lit("null")).otherwise(s(v * 2500)), F.lit("}}"),
    )
    traded, supplied = F.col("event_type") == "purchase", F.col("event_type") == "click"
    metrics = F.concat(
        F.lit('{"Solana":{"DEXTradeByTokens":['), F.when(traded, trade).otherwise(""),
        F.lit('],"TokenSupplyUpdates":['), F.when(supplied, supply).otherwise(""), F.lit("]}}"),
    )
    pool = F.concat(
        F.lit('{"Solana":{"DEXPools":[{"Block":{"Time":"'),
        F.date_format(F.timestamp_millis("observed_at_ms"), "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        F.lit('"},"Pool":{"Market":{"BaseCurrency":{"MintAddress":"'), F.col("contract"),
        F.lit('","Symbol":"P'), P() % 4, F.lit('"'), uri, F.lit('}},"Quote":{"PostAmountInUSD":"'), s(v), F.lit('"}}}]}}'),
    )
    holders = F.concat(
        F.lit('{"Solana":{"BalanceUpdates":[{"BalanceUpdate":{"Currency":{"MintAddress":"'), F.col("contract"),
        F.lit('"}},"holders":"'), F.when(P() % 9 == 0, "many").otherwise(s(P() % 1000)), F.lit('"}]}}'),
    )
    return I.events(spark, d).select(
        "pos", "user_id", "event_type", "observed_at_ms", metrics.alias("metrics"), pool.alias("pool"), holders.alias("holders")
    )


define(
    "pooled_",
    """SELECT pos, contract, observed_at_ms, observed_at_ms // 1000 * 1000 AS first_seen_at_ms, 'P' || (pos % 4) AS ticker,
  value AS liquidity_usd, CASE WHEN pos % 6 < 2 THEN pos % 6 = 0 END AS declared_telegram,
  CASE WHEN pos % 6 < 2 THEN false END AS declared_x, CASE WHEN pos % 6 < 2 THEN pos % 6 = 0 END AS declared_website
  FROM ev_""",
)


@register("s15_new_pools", "SELECT * FROM pooled_")
def s15(spark, d):
    return trades.new_pools(trade_payloads(spark, d), "observed_at_ms", "pool").select(
        F.col("at.pos").alias("pos"), "contract", "observed_at_ms", "first_seen_at_ms", "ticker", "liquidity_usd",
        "declared_telegram", "declared_x", "declared_website",
    )


define(
    "metric_",
    """SELECT coalesce(t.contract, u.contract) AS mint, t.price_usd, t.volume_24h_usd, u.mcap_usd, u.mint_revoked,
  u.freeze_active, u.declared_telegram, CASE WHEN t.contract IS NOT NULL THEN t.ticker ELSE u.ticker END AS ticker,
  t.contract IS NOT NULL AS has_trades, u.contract IS NOT NULL AS has_supply FROM (SELECT contract,
    arg_max_null(CASE WHEN pos % 5 <> 0 THEN value END, pos) AS price_usd, arg_max(value * 10, pos) AS volume_24h_usd,
    arg_max(CASE WHEN pos % 4 <> 0 THEN 'S' || (pos % 6) END, pos) AS ticker FROM ev_ WHERE event_type = 'purchase' GROUP BY 1) t
  FULL JOIN (SELECT contract, arg_max_null(CASE WHEN pos % 7 <> 0 THEN value * 2500 END, pos) AS mcap_usd,
    arg_max(CASE WHEN pos % 3 < 2 THEN pos % 3 = 0 END, pos) AS mint_revoked,
    arg_max(CASE WHEN pos % 4 < 2 THEN pos % 4 = 1 END, pos) AS freeze_active,
    arg_max(CASE WHEN pos % 6 < 2 THEN pos % 6 = 0 END, pos) AS declared_telegram,
    'Y' || arg_min(pos % 8, pos) AS ticker FROM ev_ WHERE event_type = 'click' GROUP BY 1) u ON t.contract = u.contract""",
)


@register("s16_token_metrics", "SELECT * FROM metric_")
def s16(spark, d):
    return trades.token_metrics(trade_payloads(spark, d), "metrics").select(
        "mint", "price_usd", "volume_24h_usd", "mcap_usd", "mint_revoked", "freeze_active", "declared_telegram",
        "ticker", "has_trades", "has_supply",
    )


define("holder_", "SELECT contract AS mint, arg_max(pos % 1000, pos) AS holders FROM ev_ WHERE pos % 9 <> 0 GROUP BY 1")


@register("s17_holder_counts", "SELECT * FROM holder_")
def s17(spark, d):
    return trades.holder_counts(trade_payloads(spark, d), "holders")


def _layered(spark, d):
    raw = trade_payloads(spark, d)
    pools_ = trades.new_pools(raw, "observed_at_ms", "pool")
    return trades.layered(pools_, trades.token_metrics(raw, "metrics"), trades.holder_counts(raw, "holders"))


@register(
    "s30_pool_feed",
    """SELECT p.contract, p.observed_at_ms, coalesce(m.ticker, p.ticker) AS ticker, m.mcap_usd, m.price_usd, h.holders AS holder_count,
    m.mint_revoked, coalesce(m.declared_telegram, p.declared_telegram) AS declared_telegram FROM pooled_ p
    LEFT JOIN metric_ m ON m.mint = p.contract LEFT JOIN holder_ h ON h.mint = p.contract""",
)
def s30(spark, d):
    return _layered(spark, d).select(
        "contract", "observed_at_ms", "ticker", "mcap_usd", "price_usd", "holder_count", "mint_revoked", "declared_telegram"
    )


@register(
    "j10_layered_pools",
    """SELECT chain, count(*) AS pools, count(mcap_usd) AS with_mcap, count(holders) AS with_holders FROM (SELECT 'solana' AS chain,
    m.mcap_usd, h.holders FROM pooled_ p LEFT JOIN metric_ m ON m.mint = p.contract LEFT JOIN holder_ h ON h.mint = p.contract) GROUP BY 1""",
)
def j10(spark, d):
    return _layered(spark, d).groupBy("chain").agg(
        F.count("*").alias("pools"), F.count("mcap_usd").alias("with_mcap"), F.count("holder_count").alias("with_holders")
    )


@register(
    "s29_backfill_histories",
    """SELECT chain, contract, count(*) AS points, min(observed_at_ms) AS first_ms FROM ev_
    WHERE observed_at_ms BETWEEN 1704758400000 - 3 * 86400000 AND 1704758400000 GROUP BY 1, 2""",
)
def s29(spark, d):
    rows = trades.histories(I.events(spark, d), I.AS_OF_LATE, 3)
    return rows.groupBy("chain", "contract").agg(
        F.count("*").alias("points"), F.min("observed_at_ms").alias("first_ms")
    )


# --- safety reports -------------------------------------------------------------


def _flag01(k: int, m: int):
    return F.when(P() % m != 0, F.when(P() % k == 0, "1").otherwise("0"))


def evm_payloads(spark, d):
    v = F.col("value")
    frac = (P() % 21) * 5 / 100
    holders = F.to_json(
        F.array(
            F.struct(F.lit("0x000000000000000000000000000000000000dEaD").alias("address"), F.lit("").alias("tag"), s(frac).alias("percent"), F.lit(0).alias("is_locked")),
            F.struct(F.lit("0xaa").alias("address"), F.lit("UniCrypt").alias("tag"), F.lit("0.25").alias("percent"), F.when(P() % 2 == 0, 1).otherwise(0).alias("is_locked")),
        )
    )
    top = F.to_json(
        F.array(
            F.struct(F.lit("0x1").alias("address"), F.lit("").alias("tag"), F.lit("0.125").alias("percent")),
            F.struct(F.lit("0x2").alias("address"), F.lit("Binance 14").alias("tag"), F.lit("0.5").alias("percent")),
            F.struct(F.lit("0x3").alias("address"), F.lit("").alias("tag"), F.when(P() % 4 != 0, s((P() % 16) / 64)).alias("percent")),
        )
    )
    flags = F.to_json(
        F.struct(
            _flag01(5, 7).alias("is_honeypot"),
            _flag01(3, 11).alias("cannot_sell_all"),
            F.when(P() % 6 != 0, s((P() % 16) / 64)).alias("buy_tax"),
            F.when(P() % 6 == 1, "free").otherwise("0.25").alias("sell_tax"),
            _flag01(2, 5).alias("is_mintable"),
            _flag01(9, 8).alias("transfer_pausable"),
            _flag01(4, 3).alias("is_proxy"),
            F.when(P() % 3 == 0, "").when(P() % 3 == 1, "0xOwner").alias("owner_address"),
            F.when(P() % 5 == 0, "1").alias("can_take_back_ownership"),
            F.when(P() % 4 == 0, "0xMaker").alias("creator_address"),
            s(P() % 300).alias("holder_count"),
            _flag01(6, 13).alias("hidden_owner"),
        )
    )
    facts = F.concat(
        F.regexp_replace(flags, "\\}$", ""), F.lit(',"lp_holders":'), F.when(P() % 10 != 0, holders).otherwise("null"),
        F.lit(',"holders":'), top, F.lit("}"),
    )
    body = F.concat(F.lit('{"result":{"0xToken'), P(), F.lit('":'), facts, F.lit("}}"))
    return I.events(spark, d).where("chain <> 'c1'").select(
        "pos", "chain", F.when(P() % 47 == 0, "<html>").otherwise(body).alias("payload")
    )


def _f01(k: int, m: int) -> str:
    return f"CASE WHEN pos % {m} <> 0 THEN pos % {k} = 0 END"


@register(
    "s18_evm_safety",
    f"""SELECT pos, chain, '0xtoken' || pos AS contract, {_f01(5, 7)} AS honeypot, {_f01(3, 11)} AS sells_failing,
    CASE WHEN pos % 6 <> 0 THEN (pos % 16) / 64.0::DOUBLE * 100.0 END AS buy_tax_pct,
    CASE WHEN pos % 6 <> 1 THEN 25.0::DOUBLE END AS sell_tax_pct, NOT ({_f01(2, 5)}) AS mint_revoked, {_f01(9, 8)} AS freeze_active,
    CASE WHEN pos % 10 <> 0 THEN CASE WHEN (pos % 21) * 5 >= 50 THEN true WHEN (pos % 21) * 5
      + CASE WHEN pos % 2 = 0 THEN 25 ELSE 0 END <= 0 THEN false END END AS lp_burned,
    CASE WHEN pos % 10 <> 0 THEN round((pos % 21) * 5 + CASE WHEN pos % 2 = 0 THEN 25.0::DOUBLE ELSE 0 END, 6) END AS lp_locked_pct,
    12.5::DOUBLE + CASE WHEN pos % 4 <> 0 THEN (pos % 16) / 64.0::DOUBLE * 100.0 ELSE 0 END AS top10_ex_lp_pct,
    pos % 300 AS holder_count, {_f01(4, 3)} AS upgradeable,
    CASE WHEN pos % 3 < 2 THEN pos % 3 = 0 AND pos % 5 <> 0 END AS admin_renounced,
    CASE WHEN pos % 4 = 0 THEN '0xMaker' WHEN pos % 3 = 1 THEN '0xOwner' END AS deployer_address,
    concat_ws(',', CASE WHEN {_f01(6, 13)} THEN 'hidden_owner' END, CASE WHEN {_f01(9, 8)} THEN 'transfer_pausable' END) AS risk_labels
    FROM ev_ WHERE chain <> 'c1' AND pos % 47 <> 0""",
)
def s18(spark, d):
    r = reports.evm(evm_payloads(spark, d), ["pos", "chain"])
    return r.withColumn("risk_labels", F.array_join("risk_labels", ",")).withColumn(
        "lp_locked_pct", F.round("lp_locked_pct", 6)
    ).drop("source", "source_fields")


@register(
    "f21_seen_fields",
    """SELECT pos, array_to_string(list_sort(list_filter(['goplus:buy_tax', 'goplus:lp_holders', 'goplus:lp_holders[].address',
    'goplus:lp_holders[].percent', 'goplus:holders[].tag'], lambda x: (x <> 'goplus:buy_tax' OR pos % 6 <> 0) AND
    (x NOT LIKE '%lp_holders[]%' OR pos % 10 <> 0))), ',') AS seen FROM ev_ WHERE chain <> 'c1' AND pos % 47 <> 0""",
)
def f21(spark, d):
    r = reports.evm(evm_payloads(spark, d), ["pos", "chain"])
    wanted = F.array(
        *[
            F.lit(f"goplus:{x}")
            for x in ("buy_tax", "lp_holders", "lp_holders[].address", "lp_holders[].percent", "holders[].tag")
        ]
    )
    return r.select("pos", F.array_join(F.sort_array(F.array_intersect("source_fields", wanted)), ",").alias("seen"))


@register(
    "a05_lp_state",
    """SELECT pos, CASE WHEN b >= 50 THEN true WHEN b + l <= 0 THEN false END AS burned, (b + l)::DOUBLE AS locked_pct FROM
    (SELECT pos, pos % 4 * 25 AS b, CASE WHEN pos % 3 = 0 THEN 12.5::DOUBLE ELSE 0 END AS l FROM ev_)""",
)
def a05(spark, d):
    none = F.lit(None).cast("string")

    def holder(address, tag, pct, locked):
        return F.struct(
            address.alias("address"), none.alias("account"), tag.alias("tag"), pct.alias("percent"), locked.alias("is_locked")
        )

    lst = F.array(
        holder(F.lit("wallet"), F.lit("Burn address"), s(P() % 4 * 0.25), F.lit("0")),
        holder(F.lit("locker"), none, F.lit("0.125"), F.when(P() % 3 == 0, "1").otherwise("0")),
    )
    return I.events(spark, d).withColumn("_s", safety.lp_state(lst)).select("pos", "_s.burned", "_s.locked_pct")


@register(
    "a06_top10_concentration",
    """SELECT pos, round(list_sum(list_slice(list_reverse_sort(list_transform(range(1, 15), lambda i: ((pos * i) % 16) / 64.0::DOUBLE * 100.0)), 1, 10)), 6)
    AS top10 FROM ev_""",
)
def a06(spark, d):
    none = F.lit(None).cast("string")
    lst = F.transform(
        F.sequence(F.lit(1), F.lit(16)),
        lambda i: F.struct(
            F.concat(F.lit("w"), i).alias("address"),
            none.alias("account"),
            F.when(i == 15, "Exchange wallet").when(i == 16, "LP pool").alias("tag"),
            s(F.when(i > 14, 0.9).otherwise((P() * i) % 16 / 64)).alias("percent"),
            none.alias("is_locked"),
        ),
    )
    return I.events(spark, d).select("pos", F.round(safety.top10_ex_lp(lst), 6).alias("top10"))


@register(
    "a07_pool_lock",
    """SELECT pos, CASE WHEN pos % 4 = 0 THEN true END AS burned, CASE WHEN pos % 5 = 0 THEN 96.0::DOUBLE WHEN pos % 5 = 1 THEN 0.0
    WHEN pos % 5 = 2 AND pos % 7 <> 0 AND 100.0 * (value + 10) / (value * 2 + 20) BETWEEN 0 AND 100.5 THEN
    round(least(100.0 * (value + 10) / (value * 2 + 20), 100.0), 6) END AS locked_pct FROM ev_""",
)
def a07(spark, d):
    v, m = F.col("value"), P() % 5

    def pool(pct, burned, usd):
        return F.struct(pct.alias("locked_pct"), burned.alias("burned"), usd.alias("locked_usd"))

    lst = F.array(
        pool(F.when(m == 0, 99.0).when(m == 1, 0.0).when(m == 2, 90.0).when(m == 3, 40.0), F.lit(None).cast("boolean"), v),
        pool(F.when(m == 0, 96.0).when(m == 1, -1.0).when(m == 2, 0.0).when(m == 3, 0.0), P() % 4 == 0, F.when((P() % 7 != 0) & (m != 3), F.lit(10.0))),
    )
    total = v * 2 + 20
    return I.events(spark, d).withColumn("_l", safety.pool_lock(lst, total)).select(
        "pos", "_l.burned", F.round("_l.locked_pct", 6).alias("locked_pct")
    )


def solana_payloads(spark, d):
    facts = F.concat_ws(
        ",",
        F.when(P() % 5 != 0, F.concat(F.lit('"mintable":{"status":"'), P() % 2, F.lit('"}'))),
        F.when(P() % 3 != 0, F.concat(F.lit('"freezable":{"status":"'), (P() % 3 == 1).cast("int"), F.lit('"}'))),
        F.when(P() % 7 < 2, F.concat(F.lit('"non_transferable":"'), P() % 7, F.lit('"'))),
        F.when(P() % 9 == 0, F.lit('"transfer_hook":[{"address":"h"}]')).otherwise(F.lit('"transfer_hook":[]')),
        F.when(P() % 4 == 0, F.lit('"transfer_fee":{}')).when(P() % 4 == 1, F.lit('"transfer_fee":{"transfer_fee":"0.0625"}')),
        F.when(P() % 6 == 0, F.lit('"creators":[{"address":"cA","malicious_address":1},{"address":"cB","malicious":"0"}]'))
        .when(P() % 6 == 1, F.lit('"creators":["plain"]'))
        .otherwise(F.lit('"creators":[]')),
        F.when(P() % 8 == 0, F.lit('"closable":{"status":"1"}')),
    )
    return I.events(spark, d).where("chain = 'c1'").select(
        "pos", F.concat(F.lit('{"result":{"mint'), P(), F.lit('":{'), facts, F.lit("}}}")).alias("payload")
    )


@register(
    "s19_solana_safety",
    """SELECT pos, 'mint' || pos AS contract, CASE WHEN pos % 7 < 2 OR pos % 9 = 0 THEN pos % 7 = 1 OR pos % 9 = 0 WHEN answered THEN false END
    AS honeypot, CASE WHEN pos % 7 < 2 THEN pos % 7 = 1 WHEN answered THEN false END AS sells_failing,
    CASE WHEN pos % 4 = 1 THEN 6.25::DOUBLE WHEN pos % 4 = 0 AND answered THEN 0.0 END AS buy_tax_pct,
    CASE WHEN pos % 5 <> 0 THEN pos % 2 = 0 END AS mint_revoked, CASE WHEN pos % 3 <> 0 THEN pos % 3 = 1 END AS freeze_active,
    CASE pos % 6 WHEN 0 THEN 'cA' WHEN 1 THEN 'plain' END AS deployer_address, CASE WHEN pos % 6 = 0 THEN 1::BIGINT END AS deployer_prior_rugs,
    concat_ws(',', CASE WHEN pos % 8 = 0 THEN 'closable' END, CASE WHEN pos % 9 = 0 THEN 'transfer_hook' END) AS risk_labels
    FROM (SELECT *, pos % 5 <> 0 OR pos % 3 <> 0 AS answered FROM ev_ WHERE chain = 'c1')""",
)
def s19(spark, d):
    r = reports.solana(solana_payloads(spark, d), ["pos"])
    return r.select(
        "pos", "contract", "honeypot", "sells_failing", "buy_tax_pct", "mint_revoked", "freeze_active",
        "deployer_address", "deployer_prior_rugs", F.array_join("risk_labels", ",").alias("risk_labels"),
    )


def second_payloads(spark, d):
    facts = F.concat_ws(
        ",",
        F.when(P() % 3 == 0, F.lit('"mintAuthority":null')).when(P() % 3 == 1, F.lit('"mintAuthority":"me"')),
        F.when(P() % 4 == 0, F.lit('"freezeAuthority":"me"')).when(P() % 4 == 1, F.lit('"freezeAuthority":null')),
        F.concat(F.lit('"totalMarketLiquidity":'), F.col("value")),
        F.concat(F.lit('"markets":[{"marketType":"amm","lp":{"lpLockedPct":'), F.when(P() % 2 == 0, "99").otherwise("0"), F.lit(',"lpBurned":true}},{"lp":null}]')),
        F.lit('"topHolders":[{"owner":"a","pct":12.5},{"owner":"Raydium pool","pct":50},{"owner":"b","pct":2.25}]'),
        F.when(P() % 5 == 0, F.lit('"risks":[{"name":"Creator history of rugged tokens"},{"name":"Low"}]')).when(P() % 5 == 1, F.lit('"risks":[]')),
        F.when(P() % 6 != 0, F.lit('"creator":"cr"')),
        F.when(P() % 7 == 0, F.lit('"score":12')).when(P() % 7 == 1, F.lit('"rugged":true')),
        F.when(P() % 9 != 0, F.concat(F.lit('"totalHolders":'), P())),
    )
    return I.events(spark, d).where("chain = 'c1'").select(
        "pos", "contract", F.when(P() % 41 == 0, "{}").otherwise(F.concat(F.lit("{"), facts, F.lit("}"))).alias("payload")
    )


@register(
    "s20_second_opinion",
    """SELECT pos, contract, CASE WHEN pos % 3 < 2 THEN pos % 3 = 0 END AS mint_revoked, CASE WHEN pos % 4 < 2 THEN pos % 4 = 0 END
    AS freeze_active, true AS lp_burned, CASE WHEN pos % 2 = 0 THEN 99.0::DOUBLE ELSE 0.0 END AS lp_locked_pct, 14.75::DOUBLE AS top10_ex_lp_pct,
    CASE WHEN pos % 9 <> 0 THEN pos END AS holder_count, CASE WHEN pos % 7 = 1 THEN true END AS rugged,
    CASE WHEN pos % 6 <> 0 THEN 'cr' END AS deployer_address, CASE WHEN pos % 5 = 0 THEN 1::BIGINT WHEN pos % 6 <> 0 AND pos % 7 < 2 THEN 0 END
    AS deployer_prior_rugs, CASE WHEN pos % 5 = 0 THEN 'Creator history of rugged tokens,Low' ELSE '' END AS risk_labels
    FROM ev_ WHERE chain = 'c1' AND pos % 41 <> 0""",
)
def s20(spark, d):
    r = reports.second_opinion(second_payloads(spark, d), ["pos", "contract"])
    return r.select(
        "pos", "contract", "mint_revoked", "freeze_active", "lp_burned", "lp_locked_pct", "top10_ex_lp_pct",
        "holder_count", "rugged", "deployer_address", "deployer_prior_rugs",
        F.array_join("risk_labels", ",").alias("risk_labels"),
    )


@register(
    "s21_deployer_reputation",
    """SELECT pos, CASE WHEN pos % 3 < 2 THEN (pos % 3 = 0 AND pos % 2 = 0)::BIGINT + CASE WHEN pos % 3 = 1 THEN pos % 4 ELSE 0 END END AS prior_rugs,
    CASE WHEN pos % 3 = 0 AND pos % 2 = 0 THEN 'phishing_activities' ELSE '' END AS labels FROM ev_""",
)
def s21(spark, d):
    facts = (
        F.when(P() % 3 == 0, F.concat(F.lit('{"cybercrime":"0","phishing_activities":"'), (P() % 2 == 0).cast("int"), F.lit('"}')))
        .when(P() % 3 == 1, F.concat(F.lit('{"number_of_malicious_contracts_created":"'), P() % 4, F.lit('"}')))
        .otherwise('{"other":"1"}')
    )
    rows = I.events(spark, d).select("pos", F.concat(F.lit('{"result":'), facts, F.lit("}")).alias("payload"))
    r = reports.deployers(rows, ["pos"])
    return r.withColumn("labels", F.array_join("labels", ","))


# --- merges ----------------------------------------------------------------------

_FACTS = (
    "honeypot", "sells_failing", "freeze_active", "upgradeable", "mint_revoked", "lp_burned", "admin_renounced",
    "buy_tax_pct", "sell_tax_pct", "top10_ex_lp_pct", "holder_count", "deployer_prior_rugs", "lp_locked_pct",
)


def _rule(c: str) -> str:
    if c in safety.WORSE_IF_TRUE:
        return f"CASE WHEN a.{c} IS NULL THEN b.{c} WHEN b.{c} IS NULL THEN a.{c} ELSE a.{c} OR b.{c} END AS {c}"
    if c in safety.WORSE_IF_FALSE:
        return f"CASE WHEN a.{c} IS NULL THEN b.{c} WHEN b.{c} IS NULL THEN a.{c} ELSE a.{c} AND b.{c} END AS {c}"
    return f"{'least' if c in safety.WORSE_IF_SMALL else 'greatest'}(a.{c}, b.{c}) AS {c}"


def also_alone(rows, mark: str):
    """All rows, and each once more under a token that no other table has."""
    return rows.unionByName(rows.withColumn("contract", F.concat("contract", F.lit(mark))))


@register(
    "j11_merge_safety",
    f"""SELECT chain, contract, CASE WHEN a.contract IS NULL THEN b.source WHEN b.contract IS NULL THEN a.source ELSE
    a.source || '+' || b.source END AS source, greatest(a.collected_at_ms, b.collected_at_ms) AS collected_at_ms,
    coalesce(a.deployer_address, b.deployer_address) AS deployer_address, {', '.join(_rule(c) for c in _FACTS)}
    FROM (SELECT * FROM safety0_ UNION ALL SELECT * REPLACE (contract || '-a' AS contract) FROM safety0_) a
    FULL JOIN (SELECT * FROM safety3_ UNION ALL SELECT * REPLACE (contract || '-b' AS contract) FROM safety3_) b USING (chain, contract)""",
)
def j11(spark, d):
    a = also_alone(I.safety(spark, d, 0), "-a").withColumn("source_order", F.lit(0))
    b = also_alone(I.safety(spark, d, 3), "-b").withColumn("source_order", F.lit(1))
    m = safety.merge(a.unionByName(b), I.TOKEN)
    return m.select(*I.TOKEN, "source", "collected_at_ms", "deployer_address", *_FACTS)


@register(
    "u06_union_labels",
    """SELECT contract, array_to_string(list_sort(list_distinct(['a' || (user_id % 3), 'b', 'a' || (user_id % 5), 'c' || (user_id % 2)])), ',') AS labels
    FROM safety0_""",
)
def u06(spark, d):
    base = I.safety(spark, d).select(*I.TOKEN, "user_id", "source", "collected_at_ms")
    a = F.array(F.concat(F.lit("a"), U() % 3), F.lit("b"))
    b = F.array(F.concat(F.lit("a"), U() % 5), F.concat(F.lit("c"), U() % 2))
    both = base.withColumn("risk_labels", a).unionByName(base.withColumn("risk_labels", b))
    m = safety.merge(both.withColumn("source_order", F.lit(0)), I.TOKEN)
    return m.select("contract", F.array_join("risk_labels", ",").alias("labels"))


@register(
    "j12_deployer_history",
    """SELECT chain, contract, CASE WHEN chain IN ('c0', 'c2') AND deployer_address IS NOT NULL AND k % 3 <> 0 THEN k ELSE deployer_prior_rugs END
    AS deployer_prior_rugs FROM (SELECT *, substr(deployer_address, 2)::BIGINT AS k FROM safety0_)""",
)
def j12(spark, d):
    r = I.safety(spark, d).withColumn("risk_labels", F.array().cast("array<string>"))
    keyed = safety.deployer_keys(r, ["c0", "c2"])
    number_ = F.substring("deployer_key", 2, 9).cast("bigint")
    history = (
        keyed.where("deployer_key is not null")
        .select("chain", "deployer_key")
        .distinct()
        .select(
            "chain",
            "deployer_key",
            F.when(number_ % 3 != 0, number_).alias("prior_rugs"),
            F.array(F.lit("fake_token")).alias("labels"),
        )
    )
    return safety.attach_history(keyed, history).select("chain", "contract", "deployer_prior_rugs")


@register(
    "o06_busiest_deployers",
    """SELECT chain, deployer_address AS deployer_key, count(*) AS tokens FROM safety0_ WHERE chain IN ('c0', 'c2') AND deployer_address IS NOT NULL
    GROUP BY 1, 2 ORDER BY tokens DESC, 1, 2 LIMIT 10""",
)
def o06(spark, d):
    return safety.busiest_deployers(safety.deployer_keys(I.safety(spark, d), ["c0", "c2"]), 10)


@register(
    "o06_all_deployers",
    """SELECT chain, deployer_address AS deployer_key, count(*) AS tokens FROM safety0_ WHERE chain IN ('c0', 'c2') AND deployer_address IS NOT NULL
    GROUP BY 1, 2""",
)
def o06_all(spark, d):
    return safety.busiest_deployers(safety.deployer_keys(I.safety(spark, d), ["c0", "c2"]), None)


@register(
    "j18_safety_with_snapshot",
    """SELECT f.chain, f.contract, s.snapshot_id FROM (SELECT chain, contract FROM safety0_ UNION ALL SELECT chain, contract || '-x' FROM safety0_) f
    LEFT JOIN snap_ s USING (chain, contract)""",
)
def j18(spark, d):
    read = also_alone(I.safety(spark, d).select(*I.TOKEN), "-x")
    return safety.with_snapshot(read, I.snapshots(spark, d), I.TOKEN)


@register(
    "j02_latest_safety",
    """SELECT chain, contract, source, collected_at_ms, honeypot FROM (SELECT * FROM safety0_ UNION ALL SELECT * FROM safety3_)
    QUALIFY row_number() OVER (PARTITION BY chain, contract ORDER BY collected_at_ms DESC, source DESC) = 1""",
)
def j02(spark, d):
    from tidewatch.operators import keys

    rows = I.safety(spark, d, 0).unionByName(I.safety(spark, d, 3))
    return keys.latest(rows, I.TOKEN, ["collected_at_ms", "source"]).select(
        *I.TOKEN, "source", "collected_at_ms", "honeypot"
    )


@register(
    "p22_stale_safety",
    f"""SELECT s.snapshot_id FROM snapx_ s LEFT JOIN safety0_ f USING (chain, contract)
    WHERE {I.AS_OF_LATE} - s.ts <= 10080 * 60000 AND (f.contract IS NULL OR {I.AS_OF_LATE} - f.collected_at_ms >= 21600000)""",
)
def p22(spark, d):
    from tidewatch.plans import scoring

    snaps = I.snapshots(spark, d).select("snapshot_id", *I.TOKEN, "ts")
    unread = snaps.withColumns({c: F.concat(c, F.lit("-x")) for c in ("snapshot_id", "contract")})
    return scoring.stale(snaps.unionByName(unread), I.safety(spark, d), I.AS_OF_LATE).select("snapshot_id")


# --- posts, previews, candles -----------------------------------------------------


@register(
    "a08_mention_counts",
    """SELECT conv_id, count(*) AS mentions_window, count(DISTINCT role) AS unique_authors, nullif(sum(length(text) * 1000)::DOUBLE, 0)
    AS follower_weighted_reach, count(*) FILTER (length(text) * 1000 >= 100000 AND turn % 3 > 0) AS tier1_organic_engagements,
    count(*) FILTER (turn > 0) AS replies, count(*) FILTER (turn = 0) AS posts FROM conversations GROUP BY 1""",
)
def a08(spark, d):
    rows = I.read(spark, d, "conversations").select(
        "conv_id",
        F.col("role").alias("author_id"),
        F.nullif(F.length("text") * 1000.0, F.lit(0.0)).alias("followers"),
        (F.col("turn") % 3).alias("likes"),
        F.lit(None).cast("bigint").alias("reposts"),
        (F.col("turn") > 0).alias("is_reply"),
    )
    return posts.counts(rows, ["conv_id"])


@register(
    "s22_search_payloads",
    """SELECT conv_id, turn, 2::BIGINT AS mentions_window, CASE WHEN length(text) > 0 THEN 1 ELSE 1 END::BIGINT AS unique_authors,
    nullif((length(text) * 1000 * 2)::DOUBLE, 0) AS follower_weighted_reach,
    CASE WHEN length(text) * 1000 >= 100000 THEN 1 + (turn % 2) ELSE 0 END AS tier1_organic_engagements,
    1::BIGINT AS replies, 1::BIGINT AS posts FROM conversations""",
)
def s22(spark, d):
    turn = F.col("turn")
    body = F.concat(
        F.lit('{"data":[{"author_id":"'), F.col("role"), F.lit('","public_metrics":{"like_count":1},"referenced_tweets":[{"type":"replied_to"}]},'),
        F.lit('{"author_id":"'), F.col("role"), F.lit('","public_metrics":{"like_count":0,"retweet_count":'), turn % 2,
        F.lit('}}],"includes":{"users":[{"id":"'), F.col("role"), F.lit('","public_metrics":{"followers_count":'),
        F.length("text") * 1000, F.lit("}}]}}"),
    )
    rows = I.read(spark, d, "conversations").select("conv_id", "turn", body.alias("payload"))
    return posts.searches(rows, ["conv_id", "turn"])


@register(
    "s23_channel_preview",
    """SELECT page_id, page_id % 3 > 0 AS "exists", CASE WHEN page_id % 3 > 0 AND page_id % 4 > 0 THEN 12000 + page_id END AS members,
    CASE WHEN page_id % 3 > 0 THEN 1 + page_id END AS online FROM pages""",
)
def s23(spark, d):
    pid = F.col("page_id")
    shown = F.concat(F.lit('<div class="tgme_page_extra">'), F.when(pid % 4 > 0, F.concat(F.format_number(12000 + pid, 0), F.lit(" members, "))).otherwise(""), pid + 1, F.lit(" online</div>"))
    page = F.when(pid % 3 > 0, F.concat(F.regexp_replace("html", "(?i)members|subscribers|online", ""), shown)).otherwise(
        F.regexp_replace("html", "tgme_", "")
    )
    return I.read(spark, d, "pages").select("page_id", text.preview(page).alias("p")).select(
        "page_id", "p.exists", "p.members", "p.online"
    )


@register(
    "f09_link_kinds",
    """SELECT pos, pos % 4 = 0 AS telegram, pos % 4 = 1 OR pos % 4 = 2 AS x, true AS website,
    CASE WHEN pos % 4 = 0 THEN 'https://T.me/r' || pos END AS telegram_url, CASE WHEN pos % 4 = 1 THEN 'https://x.com/' || pos
    WHEN pos % 4 = 2 THEN 'https://other.example' END AS x_url FROM ev_""",
)
def f09(spark, d):
    m = P() % 4
    link = (
        F.when(m == 0, F.concat(F.lit("https://T.me/r"), P()))
        .when(m == 1, F.to_json(F.struct(F.concat(F.lit("https://x.com/"), P()).alias("url"))))
        .when(m == 2, F.lit('{"type":"twitter","url":"https://other.example"}'))
        .otherwise("ftp://nothing")
    )
    items = text.link_items(F.array(link, F.lit("http://plain.example"), F.lit(None).cast("string")))
    i = F.col("_i")
    return I.events(spark, d).withColumn("_i", items).select(
        "pos",
        text.declares(i, "telegram").alias("telegram"),
        text.declares(i, "x").alias("x"),
        text.declares(i, "website").alias("website"),
        text.first_url(i, "telegram").alias("telegram_url"),
        text.first_url(i, "x").alias("x_url"),
    )


@register(
    "f10_handles",
    """SELECT pos, CASE pos % 5 WHEN 0 THEN 'chan' || pos WHEN 1 THEN 'user_' || pos WHEN 2 THEN 'bare' || pos END AS handle FROM ev_""",
)
def f10(spark, d):
    m = P() % 5
    raw = (
        F.when(m == 0, F.concat(F.lit("https://t.me/chan"), P(), F.lit("?x=1")))
        .when(m == 1, F.concat(F.lit("join @user_"), P()))
        .when(m == 2, F.concat(F.lit("  @bare"), P(), F.lit(" ")))
        .when(m == 3, F.lit("a b"))
    )
    return I.events(spark, d).select("pos", text.handle(raw).alias("handle"))


@register(
    "f11_search_query",
    """SELECT pos, CASE pos % 4 WHEN 0 THEN '($T' || pos || ' OR ' || contract || ') -is:retweet' WHEN 1 THEN '($S' || pos || ') -is:retweet'
    WHEN 2 THEN '(' || contract || ') -is:retweet' END AS query FROM ev_""",
)
def f11(spark, d):
    m = P() % 4
    ticker = F.when(m == 0, F.concat(F.lit("T"), P())).when(m == 1, F.concat(F.lit("$S"), P()))
    contract = F.when(m.isin(0, 2), F.col("contract"))
    return I.events(spark, d).select("pos", text.search_query(ticker, contract).alias("query"))


@register(
    "f12_page_url",
    """SELECT pos, CASE user_id % 4 WHEN 3 THEN NULL ELSE 'https://pages.example/' || ['solana', 'bsc', 'ethereum'][user_id % 4 + 1]
    || '/' || contract END AS url FROM ev_""",
)
def f12(spark, d):
    names = F.array(F.lit("sol"), F.lit("bnb"), F.lit("ETH"), F.lit("robinhood"))
    chain = F.element_at(names, (U() % 4 + 1).cast("int"))
    return I.events(spark, d).select(
        "pos", chains.page_url(chain, F.col("contract"), "https://pages.example").alias("url")
    )


@register(
    "f07_canonical_chain",
    """SELECT pos, ['bnb', 'ethereum', 'my-chain-' || (pos % 3), 'polygon', 'robinhood'][pos % 5 + 1] AS chain,
    ['BNB Chain', 'Ethereum', 'my-chain-' || (pos % 3), 'Polygon', 'Robinhood Chain'][pos % 5 + 1] AS label,
    CASE WHEN pos % 5 <> 2 THEN true END AS evm FROM ev_""",
)
def f07(spark, d):
    raw = F.element_at(
        F.array(F.lit(" BSC "), F.lit("Mainnet"), F.concat(F.lit("My  Chain_"), P() % 3), F.lit("matic"), F.lit("robinhood chain")),
        (P() % 5 + 1).cast("int"),
    )
    return I.events(spark, d).select(
        "pos", chains.canonical(raw).alias("chain"), chains.label(raw).alias("label"), chains.is_evm(raw).alias("evm")
    )


@register(
    "f08_chain_overrides",
    """SELECT chain, ['s-nine', NULL, NULL, NULL][user_id % 4 + 1] AS source_id, user_id % 4 = 0 AS offered, count(*) AS n FROM ev_ GROUP BY 1, 2, 3""",
)
def f08(spark, d):
    bound = chains.bound_sources(spark, "c0=s-nine, broken, =x,", ())
    return (
        I.events(spark, d)
        .select("chain")
        .join(bound.select(F.col("name").alias("chain"), "source_id", "offered"), "chain", "left")
        .groupBy("chain", "source_id", F.coalesce("offered", F.lit(False)).alias("offered"))
        .agg(F.count("*").alias("n"))
    )


@register("p21_requested_chains", "SELECT chain, count(*) AS n FROM ev_ WHERE chain IN ('c0', 'c2') GROUP BY 1")
def p21(spark, d):
    rows = chains.requested(I.events(spark, d), ["C0", "s2"], registry=I.STAND_IN_CHAINS)
    return rows.groupBy("chain").agg(F.count("*").alias("n"))


@register("s24_candle_payloads", "SELECT coin, t, o, h, l, c, CASE WHEN (t // 14400000) % 5 <> 0 THEN v END AS v FROM candle_")
def s24(spark, d):
    c = I.candles(spark, d)
    bar = F.struct(
        "t", *[s(F.col(k)).alias(k) for k in "ohlc"],
        F.when((F.col("t") / 14_400_000) % 5 == 0, "NaN").otherwise(s(F.col("v"))).alias("v"),
    )
    rows = c.select("coin", F.concat(F.lit("["), F.to_json(bar), F.lit(',{"o":"1"}]')).alias("payload"))
    return bars.candles(rows, ["coin"])


def contexts(spark, d):
    """One [meta, contexts] payload per day, one asset per event type."""
    per = (
        I.events(spark, d)
        .groupBy(F.floor(F.col("observed_at_ms") / I.DAY).cast("bigint").alias("day"), "event_type")
        .agg(F.count("*").alias("n"), F.max_by("value", F.struct("observed_at_ms", "pos")).alias("px"))
    )
    name = F.col("event_type")
    meta = F.concat(F.lit('{"universe":[{"name":"'), name, F.lit('"},{"name":"gone","isDelisted":true}]}'))
    ctx = F.concat(
        F.lit('[{"markPx":"'), F.col("px"), F.lit('","dayNtlVlm":"'), F.col("n"), F.lit('","openInterest":"'), F.col("n") * 2,
        F.lit('","funding":"0.00125","impactPxs":["'), F.col("px") - 0.25, F.lit('","'), F.col("px") + 0.25, F.lit('"]},{"markPx":"1"}]'),
    )
    rows = per.select("day", F.concat(F.lit("["), meta, F.lit(","), ctx, F.lit("]")).alias("payload"))
    return bars.contexts(rows, ["day"])


define(
    "ctx_",
    f"""SELECT observed_at_ms // {I.DAY} AS day, event_type AS coin, arg_max(value, (observed_at_ms, pos)) AS mark_px,
  count(*)::DOUBLE AS day_ntl_vlm, count(*) * 2.0::DOUBLE AS open_interest FROM ev_ GROUP BY 1, 2""",
)


@register("s25_asset_contexts", "SELECT *, 0.00125::DOUBLE AS funding, mark_px - 0.25 AS impact_bid, mark_px + 0.25 AS impact_ask FROM ctx_")
def s25(spark, d):
    return contexts(spark, d).drop("prev_day_px")


@register(
    "f18_context_measures",
    """SELECT day, coin, round(open_interest * mark_px, 6) AS oi_usd, round(((mark_px + 0.25) - (mark_px - 0.25)) / mark_px * 10000, 6) AS impact_bps FROM ctx_""",
)
def f18(spark, d):
    return contexts(spark, d).select(
        "day", "coin", F.round(bars.open_interest_usd(), 6).alias("oi_usd"), F.round(bars.impact_spread_bps(), 6).alias("impact_bps")
    )


@register(
    "o05_top_by_notional",
    """SELECT day, coin, day_ntl_vlm FROM ctx_ WHERE day_ntl_vlm IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY day ORDER BY day_ntl_vlm DESC, coin) <= 3""",
)
def o05(spark, d):
    from tidewatch.plans import rotation

    return rotation.choose_names(contexts(spark, d), 3, ["day"]).select("day", "coin", "day_ntl_vlm")


# --- scalar parsing ----------------------------------------------------------------


@register(
    "f02_number_parse",
    """SELECT pos, CASE pos % 6 WHEN 0 THEN value WHEN 1 THEN (pos % 100) * 100.0::DOUBLE END AS as_number,
    CASE pos % 6 WHEN 0 THEN trunc(value)::BIGINT WHEN 1 THEN pos % 100 * 100 END AS as_whole FROM ev_""",
)
def f02(spark, d):
    from tidewatch.functions.values import whole

    m = P() % 6
    raw = (
        F.when(m == 0, F.concat(F.lit(" "), F.col("value")))
        .when(m == 1, F.concat(P() % 100, F.lit("e2")))
        .when(m == 2, "NaN")
        .when(m == 3, "-Infinity")
        .when(m == 4, "true")
    )
    return I.events(spark, d).select("pos", number(raw).alias("as_number"), whole(raw).alias("as_whole"))


@register(
    "f03_to_ms",
    """SELECT pos, CASE pos % 4 WHEN 3 THEN NULL ELSE observed_at_ms // 1000 * 1000 - CASE WHEN pos % 4 = 2 THEN 7200000 ELSE 0 END END AS ms FROM ev_""",
)
def f03(spark, d):
    from tidewatch.functions.values import to_ms

    base = F.date_format(F.timestamp_millis("observed_at_ms"), "yyyy-MM-dd'T'HH:mm:ss")
    m = P() % 4
    raw = F.when(m == 0, F.concat(base, F.lit("Z"))).when(m == 1, base).when(m == 2, F.concat(base, F.lit("+02:00"))).otherwise("soon")
    return I.events(spark, d).select("pos", to_ms(raw).alias("ms"))


@register(
    "f01_f04_clean_and_positive",
    """SELECT pos, CASE WHEN pos % 5 > 1 THEN value * (pos % 3 - 1) END AS clean, CASE WHEN pos % 5 > 1 AND pos % 3 > 0 AND value * (pos % 3 - 1) >= 0
    THEN value * (pos % 3 - 1) WHEN pos % 5 > 1 AND pos % 3 = 1 THEN 0.0 END AS non_negative,
    CASE WHEN pos % 5 > 1 AND value * (pos % 3 - 1) > 0 THEN value * (pos % 3 - 1) END AS positive FROM ev_""",
)
def f01(spark, d):
    from tidewatch.functions.values import clean, non_negative, positive

    x = F.when(P() % 5 == 0, float("nan")).when(P() % 5 == 1, float("inf")).otherwise(F.col("value") * (P() % 3 - 1))
    return I.events(spark, d).withColumn("x", x).select(
        "pos", clean("x").alias("clean"), non_negative("x").alias("non_negative"), positive("x").alias("positive")
    )


@register(
    "f05_f06_flag_and_percent",
    """SELECT pos, CASE pos % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true END AS flag,
    CASE WHEN pos % 4 > 0 THEN (pos % 64) / 64.0::DOUBLE * 100.0 END AS pct FROM ev_""",
)
def f05(spark, d):
    from tidewatch.functions.values import flag, percent

    m = P() % 4
    raw = F.when(m == 0, " 1").when(m == 1, "No").when(m == 2, "TRUE").otherwise("maybe")
    frac = F.when(m > 0, s(P() % 64 / 64)).otherwise("x")
    return I.events(spark, d).select("pos", flag(raw).alias("flag"), percent(frac).alias("pct"))


@register(
    "f20_json_cells",
    """SELECT pos, CASE WHEN pos % 3 = 0 THEN '' ELSE 'k,' || regexp_extract(props, '[0-9]+') END AS cell, CASE WHEN pos % 3 <> 0 THEN
    regexp_extract(props, '[0-9]+')::BIGINT END AS k FROM ev_""",
)
def f20(spark, d):
    from tidewatch.sources.journal import json_cell

    k = F.get_json_object("props", "$.k")
    raw = F.when(P() % 3 == 0, "[broken").otherwise(F.concat(F.lit('["k","'), k, F.lit('"]')))
    cell = json_cell(raw, "array<string>", F.array().cast("array<string>"))
    return I.events(spark, d).select(
        "pos", F.array_join(cell, ",").alias("cell"), F.get(cell, F.lit(1)).try_cast("bigint").alias("k")
    )


@register(
    "j19_posts_with_authors",
    """SELECT c.conv_id, c.turn, a.posts AS author_posts FROM conversations c LEFT JOIN (SELECT role, count(*) AS posts FROM conversations
    WHERE role <> 'system' GROUP BY 1) a USING (role)""",
)
def j19(spark, d):
    rows = I.read(spark, d, "conversations")
    authors = rows.where("role <> 'system'").groupBy("role").agg(F.count("*").alias("author_posts"))
    return rows.select("conv_id", "turn", "role").join(authors, "role", "left").drop("role")
