"""Safety-report payloads to typed safety rows. Absent and "no" are kept apart throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import text
from tidewatch.functions.values import flag, number, percent, whole
from tidewatch.operators import safety

# Risk flags of the EVM report and of the deployer report.
EVM_RISKS = (
    "is_blacklisted", "is_whitelisted", "hidden_owner", "selfdestruct", "external_call",
    "trading_cooldown", "personal_slippage_modifiable", "slippage_modifiable",
    "transfer_pausable", "anti_whale_modifiable",
)
DEPLOYER_FLAGS = (
    "honeypot_related_address", "phishing_activities", "financial_crime", "stealing_attack",
    "blackmail_activities", "fake_token", "cybercrime",
)
SOLANA_RISKS = ("closable", "metadata_mutable", "balance_mutable_authority")


def _get(name: str) -> Column:
    return F.try_element_at("facts", F.lit(name))


def _has(name: str) -> Column:
    return F.map_contains_key("facts", F.lit(name))


def _filled(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _by_token(payloads: DataFrame, payload: str, keep: list[str]) -> DataFrame:
    """One row per (payload, token): the token's facts as a map of raw values."""
    parsed = F.from_json(payload, "struct<result:map<string,map<string,string>>>")["result"]
    return payloads.select(*keep, F.explode(parsed).alias("contract", "facts")).where("facts is not null")


def _named(flags: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(c.eqNullSafe(True), F.lit(n)) for n, c in flags.items()]))


def evm(payloads: DataFrame, keep: list[str], payload: str = "payload") -> DataFrame:
    """EVM token report; ``keep`` carries chain, collection time and the like."""
    rows = _by_token(payloads, payload, keep)
    lp = safety.lp_state(F.from_json(_get("lp_holders"), safety.HOLDERS))
    owner = F.lower(F.trim(F.coalesce(_get("owner_address"), F.lit(""))))
    gone = (owner == "") | safety.burned(owner, F.lit(None).cast("string"))
    takes_back = F.coalesce(flag(_get("can_take_back_ownership")), F.lit(False))
    return rows.withColumn("_lp", lp).select(
        *keep,
        F.lower("contract").alias("contract"),
        F.lit("goplus").alias("source"),
        flag(_get("is_honeypot")).alias("honeypot"),
        flag(_get("cannot_sell_all")).alias("sells_failing"),
        percent(_get("buy_tax")).alias("buy_tax_pct"),
        percent(_get("sell_tax")).alias("sell_tax_pct"),
        (~flag(_get("is_mintable"))).alias("mint_revoked"),
        flag(_get("transfer_pausable")).alias("freeze_active"),
        F.col("_lp.burned").alias("lp_burned"),
        F.col("_lp.locked_pct").alias("lp_locked_pct"),
        safety.top10_ex_lp(F.from_json(_get("holders"), safety.HOLDERS)).alias("top10_ex_lp_pct"),
        whole(_get("holder_count")).alias("holder_count"),
        flag(_get("is_proxy")).alias("upgradeable"),
        F.when(_has("owner_address"), gone & ~takes_back).alias("admin_renounced"),
        F.coalesce(_filled(_get("creator_address")), _filled(_get("owner_address"))).alias("deployer_address"),
        _named({n: flag(_get(n)) for n in EVM_RISKS}).alias("risk_labels"),
        text.seen_fields(F.col("facts"), "goplus").alias("source_fields"),
    )


def solana(payloads: DataFrame, keep: list[str], payload: str = "payload") -> DataFrame:
    """Solana token report: what blocks a transfer, the transfer fee and the creators' record."""

    def status(name: str) -> Column:
        return flag(F.get_json_object(_get(name), "$.status"))

    rows = _by_token(payloads, payload, keep).withColumns(
        {
            "_lp": safety.lp_state(F.from_json(_get("lp_holders"), safety.HOLDERS)),
            "_mint": status("mintable"),
            "_freeze": status("freezable"),
            "_stuck": flag(_get("non_transferable")),
            "_hook": F.coalesce(~F.trim(_get("transfer_hook")).isin("", "[]", "{}", "0", "false", "null"), F.lit(False)),
            "_fee": F.when(F.trim(_get("transfer_fee")).startswith("{"), F.trim(_get("transfer_fee"))),
            "_creators": F.from_json(_get("creators"), "array<string>"),
        }
    )
    answered = F.col("_mint").isNotNull() | F.col("_freeze").isNotNull()
    stuck, hook, fee = F.col("_stuck"), F.col("_hook"), F.col("_fee")

    def creator(e: Column) -> Column:
        is_object = F.trim(e).startswith("{")
        bad = F.coalesce(
            flag(F.get_json_object(e, "$.malicious_address")), flag(F.get_json_object(e, "$.malicious"))
        )
        return F.struct(
            F.when(is_object, _filled(F.get_json_object(e, "$.address"))).otherwise(e).alias("address"),
            F.when(is_object, bad).alias("bad"),
        )

    creators = F.transform("_creators", creator)
    verdicts = F.filter(F.transform(creators, lambda c: c["bad"]), lambda b: b.isNotNull())
    fee_pct = F.when(
        F.size(F.json_object_keys(fee)) > 0,
        F.coalesce(
            number(F.get_json_object(fee, "$.transfer_fee_percent")),
            percent(F.get_json_object(fee, "$.transfer_fee")),
        ),
    ).when(fee.isNotNull() & answered, 0.0)
    return rows.select(
        *keep,
        "contract",
        F.lit("goplus").alias("source"),
        F.when(stuck.isNotNull() | hook, F.coalesce(stuck, F.lit(False)) | hook)
        .when(answered, False)
        .alias("honeypot"),
        F.coalesce(stuck, F.when(answered, False)).alias("sells_failing"),
        fee_pct.alias("buy_tax_pct"),
        fee_pct.alias("sell_tax_pct"),
        (~F.col("_mint")).alias("mint_revoked"),
        F.col("_freeze").alias("freeze_active"),
        F.col("_lp.burned").alias("lp_burned"),
        F.col("_lp.locked_pct").alias("lp_locked_pct"),
        safety.top10_ex_lp(F.from_json(_get("holders"), safety.HOLDERS)).alias("top10_ex_lp_pct"),
        F.get(F.filter(F.transform(creators, lambda c: c["address"]), lambda a: a.isNotNull()), F.lit(0)).alias(
            "deployer_address"
        ),
        F.when(F.size(verdicts) > 0, F.size(F.filter(verdicts, lambda b: b)))
        .cast("bigint")
        .alias("deployer_prior_rugs"),
        F.array_compact(
            F.array(
                *[F.when(status(n).eqNullSafe(True), F.lit(n)) for n in SOLANA_RISKS],
                F.when(hook, F.lit("transfer_hook")),
            )
        ).alias("risk_labels"),
        text.seen_fields(F.col("facts"), "goplus").alias("source_fields"),
    )


def second_opinion(payloads: DataFrame, keep: list[str], payload: str = "payload") -> DataFrame:
    """Second-opinion report of one token per payload; ``keep`` carries the contract."""
    market = (
        "array<struct<marketType:string,marketTypeName:string,"
        "lp:struct<lpLockedPct:string,lpBurned:string,lpLockedUSD:string>>>"
    )
    rows = payloads.select(*keep, F.from_json(payload, "map<string,string>").alias("facts")).where(
        F.size("facts") > 0
    )
    pools = F.transform(
        F.filter(F.from_json(_get("markets"), market), lambda m: m["lp"].isNotNull()),
        lambda m: F.struct(
            F.coalesce(_filled(m["marketType"]), _filled(m["marketTypeName"])).alias("market"),
            number(m["lp"]["lpLockedPct"]).alias("locked_pct"),
            flag(m["lp"]["lpBurned"]).alias("burned"),
            number(m["lp"]["lpLockedUSD"]).alias("locked_usd"),
        ),
    )
    holders = F.from_json(_get("topHolders"), "array<struct<owner:string,pct:string>>")
    shares = F.transform(
        F.filter(holders, lambda h: h.isNotNull() & ~safety.not_a_holder(h["owner"])), lambda h: number(h["pct"])
    )
    risks = F.filter(
        F.transform(F.from_json(_get("risks"), "array<struct<name:string>>"), lambda r: r["name"]),
        lambda n: n.isNotNull() & (n != ""),
    )
    rows = rows.withColumns(
        {
            "_markets": pools,
            "_total": number(_get("totalMarketLiquidity")),
            "_risks": F.coalesce(risks, F.array().cast("array<string>")),
            "_creator": F.coalesce(_filled(_get("creator")), _filled(_get("creatorAddress"))),
            "_rugged": F.when(_get("rugged").isin("true", "false"), _get("rugged") == "true"),
        }
    ).withColumn("_lock", safety.pool_lock(F.col("_markets"), F.col("_total")))

    def authority(name: str) -> Column:
        return F.when(_has(name), F.coalesce(_get(name), F.lit("")) != "")

    named = F.exists(
        "_risks",
        lambda n: F.lower(n).contains("creator") & (F.lower(n).contains("rug") | F.lower(n).contains("history")),
    )
    evaluated = (
        number(_get("score")).isNotNull()
        | number(_get("score_normalised")).isNotNull()
        | F.col("_rugged").isNotNull()
        | F.coalesce(F.trim(_get("creatorTokens")).startswith("["), F.lit(False))
    )
    return rows.select(
        *keep,
        F.lit("rugcheck").alias("source"),
        (~authority("mintAuthority")).alias("mint_revoked"),
        authority("freezeAuthority").alias("freeze_active"),
        F.col("_lock.burned").alias("lp_burned"),
        F.col("_lock.locked_pct").alias("lp_locked_pct"),
        F.col("_markets").alias("lp_markets"),
        F.col("_total").alias("lp_total_usd"),
        safety.top_holders(shares).alias("top10_ex_lp_pct"),
        whole(_get("totalHolders")).alias("holder_count"),
        F.col("_rugged").alias("rugged"),
        F.col("_creator").alias("deployer_address"),
        F.when(named, 1)
        .when(F.col("_creator").isNotNull() & evaluated, 0)
        .cast("bigint")
        .alias("deployer_prior_rugs"),
        F.col("_risks").alias("risk_labels"),
        text.seen_fields(F.col("facts"), "rugcheck").alias("source_fields"),
    )


def deployers(payloads: DataFrame, keep: list[str], payload: str = "payload") -> DataFrame:
    """Deployer report to prior_rugs and labels; null when no question was answered."""
    rows = payloads.select(
        *keep, F.from_json(payload, "struct<result:map<string,string>>")["result"].alias("facts")
    )
    hits = _named({n: flag(_get(n)) for n in DEPLOYER_FLAGS})
    created = number(_get("number_of_malicious_contracts_created"))
    answered = created.isNotNull()
    for n in DEPLOYER_FLAGS:
        answered = answered | F.coalesce(_has(n), F.lit(False))
    extra = F.when(created > 0, created.cast("bigint")).otherwise(0)
    return rows.select(
        *keep,
        F.when(answered, F.size(hits) + extra).cast("bigint").alias("prior_rugs"),
        F.when(answered, hits).otherwise(F.array().cast("array<string>")).alias("labels"),
    )
