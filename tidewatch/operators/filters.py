"""Eight hard filters. Each answers pass, reject or unknown; unknown is not clean."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import chains

# Filter thresholds.
TAX_MAX_PCT = 5.0
LOCK_MIN_DAYS = 30
LOCK_MIN_PCT = 95.0
TOP10_MAX_PCT = 35.0
LIQUIDITY_MIN_PCT = 2.0
DAY_MS = 86_400_000

PASS, REJECT, UNKNOWN = "pass", "reject", "unknown"

# Input columns of every filter; a column the caller lacks is unknown.
INPUTS = {
    "chain": "string",
    "evaluated_at_ms": "bigint",
    "honeypot": "boolean",
    "sells_failing": "boolean",
    "buy_tax_pct": "double",
    "sell_tax_pct": "double",
    "mint_revoked": "boolean",
    "freeze_active": "boolean",
    "lp_burned": "boolean",
    "lp_locked_until_ms": "bigint",
    "lp_locked_pct": "double",
    "top10_ex_lp_pct": "double",
    "liquidity_usd": "double",
    "fdv_usd": "double",
    "mcap_usd": "double",
    "deployer_prior_rugs": "bigint",
    "upgradeable": "boolean",
    "admin_renounced": "boolean",
}
# Safety facts that, when measured, replace the snapshot's own value.
SAFETY_FIELDS = (
    "honeypot", "sells_failing", "buy_tax_pct", "sell_tax_pct", "mint_revoked", "freeze_active",
    "lp_burned", "top10_ex_lp_pct", "lp_locked_pct", "upgradeable", "admin_renounced",
    "deployer_prior_rugs",
)


def _answer(outcome: str, reason: Column | str) -> Column:
    reason = F.lit(reason) if isinstance(reason, str) else reason
    return F.struct(F.lit(outcome).alias("outcome"), reason.alias("reason"))


def _ok(reason):
    return _answer(PASS, reason)


def _no(reason):
    return _answer(REJECT, reason)


def _dunno(what: Column | str) -> Column:
    what = F.lit(what) if isinstance(what, str) else what
    return _answer(UNKNOWN, F.concat(what, F.lit(" unknown; unknown is not clean")))


def _say(fmt: str, *args) -> Column:
    return F.format_string(fmt, *args)


def sellability() -> Column:
    def tax(side: str) -> Column:
        c = F.col(f"{side}_tax_pct")
        return c > TAX_MAX_PCT, _no(_say(f"{side} tax %.2f%% > {TAX_MAX_PCT}%%", c))

    return (
        F.when(F.col("honeypot"), _no("honeypot detected"))
        .when(F.col("sells_failing"), _no("sells are failing"))
        .when(*tax("buy"))
        .when(*tax("sell"))
        .when(F.col("honeypot").isNull() | F.col("sells_failing").isNull(), _dunno("sellability"))
        .when(F.col("buy_tax_pct").isNull() | F.col("sell_tax_pct").isNull(), _dunno("transfer tax"))
        .otherwise(_ok("sellable, taxes within limit"))
    )


def mint_authority() -> Column:
    c = F.col("mint_revoked")
    return (
        F.when(c.isNull(), _dunno("mint authority"))
        .when(c, _ok("mint authority revoked"))
        .otherwise(_no("mint authority still active"))
    )


def freeze_authority() -> Column:
    c = F.col("freeze_active")
    return (
        F.when(c.isNull(), _dunno("freeze authority"))
        .when(c, _no("freeze authority active"))
        .otherwise(_ok("freeze authority inactive"))
    )


def liquidity_lock() -> Column:
    until, pct = F.col("lp_locked_until_ms"), F.col("lp_locked_pct")
    days = (until - F.col("evaluated_at_ms")) / DAY_MS
    return (
        F.when(F.col("lp_burned"), _ok("LP burned"))
        .when(until.isNotNull() & F.col("evaluated_at_ms").isNull(), _dunno("evaluation time"))
        .when(days < LOCK_MIN_DAYS, _no(_say(f"LP lock expires in %.1fd < {LOCK_MIN_DAYS}d", days)))
        .when(until.isNotNull(), _ok(_say("LP locked for %.0fd", days)))
        .when(
            pct >= LOCK_MIN_PCT,
            _ok(
                _say(
                    "%.0f%% of LP locked or burned; expiry not reported by any available source",
                    pct,
                )
            ),
        )
        .when(pct <= 0, _no("no LP locked or burned"))
        .when(
            pct.isNotNull(),
            _dunno(
                _say(
                    f"only %.0f%% of LP locked, under the {LOCK_MIN_PCT:.0f}%% needed without an "
                    "expiry; lock duration",
                    pct,
                )
            ),
        )
        .when(~F.col("lp_burned"), _no("LP neither burned nor locked"))
        .otherwise(_dunno("LP burn and lock status"))
    )


def concentration() -> Column:
    c = F.col("top10_ex_lp_pct")
    return (
        F.when(c.isNull(), _dunno("top-10 concentration"))
        .when(c > TOP10_MAX_PCT, _no(_say(f"top-10 ex-LP hold %.1f%% > {TOP10_MAX_PCT}%%", c)))
        .otherwise(_ok(_say("top-10 ex-LP hold %.1f%%", c)))
    )


def deployer_history() -> Column:
    c = F.col("deployer_prior_rugs")
    return (
        F.when(c.isNull(), _dunno("deployer history"))
        .when(c >= 1, _no(_say("deployer linked to %d prior rug(s)", c)))
        .otherwise(_ok("no prior rugs on deployer"))
    )


def liquidity_depth() -> Column:
    ref = F.coalesce("fdv_usd", "mcap_usd")
    kind = F.when(F.col("fdv_usd").isNotNull(), "FDV").otherwise("mcap")
    pct = F.try_divide(F.col("liquidity_usd"), ref) * 100
    return (
        F.when(F.col("liquidity_usd").isNull() | ref.isNull(), _dunno("liquidity or valuation"))
        .when(ref <= 0, _dunno(F.concat(kind, F.lit(" is not positive"))))
        .when(
            pct < LIQUIDITY_MIN_PCT,
            _no(_say(f"liquidity %.2f%% of %s < {LIQUIDITY_MIN_PCT}%%", pct, kind)),
        )
        .otherwise(_ok(_say("liquidity %.2f%% of %s", pct, kind)))
    )


def proxy_risk(registry=chains.REGISTRY) -> Column:
    up, evm, chain = F.col("upgradeable"), chains.is_evm("chain", registry), F.col("chain")
    return (
        F.when(up.isNull() & ~evm, _ok(F.concat(F.lit("proxies are not a construct on "), chain)))
        .when(
            up.isNull() & evm.isNull(),
            _dunno(F.concat(F.lit("whether "), chain, F.lit(" has EVM proxies"))),
        )
        .when(up.isNull(), _dunno("upgradeability"))
        .when(~up, _ok("contract is not upgradeable"))
        .when(F.col("admin_renounced").isNull(), _dunno("proxy admin"))
        .when(F.col("admin_renounced"), _ok("upgradeable but admin renounced"))
        .otherwise(_no("upgradeable with unrenounced admin"))
    )


CHECKS = {
    "sellability": sellability,
    "mint_authority": mint_authority,
    "freeze_authority": freeze_authority,
    "liquidity_lock": liquidity_lock,
    "concentration": concentration,
    "deployer_history": deployer_history,
    "liquidity_depth": liquidity_depth,
    "proxy_risk": proxy_risk,
}


def inputs(df: DataFrame) -> DataFrame:
    """Give the frame every filter input, null where it has none."""
    missing = {c: F.lit(None).cast(t) for c, t in INPUTS.items() if c not in df.columns}
    return df.withColumns(missing) if missing else df


def override(snapshot_side: DataFrame, safety: DataFrame, keys: list[str]) -> DataFrame:
    """Filter inputs: a measured safety fact replaces the snapshot's, an unknown one does not."""
    facts = [c for c in SAFETY_FIELDS if c in safety.columns]
    renamed = safety.select(*keys, *[F.col(c).alias(f"_s_{c}") for c in facts])
    joined = inputs(snapshot_side).join(renamed, keys, "left")
    return joined.withColumns({c: F.coalesce(f"_s_{c}", c) for c in facts}).drop(
        *[f"_s_{c}" for c in facts]
    )


def verdict(df: DataFrame, registry=chains.REGISTRY) -> DataFrame:
    """Run all eight checks on every row. Nothing stops at the first rejection."""
    df = inputs(df)
    results = F.array(
        *[
            F.struct(
                F.lit(name).alias("name"),
                (check(registry) if name == "proxy_risk" else check()).alias("r"),
            )
            for name, check in CHECKS.items()
        ]
    )

    def names(outcome: str) -> Column:
        return F.transform(
            F.filter("_results", lambda x: x["r"]["outcome"] == outcome), lambda x: x["name"]
        )

    return (
        df.withColumn("_results", results)
        .withColumn("rejected_by", names(REJECT))
        .withColumn("indeterminate_on", names(UNKNOWN))
        .withColumn("excluded", (F.size("rejected_by") > 0) | (F.size("indeterminate_on") > 0))
        .withColumn(
            "reasons",
            F.map_from_entries(
                F.transform(
                    F.filter("_results", lambda x: x["r"]["outcome"] != PASS),
                    lambda x: F.struct(x["name"], x["r"]["reason"]),
                )
            ),
        )
        .drop("_results")
    )


def single(df: DataFrame, name: str, registry=chains.REGISTRY) -> DataFrame:
    """One check's outcome and reason."""
    check = CHECKS[name](registry) if name == "proxy_risk" else CHECKS[name]()
    return (
        inputs(df)
        .withColumn("_r", check)
        .withColumn("outcome", F.col("_r.outcome"))
        .withColumn("reason", F.col("_r.reason"))
        .drop("_r")
    )
