"""Per-feature backtest: which stored features order the outcome, and why to distrust them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.values import age_band, clean, div, known, outcome
from tidewatch.operators import keys, stats
from tidewatch.session import durable

# Default outcome, caution thresholds and the control feature.
LABEL, THRESHOLD = "max_multiple_6h", 1.5
TIE_WARNING = 0.30
MIN_STRATUM_ROWS = 12
CONTROL = "age_minutes"
BANDS = ("<1h", "1-6h", "6-48h", ">48h")

# The verdict sentences.
SAYS = {
    "unmeasurable": "unmeasurable",
    "control": "control variable -- ",
    "younger": "younger surges more",
    "older": "older surges more",
    "not_self": "; the strata are cut on it, so it is not checked against itself",
    "artefact": "artefact: pinned value, and no separation inside an age band",
    "suspect": "suspect: %.0f%% of rows share one value",
    "none": "no separation (interval spans 0.5)",
    "confounded": "confounded with age: separation does not survive stratification",
    "no_split": "separates in sample only -- no out-of-sample split to confirm it",
    "turned": "separates in sample only -- the direction learned on the earlier rows did not hold on the later ones",
    "lead": "separates, out of sample, within age bands -- a lead, not a result",
}


def _share(buys: str, sells: str) -> Column:
    return div(buys, F.col(buys) + F.col(sells))


def _declared() -> list[Column]:
    return [F.col(f"socials_declared_{s}") for s in ("telegram", "x", "website")]


def feature_columns() -> dict[str, Column]:
    """Every feature as a function of stored columns, so a new one applies to old rows too."""
    mcap, volume = clean("market_mcap_usd"), clean("market_volume_24h_usd")
    liquidity, trades = clean("market_liquidity_usd"), clean("mindshare_txns_24h")
    declared = _declared()
    yes = sum((F.coalesce(c, F.lit(False)).cast("double") for c in declared), F.lit(0.0))
    return {
        "mcap_usd": mcap,
        "liquidity_usd": liquidity,
        "volume_24h_usd": volume,
        "age_minutes": clean("age_at_trigger_minutes"),
        "turnover_24h": div(volume, mcap),
        "liquidity_over_mcap": div(liquidity, mcap),
        "fdv_over_mcap": div("market_fdv_usd", mcap),
        "value_per_trade": div(volume, trades),
        "txn_accel_6h_24h": div(
            div("mindshare_txns_6h", F.lit(6.0)), div("mindshare_txns_24h", F.lit(24.0))
        ),
        "buy_pressure_1h": _share("momentum_buys_1h", "momentum_sells_1h"),
        "buy_pressure_24h": _share("momentum_buys_24h", "momentum_sells_24h"),
        "volume_accel_1h_6h": div("momentum_volume_1h_usd", div("momentum_volume_6h_usd", F.lit(6.0))),
        **{
            f"price_change_{w}_pct": clean(f"momentum_price_change_{w}_pct")
            for w in ("5m", "1h", "6h", "24h")
        },
        "mindshare_share_pct": clean("mindshare_share_pct"),
        "mindshare_percentile": clean("mindshare_percentile"),
        "pair_count": clean("mindshare_pair_count"),
        "boost_total": clean("mindshare_boost_total"),
        "socials_declared_n": F.when(known(*declared) > 0, yes),
        "declared_x": F.col("socials_declared_x").cast("double"),
        "declared_telegram": F.col("socials_declared_telegram").cast("double"),
        "declared_website": F.col("socials_declared_website").cast("double"),
        "holder_count": clean("safety_holder_count"),
        "top10_ex_lp_pct": clean("safety_top10_ex_lp_pct"),
        "lp_locked_pct": clean("safety_lp_locked_pct"),
        "data_completeness": clean("data_completeness"),
    }


SOURCES = (
    "market_mcap_usd", "market_liquidity_usd", "market_volume_24h_usd", "market_fdv_usd",
    "age_at_trigger_minutes", "mindshare_txns_24h", "mindshare_txns_6h", "momentum_buys_1h",
    "momentum_sells_1h", "momentum_buys_24h", "momentum_sells_24h", "momentum_volume_1h_usd",
    "momentum_volume_6h_usd", "momentum_price_change_5m_pct", "momentum_price_change_1h_pct",
    "momentum_price_change_6h_pct", "momentum_price_change_24h_pct", "mindshare_share_pct",
    "mindshare_percentile", "mindshare_pair_count", "mindshare_boost_total", "data_completeness",
    "safety_holder_count", "safety_top10_ex_lp_pct", "safety_lp_locked_pct",
)


def features(rows: DataFrame, keep: list[str]) -> DataFrame:
    """The 28 features of each snapshot row; absent stored columns are unknown."""
    missing = {c: F.lit(None).cast("double") for c in SOURCES if c not in rows.columns}
    flags = {
        c: F.lit(None).cast("boolean")
        for c in ("socials_declared_telegram", "socials_declared_x", "socials_declared_website")
        if c not in rows.columns
    }
    rows = rows.withColumns({**missing, **flags}) if missing or flags else rows
    return rows.select(*keep, *[c.alias(n) for n, c in feature_columns().items()])


def rows(
    snapshots: DataFrame,
    labels: DataFrame,
    safety: DataFrame | None = None,
    label: str = LABEL,
    threshold: float | None = THRESHOLD,
    limit: int | None = None,
) -> DataFrame:
    """Snapshots (the newest ``limit`` if given) with a resolved label, as features and 1/0."""
    newest = snapshots if limit is None else snapshots.orderBy(F.desc("ts"), "snapshot_id").limit(limit)
    answers = labels.select("snapshot_id", outcome(label, threshold).alias("label"))
    joined = newest.join(answers.where("label is not null"), "snapshot_id")
    if safety is not None:
        facts = ("holder_count", "top10_ex_lp_pct", "lp_locked_pct")
        latest = keys.latest(safety, ["snapshot_id"], ["ts", "observation_id"])
        joined = joined.join(
            latest.select("snapshot_id", *[F.col(c).alias(f"safety_{c}") for c in facts]),
            "snapshot_id",
            "left",
        )
    return features(joined, ["snapshot_id", "ts", "label"]).withColumn("age_band", age_band(CONTROL))


def long_form(wide: DataFrame) -> DataFrame:
    """One row per (feature, snapshot) where the feature is known."""
    names = list(feature_columns())
    entries = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("score")) for n in names])
    return (
        wide.select("snapshot_id", "ts", "label", "age_band", F.explode(entries).alias("_e"))
        .select("snapshot_id", "ts", "label", "age_band", "_e.feature", "_e.score")
        .where("score is not null")
    )


def evaluate(wide: DataFrame, names: list[str] | None = None) -> DataFrame:
    """One row per feature with every statistic and its verdict.

    All features, splits and bands are scopes of one long frame, so each statistic is one pass.
    """
    # Four statistics read the long frame, so it is computed once and cut from its lineage.
    long = durable(long_form(wide))
    split = stats.time_split(long, "ts", "snapshot_id", ["feature"])
    scopes = F.array(
        F.lit("all"), F.col("split"), F.when(F.col("age_band").isNotNull(), F.concat(F.lit("band "), "age_band"))
    )
    scoped = split.withColumn("scope", F.explode(F.array_compact(scopes)))
    areas = stats.auc(scoped, ["feature", "scope"])

    def at(scope: str, column: str) -> Column:
        return F.max(F.when(F.col("scope") == scope, F.col(column)))

    wide_areas = areas.groupBy("feature").agg(
        at("all", "n").alias("n"),
        at("all", "positives").alias("positives"),
        at("all", "negatives").alias("negatives"),
        at("all", "auc").alias("auc"),
        at("train", "auc").alias("_train"),
        at("test", "auc").alias("_test"),
        at("test", "positives").alias("_tp"),
        at("test", "negatives").alias("_tn"),
        *[
            F.max(F.when((F.col("scope") == f"band {b}") & (F.col("n") >= MIN_STRATUM_ROWS), F.col("auc"))).alias(
                f"auc_{i}"
            )
            for i, b in enumerate(BANDS)
        ],
    )
    oriented = F.when(F.col("_train") >= 0.5, F.col("_test")).otherwise(1.0 - F.col("_test"))
    two_sided = F.col("auc").isNotNull()
    wide_areas = wide_areas.withColumn(
        "auc_out_of_sample", F.when(two_sided & F.col("_train").isNotNull(), oriented)
    )
    signs = wide_areas.select(
        "feature", F.when(F.coalesce("auc", F.lit(0.5)) >= 0.5, 1.0).otherwise(-1.0).alias("_sign")
    )
    lifts = stats.decile_lift(
        long.join(signs, "feature"),
        ["feature"],
        [(F.col("_sign") * F.col("score")).desc(), F.col("ts"), F.col("snapshot_id")],
    ).select("feature", F.col("lift").alias("top_decile_lift"))
    first_seen = F.struct("ts", "snapshot_id")
    ties = _tie_mass(long, first_seen)
    out = wide_areas.join(lifts, "feature").join(ties, "feature")
    low, high = stats.auc_interval(F.col("auc"), F.col("positives"), F.col("negatives"))
    olow, ohigh = stats.auc_interval(F.col("auc_out_of_sample"), F.col("_tp"), F.col("_tn"))
    out = (
        out.withColumn("auc_low", low)
        .withColumn("auc_high", high)
        .withColumn("oos_low", olow)
        .withColumn("oos_high", ohigh)
        .withColumn("top_decile_lift", F.when(two_sided, F.col("top_decile_lift")))
    )
    return judge(out).drop("_train", "_test", "_tp", "_tn", "negatives")


def _tie_mass(long: DataFrame, first_seen: Column) -> DataFrame:
    counts = long.groupBy("feature", "score").agg(F.count("*").alias("_n"), F.min(first_seen).alias("_first"))
    most = counts.groupBy("feature").agg(F.max("_n").alias("_most"), F.sum("_n").alias("_all"))
    modal = counts.join(most, "feature").where("_n = _most")
    return modal.groupBy("feature").agg(
        F.any_value(F.col("_most") / F.col("_all")).alias("tie_share"),
        F.min_by("score", "_first").alias("tie_value"),
    )


def judge(df: DataFrame) -> DataFrame:
    """Add the reading flags and the verdict, tested in a fixed order."""
    side = F.when(F.col("auc") >= 0.5, 1.0).otherwise(-1.0)
    bands = F.array_compact(F.array(*[F.col(f"auc_{i}") for i in range(len(BANDS))]))
    agree = F.forall(bands, lambda v: (v - 0.5) * side > 0.02)
    control = F.col("feature") == CONTROL
    survives = control | ((F.size(bands) > 0) & F.col("auc").isNotNull() & agree)
    separates = F.coalesce((F.col("auc_low") > 0.5) | (F.col("auc_high") < 0.5), F.lit(False))
    holds = F.coalesce(F.col("auc_out_of_sample") > 0.5, F.lit(False))
    pinned = F.col("tie_share") >= TIE_WARNING
    return (
        df.withColumn("is_control", control)
        .withColumn("separates", separates)
        .withColumn("survives_strata", F.coalesce(survives, F.lit(False)))
        .withColumn("holds_out_of_sample", holds)
        .withColumn("degenerate", pinned)
        .withColumn(
            "verdict",
            F.when(F.col("auc").isNull(), SAYS["unmeasurable"])
            .when(
                F.col("is_control"),
                F.concat(
                    F.lit(SAYS["control"]),
                    F.when(F.col("auc") < 0.5, SAYS["younger"]).otherwise(SAYS["older"]),
                    F.lit(SAYS["not_self"]),
                ),
            )
            .when(
                F.col("degenerate") & ~F.col("survives_strata"),
                SAYS["artefact"],
            )
            .when(
                F.col("degenerate"),
                F.format_string(SAYS["suspect"], F.col("tie_share") * 100),
            )
            .when(~F.col("separates"), SAYS["none"])
            .when(
                ~F.col("survives_strata"),
                SAYS["confounded"],
            )
            .when(
                F.col("auc_out_of_sample").isNull(),
                SAYS["no_split"],
            )
            .when(
                ~F.col("holds_out_of_sample"),
                SAYS["turned"],
            )
            .otherwise(SAYS["lead"]),
        )
        .withColumn(
            "is_lead",
            F.col("separates")
            & F.col("holds_out_of_sample")
            & F.col("survives_strata")
            & ~F.col("degenerate")
            & ~F.col("is_control"),
        )
    )


def report(wide: DataFrame, evaluated: DataFrame, gate_row: DataFrame) -> DataFrame:
    """One row: sample, base rate with interval, the exit gate and the leads.

    ``gate_row`` holds one row (survivors, dead, complete_social, triggered).
    """
    base = stats.base_rate(wide, []).withColumn("_one", F.lit(1))
    leads = evaluated.where("is_lead").agg(
        F.array_join(F.sort_array(F.collect_list("feature")), ",").alias("leads"), F.count("*").alias("n_leads")
    )
    per, met = stats.gate(F.col("survivors"), F.col("dead"), F.col("complete_social"))
    one = F.lit(1).alias("_one")
    return (
        base.join(leads.select("*", one), "_one")
        .join(gate_row.select("*", one), "_one")
        .withColumn("dead_per_survivor", per)
        .withColumn("gate_met", met)
        .drop("_one")
    )


def by_strength(evaluated: DataFrame) -> DataFrame:
    """Strongest separation first, in either direction."""
    return evaluated.orderBy(F.desc(F.coalesce(F.abs(F.col("auc") - 0.5), F.lit(0.0))), "feature")
