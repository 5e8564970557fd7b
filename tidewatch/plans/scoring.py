"""The scoring run: filters, pillars, ranks, and change-only appends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import chains
from tidewatch.functions.values import known
from tidewatch.operators import filters, keys, pillars, social
from tidewatch.operators.ordered import row_numbers
from tidewatch.operators.outcomes import window_closed

# Reuse age of a safety verdict and the no-edge line.
SAFETY_MAX_AGE_MS = 6 * 60 * 60 * 1000
NO_EDGE_BELOW = 55.0
TOKEN = ["chain", "contract"]
# What a re-score may differ in and still be the same score.
IDENTITY = ("score_id", "run_id", "scored_at_ms", "rank")


def newest(snapshots: DataFrame, limit: int | None) -> DataFrame:
    """The most recently triggered snapshots, all with ``None``: a top-k, never a full sort."""
    return snapshots if limit is None else snapshots.orderBy(F.desc("ts"), "snapshot_id").limit(limit)


def completeness(df: DataFrame, columns: list[str]) -> DataFrame:
    """fields_present, fields_expected and their ratio over the counted feature columns."""
    return (
        df.withColumn("fields_present", known(*[F.col(c) for c in columns]).cast("bigint"))
        .withColumn("fields_expected", F.lit(len(columns)).cast("bigint"))
        .withColumn("data_completeness", F.col("fields_present") / F.col("fields_expected"))
    )


def filter_frame(candidates: DataFrame, as_of_ms: int | None = None) -> DataFrame:
    """Filter inputs named from a stored snapshot row."""
    source = {
        "evaluated_at_ms": F.lit(as_of_ms).cast("bigint") if as_of_ms is not None else F.col("ts"),
        "mcap_usd": "market_mcap_usd",
        "liquidity_usd": "market_liquidity_usd",
        "fdv_usd": "market_fdv_usd",
        "mint_revoked": "authorities_mint_revoked",
        "freeze_active": "authorities_freeze_active",
        "lp_locked_until_ms": "authorities_lp_locked_until",
        "top10_ex_lp_pct": "holders_top10_ex_lp_pct",
        "deployer_prior_rugs": "deployer_prior_rugs",
    }
    picked = {}
    for name, src in source.items():
        if isinstance(src, Column):
            picked[name] = src
        elif src in candidates.columns:
            picked[name] = F.col(src)
    return candidates.withColumns(picked)


def stale(
    candidates: DataFrame, latest_safety: DataFrame, as_of_ms: int, max_age_ms: int = SAFETY_MAX_AGE_MS
) -> DataFrame:
    """Tokens whose safety must be looked up again: missing or old, and not finished."""
    seen = latest_safety.select(*TOKEN, F.col("collected_at_ms").alias("_seen"))
    return (
        candidates.where(~window_closed(F.col("ts"), as_of_ms))
        .where((F.col("chain") != "") & (F.col("contract") != ""))
        .join(seen, TOKEN, "left")
        .where(F.col("_seen").isNull() | (as_of_ms - F.col("_seen") >= max_age_ms))
        .drop("_seen")
    )


def score_rows(
    candidates: DataFrame,
    safety: DataFrame,
    as_of_ms: int,
    regime: str | None = None,
    weights: dict[str, float] | None = None,
    registry=chains.REGISTRY,
) -> DataFrame:
    """One score row per candidate: verdict, pillars and score; excluded rows have no score."""
    framed = filter_frame(candidates, as_of_ms)
    merged = filters.override(framed, safety, TOKEN)
    judged = filters.verdict(merged, registry)
    scored = pillars.score(judged, weights, regime)
    keep = ~F.col("excluded")
    return scored.withColumn("score", F.when(keep, F.col("score"))).withColumn(
        "raw_score", F.when(keep, F.col("raw_score"))
    )


def rank_batch(rows: DataFrame, tie: str, digits: int | None = None) -> DataFrame:
    """Rank the survivors best first, unscored survivors last; excluded rows have no rank."""
    key = F.col("score") if digits is None else F.round("score", digits)
    order = [F.col("excluded"), key.desc_nulls_last(), F.col(tie)]
    placed = row_numbers(rows, [], order, "_at")
    return placed.withColumn("rank", F.when(~F.col("excluded"), F.col("_at"))).drop("_at")


def run(
    snapshots: DataFrame,
    social_rows: DataFrame,
    safety_rows: DataFrame,
    as_of_ms: int,
    limit: int | None,
    regime: str | None = None,
    registry=chains.REGISTRY,
) -> DataFrame:
    """Score the newest ``limit`` snapshots (all with ``None``) with social counts folded in and safety reused."""
    candidates = social.fold_into(newest(snapshots, limit), social_rows)
    latest = keys.latest(safety_rows, TOKEN, ["collected_at_ms", "source"])
    return score_rows(candidates, latest, as_of_ms, regime, registry=registry)


def changed_scores(rows: DataFrame, stored: DataFrame, content: list[str], rounded: tuple[str, ...]) -> DataFrame:
    """Score rows to append: those that say something their token's newest row does not."""
    newest_rows = keys.latest(stored, ["snapshot_id"], ["scored_at_ms", "score_id"])
    return keys.changed_only(rows, newest_rows, ["snapshot_id"], content, rounded)


def exclusion_summary(rows: DataFrame) -> DataFrame:
    """Excluded on evidence against excluded as unmeasured."""
    on_evidence = F.size("rejected_by") > 0
    return rows.where("excluded").agg(
        F.count("*").alias("excluded_total"),
        F.count_if(on_evidence).alias("excluded_on_evidence"),
        F.count_if(~on_evidence).alias("excluded_as_unmeasured"),
    )


def batch_verdict(rows: DataFrame) -> DataFrame:
    """One sentence on the batch."""
    best = rows.where("not excluded").agg(
        F.count("*").alias("_n"), F.max(F.coalesce("score", F.lit(0.0))).alias("best_score")
    )
    fit = pillars.WEIGHTS_VERSION
    return best.select(
        "best_score",
        F.when(F.col("_n") == 0, "no candidate cleared the hard filters")
        .when(
            F.col("best_score") < NO_EDGE_BELOW,
            F.format_string(
                f"no edge in this batch (best score %.1f < {NO_EDGE_BELOW:.0f}); weights {fit} "
                "establish no edge, so this is a logged observation, not a recommendation",
                "best_score",
            ),
        )
        .otherwise(
            F.format_string(
                f"best score %.1f, but weights {fit} were fitted on too small a sample to "
                "establish an edge -- a logged observation, not a recommendation",
                "best_score",
            )
        )
        .alias("verdict"),
    )


def current_board(
    snapshots: DataFrame, scores: DataFrame, limit: int | None, rank_since_ms: int
) -> DataFrame:
    """Newest score of each of the ``limit`` newest tokens (all with ``None``), one scoring version only, ranked.

    Rows scored under an older prompt or weights version than the newest row are dropped; only
    survivors triggered inside the open window hold a rank.
    """
    recent = newest(snapshots, limit).select("snapshot_id", "ts", *TOKEN)
    newest_rows = keys.latest(
        scores.join(recent.select("snapshot_id"), "snapshot_id", "left_semi"),
        ["snapshot_id"],
        ["scored_at_ms", "score_id"],
    )
    version = newest_rows.groupBy().agg(
        F.max_by(
            F.struct("prompt_version", "weights_version"), F.struct("scored_at_ms", "score_id")
        ).alias("_v")
    )
    current = newest_rows.join(
        version.select("_v.prompt_version", "_v.weights_version"),
        ["prompt_version", "weights_version"],
        "left_semi",
    ).join(recent, "snapshot_id")
    open_now = ~F.col("excluded") & (F.col("ts") >= rank_since_ms)
    ranks = row_numbers(
        current.where(open_now).select("snapshot_id", F.col("score").alias("_key")),
        [],
        [F.col("_key").desc_nulls_last(), F.col("snapshot_id")],
    ).select("snapshot_id", F.col("rank").alias("board_rank"))
    return current.join(ranks, "snapshot_id", "left")
