"""Boards for readers: the stored board, the live view and their JSON rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import chains
from tidewatch.operators import keys, pillars, trigger
from tidewatch.operators.outcomes import WINDOW_MINUTES
from tidewatch.plans import scoring


def snapshot_rows(
    crossings: DataFrame, source: str, regime: str | None = None, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Snapshot rows of firing observations; an observation that did not fire is refused.

    ``keep`` names further columns of the observation to carry along.
    """
    fired = trigger.decide(crossings).where("fired")
    ts = F.timestamp_millis("observed_at_ms")
    return fired.select(
        F.sha2(F.concat_ws("|", "chain", "contract"), 256).alias("snapshot_id"),
        "chain",
        "contract",
        F.col("observed_at_ms").alias("ts"),
        F.to_date(ts).alias("snapshot_date"),
        "trigger_kind",
        "trigger_mcap_crossed",
        "trigger_holders_crossed",
        F.lit(source).alias("source"),
        F.lit(regime).cast("string").alias("regime"),
        F.col("mcap_usd").alias("market_mcap_usd"),
        F.col("holder_count").alias("holders_count"),
        *keep,
    )


def trigger_events(snapshots: DataFrame) -> DataFrame:
    """The event row that marks each token as fired."""
    return snapshots.select(
        F.concat(F.lit("e-"), "snapshot_id").alias("event_id"),
        "ts",
        "chain",
        "contract",
        "trigger_kind",
        "trigger_mcap_crossed",
        "trigger_holders_crossed",
        F.col("market_mcap_usd").alias("mcap_usd_at_trigger"),
        F.col("holders_count").alias("holder_count_at_trigger"),
        "snapshot_id",
        "source",
    )


def payload(
    snapshots: DataFrame,
    scores: DataFrame,
    labels: DataFrame,
    safety: DataFrame,
    as_of_ms: int,
    limit: int | None,
    page_base: str = "https://pages.example",
    registry=chains.REGISTRY,
) -> DataFrame:
    """Board rows: the newest ``limit`` snapshots (all with ``None``) with current score, latest label and latest safety."""
    since = as_of_ms - WINDOW_MINUTES * 60_000
    recent = scoring.newest(snapshots, limit)
    board = scoring.current_board(snapshots, scores, limit, since).select(
        "snapshot_id", "score", "excluded", F.col("board_rank").alias("rank")
    )
    label = keys.latest(labels, ["snapshot_id"], ["filled_at_ms", "label_id"]).select(
        "snapshot_id", "max_multiple_24h", "max_multiple_7d", "survived_24h", "survived_7d"
    )
    facts = keys.latest(safety, ["chain", "contract"], ["collected_at_ms", "source"])
    fact = F.struct(*[F.col(c) for c in facts.columns if c not in ("chain", "contract")])
    return (
        recent.join(board, "snapshot_id", "left")
        .join(label, "snapshot_id", "left")
        .join(facts.select("chain", "contract", fact.alias("safety")), ["chain", "contract"], "left")
        .withColumn("outcome_window_closed", F.col("ts") < since)
        .withColumn("chain_label", chains.label("chain", registry))
        .withColumn("page_url", chains.page_url("chain", "contract", page_base, registry))
    )


def as_json(rows: DataFrame, column: str = "json") -> DataFrame:
    """One JSON document per board row."""
    return rows.select("snapshot_id", F.to_json(F.struct(*rows.columns)).alias(column))


def verdict_rows(rows: DataFrame) -> DataFrame:
    """Ranked rows and rejected rows as one frame of JSON documents with their kind."""
    ranked = F.struct(
        "rank", "snapshot_id", "chain", "score", F.struct(*[F.col(f"pillar_{n}.score").alias(n) for n in pillars.NAMES]).alias("pillar_scores"),
        "modifiers_applied", "data_gaps",
    )
    rejected = F.struct(
        "snapshot_id",
        F.concat("rejected_by", "indeterminate_on").alias("rejected_by"),
        F.col("rejected_by").alias("hard_rejected_by"),
        "indeterminate_on",
    )
    return rows.select(
        "snapshot_id",
        F.when(F.col("excluded"), "rejected").otherwise("ranked").alias("kind"),
        F.when(F.col("excluded"), F.to_json(rejected)).otherwise(F.to_json(ranked)).alias("json"),
    )


def live(universe: DataFrame) -> DataFrame:
    """One row: how many polled tokens are at or above the trigger, and how many below."""
    fired = trigger.decide(universe)
    return fired.agg(
        F.count("*").alias("polled"),
        F.count_if("fired").alias("triggered"),
        F.count_if(~F.col("fired")).alias("below_trigger"),
    )


def live_order(rows: DataFrame, limit: int) -> DataFrame:
    """Ranked rows first, then the rest by market cap."""
    return rows.orderBy(
        F.asc_nulls_last("rank"), F.desc(F.coalesce("market_mcap_usd", F.lit(0.0))), "snapshot_id"
    ).limit(limit)


def progress(snapshots: DataFrame, scores: DataFrame, observations: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts a reader sees beside the board, one row per measure."""

    def one(name: str, df: DataFrame, agg: Column) -> DataFrame:
        return df.agg(agg.cast("bigint").alias("value")).select(F.lit(name).alias("measure"), "value")

    parts = [
        one("triggered_tokens", snapshots, F.count("*")),
        one("scored_rows", scores, F.count("*")),
        one("outcome_observations", observations, F.count("*")),
        one("labelled_snapshots", labels, F.countDistinct("snapshot_id")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
