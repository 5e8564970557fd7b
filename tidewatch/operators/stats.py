"""Rank statistics per group: AUC, decile lift, tie mass, time splits.

Nothing here ranks a whole group in one task. AUC first collapses to one row per distinct score,
then takes running totals over range partitions; deciles and splits use the same running totals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.values import auc_interval, wilson
from tidewatch.operators.keys import join_null_safe
from tidewatch.operators.ordered import prefix_sums, row_numbers

# Held-out share and the exit gate.
TEST_FRACTION = 0.3
MIN_COMPLETE_SERIES = 300
MIN_DEAD_PER_SURVIVOR = 20
CONCORDANCE_BENCHMARK = 0.858


def auc(df: DataFrame, groups: list[str], label: str = "label", score: str = "score") -> DataFrame:
    """Per group: n, positives, negatives, auc (ties averaged; null when a class is absent)."""
    distinct = df.groupBy(*groups, score).agg(
        F.sum(F.col(label).cast("bigint")).alias("_pos"), F.count("*").alias("_n")
    )
    cum = prefix_sums(distinct, groups, [F.col(score)], {"_cum": F.col("_n")})
    # Average 1-based rank of a tied block ending at _cum, doubled to stay whole.
    twice_rank = 2 * F.col("_cum") - F.col("_n") + 1
    sums = cum.groupBy(*groups).agg(
        F.sum("_n").alias("n"),
        F.sum("_pos").alias("positives"),
        F.sum(F.col("_pos") * twice_rank).alias("_ranks"),
    )
    p, q = F.col("positives"), F.col("n") - F.col("positives")
    value = F.try_divide(F.col("_ranks") / 2 - p * (p + 1) / 2, (p * q).cast("double"))
    return sums.select(
        *groups, "n", "positives", q.alias("negatives"), F.when((p > 0) & (q > 0), value).alias("auc")
    )


def with_interval(df: DataFrame, area: str = "auc") -> DataFrame:
    low, high = auc_interval(F.col(area), F.col("positives"), F.col("negatives"))
    return df.withColumn(f"{area}_low", low).withColumn(f"{area}_high", high)


def decile_lift(
    df: DataFrame, groups: list[str], order: list[Column], label: str = "label"
) -> DataFrame:
    """Positive rate of the first max(1, n // 10) rows over the base rate, with its interval."""
    ranked = row_numbers(df, groups, order, "_rank")
    totals = [F.count("*").alias("_n"), F.sum(F.col(label).cast("bigint")).alias("_pos")]
    if groups:
        met = join_null_safe(ranked, ranked.groupBy(*groups).agg(*totals), groups)
    else:
        whole = ranked.agg(*totals).first()
        met = ranked.withColumns({"_n": F.lit(whole["_n"]), "_pos": F.lit(whole["_pos"]).cast("bigint")})
    met = met.withColumn("decile_size", F.greatest(F.lit(1), F.floor(F.col("_n") / 10)).cast("bigint"))
    hits = (
        met.where("_rank <= decile_size")
        .groupBy(*groups, "_n", "_pos", "decile_size")
        .agg(F.sum(F.col(label).cast("bigint")).alias("decile_positives"))
    )
    base = F.col("_pos") / F.col("_n")
    low, high = wilson(F.col("decile_positives"), F.col("decile_size"))
    some = F.col("_pos") > 0
    return hits.select(
        *groups,
        "decile_size",
        "decile_positives",
        F.when(some, F.col("decile_positives") / F.col("decile_size") / base).alias("lift"),
        F.when(some, low / base).alias("lift_low"),
        F.when(some, high / base).alias("lift_high"),
    )


def tie_mass(df: DataFrame, groups: list[str], value: str, pos: str) -> DataFrame:
    """Share of rows at the modal value; the value seen first wins a tie."""
    counts = df.groupBy(*groups, value).agg(F.count("*").alias("_n"), F.min(pos).alias("_first"))
    return counts.groupBy(*groups).agg(
        (F.max("_n") / F.sum("_n")).alias("tie_share"),
        F.max_by(value, F.struct("_n", -F.col("_first"))).alias("tie_value"),
    )


def cut_position(n: int, test_fraction: float = TEST_FRACTION) -> int:
    """Rows in the training part: truncated, as the split defines it."""
    return int(n * (1 - test_fraction))


def time_split(
    df: DataFrame,
    ts: str,
    tie: str,
    groups: list[str] = (),
    test_fraction: float = TEST_FRACTION,
) -> DataFrame:
    """Add split = train | test, oldest rows first. Never shuffled at random."""
    groups = list(groups)
    ranked = row_numbers(df, groups, [F.col(ts), F.col(tie)], "_at")
    share = 1 - test_fraction
    if groups:
        sizes = ranked.groupBy(*groups).agg(F.floor(F.max("_at") * F.lit(share)).alias("_cut"))
        ranked = join_null_safe(ranked, sizes, groups)
    else:
        # The ranks are stored, so their largest is a read and not another run of the input.
        n = ranked.agg(F.max("_at")).first()[0] or 0
        ranked = ranked.withColumn("_cut", F.lit(cut_position(n, test_fraction)))
    return ranked.withColumn("split", F.when(F.col("_at") <= F.col("_cut"), "train").otherwise("test")).drop(
        "_at", "_cut"
    )


def repair_leakage(split: DataFrame, deployer: str = "deployer") -> DataFrame:
    """Move test rows whose deployer was seen in training into train, flagged ``moved``."""
    seen = (
        split.where((F.col("split") == "train") & (F.col(deployer) != ""))
        .select(F.col(deployer), F.lit(True).alias("_seen"))
        .distinct()
    )
    joined = split.join(seen, deployer, "left")
    moved = (F.col("split") == "test") & F.col("_seen").isNotNull()
    return (
        joined.withColumn("moved", moved)
        .withColumn("split", F.when(moved, "train").otherwise(F.col("split")))
        .drop("_seen")
    )


def base_rate(df: DataFrame, groups: list[str], label: str = "label") -> DataFrame:
    """n, positives, base rate and its Wilson interval per group."""
    out = df.groupBy(*groups).agg(
        F.count("*").alias("n"), F.sum(F.col(label).cast("bigint")).alias("positives")
    )
    low, high = wilson(F.col("positives"), F.col("n"))
    return (
        out.withColumn("base_rate", F.try_divide(F.col("positives").cast("double"), F.col("n")))
        .withColumn("base_rate_low", low)
        .withColumn("base_rate_high", high)
    )


def gate(survivors: Column, dead: Column, complete_social: Column) -> tuple[Column, Column]:
    """(dead per survivor, whether the exit criteria are met)."""
    per = F.try_divide(dead.cast("double"), survivors.cast("double"))
    met = (complete_social >= MIN_COMPLETE_SERIES) & (per >= MIN_DEAD_PER_SURVIVOR)
    return per, F.coalesce(met, F.lit(False))
