"""Calibration: exit gate, time-split logistic fit, held-out metrics, weights and report."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidewatch.functions.values import mcap_band, outcome
from tidewatch.operators import pillars, social, stats
from tidewatch.session import durable

# Labels calibrated against, with the threshold of a yes.
LABELS = (
    ("max_multiple_1h", 2.0),
    ("max_multiple_6h", 2.0),
    ("max_multiple_24h", 2.0),
    ("max_multiple_72h", 2.0),
    ("max_multiple_7d", 2.0),
    ("survived_24h", None),
    ("survived_7d", None),
)
BANDS = ("<500k", "500k-2m", "2m-10m", ">10m")
EPOCHS, RATE, L2 = 400, 0.3, 0.01

# The sentences of the verdict, around the figures they hold.
WAITING = (
    "Phase 0 has not finished collecting, so no edge can be claimed. ",
    ". Until this is met, every score the screener emits -- whatever weights are in force -- "
    "is a logged observation and must not be read as a prediction.",
)
EMPTY = (
    "The held-out set of {n} rows contains no positive events, so nothing can be measured on it. "
    "This usually means outcomes are clustered in time; collect a longer span before splitting again."
)
FLAT = ("The top decile scores ", " the base rate out of sample, so no edge has been measured.")
EDGE = (
    "The top decile beats the base rate by ",
    " out of sample, on %d positive events in a test set of {n}. ",
    "Concordance %.3f is ",
    " the published {benchmark} benchmark.",
)


def base_rate_by_band(
    rows: DataFrame, label: str, threshold: float | None, mcap: str = "market_mcap_usd"
) -> DataFrame:
    """Outcome rate per market-cap band; an empty band keeps its row with a null rate."""
    spark = rows.sparkSession
    answered = rows.select(mcap_band(mcap).alias("band"), outcome(label, threshold).alias("_y")).where(
        "band is not null and _y is not null"
    )
    counts = answered.groupBy("band").agg(F.count("*").alias("n"), F.sum("_y").alias("positives"))
    bands = spark.createDataFrame([(b,) for b in BANDS], "band string")
    return bands.join(counts, "band", "left").select(
        "band",
        F.coalesce("n", F.lit(0)).alias("n"),
        F.coalesce("positives", F.lit(0)).alias("positives"),
        F.try_divide(F.col("positives").cast("double"), F.col("n")).alias("base_rate"),
    )


def exit_criteria(
    snapshots: DataFrame, labels: DataFrame, social_rows: DataFrame, survival: str = "survived_7d"
) -> DataFrame:
    """One row: counts of the exit test and whether it is met."""
    counts = {
        "triggered": snapshots.agg(F.count("*").alias("triggered")),
        "lived": labels.agg(
            F.count_if(F.col(survival)).alias("survivors"), F.count_if(~F.col(survival)).alias("dead")
        ),
        "social": social.complete_series(social_rows).agg(F.count("*").alias("complete_social")),
    }
    keyed = [c.withColumn("_one", F.lit(1)) for c in counts.values()]
    one = reduce(lambda a, b: a.join(b, "_one"), keyed).drop("_one")
    per, met = stats.gate(F.col("survivors"), F.col("dead"), F.col("complete_social"))
    return one.withColumn("dead_per_survivor", per).withColumn("met", met)


def explain_gate() -> Column:
    """The exit test in one line, over an exit-criteria row."""
    return F.concat(
        F.format_string(
            f"triggered=%d complete_social=%d/{stats.MIN_COMPLETE_SERIES} dead_per_survivor=",
            "triggered",
            "complete_social",
        ),
        F.when(F.col("dead_per_survivor").isNull(), "n/a (no survivors yet)").otherwise(
            F.format_string("%.1f", "dead_per_survivor")
        ),
        F.lit(f"/{stats.MIN_DEAD_PER_SURVIVOR} -> "),
        F.when(F.col("met"), "met").otherwise("NOT met, keep collecting"),
    )


# --- rows and model -------------------------------------------------------------


def training_rows(
    first_scores: DataFrame,
    labels: DataFrame,
    label: str,
    threshold: float | None,
) -> DataFrame:
    """One row per token: its pillars at the trigger and what it did next.

    ``first_scores`` holds each token's first score row with its pillar inputs; pillars are
    recomputed so every row shares one definition. Unresolved outcomes are left out.
    """
    answers = labels.select("snapshot_id", outcome(label, threshold).alias("label")).where("label is not null")
    scored = pillars.add(first_scores.join(answers, "snapshot_id"))
    keep = [c for c in ("snapshot_id", "ts", "label", "deployer", "regime", "data_completeness") if c in scored.columns]
    return scored.select(*keep, *[F.col(f"pillar_{n}.score").alias(n) for n in pillars.NAMES])


@dataclass(frozen=True)
class Model:
    """Coefficients per pillar and per missing flag, the bias, and the means filled in."""

    weights: dict[str, float]
    bias: float
    means: dict[str, float]

    def inputs(self) -> dict[str, Column]:
        out = {}
        for n in pillars.NAMES:
            out[n] = F.coalesce(F.col(n) / 100.0, F.lit(self.means[n]))
            out[f"{n}__missing"] = F.col(n).isNull().cast("double")
        return out

    def predict(self) -> Column:
        """Probability as a column expression."""
        z = F.lit(self.bias)
        for name, x in self.inputs().items():
            z = z + F.lit(self.weights[name]) * x
        return 1.0 / (1.0 + F.exp(-F.greatest(F.lit(-60.0), F.least(F.lit(60.0), z))))


def _terms() -> list[str]:
    return [t for n in pillars.NAMES for t in (n, f"{n}__missing")]


def feature_means(train: DataFrame) -> dict[str, float]:
    """Means over present values, scaled to 0..1; 0 where a pillar never resolved."""
    row = train.agg(*[F.avg(F.col(n) / 100.0).alias(n) for n in pillars.NAMES]).first()
    return {n: row[n] if row[n] is not None else 0.0 for n in pillars.NAMES}


def fit_converged(train: DataFrame) -> Model:
    """The minimum of the objective, by Spark's own logistic regression."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    means = feature_means(train)
    blank = Model({}, 0.0, means)
    frame = train.select(F.col("label").cast("double").alias("label"), *[c.alias(n) for n, c in blank.inputs().items()])
    ready = VectorAssembler(inputCols=_terms(), outputCol="features").transform(frame)
    fitted = LogisticRegression(
        regParam=L2, elasticNetParam=0.0, standardization=False, maxIter=200, tol=1e-9
    ).fit(ready.select("label", "features"))
    return Model(dict(zip(_terms(), map(float, fitted.coefficients))), float(fitted.intercept), means)


def fit_steps(
    train: DataFrame, epochs: int = EPOCHS, rate: float = RATE, l2: float = L2, tasks: int | None = None
) -> Model:
    """Full-batch gradient steps, which stop short of the minimum as the published fit does.

    One job for all steps: the rows are dealt to ``tasks`` tasks (the session's parallelism if not
    given) that run side by side as a barrier stage. Each keeps its rows' terms as a matrix, 120
    bytes a row; in a step each sums its gradient and all exchange these sums, sixteen numbers a
    task, so every task takes the same step. A lost task restarts the stage. No rows give zeros.
    """
    means = feature_means(train)
    blank, terms = Model({}, 0.0, means), _terms()
    frame = train.select(F.col("label").cast("double").alias("label"), *[c.alias(n) for n, c in blank.inputs().items()])
    dealt = frame.repartition(tasks or train.sparkSession.sparkContext.defaultParallelism)
    schema = ", ".join(f"{c} double" for c in [*[f"w{k}" for k in range(len(terms))], "bias"])
    kind = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import BarrierTaskContext

        context = BarrierTaskContext.get()
        parts = [np.stack([b.column(c).to_numpy() for c in ("label", *terms)], axis=1) for b in batches]
        rows = np.concatenate([np.zeros((0, len(terms) + 1)), *parts])
        label, x = rows[:, 0], rows[:, 1:]
        w, bias = np.zeros(len(terms)), 0.0
        n = sum(json.loads(m) for m in context.allGather(json.dumps(len(label))))
        for _ in range(epochs if n else 0):
            error = 1.0 / (1.0 + np.exp(-np.clip(x @ w + bias, -60, 60))) - label
            mine = [*(error @ x).tolist(), float(error.sum())]
            total = np.sum([json.loads(m) for m in context.allGather(json.dumps(mine))], axis=0)
            bias -= rate * total[-1] / n
            w = w - rate * (total[:-1] / n + l2 * w)
        if context.partitionId() == 0:
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*w.tolist(), float(bias))], schema=kind)

    # One row: a limit may not stand in a barrier stage.
    fitted = dealt.mapInArrow(run, schema, barrier=True).collect()[0]
    return Model(dict(zip(terms, fitted[:-1])), fitted[-1], means)


# --- weights --------------------------------------------------------------------


def deployable(coefficients: DataFrame, groups: list[str] = (), places: int = 2) -> DataFrame:
    """(name, coefficient, pos) to non-negative weights that sum to one.

    Negative coefficients are clamped, the rest renormalised and rounded half-even, and the
    rounding residue goes to the largest weight. A group holds one row per pillar.
    """
    groups = list(groups)
    w = Window.partitionBy(*groups)
    kept = coefficients.withColumn("_raw", F.greatest(F.lit(0.0), F.coalesce("coefficient", F.lit(0.0))))
    total, n = F.sum("_raw").over(w), F.count("*").over(w)
    exact = kept.withColumn("normalised", F.when(total > 0, F.col("_raw") / total).otherwise(1.0 / n))
    rounded = exact.withColumn("_r", F.bround("normalised", places))
    largest = F.row_number().over(w.orderBy(F.desc("_r"), "pos")) == 1
    residue = F.bround(F.col("_r") + 1.0 - F.sum("_r").over(w), places)
    return rounded.select(*groups, "name", "normalised", F.when(largest, residue).otherwise(F.col("_r")).alias("weight"))


def weights_of(model: Model, spark, places: int = 2) -> dict[str, float]:
    """The fitted vector as it would be deployed: seven numbers."""
    rows = [(n, model.weights[n], i) for i, n in enumerate(pillars.NAMES)]
    frame = deployable(spark.createDataFrame(rows, "name string, coefficient double, pos int"), places=places)
    return {r["name"]: r["weight"] for r in frame.collect()}


# --- evaluation -----------------------------------------------------------------


def vector_scores(rows: DataFrame, vectors: dict[str, Column], keep: list[str]) -> DataFrame:
    """Long form: one row per (vector, token). A token without a composite ranks last."""
    last = F.lit(float("-inf"))
    entries = F.array(
        *[F.struct(F.lit(n).alias("vector"), F.coalesce(c, last).alias("score")) for n, c in vectors.items()]
    )
    return rows.select(*keep, F.explode(entries).alias("_e")).select(*keep, "_e.vector", "_e.score")


def composite_of(weights: dict[str, float]) -> Column:
    """The composite of a training row under a weight vector."""
    return pillars.composite({n: F.col(n) for n in pillars.NAMES}, weights)[0]


def ranking(long: DataFrame, groups: list[str], tie: str = "snapshot_id", ts: str = "ts", digits: int | None = None) -> DataFrame:
    """AUC with interval and decile lift with interval per group of a long frame."""
    if digits is not None:
        long = long.withColumn("score", F.round("score", digits))
    areas = stats.with_interval(stats.auc(long, groups))
    lifts = stats.decile_lift(long, groups, [F.col("score").desc(), F.col(ts), F.col(tie)])
    return areas.join(lifts, groups)


@dataclass(frozen=True)
class Fit:
    """A fitted model, its split rows, and its held-out metrics per vector."""

    model: Model
    deployed: dict[str, float]
    split: DataFrame
    metrics: DataFrame
    by_regime: DataFrame


class NotReady(RuntimeError):
    """The exit criteria are not met and the fit was not forced."""


def fit(rows: DataFrame, gate_met: bool, force: bool = False, parity: bool = False) -> Fit:
    """Split forward in time, fit on the older part, measure on the newer part.

    Refuses below the exit criteria unless forced. Measures three vectors on the same held-out
    rows: the logistic model, the weights in force, and the fitted weights as deployed.
    """
    if not gate_met and not force:
        raise NotReady("the exit criteria are not met; pass force=True to fit anyway")
    split = durable(stats.repair_leakage(stats.time_split(rows, "ts", "snapshot_id")))
    train = split.where("split = 'train'")
    model = fit_steps(train) if parity else fit_converged(train)
    deployed = weights_of(model, rows.sparkSession)
    test = split.where("split = 'test'")
    vectors = {
        "logistic_model": model.predict(),
        "in_force": composite_of(pillars.FITTED_V1),
        "deployed": composite_of(deployed),
    }
    keep = [c for c in ("snapshot_id", "ts", "label", "regime") if c in split.columns]
    long = durable(vector_scores(test, vectors, keep))
    per_regime = long.where("vector = 'logistic_model'")
    by_regime = ranking(per_regime, ["regime"]) if "regime" in keep else ranking(per_regime, ["vector"])
    return Fit(model, deployed, split, ranking(long, ["vector"]), by_regime)


def windows(split: DataFrame) -> DataFrame:
    """First and last trigger time, size and positives on each side of the split."""
    return split.groupBy("split").agg(
        F.count("*").alias("n"),
        F.sum(F.col("label").cast("bigint")).alias("positives"),
        F.min("ts").alias("from_ms"),
        F.max("ts").alias("to_ms"),
    )


def checks(metrics: DataFrame, gate_met: bool) -> DataFrame:
    """The five conditions a fitted vector must meet before it may replace the one in force."""

    def of(vector: str, column: str) -> Column:
        return F.max(F.when(F.col("vector") == vector, F.col(column)))

    one = metrics.agg(
        of("deployed", "auc").alias("_auc"),
        of("deployed", "auc_low").alias("_low"),
        of("deployed", "lift").alias("_lift"),
        of("in_force", "auc").alias("_prior"),
        of("logistic_model", "auc").alias("_model"),
        of("logistic_model", "lift").alias("_model_lift"),
        F.max("positives").alias("_pos"),
    )
    yes = F.lit(True)
    return one.select(
        F.lit(gate_met).alias("phase_0_exit_criteria_met"),
        F.coalesce(F.col("_pos") > 0, ~yes).alias("positive_events_in_test"),
        F.coalesce(F.col("_low") > 0.5, ~yes).alias("out_of_sample_auc_above_chance"),
        F.coalesce(F.col("_auc").isNotNull() & (F.col("_prior").isNull() | (F.col("_auc") > F.col("_prior"))), ~yes).alias(
            "beats_the_priors_out_of_sample"
        ),
        F.coalesce(F.col("_lift") > 1.0, ~yes).alias("top_decile_beats_base_rate"),
        F.coalesce(F.col("_model") >= stats.CONCORDANCE_BENCHMARK, ~yes).alias("beats_benchmark"),
        F.coalesce(F.col("_model_lift") > 1.0, ~yes).alias("has_measured_edge"),
    ).withColumn(
        "may_replace_priors",
        F.col("phase_0_exit_criteria_met")
        & F.col("positive_events_in_test")
        & F.col("out_of_sample_auc_above_chance")
        & F.col("beats_the_priors_out_of_sample")
        & F.col("top_decile_beats_base_rate"),
    )


def held_out_by_label(
    first_scores: DataFrame, labels: DataFrame, after_ms: int, vectors: dict[str, dict[str, float]], digits: int | None = None
) -> DataFrame:
    """Each vector on every calibration label, over tokens triggered after the training window.

    The seven labels unpivot to one long frame, so all of them are measured in one pass.
    """
    answers = F.array(
        *[F.struct(F.lit(l).alias("outcome"), outcome(l, t).alias("label")) for l, t in LABELS]
    )
    long_labels = labels.select("snapshot_id", F.explode(answers).alias("_a")).select("snapshot_id", "_a.*")
    scored = pillars.add(first_scores.where(F.col("ts") > after_ms))
    rows = scored.select("snapshot_id", "ts", *[F.col(f"pillar_{n}.score").alias(n) for n in pillars.NAMES])
    joined = rows.join(long_labels.where("label is not null"), "snapshot_id")
    long = vector_scores(joined, {v: composite_of(w) for v, w in vectors.items()}, ["snapshot_id", "ts", "outcome", "label"])
    if digits is not None:
        long = long.withColumn("score", F.round("score", digits))
    areas = stats.with_interval(stats.auc(long, ["outcome", "vector"]))
    names = rows.sparkSession.createDataFrame(
        [(l, v) for l, _ in LABELS for v in vectors], "outcome string, vector string"
    )
    return names.join(areas, ["outcome", "vector"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def verdict(metrics: DataFrame, gate_row: DataFrame, test_size: int) -> DataFrame:
    """(verdict, explanation): not ready, no measured edge, or a measured edge."""
    one = metrics.where("vector = 'logistic_model'").select("auc", "lift", "positives").withColumn("_one", F.lit(1))
    joined = gate_row.withColumn("_one", F.lit(1)).join(one, "_one", "left")
    lift = F.col("lift")
    lift_text = F.when(lift.isNull(), "undefined").otherwise(F.format_string("%.2fx", lift))
    against = F.when(F.col("auc") >= stats.CONCORDANCE_BENCHMARK, "above").otherwise("below")
    waiting = F.concat(F.lit(WAITING[0]), explain_gate(), F.lit(WAITING[1]))
    empty = EMPTY.format(n=test_size)
    flat = F.concat(F.lit(FLAT[0]), lift_text, F.lit(FLAT[1]))
    edge = F.concat(
        F.lit(EDGE[0]),
        lift_text,
        F.format_string(EDGE[1].format(n=test_size), "positives"),
        F.format_string(EDGE[2], "auc"),
        against,
        F.lit(EDGE[3].format(benchmark=stats.CONCORDANCE_BENCHMARK)),
    )
    ready, measured, some = F.col("met"), F.coalesce(lift > 1.0, F.lit(False)), F.coalesce(F.col("positives") > 0, F.lit(False))
    return joined.select(
        F.when(~ready | ~some, "not_ready").when(~measured, "no_measured_edge").otherwise("measured_edge").alias("verdict"),
        F.when(~ready, waiting).when(~some, F.lit(empty)).when(~measured, flat).otherwise(edge).alias("explanation"),
    )


def record(fitted: Fit, version: str, label: str, threshold: float | None) -> DataFrame:
    """The one-row record a weight vector is adopted from."""
    spark = fitted.split.sparkSession
    meta = spark.createDataFrame(
        [(version, label, threshold, fitted.deployed, dict(pillars.FITTED_V1), {**fitted.model.weights, "bias": fitted.model.bias})],
        "weights_version string, label string, threshold double, weights map<string,double>, "
        "replaces map<string,double>, coefficients map<string,double>",
    ).withColumn("_one", F.lit(1))
    sides = windows(fitted.split).agg(
        F.map_from_entries(F.collect_list(F.struct("split", F.struct("n", "positives", "from_ms", "to_ms")))).alias("windows")
    )
    shown = fitted.metrics.agg(
        F.map_from_entries(
            F.collect_list(F.struct("vector", F.struct("auc", "auc_low", "auc_high", "lift", "lift_low", "lift_high")))
        ).alias("out_of_sample")
    )
    one = F.lit(1).alias("_one")
    return meta.join(sides.select("*", one), "_one").join(shown.select("*", one), "_one").drop("_one")
