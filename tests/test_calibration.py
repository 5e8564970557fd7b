"""The fit, its weights and its refusals."""

import numpy as np
import pytest

from tidewatch.operators import pillars
from tidewatch.plans import calibration


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    out = []
    for i in range(240):
        f = [None if rng.random() < 0.15 else float(rng.uniform(0, 100)) for _ in pillars.NAMES]
        strength = (f[3] or 50) / 25 - 2
        out.append((f"s{i:04d}", i, int(rng.random() < 1 / (1 + np.exp(-strength))), f"d{i}", "neutral", *f))
    names = ", ".join(f"{n} double" for n in pillars.NAMES)
    return spark.createDataFrame(out, f"snapshot_id string, ts int, label int, deployer string, regime string, {names}")


def brute_steps(pdf, epochs):
    names = list(pillars.NAMES)
    means = {n: np.nanmean(pdf[n].astype(float) / 100) for n in names}
    cols = []
    for n in names:
        v = pdf[n].astype(float) / 100
        cols += [v.fillna(means[n]), v.isna().astype(float)]
    x, y = np.column_stack(cols), pdf["label"].to_numpy()
    w, b = np.zeros(x.shape[1]), 0.0
    for _ in range(epochs):
        e = 1 / (1 + np.exp(-(x @ w + b))) - y
        b -= 0.3 * e.mean()
        w = w - 0.3 * (e @ x / len(y) + 0.01 * w)
    return w, b


def test_gradient_steps_match_numpy(spark, rows):
    model = calibration.fit_steps(rows, epochs=4)
    w, b = brute_steps(rows.toPandas(), 4)
    assert model.bias == pytest.approx(b)
    assert list(model.weights.values()) == pytest.approx(list(w))


def test_converged_fit_is_the_limit_of_the_steps(spark, rows):
    model = calibration.fit_converged(rows)
    w, b = brute_steps(rows.toPandas(), 60000)
    assert list(model.weights.values()) == pytest.approx(list(w), abs=2e-3)


def test_fit_refuses_below_the_gate(spark, rows):
    with pytest.raises(calibration.NotReady):
        calibration.fit(rows, gate_met=False)


def test_forced_fit_reports_every_vector(spark, rows):
    fitted = calibration.fit(rows, gate_met=False, force=True)
    got = {r["vector"]: r for r in fitted.metrics.collect()}
    assert set(got) == {"logistic_model", "in_force", "deployed"}
    assert got["logistic_model"]["n"] == 72
    assert got["deployed"]["auc"] > 0.6
    assert sum(fitted.deployed.values()) == pytest.approx(1.0)
    c = calibration.checks(fitted.metrics, gate_met=False).first()
    assert c["positive_events_in_test"] and not c["may_replace_priors"]


def test_weights_clamp_and_sum_to_one(spark):
    coef = [("a", 1.0, 0), ("b", 1.0, 1), ("c", 1.0, 2), ("d", -4.0, 3)]
    got = {r["name"]: r["weight"] for r in calibration.deployable(spark.createDataFrame(coef, "name string, coefficient double, pos int")).collect()}
    assert got == {"a": 0.34, "b": 0.33, "c": 0.33, "d": 0.0}
    none = [("a", -1.0, 0), ("b", -1.0, 1)]
    got = {r["name"]: r["weight"] for r in calibration.deployable(spark.createDataFrame(none, "name string, coefficient double, pos int")).collect()}
    assert got == {"a": 0.5, "b": 0.5}
