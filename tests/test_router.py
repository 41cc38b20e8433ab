"""Fits of the reliability model."""

import numpy as np
import pytest

from blockwise.operators import router as rt
from blockwise.plans import q_runs


@pytest.fixture
def blocks(spark):
    rng = np.random.default_rng(3)
    n = 80
    x = rng.normal(size=(n, len(rt.FEATURES))) * rng.uniform(0.1, 5, len(rt.FEATURES)) + 2
    x[:, 3] = 1.0
    y = (x[:, 0] + rng.normal(size=n) > 1.5).astype(int)
    rows = [(f"n{i}", float(rng.uniform()), int(y[i]), int(1 - y[i]), *[None if rng.uniform() < 0.1 else float(v) for v in x[i]]) for i in range(n)]
    return spark.createDataFrame(rows, "name string, b3_f1 double, reliable_085 int, hard_080 int, " + ", ".join(f"{c} double" for c in rt.FEATURES)), rows


def test_all_fits_share_their_passes(spark, blocks):
    sc = spark.sparkContext
    sc.setJobGroup("fits", "")
    try:
        rt.cross_validated(blocks[0])
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert len(sc.statusTracker().getJobIdsForGroup("fits")) < 40


def test_a_fit_is_the_minimum_of_the_penalized_loss(spark, blocks):
    model = {r.feature: r for r in rt.fit_model(blocks[0], rt.FEATURES).collect()}
    x = np.array([[np.nan if v is None else v for v in r[4:]] for r in blocks[1]])
    y = np.array([r[2] for r in blocks[1]])
    median = np.nanmedian(x, 0)
    x = np.where(np.isnan(x), median, x)
    scale = np.where(x.std(0) < 1e-12, 1.0, x.std(0))
    assert np.allclose([model[c].median for c in rt.FEATURES], median) and np.allclose([model[c].mean for c in rt.FEATURES], x.mean(0)) and np.allclose([model[c].scale for c in rt.FEATURES], scale)
    x = np.c_[(x - x.mean(0)) / scale, np.ones(len(x))]
    at = np.array([model[c].coefficient for c in (*rt.FEATURES, rt.CONSTANT)])
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    slope = x.T @ (w * (1 / (1 + np.exp(-x @ at)) - y)) + np.append(at[:-1], 0)
    assert np.abs(slope).max() < 1e-6


def test_one_class_only_gives_its_share(spark, blocks):
    one = blocks[0].where("reliable_085 = 1")
    assert {r.predicted_probability for r in rt.predict(rt.fit_model(one, rt.FEATURES), one).collect()} == {1.0}


def test_features_are_finished_and_their_files_released_before_the_runs(spark, data, monkeypatch):
    order = []
    note = lambda what, rows, schema: lambda *_: (order.append(what), spark.createDataFrame(rows, schema))[1]
    monkeypatch.setattr(rt, "block_features", note("features", [("n", 1.0)], "name string, paper_count double"))
    monkeypatch.setattr(q_runs, "release", lambda _: order.append("release"))
    monkeypatch.setattr(q_runs, "runs", note("runs", [("first", "n", 0.9)], "run_id string, name string, b3_f1 double"))
    assert q_runs.labelled_features(spark, data).count() == 1 and order == ["features", "release", "runs"]
