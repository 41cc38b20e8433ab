"""Clustering scores: fixed cases, and brute force on random partitions."""

from itertools import combinations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from blockwise.operators import analysis, labels, metrics

KEYS = ["name"]


def labelled(spark, groups, name="b"):
    return spark.createDataFrame([(name, p, str(i)) for i, g in enumerate(groups) for p in g], "name string, paper_id string, label string")


def score(spark, truth, pred):
    r = metrics.scores(labelled(spark, truth), labelled(spark, pred), KEYS).first()
    return (r.pairwise_precision, r.pairwise_recall, r.pairwise_f1), (r.b3_precision, r.b3_recall, r.b3_f1)


TRUTH = [["p1", "p2"], ["p3", "p4"]]


@pytest.mark.parametrize("pred, pair, b3", [
    (TRUTH, (1, 1, 1), (1, 1, 1)),
    ([["p1"], ["p2"], ["p3"], ["p4"]], (0, 0, 0), (1, 0.5, 2 / 3)),
    ([["p1", "p2", "p3", "p4"]], (1 / 3, 1, 0.5), (0.5, 1, 2 / 3)),
])
def test_fixed_cases(spark, pred, pair, b3):
    a, b = score(spark, TRUTH, pred)
    assert a == pytest.approx(pair) and b == pytest.approx(b3)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 4), st.integers(0, 3)), min_size=1, max_size=25))
def test_against_brute_force(spark, rows):
    ids = [f"p{i:02}" for i in range(len(rows))]
    t, p, w = ({i: r[k] for i, r in zip(ids, rows)} for k in range(3))
    frame = lambda m: spark.createDataFrame([("b", i, str(v)) for i, v in m.items()], "name string, paper_id string, label string")
    pairs = list(combinations(ids, 2))
    tp = sum(t[a] == t[b] and p[a] == p[b] for a, b in pairs)
    pp, tt = sum(p[a] == p[b] for a, b in pairs), sum(t[a] == t[b] for a, b in pairs)
    r = metrics.scores(frame(t), frame(p), KEYS).first()
    assert r.pairwise_precision == pytest.approx(tp / pp if pp else 0)
    assert r.pairwise_recall == pytest.approx(tp / tt if tt else 0)
    b3 = sum(sum(t[a] == t[b] and p[a] == p[b] for b in ids) / sum(p[a] == p[b] for b in ids) for a in ids) / len(ids)
    assert r.b3_precision == pytest.approx(b3)
    got = analysis.repair_counts(frame(t), frame(w), frame(p), KEYS).first()
    want = {"fixed_false_splits": 0, "fixed_false_merges": 0, "introduced_false_splits": 0, "introduced_false_merges": 0, "unchanged_pairs": 0}
    for a, b in pairs:
        gt, ws, fs = t[a] == t[b], w[a] == w[b], p[a] == p[b]
        want["unchanged_pairs" if ws == fs else "fixed_false_splits" if gt and fs else "fixed_false_merges" if not gt and ws else "introduced_false_splits" if gt else "introduced_false_merges"] += 1
    assert {k: got[k] for k in want} == want


def clusters(spark, groups):
    return spark.createDataFrame([("b", i, j, p) for i, g in enumerate(groups) for j, p in enumerate(g)], "name string, cluster_index int, pos int, paper_id string")


def universe(spark, ids):
    return spark.createDataFrame([("b", i) for i in ids], "name string, paper_id string")


@pytest.mark.parametrize("groups, ids, status", [
    ([["p1", "p1", "p2"]], ["p1", "p2"], "ok"),
    ([["p1", "p2"], ["p2", "p3"]], ["p1", "p2", "p3"], "repeated"),
    ([["p1"]], ["p1", "p2"], "missing"),
    ([["p1", "x"]], ["p1"], "unknown"),
])
def test_violations(spark, groups, ids, status):
    v = labels.violations(clusters(spark, groups), universe(spark, ids), KEYS).first()
    assert v.status == status
    assert v.first_missing == ("p2" if status == "missing" else "")


def test_empty_clustering_and_labels(spark):
    none = clusters(spark, [["p1"]]).where("false")
    assert labels.violations(none, universe(spark, ["p1"]), KEYS).first().status == "empty"
    g = labels.normalized_groups(clusters(spark, [["p1", "x"], ["p1", "p2"]]), universe(spark, ["p1", "p2", "p3"]), KEYS)
    assert {r.paper_id: r.label for r in g.collect()} == {"p1": "0", "p2": "1", "p3": "missing:p3"}
    assert metrics.macro_average(none.selectExpr("1.0 as pairwise_f1")).first().macro_average == 0.0


def test_one_to_one_guard(spark):
    a = spark.createDataFrame([("x", 1), ("x", 2)], "name string, v int")
    b = spark.createDataFrame([("x", 3)], "name string, w int")
    with pytest.raises(Exception, match="more than once"):
        labels.require_one_to_one(a, b, KEYS).collect()
    with pytest.raises(ValueError):
        labels.require_count(b, 80)
