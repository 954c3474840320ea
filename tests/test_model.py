import math
import re
from collections import Counter

import numpy as np
import pytest
from frames import rows
from pyspark.sql import functions as F

from revtide.operators import graph, model, rollup


def test_constant_missing_and_nan_features(spark):
    frame = spark.createDataFrame(
        [(1.0, 1.0, 1.0, 0), (1.0, 2.0, None, 0), (1.0, 3.0, float("nan"), 1), (1.0, 5.0, 4.0, 1), (1.0, 1.0, 7.0, 1)],
        "constant double, x double, holes double, label int",
    )
    got = {r.feature: r.score for r in model.feature_correlations(frame, ["constant", "x", "holes"]).collect()}
    assert got["constant"] is None
    assert got["x"] == pytest.approx(np.corrcoef([1, 2, 3, 5, 1], [0, 0, 1, 1, 1])[0, 1])
    assert got["holes"] == pytest.approx(np.corrcoef([1, 4, 7], [0, 1, 1])[0, 1])
    top = model.top_correlations(model.feature_correlations(frame, ["constant", "x", "holes"]), 3)
    assert [r.feature for r in top.collect()] == ["holes", "x", "constant"]


def _auc(pairs):
    pos = [s for s, y in pairs if y == 1]
    neg = [s for s, y in pairs if y == 0]
    return sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))


def test_auc_counts_ties_half_and_ignores_monotone_maps(spark):
    rng = np.random.default_rng(1)
    pairs = [(float(s), int(y)) for s, y in zip(rng.integers(0, 40, 500) / 7, rng.integers(0, 2, 500))]
    frame = spark.createDataFrame(pairs, "score double, label int")
    assert model.roc_auc(frame).first().roc_auc == pytest.approx(_auc(pairs))
    mapped = frame.withColumn("score", F.exp("score") - 3)
    assert model.roc_auc(mapped).first().roc_auc == pytest.approx(_auc(pairs))


def test_auc_with_one_class_is_unknown(spark):
    frame = spark.createDataFrame([(0.1, 1), (0.4, 1)], "score double, label int")
    assert model.roc_auc(frame).first().roc_auc is None


def test_auc_on_one_heavy_score(spark):
    pairs = [(0.0, i % 2) for i in range(300)] + [(i / 10, int(i > 3)) for i in range(10)]
    frame = spark.createDataFrame(pairs, "score double, label int")
    assert model.roc_auc(frame).first().roc_auc == pytest.approx(_auc(pairs))


def test_split_is_fixed_and_near_its_ratio(spark):
    frame = spark.range(4000).select(F.col("id").alias("k"))
    one = rows(model.train_test_split(frame, ["k"]), "k", "is_test")
    assert one == rows(model.train_test_split(frame.repartition(3), ["k"]), "k", "is_test")
    assert 0.22 < sum(t for _, t in one) / 4000 < 0.28


def test_scaling_uses_training_rows_and_population_deviation(spark):
    frame = spark.createDataFrame([(1.0, 2.0, True), (3.0, 2.0, True), (9.0, 2.0, False)], "x double, c double, fit boolean")
    got = model.standard_scale(frame, ["x", "c"], F.col("fit"))
    assert rows(got, "x", "c") == [(-1.0, 0.0), (1.0, 0.0), (7.0, 0.0)]


def test_logistic_regression_against_newton(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 2))
    y = (rng.random(300) < 1 / (1 + np.exp(-(0.8 * x[:, 0] - 0.5 * x[:, 1] + 0.3)))).astype(int)
    frame = spark.createDataFrame([(float(a), float(b), int(c)) for (a, b), c in zip(x, y)], "a double, b double, label int")
    fitted = model.fit_logistic(frame, ["a", "b"])
    # Minimise |w|^2 / 2 + C * sum(loss), intercept free, by Newton steps.
    design, w = np.c_[x, np.ones(300)], np.zeros(3)
    penalty = np.diag([1.0, 1.0, 0.0]) / model.INVERSE_PENALTY
    for _ in range(30):
        p = 1 / (1 + np.exp(-design @ w))
        w -= np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + penalty, design.T @ (p - y) + penalty @ w)
    assert fitted.weights == pytest.approx([w[2], w[0], w[1]], abs=1e-9) and fitted.decrement < 1e-8
    gradient, curvature = model.loss_terms(frame, ["a", "b"], fitted.weights)
    assert np.abs(gradient).max() < 1e-8 and np.linalg.eigvalsh(curvature).min() > 0
    scored = model.score_logistic(fitted, frame, ["a", "b"])
    assert all((r.score > 0.5) == (r.prediction == 1) for r in scored.collect())


def test_rows_of_one_class_get_their_class(spark):
    frame = spark.createDataFrame([(1.0, 1), (2.0, 1)], "a double, label int")
    scored = model.score_logistic(model.fit_logistic(frame, ["a"]), frame, ["a"])
    assert rows(scored, "score", "prediction") == [(1.0, 1), (1.0, 1)]


def test_auc_per_group_over_many_slices(spark):
    rng = np.random.default_rng(9)
    groups = {}
    for g in range(10):
        scores = rng.integers(0, 60, 80) * 10.0 ** (g - 5)
        groups[None if g == 3 else g] = [(float(s), int(y)) for s, y in zip(scores, rng.integers(0, 2, 80))]
    frame = spark.createDataFrame([(g, s, y) for g, pairs in groups.items() for s, y in pairs], "g int, score double, label int")
    got = {r.g: r.roc_auc for r in model.roc_auc(frame, ["g"], rows_per_slice=4).collect()}
    assert got == pytest.approx({g: _auc(pairs) for g, pairs in groups.items()})


def test_metrics(spark):
    frame = spark.createDataFrame([(1, 1), (1, 0), (0, 1), (0, 0), (1, 1)], "label int, prediction int")
    got = model.f1_accuracy(frame).first()
    assert (got.f1, got.accuracy, got.n) == (pytest.approx(2 / 3), 0.6, 5)
    assert rows(model.confusion_matrix(frame), "y_true", "predicted_0", "predicted_1") == [(0, 1, 1), (1, 1, 2)]
    assert model.f1_accuracy(frame.filter("label = 0").withColumn("prediction", F.lit(0))).first().f1 == 0.0


def test_single_row_has_no_deviation(spark):
    frame = spark.createDataFrame([("a", 2.0), ("b", 1.0), ("b", 3.0)], "k string, x double")
    assert rows(rollup.rollup(frame, ["x"], ["k"]).filter("k = 'b'"), "mean_x", "std_x", "max_x") == [(2.0, math.sqrt(2), 3.0)]
    assert rollup.rollup(frame, ["x"], ["k"]).filter("k = 'a'").first().std_x is None


def test_union_fills_missing_columns(spark):
    a, b = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([(2, 5)], "x int, y int")
    assert rows(rollup.labelled_union(a, b).na.fill(-1), "x", "label", "y") == [(1, 0, -1), (2, 1, 5)]


def _graph(spark):
    vertices = spark.createDataFrame([("g", 1, 1.0), ("g", 2, 2.0), ("g", 3, 4.0)], "k string, event_user_id long, x double")
    directed = spark.createDataFrame(
        [("g", 1, 2, 0.5, 0.1), ("g", 2, 1, 0.25, 0.2), ("g", 1, 3, 0.5, 0.9)],
        "k string, event_user_id long, event_user_id_r long, coedit_ratio double, coedit_revisions_ratio double",
    )
    v = graph.graph_vertices(vertices.union(spark.createDataFrame([("lonely", 9, 1.0)], vertices.schema)), directed, ["x"], ["k"])
    return v, graph.graph_self_loops(graph.graph_edges(directed, ["k"]), v, ["k"])


def test_propagation_against_matrices(spark):
    v, e = _graph(spark)
    assert rows(v, "vertex") == [(1,), (2,), (3,)]
    a = np.array([[1, 1, 0], [1, 1, 0], [1, 0, 1]], float)  # a[v, u] for u -> v, loops included
    norm = a / np.sqrt(np.outer(a.sum(1), a.sum(0)))
    expected = np.linalg.matrix_power(norm, 3) @ np.array([1.0, 2.0, 4.0])
    got = rows(graph.graph_propagate(v, e, ["x"], 3, ["k"]), "vertex", "x")
    assert [x for _, x in got] == pytest.approx(expected)
    readout = graph.graph_readout(graph.graph_propagate(v, e, ["x"], 3, ["k"]), ["x"], ["k"]).first()
    assert readout.mean_x == pytest.approx(expected.mean())


def test_message_sums(spark):
    v, e = _graph(spark)
    got = rows(graph.graph_message_sum(v, e, ["x"], ["k"]), "vertex", "sum_x", "sum_coedit_ratio")
    assert got == [(1, 3.0, 0.25), (2, 3.0, 0.5), (3, 5.0, 0.5)]


@pytest.mark.parametrize("limits", [{"edges_per_bucket": 1}, {"max_broadcast": 0}])
def test_graphs_of_any_size_and_number_give_the_same_sums(spark, limits):
    rng = np.random.default_rng(3)
    # One graph holds most edges, and one vertex a third of them; two graphs share their vertex ids.
    ends = [("big", 0, int(v)) for v in range(60)] + [("big", int(a), int(b)) for a, b in rng.integers(0, 60, (100, 2))]
    ends = sorted({*ends, ("small", 0, 1), ("small", 1, 0), ("unknown", 5, 6)})
    edges = spark.createDataFrame([(k, a, b, 0.5, 0.25) for k, a, b in ends], "k string, src long, dst long, coedit_ratio double, coedit_revisions_ratio double")
    points = {("big", v): float(v) for v in range(60)} | {("small", 0): 1.0, ("small", 1): 3.0, ("alone", 7): 2.0}
    vertices = spark.createDataFrame([(*p, x) for p, x in points.items()], "k string, vertex long, x double")
    tables = graph.graph_tables(vertices, edges, ["x"], ["k"], **limits)

    known_ends = [(k, a, b) for k, a, b in ends if k != "unknown"]
    out, into = Counter((k, a) for k, a, _ in known_ends), Counter((k, b) for k, _, b in known_ends)
    state = points
    for _ in range(2):
        sums = dict.fromkeys(points, 0.0)
        for k, a, b in known_ends:
            sums[k, b] += state[k, a] / math.sqrt(out[k, a] * into[k, b])
        state = sums
    got = {(r.k, r.vertex): r.x for r in graph.propagate(tables, ["x"], 2).collect()}
    assert got == pytest.approx(state)
    sums = {(r.k, r.vertex): (r.sum_x, r.sum_coedit_ratio) for r in graph.message_sum(tables, ["x"]).collect()}
    assert sums == {
        (k, v): (sum(points[k, a] for j, a, b in known_ends if (j, b) == (k, v)), n / 2) for (k, v), n in into.items()
    }


def test_edges_are_not_shuffled_once_written(spark):
    v, e = _graph(spark)
    tables = graph.graph_tables(v, e, ["x"], ["k"])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rounds = graph.propagate(tables, ["x"], 3)
        plan = rounds._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # One exchange a round, of sums already combined; the fourth sends the numbers of the graphs.
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 3 and "Sort " not in plan
    for found in re.finditer(r"Exchange hashpartitioning.*\n.*", plan):
        assert "partial_sum" in found.group()


def test_empty_graphs(spark):
    vertices = spark.createDataFrame([], "k string, vertex long, x double")
    edges = spark.createDataFrame([], "k string, src long, dst long, coedit_ratio double, coedit_revisions_ratio double")
    assert graph.graph_propagate(vertices, edges, ["x"], 2, ["k"]).count() == 0
    assert graph.graph_message_sum(vertices, edges, ["x"], ["k"]).count() == 0
