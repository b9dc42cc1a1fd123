"""Ridge against its closed form, dense scoring against numpy, ensembles."""

import numpy as np
import pytest

from matchlake.operators import evaluate, features, models, predict

NAMES = features.FEATURES[:4]

@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(1)
    n = 200
    x = rng.normal(5, 3, (n, 4))
    x[:, 3] = x[:, 0] - x[:, 1]  # as the difference features are
    home = x @ [1.0, -2.0, 0.5, 0.0] + 100 + rng.normal(0, 2, n)
    away = x @ [0.3, 1.0, -0.5, 0.2] + 95 + rng.normal(0, 2, n)
    rows = [(i, *map(float, x[i]), float(home[i]), float(away[i])) for i in range(n)]
    named = ", ".join(f"`{c}` double" for c in NAMES)
    schema = f"game_id long, {named}, home_score double, away_score double"
    frame = spark.createDataFrame(rows, schema).repartition(3).cache()
    return x, home, away, frame


@pytest.mark.parametrize("alpha", [1.0, 100.0])
def test_ridge_equals_closed_form(data, alpha):
    x, home, away, frame = data
    model = models.train_ridge(frame, frame, (alpha,))
    got = model.predict(frame).toPandas().sort_values("game_id")
    z = (x - x.mean(0)) / x.std(0)
    for y, column in ((home, "pred_home_score"), (away, "pred_away_score")):
        w = np.linalg.solve(z.T @ z + alpha * np.eye(4), z.T @ (y - y.mean()))
        np.testing.assert_allclose(got[column], z @ w + y.mean(), rtol=1e-6)
    assert model.names == NAMES


def test_ridge_picks_lowest_error(data):
    frame = data[3]
    model = models.train_ridge(frame, frame)
    errors = [models.train_ridge(frame, frame, (a,)).measured["avg_score_mae"] for a in models.RIDGE_ALPHAS]
    assert model.measured["avg_score_mae"] == min(errors)


@pytest.mark.parametrize("alpha", [1.0, 100.0])
def test_gradient_is_zero_at_the_optimum_only(data, alpha):
    frame = data[3]
    model = models.train_ridge(frame, frame, (alpha,))
    found = models.ridge_gradient(model, frame).collect()
    assert len(found) == 10 and max(abs(r.gradient) for r in found) < 1e-6
    model.settings["alpha"] = 3 * alpha + 50
    assert max(abs(r.gradient) for r in models.ridge_gradient(model, frame).collect()) > 1e-3


def test_trees_learn(data):
    frame = data[3]
    model = models.train_trees(frame, frame, maxIter=10)
    flat = np.mean([np.abs(y - y.mean()).mean() for y in data[1:3]])
    assert model.measured["avg_score_mae"] < flat / 2
    assert model.settings["maxDepth"] == 5 and models.TREE_SETTINGS["maxIter"] == 200


def test_dense_scores(spark, data):
    x, _, _, frame = data
    rng = np.random.default_rng(2)
    layers = [(rng.normal(size=(8, 4)), rng.normal(size=8)), (rng.normal(size=(2, 8)), rng.normal(size=2))]
    weights = models.DenseWeights(layers, x.mean(0), x.std(0), np.array([100.0, 90.0]), np.array([10.0, 9.0]))
    got = models.score_dense(frame, NAMES, weights).toPandas().sort_values("game_id")
    z = (x - x.mean(0)) / x.std(0)
    want = (np.maximum(z @ layers[0][0].T + layers[0][1], 0) @ layers[1][0].T + layers[1][1]) * [10, 9] + [100, 90]
    np.testing.assert_allclose(got[["pred_home_score", "pred_away_score"]], want, rtol=1e-9)


def test_ensemble_uses_present_members(spark):
    p = spark.createDataFrame(
        [(1, "L", 100.0, 90.0), (1, "T", 110.0, 94.0), (2, "L", 99.0, 98.0), (1, "other", 0.0, 0.0)],
        "game_id long, predictor string, pred_home_score double, pred_away_score double",
    )
    got = {r.game_id: (r.pred_home_score, r.pred_away_score, r.members) for r in predict.ensemble(p, ["L", "T", "M"]).collect()}
    assert got == {1: (105.0, 92.0, 2), 2: (99.0, 98.0, 1)}


def test_metrics(spark):
    rows = spark.createDataFrame(
        [(100, 90, 98.0, 95.0), (80, 80, 90.0, 70.0), (95, 99, 93.0, 100.0)],
        "home_score int, away_score int, pred_home_score double, pred_away_score double",
    )
    m = evaluate.metrics(rows).first()
    assert (m.home_mae, m.away_mae, m.avg_score_mae) == (4.667, 5.333, 5.0)
    assert (m.margin_mae, m.total_mae, m.n_samples) == (10.0, 1.333, 3)
    assert m.win_accuracy == 0.6667  # a tie is not a home win
    margins, won = np.array([3.0, 20.0, -7.0]), np.array([1, 0, 0])
    p = np.clip(1 / (1 + np.exp(-0.15 * margins)), 0.001, 0.999)
    assert m.brier_score == round(float(np.mean((p - won) ** 2)), 4)
    assert m.log_loss == round(float(-np.mean(won * np.log(p) + (1 - won) * np.log(1 - p))), 4)
