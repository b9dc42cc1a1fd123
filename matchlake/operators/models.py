"""Trained score predictors on Spark ML, and scoring of a stored dense network."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchlake.functions.seasons import COUNTED_SEASON_TYPES
from matchlake.operators.evaluate import metrics
from matchlake.operators.features import FEATURES
from matchlake.operators.predict import with_win_probability
from matchlake.sources.shared import shared_folder

# The penalties tried and the settings of boosted trees.
RIDGE_ALPHAS = (1.0, 10.0, 100.0)
TREE_SETTINGS = {
    "maxIter": 200,
    "maxDepth": 5,
    "stepSize": 0.1,
    "subsamplingRate": 0.8,
    "featureSubsetStrategy": "0.8",
    "seed": 42,
}
TARGETS = ("home", "away")


def _side_by_side(spark: SparkSession, fit: Callable, jobs: list[tuple]) -> list:
    """Fit independent models at the same time; each fit is a Spark job of its own."""
    run = inheritable_thread_target(spark)(fit)
    with ThreadPoolExecutor(len(jobs)) as pool:
        return list(pool.map(lambda job: run(*job), jobs))


def modeling_table(
    games: DataFrame, finals: DataFrame, features: DataFrame, seasons: list[str] | None = None
) -> DataFrame:
    """Finalized counted games with final scores and their features as columns."""
    kept = games.filter(
        F.col("season_type").isin(*COUNTED_SEASON_TYPES)
        & F.col("game_data_finalized")
        & F.col("pre_game_data_finalized")
    )
    if seasons is not None:
        kept = kept.filter(F.col("season").isin(seasons))
    scores = finals.select(
        "game_id",
        "home_score",
        "away_score",
        (F.col("home_score") + F.col("away_score")).alias("total"),
        (F.col("home_score") - F.col("away_score")).alias("home_margin"),
    )
    return (
        kept.select("game_id", "start", "home_team", "away_team", "season", "season_type")
        .join(scores, "game_id")
        .join(features, "game_id")
    )


def feature_columns(table: DataFrame) -> list[str]:
    return [c for c in FEATURES if c in table.columns]


def complete_rows(table: DataFrame) -> DataFrame:
    """Training drops rows with any null; scoring fills features with 0 instead."""
    return table.dropna()


def fill_features(rows: DataFrame, names: list[str]) -> DataFrame:
    return rows.fillna(0, names)


@dataclass
class ScoreModel:
    """One fitted pipeline per side, and the metrics on the test rows."""

    sides: dict[str, Transformer]
    names: list[str]
    measured: dict
    settings: dict

    def score(self, rows: DataFrame) -> DataFrame:
        out = fill_features(rows, self.names)
        for side, model in self.sides.items():
            out = model.transform(out).withColumnRenamed(
                f"pred_{side}", f"pred_{side}_score"
            ).drop("features_raw", "features")
        return out

    def predict(self, rows: DataFrame) -> DataFrame:
        scored = self.score(rows)
        return with_win_probability(
            scored.select("game_id", "pred_home_score", "pred_away_score")
        )


def _measure(model: ScoreModel, test: DataFrame) -> dict:
    return metrics(model.score(test)).first().asDict()


def _prepared(names: list[str]) -> list:
    return [
        VectorAssembler(inputCols=names, outputCol="features_raw"),
        StandardScaler(
            inputCol="features_raw", outputCol="features", withMean=True, withStd=True
        ),
    ]


def train_ridge(
    train: DataFrame, test: DataFrame, alphas: tuple[float, ...] = RIDGE_ALPHAS
) -> ScoreModel:
    """Scaled ridge per side; the alpha with the lowest mean error on ``test``.

    The penalty is scaled to act as alpha on the squared error itself: the scaler
    divides by the sample deviation instead of the population one, and the solver
    works on the mean squared error of the label divided by its deviation.
    """
    names = feature_columns(train)
    prepare = Pipeline(stages=_prepared(names)).fit(train)
    ready = prepare.transform(train)
    facts = train.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.stddev_pop(f"{side}_score").alias(side) for side in TARGETS],
    ).first()
    n = facts["n"]

    def fit(alpha: float, side: str) -> PipelineModel:
        line = LinearRegression(
            featuresCol="features",
            labelCol=f"{side}_score",
            predictionCol=f"pred_{side}",
            elasticNetParam=0.0,
            regParam=alpha * (n - 1) / n**2 * facts[side],
            standardization=False,
            solver="normal",
        )
        return PipelineModel([*prepare.stages, line.fit(ready)])

    jobs = [(alpha, side) for alpha in alphas for side in TARGETS]
    fitted = dict(zip(jobs, _side_by_side(train.sparkSession, fit, jobs)))
    best = None
    for alpha in alphas:
        sides = {side: fitted[alpha, side] for side in TARGETS}
        model = ScoreModel(sides, names, {}, {"alpha": alpha})
        model.measured = _measure(model, test)
        if best is None or model.measured["avg_score_mae"] < best.measured["avg_score_mae"]:
            best = model
    return best


def ridge_gradient(model: ScoreModel, train: DataFrame) -> DataFrame:
    """Gradient of the penalised squared error at the fitted weights, over the rows' number.

    One row per side and feature, and one per side for the intercept; all are zero
    at the optimum. Weights are those of features divided by their sample deviation.
    """
    out = None
    for side, fitted in model.sides.items():
        line = fitted.stages[-1]
        rows = fitted.transform(train).select(
            (F.col(f"{side}_score") - F.col(f"pred_{side}")).alias("rest"),
            vector_to_array("features").alias("z"),
        )
        fitted_weights = [float(w) for w in line.coefficients]
        sums = rows.agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("rest").alias("intercept"),
            *[F.sum(F.col("rest") * F.col("z")[j]).alias(f"s{j}") for j in range(len(model.names))],
        )
        n, alpha = F.col("n"), model.settings["alpha"]
        parts = [
            F.struct(F.lit(name).alias("feature"), (alpha * (n - 1) / n * w - F.col(f"s{j}")).alias("sum"))
            for j, (name, w) in enumerate(zip(model.names, fitted_weights, strict=True))
        ]
        parts.append(F.struct(F.lit("intercept").alias("feature"), (-F.col("intercept")).alias("sum")))
        side_rows = sums.select("n", F.explode(F.array(*parts)).alias("p")).select(
            F.lit(side).alias("side"), "p.feature", "n", (F.col("p.sum") / n).alias("gradient")
        )
        out = side_rows if out is None else out.unionByName(side_rows)
    return out


def gain_over_mean(model: ScoreModel, rows: DataFrame) -> DataFrame:
    """Per side the number of rows and the mean absolute errors of model and plain mean."""
    scored = model.score(rows)
    means = rows.agg(*[F.avg(f"{side}_score").alias(side) for side in TARGETS]).first()
    out = None
    for side in TARGETS:
        actual = F.col(f"{side}_score")
        one = scored.agg(
            F.lit(side).alias("side"),
            F.count(F.lit(1)).alias("n"),
            F.avg(F.abs(actual - F.col(f"pred_{side}_score"))).alias("model_mae"),
            F.avg(F.abs(actual - means[side])).alias("mean_mae"),
        )
        out = one if out is None else out.unionByName(one)
    return out


def train_trees(train: DataFrame, test: DataFrame, **settings) -> ScoreModel:
    """Boosted regression trees per side."""
    names = feature_columns(train)
    chosen = TREE_SETTINGS | settings
    prepare = Pipeline(stages=_prepared(names)).fit(train)
    ready = prepare.transform(train)
    shared_folder(train.sparkSession)  # long boosting runs checkpoint there

    def fit(side: str) -> PipelineModel:
        trees = GBTRegressor(
            featuresCol="features",
            labelCol=f"{side}_score",
            predictionCol=f"pred_{side}",
            **chosen,
        )
        return PipelineModel([*prepare.stages, trees.fit(ready)])

    fitted = _side_by_side(train.sparkSession, fit, [(side,) for side in TARGETS])
    sides = dict(zip(TARGETS, fitted))
    model = ScoreModel(sides, names, {}, chosen)
    model.measured = _measure(model, test)
    return model


@dataclass(frozen=True)
class DenseWeights:
    """Layers (weight of shape out × in, bias) and both normalisations."""

    layers: list[tuple[np.ndarray, np.ndarray]]
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    y_mean: np.ndarray | None = None
    y_std: np.ndarray | None = None

    def forward(self, x: np.ndarray) -> np.ndarray:
        if self.mean is not None:
            x = (x - self.mean) / self.scale
        for i, (weight, bias) in enumerate(self.layers):
            x = x @ weight.T + bias
            if i < len(self.layers) - 1:
                x = np.maximum(x, 0.0)
        return x if self.y_mean is None else x * self.y_std + self.y_mean


def score_dense(rows: DataFrame, names: list[str], weights: DenseWeights) -> DataFrame:
    """Score batches in Python workers. The weights are a few thousand numbers,
    fixed by the network's shape, and travel with the task."""

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            y = weights.forward(batch[names].to_numpy(dtype="float64"))
            yield pd.DataFrame(
                {
                    "game_id": batch["game_id"],
                    "pred_home_score": y[:, 0],
                    "pred_away_score": y[:, 1],
                }
            )

    key = rows.schema["game_id"].dataType.simpleString()
    filled = fill_features(rows.select("game_id", *names), names)
    return with_win_probability(
        filled.mapInPandas(
            score, f"game_id {key}, pred_home_score double, pred_away_score double"
        )
    )
