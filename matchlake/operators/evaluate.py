"""Scores of predictions against results, rankings and the model list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchlake.functions.probability import EVALUATION_SLOPE

_HIGH = 0.999


def _log_loss(truth: Column, chance: Column) -> Column:
    return -(truth * F.log(chance) + (1 - truth) * F.log(1 - chance))


def metrics(rows: DataFrame, *by: str) -> DataFrame:
    """Eleven metrics of (home_score, away_score) vs the predicted scores.

    The win chance here is the evaluation curve (slope 0.15, no intercept), not
    the one predictions are served with.
    """
    miss_home = F.col("pred_home_score") - F.col("home_score")
    miss_away = F.col("pred_away_score") - F.col("away_score")
    margin = F.col("pred_home_score") - F.col("pred_away_score")
    won = (F.col("home_score") > F.col("away_score")).cast("double")
    chance = 1 / (1 + F.exp(-EVALUATION_SLOPE * margin))
    chance = F.least(F.greatest(chance, F.lit(1 - _HIGH)), F.lit(_HIGH))
    sure = rows.withColumns({"__won": won, "__chance": chance, "__mh": miss_home, "__ma": miss_away})
    home, away = F.avg(F.abs("__mh")), F.avg(F.abs("__ma"))
    return sure.groupBy(*by).agg(
        F.round(home, 3).alias("home_mae"),
        F.round(away, 3).alias("away_mae"),
        F.round((home + away) / 2, 3).alias("avg_score_mae"),
        F.round(F.sqrt(F.avg(F.col("__mh") * F.col("__mh"))), 3).alias("home_rmse"),
        F.round(F.sqrt(F.avg(F.col("__ma") * F.col("__ma"))), 3).alias("away_rmse"),
        F.round(F.avg(F.abs(F.col("__mh") - F.col("__ma"))), 3).alias("margin_mae"),
        F.round(F.avg(F.abs(F.col("__mh") + F.col("__ma"))), 3).alias("total_mae"),
        F.round(F.avg(((margin > 0).cast("double") == F.col("__won")).cast("int")), 4).alias(
            "win_accuracy"
        ),
        F.round(F.avg((F.col("__chance") - F.col("__won")) * (F.col("__chance") - F.col("__won"))), 4).alias(
            "brier_score"
        ),
        F.round(F.avg(_log_loss(F.col("__won"), F.col("__chance"))), 4).alias("log_loss"),
        F.count(F.lit(1)).alias("n_samples"),
    )


def leaderboard(measured: DataFrame) -> DataFrame:
    """Models by rising average error; the input has one row per model."""
    order = Window.orderBy("avg_score_mae", "model")
    return measured.select(
        F.row_number().over(order).alias("rank"),
        "model",
        "avg_score_mae",
        "margin_mae",
        "win_accuracy",
        "brier_score",
        "home_mae",
        "away_mae",
        "total_mae",
        "n_samples",
    )


def scored_predictions(
    predictions: DataFrame, games: DataFrame, finals: DataFrame, seasons: list[str] | None = None
) -> DataFrame:
    kept = games if seasons is None else games.filter(F.col("season").isin(seasons))
    result = (
        F.when(F.col("home_score") > F.col("away_score"), 1.0)
        .when(F.col("home_score") < F.col("away_score"), 0.0)
        .otherwise(0.5)
    )
    return (
        predictions.join(kept.select("game_id"), "game_id")
        .join(finals.select("game_id", "home_score", "away_score"), "game_id")
        .withColumn("actual_home_win_pct", result)
    )


def predictor_metrics(scored: DataFrame) -> DataFrame:
    """Log loss of the served chance and three mean errors per predictor."""
    miss_home = F.col("pred_home_score") - F.col("home_score")
    miss_away = F.col("pred_away_score") - F.col("away_score")
    return scored.groupBy("predictor").agg(
        F.avg(_log_loss(F.col("actual_home_win_pct"), F.col("pred_home_win_pct"))).alias("log_loss"),
        F.avg(F.abs(miss_home)).alias("mae_home_score"),
        F.avg(F.abs(miss_away)).alias("mae_away_score"),
        F.avg(F.abs(miss_home - miss_away)).alias("mae_home_margin"),
        F.count(F.lit(1)).alias("n"),
    )


def best_models(models: DataFrame, status: str = "active") -> DataFrame:
    """Per type the lowest error; models without one only if no other exists."""
    order = Window.partitionBy("model_type").orderBy(F.asc_nulls_last("avg_score_mae"), "model_id")
    return (
        models.filter(F.col("status") == status)
        .withColumn("__n", F.row_number().over(order))
        .filter("__n = 1")
        .drop("__n")
    )


def promote(models: DataFrame, wanted: DataFrame) -> DataFrame:
    """Wanted models become active; other active ones of their types are archived."""
    chosen = wanted.select("model_id").distinct().withColumn("__chosen", F.lit(True))
    marked = models.join(chosen, "model_id", "left")
    types = (
        models.join(chosen, "model_id", "left_semi").select("model_type").distinct()
        .withColumn("__touched", F.lit(True))
    )
    status = (
        F.when(F.col("__chosen"), F.lit("active"))
        .when(F.col("__touched") & (F.col("status") == "active"), F.lit("archived"))
        .otherwise(F.col("status"))
    )
    return (
        marked.join(types, "model_type", "left")
        .withColumn("status", status)
        .select(*models.columns)
    )
