"""Pre-game predictions and their blend with live states."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlake.functions.clock import fraction_done, minutes_left
from matchlake.functions.probability import blended_score, home_win_probability


def with_win_probability(scores: DataFrame) -> DataFrame:
    """Predicted scores → prediction rows."""
    return scores.withColumn(
        "pred_home_win_pct",
        home_win_probability(F.col("pred_home_score"), F.col("pred_away_score")),
    )


def baseline(features: DataFrame) -> DataFrame:
    """Each side scores the mean of its own average and what the other allows.

    Games lacking one of the four averages get no prediction.
    """
    need = ["Home_PPG", "Home_OPP_PPG", "Away_PPG", "Away_OPP_PPG"]
    return with_win_probability(
        features.dropna(subset=need).select(
            "game_id",
            ((F.col("Home_PPG") + F.col("Away_OPP_PPG")) / 2).alias("pred_home_score"),
            ((F.col("Away_PPG") + F.col("Home_OPP_PPG")) / 2).alias("pred_away_score"),
        )
    )


def ensemble(predictions: DataFrame, members: list[str]) -> DataFrame:
    """Equal-weight mean over the member predictors that predicted the game."""
    return with_win_probability(
        predictions.filter(F.col("predictor").isin(members))
        .groupBy("game_id")
        .agg(
            F.avg("pred_home_score").alias("pred_home_score"),
            F.avg("pred_away_score").alias("pred_away_score"),
            F.count("pred_home_score").alias("members"),
        )
    )


def newest(predictions: DataFrame, predictor: str) -> DataFrame:
    """Each game's newest prediction by one predictor, of equal times the largest."""
    kept = ("pred_home_score", "pred_away_score", "pred_home_win_pct")
    last = F.max(F.struct("prediction_ts", *kept)).alias("last")
    found = predictions.filter(F.col("predictor") == predictor).groupBy("game_id").agg(last)
    return found.select("game_id", *[f"last.{c}" for c in (*kept, "prediction_ts")])


def live_inputs(predictions: DataFrame, latest: DataFrame, predictor: str) -> DataFrame:
    """Stored prediction with the latest state; states alone are dropped."""
    state = latest.select(
        "game_id", "clock", "period", "home_score", "away_score", "is_final_state"
    )
    return newest(predictions, predictor).join(state, "game_id", "left")


def live_predictions(inputs: DataFrame) -> DataFrame:
    """Final games take their score, running ones the blend, others stay as stored."""
    has_state = F.col("period").isNotNull()
    final = has_state & F.coalesce("is_final_state", F.lit(False))
    at = (F.col("period"), F.col("clock"))
    timed = inputs.withColumns({"__left": minutes_left(*at), "__rest": 1 - fraction_done(*at)})

    def score(side: str) -> Column:
        stored, now = F.col(f"pred_{side}_score"), F.col(f"{side}_score")
        return (
            F.when(final, now.cast("double"))
            .when(has_state, blended_score(stored, now, F.col("__rest")))
            .otherwise(stored)
        )

    scored = timed.withColumns({"__home": score("home"), "__away": score("away")})
    chance = (
        F.when(final, (F.col("home_score") > F.col("away_score")).cast("double"))
        .when(has_state, home_win_probability(F.col("__home"), F.col("__away"), F.col("__left")))
        .otherwise(F.col("pred_home_win_pct"))
    )
    return scored.select(
        "game_id",
        F.col("__home").alias("pred_home_score"),
        F.col("__away").alias("pred_away_score"),
        chance.alias("pred_home_win_pct"),
    )


def live_player_points(snapshot: DataFrame, predicted: DataFrame, latest: DataFrame) -> DataFrame:
    """Predicted points per player: final games take the points scored."""
    final = latest.select("game_id", "is_final_state")
    joined = (
        snapshot.join(predicted, ["game_id", "side", "person_id"], "full_outer")
        .join(final, "game_id", "left")
    )
    ended = F.coalesce("is_final_state", F.lit(False))
    return joined.select(
        "game_id",
        "side",
        "person_id",
        "name",
        F.coalesce("points", F.lit(0)).alias("points"),
        F.coalesce(
            F.when(ended, F.col("points")).otherwise(F.col("pred_points")), F.lit(0)
        ).alias("pred_points"),
    )


# Formula predictors by name; the trained ones come from ``operators.models``.
PREDICTORS = {"Baseline": baseline}
ENSEMBLE = "Ensemble"


def predictors(trained: dict[str, Any] | None = None, members: list[str] | None = None) -> dict[str, Callable[[DataFrame], DataFrame]]:
    """Every predictor by name: features → prediction rows.

    ``trained`` are fitted models with a ``predict``. The ensemble means over ``members``,
    over all others without them; unknown members are an error.
    """
    found = PREDICTORS | {name: model.predict for name, model in (trained or {}).items()}
    chosen = list(found) if members is None else members
    unknown = sorted(set(chosen) - set(found))
    if unknown:
        raise ValueError(f"unknown predictors: {unknown}")

    def together(features: DataFrame) -> DataFrame:
        told = [found[name](features).withColumn("predictor", F.lit(name)) for name in chosen]
        return ensemble(reduce(DataFrame.unionByName, told), chosen).drop("members")

    return found | {ENSEMBLE: together}
