"""All that is known before a game, from plays to predictions."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame

from matchlake.operators import features, history, predict, queues, states
from matchlake.sources.store import KeyedTables


class Refreshed(NamedTuple):
    """Tables of one refresh, bucketed by game."""

    #: Games with both data flags as they are after it.
    games: DataFrame
    finals: DataFrame
    features: DataFrame
    predictions: DataFrame


def refresh(games: DataFrame, plays: DataFrame, tables: KeyedTables) -> Refreshed:
    """States and finals from plays, features and flags from finals, predictions from features.

    A game's data flag is set when its plays end it, its pre-game flag when neither
    side misses earlier states. Every table is written once and read by the steps
    after it; those that meet on the game meet without an exchange.
    """
    derived = states.game_states(games, plays).select("game_id", "play_id", "home_score", "away_score", "is_final_state")
    finals = tables.save("finals", states.final_states(derived))
    ended = finals.selectExpr("game_id", "true AS is_final_state")
    flagged = queues.finalize_pregame(states.finalize_games(games, ended), history.prior_counts(games, finals))
    known = tables.save("features", features.side_sums(games, finals, tables.buckets), features.features_of)
    told = tables.save("predictions", predict.baseline(known))
    return Refreshed(tables.save("games", flagged), finals, known, told)


def predicted_games(done: Refreshed) -> DataFrame:
    """Every game with its flags and, where its features allow one, its prediction."""
    flags = done.games.select("game_id", "game_data_finalized", "pre_game_data_finalized")
    return flags.join(done.predictions, "game_id", "left")
