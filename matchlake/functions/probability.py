"""Win probability and the blend of a stored prediction with a live score."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Serving curve, evaluation curve, score bounds.
CURVE_INTERCEPT = -0.2504
CURVE_SLOPE = 0.1949
EVALUATION_SLOPE = 0.15
LOWEST_SCORE, HIGHEST_SCORE = 70, 150


def home_win_probability(
    home: Column, away: Column, minutes: Column | None = None, kind: str = "logarithmic"
) -> Column:
    """Logistic in the margin; with minutes left given, steeper as they run out."""
    slope = F.lit(CURVE_SLOPE)
    if minutes is not None:
        urgency = F.lit(48.0) / (minutes + 1)
        if kind == "logarithmic":
            urgency = F.log(urgency)
        elif kind != "linear":
            raise ValueError("kind must be 'linear' or 'logarithmic'")
        slope = slope * (1 + urgency)
    return 1 / (1 + F.exp(-(F.lit(CURVE_INTERCEPT) + slope * (home - away))))


def blended_score(
    pregame: Column,
    current: Column,
    remaining: Column,
    method: str = "weighted",
    midpoint: float = 0.5,
    steepness: float = 10.0,
) -> Column:
    """Mix of the stored score and the current one stretched to a full game.

    The stretched score is held between 70 and 150. At the opening second
    nothing can be stretched, so it takes the lower bound there; the weighted
    method then returns the stored score.
    """
    done = 1 - remaining
    stretched = F.when(remaining == 0, current.cast("double")).otherwise(
        F.try_divide(current.cast("double"), done)
    )
    lowest, highest = F.lit(float(LOWEST_SCORE)), F.lit(float(HIGHEST_SCORE))
    held = F.when(done == 0, lowest).otherwise(
        F.greatest(F.least(stretched, highest), lowest)
    )
    if method == "simple":
        return (held + pregame) / 2
    if method == "weighted":
        share = done
    elif method == "logistic":
        share = 1 / (1 + F.exp(-steepness * (done - midpoint)))
    else:
        raise ValueError("method must be 'simple', 'weighted' or 'logistic'")
    return share * held + (1 - share) * pregame
