"""Categories, alerts and post-processing of predictions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bounds of the categories low, moderate, high and extreme.
BOUNDS = (5.0, 20.0, 40.0)
SPIKE = 20.0
ALERT_PROBABILITY = 0.10
ALERT_PREDICTION = 12.0


def category_right_closed(x: Column) -> Column:
    """0..3 with a bound belonging to the lower class; NULL stays NULL."""
    a, b, c = BOUNDS
    return F.when(x <= a, 0).when(x <= b, 1).when(x <= c, 2).when(x > c, 3)


def category_left_closed(x: Column) -> Column:
    """0..3 with a bound belonging to the upper class; NULL stays NULL."""
    a, b, c = BOUNDS
    return F.when(x < a, 0).when(x < b, 1).when(x < c, 2).when(x >= c, 3)


def risk_label(x: Column) -> Column:
    labels = F.array(*[F.lit(s) for s in ("Low", "Moderate", "High", "Extreme")])
    return F.coalesce(F.element_at(labels, category_left_closed(x) + 1), F.lit("No Data"))


def risk_colour(x: Column) -> Column:
    colours = F.array(*[F.lit(s) for s in ("green", "yellow", "orange", "red")])
    return F.coalesce(F.element_at(colours, category_left_closed(x) + 1), F.lit("gray"))


def is_spike(x: Column, inclusive: bool = True) -> Column:
    return x >= SPIKE if inclusive else x > SPIKE


def clipped(p: Column, quantile: Column | None = None, cap: Column | None = None) -> Column:
    """Not below 0, nor above the quantile or cap where those are given and not NULL."""
    bounds = [c for c in (quantile, cap) if c is not None]
    return F.when(p.isNotNull(), F.least(F.greatest(p, F.lit(0.0)), *bounds) if bounds else F.greatest(p, F.lit(0.0)))


def blend(*weighted: tuple[Column, Column]) -> Column:
    """The weighted mean of the predictions that aren't NULL."""
    total = sum((F.when(p.isNotNull(), w).otherwise(0.0) for p, w in weighted), F.lit(0.0))
    value = sum((F.coalesce(p * w, F.lit(0.0)) for p, w in weighted), F.lit(0.0))
    return F.when(total > 0, value / total)


def hybrid_alert(probability: Column, prediction: Column) -> Column:
    """True if either evidence is there, False if neither, NULL if both are unknown."""
    yes = F.coalesce(probability >= ALERT_PROBABILITY, F.lit(False)) | F.coalesce(prediction >= ALERT_PREDICTION, F.lit(False))
    return F.when(probability.isNotNull() | prediction.isNotNull(), yes)


def primary_prediction(model: Column, *, ensemble: Column, boosted: Column, forest: Column, naive: Column, linear: Column) -> Column:
    return (
        F.when(model == "xgboost", boosted).when(model == "rf", forest).when(model == "naive", naive)
        .when(model == "linear", linear).otherwise(ensemble)
    )


def sparse_to_slots(probabilities: Column, slots: int = 4) -> Column:
    """A map class -> probability as an array with a slot per class, 0 where absent."""
    return F.transform(F.sequence(F.lit(0), F.lit(slots - 1)), lambda i: F.coalesce(F.try_element_at(probabilities, i), F.lit(0.0)))


def json_number(x: Column) -> Column:
    """NULL for NaN and infinities, which JSON can't hold."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)
