"""Baseline forecasts every model is compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heatline.operators.scale import over_ordered
from heatline.schema import MODULES, MOVING_AVERAGE_ROWS, TARGETS


def persistence(df: DataFrame, columns: list[str] = MODULES, prefix: str = "Predicted_") -> DataFrame:
    """M1: the forecast is the current value."""
    return df.withColumns({prefix + c: F.col(c) for c in columns})


def moving_average(
    df: DataFrame, keys: list[str], time: str = "event_time", columns: list[str] = MODULES,
    rows: int = MOVING_AVERAGE_ROWS, prefix: str = "Predicted_", limit: int | None = None,
) -> DataFrame:
    """Mean of the last rows with the current one, across split borders."""
    return over_ordered(
        df, keys, [time], rows - 1,
        lambda w: {prefix + c: F.avg(c).over(w.rowsBetween(-(rows - 1), 0)) for c in columns},
        limit=limit,
    )


def forecast_pairs(
    df: DataFrame, modules: list[str] = MODULES, targets: list[str] = TARGETS,
    prefix: str = "Predicted_", keep: list[str] = [],
) -> DataFrame:
    """Wide targets and forecasts to ``module, actual, predicted`` rows."""
    pairs = F.array(
        *[
            F.struct(
                F.lit(m).alias("module"),
                F.col(t).cast("double").alias("actual"),
                F.col(prefix + m).cast("double").alias("predicted"),
            )
            for m, t in zip(modules, targets)
        ]
    )
    return df.select(*keep, F.inline(pairs))
