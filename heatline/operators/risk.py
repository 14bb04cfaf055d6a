"""Thresholds from history and risk from a forecast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heatline.functions.scalars import known
from heatline.operators.scale import (
    bounded_broadcast,
    rows_per_chunk,
    same,
    values_at_ranks,
)
from heatline.operators.split import chronological_split
from heatline.schema import (
    CRITICAL_QUANTILE,
    NEAR_WARNING,
    RISE_TO_CRITICAL,
    RISE_TO_WARNING,
    WARNING_QUANTILE,
)


#: Size of a KLL sketch: about three times as many numbers at most, however many values.
SKETCH_SIZE = 4096


def exact_quantiles(
    df: DataFrame, keys: list[str], value: str, quantiles: dict[str, float],
    limit: int | None = None,
) -> DataFrame:
    """A10: linearly interpolated quantiles per group, missing values ignored.

    ``percentile`` holds a group's distinct values in one task, so it is used
    only where a count shows the largest group is small.
    """
    limit = limit or rows_per_chunk(df.sparkSession)
    rows = df.select(*keys, known(F.col(value).cast("double")).alias(value))
    largest = rows.groupBy(*keys).agg(F.count(value).alias("n")).agg(F.max("n")).head()[0] or 0
    if largest <= limit:
        return rows.groupBy(*keys).agg(
            *[F.percentile(value, q).alias(name) for name, q in quantiles.items()]
        ).dropna(how="all", subset=list(quantiles))

    def ranks(n: Column) -> dict[str, Column]:
        made = {}
        for name, q in quantiles.items():
            made[f"{name}_low"] = F.floor(F.lit(q) * (n - 1))
            made[f"{name}_high"] = F.ceil(F.lit(q) * (n - 1))
        return made

    found = values_at_ranks(rows, keys, value, ranks, limit)
    sizes = rows.groupBy(*keys).agg(F.count(value).alias("_n"))

    def rank_value(name: str) -> Column:
        return F.max(F.when(F.col("rank_name") == name, F.col("rank_value")))

    ends = found.groupBy(*keys).agg(
        *[rank_value(f"{n}_{side}").alias(f"{n}_{side}") for n in quantiles for side in ("low", "high")]
    )
    sizes = sizes.withColumnsRenamed({k: f"_n_{k}" for k in keys})
    joined = ends.join(sizes, same(ends, sizes, [(k, f"_n_{k}") for k in keys]))
    at = {n: F.lit(q) * (F.col("_n") - 1) for n, q in quantiles.items()}

    def between(n: str) -> Column:
        low, high = F.col(f"{n}_low"), F.col(f"{n}_high")
        mixed = (F.ceil(at[n]) - at[n]) * low + (at[n] - F.floor(at[n])) * high
        return F.when(low == high, low).otherwise(mixed)

    return joined.select(*keys, *[between(n).alias(n) for n in quantiles])


def fit_thresholds(
    df: DataFrame, keys: list[str] = ["module"], value: str = "value",
    warning: float = WARNING_QUANTILE, critical: float = CRITICAL_QUANTILE,
    limit: int | None = None, fit_split: str | None = None, time: str = "event_time",
) -> DataFrame:
    """A10: warning and critical levels from each module's history.

    The whole history by default; ``fit_split='train'`` leaves later splits unseen.
    """
    if fit_split:
        df = chronological_split(df, time).filter(F.col("split") == fit_split)
    levels = exact_quantiles(df, keys, value, {"warning": warning, "critical": critical}, limit)
    return levels.withColumn("source", F.lit("historical_percentiles"))


def value_sketches(
    df: DataFrame, keys: list[str] = ["module"], value: str = "value", time: str = "event_time",
    size: int = SKETCH_SIZE,
) -> DataFrame:
    """A10, incremental: a KLL sketch of each key's values by day, with their count.

    Sketches of new days are appended to those stored; no old reading is read again.
    """
    rows = df.select(
        *keys, F.to_date(time).alias("event_date"), known(F.col(value).cast("double")).alias("_v")
    ).filter(F.col("_v").isNotNull())
    return rows.groupBy(*keys, "event_date").agg(
        F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double("_v", F.lit(size)).alias("sketch")
    )


def rank_error(size: int = SKETCH_SIZE) -> float:
    """How far, as a share of all values, a quantile's rank in a sketch may be off (99 % sure)."""
    return 2.296 / size**0.9723


def sketched_thresholds(
    sketches: DataFrame, keys: list[str] = ["module"],
    warning: float = WARNING_QUANTILE, critical: float = CRITICAL_QUANTILE,
) -> DataFrame:
    """A10: levels of any period from its days' sketches, each within ``rank_error``."""
    merged = sketches.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("_all")
    )
    levels = {"warning": warning, "critical": critical}
    return merged.select(
        *keys, "n",
        *[F.kll_sketch_get_quantile_double("_all", F.lit(q)).alias(name) for name, q in levels.items()],
        F.lit("sketched_percentiles").alias("source"),
    )


def ready_thresholds(thresholds: DataFrame, keys: list[str] = ["module"]) -> DataFrame:
    """Thresholds written once and sized for joining, for use in many joins."""
    if f"_t_{keys[0]}" in thresholds.columns:
        return thresholds
    return bounded_broadcast(
        thresholds.select(
            *[F.col(k).alias(f"_t_{k}") for k in keys],
            F.col("warning").alias("warning_threshold"),
            F.col("critical").alias("critical_threshold"),
        )
    )


def with_thresholds(
    df: DataFrame, thresholds: DataFrame, keys: list[str] = ["module"]
) -> DataFrame:
    """Each row's levels; NULL where its module has none."""
    side = ready_thresholds(thresholds, keys)
    pairs = [(k, f"_t_{k}") for k in keys]
    return df.join(side, same(df, side, pairs), "left").drop(*[b for _, b in pairs])


def risk_level(
    predicted: Column, delta: Column, warning: Column, critical: Column,
    rise_to_warning: float = RISE_TO_WARNING, rise_to_critical: float = RISE_TO_CRITICAL,
    near: float = NEAR_WARNING,
) -> Column:
    """level from the forecast, raised by at most one step on a strong rise."""
    rising = F.coalesce(delta >= rise_to_critical, F.lit(False))
    climbing = F.coalesce(delta >= rise_to_warning, F.lit(False))
    level = (
        F.when((predicted >= critical) | ((predicted >= warning) & rising), "CRITICAL")
        .when((predicted >= warning) | (climbing & (predicted >= warning * near)), "WARNING")
        .otherwise("NORMAL")
    )
    return F.when(predicted.isNotNull() & warning.isNotNull() & critical.isNotNull(), level)


def classify(
    df: DataFrame, thresholds: DataFrame, keys: list[str] = ["module"], **options: float
) -> DataFrame:
    """Add levels, ``temperature_delta`` and ``risk_level``.

    A row of a module without thresholds gets a NULL risk; ``unknown_modules``
    lists them.
    """
    rows = with_thresholds(df, thresholds, keys)
    predicted = F.col("predicted_temperature")
    delta = predicted - F.col("current_temperature")
    risk = risk_level(
        predicted, delta, F.col("warning_threshold"), F.col("critical_threshold"), **options
    )
    return rows.withColumns({"temperature_delta": delta, "risk_level": risk})


def unknown_modules(df: DataFrame, thresholds: DataFrame, keys: list[str] = ["module"]) -> DataFrame:
    """Rows no threshold exists for."""
    return df.join(bounded_broadcast(thresholds.select(*keys)), keys, "left_anti")
