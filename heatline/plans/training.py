"""The batch path from raw telemetry to supervised, split and scored rows."""

from __future__ import annotations

from pyspark.sql import DataFrame

from heatline.operators.baselines import forecast_pairs, persistence
from heatline.operators.features import add_features
from heatline.operators.metrics import module_metrics
from heatline.operators.project import (
    as_float32,
    complete_rows,
    drop_targets,
    prepare_time,
    probe_columns,
    target_names,
)
from heatline.operators.scale import written
from heatline.operators.split import chronological_split
from heatline.operators.targets import add_future_targets
from heatline.operators.timeline import collapse_duplicates, module_table, resampled_modules
from heatline.schema import (
    CADENCE_SECONDS,
    HORIZON_SECONDS,
    MODULES,
    POWER_CHANNELS,
    SOURCE_TIME,
    TARGETS,
    TOTAL_POWER,
    feature_names,
)


def modules_from_raw(
    raw: DataFrame, keys: list[str] = [], cadence_seconds: int = CADENCE_SECONDS
) -> DataFrame:
    """Raw probes to the module table: clean, collapse, derive, resample."""
    timed = drop_targets(prepare_time(raw, SOURCE_TIME))
    probes = [c for m in range(1, 9) for c in probe_columns(timed, m)]
    power = [c for c in POWER_CHANNELS if c in timed.columns]
    lean = timed.select(*keys, "event_time", *[f"`{c}`" for c in [*power, *probes]])
    once = collapse_duplicates(lean, [*keys, "event_time"])
    modules = module_table(once, [*keys, "event_time"])
    return resampled_modules(modules, keys, "event_time", cadence_seconds)


def feature_table(
    modules: DataFrame, keys: list[str] = [], horizon_seconds: float = HORIZON_SECONDS,
    names: list[str] = MODULES, mode: str = "training", limit: int | None = None,
) -> DataFrame:
    """Supervised rows with every feature known, in float32 like the stored model.

    Targets are joined first, so windows run over the rows that have one. The
    joined table is written once: windows at scale read it more than once.
    """
    targets = target_names(names)
    supervised = written(add_future_targets(modules, keys, columns=names, seconds=horizon_seconds))
    rows = add_features(supervised, keys, modules=names, mode=mode, limit=limit)
    inputs = [*feature_names(names, TOTAL_POWER), *targets.values()]
    return as_float32(complete_rows(rows, inputs), inputs)


def split_table(features: DataFrame, limit: int | None = None) -> DataFrame:
    """Chronological 70/15/15 label on the feature table."""
    return chronological_split(features, limit=limit)


def persistence_by_module(
    modules: DataFrame, keys: list[str] = [], horizon_seconds: float = HORIZON_SECONDS
) -> DataFrame:
    """How wrong "no change" is for each module."""
    rows = persistence(add_future_targets(modules, keys, seconds=horizon_seconds))
    return module_metrics(forecast_pairs(rows, MODULES, TARGETS))
