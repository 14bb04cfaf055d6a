"""Past-only features in training and serving form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from heatline.functions import scalars as S
from heatline.operators.scale import over_ordered
from heatline.schema import (
    CHANGE_ROWS,
    LAGS,
    MEAN_ROWS,
    MODULES,
    POWER_ROWS,
    STD_ROWS,
    TOTAL_POWER,
    feature_names,
)

REACH = max(*LAGS, *CHANGE_ROWS, *[n - 1 for n in (*MEAN_ROWS, *STD_ROWS)], POWER_ROWS)


def lagged(w: WindowSpec, name: str, n: int, serving: bool) -> Column:
    """The value ``n`` rows ago; serving falls back to the current one."""
    past = F.lag(name, n).over(w)
    return F.coalesce(past, F.col(name)) if serving else past


def changed(w: WindowSpec, name: str, n: int, serving: bool) -> Column:
    """The change over ``n`` rows; serving falls back to no change."""
    step = F.col(name) - F.lag(name, n).over(w)
    return F.coalesce(step, F.lit(0.0)) if serving else step


def rolling_mean(w: WindowSpec, name: str, n: int, serving: bool) -> Column:
    """Trailing mean; training wants a full window."""
    frame = w.rowsBetween(-(n - 1), 0)
    mean = F.avg(name).over(frame)
    return mean if serving else F.when(F.count(name).over(frame) == n, mean)


def rolling_std(w: WindowSpec, name: str, n: int, serving: bool) -> Column:
    """Trailing deviation; sample in training, population in serving."""
    frame = w.rowsBetween(-(n - 1), 0)
    if serving:
        return F.stddev_pop(name).over(frame)
    return F.when(F.count(name).over(frame) == n, F.stddev_samp(name).over(frame))


def series_columns(w: WindowSpec, columns: list[str], serving: bool) -> dict[str, Column]:
    """All windowed features of some columns, over one window spec."""
    made = {}
    for suffix, sizes, function in (
        ("Lag", LAGS, lagged),
        ("RollingMean", MEAN_ROWS, rolling_mean),
        ("RollingStd", STD_ROWS, rolling_std),
        ("Change", CHANGE_ROWS, changed),
    ):
        for n in sizes:
            for name in columns:
                made[f"{name}_{suffix}_{n}"] = function(w, name, n, serving)
    return made


def power_columns(w: WindowSpec, power: str, serving: bool) -> dict[str, Column]:
    """W5, W11."""
    return {
        f"{power}_Lag_{POWER_ROWS}": lagged(w, power, POWER_ROWS, serving),
        f"{power}_Change_{POWER_ROWS}": changed(w, power, POWER_ROWS, serving),
    }


def cross_columns(modules: list[str], serving: bool) -> dict[str, Column]:
    """State across the modules of one row."""
    values = [F.col(m) for m in modules]
    extremes = [S.known(v) for v in values]
    return {
        "Module_Temp_Mean": S.row_mean(values),
        "Module_Temp_STD": S.row_std(values, 0 if serving else 1),
        "Module_Temp_Max": F.greatest(*extremes),
        "Module_Temp_Min": F.least(*extremes),
    }


def add_features(
    df: DataFrame, keys: list[str], time: str = "event_time", modules: list[str] = MODULES,
    power: str | None = TOTAL_POWER, mode: str = "training", limit: int | None = None,
    order: list[str] | None = None,
) -> DataFrame:
    """The ordered feature set beside the table's other columns.

    Rows are the series as given, so a lag of one crosses a gap in time. They stand in
    ``order``, that of ``time`` by default.
    """
    if mode not in ("training", "serving"):
        raise ValueError("mode is 'training' or 'serving'")
    serving = mode == "serving"

    def build(w: WindowSpec) -> dict[str, Column]:
        made = series_columns(w, modules, serving)
        return {**made, **power_columns(w, power, serving)} if power else made

    wide = over_ordered(df, keys, order or [time], REACH, build, limit=limit)
    wide = wide.withColumns({**cross_columns(modules, serving), **S.time_parts(F.col(time))})
    features = feature_names(modules, power)
    others = [c for c in df.columns if c not in features]
    return wide.select(*others, *features)


def add_series_features(
    df: DataFrame, keys: list[str], time: str, value: str, mode: str = "training",
    limit: int | None = None,
) -> DataFrame:
    """W1-W4 or W8-W11 on a long table of ``value`` by key."""
    return over_ordered(
        df, keys, [time], REACH,
        lambda w: series_columns(w, [value], mode == "serving"), limit=limit,
    )


def cross_state(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """A11, A12 on long rows: sample and population deviation side by side."""
    return df.groupBy(*keys).agg(
        F.avg(value).alias("temp_mean"),
        F.stddev_samp(value).alias("temp_std"),
        F.stddev_pop(value).alias("temp_std_serving"),
        F.max(value).alias("temp_max"),
        F.min(value).alias("temp_min"),
    )
