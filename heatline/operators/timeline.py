"""Cleaning a telemetry timeline and describing its cadence."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heatline.functions import scalars as S
from heatline.operators.project import numeric_columns, probe_columns, with_any_module
from heatline.operators.scale import bounded_broadcast, dealt, over_ordered, same, written
from heatline.schema import MODULES, POWER_CHANNELS, TOTAL_POWER


def collapse_duplicates(
    df: DataFrame, keys: list[str], order: list[str] | None = None, rows: int | None = None
) -> DataFrame:
    """A1, A2: one row per key; numbers averaged, other columns first known by ``order``.

    Without ``order`` only the numeric columns are kept, and ``rows``, how many there are,
    bounds what one task groups (``dealt``). With it, keys are counted first by
    a hashed aggregate, and only rows whose key occurs twice are sorted for the pick: the
    table is read twice, so give it a stored one.
    """
    order = order or []
    numeric = [c for c in numeric_columns(df) if c not in [*keys, *order]]
    known = {c: S.known(F.col(f"`{c}`").cast("double")) for c in numeric}
    merged = [F.avg(v).alias(c) for c, v in known.items()]
    other = [c for c in df.columns if order and c not in [*keys, *order, *numeric]]
    if not other:
        return dealt(df, keys, rows).groupBy(*keys).agg(*merged)
    rank = F.struct(*order)
    merged += [F.min_by(c, F.when(F.col(f"`{c}`").isNotNull(), rank)).alias(c) for c in other]
    twice = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    twice = bounded_broadcast(twice.select(*[F.col(k).alias(f"_k_{k}") for k in keys]))
    match = same(df, twice, [(k, f"_k_{k}") for k in keys])
    several = df.join(twice, match, "left_semi").groupBy(*keys).agg(*merged)
    single = df.join(twice, match, "left_anti").select(
        *keys, *[v.alias(c) for c, v in known.items()], *[F.col(f"`{c}`") for c in other]
    )
    return single.unionByName(several)


def module_means(probes: DataFrame, keys: list[str]) -> DataFrame:
    """A3: mean over the known probes of each module, from long rows."""
    return probes.groupBy(*keys).agg(F.avg(S.known(F.col("value"))).alias("value"))


def total_power(df: DataFrame, channels: list[str] = POWER_CHANNELS):
    """A4: sum of the known channels as a column; 0.0 if there are none."""
    present = [c for c in channels if c in df.columns]
    return sum((F.coalesce(S.known(F.col(f"`{c}`")), F.lit(0.0)) for c in present), F.lit(0.0))


def module_table(df: DataFrame, keys: list[str], modules=range(1, 9)) -> DataFrame:
    """A3, A4: raw probe and power columns to one column per module, row by row."""
    return df.select(
        *keys,
        *[
            S.row_mean([F.col(f"`{c}`") for c in probe_columns(df, m)]).alias(f"Module_{m}_Avg_Temp")
            for m in modules
        ],
        total_power(df).alias(TOTAL_POWER),
    )


def probe_counts(probes: DataFrame) -> DataFrame:
    """A22."""
    return probes.groupBy("module").agg(F.countDistinct("channel").alias("channels"))


def resample_mean(
    df: DataFrame, keys: list[str], time: str, seconds: int, columns: list[str],
    origin: datetime | None = None,
) -> DataFrame:
    """A5: mean per tumbling bucket, labelled by its start; empty buckets are absent.

    Buckets count from ``origin``'s midnight, which matters only where the width
    does not divide a day.
    """
    start = None
    if origin is not None:
        midnight = int(datetime(origin.year, origin.month, origin.day).toordinal() - 719163) * 86400
        start = f"{midnight % seconds} seconds"
    bucket = F.window(time, f"{seconds} seconds", startTime=start)
    means = [F.avg(S.known(F.col(c))).alias(c) for c in columns]
    grouped = df.groupBy(*keys, bucket.alias("_bucket")).agg(*means)
    return grouped.select(*keys, F.col("_bucket.start").alias(time), *columns)


def resampled_modules(
    df: DataFrame, keys: list[str], time: str, seconds: int,
    modules: list[str] = MODULES, origin: datetime | None = None,
) -> DataFrame:
    """The module table at a regular cadence."""
    columns = [*modules, TOTAL_POWER]
    return with_any_module(resample_mean(df, keys, time, seconds, columns, origin), modules)


def modules_wide(
    df: DataFrame, keys: list[str], modules: list[str] = MODULES, value: str = "value"
) -> DataFrame:
    """Long ``module, value`` rows to one column per module."""
    return df.groupBy(*keys).pivot("module", modules).agg(F.avg(value))


def intervals(df: DataFrame, keys: list[str], time: str) -> DataFrame:
    """Seconds since the previous distinct time; NULL at each start."""
    times = written(df.select(*keys, time).filter(F.col(time).isNotNull()).distinct())
    return over_ordered(
        times, keys, [time], 1,
        lambda w: {"delta_seconds": S.seconds_between(F.col(time), F.lag(time).over(w))},
    )


def interval_counts(df: DataFrame, keys: list[str], time: str, n: int = 10) -> DataFrame:
    """The ``n`` most frequent intervals, shorter first on a tie."""
    return (
        intervals(df, keys, time)
        .filter(F.col("delta_seconds").isNotNull())
        .groupBy("delta_seconds")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "delta_seconds")
        .limit(n)
    )


def cadence(
    df: DataFrame, keys: list[str], time: str, expected_seconds: float, minimum: float = 0.95
) -> DataFrame:
    """Share of expected intervals, number of breaks, and the verdict."""
    delta, exact = F.col("delta_seconds"), F.lit(float(expected_seconds))
    return intervals(df, keys, time).agg(
        F.count(delta).alias("intervals"),
        F.avg((delta == exact).cast("int")).alias("exact_ratio"),
        F.count_if(delta.isNull() | (delta != exact)).alias("gap_rows"),
    ).withColumn("is_regular", F.col("exact_ratio") >= minimum)


def profile(df: DataFrame, time: str) -> DataFrame:
    """Rows, invalid, distinct and duplicate times, and the range.

    Counts per time first, so the distinct count needs no second shuffle of rows.
    """
    per_time = df.groupBy(time).agg(F.count(F.lit(1)).alias("_rows"))
    valid = F.col(time).isNotNull()
    return per_time.agg(
        F.coalesce(F.sum("_rows"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.when(~valid, F.col("_rows"))), F.lit(0)).alias("invalid_rows"),
        F.count_if(valid).alias("unique_times"),
        F.coalesce(F.sum(F.when(valid, F.col("_rows") - 1)), F.lit(0)).alias("duplicate_rows"),
        F.min(time).alias("first_time"),
        F.max(time).alias("last_time"),
    )


def distinct_times(df: DataFrame, time: str) -> DataFrame:
    """A23."""
    return df.select(time).filter(F.col(time).isNotNull()).distinct()
