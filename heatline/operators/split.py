"""Chronological train / validation / test split."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heatline.operators.scale import values_at_ranks
from heatline.schema import SPLIT_FRACTIONS

NAMES = ("train", "validation", "test")


def split_times(
    df: DataFrame, time: str = "event_time", fractions: tuple[float, float] = SPLIT_FRACTIONS,
    limit: int | None = None,
) -> list[datetime]:
    """The first time of validation and of test, found by rank without a sort.

    Empty for a table without rows.
    """
    micros = df.select(F.unix_micros(time).alias("_t"))

    def ranks(n):
        # The product is taken in floating point, so 0.7 * 90 gives row 62.
        return {f"cut{i}": F.floor(F.lit(f) * n.cast("double")) for i, f in enumerate(fractions)}

    found = values_at_ranks(micros, [], "_t", ranks, limit)
    rows = found.withColumn("at", F.timestamp_micros(F.col("rank_value").cast("long"))).collect()
    at = {r["rank_name"]: r["at"] for r in rows}
    return [at[f"cut{i}"] for i in range(len(fractions))] if at else []


def chronological_split(
    df: DataFrame, time: str = "event_time", fractions: tuple[float, float] = SPLIT_FRACTIONS,
    limit: int | None = None,
) -> DataFrame:
    """Add ``split``. Cuts fall between times, so equal times are never parted; a row
    without a time is in no split.

    The two cut times are literals: filtering on one split is a time-range
    filter that reaches the scan, and no row is moved.
    """
    cuts = split_times(df, time, fractions, limit)
    if not cuts:
        return df.withColumn("split", F.lit(None).cast("string"))
    validation, test = [F.lit(at) for at in cuts]
    label = (
        F.when(F.col(time) < validation, NAMES[0])
        .when(F.col(time) < test, NAMES[1])
        .when(F.col(time).isNotNull(), NAMES[2])
    )
    return df.withColumn("split", label)


def split_report(df: DataFrame, time: str = "event_time") -> DataFrame:
    """Rows and time range of each split."""
    return df.groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"),
        F.min(time).alias("first_time"),
        F.max(time).alias("last_time"),
    )


def check_split(df: DataFrame, time: str = "event_time") -> DataFrame:
    """Fail if two neighbouring splits overlap in time."""
    ranges = {r["split"]: r for r in split_report(df, time).collect()}
    present = [ranges[n] for n in NAMES if n in ranges]
    for earlier, later in zip(present, present[1:]):
        if not earlier["last_time"] < later["first_time"]:
            raise ValueError(f"{earlier['split']} overlaps {later['split']}")
    return df


def production_rows(df: DataFrame) -> DataFrame:
    """Train and validation together."""
    return df.filter(F.col("split").isin(*NAMES[:2]))
