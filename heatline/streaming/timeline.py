"""Event-time operators on streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from heatline.functions.scalars import known
from heatline.operators.timeline import resample_mean
from heatline.schema import HORIZON_SECONDS, TOLERANCE_SECONDS

_STATE = "targets binary, predicted binary, times binary, readings binary"
_NONE = np.iinfo(np.int64).min


def resample_stream(
    df: DataFrame, keys: list[str], time: str, seconds: int, columns: list[str],
    delay: str = "1 minute",
) -> DataFrame:
    """Tumbling means, each sent once its bucket is ``delay`` past."""
    return resample_mean(df.withWatermark(time, delay), keys, time, seconds, columns)


def matured_forecasts(
    forecasts: DataFrame, readings: DataFrame, on: list[str] = ["module"],
    horizon_seconds: int = HORIZON_SECONDS, tolerance_seconds: int = TOLERANCE_SECONDS,
    delay: str = "1 minute",
) -> DataFrame:
    """Each forecast with the reading nearest its target time, once it is due.

    Time is cut into buckets of two tolerances, and a reading also goes to the
    neighbour its tolerance reaches into, so forecasts and readings meet by key and
    bucket: state is spread over buckets, not modules alone. A bucket keeps both as they
    came; once the watermark passes a forecast's target time and tolerance, its nearest
    reading is looked up in the sorted times, so no pairs are formed. Ties go as in the
    batch form. Equal forecasts are all sent, NaN is no reading, and a forecast no reading
    came near is sent with NULLs. ``forecasts`` needs ``event_time`` and
    ``predicted_temperature``; ``readings`` needs ``event_time`` and
    ``current_temperature``.
    """
    reach = tolerance_seconds * 1_000_000
    width = max(2 * reach, 1)

    def bucket(micros: Column) -> Column:
        return F.floor(micros / F.lit(width))

    due = F.col("event_time") + F.expr(f"INTERVAL {horizon_seconds} SECONDS")
    left = forecasts.select(
        *on, due.alias("_clock"), known(F.col("predicted_temperature")).alias("_value")
    ).filter(F.col("_clock").isNotNull())
    right = readings.select(
        *on, F.col("event_time").alias("_clock"), known(F.col("current_temperature")).alias("_value")
    ).dropna(subset=[*on, "_value"])
    kinds = [d.schema["_value"].dataType for d in (left, right)]
    at = F.unix_micros("_clock")
    reached = F.explode(F.sequence(bucket(at - reach), bucket(at + reach)))

    def row(df: DataFrame, to: Column, wanted: bool) -> DataFrame:
        return df.select(
            *on, to.alias("_bucket"), "_clock", at.alias("_at"),
            F.col("_value").cast("double").alias("_value"), F.lit(wanted).alias("_wanted"),
        ).withWatermark("_clock", delay)

    both = row(left, bucket(at), True).unionByName(row(right, reached, False))
    made = [f"`{k}` {both.schema[k].dataType.simpleString()}" for k in on]
    made += ["target long", "predicted double", "time long", "value double"]
    matched = both.groupBy(*on, "_bucket").applyInPandasWithState(
        _matcher(on, reach, width), ", ".join(made), _STATE, "append", "EventTimeTimeout",
    )
    found = F.col("time") != _NONE
    return matched.select(
        *on, F.timestamp_micros(F.col("target") - horizon_seconds * 1_000_000).alias("event_time"),
        F.timestamp_micros("target").alias("target_time"),
        F.col("predicted").cast(kinds[0]).alias("predicted_temperature"),
        F.when(found, F.timestamp_micros("time")).alias("matched_time"),
        F.when(found, F.col("value").cast(kinds[1])).alias("matched_value"),
    )


def nearest(
    targets: np.ndarray, times: np.ndarray, values: np.ndarray, reach: int
) -> tuple[np.ndarray, np.ndarray]:
    """Time and value of the reading nearest each target; ``_NONE`` and NaN beyond ``reach``.

    The earlier one wins on equal distance. Of readings at one time the greatest counts
    from before, the least from behind.
    """
    order = np.lexsort((values, times))
    times = np.concatenate(([_NONE], times[order], [_NONE]))
    values = np.concatenate(([np.nan], values[order], [np.nan]))
    ahead = np.searchsorted(times[1:-1], targets, "right") + 1
    back = ahead - 1
    far = np.int64(reach + 1)
    behind = np.where(back > 0, targets - times[back], far)
    before = np.where(ahead < len(times) - 1, times[ahead] - targets, far)
    best = np.where(behind <= before, back, ahead)
    best = np.where(np.minimum(behind, before) <= reach, best, 0)
    return times[best], values[best]


def _matcher(on: list[str], reach: int, width: int) -> Callable:
    def match(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = state.get if state.exists else (b"",) * 4
        parts = [[np.frombuffer(b, kind)] for b, kind in zip(kept, ("i8", "f8") * 2)]
        if not state.hasTimedOut:
            for new in rows:
                wanted = new["_wanted"].to_numpy(bool)
                at, value = new["_at"].to_numpy("i8"), new["_value"].to_numpy("f8")
                for part, more in zip(parts, (at[wanted], value[wanted], at[~wanted], value[~wanted])):
                    part.append(more)
        targets, predicted, times, values = (np.concatenate(part) for part in parts)
        mark = state.getCurrentWatermarkMs()
        due = targets + reach < mark * 1000
        if due.any():
            time, value = nearest(targets[due], times, values, reach)
            yield pd.DataFrame(
                {k: [v] * len(time) for k, v in zip(on, key)}
                | {"target": targets[due], "predicted": predicted[due], "time": time, "value": value}
            )
        targets, predicted = targets[~due], predicted[~due]
        # Forecasts can come until the watermark is past the bucket.
        wake = (int(targets.min()) + reach if len(targets) else (int(key[-1]) + 1) * width) // 1000
        if len(targets) or wake > mark:
            state.update(tuple(a.tobytes() for a in (targets, predicted, times, values)))
            state.setTimeoutTimestamp(max(wake, 1))
        elif state.exists:
            state.remove()

    return match
