"""Supervised targets from an exact time offset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heatline.functions.scalars import shifted
from heatline.operators.project import target_names, with_all_targets
from heatline.operators.scale import dealt
from heatline.schema import HORIZON_SECONDS, MODULES


def add_future_targets(
    df: DataFrame, keys: list[str], time: str = "event_time",
    columns: list[str] = MODULES, seconds: float = HORIZON_SECONDS,
    names: dict[str, str] | None = None, rows: int | None = None,
) -> DataFrame:
    """Give each row the values of the row exactly ``seconds`` later of the same key.

    Rows without a complete later row are dropped. Not a row shift: gaps in the
    series must not move a target. Every row is sent to its own time and, with its
    values as targets, to the time they are the target of; one hashed aggregate by key
    and time puts the two halves together, so the table is derived and read once.
    Keys and time name one row, as after collapsing duplicates; if not, it is an error.
    ``rows``, how many there are at most, bounds what one task groups (``dealt``).
    """
    names = names or target_names(columns)
    others = [c for c in df.columns if c not in (*keys, time)]
    half = [f"_o{i}" for i in range(len(others))]
    goal = [f"_g{i}" for i in range(len(columns))]

    def none(name: str) -> Column:
        return F.lit(None).cast(df.schema[name].dataType)

    def sent(at: Column, now: int, own: list[Column], later: list[Column]) -> Column:
        parts = [at.alias("_at"), F.lit(now).alias("_now"), F.lit(1 - now).alias("_later")]
        parts += [c.alias(n) for c, n in zip([*own, *later], [*half, *goal])]
        return F.struct(*parts)

    here = sent(F.col(time), 1, [F.col(f"`{c}`") for c in others], [none(c) for c in columns])
    ahead = sent(
        shifted(F.col(time), -seconds), 0, [none(c) for c in others], [F.col(f"`{c}`") for c in columns]
    )
    complete = F.lit(True)
    for c in columns:
        value = F.col(f"`{c}`")
        known = value.isNotNull()
        if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)):
            known = known & ~F.isnan(value)
        complete = complete & known
    halves = df.filter(F.col(time).isNotNull()).select(
        *keys, F.inline(F.when(complete, F.array(here, ahead)).otherwise(F.array(here)))
    )
    place = [*keys, "_at"]
    met = dealt(halves, place, rows and 2 * rows).groupBy(*place).agg(
        F.sum("_now").alias("_now"), F.sum("_later").alias("_later"),
        *[F.first(c, ignorenulls=True).alias(c) for c in [*half, *goal]],
    )
    repeated = F.raise_error(F.lit("Keys and time name more than one row; collapse duplicates first."))
    once = F.when(F.greatest("_now", "_later") > 1, repeated.cast("boolean")).otherwise(
        (F.col("_now") == 1) & (F.col("_later") == 1)
    )
    back = dict(zip(others, half)) | {time: "_at"}
    joined = met.filter(once).select(
        *[F.col(back.get(c, c)).alias(c) for c in df.columns],
        shifted(F.col("_at"), seconds).alias("target_time"),
        *[F.col(g).alias(names[c]) for g, c in zip(goal, columns)],
    )
    return with_all_targets(joined, list(names.values()))
