"""Serving features on a stream of module rows (X11)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from heatline.operators.features import REACH, add_features
from heatline.operators.scale import by, written
from heatline.schema import MODULES, TOTAL_POWER
from heatline.streaming.carried import carried_stream


def feature_stream(
    df: DataFrame, root: str, checkpoint: str, keys: list[str], time: str = "event_time",
    modules: list[str] = MODULES, power: str = TOTAL_POWER,
) -> DataStreamWriter:
    """X11: the serving feature set of rows arriving in order, per series.

    What is carried are the last rows of each series, as many as the windows look back
    on. They go before the new ones, and the columns are those of the batch form.
    """
    values = [*modules, power]
    place = Window.partitionBy(*by(keys)).orderBy(F.desc("_turn"), F.desc(time))

    def step(batch: DataFrame, before: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        rows = batch.withColumn("_turn", F.lit(0))
        if before is not None:
            rows = rows.unionByName(before, allowMissingColumns=True)
        rows = written(rows, "series")
        made = add_features(rows, keys, time, modules, power, "serving", order=["_turn", time])
        # The newest row has the turn before 0, the one before it the turn before that.
        last = rows.withColumn("_back", F.row_number().over(place)).filter(F.col("_back") <= REACH)
        tail = last.select(*dict.fromkeys([*keys, time, *values]), (-F.col("_back")).alias("_turn"))
        return made.filter("_turn = 0").drop("_turn"), tail

    return carried_stream(df, root, checkpoint, step)
