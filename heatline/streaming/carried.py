"""Streams that carry a small table from one micro-batch to the next.

The step of a batch gets its rows and the carried table and gives rows to store and the
table to carry on. Both are written under the batch's own name and become visible by one
commit row, so a batch that stopped half-way is simply run again, and one that was
committed before the stream noted it is recognised by its number.

A step works with the same column rules as the batch form, and a series of any length in
a batch is cut like any other: no key's rows are held together in one worker.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from heatline.operators.scale import written
from heatline.streaming.store import Commits

Step = Callable[[DataFrame, DataFrame | None], tuple[DataFrame, DataFrame]]


def carried_stream(
    df: DataFrame, root: str, checkpoint: str, step: Step, initial: DataFrame | None = None
) -> DataStreamWriter:
    """Run ``step`` on every micro-batch of ``df``; its table starts as ``initial``, or None."""
    spark, root = df.sparkSession, root.rstrip("/")
    commits = Commits(spark, root)

    def write(batch: DataFrame, batch_id: int) -> None:
        if commits.done(checkpoint, batch_id):
            return
        name, last = uuid.uuid4().hex, commits.last
        carried = initial if last is None else spark.read.parquet(f"{root}/carried/{last['batch']}")
        rows, after = step(written(batch, "batch"), carried)
        rows = rows.withColumn("batch", F.lit(name))
        rows.write.mode("append").parquet(f"{root}/rows")
        after.write.parquet(f"{root}/carried/{name}")
        commits.add(name, checkpoint, batch_id)

    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def carried_rows(spark: SparkSession, root: str) -> DataFrame:
    """The rows that complete batches stored."""
    root = root.rstrip("/")
    return Commits(spark, root).visible(spark.read.parquet(f"{root}/rows")).drop("batch")
