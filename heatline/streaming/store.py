"""Predictions, alerts and system events that become visible a whole batch at a time.

A batch appends its rows to the day-partitioned tables under a name of its own, and its
last step is one small row in ``commits``. Readers see the rows of committed batches only,
so a batch that stopped half-way shows nothing, and its repeat, under another name,
shows everything once. With a batch also go two small tables, read back by name:

* ``marks``: the highest offset stored of each partition. Rows beyond their partition's
  mark are new without a look at what is stored; only rows at or below it (a
  redelivery, or a late one) are compared, with the stored days they fall on.
* ``risks``: the risk of each module's newest prediction, from which the next batch's
  alerts go on.

One writer at a time, as a streaming query is. A new writer finds the newest commit
itself. Defined results: predictions without a partition or offset cannot be told apart
and are all kept; events without one are compared by what they say.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heatline.operators.alerts import alert_events, alert_records
from heatline.operators.monitor import new_records
from heatline.operators.scale import bounded_broadcast, same, stored, written
from heatline.schema import ALERTS, PREDICTIONS, SYSTEM_EVENTS
from heatline.sources.sinks import append_records

TABLES = {"predictions": PREDICTIONS, "alerts": ALERTS, "system_events": SYSTEM_EVENTS}
#: A module's predictions follow one another in this order within a batch.
ORDER = ["event_time", "kafka_partition", "kafka_offset"]
_COMMITS = "number long, batch string, source string, source_batch long"
_MARKS = "kafka_partition int, mark long"
_RISKS = "module string, risk_level string"
_EVENT = ["event_time", "event_type", "message"]


def existing(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """The Parquet table at ``path``, empty where nothing has been written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as problem:
        # Any other problem must stop the batch.
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


class Commits:
    """Which batches below a folder are complete: a small row each, in a table of their own."""

    def __init__(self, spark: SparkSession, root: str):
        self._spark, self._path = spark, f"{root.rstrip('/')}/commits"
        self.last = self.all().orderBy(F.desc("number")).first()

    def all(self) -> DataFrame:
        return existing(self._spark, self._path, _COMMITS)

    def visible(self, rows: DataFrame) -> DataFrame:
        """The rows whose ``batch`` is complete."""
        return rows.join(bounded_broadcast(self.all()), "batch", "left_semi")

    def done(self, source: str, source_batch: int) -> bool:
        """Whether this batch of a stream is the newest commit, or lies before it."""
        return self.last is not None and self.last["source"] == source and self.last["source_batch"] >= source_batch

    def add(self, batch: str, source: str = "", source_batch: int = -1) -> None:
        """Make a batch visible."""
        number = self.last["number"] + 1 if self.last else 0
        row = self._spark.createDataFrame([(number, batch, source, source_batch)], _COMMITS).coalesce(1)
        row.write.mode("append").parquet(self._path)
        self.last = row.first()


class BatchStore:
    """The three tables of a site below ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self._spark, self._root = spark, root.rstrip("/")
        self._commits = Commits(spark, root)

    def read(self, name: str) -> DataFrame:
        """The rows of a table that committed batches wrote; filter on time to prune days."""
        return self._commits.visible(self._dated(name)).select(*TABLES[name].names)

    def _dated(self, name: str) -> DataFrame:
        own = [T.StructField("batch", T.StringType()), T.StructField("event_date", T.DateType())]
        layout = T.StructType([*TABLES[name].fields, *own])
        return existing(self._spark, f"{self._root}/{name}", layout)

    def _of_last(self, name: str, schema: str) -> DataFrame:
        last = self._commits.last
        if last is None:
            return self._spark.createDataFrame([], schema)
        return self._spark.read.schema(schema).parquet(f"{self._root}/{name}/{last['batch']}")

    def marks(self) -> DataFrame:
        """The highest stored offset of each partition."""
        return self._of_last("marks", _MARKS)

    def risks(self) -> DataFrame:
        """The risk of each module's newest prediction."""
        return self._of_last("risks", _RISKS)

    def _stored_days(self, name: str, rows: DataFrame) -> DataFrame:
        """What committed batches stored on the days of ``rows``.

        Event time comes from the message or the broker, so it is the same in every
        delivery, and the days reach the scan as a dynamic filter on its partitions.
        """
        days = bounded_broadcast(rows.select(F.to_date("event_time").alias("event_date")).distinct())
        return self._commits.visible(self._dated(name).join(days, "event_date", "left_semi"))

    def _by_mark(self, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Rows beyond their partition's mark, and all others."""
        marks = bounded_broadcast(self.marks().withColumnRenamed("kafka_partition", "_partition"))
        seen = rows.join(marks, same(rows, marks, [("kafka_partition", "_partition")]), "left")
        beyond = F.col("kafka_offset").isNotNull() & F.col("kafka_partition").isNotNull()
        beyond = beyond & (F.col("mark").isNull() | (F.col("kafka_offset") > F.col("mark")))
        return seen.filter(beyond).select(*rows.columns), seen.filter(~beyond).select(*rows.columns)

    def new_predictions(self, rows: DataFrame) -> DataFrame:
        """Predictions that no committed batch holds, each once."""
        beyond, others = self._by_mark(rows)
        if others.isEmpty():
            return new_records(beyond)
        compared = new_records(others, self._stored_days("predictions", others))
        return new_records(beyond).unionByName(compared)

    def new_events(self, events: DataFrame) -> DataFrame:
        """System events that no committed batch holds, each once."""
        traced = {c: F.col(c) if c in events.columns else F.lit(None) for c in ("kafka_partition", "kafka_offset")}
        events = events.withColumns({"kafka_partition": traced["kafka_partition"].cast("int"),
                                     "kafka_offset": traced["kafka_offset"].cast("long")})
        events = events.dropDuplicates(_EVENT)
        beyond, others = self._by_mark(events)
        if not others.isEmpty():
            done = self._stored_days("system_events", others)
            done = done.select(*[F.col(k).alias(f"_d_{k}") for k in _EVENT])
            others = others.join(done, same(others, done, [(k, f"_d_{k}") for k in _EVENT]), "left_anti")
            beyond = beyond.unionByName(others)
        return beyond

    def write(self, predictions: DataFrame | None = None, events: DataFrame | None = None) -> None:
        """Store what is new of a batch, with the alerts it raises.

        ``events`` may carry kafka_partition and kafka_offset of the message they tell of.
        Nothing shows before the last step; a writer that fails anywhere can be run again.
        """
        spark, batch = self._spark, uuid.uuid4().hex
        empty = spark.createDataFrame([], PREDICTIONS)
        rows = empty if predictions is None else predictions.select(*PREDICTIONS.names)
        # Written once to the shared folder, as four outputs come from it.
        rows = written(self.new_predictions(rows), "batch-predictions")
        self._append(rows, "predictions", batch)
        offsets = rows.select("kafka_partition", "kafka_offset")
        if events is not None:
            told = written(self.new_events(events), "batch-events")
            self._append(told.select(*SYSTEM_EVENTS.names), "system_events", batch)
            offsets = offsets.unionByName(told.select("kafka_partition", "kafka_offset"))
        before = stored(self.risks())
        raised = alert_records(alert_events(rows, ["module"], ORDER, before))
        self._append(raised.select(*ALERTS.names), "alerts", batch)
        newest = rows.filter("risk_level IS NOT NULL").groupBy("module").agg(
            F.max_by("risk_level", F.struct(*ORDER)).alias("risk_level")
        )
        kept = before.join(newest.select(F.col("module").alias("_m")), F.col("module").eqNullSafe(F.col("_m")), "left_anti")
        newest.unionByName(kept).write.parquet(f"{self._root}/risks/{batch}")
        offsets = offsets.filter("kafka_partition IS NOT NULL AND kafka_offset IS NOT NULL")
        marks = self.marks().unionByName(offsets.withColumnRenamed("kafka_offset", "mark"))
        marks.groupBy("kafka_partition").agg(F.max("mark").alias("mark")).write.parquet(
            f"{self._root}/marks/{batch}"
        )
        self._commits.add(batch)

    def _append(self, rows: DataFrame, name: str, batch: str) -> None:
        append_records(rows.withColumn("batch", F.lit(batch)), f"{self._root}/{name}")
