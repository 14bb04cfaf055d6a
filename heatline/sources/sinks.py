"""Where results go: messages, datasets, reports and record tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heatline.operators.project import json_safe


def json_messages(df: DataFrame, replay_id: Column, key: Column) -> DataFrame:
    """Rows as keyed JSON messages; infinities cannot be sent.

    The key keeps one site's messages in order on their partition.
    """
    finite = {
        f.name: F.when(
            F.abs(f"`{f.name}`") == float("inf"),
            F.raise_error(F.lit(f"{f.name} is not JSON compliant")),
        ).otherwise(F.col(f"`{f.name}`"))
        for f in df.schema
        if isinstance(f.dataType, (T.DoubleType, T.FloatType))
    }
    safe = json_safe(df.withColumns(finite))
    fields = F.struct(
        *[F.col(f"`{c}`") for c in safe.columns if c != "_replay_id"],
        replay_id.cast("long").alias("_replay_id"),
    )
    value = F.to_json(fields, {"ignoreNullFields": "false"})
    return safe.select(key.cast("string").alias("key"), value.alias("value"))


def publish(messages: DataFrame, servers: str, topic: str) -> None:
    """S3: a batch of messages to a topic. Needs Spark's Kafka package."""
    messages.write.format("kafka").option("kafka.bootstrap.servers", servers).option(
        "topic", topic
    ).option("kafka.acks", "all").option("kafka.retries", "3").save()


def publish_stream(messages: DataFrame, servers: str, topic: str, checkpoint: str):
    """S3: a stream of messages to a topic."""
    return (
        messages.writeStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("topic", topic)
        .option("kafka.acks", "all")
        .option("checkpointLocation", checkpoint)
    )


def with_date(df: DataFrame, time: str = "event_time") -> DataFrame:
    return df.withColumn("event_date", F.to_date(time))


def _by_day(dated: DataFrame):
    """Rows gathered by day; AQE splits a busy day and joins quiet ones."""
    return dated.hint("rebalance", "event_date").write


def write_dataset(
    df: DataFrame, path: str, time: str = "event_time", mode: str = "overwrite"
) -> None:
    """A telemetry table as Parquet by day."""
    _by_day(with_date(df, time)).mode(mode).partitionBy("event_date").parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A table or report as CSV with a header."""
    df.write.mode(mode).option("header", True).csv(path)


def append_records(df: DataFrame, path: str) -> None:
    """Records appended by day."""
    _by_day(with_date(df)).mode("append").partitionBy("event_date").parquet(path)


def append_json(df: DataFrame, path: str) -> None:
    """One JSON object per line."""
    json_safe(df).write.mode("append").option("ignoreNullFields", False).json(path)


def write_thresholds(thresholds: DataFrame, path: str) -> None:
    """A JSON object of one module per line; however many modules, none are gathered."""
    entry = F.create_map("module", F.struct("warning", "critical", "source"))
    thresholds.select(F.to_json(entry).alias("value")).write.mode("overwrite").text(path)
