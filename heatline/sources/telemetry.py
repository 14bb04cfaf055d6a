"""Where telemetry comes from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heatline.schema import ENVELOPE


def read_telemetry(
    spark: SparkSession, path: str, schema: T.StructType | str, fmt: str = "csv"
) -> DataFrame:
    """A telemetry table under a declared layout; nothing is inferred."""
    reader = spark.read.schema(schema)
    return reader.csv(path, header=True) if fmt == "csv" else reader.format(fmt).load(path)


def kafka_messages(
    spark: SparkSession, servers: str, topic: str, starting: str = "latest",
    most_per_batch: int | None = None,
) -> DataFrame:
    """The topic as a stream of envelopes. Needs Spark's Kafka package.

    The checkpoint takes the place of a consumer group and its commits.
    """
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", starting)
    )
    if most_per_batch:
        reader = reader.option("maxOffsetsPerTrigger", most_per_batch)
    return reader.load().select(
        F.col("key").cast("string"), F.col("value").cast("string"),
        "topic", "partition", "offset", "timestamp",
    )


def file_messages(
    spark: SparkSession, path: str, fmt: str = "parquet", files_per_batch: int | None = None
) -> DataFrame:
    """The same envelopes from files."""
    return replay_stream(spark, path, ENVELOPE, fmt, files_per_batch)


def replay_stream(
    spark: SparkSession, path: str, schema: T.StructType | str, fmt: str = "parquet",
    files_per_batch: int | None = None,
) -> DataFrame:
    """A stored table as a stream."""
    reader = spark.readStream.schema(schema).format(fmt)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def read_records(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A record table without its partition column; filter on time to prune days."""
    return spark.read.parquet(path).select(*schema.names)


def read_thresholds(spark: SparkSession, path: str) -> DataFrame:
    """JSON objects of modules as rows, still unchecked.

    One object to a line, or a single one over the whole file.
    """
    names = ("warning", "critical", "Warning_95", "Critical_99", "source")
    levels = "map<string,struct<" + ",".join(f"{n}:string" for n in names) + ">>"
    for whole in (False, True):
        text = spark.read.text(path, wholetext=whole).filter(F.trim("value") != "")
        parsed = text.select(F.from_json("value", levels).alias("levels"))
        if parsed.filter(F.col("levels").isNull()).isEmpty():
            break
    else:
        raise ValueError("Threshold configuration must be a JSON object")
    return parsed.select(F.explode("levels").alias("module", "level")).select(
        "module", *[f"level.{n}" for n in names]
    )
