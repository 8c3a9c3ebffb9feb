"""Topics as line streams. Needs the Kafka connector package on the class path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter


def source_options(servers: str, topic: str) -> dict[str, str]:
    """Subscribe to one topic from its end on; go on when old messages have expired."""
    return {
        "kafka.bootstrap.servers": servers,
        "subscribe": topic,
        "startingOffsets": "latest",
        "failOnDataLoss": "false",
    }


def sink_options(servers: str, topic: str) -> dict[str, str]:
    return {"kafka.bootstrap.servers": servers, "topic": topic}


def decode(messages: DataFrame) -> DataFrame:
    """Binary message value to text."""
    return messages.select(F.col("value").cast("string").alias("value"))


def read_lines(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    return decode(
        spark.readStream.format("kafka").options(**source_options(servers, topic)).load()
    )


def relay_lines(lines: DataFrame, servers: str, topic: str, checkpoint: str) -> DataStreamWriter:
    """A writer that forwards each line to a topic; call start() on it."""
    return (
        lines.select("value")
        .writeStream.format("kafka")
        .options(**sink_options(servers, topic))
        .option("checkpointLocation", checkpoint)
    )
