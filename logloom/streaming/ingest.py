"""Taking lines in: drop directories into one text table, or parsed into the log table."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter

from logloom.functions.clf import parse_lines
from logloom.sources.files import write_logs

# A landed file is rolled at this size or age.
ROLL_BYTES = 134_217_728
ROLL_SECONDS = 180


def watch_directories(
    spark: SparkSession, directories: Sequence[str], *, files_per_batch: int | None = None
) -> DataFrame:
    """Lines of every new file in any of the directories, each file once."""
    lines = None
    for directory in directories:
        reader = spark.readStream.format("text")
        if files_per_batch is not None:
            reader = reader.option("maxFilesPerTrigger", files_per_batch)
        source = reader.load(directory)
        lines = source if lines is None else lines.unionByName(source)
    if lines is None:
        raise ValueError("no directory to watch")
    return lines


def land_lines(
    lines: DataFrame,
    root: str,
    checkpoint: str,
    *,
    roll_bytes: int = ROLL_BYTES,
    trigger: dict | None = None,
) -> DataStreamWriter:
    """A writer that lands lines as text files; call start() on it.

    Files close at each trigger (every ROLL_SECONDS) and at `roll_bytes`: each task adds up
    the bytes of its lines and begins a new file (`roll=N`) before the line that would
    take it over the limit. A single longer line has a file of its own.
    """
    return (
        with_rolls(lines, roll_bytes)
        .writeStream.format("text")
        .partitionBy("roll")
        .option("path", root)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": f"{ROLL_SECONDS} seconds"}))
    )


def with_rolls(lines: DataFrame, roll_bytes: int) -> DataFrame:
    """(value, roll): the number of the file, within its task, that each line belongs in.

    A running sum in the order of a task's lines, carried over its batches; nothing is shuffled.
    Null lines, which text files cannot hold apart from empty ones, count as empty.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll, room = 0, roll_bytes
        for batch in batches:
            sizes = pc.add(pc.fill_null(pc.binary_length(batch.column("value")), 0), 1)
            ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
            rolls = np.empty(len(ends), np.int32)
            at, base = 0, 0
            while at < len(ends):
                # All lines from here on that end within the room left.
                stop = int(np.searchsorted(ends, base + room, side="right"))
                if stop == at and room == roll_bytes:
                    stop = at + 1
                rolls[at:stop] = roll
                if stop < len(ends):
                    roll, room = roll + 1, roll_bytes
                else:
                    room -= int(ends[-1]) - base
                base, at = int(ends[stop - 1]) if stop else base, stop
            yield pa.RecordBatch.from_arrays([batch.column("value"), pa.array(rolls)], names=["value", "roll"])

    return lines.select("value").mapInArrow(rows, "value string, roll int")


def log_stream(
    lines: DataFrame, root: str, checkpoint: str, *, name: str = "stream", trigger: dict | None = None
) -> DataStreamWriter:
    """A writer that parses lines into the log table (see write_logs()); call start() on it.

    Each micro-batch is a load of its own, named by its number, so a batch that is delivered
    again replaces itself, and the daily reports find the days that it changed. Streams
    into one table need different names.
    """

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        write_logs(parse_lines(batch), root, f"{name}-{batch_id}")

    return (
        lines.writeStream.foreachBatch(on_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": f"{ROLL_SECONDS} seconds"}))
    )
