"""Text and parquet tables of log lines and parsed logs.

The log table is `load=L.A/date=D/`, where L names a load (a file, an hour, a micro-batch) and
A the attempt that wrote it. What a load holds is told by its manifest `_loads/try=L.A`,
which is written last: a load that was cut short is not read, and one that is written
again takes the place of its earlier attempt, on whichever days either had lines. Each
load has a directory of its own, so loads may be written at the same time.
"""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.functions.clf import REASONS
from logloom.schema import LOG_SCHEMA

# Fixed value: a day of the log table.
DAY_DIRECTORY = r"date=(\d{4}-\d{2}-\d{2})"
# The "day" under which a load keeps the lines that did not parse.
REJECTED = "rejected"
# Folder of the manifests; Spark's readers pass over names that begin so.
LOADS = "_loads"
_LOAD_NAME = r"[A-Za-z0-9_-]+"
_LOADS_SCHEMA = "load string, attempt string, days array<string>, lines bigint, rejects map<string, bigint>"


def read_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """Raw lines, one row each, in column `value`."""
    return spark.read.text(list(paths)).select("value")


def write_logs(parsed: DataFrame, root: str, load: str, *, rebalance: bool = True) -> dict[str, int]:
    """Add a load to the log table; returns how many lines it had, and of each reject reason.

    A day may come in any number of loads. The same load written again replaces itself and
    nothing else, so a rerun is harmless. Lines that did not parse go to the same load's
    rejects (see read_rejects()), in the same job: the text is read and parsed once, and the
    counts are observed by the tasks that write.

    With `rebalance`, rows are shuffled by day into files of even size: the hint, unlike
    repartition(), lets Spark cut a large day into many tasks. Turn it off for input that is
    already in time order, where each task holds one or two days and the shuffle of the
    whole table buys nothing.
    """
    if not re.fullmatch(_LOAD_NAME, load):
        raise ValueError(f"a load is named by letters, digits, _ and -, not {load!r}")
    spark = parsed.sparkSession
    attempt = f"{time.time_ns() // 1_000_000:015d}{uuid.uuid4().hex[:6]}"
    is_log = F.col("reject_reason").isNull()
    columns = [c for c in parsed.columns if c not in ("line", "date")]
    rows = parsed.select(
        *columns, F.when(~is_log, F.col("line")).alias("line"),
        F.when(is_log, F.col("date")).otherwise(REJECTED).alias("date"),
    )
    if rebalance:
        rows = rows.hint("rebalance", F.col("date"))
    # Observed behind the shuffle, in the tasks whose success is counted once.
    seen = Observation()
    counts = [F.count_if(F.col("reject_reason") == r).alias(r) for r in REASONS]
    days = F.collect_set(F.when(F.col("reject_reason").isNull(), F.col("date"))).alias("days")
    rows = rows.observe(seen, F.count(F.lit(1)).alias("lines"), days, *counts)
    rows.write.partitionBy("date").parquet(f"{root}/load={load}.{attempt}")
    found = seen.get
    rejects = {r: found[r] for r in REASONS if found[r]}
    manifest = spark.createDataFrame([(load, attempt, sorted(found["days"]), found["lines"], rejects)], _LOADS_SCHEMA)
    earlier = _manifests(spark, root).where(F.col("load") == load).collect()
    manifest.coalesce(1).write.parquet(f"{root}/{LOADS}/try={load}.{attempt}")
    for old in earlier:
        delete(spark, f"{root}/load={load}.{old.attempt}")
        delete(spark, f"{root}/{LOADS}/try={load}.{old.attempt}")
    return {"lines": found["lines"], **rejects}


def _manifests(spark: SparkSession, root: str) -> DataFrame:
    """All manifests, also of attempts that a later one has replaced; a row each."""
    if not exists(spark, f"{root}/{LOADS}"):
        return spark.createDataFrame([], _LOADS_SCHEMA)
    return spark.read.schema(_LOADS_SCHEMA).parquet(f"{root}/{LOADS}").select("load", "attempt", "days", "lines", "rejects")


def read_loads(spark: SparkSession, root: str) -> DataFrame:
    """(load, attempt, days, lines, rejects): the newest finished attempt at every load."""
    newest = F.max_by(F.struct("attempt", "days", "lines", "rejects"), "attempt").alias("__m")
    return _manifests(spark, root).groupBy("load").agg(newest).select("load", "__m.*")


def forget_leftovers(spark: SparkSession, root: str) -> int:
    """Delete the directories of attempts that no manifest names, as killed jobs leave them.

    For maintenance, while nothing is being loaded; returns how many there were.
    """
    named = {f"{r.load}.{r.attempt}" for r in _manifests(spark, root).select("load", "attempt").collect()}
    gone = [name for name in list_partitions(spark, root, r"load=(.*)") if name not in named]
    for name in gone:
        delete(spark, f"{root}/load={name}")
    return len(gone)


def loads_by_day(spark: SparkSession, root: str) -> DataFrame:
    """(date, loads): the loads, with their attempts, that each day of the log table is made of."""
    name = F.concat_ws(".", "load", "attempt")
    exploded = read_loads(spark, root).select(F.explode("days").alias("date"), name.alias("load"))
    return exploded.groupBy("date").agg(F.array_sort(F.collect_list("load")).alias("loads"))


def read_logs(spark: SparkSession, root: str, days: Iterable[str] | None = None) -> DataFrame:
    """The log table, or some days of it.

    With the schema given, no file is opened to infer it and `date` stays text. Only the
    directories that manifests name are listed, and with `days` only those of these days.
    """
    schema = T.StructType([f for f in LOG_SCHEMA if f.name != "date"])
    columns = [*schema.fieldNames(), "date"]
    schema = schema.add(T.StructField("date", T.StringType(), True))
    found = loads_by_day(spark, root)
    if days is not None:
        found = found.where(F.col("date").isin(list(days)))
    # A short text per directory, which the reader lists anyway.
    paths = [f"{root}/load={x}/date={r.date}" for r in found.collect() for x in r.loads]
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", root).parquet(*paths).select(*columns)


def read_rejects(spark: SparkSession, root: str) -> DataFrame:
    """(load, line, reject_reason) of the lines of all loads that did not parse."""
    schema = "line string, reject_reason string, load string"
    own = read_loads(spark, root).where(F.size("rejects") > 0).collect()
    paths = [f"{root}/load={r.load}.{r.attempt}/date={REJECTED}" for r in own]
    if not paths:
        return spark.createDataFrame([], schema).select("load", "line", "reject_reason")
    rows = spark.read.schema(schema).option("basePath", root).parquet(*paths)
    return rows.select(F.substring_index("load", ".", 1).alias("load"), "line", "reject_reason")


def reject_totals(spark: SparkSession, root: str) -> DataFrame:
    """(load, reject_reason, lines) as the loads counted them; no line is read."""
    return read_loads(spark, root).select("load", F.explode("rejects").alias("reject_reason", "lines"))


def _file_system(spark: SparkSession, path: str):
    """Hadoop's path and the file system it lies in."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def delete(spark: SparkSession, path: str) -> None:
    found, fs = _file_system(spark, path)
    fs.delete(found, True)


def exists(spark: SparkSession, path: str) -> bool:
    found, fs = _file_system(spark, path)
    return fs.exists(found)


def list_partitions(
    spark: SparkSession, root: str, pattern: str, *, finished: bool = False
) -> list[str]:
    """First group of `pattern` for each subdirectory of `root` it matches as a whole.

    With `finished`, only of those that hold the mark Spark's writer leaves when all
    of its tasks are committed. No data file is touched.
    """
    path, fs = _file_system(spark, root)
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory()]
    found = {n: m.group(1) for n in names if (m := re.fullmatch(pattern, n))}
    return sorted(v for n, v in found.items() if not finished or exists(spark, f"{root}/{n}/_SUCCESS"))


def list_days(spark: SparkSession, root: str) -> DataFrame:
    """(date): the days present in the log table; other directories are ignored."""
    return loads_by_day(spark, root).select("date")
