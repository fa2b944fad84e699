"""Incremental History reports over the log as it grows (A9, A10 streaming).

The log table is read as a stream of appended files.  Two reports:

* running totals of the risk KPIs (``complete`` mode): the state is a handful
  of counters whatever the log size;
* KPIs per analysis day: the counts of every micro-batch are kept per log file
  and day and added up on reading, so late rows and the last day are always in
  the report, and a file that is counted again still counts once.

The definitions are the batch ones of ``operators.history``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import utc_time
from ..sources.log import STORED_SCHEMA


COUNTS = ["total_analyses", "at_risk", "showing_safe"]
COUNT_SCHEMA = "file string, day date, total_analyses long, at_risk long, showing_safe long"


def log_stream(spark: SparkSession, log_path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """The Parquet log as a stream (fixed schema, date partition column)."""
    reader = spark.readStream.schema(STORED_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(log_path)


def _counts(grouped) -> DataFrame:
    d = F.col("danger")
    return grouped.agg(
        F.count(F.lit(1)).alias("total_analyses"),
        F.count_if(F.coalesce(d == "Y", F.lit(False))).alias("at_risk"),
        F.count_if(F.coalesce(d == "N", F.lit(False))).alias("showing_safe"),
    )


def _with_rates(df: DataFrame, *keys: str) -> DataFrame:
    rate = F.coalesce(
        F.bround(F.try_divide(F.col("at_risk"), F.col("total_analyses")) * 100.0, 0), F.lit(0.0)
    ).cast("long")
    return df.select(
        *keys, "total_analyses", "at_risk",
        (F.col("total_analyses") - F.col("at_risk")).alias("safe"),
        rate.alias("risk_rate_pct"), F.col("at_risk").alias("showing_at_risk"), "showing_safe",
    )


def running_risk_kpis(stream: DataFrame) -> DataFrame:
    """A9 + A10 over everything seen so far (use ``complete`` output mode)."""
    return _with_rates(_counts(stream.groupBy()))


def daily_counts(log: DataFrame) -> DataFrame:
    """Counts per analysis day (UTC); they add up over parts of the log."""
    return _counts(log.groupBy(F.to_date(utc_time("timestamp")).alias("day")))


def daily_risk_kpis(log: DataFrame) -> DataFrame:
    """A9 + A10 per analysis day (UTC)."""
    return _with_rates(daily_counts(log), "day")


def file_counts(batch: DataFrame) -> DataFrame:
    """Counts per log file and analysis day.  A log file never changes, so
    whoever counts it, whenever, gets the same rows."""
    return _counts(batch.groupBy(F.col("file_path").alias("file"), F.to_date(utc_time("timestamp")).alias("day")))


def _counted(spark: SparkSession, out_path: str) -> DataFrame:
    """Every counted (file, day) once, however often it was counted.

    Two counts of one file are equal, so their maximum is either; it is a partial
    and final aggregate, and no join with a list of files is needed."""
    parts = spark.read.schema(COUNT_SCHEMA).option("recursiveFileLookup", True).parquet(out_path)
    return parts.groupBy("file", "day").agg(*[F.max(c).alias(c) for c in COUNTS])


def read_daily_risk_kpis(spark: SparkSession, out_path: str) -> DataFrame:
    """The report that ``start_daily_risk_kpis`` keeps: every day seen so far,
    with all its rows, however late they came, and however often a file was
    counted (a replay, a second query or a new checkpoint over the same log)."""
    sums = _counted(spark, out_path).groupBy("day").agg(*[F.sum(c).alias(c) for c in COUNTS])
    return _with_rates(sums, "day")


def compact_daily_counts(spark: SparkSession, out_path: str) -> int:
    """Rewrite the counts of many micro-batches as one set of files and drop the
    folders they came from; returns how many were dropped.

    Safe at any point of failure: folders go only after the compacted one is
    whole, and until then a (file, day) in both counts once.  Batches that arrive
    meanwhile are not touched.  Run it where no report is being read: a
    reader that has listed a folder misses it."""
    names = [f for f in _folders(spark, out_path)]
    if len(names) < 2:
        return 0
    paths = [f"{out_path}/{n}" for n in names]
    parts = spark.read.schema(COUNT_SCHEMA).option("recursiveFileLookup", True).parquet(*paths)
    one = parts.groupBy("file", "day").agg(*[F.max(c).alias(c) for c in COUNTS])
    one.hint("rebalance").write.parquet(f"{out_path}/compacted-{uuid.uuid4().hex}")
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    return len(paths)


def _folders(spark: SparkSession, path: str) -> list[str]:
    """Folders of finished writes: a batch's write that has not ended has no
    ``_SUCCESS`` file, and is left alone."""
    jvm = spark._jvm.org.apache.hadoop.fs
    root = jvm.Path(path)
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(root):
        return []
    names = [s.getPath().getName() for s in system.listStatus(root) if s.isDirectory()]
    return sorted(n for n in names if system.exists(jvm.Path(f"{path}/{n}/_SUCCESS")))


def start_daily_risk_kpis(
    spark: SparkSession, log_path: str, out_path: str, checkpoint_location: str, available_now: bool = False,
    max_files_per_trigger: int | None = None,
) -> StreamingQuery:
    """Keep the counts of each micro-batch per log file and day in a folder of
    its own (query and batch), which a replayed batch overwrites.  A micro-batch
    holds whole files.  No watermark and no state: a late row is one more
    count of its day, and a file counted again, by a replay or by a query with
    another checkpoint, is known by its name."""

    def each_batch(batch: DataFrame, epoch: int) -> None:
        query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        file_counts(batch).write.mode("overwrite").parquet(f"{out_path}/{query}-{epoch}")

    # the file's name is a column of the scan, not of the log
    log = log_stream(spark, log_path, max_files_per_trigger).select("timestamp", "danger", "_metadata.file_path")
    writer = log.writeStream.foreachBatch(each_batch).option("checkpointLocation", checkpoint_location)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
