"""The analysis log: fixed schema, readers and writers.

At rest the log is an append-only Parquet table partitioned by
``analysis_date`` (one folder per day), so date filters prune files and an
append never rewrites history.  A CSV export with a header is offered for
interchange.
"""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import utc_time
from .csv_records import read_text_columns

# The log's columns, in order.
LOG_SCHEMA = T.StructType(
    [
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()),
        T.StructField("zoom", T.IntegerType()),
        T.StructField("image_description", T.StringType()),
        T.StructField("image_prompt", T.StringType()),
        T.StructField("image_model", T.StringType()),
        T.StructField("text_description", T.StringType()),
        T.StructField("text_prompt", T.StringType()),
        T.StructField("text_model", T.StringType()),
        T.StructField("danger", T.StringType()),
    ]
)
LOG_FIELDS = LOG_SCHEMA.fieldNames()

PARTITION_COL = "analysis_date"

# Order of storage: given with the rows, else the time of the append (a batch
# holds a key once).  Kept beside the log's own columns.
ID_FIELD = T.StructField("id", T.LongType())
STORED_SCHEMA = T.StructType(LOG_SCHEMA.fields + [ID_FIELD, T.StructField(PARTITION_COL, T.DateType())])


def empty_log(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], LOG_SCHEMA)


def _missing(e: Exception) -> bool:
    msg = str(e)
    return "PATH_NOT_FOUND" in msg or "does not exist" in msg


def read_log(spark: SparkSession, path: str, with_id: bool = False) -> DataFrame:
    """The Parquet log; a missing table reads as no rows (fixed schema).
    ``with_id`` adds the order of storage, which lookups need."""
    names = [*LOG_FIELDS, "id"] if with_id else LOG_FIELDS
    try:
        df = spark.read.schema(STORED_SCHEMA).parquet(path)
    except Exception as e:  # noqa: BLE001
        if _missing(e):
            return spark.createDataFrame([], STORED_SCHEMA).select(*names)
        raise
    return df.select(*names)


def read_log_csv(spark: SparkSession, path: str) -> DataFrame:
    """S7 + S8: a CSV log (header, quoted fields with newlines); the timestamp is
    parsed with ``try_to_timestamp`` so ISO text with or without fractions both
    load, and bad text becomes NULL.  Missing or empty input reads as no rows.
    A file is split over tasks, whatever its fields hold."""
    try:
        files = sorted(unquote(f) for f in spark.read.text(path).inputFiles())
    except Exception as e:  # noqa: BLE001
        if _missing(e):
            return empty_log(spark)
        raise
    if not files:
        return empty_log(spark)
    raw = read_text_columns(spark, files, LOG_FIELDS)
    return raw.select(
        F.try_to_timestamp(F.col("timestamp")).cast("timestamp").alias("timestamp"),
        *[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in LOG_SCHEMA.fields[1:]],
    )


def conform(rows: DataFrame, *more) -> DataFrame:
    """Cast and order a frame to the log schema (missing columns are NULL)."""
    return rows.select(
        *[
            (F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in LOG_SCHEMA.fields
        ],
        *more,
    )


def append_log(rows: DataFrame, path: str) -> None:
    """K1 + U2: append a whole batch of log rows, partitioned by analysis date.

    Spark's commit protocol makes the append atomic per job: a failed or
    retried task leaves no partial rows, unlike an unlocked file append."""
    order = F.col("id").cast("long") if "id" in rows.columns else F.unix_micros(F.current_timestamp())
    out = conform(rows, order.alias("id")).withColumn(PARTITION_COL, F.to_date(utc_time("timestamp")))
    # rebalance by day: AQE sizes the write partitions -- small days share a
    # task, a hot day is split over several -- so a bulk append spanning many
    # days writes right-sized files instead of one per task and day
    out = out.hint("rebalance", PARTITION_COL)
    out.write.mode("append").partitionBy(PARTITION_COL).parquet(path)


def export_log_csv(log: DataFrame, path: str) -> None:
    """K3: CSV export with a header line (one per part file), fields quoted
    as needed so multi-line descriptions survive the round trip."""
    (
        conform(log).write.mode("overwrite")
        .option("header", True)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
        .csv(path)
    )
