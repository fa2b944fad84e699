"""The request workflow as a Structured Streaming query (W1 incremental).

Requests arrive as files (Parquet or JSON lines with ``request_id, latitude,
longitude, zoom``) in a folder.  The query's state holds the first result of
every location: the log is a second source of the stream, so each of its rows
is read once, when it is new, and a micro-batch scans no log.  A request meets
the state of its location, after the log rows of the same micro-batch.

The locations that the state does not know run through the batch workflow
(``process_requests``) and are marked as asked; their log rows reach the state with a
later micro-batch.  A location asked for again before that is looked up in a
key table of the query's own results (``sources.first_results``), of which only
its buckets are read.

Progress and state lie in the checkpoint location.  What a micro-batch has
found is written to a folder of its own before anything is appended; a
micro-batch that is delivered again finds it there, so no model is called
twice, and appends only the rows the log lacks.
"""

from __future__ import annotations

import warnings

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..config import DEFAULT_MODEL_CONFIG, ModelConfig
from ..operators.cache import KEY
from ..plans.workflow import ClientFactory, process_requests, whole_key
from ..sources.first_results import merge_first_results, read_first_results
from ..sources.log import PARTITION_COL, STORED_SCHEMA, append_log, conform
from .history import log_stream

REQUEST_SCHEMA = T.StructType(
    [
        T.StructField("request_id", T.LongType()),
        T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()),
        T.StructField("zoom", T.IntegerType()),
    ]
)


def request_stream(spark: SparkSession, folder: str, fmt: str = "parquet",
                   max_files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(REQUEST_SCHEMA).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(folder)


PAYLOAD = ["image_description", "danger", "text_description"]
_KEY_FIELDS = REQUEST_SCHEMA.fields[1:]
_PAYLOAD_FIELDS = [T.StructField(c, T.StringType()) for c in PAYLOAD]
# a location's rows of either source: a log entry, or the ids of its requests
EITHER = T.StructType(
    [*_KEY_FIELDS, T.StructField("request_ids", T.ArrayType(T.LongType())), T.StructField("micros", T.LongType()), T.StructField("id", T.LongType()), *_PAYLOAD_FIELDS]
)
# of a location: its first result (``known``), or that it was asked for
STATE = T.StructType(
    [T.StructField("known", T.BooleanType()), T.StructField("late", T.BooleanType()), T.StructField("micros", T.LongType()), T.StructField("id", T.LongType()), *_PAYLOAD_FIELDS]
)
ANSWERED = T.StructType(
    [*_KEY_FIELDS, T.StructField("request_ids", T.ArrayType(T.LongType())), T.StructField("hit", T.BooleanType()), T.StructField("asked", T.BooleanType()), *_PAYLOAD_FIELDS]
)
LOOKED = T.StructType([REQUEST_SCHEMA.fields[0], *_KEY_FIELDS, *ANSWERED.fields[4:]])


def _by_location(batches):
    """Requests -> one row for each location of a batch of rows, with their ids:
    a location that is asked for often reaches its task as a few rows."""
    for rows in batches:
        if len(rows):
            ids = rows.groupby(KEY, dropna=False)["request_id"].agg(lambda x: [_none(i) for i in x.astype(object)])
            yield ids.rename("request_ids").reset_index()[[*KEY, "request_ids"]]


def _either(df: DataFrame) -> DataFrame:
    micros = F.unix_micros("timestamp") if "timestamp" in df.columns else F.lit(None)
    given = {f.name: F.col(f.name) if f.name in df.columns else F.lit(None) for f in EITHER.fields} | {"micros": micros}
    return df.select(*[given[f.name].cast(f.dataType).alias(f.name) for f in EITHER.fields])


def _none(v):
    return None if v is None or v != v else v


def _look_up(key, batches, state):
    """A location's rows of one micro-batch: log entries into the state, requests
    out with what the state then holds.  Only ids wait for the entries."""
    warnings.simplefilter("ignore", FutureWarning)  # of columns without a value, inside PySpark
    held = tuple(state.get) if state.exists else None
    before, first = held is not None, held[1:] if held and held[0] else None
    requests = []
    for rows in batches:
        for ids, micros, id, *payload in zip(*(rows[c].tolist() for c in ("request_ids", "micros", "id", *PAYLOAD))):
            if ids is not None:
                requests.append(ids)
                continue
            micros = None if pd.isna(micros) else int(micros)
            entry = (micros is None, micros, None if pd.isna(id) else int(id), *map(_none, payload))
            # the earliest, no timestamp last, then the least id
            if first is None or (entry[0], entry[1] or 0, entry[2] or 0) < (first[0], first[1] or 0, first[2] or 0):
                first = entry
    state.update((first is not None, *(first or [None] * (len(STATE) - 1))))
    if requests:
        found = dict(zip(PAYLOAD, first[3:] if first else [None] * 3))
        yield pd.DataFrame([dict(zip(KEY, key)) | {"request_ids": ids, "hit": first is not None, "asked": before} | found for ids in requests])


def looked_up(requests: DataFrame, log: DataFrame) -> DataFrame:
    """Streams of requests and of log rows -> every request with ``hit`` and the
    first result of its location, from keyed state."""
    asked = requests.mapInPandas(_by_location, T.StructType(EITHER.fields[:4]))
    rows = _either(log.where(whole_key(log))).unionByName(_either(asked))
    answered = rows.groupBy(*KEY).applyInPandasWithState(_look_up, ANSWERED, STATE, "append", "NoTimeout")
    return answered.select(F.explode("request_ids").alias("request_id"), *LOOKED.fieldNames()[1:])


def _finished(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def _not_appended(rows: DataFrame, log_path: str) -> DataFrame:
    """The rows of a batch that the log lacks: of its days, those of its stamp."""
    spark = rows.sparkSession
    days = [r[0] for r in rows.select(F.to_date("timestamp")).distinct().collect()]  # one, or two at midnight
    log = spark.read.schema(STORED_SCHEMA).parquet(log_path).where(F.col(PARTITION_COL).isin(days))
    there = log.select(*[F.col(c).alias(f"_{c}") for c in ("id", *KEY)]).distinct()
    same = [F.col(f"_{c}") == rows[c] for c in ("id", *KEY)]
    return rows.join(there, same, "left_anti")


def start_request_stream(
    spark: SparkSession,
    requests_folder: str,
    log_path: str,
    results_path: str,
    checkpoint_location: str,
    client_factory: ClientFactory,
    image_root: str,
    config: ModelConfig = DEFAULT_MODEL_CONFIG,
    fmt: str = "parquet",
    available_now: bool = False,
    processing_time: str | None = None,
    model_parallelism: int | None = None,
    fetch=None,
    max_files_per_trigger: int | None = None,
) -> StreamingQuery:
    """Start the incremental workflow; ``available_now`` drains what is there
    and stops (batch-like runs and tests)."""
    work_path = f"{results_path.rstrip('/')}-work"

    def each_batch(batch: DataFrame, epoch_id: int) -> None:
        session = batch.sparkSession
        query = session.sparkContext.getLocalProperty("sql.streaming.queryId")
        results_folder, work = f"{results_path}/query={query}/epoch={epoch_id}", f"{work_path}/{query}-{epoch_id}"
        # also when it is delivered again: the state moves on with it
        batch.write.mode("overwrite").parquet(f"{work}/looked")
        again = _finished(session, f"{work}/rows")
        if not again:
            looked = session.read.schema(LOOKED).parquet(f"{work}/looked")
            first = looked.where("hit").select(*KEY, *PAYLOAD).distinct()
            asked = looked.where("asked AND NOT hit").select(*KEY).distinct()
            own = read_first_results(session, f"{work_path}/{query}-first", asked).select(*KEY, *PAYLOAD)
            first = first.unionByName(own.join(asked, KEY, "left_semi"))
            results, new_rows = process_requests(
                looked.select(*REQUEST_SCHEMA.fieldNames()), None, client_factory, image_root, config,
                model_parallelism=model_parallelism, fetch=fetch, first=first,
            )
            results.write.mode("overwrite").parquet(results_folder)
            stamped = conform(new_rows).withColumn("id", F.unix_micros("timestamp"))
            stamped.write.mode("overwrite").parquet(f"{work}/rows")
        rows = session.read.parquet(f"{work}/rows")
        append_log(_not_appended(rows, log_path) if again else rows, log_path)
        merge_first_results(rows, f"{work_path}/{query}-first")

    stream = request_stream(spark, requests_folder, fmt, max_files_per_trigger)
    where = spark._jvm.org.apache.hadoop.fs.Path(log_path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(where)  # no log yet
    # all that is logged comes before the first request
    log = log_stream(spark, log_path)
    writer = (
        looked_up(stream, log)
        .writeStream.foreachBatch(each_batch)
        .option("checkpointLocation", checkpoint_location)
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif processing_time:
        writer = writer.trigger(processingTime=processing_time)
    return writer.start()
