"""Fetching remote files into a landing folder.

A fetch plan is a DataFrame ``(seq, url, target_path)``.  Files already landed
are removed from it with an anti join against the folder's listing, the rest
are fetched by an injected ``fetch(url) -> bytes`` inside ``mapInPandas`` (one
call per row, spread over ``parallelism`` tasks), written to a temporary name
and renamed into place (K4), so a retried task never leaves a half file.  Each
row reports its byte count or its error; ``fetch_all`` fails when any error
remains, after all rows were tried.  A ``CallPolicy`` gives a call its time-out,
further attempts at what may pass, and the calls at once in a task; a file is
written only by the attempt that answered in time.

``target_path`` is a path or a URI (``file:``, ``s3://``, ``gs://``, ``hdfs://``:
what pyarrow's file systems reach) on storage that every executor shares; a
scheme that cannot be written is an error on its row.  The size of every file
is checked after it has landed.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import BOUNDARY_FILE, BOUNDARY_URL, DATASETS, INDICATOR_URL_FORMAT
from ..operators.calls import CallPolicy, Calls

FetchFn = Callable[[str], bytes]

PLAN_SCHEMA = T.StructType(
    [T.StructField("seq", T.IntegerType()), T.StructField("url", T.StringType()),
     T.StructField("target_path", T.StringType())]
)
RESULT_SCHEMA = T.StructType(
    PLAN_SCHEMA.fields + [T.StructField("bytes", T.LongType()), T.StructField("error", T.StringType())]
)


def dataset_catalogue(spark: SparkSession) -> DataFrame:
    """S1 + F25: display name, file name, dataset id, source slug and URL of
    every indicator dataset, in catalogue order."""
    rows = [(i, name, f, f[:-4], slug) for i, (name, f, slug) in enumerate(DATASETS)]
    df = spark.createDataFrame(rows, "seq int, display_name string, file_name string, dataset string, slug string")
    return df.withColumn("url", F.format_string(INDICATOR_URL_FORMAT, F.col("slug")))


def download_plan(spark: SparkSession, download_dir: str = "downloads") -> DataFrame:
    """S2 + S3: the five indicator CSVs, then the boundary archive, each into
    ``download_dir``."""
    cat = dataset_catalogue(spark)
    sep = "" if download_dir.endswith("/") else "/"
    files = cat.select(
        "seq", "url", F.concat(F.lit(download_dir + sep), F.col("file_name")).alias("target_path")
    )
    boundary = spark.createDataFrame(
        [(len(DATASETS), BOUNDARY_URL, download_dir + sep + BOUNDARY_FILE)], PLAN_SCHEMA
    )
    return files.unionByName(boundary)


def tile_fetch_plan(work_list: DataFrame, tile_dir: str) -> DataFrame:
    """A tile work list (``file_name, url``, from J3) as a fetch plan."""
    sep = "" if tile_dir.endswith("/") else "/"
    return work_list.select(
        F.lit(None).cast("int").alias("seq"), "url",
        F.concat(F.lit(tile_dir + sep), F.col("file_name")).alias("target_path"),
    )


def plain_path(path):
    """One spelling for local files: ``file:/x``, ``file:///x`` and ``/x`` are ``/x``."""
    return F.regexp_replace(path, r"^file:/+", "/")


def landed_files(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """Paths already present in ``folder`` (metadata only, no bytes read)."""
    try:
        files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    except Exception as e:  # noqa: BLE001 -- a missing folder has no files
        if "PATH_NOT_FOUND" in str(e) or "does not exist" in str(e):
            return spark.createDataFrame([], "target_path string")
        raise
    return files.select(plain_path(F.col("path")).alias("target_path"))


def file_system(path: str):
    """The file system of a path or URI, and the path inside it."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        if path.startswith("file:") and not path.startswith("file://"):
            path = "file://" + path[len("file:") :]
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), os.path.abspath(path)


def _write_atomically(path: str, data: bytes) -> None:
    system, where = file_system(path)
    folder, _, name = where.rpartition("/")
    hidden = f"{folder}/.{name}.{uuid.uuid4().hex}.part"
    try:
        out = system.open_output_stream(hidden)
    except FileNotFoundError:
        system.create_dir(folder, recursive=True)
        out = system.open_output_stream(hidden)
    with out:
        out.write(data)
    system.move(hidden, where)
    if system.get_file_info(where).size != len(data):
        raise OSError(f"{path} did not land whole")


def run_fetch(plan: DataFrame, fetch: FetchFn, parallelism: int | None = None,
              skip_landed: DataFrame | None = None, policy: CallPolicy = CallPolicy()) -> DataFrame:
    """Fetch every plan row (minus ``skip_landed`` target paths); returns the
    plan with ``bytes`` written and ``error`` (NULL on success)."""
    if skip_landed is not None:
        landed = skip_landed.select(plain_path(F.col("target_path")).alias("landed")).distinct()
        plan = plan.join(landed, plain_path(F.col("target_path")) == F.col("landed"), "left_anti")
    plan = plan.select(*[f.name for f in PLAN_SCHEMA.fields])
    # one row = one download but a few bytes: AQE would pack a work list into
    # very few tasks, so it is spread round-robin over a set number of tasks
    from ..session import call_tasks

    plan = plan.repartition(parallelism or call_tasks(plan.sparkSession))
    names = [f.name for f in RESULT_SCHEMA.fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with Calls(lambda: None, lambda _, url: fetch(url), policy) as calls:
            for pdf in batches:
                sizes, errors, targets = [None] * len(pdf), [None] * len(pdf), list(pdf["target_path"])

                def landed(place, data, error):
                    try:
                        if error is not None:
                            raise error
                        _write_atomically(targets[place], data)
                        sizes[place] = len(data)
                    except Exception as e:  # noqa: BLE001 -- reported per row
                        errors[place] = f"{type(e).__name__}: {e}"

                calls.run(pdf["url"], landed)
                yield pdf.assign(bytes=pd.array(sizes, dtype="Int64"), error=errors)[names]

    return plan.mapInPandas(run, RESULT_SCHEMA)


class FetchError(RuntimeError):
    """Some fetches failed; ``results`` is the full result table."""

    def __init__(self, message: str, results: DataFrame):
        super().__init__(message)
        self.results = results


def fetch_all(plan: DataFrame, fetch: FetchFn, parallelism: int | None = None,
              skip_landed: DataFrame | None = None, policy: CallPolicy = CallPolicy()) -> DataFrame:
    """Run the plan once; if any fetch failed, raise ``FetchError`` that names
    some of the failed URLs and holds the whole result table.  The results are
    checkpointed into the shared folder, so nothing is fetched twice."""
    from ..session import checkpoint_dir

    checkpoint_dir(plan.sparkSession)
    results = run_fetch(plan, fetch, parallelism, skip_landed, policy).checkpoint(eager=True)
    failed = results.where(F.col("error").isNotNull()).limit(10).collect()
    if failed:
        raise FetchError("fetch failed: " + "; ".join(f"{r.url}: {r.error}" for r in failed), results)
    return results


def download_datasets(spark: SparkSession, fetch: FetchFn, download_dir: str = "downloads") -> list:
    """S2 + S3 end to end: every dataset CSV and the boundary archive; returns
    the six result rows in catalogue order."""
    return fetch_all(download_plan(spark, download_dir), fetch).orderBy("seq").collect()


def plan_targets(results: Sequence) -> list[str]:
    return [r.target_path for r in results]
