"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import sys
import types
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpoint_dir

# Text handled at once inside a task: bounds the worker's memory whatever the
# Arrow batch holds.  A single longer document is a slice of its own.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back with the
    same schema: lineage starts at files every executor can read again."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def schema_with(df: DataFrame, **more: str) -> T.StructType:
    """The schema of ``df`` with columns (name, type) added."""
    return T.StructType([*df.schema.fields, *(T.StructField(k, T._parse_datatype_string(v)) for k, v in more.items())])


def keyed_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text (null text: empty), whatever else the table has."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )


def process_cache(name: str, make):
    """A value kept for the life of a Python worker process.

    Functions reach the workers by value, so their module globals are rebuilt
    for every task; this cache is not.
    """
    store = sys.modules.setdefault("_landsight_worker_cache", types.ModuleType("_landsight_worker_cache"))
    if not hasattr(store, name):
        setattr(store, name, make())
    return getattr(store, name)


def text_slices(batches, column: str = "text", limit: int = SLICE_BYTES):
    """Yield record batches holding about ``limit`` bytes of ``column`` at most
    (one row at least), so memory does not follow the Arrow batch size."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0)
        ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < n:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
        del batch, sizes
        give_back()


def give_back() -> None:
    """Return free memory to the system: workers are reused, and what one
    operator has needed at its peak would stay with the next."""
    pa.default_memory_pool().release_unused()
    trim = process_cache("malloc_trim", lambda: getattr(ctypes.CDLL(None), "malloc_trim", None))  # glibc only
    if trim:
        trim(0)


def string_bytes(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array without nulls and its n + 1 offsets."""
    arr = pa.concat_arrays([arr.cast(pa.large_binary())])
    offsets = np.frombuffer(arr.buffers()[1], np.int64, len(arr) + 1, arr.offset * 8)
    data = np.frombuffer(arr.buffers()[2], np.uint8) if arr.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def words_of(arr: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of each text -- runs of ``[^\\x20\\x09-\\x0D]`` -- flattened, and
    the number of the text each word belongs to."""
    lists = pc.ascii_split_whitespace(arr.cast(pa.large_string()))
    flat = lists.flatten()
    rows = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    full = pc.greater(pc.binary_length(flat), 0)
    return flat.filter(full), rows[full.to_numpy(zero_copy_only=False)].astype(np.int64)


def per_row(values: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sum of ``values`` for each of ``n`` rows."""
    return np.bincount(rows, weights=values, minlength=n).astype(np.int64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the output."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))
