"""Integer vectors and blocks of queries against shards of rows, shared by the
searches over embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHARD_ROWS = 4096  # rows of a shard
BLOCK_QUERIES = 4096  # queries that meet a shard in one group
EXACT = float(1 << 53)  # integers that doubles hold exactly


def integer_vectors(df: DataFrame, scale: int, *more: Column, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id``, ``v`` (floor(scale * x) of every component x, as a double) and
    the columns ``more``.  Rows without an id, without a vector, or with a null
    or non-finite component are left out."""
    x = F.col(vector_col)
    finite = F.forall(x, lambda c: c.isNotNull() & (F.abs(F.nanvl(c.cast("double"), F.lit(float("inf")))) < float("inf")))
    whole = F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")))
    return df.where(F.col(id_col).isNotNull() & x.isNotNull() & finite).select(F.col(id_col).cast("long").alias("vec_id"), whole.alias("v"), *more)


def of_number(n: int, each: int) -> int:
    """How many shards or blocks of ``each`` hold ``n`` rows."""
    return max(1, -(-n // each))


def dealt(parts: int, *cols: str) -> Column:
    """A number below ``parts`` by the hash of the columns."""
    return F.pmod(F.xxhash64(*cols), F.lit(parts)).cast("int")


def matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    """A list column whose lists have ``dims`` elements each, as rows of int64."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(flat, pa.ChunkedArray):  # no chunk at all
        flat = pa.concat_arrays(flat.chunks) if flat.num_chunks else pa.array([], column.type)
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(flat), dims)


def for_scores(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both matrices as doubles where those give exact scores, which is the fast
    way, else as 64-bit integers.  Scores beyond 64 bits are an error."""
    if not x.size or not y.size:
        return x.astype(np.float64), y.astype(np.float64)
    bound = float(np.abs(x.astype(np.float64)).sum(axis=1).max()) * float(np.abs(y.astype(np.float64)).max())
    if bound < EXACT:
        return x.astype(np.float64), y.astype(np.float64)
    if bound < float(1 << 62):
        return x, y
    raise ValueError("a score does not fit 64 bits")
