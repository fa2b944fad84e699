"""Broadcast only behind a size check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A dimension (boundaries, catalogue) above this many rows, or above this many
# bytes (geometry columns can be large), is joined by shuffle.
DEFAULT_MAX_BROADCAST_ROWS = 100_000
DEFAULT_MAX_BROADCAST_BYTES = 256 * 1024 * 1024


def _value_bytes(field: T.StructField):
    """Bytes of one value: text and binary by length, nested values by their
    JSON text, everything else as 8 bytes."""
    c = F.col(f"`{field.name}`")
    dt = field.dataType
    if isinstance(dt, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0))
    if isinstance(dt, (T.ArrayType, T.MapType, T.StructType)):
        return F.coalesce(F.octet_length(F.to_json(c)), F.lit(0))
    return F.lit(8)


def fits_broadcast(
    df: DataFrame,
    max_rows: int = DEFAULT_MAX_BROADCAST_ROWS,
    max_bytes: int = DEFAULT_MAX_BROADCAST_BYTES,
) -> bool:
    """True when ``df`` has at most ``max_rows`` rows holding at most
    ``max_bytes`` bytes.

    One aggregation (partial sums per task, one row each) counts the rows and
    sums their value sizes.  Meant for dimension tables read from storage, not
    for plans whose evaluation is expensive.
    """
    size = sum((_value_bytes(f) for f in df.schema.fields), F.lit(0))
    row = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("b")).first()
    return row["n"] <= max_rows and row["b"] <= max_bytes


def maybe_broadcast(
    df: DataFrame,
    max_rows: int = DEFAULT_MAX_BROADCAST_ROWS,
    max_bytes: int = DEFAULT_MAX_BROADCAST_BYTES,
) -> DataFrame:
    """``F.broadcast(df)`` when the size check passes, else ``df`` unchanged
    (the join then shuffles, and AQE may still broadcast at run time)."""
    return F.broadcast(df) if fits_broadcast(df, max_rows, max_bytes) else df
