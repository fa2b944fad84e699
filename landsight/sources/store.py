"""Written intermediate tables in the shared folder.

A derived table that several plans (or several branches of one plan) read --
the long indicator table above all -- is written once as Parquet under the
session's ``spark.checkpoint.dir`` and read back.  Readers then get a stored,
typed table: column pruning, predicate pushdown into the Parquet scan,
partition pruning on the partition columns, and a lineage that starts at the
files, so a lost executor recomputes from storage, not from the raw inputs.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..session import checkpoint_dir


def table_path(df: DataFrame, name: str) -> str:
    root = checkpoint_dir(df.sparkSession).rstrip("/")
    return f"{root}/tables/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` to a fresh folder in the shared checkpoint folder and return
    a DataFrame reading it."""
    path = table_path(df, name)
    out = df
    if partition_by:
        # file sizes follow the data: small partitions share a writer, a large
        # one is split over several
        out = df.hint("rebalance", *partition_by)
    writer = out.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    # the given schema: a partition column keeps its type ("001" stays text)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)
