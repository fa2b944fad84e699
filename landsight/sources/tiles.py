"""Tile image inventory.

Tiles are PNG files named ``esri_{z}_{x}_{y}.png``.  The inventory lists them
with Spark's ``binaryFile`` source; the ``content`` column is not selected, so
only file metadata is read.  Image bytes are read only where a consumer asks
for them (``read_tile_images``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.tiles import tile_from_path

TILE_GLOB = "esri_*.png"

INVENTORY_SCHEMA = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("file_name", T.StringType()),
        T.StructField("length", T.LongType()),
        T.StructField("z", T.IntegerType()),
        T.StructField("x", T.IntegerType()),
        T.StructField("y", T.IntegerType()),
    ]
)


def _tile_files(spark: SparkSession, folder: str) -> DataFrame:
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", TILE_GLOB)
        .option("recursiveFileLookup", "true")
        .load(folder)
    )


def read_tile_inventory(spark: SparkSession, folder: str) -> DataFrame:
    """``path, file_name, length, z, x, y`` of every cached tile; an empty
    or missing folder gives no rows."""
    try:
        files = _tile_files(spark, folder)
    except Exception as e:  # noqa: BLE001 -- Spark raises on a missing path
        if "PATH_NOT_FOUND" in str(e) or "does not exist" in str(e):
            return spark.createDataFrame([], INVENTORY_SCHEMA)
        raise
    key = tile_from_path(F.col("path"))
    return files.select(
        "path",
        F.regexp_extract("path", r"[^/]+$", 0).alias("file_name"),
        "length",
        key["z"].alias("z"), key["x"].alias("x"), key["y"].alias("y"),
    )


def read_tile_images(spark: SparkSession, folder: str) -> DataFrame:
    """S10 with bytes: ``file_name, content`` for consumers that need the image."""
    files = _tile_files(spark, folder)
    return files.select(F.regexp_extract("path", r"[^/]+$", 0).alias("file_name"), "content")
