"""Country boundaries.

The boundary table is ``ISO_A3, ADMIN`` plus the other properties and a
``geometry`` column carried as text (GeoJSON) or bytes (WKB) -- geometry is
only drawn, never computed on.  Read from a GeoJSON FeatureCollection or from
Parquet.  Property names are kept as they are (``Name`` and ``NAME`` are
different columns; the session must be case-sensitive to read both).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_boundaries_geojson(
    spark: SparkSession, path: str, properties: Sequence[str] = ("ISO_A3", "ADMIN")
) -> DataFrame:
    """GeoJSON FeatureCollection -> one row per feature with the requested
    properties (as text) and ``geometry`` as GeoJSON text.

    Read with a fixed schema, never inferred: properties as a text map and the
    geometry as a string field, which keeps its raw JSON whatever the geometry
    type (inference fails on mixed Polygon / MultiPolygon / Point coordinates).
    """
    schema = "features array<struct<properties: map<string,string>, geometry: string>>"
    doc = spark.read.schema(schema).option("multiLine", True).json(path)
    feats = doc.select(F.explode("features").alias("f"))
    return feats.select(
        *[F.col("f.properties")[p].alias(p) for p in properties],
        F.col("f.geometry").alias("geometry"),
    )


_FEATURE_SCHEMA = "properties map<string,string>, geometry string"


def read_boundaries_geojsonseq(
    spark: SparkSession, path: str, properties: Sequence[str] = ("ISO_A3", "ADMIN")
) -> DataFrame:
    """GeoJSON text sequence (one Feature per line) -> boundary rows.  Unlike a
    FeatureCollection, which is one document and so one task, the lines are
    split across tasks."""
    feats = spark.read.schema(_FEATURE_SCHEMA).json(path)
    return feats.select(*[F.col("properties")[p].alias(p) for p in properties], "geometry")


def write_boundaries_geojsonseq(boundary: DataFrame, path: str, geometry_col: str = "geometry") -> None:
    """Boundary rows -> GeoJSON text sequence, written in parallel.  The
    geometry column holds GeoJSON text; properties are all other columns."""
    props = [c for c in boundary.columns if c != geometry_col]
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.create_map(*[x for c in props for x in (F.lit(c), F.col(c).cast("string"))]).alias("properties"),
        F.parse_json(F.col(geometry_col)).alias("geometry"),
    )
    boundary.select(F.to_json(feature).alias("value")).write.mode("overwrite").text(path)


def read_boundaries_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Boundaries stored as Parquet (``geometry`` as WKB bytes or text)."""
    return spark.read.parquet(path)
