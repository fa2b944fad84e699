"""Tile preview for a table of coordinates (D6): all native expressions, one
projection -- no shuffle at all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import tiles as TL


def tile_preview(coords: DataFrame, lat: str = "latitude", lon: str = "longitude", zoom: str = "zoom") -> DataFrame:
    """Per coordinate -- the tile (F1), its bounds (F2), centre (F3), ring
    (F4), zoom caption (F7), preview zoom (F8) and the 5-decimal location labels
    (F6) -- next to the input columns."""
    b = TL.tile_bounds(lat, lon, zoom)
    return (
        coords.withColumn("tile", TL.tile_xyz(lat, lon, zoom))
        .withColumn("bounds", b)
        .withColumn("center", TL.bounds_center(F.col("bounds")))
        .withColumn("ring", TL.bounds_ring(F.col("bounds")))
        .withColumn("zoom_label", TL.zoom_label(zoom))
        .withColumn("preview_zoom", TL.preview_zoom(zoom))
        .withColumn("lat_label", X.coordinate_label(lat, "lat", 5))
        .withColumn("lon_label", X.coordinate_label(lon, "lon", 5))
    )
