"""Web Mercator tile math as native column expressions.

No UDF: ``pow, radians, tan, cos, ln, sinh, atan`` and a truncating cast are
all Catalyst expressions, so these stay inside whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Latitude clamp of the tile index, and the tile file name and
# tile URL formats (the URL takes z, y, x; the file name z, x, y).
MAX_LATITUDE = 90.0
TILE_FILE_FORMAT = "esri_%d_%d_%d.png"
TILE_FILE_PATTERN = r"esri_(\d+)_(\d+)_(\d+)\.png"
TILE_URL_FORMAT = (
    "https://server.arcgisonline.com/ArcGIS/rest/services/World_Imagery/MapServer/tile/%d/%d/%d"
)

# Zoom-level captions (inclusive ranges).
ZOOM_LABELS = [
    (1, 4, "Continental view"),
    (5, 8, "Country / region"),
    (9, 11, "City level"),
    (12, 14, "District level"),
    (15, 17, "Neighbourhood"),
    (18, 20, "Building level"),
]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _tile_count(zoom) -> Column:
    return F.pow(F.lit(2.0), _c(zoom).cast("double"))


def _clamp_index(v: Column, n: Column) -> Column:
    return F.greatest(F.lit(0), F.least((n - 1).cast("long"), v))


def _tile_x(lon, n) -> Column:
    return ((_c(lon) + 180.0) / 360.0 * n).try_cast("long")


def tile_xyz(lat, lon, zoom) -> Column:
    """``struct(z, x, y)`` of the tile holding (lat, lon) at ``zoom``.

    Latitude is clamped to +-90; x and y are truncated toward zero and clamped
    to ``[0, 2^z - 1]``.  A NULL or NaN coordinate or a NULL zoom gives NULL.  At the south pole the logarithm's argument is 0 (the
    formula is undefined there); Spark's ``ln`` gives NULL, mapped to the last
    row ``2^z - 1``.  The north pole gives row 0 through the clamp.
    """
    n = _tile_count(zoom)
    lat_c = F.greatest(F.lit(-MAX_LATITUDE), F.least(F.lit(MAX_LATITUDE), _c(lat).cast("double")))
    x = _clamp_index(_tile_x(lon, n), n)
    y = _clamp_index(F.coalesce(_mercator_row(lat_c, n), (n - 1).cast("long")), n)
    tile = F.struct(_c(zoom).cast("int").alias("z"), x.cast("int").alias("x"), y.cast("int").alias("y"))
    return F.when(_placed(lat, lon, zoom), tile)


def _placed(lat, lon, zoom) -> Column:
    """All three are given (``least`` and ``greatest`` would skip a NULL)."""
    lat, lon = _c(lat).cast("double"), _c(lon).cast("double")
    return lat.isNotNull() & ~F.isnan(lat) & lon.isNotNull() & ~F.isnan(lon) & _c(zoom).isNotNull()


def _mercator_row(lat, n) -> Column:
    r = F.radians(lat)
    arg = F.tan(r) + F.lit(1.0) / F.cos(r)
    return ((F.lit(1.0) - F.ln(arg) / F.pi()) / 2.0 * n).try_cast("long")


def tile_bounds(lat, lon, zoom) -> Column:
    """``struct(lon_min, lat_min, lon_max, lat_max)`` of the tile at the
    coordinates, by the inverse Mercator projection.  Unlike F1 the latitude is
    not clamped (as in the preview).  A missing coordinate or zoom gives NULL."""
    n = _tile_count(zoom)
    x = _clamp_index(_tile_x(lon, n), n).cast("double")
    y = _clamp_index(F.coalesce(_mercator_row(_c(lat).cast("double"), n), (n - 1).cast("long")), n).cast("double")

    def lat_of(row: Column) -> Column:
        return F.degrees(F.atan(F.sinh(F.pi() * (F.lit(1.0) - 2.0 * row / n))))

    bounds = F.struct(
        (x / n * 360.0 - 180.0).alias("lon_min"),
        lat_of(y + 1.0).alias("lat_min"),
        ((x + 1.0) / n * 360.0 - 180.0).alias("lon_max"),
        lat_of(y).alias("lat_max"),
    )
    return F.when(_placed(lat, lon, zoom), bounds)


def bounds_center(bounds) -> Column:
    """``struct(lat, lon)`` centre of a bounds struct."""
    b = _c(bounds)
    return F.struct(
        ((b["lat_min"] + b["lat_max"]) / 2.0).alias("lat"),
        ((b["lon_min"] + b["lon_max"]) / 2.0).alias("lon"),
    )


def bounds_ring(bounds) -> Column:
    """closed ring of five ``[lon, lat]`` points, counter-clockwise from the
    south-west corner."""
    b = _c(bounds)
    sw = F.array(b["lon_min"], b["lat_min"])
    se = F.array(b["lon_max"], b["lat_min"])
    ne = F.array(b["lon_max"], b["lat_max"])
    nw = F.array(b["lon_min"], b["lat_max"])
    return F.array(sw, se, ne, nw, sw)


def signed_degrees(magnitude, direction) -> Column:
    """hemisphere letter + magnitude -> signed degrees (N/E positive)."""
    d = F.upper(_c(direction))
    return F.when(d.isin("N", "E"), _c(magnitude)).otherwise(-_c(magnitude))


def zoom_label(zoom) -> Column:
    """zoom caption; empty text outside 1-20."""
    z = _c(zoom)
    expr = None
    for lo, hi, text in ZOOM_LABELS:
        cond = z.between(lo, hi)
        expr = F.when(cond, F.lit(text)) if expr is None else expr.when(cond, F.lit(text))
    return expr.otherwise(F.lit(""))


def preview_zoom(zoom) -> Column:
    """F8: map zoom for the preview, two levels out, never below 0."""
    return F.greatest(F.lit(0), _c(zoom) - 2)


def tile_file_name(tile) -> Column:
    """``esri_{z}_{x}_{y}.png`` of a tile struct."""
    t = _c(tile)
    return F.when(t.isNotNull(), F.format_string(TILE_FILE_FORMAT, t["z"], t["x"], t["y"]))


def tile_url(tile) -> Column:
    """tile service URL of a tile struct -- note the z/y/x order."""
    t = _c(tile)
    return F.when(t.isNotNull(), F.format_string(TILE_URL_FORMAT, t["z"], t["y"], t["x"]))


def tile_from_path(path) -> Column:
    """tile struct parsed back from a file name or path (NULL fields when
    the name does not match)."""
    p = _c(path)

    def part(i: int) -> Column:
        s = F.regexp_extract(p, TILE_FILE_PATTERN, i)
        return F.when(s != "", s.try_cast("int"))

    return F.struct(part(1).alias("z"), part(2).alias("x"), part(3).alias("y"))
