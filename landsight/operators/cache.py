"""Result-cache lookup and tile work lists (J2, J3, O5, S9 plan).

Keys are exact ``(latitude, longitude, zoom)`` triples.  Both the log and the
request stream can hold a hot key (one location asked for again and again),
so the log is reduced to its first entry per key with a partial + final
aggregation (``min`` of a struct: one row per key per task crosses the
shuffle), and requests are reduced to distinct keys before any join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tiles import tile_file_name, tile_url, tile_xyz

KEY = ["latitude", "longitude", "zoom"]


def first_per_key(
    log: DataFrame,
    payload: Sequence[str] = ("image_description", "danger", "text_description"),
    key: Sequence[str] = KEY,
    order_col: str = "timestamp",
    tie_col: str = "id",
) -> DataFrame:
    """The first stored entry per key -- earliest ``order_col`` (missing
    last), ties by ``tie_col`` -- as ``key + payload`` columns."""
    key = list(key)
    sort_fields = [
        F.col(order_col).isNull().alias("__late"),
        F.col(order_col).alias("__ts"),
    ] + ([F.col(tie_col).alias("__tie")] if tie_col in log.columns else [])
    rec = F.struct(*sort_fields, *[F.col(c) for c in payload])
    first = log.groupBy(*key).agg(F.min(rec).alias("__first"))
    return first.select(*key, *[F.col("__first")[c].alias(c) for c in payload])


def first_for_keys(
    log: DataFrame,
    wanted: DataFrame,
    payload: Sequence[str] = ("image_description", "danger", "text_description"),
    key: Sequence[str] = KEY,
) -> DataFrame:
    """O5 restricted to the keys of ``wanted`` (distinct keys).

    The log is aggregated first (a hot key becomes one row per task) and only
    then semi-joined, so no join sees a hot key's raw rows: a shuffled semi join
    followed by the aggregate would keep such a key in one task, since AQE does
    not split a partition that the next operator needs whole."""
    key = list(key)
    return first_per_key(log, payload, key).join(wanted, key, "left_semi")


def lookup_requests(
    requests: DataFrame,
    log: DataFrame,
    payload: Sequence[str] = ("image_description", "danger", "text_description"),
    key: Sequence[str] = KEY,
) -> DataFrame:
    """Every request with ``hit`` and the first stored entry's payload (NULL
    on a miss).

    Plan: the first entry of each requested key (``first_for_keys``), joined
    back to the requests -- one row per key on that side, and AQE splits a hot
    request key on the preserved requests side."""
    key = list(key)
    wanted = requests.select(*key).distinct()
    first = first_for_keys(log, wanted, payload, key).withColumn("hit", F.lit(True))
    out = requests.join(first, key, "left")
    return out.withColumn("hit", F.coalesce(F.col("hit"), F.lit(False)))


def split_requests(requests: DataFrame, log: DataFrame, key: Sequence[str] = KEY):
    """J2 as two frames: (hits with cached payload, misses)."""
    looked = lookup_requests(requests, log, key=key)
    hits = looked.where(F.col("hit")).drop("hit")
    misses = requests.join(log.select(*key).distinct(), list(key), "left_anti")
    return hits, misses


def tile_keys(df: DataFrame, lat: str = "latitude", lon: str = "longitude", zoom: str = "zoom") -> DataFrame:
    """Distinct tiles (``z, x, y``) with file name and URL for a coordinate table."""
    t = df.select(tile_xyz(lat, lon, zoom).alias("t")).distinct()
    return t.select(
        "t.z", "t.x", "t.y",
        tile_file_name(F.col("t")).alias("file_name"),
        tile_url(F.col("t")).alias("url"),
    )


def tile_work_list(coords: DataFrame, inventory: DataFrame) -> DataFrame:
    """Tiles the coordinates need that are not in ``inventory`` (a frame
    with ``file_name``) -- the fetch work list."""
    need = tile_keys(coords)
    have = inventory.select("file_name").distinct()
    return need.join(have, "file_name", "left_anti")


def tiles_cached(coords: DataFrame, inventory: DataFrame) -> DataFrame:
    """The coordinate table with ``tile_file`` and a ``tile_cached`` flag."""
    rows = coords.withColumn("tile_file", tile_file_name(tile_xyz("latitude", "longitude", "zoom")))
    have = inventory.select(F.col("file_name").alias("tile_file")).distinct().withColumn("tile_cached", F.lit(True))
    return rows.join(have, "tile_file", "left").withColumn(
        "tile_cached", F.coalesce(F.col("tile_cached"), F.lit(False))
    )
