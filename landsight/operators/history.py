"""Risk-log reporting.

The log is append-only and can be very large; every report here is either one
global aggregate (partial per task, one row to the driver) or a projection
plus a distributed sort -- no global window, no per-row driver loop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .cache import tiles_cached
from .ranking import Ranked

# Filter and sort choices of the History page.
FILTERS = ("All", "At Risk", "Safe")
SORTS = ("Newest first", "Oldest first")

DISPLAY_COLUMNS = ["Timestamp", "Latitude", "Longitude", "Zoom", "Risk", "Vision Model", "Text Model"]


def risk_kpis(log: DataFrame) -> DataFrame:
    """A9 + A10: one row -- total, at risk (``Y``), safe (everything else),
    risk rate in percent rounded half to even (0 for an empty log), and the
    record counts the ``At Risk`` and ``Safe`` filters would show."""
    d = F.col("danger")
    agg = log.agg(
        F.count(F.lit(1)).alias("total_analyses"),
        F.count_if(F.coalesce(d == "Y", F.lit(False))).alias("at_risk"),
        F.count_if(F.coalesce(d == "N", F.lit(False))).alias("showing_safe"),
    )
    rate = F.coalesce(
        F.bround(F.try_divide(F.col("at_risk"), F.col("total_analyses")) * 100.0, 0), F.lit(0.0)
    ).cast("long")
    return agg.select(
        "total_analyses",
        "at_risk",
        (F.col("total_analyses") - F.col("at_risk")).alias("safe"),
        rate.alias("risk_rate_pct"),
        F.col("at_risk").alias("showing_at_risk"),
        "showing_safe",
    )


def filter_risk(log: DataFrame, choice: str = "All") -> DataFrame:
    """``All``; ``At Risk`` keeps ``danger = 'Y'``; ``Safe`` keeps
    ``danger = 'N'`` (other values, including NULL, drop out of both)."""
    if choice not in FILTERS:
        raise ValueError(f"filter must be one of {FILTERS}")
    if choice == "At Risk":
        return log.where(F.col("danger") == "Y")
    if choice == "Safe":
        return log.where(F.col("danger") == "N")
    return log


# Tie-break of the log sort when there is no id column: the location.
LOCATION_TIE = ("latitude", "longitude", "zoom")


def sort_log(log: DataFrame, choice: str = "Newest first", tie_col: str = "id") -> DataFrame:
    """O2: by timestamp, newest or oldest first, missing timestamps last; ties
    by ``tie_col`` -- or, when the log has no such column, by location -- so
    the order is stable.  A distributed range sort: every row of one workflow
    batch carries the same timestamp, and the tie-break keeps such a batch
    spread over many range partitions instead of one."""
    return log.orderBy(*sort_keys(log, choice, tie_col))


def sort_keys(log: DataFrame, choice: str = "Newest first", tie_col: str = "id") -> list:
    """The sort expressions of ``sort_log``."""
    if choice not in SORTS:
        raise ValueError(f"sort must be one of {SORTS}")
    ts = F.col("timestamp")
    first = ts.desc_nulls_last() if choice == "Newest first" else ts.asc_nulls_last()
    ties = [tie_col] if tie_col in log.columns else [c for c in LOCATION_TIE if c in log.columns]
    return [first, *[F.col(c).asc() for c in ties]]


def ranked_log(log: DataFrame, choice: str = "Newest first", tie_col: str = "id") -> Ranked:
    """O2 with places: the log stored in the page's order, for the place of each
    record and for pages of it."""
    return Ranked(log, sort_keys(log, choice, tie_col))


def history_table(log: DataFrame, choice: str = "All", order: str = "Newest first") -> DataFrame:
    """The History table -- seven renamed display columns."""
    rows = sort_log(filter_risk(log, choice), order)
    return rows.select(
        X.timestamp_text("timestamp").alias("Timestamp"),
        X.coordinate_label("latitude", "lat").alias("Latitude"),
        X.coordinate_label("longitude", "lon").alias("Longitude"),
        F.col("zoom").alias("Zoom"),
        X.risk_label("danger").alias("Risk"),
        F.col("image_model").alias("Vision Model"),
        F.col("text_model").alias("Text Model"),
    )


def risk_points(log: DataFrame, choice: str = "All") -> DataFrame:
    """The map feed -- lat, lon, danger and an RGBA colour per record."""
    return filter_risk(log, choice).select(
        F.col("latitude").alias("lat"),
        F.col("longitude").alias("lon"),
        "danger",
        X.risk_color("danger").alias("color"),
    )


def detail_records(
    log: DataFrame,
    tile_inventory: DataFrame,
    choice: str = "All",
    order: str = "Newest first",
) -> DataFrame:
    """D3: one detail record per log row -- headline, tile file, whether that
    tile is cached (J3, a left join against the distinct inventory names),
    justification, models and description.  One join, no per-row loop."""
    out = tiles_cached(filter_risk(log, choice), tile_inventory).select(
        *[c for c in ["id"] if c in log.columns],
        X.record_headline("danger", "timestamp", "latitude", "longitude", "zoom").alias("headline"),
        X.is_at_risk("danger").alias("at_risk"),
        "tile_file",
        "tile_cached",
        F.col("text_description").alias("justification"),
        "image_model",
        "text_model",
        "image_description",
        "timestamp",
    )
    return sort_log(out, order)
