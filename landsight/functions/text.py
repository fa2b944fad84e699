"""Display text as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Risk flag, labels, icons and point colours (RGBA).
RISK_FLAG = "Y"
AT_RISK_LABEL = "🚨 At Risk"
SAFE_LABEL = "✅ Safe"
AT_RISK_ICON = "🚨"
SAFE_ICON = "✅"
AT_RISK_COLOR = [220, 38, 38, 200]
SAFE_COLOR = [22, 163, 74, 200]

# Timestamp display pattern and the prompt joint.
TIMESTAMP_PATTERN = "yyyy-MM-dd HH:mm 'UTC'"
DESCRIPTION_JOINT = "\n\nImage description:\n"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def coordinate_label(value, axis: str, decimals: int = 4) -> Column:
    """``N 38.6799°`` -- hemisphere letter (>= 0 is N or E), the magnitude
    with ``decimals`` places (round half even, like Python's format), and ``°``.
    ``axis`` is ``"lat"`` or ``"lon"``."""
    v = _c(value)
    pos, neg = ("N", "S") if axis == "lat" else ("E", "W")
    letter = F.when(v >= 0, F.lit(pos)).otherwise(F.lit(neg))
    return F.concat(letter, F.lit(" "), F.format_number(F.abs(v), decimals), F.lit("°"))


def number_text(value, decimals: int = 2) -> Column:
    """``1,234.56`` -- thousands separators, fixed decimals, ties
    to even on the exact binary value (as Python's format).  Infinities and
    NaN print as Python prints them (``inf``, ``-inf``, ``nan``), not ``∞``."""
    v = _c(value).cast("double")
    return (
        F.when(F.isnan(v), F.lit("nan"))
        .when(v == F.lit(float("inf")), F.lit("inf"))
        .when(v == F.lit(float("-inf")), F.lit("-inf"))
        .otherwise(F.format_number(v, decimals))
    )


def count_text(value) -> Column:
    """``{:,}`` of a count: ``1,234``."""
    return F.format_number(_c(value).cast("long"), 0)


def timestamp_text(ts) -> Column:
    """``2024-01-01 10:11 UTC``, whatever the session's time zone."""
    return F.date_format(utc_time(ts), TIMESTAMP_PATTERN)


def utc_time(ts) -> Column:
    """The instant's clock time in UTC."""
    return F.to_utc_timestamp(_c(ts).cast("timestamp"), F.current_timezone())


def is_at_risk(danger) -> Column:
    """The History page's test: only ``Y`` is at risk (NULL is not)."""
    return F.coalesce(_c(danger) == F.lit(RISK_FLAG), F.lit(False))


def risk_label(danger) -> Column:
    """``🚨 At Risk`` for ``Y``, else ``✅ Safe``."""
    return F.when(is_at_risk(danger), F.lit(AT_RISK_LABEL)).otherwise(F.lit(SAFE_LABEL))


def risk_icon(danger) -> Column:
    return F.when(is_at_risk(danger), F.lit(AT_RISK_ICON)).otherwise(F.lit(SAFE_ICON))


def risk_color(danger) -> Column:
    """F16: RGBA point colour, red for ``Y`` and green otherwise."""
    red = F.array(*[F.lit(v) for v in AT_RISK_COLOR])
    green = F.array(*[F.lit(v) for v in SAFE_COLOR])
    return F.when(is_at_risk(danger), red).otherwise(green)


def record_headline(danger, ts, lat, lon, zoom) -> Column:
    """``{icon} {ts}  ·  {lat}, {lon}  ·  Zoom {zoom}`` (two spaces around
    each middle dot)."""
    return F.concat(
        risk_icon(danger), F.lit(" "), timestamp_text(ts),
        F.lit("  ·  "), coordinate_label(lat, "lat"), F.lit(", "), coordinate_label(lon, "lon"),
        F.lit("  ·  Zoom "), _c(zoom).cast("int").cast("string"),
    )


def assessment_prompt(prompt, description) -> Column:
    """the text model's input -- prompt, a joint line, the description."""
    p = F.lit(prompt) if isinstance(prompt, str) else prompt
    return F.concat(p, F.lit(DESCRIPTION_JOINT), _c(description))
