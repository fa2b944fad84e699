"""Insight operators.

Input is the *matched* part of the boundary merge (indicator rows with a
boundary country); unmatched boundary rows carry no value and drop out of
every insight, as in the per-selection computation.  Everything is keyed by
``by`` (default dataset and metric), so all datasets are computed at once.

Scale: per-country means are one partial + final hash aggregation; year
choices and availability flags are per-dataset aggregates (a few rows) joined
back by broadcast; top/bottom-k ranks run over the per-country series, which
holds at most one row per country and group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import number_text
from .broadcast import DEFAULT_MAX_BROADCAST_ROWS, maybe_broadcast
from .merge import clean_indicator_codes
from .stats import country_means
from .years import last_two_years

DEFAULT_BY = ("dataset", "metric")


def matched_rows(
    boundary: DataFrame,
    indicator: DataFrame,
    code_col: str = "code",
    max_broadcast_rows: int = DEFAULT_MAX_BROADCAST_ROWS,
) -> DataFrame:
    """Indicator rows joined to their boundary (the matched side of J1);
    the boundary is broadcast after a size check, the indicator is not shuffled."""
    ind = clean_indicator_codes(indicator, code_col)
    b = maybe_broadcast(boundary, max_broadcast_rows)
    return ind.join(b, ind[code_col] == b["ISO_A3"], "inner")


def year_pivot(
    rows: DataFrame, country_col: str = "ADMIN", by: Sequence[str] = DEFAULT_BY
) -> DataFrame:
    """Per country, the mean value in the previous and in the last of the
    two latest years (``prev_mean``, ``last_mean``; NULL when absent)."""
    by = list(by)
    years = last_two_years(rows, by)
    r = rows.join(years, by, "inner").where(
        F.col("year_number").isin(F.col("prev_year"), F.col("last_year"))
        & F.col(country_col).isNotNull()
        & F.col("value").isNotNull()
    )
    yn = F.col("year_number")
    return r.groupBy(*by, country_col, "prev_year", "last_year").agg(
        F.avg(F.when(yn == F.col("prev_year"), F.col("value"))).alias("prev_mean"),
        F.avg(F.when(yn == F.col("last_year"), F.col("value"))).alias("last_mean"),
        F.count(F.when(yn == F.col("prev_year"), F.col("value"))).alias("prev_n"),
        F.count(F.when(yn == F.col("last_year"), F.col("value"))).alias("last_n"),
    )


def change_label(metric, prev_year, last_year):
    """``Annual Change in {metric} ({prev} → {last})``."""
    return F.format_string(
        "Annual Change in %s (%d → %d)", metric, prev_year.cast("long"), last_year.cast("long")
    )


def yoy_change(
    rows: DataFrame, country_col: str = "ADMIN", by: Sequence[str] = DEFAULT_BY
) -> DataFrame:
    """Last-year mean minus previous-year mean per country, for countries
    present in both years; with the insight label."""
    by = list(by)
    piv = year_pivot(rows, country_col, by)
    out = piv.where(F.col("prev_mean").isNotNull() & F.col("last_mean").isNotNull())
    metric = F.col("metric") if "metric" in by else F.lit("value")
    return out.select(
        *by,
        country_col,
        (F.col("last_mean") - F.col("prev_mean")).alias("value"),
        change_label(metric, F.col("prev_year"), F.col("last_year")).alias("label"),
        "prev_mean", "last_mean", "prev_n", "last_n",
    )


def insight_series(
    rows: DataFrame, country_col: str = "ADMIN", by: Sequence[str] = DEFAULT_BY
) -> DataFrame:
    """Per group, the year-on-year change when it is available and
    non-empty, else the per-country mean with the metric name as label."""
    by = list(by)
    change = yoy_change(rows, country_col, by)
    have_change = change.select(*by).distinct()
    means = country_means(rows, by, country_col).join(have_change, by, "left_anti")
    metric = F.col("metric") if "metric" in by else F.lit("value")
    means = means.select(
        *by, country_col, F.col("mean_value").alias("value"), metric.alias("label"), "n_values"
    )
    return change.unionByName(means, allowMissingColumns=True)


def top_bottom(
    series: DataFrame,
    by: Sequence[str],
    country_col: str = "ADMIN",
    value_col: str = "value",
    k: int = 5,
) -> DataFrame:
    """The ``k`` largest and ``k`` smallest values per group.

    Ties keep the alphabetically first countries (the series index is sorted by
    country).  ``side`` is ``top`` or ``bottom``; ``rank`` 1 is the most extreme;
    a row on both sides (a small group) appears once per side.  Every row of the
    series is taken once for each side and ranked there: one ``row_number() <= k``
    window, which Spark runs as a per-task group limit before the shuffle, so no
    group -- however large -- is gathered in one task.  The series has one
    reader, so what it is derived from is scanned once.
    """
    by = list(by)
    v, top = F.col(value_col), F.col("__side") == "top"
    s = series.where(v.isNotNull()).withColumn("__side", F.explode(F.array(F.lit("top"), F.lit("bottom"))))
    # one of the two values is NULL in all rows of a side
    order = [F.when(top, v).desc(), F.when(~top, v).asc(), F.col(country_col).asc()]
    w = Window.partitionBy(*by, "__side").orderBy(*order)
    ranked = s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select(*series.columns, F.col("__side").alias("side"), "rank")


def bar_labels(ranked: DataFrame, value_col: str = "value") -> DataFrame:
    """the text printed next to each top/bottom bar -- one decimal with
    thousands separators."""
    return ranked.withColumn("bar_label", number_text(value_col, 1))


def preview_rows(
    rows: DataFrame,
    by: Sequence[str],
    country_col: str = "ADMIN",
    value_col: str = "value",
    n: int = 20,
) -> DataFrame:
    """The first ``n`` non-missing (country, value) rows per group,
    in country then value order (deterministic ``head(n)``)."""
    by = list(by)
    s = rows.where(F.col(country_col).isNotNull() & F.col(value_col).isNotNull())
    w = Window.partitionBy(*by).orderBy(F.col(country_col).asc(), F.col(value_col).asc())
    return (
        s.select(*by, country_col, value_col)
        .withColumn("row", F.row_number().over(w))
        .where(F.col("row") <= n)
    )
