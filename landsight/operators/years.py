"""Year operators over the long indicator table.

All of them aggregate per dataset first (partial + final hash aggregation, so a
dataset holding most rows costs one pre-aggregated row per task), and join the
result -- bounded by the number of datasets times the number of years -- back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clean import truncated_year

NO_YEARS_MESSAGE = "No valid years found in the 'Year' column."


def latest_year(indicator: DataFrame, by: str = "dataset") -> DataFrame:
    """A1 per dataset: the largest coerced year over all rows, truncated to int.

    Datasets with no usable year are absent (the single form raises)."""
    return (
        indicator.where(F.col("year_number").isNotNull())
        .groupBy(by)
        .agg(truncated_year(F.max("year_number")).alias("latest_year"))
    )


def latest_year_single(df: DataFrame, year_number_col: str = "year_number") -> int:
    """A1 for one frame, as a driver-side int; ValueError when there is no year."""
    row = df.agg(F.max(year_number_col).alias("m")).first()
    if row is None or row["m"] is None:
        raise ValueError(NO_YEARS_MESSAGE)
    return int(row["m"])


def filter_latest(indicator: DataFrame, by: str = "dataset") -> DataFrame:
    """Only the rows of each dataset's latest year (coerced comparison)."""
    latest = latest_year(indicator, by)
    return indicator.join(
        latest,
        (indicator[by] == latest[by])
        & (indicator["year_number"] == latest["latest_year"].cast("double")),
        "left_semi",
    )


def latest_rows(indicator: DataFrame, by: str = "dataset") -> DataFrame:
    """P6 with the latest years looked up first: they reach the plan as literals
    (one pair per dataset of the catalogue), so a table stored by dataset and
    year is read in those folders only."""
    years = latest_year(indicator, by).collect()  # one row per dataset
    wanted = F.lit(False)
    for r in years:
        same = (F.col(by) == F.lit(r[by])) & (F.col("year") == F.lit(r["latest_year"]))
        wanted = wanted | (same & (F.col("year_number") == F.lit(float(r["latest_year"]))))
    return indicator.where(wanted)


def filter_year(indicator: DataFrame, year: int | None) -> DataFrame:
    """Rows whose coerced year equals ``year``; no-op when ``year`` is None."""
    if year is None:
        return indicator
    return indicator.where(F.col("year_number") == F.lit(float(year)))


def available_years(indicator: DataFrame, by: str = "dataset") -> DataFrame:
    """A2 + U1 + O3: distinct truncated years having a usable value, per dataset,
    with ``year_rank`` 1 for the newest (the default selection)."""
    years = (
        indicator.where(F.col("value").isNotNull() & F.col("year_number").isNotNull())
        .select(by, truncated_year(F.col("year_number")).alias("year"))
        .where(F.col("year").isNotNull())
        .distinct()
    )
    w = Window.partitionBy(by).orderBy(F.col("year").desc())
    return years.withColumn("year_rank", F.row_number().over(w))


def last_two_years(rows: DataFrame, by="dataset") -> DataFrame:
    """The two largest distinct coerced years per group (``prev_year``,
    ``last_year``); groups with fewer than two years are absent.  ``by`` is a
    column name or a list of them."""
    by = [by] if isinstance(by, str) else list(by)
    distinct_years = rows.where(F.col("year_number").isNotNull()).select(*by, "year_number").distinct()
    w = Window.partitionBy(*by).orderBy(F.col("year_number").desc())
    ranked = distinct_years.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= 2)
    return (
        ranked.groupBy(*by)
        .agg(
            F.max(F.when(F.col("__r") == 2, F.col("year_number"))).alias("prev_year"),
            F.max(F.when(F.col("__r") == 1, F.col("year_number"))).alias("last_year"),
        )
        .where(F.col("prev_year").isNotNull())
    )


def selections(indicator: DataFrame, by: str = "dataset") -> DataFrame:
    """Every selectable (dataset, year): the available years, and for a dataset
    without any a NULL year, which selects all its rows."""
    years = available_years(indicator, by).select(by, "year")
    none = indicator.select(by).distinct().join(years.select(by), by, "left_anti")
    return years.unionByName(none.withColumn("year", F.lit(None).cast("int")))


def selection_rows(indicator: DataFrame, by: str = "dataset") -> DataFrame:
    """The rows by the selection they belong to: ``year`` is NULL for all rows of
    a dataset without a usable year; other rows without a year are in none."""
    dated = available_years(indicator, by).select(by).distinct().withColumn("__dated", F.lit(True))
    rows = indicator.join(dated, by, "left")
    rows = rows.where(F.col("__dated").isNull() | F.col("year").isNotNull())
    return rows.withColumn("year", F.when(F.col("__dated"), F.col("year"))).select(*indicator.columns)
