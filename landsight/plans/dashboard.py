"""The dashboard for every dataset at once.

``Dashboard`` holds the two inputs -- the long indicator table and the
boundaries -- and builds lazy plans; nothing runs until a result is written
or collected.  The per-selection forms of the page (one dataset, one year)
are filters on these all-at-once results.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import insights as N
from ..operators import merge as M
from ..operators import stats as S
from ..operators import years as Y
from ..sources.indicators import country_column, read_indicator_csvs


@dataclass
class Dashboard:
    indicator: DataFrame
    boundary: DataFrame

    def __post_init__(self):
        # The boundary column that names countries
        name = country_column(self.boundary.columns)
        if "ADMIN" not in self.boundary.columns:
            named = F.col(name).alias("ADMIN")
            self.boundary = self.boundary.select("*", named) if name == "ISO_A3" else self.boundary.withColumnRenamed(name, "ADMIN")

    @classmethod
    def from_files(cls, spark: SparkSession, csv_paths, boundary: DataFrame) -> "Dashboard":
        return cls(read_indicator_csvs(spark, csv_paths), boundary)

    def datasets(self) -> DataFrame:
        return self.indicator.select("dataset").distinct()

    def available_years(self) -> DataFrame:
        """A2: years with data per dataset, newest first (``year_rank`` 1)."""
        return Y.available_years(self.indicator)

    def latest_merged(self) -> DataFrame:
        """Every dataset at its latest year, merged with the boundaries.  A
        dataset without any year is an error."""
        lacking = self.datasets().join(Y.latest_year(self.indicator), "dataset", "left_anti").limit(1).collect()
        if lacking:
            raise ValueError(f"{Y.NO_YEARS_MESSAGE} ({lacking[0]['dataset']})")
        return M.merge_boundaries(
            self.boundary, Y.latest_rows(self.indicator), code_col="code", group_cols=["dataset"]
        )

    def selection_merged(self, dataset: str, year: int | None) -> DataFrame:
        """P7 + J1: one dataset at one year (the page's map frame)."""
        rows = Y.filter_year(self.indicator.where(F.col("dataset") == dataset), year)
        return M.merge_boundaries(self.boundary, rows, code_col="code")

    def kpis(self) -> DataFrame:
        """KPI row for every dataset and available year; a dataset without a
        year has one row over all its rows."""
        return S.merged_kpis(self.boundary, Y.selection_rows(self.indicator), Y.selections(self.indicator))

    def default_selection(self) -> DataFrame:
        """P7 + J1: every dataset at its newest available year (all rows of a
        dataset without one), merged with the boundaries."""
        newest = Y.selections(self.indicator).groupBy("dataset").agg(F.max("year").alias("__newest"))
        rows = Y.selection_rows(self.indicator).join(newest, "dataset")
        rows = rows.where(F.col("year").eqNullSafe(F.col("__newest"))).drop("__newest")
        return M.merge_boundaries(
            self.boundary, rows, code_col="code", group_cols=["dataset"], groups=self.datasets()
        )

    def profile(self) -> DataFrame:
        """The profile of every dataset's default selection -- also of
        datasets without a metric, whose value column is empty."""
        merged = self.default_selection()
        numeric = ["year_number", "value"]
        text = [c for c in merged.columns if c not in (*numeric, "dataset", "metric", "year") and merged.schema[c].dataType == T.StringType()]
        return S.profile(merged, ["dataset"], text_cols=text, numeric_cols=numeric)

    def preview(self, k: int = 20) -> DataFrame:
        """I4: first ``k`` (country, value) rows per dataset and selection."""
        return N.preview_rows(N.matched_rows(self.boundary, Y.selection_rows(self.indicator)), ["dataset", "year"], n=k)

    def kpi_text(self) -> DataFrame:
        """the KPI row as display text."""
        return S.kpi_text(self.kpis())

    def choropleth(self) -> DataFrame:
        """Map feed of every dataset at its latest year."""
        return S.choropleth_scale(self.latest_merged(), ["dataset"])

    def matched(self) -> DataFrame:
        return N.matched_rows(self.boundary, self.indicator)

    def insights(self) -> DataFrame:
        """Insight series per dataset (change or mean)."""
        return N.insight_series(self.matched())

    def top_bottom(self, k: int = 5) -> DataFrame:
        """Top and bottom ``k`` of each dataset's insight series."""
        return N.top_bottom(self.insights(), ["dataset", "metric", "label"], k=k)

    def year_top_bottom(self, k: int = 5) -> DataFrame:
        """I3 page form: top and bottom ``k`` country means per dataset and year."""
        rows = N.matched_rows(self.boundary, Y.selection_rows(self.indicator))
        means = S.country_means(rows, ["dataset", "year"])
        return N.bar_labels(N.top_bottom(means, ["dataset", "year"], value_col="mean_value", k=k), "mean_value")
