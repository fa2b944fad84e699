"""The History report over a stored analysis log.

``History`` reads the log and the tile inventory lazily; each method returns a
DataFrame plan.  The KPI row is one global aggregate (partial per task); the
tables are projections with a distributed sort; the detail records join the
tile inventory once instead of testing files row by row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..operators import history as H
from ..sources.log import read_log
from ..sources.tiles import read_tile_inventory


@dataclass
class History:
    log: DataFrame
    tile_inventory: DataFrame

    @classmethod
    def from_paths(cls, spark: SparkSession, log_path: str, tile_folder: str) -> "History":
        return cls(read_log(spark, log_path), read_tile_inventory(spark, tile_folder))

    def kpis(self) -> DataFrame:
        """A9 + A10: total, at risk, safe, risk rate, filtered counts."""
        return H.risk_kpis(self.log)

    def table(self, choice: str = "All", order: str = "Newest first") -> DataFrame:
        """The display table for a filter and sort choice."""
        return H.history_table(self.log, choice, order)

    def points(self, choice: str = "All") -> DataFrame:
        """The map feed."""
        return H.risk_points(self.log, choice)

    def details(self, choice: str = "All", order: str = "Newest first") -> DataFrame:
        """D3: one detail record per analysis, with its tile and cache flag."""
        return H.detail_records(self.log, self.tile_inventory, choice, order)
