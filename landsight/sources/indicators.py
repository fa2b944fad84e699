"""Indicator sources: CSV scan (S4), the long table (U3), and metric/country
column choice (P10, P11).

Canonical long table ``indicator``::

    dataset string, metric string, entity string, code string,
    year_number double, year int, value double

``code`` is stripped but not filtered (the merge filters it); ``year_number`` is
the coerced ``Year``; ``year`` is set only when that number is integral;
``value`` is the coerced metric.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.clean import clean_code, integral_year, to_number
from .csv_records import read_text_columns

# Candidate country columns, in order of preference.
COUNTRY_COLUMN_CANDIDATES = ["ADMIN", "Name", "NAME", "Entity", "Country", "ISO_A3"]

# Text tokens pandas' CSV reader turns into missing values.
CSV_NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]


def to_long(
    raw: DataFrame,
    metric: str,
    dataset_col: str = "dataset",
    entity_col: str = "Entity",
    code_col: str = "Code",
    year_col: str = "Year",
    metric_name_col: str | None = None,
) -> DataFrame:
    """Raw all-text indicator rows -> the canonical long table.

    ``metric`` is the column holding the metric values; its name becomes the
    ``metric`` value unless ``metric_name_col`` names a column carrying it.
    Without a ``Year`` column every row has no year (no years are available);
    without a ``Code`` column the merge's guard message is raised.
    """
    from ..operators.merge import MISSING_CODE_MESSAGE

    if code_col not in raw.columns:
        raise ValueError(MISSING_CODE_MESSAGE)
    year_text = F.col(year_col) if year_col in raw.columns else F.lit(None).cast("string")
    year_number = to_number(year_text)
    metric_name = F.col(metric_name_col) if metric_name_col else F.lit(metric)
    return raw.select(
        F.col(dataset_col).cast("string").alias("dataset"),
        metric_name.alias("metric"),
        F.col(entity_col).cast("string").alias("entity"),
        clean_code(F.col(code_col)).alias("code"),
        year_number.alias("year_number"),
        integral_year(year_number).alias("year"),
        to_number(F.col(metric)).alias("value"),
    )


def null_na_tokens(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Treat pandas' default missing-value tokens as NULL in text columns."""
    return df.select(
        *[
            F.when(F.col(c).isin(CSV_NA_TOKENS), F.lit(None).cast("string")).otherwise(F.col(c)).alias(c)
            if c in columns
            else F.col(c)
            for c in df.columns
        ]
    )


def csv_header(spark: SparkSession, path: str) -> list[str]:
    """Column names from the header line of one CSV file (reads one line)."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path).columns


def _dataset_of(uri: str) -> str:
    """The dataset a file belongs to: its ``dataset=...`` folder, else its name
    without ``.csv``."""
    return _dataset_of_path(unquote(uri))


def _dataset_of_path(path: str) -> str:
    folder = re.search(r"(?:^|/)dataset=([^/]*)/", path)
    return folder[1] if folder else re.sub(r"\.csv$", "", path.rsplit("/", 1)[-1])


def csv_layouts(spark: SparkSession, paths: Sequence[str]) -> dict[tuple[str, ...], list[str]]:
    """Files by header.  Datasets are few; the header is read from the first
    file of each -- one line, at any file size and count -- and Spark checks
    the others against it as it reads them."""
    by_dataset: dict[str, list[str]] = {}
    for uri in sorted(spark.read.text(list(paths)).inputFiles()):
        by_dataset.setdefault(_dataset_of(uri), []).append(unquote(uri))
    layouts: dict[tuple[str, ...], list[str]] = {}
    for files in by_dataset.values():
        header = next((h for h in (csv_header(spark, f) for f in files) if h), None)
        if header:
            layouts.setdefault(tuple(header), []).extend(files)
    return layouts


def read_indicator_csvs(spark: SparkSession, paths: Sequence[str], metric: str | None = None) -> DataFrame:
    """S4 + U3: every indicator CSV -> one long table, one scan per header layout.

    Each layout is read with an explicit all-text schema (never inferred), and
    a large file is split over many tasks, also where quoted fields hold line
    ends.  The dataset id comes from the file's path.  The metric column is the last
    numeric-looking column other than ``Year`` (P10), decided per dataset by
    one aggregate job per layout; ``metric`` names it instead, and a name that
    a layout lacks is an error.  A dataset without any numeric column keeps its
    rows, with neither metric nor value.
    """
    parts = []
    for header, files in csv_layouts(spark, paths).items():
        cols = list(header)
        if metric is not None and metric not in cols:
            raise ValueError(f"no column {metric!r} in {files[0]}")
        # read by dataset, so that no row's path is taken apart
        by_dataset: dict[str, list[str]] = {}
        for f in files:
            by_dataset.setdefault(_dataset_of_path(f), []).append(f)
        read = [read_text_columns(spark, fs, cols).drop("__file").withColumn("__dataset", F.lit(d)) for d, fs in by_dataset.items()]
        raw = null_na_tokens(reduce(DataFrame.unionByName, read), cols)
        if metric is not None:
            parts.append(to_long(raw, metric, dataset_col="__dataset"))
            continue
        # datasets that share a layout but not the metric are told apart
        chosen = choose_metric_columns(raw, cols, "__dataset")
        for name in sorted(set(chosen.values()), key=str):
            mine = raw.where(F.col("__dataset").isin([d for d, m in chosen.items() if m == name]))
            if name is None:
                mine = mine.withColumn("__none", F.lit(None).cast("string"))
                parts.append(to_long(mine, "__none", dataset_col="__dataset", metric_name_col="__none"))
            else:
                parts.append(to_long(mine, name, dataset_col="__dataset"))
    if not parts:
        return spark.createDataFrame([], LONG_SCHEMA).select("dataset", *LONG_SCHEMA.fieldNames()[:-1])
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# The texts pandas' CSV reader takes as booleans.
TRUTH_TEXTS = ["True", "False", "TRUE", "FALSE", "true", "false"]


def numeric_columns(raw: DataFrame, cols: Sequence[str], by: str) -> dict[str, list[str]]:
    """Per dataset, the columns that pandas would make numeric: every value a
    number (missing ones allowed), or every value a boolean and none missing.
    One aggregate job for all columns and datasets of a layout."""
    names = [f"c{i}" for i in range(len(cols))]
    long = raw.select(F.col(by), *[F.col(f"`{c}`").alias(n) for c, n in zip(cols, names)]).unpivot([by], names, "column", "v")
    v = F.col("v")
    number = to_number(v).isNotNull() | F.lower(v).isin("nan", "inf", "-inf", "+inf")
    kind = F.when(v.isNull(), "missing").when(v.isin(TRUTH_TEXTS), "truth").when(number, "number").otherwise("text")
    found: dict[str, dict[str, set]] = {}
    # a few rows for each dataset and column
    for row in long.select(by, "column", kind.alias("kind")).distinct().collect():
        found.setdefault(row[by], {}).setdefault(row["column"], set()).add(row["kind"])
    return {
        dataset: [c for c, n in zip(cols, names) if "text" not in kinds[n] and ("truth" not in kinds[n] or kinds[n] == {"truth"})]
        for dataset, kinds in found.items()
    }


def choose_metric_columns(raw: DataFrame, cols: Sequence[str], by: str) -> dict[str, str | None]:
    """P10 per dataset: the last numeric column other than ``Year``, else the
    first numeric column, else None."""
    chosen = {}
    for dataset, numeric in numeric_columns(raw, cols, by).items():
        others = [c for c in numeric if c != "Year"]
        chosen[dataset] = others[-1] if others else next(iter(numeric), None)
    return chosen


def country_column(columns: Sequence[str]) -> str:
    """The preferred candidate among the columns, else the first column."""
    present = set(columns).intersection(COUNTRY_COLUMN_CANDIDATES)
    return min(present, key=COUNTRY_COLUMN_CANDIDATES.index) if present else columns[0]


def metric_profile(raw: DataFrame) -> DataFrame:
    """P10 as a table: per raw column, the non-NULL count and how many values
    parse as numbers (one aggregation over the unpivoted text)."""
    cols = raw.columns
    long = raw.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot(
        [], cols, "column_name", "v"
    )
    return long.groupBy("column_name").agg(
        F.count("v").alias("non_null"),
        F.count(to_number(F.col("v"))).alias("numeric"),
    )


def write_indicator_table(indicator: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Ingest: store the long table as Parquet partitioned by dataset and year.

    Built once (e.g. after ``read_indicator_csvs``), it is what every dashboard
    plan should read: work on a dataset or its latest year prunes to its folders, the typed columns
    take pushed-down filters, and no plan re-parses the raw text.  With
    ``spark.sql.sources.partitionOverwriteMode=dynamic``, ``mode="overwrite"``
    replaces only the datasets and years present in ``indicator``."""
    # rebalance by dataset: AQE splits a large dataset over several writers and
    # lets small ones share one, so file sizes follow the data, not the tasks
    indicator.hint("rebalance", "dataset", "year").write.mode(mode).partitionBy("dataset", "year").parquet(path)


LONG_SCHEMA = T.StructType(
    [
        T.StructField("metric", T.StringType()),
        T.StructField("entity", T.StringType()),
        T.StructField("code", T.StringType()),
        T.StructField("year_number", T.DoubleType()),
        T.StructField("year", T.IntegerType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("dataset", T.StringType()),
    ]
)


def read_indicator_table(spark: SparkSession, path: str) -> DataFrame:
    """The stored long table (fixed schema; dataset and year are partition columns)."""
    df = spark.read.schema(LONG_SCHEMA).parquet(path)
    return df.select("dataset", "metric", "entity", "code", "year_number", "year", "value")
