"""Dashboard statistics.

Skew.  Indicator rows are reduced to one row per (group, code) by a partial +
final hash aggregation before anything is joined, so a country or dataset that
holds a third of all rows costs one pre-aggregated row per task.  Everything
after that point is small (groups x countries).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import count_text, number_text
from .merge import clean_indicator_codes
from .quantiles import exact_percentiles


def merged_kpis(
    boundary: DataFrame,
    indicator: DataFrame,
    groups: DataFrame,
    group_cols: Sequence[str] = ("dataset", "year"),
    code_col: str = "code",
) -> DataFrame:
    """D5 (A3-A5) for every group at once, without materialising the merge.

    For the merge of the boundaries with the indicator rows of one group:
    ``countries`` = all merged rows (matched or not), ``with_data`` = rows with a
    value, and ``mean_value`` / ``max_value`` / ``min_value`` over those values
    (NULL when ``with_data`` is 0).  ``groups`` lists the groups to report (for
    the dashboard: the available years of each dataset).

    The counts follow from per-(group, code) aggregates: a code present in a group
    with ``n`` rows, matching ``b`` boundary rows, turns ``b`` unmatched rows into
    ``b * n`` matched ones.
    """
    group_cols = list(group_cols)
    bcount = boundary.groupBy("ISO_A3").agg(F.count(F.lit(1)).alias("__b"))
    # all boundary rows, as an uncorrelated scalar subquery (no driver action)
    n_boundary = boundary.select(F.count(F.lit(1))).scalar()
    per_code = (
        clean_indicator_codes(indicator, code_col)
        .groupBy(*group_cols, code_col)
        .agg(
            F.count(F.lit(1)).alias("__n"),
            F.count("value").alias("__nv"),
            F.sum("value").alias("__s"),
            F.max("value").alias("__mx"),
            F.min("value").alias("__mn"),
        )
    )
    joined = per_code.join(bcount, per_code[code_col] == bcount["ISO_A3"], "inner")
    per_group = joined.groupBy(*group_cols).agg(
        F.sum(F.col("__b") * (F.col("__n") - 1)).alias("__extra"),
        F.sum(F.col("__b") * F.col("__nv")).alias("__nv"),
        F.sum(F.col("__b") * F.col("__s")).alias("__s"),
        F.max("__mx").alias("max_value"),
        F.min("__mn").alias("min_value"),
    )
    # a NULL group value (no year) is a group like any other
    named = per_group.withColumnsRenamed({c: f"__{c}" for c in group_cols})
    same = [groups[c].eqNullSafe(named[f"__{c}"]) for c in group_cols]
    out = groups.join(named, same, "left").drop(*[f"__{c}" for c in group_cols])
    with_data = F.coalesce(F.col("__nv"), F.lit(0)).cast("long")
    return out.select(
        *group_cols,
        (n_boundary + F.coalesce(F.col("__extra"), F.lit(0))).cast("long").alias("countries"),
        with_data.alias("with_data"),
        F.when(with_data > 0, F.col("__s") / with_data).alias("mean_value"),
        "max_value",
        "min_value",
    )


KPI_COLUMNS = ("countries", "with_data", "mean_value", "max_value", "min_value")


def kpi_text(kpis: DataFrame) -> DataFrame:
    """F11 on D5: the KPI row as the dashboard shows it -- counts as ``1,234``;
    mean, max and min as ``1,234.56``, present only when some row has data."""
    keys = [c for c in kpis.columns if c not in KPI_COLUMNS]
    shown = F.col("with_data") > 0
    return kpis.select(
        *keys,
        count_text("countries").alias("countries_text"),
        count_text("with_data").alias("with_data_text"),
        *[F.when(shown, number_text(c)).alias(f"{c}_text") for c in ("mean_value", "max_value", "min_value")],
    )


def country_means(
    rows: DataFrame,
    group_cols: Sequence[str],
    country_col: str = "ADMIN",
    value_col: str = "value",
) -> DataFrame:
    """Mean value per country within each group; NULL countries and values
    are dropped first (``dropna`` then ``groupby().mean()``).  The aggregates skip
    NULL values, and groups of nothing else go after them: a filter on the value
    would be moved to the scan and derive it a second time there."""
    return (
        rows.where(F.col(country_col).isNotNull())
        .groupBy(*group_cols, country_col)
        .agg(F.avg(value_col).alias("mean_value"), F.count(value_col).alias("n_values"))
        .where("n_values > 0")
    )


def choropleth_scale(
    merged: DataFrame,
    group_cols: Sequence[str] = ("dataset",),
    value_col: str = "value",
) -> DataFrame:
    """A12 + P16 + P17: per merged row, ``no_data`` and the value scaled to
    [0, 1] by the group's min and max (NULL when min = max or no value); per
    group, ``has_data`` tells a coloured map from a plain one.

    Group extremes come from one partial aggregation and join back (one row per
    group)."""
    group_cols = list(group_cols)
    ext = merged.groupBy(*group_cols).agg(
        F.min(value_col).alias("__min"),
        F.max(value_col).alias("__max"),
        F.max(F.col(value_col).isNotNull()).alias("has_data"),
    )
    j = merged.join(ext, group_cols, "inner")
    span = F.col("__max") - F.col("__min")
    return j.select(
        *[c for c in merged.columns],
        F.col(value_col).isNull().alias("no_data"),
        F.when(span > 0, (F.col(value_col) - F.col("__min")) / span).alias("scaled_value"),
        "has_data",
    )


def profile(
    df: DataFrame,
    group_cols: Sequence[str],
    text_cols: Sequence[str],
    numeric_cols: Sequence[str],
    approx_percentiles: bool = False,
) -> DataFrame:
    """A ``describe(include="all")`` profile per group, one row per column.

    Text columns get ``count, unique, top, freq``; numeric columns get
    ``count, mean, std, min, p25, p50, p75, max`` (sample std, linearly
    interpolated percentiles); the other statistics are NULL.  ``top`` breaks
    count ties by the smallest value.  NaN counts as missing.

    Plan: one pass over the input.  Every column is unpivoted and counted per
    (group, column, value) -- a partial + final aggregation, so a frequent value
    is one row per task across the shuffle.  Those counts are stored once in the
    shared folder, and every statistic derives from them: text statistics and
    numeric sums, extremes and counts in one aggregation; the standard deviation
    in a second pass around the mean (numerically stable); exact percentiles by
    a distributed sort of the distinct values (``quantiles.exact_percentiles``),
    so no task holds a whole group.  ``approx_percentiles=True`` uses
    ``percentile_approx`` instead.
    """
    from ..sources.store import materialize

    g = list(group_cols)
    keys = g + ["column_name"]
    no_text, no_number = F.lit(None).cast("string"), F.lit(None).cast("double")
    entries = [
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("t"), no_number.alias("x"))
        for c in text_cols
    ] + [
        F.struct(F.lit(c).alias("column_name"), no_text.alias("t"),
                 F.nanvl(F.col(c).cast("double"), no_number).alias("x"))
        for c in numeric_cols
    ]
    stacked = df.select(*g, F.inline(F.array(*entries)))
    counts = materialize(
        stacked.groupBy(*keys, "t", "x").agg(F.count(F.lit(1)).alias("n")), "profile-counts"
    )

    t, x, n = F.col("t"), F.col("x"), F.col("n")
    is_text = F.col("column_name").isin(list(text_cols)) if text_cols else F.lit(False)
    stats = counts.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(t.isNotNull() | x.isNotNull(), n)), F.lit(0)).cast("long").alias("count"),
        F.count(t).cast("long").alias("__unique"),
        F.min_by(F.struct(t.alias("v"), n.alias("c")), F.when(t.isNotNull(), F.struct(-n, t))).alias("__top"),
        F.sum(x * n).alias("__sum"),
        F.min(x).alias("min"),
        F.max(x).alias("max"),
    )
    stats = stats.withColumn("mean", F.when(F.col("count") > 0, F.col("__sum") / F.col("count")))
    # second pass around the mean: sum of squared deviations per group
    dev = (
        counts.where(x.isNotNull())
        .join(stats.select(*keys, F.col("mean").alias("__mean")), keys, "inner")
        .groupBy(*keys)
        .agg(F.sum(n * (x - F.col("__mean")) * (x - F.col("__mean"))).alias("__ss"))
    )
    if approx_percentiles:
        q = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))
        raw = stacked.where(x.isNotNull())
        pct = raw.groupBy(*keys).agg(F.percentile_approx("x", q, 10000).alias("__p")).select(
            *keys, *[F.col("__p")[i].alias(c) for i, c in enumerate(("p25", "p50", "p75"))]
        )
    else:
        pct = exact_percentiles(counts.where(x.isNotNull()), keys, "x", count_col="n")
    out = stats.join(dev, keys, "left").join(pct, keys, "left")
    numeric = ~is_text
    return out.select(
        *keys,
        "count",
        F.when(is_text, F.col("__unique")).alias("unique"),
        F.when(is_text, F.col("__top.v")).alias("top"),
        F.when(is_text, F.col("__top.c")).cast("long").alias("freq"),
        F.when(numeric, F.col("mean")).alias("mean"),
        F.when(numeric & (F.col("count") > 1), F.sqrt(F.col("__ss") / (F.col("count") - 1))).alias("std"),
        F.when(numeric, F.col("min")).alias("min"),
        F.when(numeric, F.col("p25")).alias("p25"),
        F.when(numeric, F.col("p50")).alias("p50"),
        F.when(numeric, F.col("p75")).alias("p75"),
        F.when(numeric, F.col("max")).alias("max"),
    )
