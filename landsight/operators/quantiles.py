"""Exact percentiles without gathering a group in one task (used by A8).

Spark's ``percentile`` aggregate is exact but merges a group's whole
value -> count map in one task; a group holding a third of all rows with a
wide value domain does not fit there.  This computes the same linearly
interpolated percentiles (pandas ``quantile``, DuckDB ``quantile_cont``) with
a distributed sort:

1. count rows per (group, value) -- map-side combined, so a frequent value is
   one row whatever its count (or take such counts as input);
2. range-partition the distinct (group, value) pairs and sort them inside each
   partition: a big group spreads over many partitions;
3. rank = rows of the group in earlier partitions (a small per-partition,
   per-group table) + running count inside the partition;
4. each requested position (floor and ceil of ``q * (n - 1)``) is located in
   its range partition via the small offset table, and the values at those
   ranks are picked by an equi-join on (group, partition) -- so a hot group's
   values stay spread over its partitions -- then interpolated.

The offset and target tables grow with the number of groups, so they carry no
broadcast hint: AQE broadcasts them when their run-time size is small (the
usual case) and otherwise plans a shuffle join whose skewed partitions it
splits.  No step holds more than one range partition of the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def exact_percentiles(
    df: DataFrame,
    group_cols: Sequence[str],
    value_col: str,
    quantiles: Sequence[float] = (0.25, 0.5, 0.75),
    num_partitions: int | None = None,
    count_col: str | None = None,
) -> DataFrame:
    """Per group: ``p{q}`` columns (e.g. ``p25, p50, p75``) of ``value_col``,
    NULL values ignored, NULL when the group has no value.  With ``count_col``
    the input is already one row per (group, value) with its row count."""
    g = list(group_cols)
    if count_col:
        counts = df.where(F.col(value_col).isNotNull()).select(
            *g, F.col(value_col).alias("__v"), F.col(count_col).alias("__c")
        )
    else:
        counts = (
            df.where(F.col(value_col).isNotNull())
            .groupBy(*g, F.col(value_col).alias("__v"))
            .agg(F.count(F.lit(1)).alias("__c"))
        )
    n_parts = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = (
        counts.repartitionByRange(n_parts, *[F.col(c) for c in g], F.col("__v"))
        .withColumn("__pid", F.spark_partition_id())
    )
    # Several branches read the partition ids, so they are stored: two runs of
    # the range exchange could sample other bounds.
    from ..sources.store import materialize

    ranged = materialize(ranged, "percentile-ranges")
    # rows of each group per range partition, and the offset of each partition
    per_part = ranged.groupBy(*g, "__pid").agg(F.sum("__c").alias("__pc"))
    w_off = Window.partitionBy(*g).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select(
        *g, "__pid", "__pc",
        F.coalesce(F.sum("__pc").over(w_off), F.lit(0)).alias("__off"),
    )
    totals = per_part.groupBy(*g).agg(F.sum("__pc").alias("__n"))
    # running count inside a range partition (bounded by the partition size)
    w_run = Window.partitionBy("__pid", *g).orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = ranged.withColumn("__run", F.sum("__c").over(w_run)).join(
        offsets.drop("__pc"), g + ["__pid"], "inner"
    )
    # 0-based rank interval of each distinct value: [hi - c, hi)
    ranked = ranked.select(
        *g, "__pid", "__v", (F.col("__off") + F.col("__run")).alias("__hi"), "__c"
    )
    # target positions: floor and ceil of q * (n - 1) for each requested q
    targets = totals.select(
        *g, "__n",
        F.explode(F.array(*[F.lit(float(q)) for q in quantiles])).alias("__q"),
    ).withColumn("__pos", F.col("__q") * (F.col("__n") - 1))
    targets = targets.select(
        *g, "__q", "__pos",
        F.explode(F.array_distinct(F.array(F.floor("__pos"), F.ceil("__pos")))).alias("__k"),
    )
    # the range partition holding each target rank (small x small: per group,
    # a few targets against one row per partition)
    located = targets.join(offsets, g, "inner").where(
        (F.col("__k") >= F.col("__off")) & (F.col("__k") < F.col("__off") + F.col("__pc"))
    ).select(*g, "__pid", "__q", "__pos", "__k")
    # joined on (group, partition): a hot group stays spread over its range
    # partitions instead of meeting its targets in one task
    hit = ranked.join(located, g + ["__pid"], "inner").where(
        (F.col("__k") >= F.col("__hi") - F.col("__c")) & (F.col("__k") < F.col("__hi"))
    )
    picked = hit.groupBy(*g, "__q", "__pos").agg(
        F.min_by("__v", "__k").alias("__lo_v"),
        F.max_by("__v", "__k").alias("__hi_v"),
    )
    frac = F.col("__pos") - F.floor("__pos")
    value = F.col("__lo_v") + (F.col("__hi_v") - F.col("__lo_v")) * frac
    out = picked.groupBy(*g).pivot("__q", [float(q) for q in quantiles]).agg(F.first(value))
    names = {str(float(q)): f"p{int(round(q * 100))}" for q in quantiles}
    return out.select(*g, *[F.col(f"`{k}`").alias(v) for k, v in names.items()])
